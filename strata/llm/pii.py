"""Personal data by weak supervision, with DataFrame functions only.

Spans of nine kinds are found by patterns: the base kinds email, ip, card and phone, whose spans always stay, and
candidates of five more. Four labelers vote on each span for, against or not at all: its format (regex), word and code
lists (gazetteer), cues before it (context), and the variety of its characters. The counts of vote patterns over all
documents, a few thousand rows at most whatever the corpus, go to the driver; expectation-maximisation estimates each
labeler's reliability and each kind's rate, and its posteriors train the final span classifier, a logistic function
of kind and votes that runs as a Spark expression. Candidates scoring `threshold` or more that overlap no base span
are added. Texts are read once: spans and their votes are written by checkpoint(), and counts and results come from those.

Matching finds a pattern's hits and the text between them; a hit starts where the lengths before it end, so positions
count code points. Nulls and edges: a null or empty text has no spans; spans are end exclusive; ties can't occur inside a
kind; repeated rows give repeated results; an empty table gives an empty result; texts of any length are read whole; a
doc_id of any type is passed through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import checkpoints, let, picked

BASE = ("email", "ip", "card", "phone")
EXTRA = ("obfuscated", "national", "ssn", "iban", "name")
LABELERS = ("format", "gazetteer", "context", "variety")

#: A run of a class can begin at its first character or right after a hit; then possessive runs lose no match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "obfuscated": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?[(\[]dot[)\]]\x20?[A-Za-z0-9-]++)++",
    "national": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?",
}
#: What a text must contain for a kind to be looked for.
NEEDS = {"email": "@", "phone": "+", "obfuscated": "[(\\[]at[)\\]]", "name": "(?:Mr|Mrs|Ms|Dr|Prof)\\.?\\x20[A-Z]"}
# Gazetteers and context cues.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "it", "nl", "eu", "ch", "at", "us", "ca")
NAMES = ("james", "mary", "john", "anna", "david", "maria", "peter", "laura", "paul", "julia", "thomas", "sofia", "jean", "claire", "hans", "carlos")
IBAN_COUNTRIES = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
CUES = "e-?mail|contact|write|phone|tel|call|mobile|fax|card|visa|payment|ssn|social|iban|account|address|host|server|name|signed"
AGAINST = "version|release|isbn|issn|order|invoice|section|chapter|serial|build|part"
BEFORE, BLOCK = 32, 128


def occurrences(text: Column, kind: str) -> Column:
    """array<struct<hit, start, before>> of a pattern's leftmost, non-overlapping hits in a text."""
    pattern = PATTERNS[kind]

    def total(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0), lambda s, y: s + y)

    def block_of(i: Column) -> Column:
        return F.floor(i / BLOCK).cast("int")

    def block_sums(numbers: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), block_of(F.size(numbers) - 1)), lambda b: total(F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK))))

    def place(x: Column) -> Column:
        hits, gaps = x["hits"], x["gaps"]
        lengths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))

        def at(y: Column) -> Column:
            """Sums by block keep the work far from the square of the number of hits."""
            def start(i: Column) -> Column:
                earlier = total(F.slice(y["b"], F.lit(1), block_of(i)))
                return earlier + total(F.slice(y["l"], block_of(i) * BLOCK + 1, i % BLOCK)) + F.length(F.get(gaps, i))

            before = lambda i: F.substring(F.get(gaps, i), -BEFORE, BEFORE).alias("before")
            return F.transform(hits, lambda h, i: F.struct(h.alias("hit"), start(i).cast("long").alias("start"), before(i)))

        return F.when(F.size(hits) > 0, let(lengths, lambda a: let(F.struct(block_sums(a).alias("b"), a.alias("l")), at)))

    found = let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern).alias("gaps")), place)
    need = NEEDS.get(kind, "[0-9]")
    maybe = F.contains(text, F.lit(need)) if len(need) == 1 else text.rlike(need)
    return F.coalesce(F.when(maybe, found), F.expr("cast(array() as array<struct<hit: string, start: bigint, before: string>>)"))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)
    digit = lambda i: F.substring(number, n - i, F.lit(1)).cast("int")
    worth = lambda i: F.when(i % 2 == 1, F.when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)).otherwise(digit(i))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def holds(kind: str, hit: Column) -> Column:
    """What a hit must fulfil beyond its pattern."""
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255")))
    if kind == "card":
        return let(digits(hit), lambda d: F.length(d).between(16, 19) & luhn(d))
    if kind == "phone":
        return F.length(digits(hit)).between(8, 15)
    return F.lit(True)


def found(text: Column, kinds: tuple[str, ...]) -> Column:
    """array<struct<kind, start, stop, hit, before>> of the kinds, in their order, then by start."""
    def one(kind: str) -> Column:
        ok = F.filter(occurrences(text, kind), lambda x: holds(kind, x["hit"]))
        stop = lambda x: (x["start"] + F.length(x["hit"])).alias("stop")
        named = lambda x: [x[n].alias(n) for n in ("hit", "before")]
        return F.transform(ok, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), stop(x), *named(x)))

    return F.concat(*[one(k) for k in kinds])


def votes(x: Column) -> dict[str, Column]:
    """Each labeler's vote on a span: 1 personal, -1 not, 0 abstains."""
    kind, hit = x["kind"], x["hit"]
    among = lambda v, options: F.when(v.isin(*options), 1).otherwise(-1)
    mail, first = kind.isin("email", "obfuscated"), F.substring(hit, 1, 1)
    form = (
        F.when(kind == "email", F.when(hit.rlike(r"\.[A-Za-z]{2,}$") & ~hit.rlike(r"^\.|\.\.|\.@"), 1).otherwise(-1))
        .when(kind == "ip", F.when(hit.rlike(r"(?:^|\.)0[0-9]|^0\."), -1).otherwise(1))
        .when(kind == "card", F.when(first.isin("3", "4", "5", "6"), 1).otherwise(-1))
        .when(kind == "phone", F.when(hit.rlike(r"^\+0"), -1).otherwise(1))
        .when(kind == "ssn", F.when(hit.rlike(r"^(?:000|666|9)|-00-|-0000$"), -1).otherwise(1))
        .when(kind == "national", F.when(hit.rlike(r"^\(?[01]"), -1).otherwise(1))
        .when(kind == "iban", F.when(F.length(F.replace(hit, F.lit(" "), F.lit(""))).between(15, 34), 1).otherwise(-1))
        .otherwise(0)
    )
    lists = (
        F.when(mail, among(F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1)), DOMAINS))
        .when(kind == "ip", F.when(hit.rlike(r"^(?:10|127|0|192\.168)\."), -1).otherwise(0))
        .when(kind == "iban", among(F.substring(hit, 1, 2), IBAN_COUNTRIES))
        .when(kind == "name", F.when(F.lower(F.regexp_extract(hit, r"\x20([A-Z][a-z]+)", 1)).isin(*NAMES), 1).otherwise(0))
        .otherwise(0)
    )
    near = F.lower(x["before"])
    cue = F.when(near.rlike(AGAINST), -1).when(near.rlike(CUES), 1).otherwise(0)
    kinds_of = F.size(F.array_distinct(F.split(hit, "")))
    return {"format": form, "gazetteer": lists, "context": cue, "variety": F.when(kinds_of <= 3, -1).when(kinds_of >= 6, 1).otherwise(0)}


def voted(x: Column) -> Column:
    """A span with its votes in place of its text."""
    return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), *[v.cast("byte").alias(n) for n, v in votes(x).items()])


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, more): the spans of the base kinds and of the others in each document, written once."""
    checkpoints(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = lambda kinds: F.transform(found(text, kinds), voted)
    return picked(docs, "doc_id", "text").select("doc_id", spans(BASE).alias("base"), spans(EXTRA).alias("more")).checkpoint()


def pattern_counts(spans: DataFrame) -> list[tuple[str, tuple[int, ...], int]]:
    """(kind, votes, count) over every span of every document: at most 9 * 81 rows."""
    rows = spans.select(F.explode(F.concat("base", "more")).alias("x")).select("x.*").groupBy("kind", *LABELERS).count().collect()
    return sorted((r["kind"], tuple(r[n] for n in LABELERS), r["count"]) for r in rows)


def reliabilities(counts, rounds: int = 40) -> tuple[dict, dict, dict]:
    """Expectation-maximisation over two classes: (rate of each kind, P(vote | class) of each labeler, posterior of each pattern).

    Starts from majority votes; pseudo-counts say that a labeler is right four times of five.
    """
    post = {(k, v): 1 / (1 + math.exp(-sum(v))) for k, v, _ in counts}
    table, rate = {}, {}
    for _ in range(rounds):
        rate = {k: 1.0 for k in BASE + EXTRA}
        seen = {k: 2.0 for k in rate}
        table = {(j, c, x): (8.0 if x == (1 if c else -1) else 2.0 if x else 5.0) for j in range(len(LABELERS)) for c in (0, 1) for x in (-1, 0, 1)}
        for k, v, n in counts:
            p = post[k, v]
            rate[k] += n * p
            seen[k] += n
            for j, x in enumerate(v):
                table[j, 1, x] += n * p
                table[j, 0, x] += n * (1 - p)
        rate = {k: rate[k] / seen[k] for k in rate}
        for j in range(len(LABELERS)):
            for c in (0, 1):
                s = sum(table[j, c, x] for x in (-1, 0, 1))
                for x in (-1, 0, 1):
                    table[j, c, x] /= s
        for k, v, _ in counts:
            odds = math.log(rate[k] / (1 - rate[k])) + sum(math.log(table[j, 1, x] / table[j, 0, x]) for j, x in enumerate(v))
            post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return rate, table, post


def train(counts, rounds: int = 400, rate: float = 0.5) -> dict[str, float]:
    """Weights of the logistic span classifier, fitted to the posteriors by gradient descent; its votes start from the labelers' log odds."""
    _, table, post = reliabilities(counts)
    w = {n: (math.log(table[j, 1, 1] / table[j, 0, 1]) - math.log(table[j, 1, -1] / table[j, 0, -1])) / 2 for j, n in enumerate(LABELERS)} | {k: 0.0 for k in BASE + EXTRA}
    total = {}
    for k, _, n in counts:
        total[k] = total.get(k, 0) + n
    for _ in range(rounds):
        grad = dict.fromkeys(w, 0.0)
        for k, v, n in counts:  # kinds count alike, however many spans they have
            z = w[k] + sum(w[l] * x for l, x in zip(LABELERS, v))
            err = (post[k, v] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * n / total[k]
            grad[k] += err
            for l, x in zip(LABELERS, v):
                grad[l] += err * x
        for key in w:
            w[key] += rate * (grad[key] - 1e-3 * w[key])
    return w


def score(x: Column, weights: dict[str, float]) -> Column:
    """The classifier's probability for a span with its votes, as an expression."""
    z = F.element_at(F.create_map(*[F.lit(y) for k in BASE + EXTRA for y in (k, round(weights[k], 9))]), x["kind"])
    for name in LABELERS:
        z = z + x[name] * F.lit(round(weights[name], 9))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each document."""
    rows = candidates(docs)
    weights = train(pattern_counts(rows))
    apart = lambda y: ~F.exists("base", lambda b: (b["start"] < y["stop"]) & (b["stop"] > y["start"]))
    out = rows.select("doc_id", "base", F.filter("more", lambda y: apart(y) & (score(y, weights) >= threshold)).alias("added"))
    named = lambda a: F.array_join(F.transform(a, lambda y: F.concat_ws(":", y["kind"], y["start"], y["stop"])), ",")
    count = lambda k: F.size(F.filter("base", lambda y: y["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id", *map(count, BASE), F.sha2(named(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        named(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
