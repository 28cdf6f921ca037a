"""Quality rules: a learned decision list over text statistics, emitted as ordered Spark conditions.

Main path: built-in functions only. The list is fitted on the driver from statistics of at most `limit` labelled
documents (default 4,000, those of the smallest id hash; one row an id, the least text), by sequential covering: a rule
is grown, condition by condition, on two thirds of the rows, pruned on the rest, and its rows removed before the next. A list has
at most RULES rules of CONDITIONS conditions; a condition is looked for among THRESHOLDS thresholds of a feature. These
bound the model, not the documents that it judges.

Repeated windows are found exactly: where all hashes of a text's windows differ, none repeats; otherwise windows are
sorted by hash and words, and equal neighbours compared.

Nulls and edges: a null or empty text has no words and fails the base; labels that are null or not 0 or 1 don't count;
without labels, or without a precise rule, only the base decides; an empty table gives an empty result; rows that tie or
repeat are judged alike; a doc_id may be of any type that hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import SPACE, WORD, let, packed, picked, unpacked

LABELLED = 4_000
RULES, CONDITIONS, THRESHOLDS = 12, 4, 64
MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS, DIGITS, MARKS, CAPITALS = "#*$%&|<>", "0123456789", ".,;:!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Most of what no count of characters is taken of, as a class that is quick to match.
PLAIN = r"[a-z\x20]+"
FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_lines", "repeat_share", "digit_share", "mark_share", "upper_share")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.threshold if self.above else of[self.feature] <= self.threshold


def repeated(words: Column) -> Column:
    """How many words lie in windows of three words that occur twice or more."""
    places = lambda w: F.sequence(F.lit(1), F.size(w) - 2)
    hashed = lambda w, i: F.xxhash64(w[i - 1], w[i], w[i + 1])

    def spread(seen: Column) -> Column:
        """The words in windows that equal a neighbour in (hash, words, place) order."""
        equal = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
        same = lambda x, i: equal(x, F.get(seen, i + 1)) | ((i > 0) & equal(x, F.get(seen, i - 1)))
        inside = F.transform(F.filter(seen, same), lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))
        return F.size(F.array_distinct(F.flatten(inside)))

    def count(w: Column) -> Column:
        window = lambda i: F.struct(hashed(w, i).alias("h"), w[i - 1].alias("a"), w[i].alias("b"), w[i + 1].alias("c"), i.alias("p"))
        apart = let(F.transform(places(w), lambda i: hashed(w, i)), lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when((F.size(w) < 4) | apart, F.lit(0)).otherwise(let(F.sort_array(F.transform(places(w), window)), spread))

    return let(words, count).cast("long")


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def with_statistics(rows: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the raw counts of the features to rows with `text`."""
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    words = F.array_remove(F.split(t, SPACE + "+"), "")
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated(w).alias("again"))
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("kinds"))
    # One pass drops most other characters; what is left is short, and translate() is slow.
    among = lambda few, chars: (F.length(few) - F.length(F.translate(few, chars, ""))).cast("long")
    of_chars = lambda few: F.struct(among(few, SYMBOLS).alias("symbols"), among(few, DIGITS).alias("digits"), among(few, MARKS).alias("marks"), among(few, CAPITALS).alias("upper"))
    out = rows.withColumns({"q_words": let(words, of_words), "q_lines": let(lines, of_lines), "q_chars": let(F.regexp_replace(t, PLAIN, ""), of_chars)})
    n, again = F.col("q_words.n"), F.col("q_words.again")
    stats = F.struct(
        n.alias("n_words"), F.col("q_words.chars").alias("word_chars"), F.col("q_chars.symbols").alias("n_symbols"),
        (F.col("q_lines.n") - F.col("q_lines.kinds")).alias("n_dup_lines"), again.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * again > MAX_REPEAT * n)).alias("base_failed"),
        F.col("q_lines.n").alias("q_n_lines"), F.col("q_chars.digits").alias("q_digits"), F.col("q_chars.marks").alias("q_marks"), F.col("q_chars.upper").alias("q_upper"),
    )
    # The generator keeps later filters above it: pushed down, they would compute all this twice.
    return out.select(*rows.columns, F.inline(F.array(stats)))


def features() -> dict[str, Column]:
    """The features of the list over the columns of with_statistics()."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    of = lambda a, b: F.col(a).cast("double") / b
    return {
        "n_words": F.col("n_words").cast("double"), "mean_word": of("word_chars", words), "symbols_per_word": of("n_symbols", words),
        "dup_lines": of("n_dup_lines", F.greatest("q_n_lines", F.lit(1))), "repeat_share": of("n_repeat_words", words),
        "digit_share": of("q_digits", chars), "mark_share": of("q_marks", chars), "upper_share": of("q_upper", chars),
    }


def thresholds(values: list[float], most: int = THRESHOLDS) -> list[float]:
    """Midpoints between neighbouring distinct values, thinned to `most` evenly spaced ones."""
    v = sorted(set(values))
    mid = [(a + b) / 2 for a, b in zip(v, v[1:])]
    return mid if len(mid) <= most else [mid[i * len(mid) // most] for i in range(most)]


def covered(rule: list[Condition], rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(c.holds(r) for c in rule)]


def grow(rows: list[dict]) -> list[Condition]:
    """Add the condition of the greatest information gain until no good row is left or nothing gains."""
    rule: list[Condition] = []
    while True:
        p, n = sum(r["bad"] for r in rows), sum(not r["bad"] for r in rows)
        if not n or not p or len(rule) == CONDITIONS:
            return rule
        best, gain = None, 1e-9
        now = math.log2(p / (p + n))
        for f in FEATURES:
            for t in thresholds([r[f] for r in rows]):
                hi_p = sum(1 for r in rows if r["bad"] and r[f] > t)
                hi_n = sum(1 for r in rows if not r["bad"] and r[f] > t)
                for above, a, b in ((True, hi_p, hi_n), (False, p - hi_p, n - hi_n)):
                    if a and (g := a * (math.log2(a / (a + b)) - now)) > gain:
                        best, gain = Condition(f, above, t), g
        if best is None:
            return rule
        rule.append(best)
        rows = covered([best], rows)


def prune(rule: list[Condition], rows: list[dict]) -> list[Condition]:
    """The shortest beginning of the rule of the greatest (bad - good) / covered on held-back rows."""
    def worth(k: int) -> float:
        c = covered(rule[:k], rows)
        return (2 * sum(r["bad"] for r in c) - len(c)) / len(c) if c else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn_list(rows: list[dict], precision: float = 0.97, least: int = 3) -> list[list[Condition]]:
    """Rules in order, each of at least `precision` over the rows that it covers and with `least` bad rows; none if no rule is that good."""
    left, rules = rows, []
    while len(rules) < RULES and sum(r["bad"] for r in left) >= least:
        held = [r for i, r in enumerate(left) if i % 3 == 2]
        rule = prune(grow([r for i, r in enumerate(left) if i % 3 != 2]), held)
        hit = covered(rule, left) if rule else []
        bad = sum(r["bad"] for r in hit)
        if bad < least or bad < precision * len(hit):
            break
        rules.append(rule)
        left = [r for r in left if not all(c.holds(r) for c in rule)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> list[list[Condition]]:
    """The decision list of labels (doc_id, quality); the labelled sample, bounded by `limit`, is broadcast to the documents."""
    known = picked(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = picked(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # repeated ids don't swell the sample
    # Another hash than the one that picks the sample shuffles it, so that the split doesn't follow the ids.
    stats = with_statistics(one.select("doc_id", "quality", "text", F.xxhash64("doc_id", F.lit(1)).alias("place"))).where("not base_failed")
    got = stats.select("place", (F.col("quality") == 0).alias("bad"), *[c.alias(n) for n, c in features().items()]).collect()
    return learn_list(sorted((r.asDict() for r in got), key=lambda r: tuple(r.values())))


def verdict(rules: list[list[Condition]]) -> Column:
    """The name of the first rule that holds, or null: an ordered conditional expression."""
    of, out = features(), None
    for i, rule in enumerate(rules):
        cond = rule[0].column(of)
        for c in rule[1:]:
            cond = cond & c.column(of)
        out = F.when(cond, f"rule_{i}") if out is None else out.when(cond, f"rule_{i}")
    return F.lit(None).cast("string") if out is None else out


def judge(rows: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Add the statistics, `rule` (the rule that rejects, null if none) and `kept`."""
    out = with_statistics(rows).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_report(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule) for each document."""
    out = judge(picked(docs, "doc_id", "text"), fit(docs, labels, limit))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """The documents that pass, with their own columns."""
    out = judge(packed(docs, "text"), fit(docs, labels, limit))
    return unpacked(out.where("kept"), docs)
