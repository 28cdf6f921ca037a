"""Quality, personal data, sharding and mixing against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from strata.llm import mixing, pii, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(t):
    t = t or ""
    w = WORD.findall(t)
    seen, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["hard", "docs"])
def test_quality_statistics(spark, request, labels, which):
    docs = request.getfixturevalue(which)
    got = quality.quality_report(docs, labels).collect()
    want = Counter((r["doc_id"], *statistics(r["text"])) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_decision_list():
    r = random.Random(2)
    rows = []
    for i in range(600):
        bad = i % 6 == 0
        rows.append({f: r.random() for f in quality.FEATURES} | {"bad": bad, "symbols_per_word": r.uniform(0.4, 3) if bad else r.uniform(0, 0.3)})
    rules = quality.learn_list(rows)
    assert rules and all(any(all(c.holds(x) for c in rule) for rule in rules) == x["bad"] for x in rows)
    assert quality.learn_list([]) == [] and quality.learn_list([x | {"bad": False} for x in rows]) == []


def judged(t, rules):
    """Whether a text is kept, from the statistics counted here."""
    words, chars, symbols, dups, again = statistics(t)
    if words < 50 or 100 * again > 50 * words:
        return False
    t, n, c, lines = t or "", max(words, 1), max(chars, 1), max(1, sum(bool(WORD.search(x)) for x in (t or "").split("\n")))
    among = lambda p: len(re.findall(p, t))
    row = {
        "n_words": float(words), "mean_word": chars / n, "symbols_per_word": symbols / n, "dup_lines": dups / lines, "repeat_share": again / n,
        "digit_share": among("[0-9]") / c, "mark_share": among("[.,;:!?]") / c, "upper_share": among("[A-Z]") / c,
    }
    return not any(all(x.holds(row) for x in rule) for rule in rules)


def test_quality_verdicts(spark, docs, hard):
    rule = lambda *c: [quality.Condition(*x) for x in c]
    rules = [rule(("symbols_per_word", True, 0.175)), rule(("mean_word", True, 6.4), ("upper_share", False, 0.02)), rule(("dup_lines", True, 0.3)), rule(("digit_share", True, 0.05), ("mark_share", True, 0.01)), rule(("n_words", False, 60.0))]
    rows = docs.select("doc_id", "text").unionByName(hard.select("doc_id", "text"))
    got = quality.judge(rows, rules).select("doc_id", "text", "kept").collect()
    assert len({r.kept for r in got}) == 2 and all(r.kept == judged(r.text, rules) for r in got)


def test_quality_labels_held_out(spark):
    """The list fitted without a fifth of the labels tells those of that fifth."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rules = quality.fit(docs, labels.where("crc32(cast(doc_id as string)) % 5 <> 0"))
    held = labels.where("crc32(cast(doc_id as string)) % 5 = 0 and quality in (0, 1)").select("doc_id", "quality")
    got = quality.judge(docs.join(held, "doc_id"), rules).groupBy("quality", "kept").count().collect()
    count = {(r.quality, r.kept): r["count"] for r in got}
    assert rules and count[1, True] > 0.95 * (count[1, True] + count.get((1, False), 0))
    assert count[0, False] > 0.8 * (count[0, False] + count.get((0, True), 0))


def test_quality_ids_of_any_type(spark, hard):
    text = hard.selectExpr("cast(doc_id as string) as doc_id", "text")
    marks = spark.createDataFrame([("1", 0), ("5", 1), (None, 1)], "doc_id string, quality int")
    assert quality.quality_report(text, marks).count() == text.count()


def test_equal_hashes_are_no_equal_windows(spark, monkeypatch):
    """With a hash of few values, windows that only share it don't count as repeated."""
    real = quality.F.xxhash64
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: real(*c) % 3)
    r = random.Random(5)
    texts = [" ".join(r.choice("ab cd ef gh ij kl mn".split()) for _ in range(n)) for n in (3, 4, 9, 40, 200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.n_repeat_words for x in quality.with_statistics(rows).collect()}
    assert got == {i: statistics(t)[4] for i, t in enumerate(texts)}


def test_quality_keeps_columns_and_empty_table(hard, none, labels):
    kept = quality.keep_good(hard, labels)
    assert kept.columns == hard.columns and kept.count() == quality.quality_report(hard, labels).where("kept").count()
    assert quality.quality_report(none, labels.where("false")).count() == 0


def luhn(d):
    return sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def base_spans(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in BASE.items() if k != "email" or "@" in t for m in re.finditer(p, t) if ok(m[0])]


def test_personal_data(spark, docs, hard, none):
    r = random.Random(8)
    odd = ["a@b.c_d@e.f x.y@@q@r.s", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.4 999999999999.1.1.1", "+1 (499) 555-6503 +12 3", "4111 1111 1111 1111 4111-1111-1111-1111 1", "1 " * 5000, "a@b.c " * 2500, "é@ü.de ü+49 170 1234567 😀 a@b.co"]
    odd += ["".join(r.choice("a1.@+- ()2") for _ in range(r.randint(5, 120))) for _ in range(400)]
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(hard.select("doc_id", "text")).unionByName(more)
    want = Counter()
    for x in rows.collect():
        b = base_spans(x["text"] or "")
        want[x["doc_id"], hashlib.sha256(",".join(b).encode()).hexdigest(), *(sum(y.startswith(k) for y in b) for k in BASE)] += 1
    got = pii.personal_data(rows).collect()
    assert Counter((x.doc_id, x.base_sha256, x.n_email, x.n_ip, x.n_card, x.n_phone) for x in got) == want
    assert pii.personal_data(none).count() == 0


def test_personal_data_adds_spans(spark, docs):
    text = "mail john (at) foo (dot) com or call 212-555-1234, ssn 123-45-6789, Dr. John Smith IBAN DE89 3704 0044 0532 0130 00"
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, text)], "doc_id long, text string"))
    got = pii.personal_data(rows).where("doc_id = -1").first()
    assert got.n_added >= 4 and {x.split(":")[0] for x in got.spans.split(",")} >= {"obfuscated", "national", "ssn", "iban"}


def test_personal_data_by_weak_supervision_beats_the_patterns(spark):
    """Planted spans of the added kinds, half of them not personal by format or context: the classifier tells them, the patterns can't."""
    r = random.Random(21)
    n = lambda k: "".join(r.choice("123456789") for _ in range(k))
    real = [
        lambda: ("call me on ", f"{r.randint(2, 9)}{n(2)}-{n(3)}-{n(4)}"), lambda: ("my ssn is ", f"{r.randint(1, 5)}{n(2)}-{n(2)}-{n(4)}"),
        lambda: ("contact ", f"john{n(3)} (at) mail{n(2)} (dot) com"), lambda: ("signed ", f"Dr. {r.choice(('Mary', 'Peter', 'Laura'))} Hill"),
        lambda: ("iban account ", f"DE{n(2)} {n(4)} {n(4)} {n(4)} {n(4)} {n(2)}"),
    ]
    decoy = [
        lambda: ("order ", f"1{n(2)}-{n(3)}-{n(4)}"), lambda: ("serial ", f"9{n(2)}-00-{n(4)}"), lambda: ("version ", f"build{n(3)} (at) tag{n(2)} (dot) zzq"),
        lambda: ("part ", f"XX{n(2)} 1111 1111 1111"), lambda: ("invoice ", f"000-{n(2)}-0000"),
    ]
    rows, want, of = [], {}, {}
    for i in range(600):
        lead, span = r.choice(real if i % 2 else decoy)()
        filler = " ".join(r.choice(("river", "stone", "market", "bread", "tower")) for _ in range(r.randint(20, 30)))
        rows.append((i, f"{filler} {lead}{span}, {filler}"))
        want[i], of[i] = i % 2, len(filler) + 1 + len(lead)
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hits = {x.doc_id for x in got for s in x.spans.split(",") if s and int(s.split(":")[1]) == of[x.doc_id]}
    seen = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")).where("size(more) > 0").count()
    right = sum(want[i] for i in hits)
    assert right / len(hits) > 0.9 and right > 0.9 * 300 and seen > 500  # the patterns alone: about half are right


def test_reliabilities_prefer_agreeing_labelers():
    counts = [("email", (1, 1, 1, 1), 90), ("email", (-1, -1, 0, -1), 30), ("email", (1, 1, -1, 1), 10)]
    rate, table, post = pii.reliabilities(counts)
    assert post["email", (1, 1, 1, 1)] > 0.95 > 0.05 > post["email", (-1, -1, 0, -1)] and table[0, 1, 1] > table[2, 1, 1]


@pytest.mark.parametrize("which", ["hard", "docs", "none"])
def test_sharding(request, which):
    docs = request.getfixturevalue(which)
    got, rows = sharding.shards(docs).collect(), docs.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    sizes = [len(slots.get(i, [])) for i in range(40)]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("which", ["hard", "docs"])
def test_sharding_order(request, which):
    """Shards and slots by sorting all rows here: seeded hash within a source, then fractional rank."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    sources, total = defaultdict(list), 0
    for r in request.getfixturevalue(which).collect():
        t, i = r["text"] or "", "" if r["doc_id"] is None else str(r["doc_id"])
        row = (md5(f"{i}|{md5(t)}|shard-1"), zlib.crc32(t.encode()), len(t.encode()) + 16, r["doc_id"])
        sources["n" if r["source"] is None else "s" + r["source"]].append(row)
        total += 1
    line = []
    for rows in sources.values():
        rows.sort(key=lambda x: x[:3])
        line += [((k + 0.5) / len(rows), *x) for k, x in enumerate(rows)]
    line.sort(key=lambda x: x[:4])
    want, slots = Counter(), Counter()
    for at, x in enumerate(line):
        shard = at * 40 // total
        want[x[4], x[2], shard, slots[shard]] += 1
        slots[shard] += 1
    assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.shards(request.getfixturevalue(which)).collect()) == want


def test_shards_match_the_mixture(spark):
    docs = spark.createDataFrame([(i, "t", None, "big" if i % 4 else "small") for i in range(4000)], "doc_id long, text string, lang string, source string")
    source = {i: "big" if i % 4 else "small" for i in range(4000)}
    per = Counter((r.shard, source[r.doc_id]) for r in sharding.shards(docs).collect())
    assert all(abs(per[s, "small"] - 25) <= 1 for s in range(40))


def waterfill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > 2 * sizes[s]]
        if not over:
            return capped | {s: level * w[s] for s in free}
        for s in over:
            capped[s] = 2.0 * sizes[s]
            left -= capped[s]


@pytest.mark.parametrize("which", ["hard", "docs", "none"])
def test_mixing(request, which):
    docs = request.getfixturevalue(which)
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    want = waterfill(sizes)
    got = mixing.mix_counts(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_counts(docs.repartition(5)).collect()))
    assert len(got) == len(rows)
    by = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
    where = {(r["doc_id"], len(WORD.findall(r["text"] or ""))): r["source"] for r in rows}
    for r in got:
        by[where[r.doc_id, r.size]] += r.taken
        assert abs(r.target - want[where[r.doc_id, r.size]]) < 1e-6
    for s, t in by.items():
        assert t == int(want[s] + 1e-9)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in mixed.collect()) == sum(by.values())
