"""Mixing sources to target weights, with DataFrame functions only.

Documents get a key from a hash of their id and text; keys are sorted within each source by ranges of the key; prefix
sums of word counts say where each document lies in its source; the source's budget cuts that line exactly, after as
many whole epochs as fit. A hot source is spread over 16^RANGE_DIGITS key ranges, pre-aggregated before any window; so
are rows of a null or repeated id, which their texts tell apart.

Nulls and edges: a null source is a source of its own, last in order; a null text is empty and has no words; a null id
hashes as an empty string; repeated rows tie in key, and rows that tie are interchangeable; an empty table gives an empty
result; a source without words has target 0; texts of any length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import checkpoints, packed, picked, unpacked, word_count
from strata.plans.prefix import prefix_sums

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Hex digits of the key that name its range: 4,096 ranges a source, each ordered in a task of its own.
RANGE_DIGITS = 3


def hash_key(doc_id: Column, text: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))), F.lit(seed)))


def source_group(source: Column) -> Column:
    """A non-null name of a source: null is apart from every string."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(grp, source_size, target) from rows (grp, source, source_size), one row a source.

    Weights repeat over sources in code point order. Targets share `share` of all sizes by weight; a target stops at
    `cap` times its source's size, the excess going to the others. In order of cap / weight, a source is capped just
    if its share would exceed its cap when all before it are capped: prefix sums over the source table give the level.
    """
    place = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (((F.row_number().over(place) - 1) % len(weights)) + 1).cast("int"))
    weighed = totals.withColumn("w", w.cast("long")).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("w"), F.asc_nulls_last("source"))
    whole = Window.partitionBy()
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("most").over(earlier), F.lit(0))) / F.sum("w").over(later)
    levels = weighed.withColumns({"level": level, "place": F.row_number().over(order)}).withColumn("capped", F.col("level") * F.col("w") > F.col("most"))
    cut = F.min_by("level", F.when(~F.col("capped"), F.col("place"))).over(whole)
    return levels.select("grp", "source_size", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(cut * F.col("w")).alias("target"))


def sized(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """Add size, grp, key and range to rows (doc_id, text, source, ...); the text goes."""
    key = hash_key(F.col("doc_id"), F.col("text"), seed)
    out = rows.withColumns({"size": word_count(F.col("text")), "grp": source_group(F.col("source")), "key": key}).drop("text")
    return out.withColumn("range", F.substring("key", 1, RANGE_DIGITS))


def plan_mix(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Add source_size, target, epochs (whole passes) and part (words taken beyond them) to rows of sized().

    The words of a source form one line in key order; its budget is the target rounded down. Words are added up by range
    once, for the targets and for the line.
    """
    totals = rows.groupBy("grp", "source", "range").agg(F.sum("size").alias("size")).checkpoint()
    sizes = totals.groupBy("grp", "source").agg(F.sum("size").alias("source_size"))
    lines = prefix_sums(rows, ["grp"], "range", [F.col("key"), F.col("size")], {"before": F.col("size")}, totals)
    out = lines.join(source_targets(sizes, weights, share, cap), "grp")
    budget, whole = F.floor("target").cast("long"), F.greatest("source_size", F.lit(1))
    epochs = F.floor(budget / whole).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - F.col("before")))
    return out.withColumns({"epochs": epochs, "part": part.cast("long")}).drop("grp", "key", "range", "before")


def mix_counts(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of each document the mix takes, repeats counted."""
    checkpoints(docs.sparkSession)
    plan = plan_mix(sized(picked(docs, "doc_id", "text", "source"), seed).checkpoint(), **options)  # narrow: words are counted once
    return plan.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def leading_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, with its white space as it is."""
    ends = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(ends, 1, n.cast("int")), "")


def mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mixed documents: a row for each epoch that takes one whole, and one cut at the budget where it ends inside.

    A document without words is kept once.
    """
    checkpoints(docs.sparkSession)
    plan = plan_mix(sized(packed(docs, "doc_id", "text", "source"), seed).drop("doc_id"), **options)
    whole = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("epochs") + (F.col("part") == F.col("size")).cast("long"))
    partly = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    cut = F.when(partly, F.array(F.col("part"))).otherwise(F.array().cast("array<bigint>"))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), cut)
    body = F.col(f"row.c{docs.columns.index('text')}")
    text = F.when(F.col("words") < 0, body).otherwise(leading_words(body, F.col("words")))
    out = plan.withColumn("words", F.explode(copies)).withColumn("body", text)
    changed = {"text": F.col("body")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("words") < 0, F.col(f"row.c{docs.columns.index('n_chars')}")).otherwise(F.length("body").cast(kind))
    return unpacked(out, docs, **changed)


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) || '|mix-1') AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 2 AS most FROM s),
l AS (SELECT *, row_number() OVER o AS place, ((SUM(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(SUM(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (SUM(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w WINDOW o AS (ORDER BY most::DOUBLE / w::DOUBLE, source NULLS LAST)),
t AS (SELECT source, source_size, CASE WHEN level * w > most THEN most::DOUBLE ELSE w * (SELECT arg_min(level, place) FROM l WHERE NOT level * w > most) END AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  CAST(floor(t.target) AS BIGINT) AS budget FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((budget // greatest(source_size, 1)) * size
  + greatest(0, least(size, budget - (budget // greatest(source_size, 1)) * source_size - before)) AS BIGINT) AS taken FROM p
"""
