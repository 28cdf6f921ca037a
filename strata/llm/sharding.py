"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled by a seeded hash within each source and ranked; their fractional rank, (rank + 1/2) / rows of the
source, interleaves the sources in proportion; cutting that order into equal counts gives each shard the whole
mixture. Both orders are counted over ranges first, so neither a hot source nor the whole order lies in one task.

Keys hash id and text, so rows of a null or repeated id are spread like others.

Nulls and edges: a null source is a source of its own; a null text is empty and has 0 bytes; a null id hashes as an empty
string; rows that tie are ordered by checksum and size, and those that tie still, repeated rows, are interchangeable; an
empty table gives an empty result; shards beyond the number of rows stay empty; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import checkpoints, picked
from strata.llm.mixing import hash_key, source_group
from strata.plans.prefix import prefix_sums

SHARDS, SEED, ROW_BYTES = 40, "shard-1", 16
#: Ranges of the hash within a source, as hex digits, and of the fractional rank.
RANGE_DIGITS, FRACTIONS = 3, 4096


def shards(docs: DataFrame, n: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law `rows`: counts differ by one at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = picked(docs, "doc_id", "text", "source").select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        source_group(F.col("source")).alias("grp"), hash_key(F.col("doc_id"), F.col("text"), seed).alias("key"),
    )
    checkpoints(docs.sparkSession)
    rows = rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS)).checkpoint()  # narrow: texts are read once
    tie = [F.col("key"), F.col("text_crc32"), F.col("size")]
    ranked = prefix_sums(rows, ["grp"], "range", tie, {"rank": F.lit(1)})
    counts = rows.groupBy("grp").agg(F.count("*").alias("n"))
    placed = ranked.join(counts, "grp").withColumn("fraction", (F.col("rank") + F.lit(0.5)) / F.col("n"))
    placed = placed.withColumn("part", F.floor(F.col("fraction") * FRACTIONS)).drop("n", "rank", "range")
    line = prefix_sums(placed, [], "part", [F.col("fraction"), *tie], {"at": F.lit(1)})
    total = counts.agg(F.sum("n").alias("total"))  # one row
    cut = line.join(F.broadcast(total)).withColumn("shard", F.expr(f"at * {n} div total"))
    return cut.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.expr(f"at - (shard * total + {n - 1}) div {n}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


#: DuckDB has no crc32, so the checksum's column and its part in ties are left to tests.
ORACLE = None
