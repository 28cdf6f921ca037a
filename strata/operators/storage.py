"""Runs, levels and amplification: storage planning as DataFrame queries over manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.schema import LEVELS


def run_of(ordinal: Column, entry_bytes: int, memtable_bytes: int) -> Column:
    """The run that an entry of constant size falls in: a run is sealed once it holds memtable_bytes or more."""
    return F.floor((ordinal - 1) / -(-memtable_bytes // entry_bytes)).cast("long")


def run_stats(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Entries, key range and seq range of each run, as a manifest lists them."""
    return runs.groupBy(run).agg(F.count("*").alias("entries"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def prune_files(manifest: DataFrame, lower=None, upper=None) -> DataFrame:
    """Files whose key range meets [lower, upper); a point lookup is lower = key, upper = key followed by a zero byte."""
    keep = F.lit(True)
    if lower is not None:
        keep = keep & (F.col("hi") >= F.lit(lower))
    if upper is not None:
        keep = keep & (F.col("lo") < F.lit(upper))
    return manifest.where(keep)


def covering_files(manifest: DataFrame, key) -> DataFrame:
    """Files whose closed key range holds the key."""
    return manifest.where(F.lit(key).between(F.col("lo"), F.col("hi")))


def level_metrics(manifest: DataFrame) -> DataFrame:
    """Tables and bytes of each level."""
    return manifest.groupBy("level").agg(F.count("*").alias("tables"), F.sum("size").alias("bytes"))


def level_scores(manifest: DataFrame, l0_trigger: int, base_bytes: int) -> DataFrame:
    """Level 0 scores tables / trigger, level n bytes / (base * 10^(n-1)); the last level is never a source."""
    target = F.lit(float(base_bytes)) * F.pow(F.lit(10.0), F.col("level") - 1)
    score = F.when(F.col("level") == 0, F.col("tables") / F.lit(l0_trigger)).otherwise(F.col("bytes") / target)
    return level_metrics(manifest).where(F.col("level") < LEVELS - 1).withColumn("score", score)


def pick_level(scores: DataFrame) -> DataFrame:
    """The level with the greatest score of at least 1; ties go to the deeper one."""
    due = scores.where("score >= 1")
    return due.orderBy(F.desc("score"), F.desc("level")).limit(1)


def overlapping(files: DataFrame, lo, hi) -> DataFrame:
    """Files whose closed key range meets [lo, hi]."""
    return files.where((F.col("lo") <= F.lit(hi)) & (F.col("hi") >= F.lit(lo)))


def compaction_inputs(manifest: DataFrame, level: int) -> DataFrame:
    """Pairs of each file of a level with the files of the next one that its key range meets; null: none.

    Manifests are bounded by files, not rows; Spark picks the join by their size.
    """
    a = manifest.where(F.col("level") == level).select(F.col("file_num").alias("src"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    b = manifest.where(F.col("level") == level + 1).select(F.col("file_num").alias("dst"), "lo", "hi")
    return a.join(b, (F.col("alo") <= F.col("hi")) & (F.col("ahi") >= F.col("lo")), "left").select("src", "dst")


def amplification(user: Column, wal: Column, flushed: Column, compacted: Column, live: Column) -> dict[str, Column]:
    """Write and space amplification from byte counters."""
    return {"write_amp": (wal + flushed + compacted) / user, "space_amp": live / user}


def disjoint_violations(manifest: DataFrame) -> DataFrame:
    """Files of a level below 0 whose key range meets the next file's."""
    w = Window.partitionBy("level").orderBy("lo", "hi")
    nxt = manifest.where("level > 0").withColumn("next_lo", F.lead("lo").over(w))
    return nxt.where(F.col("next_lo") <= F.col("hi"))


def order_violations(rows: DataFrame, file: str = "file_num", position: str = "position") -> DataFrame:
    """Rows of a file that aren't strictly after their predecessor in (key ascending, seq descending)."""
    w = Window.partitionBy(file).orderBy(position)
    prev = rows.withColumns({"__key": F.lag("key").over(w), "__seq": F.lag("seq").over(w)})
    return prev.where((F.col("__key") > F.col("key")) | ((F.col("__key") == F.col("key")) & (F.col("__seq") <= F.col("seq")))).drop("__key", "__seq")


def seq_violations(rows: DataFrame, last_seq: Column) -> DataFrame:
    """Rows numbered above the manifest's last seq."""
    return rows.where(F.col("seq") > last_seq)


def orphans(listing: DataFrame, manifest: DataFrame, on: str = "file_num") -> DataFrame:
    """Files in the directory that the manifest doesn't name."""
    return listing.join(manifest.select(on), on, "left_anti")


def missing(listing: DataFrame, manifest: DataFrame, on: str = "file_num") -> DataFrame:
    """Files that the manifest names and the directory lacks, or holds with another size."""
    l = listing.select(on, F.col("size").alias("__size"))
    return manifest.join(l, on, "left").where(F.col("__size").isNull() | (F.col("__size") != F.col("size"))).drop("__size")
