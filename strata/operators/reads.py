"""Point reads, ordered scans and seeks as of a sequence number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.plans.prefix import neighbour_in_order
from strata.schema import MAX_SEQ, SET


def as_of(log: DataFrame, seq: int | None = None) -> DataFrame:
    """Mutations with sequence number at most `seq`; must stay below any choice of the newest version."""
    return log if seq is None else log.where(F.col("seq") <= F.lit(seq))


def latest_versions(log: DataFrame, seq: int | None = None) -> DataFrame:
    """The newest mutation of each key, tombstones included.

    The rank is compared with 1 directly above the window, so that Spark keeps one row a key in each task before
    the shuffle: a key with a third of all rows moves no more than others.
    """
    newest = Window.partitionBy("key").orderBy(F.col("seq").desc())
    return as_of(log, seq).withColumn("__rank", F.row_number().over(newest)).where("__rank = 1").drop("__rank")


def visible_at(log: DataFrame, seq: int | None = None) -> DataFrame:
    """Live (key, seq, value) rows: newest version of each key, tombstones removed."""
    return latest_versions(log, seq).where(F.col("kind") == SET).drop("kind")


def live_rows(log: DataFrame | None, plain: DataFrame | None) -> DataFrame:
    """Live (key, seq, value) rows of a log, and of rows of other keys that are known to be the newest: those aren't shuffled."""
    parts = [] if log is None else [visible_at(log)]
    parts += [] if plain is None else [plain.select("key", "seq", "value")]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def in_bounds(lower=None, upper=None) -> Column:
    """lower <= key < upper; None leaves a side open, an empty upper bound admits nothing."""
    keep = F.lit(True)
    if lower is not None:
        keep = keep & (F.col("key") >= F.lit(lower))
    if upper is not None:
        keep = keep & (F.col("key") < F.lit(upper))
    return keep


def range_scan(log: DataFrame, lower=None, upper=None, seq: int | None = None) -> DataFrame:
    """Live rows with lower <= key < upper; bounds reach the Parquet scan."""
    return visible_at(log.where(in_bounds(lower, upper)), seq)


def seek_ge(log: DataFrame, target=None, lower=None, upper=None, seq: int | None = None) -> DataFrame:
    """The first live row with key >= target, clamped up to the lower bound; no row if there is none."""
    starts = [x for x in (target, lower) if x is not None]
    return range_scan(log, max(starts, default=None), upper, seq).orderBy("key").limit(1)


def next_after(log: DataFrame, key, upper=None, seq: int | None = None) -> DataFrame:
    """The first live row with a key greater than `key`."""
    return visible_at(log.where((F.col("key") > F.lit(key)) & in_bounds(None, upper)), seq).orderBy("key").limit(1)


def first_n(log: DataFrame, n: int, lower=None, upper=None, seq: int | None = None) -> DataFrame:
    """The first n live rows in key order."""
    return range_scan(log, lower, upper, seq).orderBy("key").limit(n)


def get(log: DataFrame, key, seq: int | None = None) -> DataFrame:
    """One row (key, found, value): absent and deleted keys are both not found."""
    newest = F.max_by(F.struct("kind", "value"), "seq")
    row = as_of(log.where(F.col("key") == F.lit(key)), seq).agg(newest.alias("m"))
    found = F.coalesce(F.col("m.kind") == SET, F.lit(False))
    return row.select(F.lit(key).alias("key"), found.alias("found"), F.when(found, F.col("m.value")).alias("value"))


def multi_get(log: DataFrame | None, keys: DataFrame, seq: int | None = None, plain: DataFrame | None = None) -> DataFrame:
    """A row (key, found, value) for each distinct requested key; Spark broadcasts the keys only below its size limit."""
    wanted = keys.select("key").distinct()
    asked = lambda rows: None if rows is None else as_of(rows.join(wanted, "key", "left_semi"), seq)
    live = live_rows(asked(log), asked(plain)).select("key", "value", F.lit(True).alias("__hit"))
    return wanted.join(live, "key", "left").select("key", F.coalesce("__hit", F.lit(False)).alias("found"), "value")


def neighbours(view: DataFrame, bucket: Column) -> DataFrame:
    """Each live row with the next key of the whole key order; null for the last.

    Buckets must follow the key order and not be null. The next key is looked for inside each bucket; the last row of a
    bucket takes the least key of the next one that has rows, from a window over the buckets' least keys alone.
    """
    return neighbour_in_order(view.withColumn("__bucket", bucket), [], "__bucket", "key", F.col("key"), "next_key").drop("__bucket")


def oldest_snapshot(pins: DataFrame) -> DataFrame:
    """The smallest pinned seq, or the greatest possible one without pins."""
    return pins.agg(F.coalesce(F.min("seq"), F.lit(MAX_SEQ)).alias("oldest"))
