"""Version analytics: history, diff, garbage collection, batch-atomic prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.reads import latest_versions, visible_at
from strata.plans.prefix import neighbour_in_order, prefix_sums
from strata.schema import DELETE, MAX_SEQ, SET

#: Sequence numbers that share a bucket of a global prefix sum.
SEQ_BUCKET = 65_536


def seq_bucket(width: int = SEQ_BUCKET) -> Column:
    return F.floor(F.col("seq") / width)


def version_history(log: DataFrame) -> DataFrame:
    """Each version with the half-open interval [seq, next_seq) in which it is the newest; null: still newest.

    A key's versions are ordered by ranges of seq, so a key with a third of all rows is spread over tasks.
    """
    rows = neighbour_in_order(log.withColumn("__bucket", seq_bucket()), ["key"], "__bucket", "seq", F.col("seq"), "next_seq")
    out = prefix_sums(rows, ["key"], "__bucket", [F.col("seq")], {"__rank": F.lit(1)})
    return out.withColumn("version", (F.col("__rank") + 1).cast("long")).select(*log.columns, "next_seq", "version")


def snapshot_diff(log: DataFrame, old: int, new: int) -> DataFrame:
    """Keys added, removed or changed between two sequence numbers, by one aggregation over the log.

    Both versions come from conditional aggregates, so the log is scanned and shuffled once; a value written anew
    with the same bytes isn't a change.
    """
    seq, version = F.col("seq"), F.struct("kind", "value")
    pick = lambda s: F.max_by(F.when(seq <= s, version), F.when(seq <= s, seq))
    both = log.where(seq <= max(old, new)).groupBy("key").agg(pick(old).alias("o"), pick(new).alias("n"))
    had, has = (F.coalesce(F.col(f"{x}.kind") == SET, F.lit(False)) for x in "on")
    change = F.when(~had & has, "added").when(had & ~has, "removed").when(had & has & ~F.col("o.value").eqNullSafe(F.col("n.value")), "changed")
    out = both.select("key", change.alias("change"), F.when(had, F.col("o.value")).alias("old_value"), F.when(has, F.col("n.value")).alias("new_value"))
    return out.where("change is not null")


def gc_versions(log: DataFrame, oldest: int = MAX_SEQ) -> DataFrame:
    """Drop each version whose next-newer version is already visible to the oldest snapshot.

    What stays are all versions after that snapshot and the newest that it sees; those are chosen in each task
    before the shuffle, so a key with a third of all rows moves no more than others.
    """
    seen = latest_versions(log, oldest)
    return seen if oldest >= MAX_SEQ else log.where(F.col("seq") > F.lit(oldest)).unionByName(seen)


def drop_tombstones(kept: DataFrame, oldest: int = MAX_SEQ, deeper: list[tuple] = ()) -> DataFrame:
    """Drop tombstones visible to all snapshots unless one of the `deeper` key ranges (lo, hi), both included, covers them.

    Apply after gc_versions: a tombstone shadows older versions in the same pass before it goes. The ranges come
    from a manifest, one for each file; merged, they are few.
    """
    dead = (F.col("kind") == DELETE) & (F.col("seq") <= oldest)
    covered = F.lit(False)
    for lo, hi in merged_ranges(deeper):
        covered = covered | F.col("key").between(F.lit(lo), F.lit(hi))
    return kept.where(~dead | covered)


def merged_ranges(ranges) -> list[tuple]:
    """Overlapping closed ranges joined into disjoint ones, in order."""
    out: list[tuple] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def drop_covered_tombstones(kept: DataFrame, oldest: int, ranges: DataFrame) -> DataFrame:
    """drop_tombstones with the ranges (lo, hi) in a DataFrame of a manifest's size: a range anti join."""
    dead = (F.col("kind") == DELETE) & (F.col("seq") <= oldest)
    safe = kept.where(dead).join(ranges, (F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi")), "left_semi")
    return kept.where(~dead).unionByName(safe)


def dedupe_replay(log: DataFrame) -> DataFrame:
    """One row for each (key, seq): replaying a log twice changes nothing."""
    return log.dropDuplicates(["key", "seq"])


def merge_runs(*runs: DataFrame) -> DataFrame:
    """The union of sorted runs with exact duplicates collapsed."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return dedupe_replay(out)


def batch_frontier(log: DataFrame, batch: Column, expected: Column) -> DataFrame:
    """For each batch: its last seq and whether all `expected` entries are there."""
    return log.groupBy(batch.alias("batch_id")).agg(F.max("seq").alias("last_seq"), F.count("*").alias("entries"), F.max(expected).alias("expected")).withColumn("complete", F.col("entries") == F.col("expected"))


def atomic_prefix(log: DataFrame, batches: DataFrame) -> DataFrame:
    """Rows up to the last batch before the first incomplete one."""
    bad = batches.where(~F.col("complete")).agg(F.min("batch_id").alias("__bad"))
    good = batches.join(F.broadcast(bad)).where(F.col("__bad").isNull() | (F.col("batch_id") < F.col("__bad"))).agg(F.max("last_seq").alias("__frontier"))
    return log.join(F.broadcast(good)).where(F.col("seq") <= F.col("__frontier")).drop("__frontier")


def valid_prefix(records: DataFrame, position: str, valid: Column) -> DataFrame:
    """Records before the first invalid one; that position is a single row, so it is broadcast."""
    bad = records.where(~valid).agg(F.min(position).alias("__bad"))
    return records.join(F.broadcast(bad)).where(F.col("__bad").isNull() | (F.col(position) < F.col("__bad"))).drop("__bad")


def live_keys_over_time(log: DataFrame, bucket_width: int = SEQ_BUCKET) -> DataFrame:
    """(seq, live_keys): the number of live keys after each mutation.

    Each mutation adds the change in its own key's liveness; the running sum is a bucketed prefix sum over seq.
    """
    alive = (F.col("kind") == SET).cast("long")
    marked = log.select("key", "seq", alive.alias("alive"), seq_bucket(bucket_width).alias("__bucket"))
    before = neighbour_in_order(marked, ["key"], "__bucket", "seq", F.col("alive"), "was", ahead=False)
    delta = before.select("seq", (F.col("alive") - F.coalesce("was", F.lit(0))).alias("delta"), "__bucket")
    sums = prefix_sums(delta, [], "__bucket", [F.col("seq")], {"before": F.col("delta")})
    return sums.select("seq", (F.col("before") + F.col("delta")).cast("long").alias("live_keys"))


def assign_seq(batch: DataFrame, base: int, ordinal: str = "ordinal", bucket_width: int = SEQ_BUCKET) -> DataFrame:
    """seq = base + rank of the ordinal: rows are counted by bucket of ordinals, then ranked inside each.

    Ordinals must not be null, nor stand twice: ties would be ranked in any order. write_frame() rejects both.
    """
    marked = batch.withColumn("__bucket", F.floor(F.col(ordinal) / bucket_width))
    out = prefix_sums(marked, [], "__bucket", [F.col(ordinal)], {"__rank": F.lit(1)})
    return out.withColumn("seq", (F.col("__rank") + F.lit(base)).cast("long")).drop("__rank", "__bucket")


def answers_changed(before: DataFrame, after: DataFrame, seq: int | None = None) -> DataFrame:
    """Rows of either visible view that the other lacks: none if a rewrite kept every answer."""
    a, b = (visible_at(x, seq).select("key", "value") for x in (before, after))
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def tombstones(log: DataFrame, seq: int | None = None) -> DataFrame:
    """Keys whose newest version is a deletion."""
    return latest_versions(log, seq).where(F.col("kind") == DELETE)
