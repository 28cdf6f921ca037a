"""Prefix sums over one global order, without one task holding the whole order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbour_in_order(df: DataFrame, groups: Sequence[str], bucket: str, order: str, value: Column, name: str, ahead: bool = True) -> DataFrame:
    """Add `name`: the value of the next row of the group by `order` (ahead=False: of the row before), null where there is none.

    Buckets as in prefix_sums(). A bucket's last row takes the value of the next bucket's first row, from a window over
    the buckets' ends alone, so a group of any size is spread over as many tasks as it has buckets.
    """
    keys = [*groups, bucket]
    end = (F.min_by if ahead else F.max_by)(value, F.col(order))
    ends = df.groupBy(*keys).agg(end.alias("__end"))
    along, inside = Window.partitionBy(*groups).orderBy(bucket), Window.partitionBy(*keys).orderBy(order)
    beside = ends.select(*keys, (F.lead if ahead else F.lag)("__end").over(along).alias("__beside"), F.lit(True).alias("__known"))
    out = df.withColumn("__value", value).join(beside, keys)
    last = (F.lead if ahead else F.lag)("__known").over(inside).isNull()
    step = (F.lead if ahead else F.lag)("__value").over(inside)
    return out.withColumn(name, F.when(last, F.col("__beside")).otherwise(step)).drop("__value", "__beside", "__known")


def prefix_sums(df: DataFrame, groups: Sequence[str], bucket: str, order: Sequence[Column], sums: dict[str, Column], totals_of: DataFrame | None = None) -> DataFrame:
    """Add, for each name in `sums`, the sum of its column over all earlier rows of the group (0 for the first).

    The order is (bucket, *order). Buckets must follow it and must not be null, nor the groups. Totals by bucket
    are summed first (pre-aggregated before the shuffle); only those pass through a window over a whole group,
    so a group of any size is spread over as many tasks as it has buckets. `totals_of` may have the same columns already
    added up by bucket, so that `df` is read once.
    """
    keys = [*groups, bucket]
    totals = (df if totals_of is None else totals_of).groupBy(*keys).agg(*[F.sum(c).alias(f"__total_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, *[F.coalesce(F.sum(f"__total_{n}").over(before), F.lit(0)).alias(f"__start_{n}") for n in sums])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(starts, keys)
    added = {n: F.col(f"__start_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}
    return out.withColumns(added).drop(*[f"__start_{n}" for n in sums])
