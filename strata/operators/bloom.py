"""An explicit Bloom filter for a set of keys, built and probed with built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_count(bits_per_key: int) -> int:
    """Probes for each key: round(bits * ln 2), from 1 to 30."""
    return max(1, min(30, round(bits_per_key * math.log(2))))


def positions(key: Column, bits: Column, k: int) -> Column:
    """The k bit positions of a key: double hashing of the halves of a 64-bit hash."""
    h = F.xxhash64(key)
    lo, hi = F.shiftrightunsigned(F.shiftleft(h, 32), 32), F.shiftrightunsigned(h, 32)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (lo + i * hi) % bits)


def build(rows: DataFrame, file: str, bits_per_key: int = 10) -> DataFrame:
    """(file, bits, k, position): the set bits of each file's filter, one row a set bit."""
    k = hash_count(bits_per_key)
    keys = rows.select(file, "key").distinct()
    sizes = keys.groupBy(file).agg((F.count("*") * bits_per_key).alias("n")).select(file, F.greatest("n", F.lit(64)).alias("bits"))
    return keys.join(sizes, file).select(file, "bits", F.explode(positions(F.col("key"), F.col("bits"), k)).alias("position")).distinct().withColumn("k", F.lit(k))


def probe(filters: DataFrame, pairs: DataFrame, file: str) -> DataFrame:
    """(file, key, maybe) for the asked (file, key) pairs, such as those that range pruning leaves.

    maybe is false only if the file can't hold the key; a file without a filter admits every key.
    """
    k = F.col("k")
    head = filters.groupBy(file).agg(F.max("bits").alias("bits"), F.max("k").alias("k"))
    asked = pairs.select(file, "key").distinct().join(head, file, "left")
    h = F.xxhash64("key")
    lo, hi = F.shiftrightunsigned(F.shiftleft(h, 32), 32), F.shiftrightunsigned(h, 32)
    spots = asked.select(file, "key", F.explode_outer(F.transform(F.sequence(F.lit(0), k - 1), lambda i: (lo + i * hi) % F.col("bits"))).alias("position"))
    hits = spots.join(filters.select(file, "position", F.lit(1).alias("hit")), [file, "position"], "left")
    return hits.groupBy(file, "key").agg((F.count("position") == F.count("hit")).alias("maybe"))
