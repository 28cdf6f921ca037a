"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.scratch import checkpoints  # noqa: F401: operators take it from here

#: The ASCII white space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a regular expression's class, and its complement.
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by position: other columns may have any names, also equal ones or the operator's own."""
    there = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(there))])
    return flat.select(*[F.col(f"c{there.index(n)}").alias(n) for n in names])


def packed(df: DataFrame, *names: str) -> DataFrame:
    """The named columns beside the whole row as `row`, so that an operator's own names can't clash with it."""
    there = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(there))])
    return flat.select(F.struct(*flat.columns).alias("row"), *[F.col(f"c{there.index(n)}").alias(n) for n in names])


def unpacked(df: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The rows of packed() under their own names again, some columns changed."""
    cols = [changed.get(n, F.col(f"row.c{i}")) for i, n in enumerate(like.columns)]
    return df.select(*cols).toDF(*like.columns)


def word_count(text: Column) -> Column:
    """Words of a text, as a long; a null text has none."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")
    return F.size(words).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_runs(batches, column: int, chars: int):
    """Arrow batches in slices of about `chars` bytes of a text column; a longer text is a slice of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + chars, side="right")))
            yield b.slice(at, to - at)
            at = to


def slices(batches, rows: int = 256):
    """Arrow batches in slices, so that what a Python worker holds as lists stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
