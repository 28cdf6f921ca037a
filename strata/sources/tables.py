"""Parquet tables of a dataset folder, and the mutation logs derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.keys import padded_key
from strata.schema import DELETE, SET


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(rows: DataFrame, key, seq, deleted, value) -> DataFrame:
    kind = F.when(deleted, F.lit(DELETE)).otherwise(F.lit(SET))
    return rows.select(padded_key(key).alias("key"), (seq + 1).cast("long").alias("seq"), kind.cast("int").alias("kind"), F.when(kind == SET, value).alias("value"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mutation for each event, keyed by user; an error event deletes."""
    return _log(table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id"), F.col("event_type") == "error", F.col("value"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mutation for each order, keyed by customer; a finished order deletes."""
    return _log(table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderstatus") == "F", F.col("o_totalprice"))
