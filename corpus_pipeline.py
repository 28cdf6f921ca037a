"""A corpus pipeline over documents: quality rules, near-dedup, secret redaction, mixing, BPE encoding.

Each stage works on all that the one before kept. Documents that the quality rules reject go; of each near-duplicate
group the one of least id stays; secrets are replaced in the text; the mix repeats and cuts documents as its budgets
say; the last stage returns token ids, one row a mixed document.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from strata.llm import mixing, neardup, quality, secrets, tokens
from strata.llm.common import checkpoints, table
from strata.sources.files import HadoopFiles


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.encoded(docs)


STAGES = [("quality_rules", rules), ("near_dedup", dedup), ("secret_scan", redact), ("mixing", mix), ("bpe", encode)]

#: Hashes, learned rules and components aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages rows are written to the shared checkpoint folder and read again.

    A stage's rows go once the next stage's are written; the last ones are what the result reads.
    """
    base = f"{checkpoints(spark)}/pipeline-{uuid4().hex}"
    files, before = HadoopFiles(spark, base), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            files.delete(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
