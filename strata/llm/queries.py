"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from strata.llm import hamming, htmltext, mixing, neardup, pii, quality, secrets, sharding, tokens, toxicity
from strata.llm.common import table


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def op1_simhash(spark, sf_dir):
    return neardup.near_duplicates(documents(spark, sf_dir))


def op2_secrets(spark, sf_dir):
    return secrets.secret_spans(documents(spark, sf_dir))


def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_topk(spark, sf_dir):
    return hamming.top_k(table(spark, sf_dir, "embeddings"))


def op5_html(spark, sf_dir):
    return htmltext.extracted(table(spark, sf_dir, "pages"))


def op6_pii(spark, sf_dir):
    return pii.personal_data(documents(spark, sf_dir))


def op7_bpe(spark, sf_dir):
    return tokens.digests(documents(spark, sf_dir))


def op8_sharding(spark, sf_dir):
    return sharding.shards(documents(spark, sf_dir))


def op9_mixing(spark, sf_dir):
    return mixing.mix_counts(documents(spark, sf_dir))


def op10_quality(spark, sf_dir):
    return quality.quality_report(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_secrets, op3_toxicity, op4_topk, op5_html, op6_pii, op7_bpe, op8_sharding, op9_mixing, op10_quality)}
#: Learned operators, and those whose hashes or tables DuckDB lacks, are tested against brute force instead.
ORACLE = {"op4_topk": hamming.ORACLE, "op9_mixing": mixing.ORACLE}
