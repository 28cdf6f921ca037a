"""The pipeline's stages one by one on their own inputs, and the registered queries."""

import corpus_pipeline
from strata.llm import mixing, neardup, quality, secrets, tokens
from strata.llm.common import checkpoints
from strata.llm.queries import ORACLE, QUERIES
from strata.sources.files import HadoopFiles


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    report = {r["doc_id"]: r["kept"] for r in quality.quality_report(docs, labels).collect()}
    good = corpus_pipeline.rules(spark, docs, sf_dir).cache()
    assert {r["doc_id"] for r in good.collect()} == {d for d, k in report.items() if k}
    first = corpus_pipeline.dedup(spark, good, sf_dir).cache()
    assert {r["doc_id"] for r in first.collect()} == {r["component_id"] for r in neardup.near_duplicates(good).collect()}
    clean = corpus_pipeline.redact(spark, first, sf_dir).cache()
    assert clean.columns == docs.columns and clean.count() == first.count()
    assert secrets.secret_spans(clean).where("spans != ''").count() == 0
    mixed = corpus_pipeline.mix(spark, clean, sf_dir).cache()
    taken = mixing.mix_counts(clean).agg({"taken": "sum"}).first()[0]
    assert mixed.columns == docs.columns and mixed.select(mixing.word_count(mixed["text"]).alias("n")).agg({"n": "sum"}).first()[0] == taken
    last = corpus_pipeline.encode(spark, mixed, sf_dir)
    assert last.count() == mixed.count()
    whole = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "n_tokens", "ids_sha256"]
    assert sorted(map(tuple, whole.select(*key).collect())) == sorted(map(tuple, tokens.digests(mixed).select(*key).collect()))


def test_stages_on_hard_rows(spark, hard, none, sf_dir):
    """Nulls, empty and long texts, repeated rows, an empty table and clashing names go through all stages."""
    docs = hard
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        rows = docs.count()
        assert name == "bpe" or docs.columns == hard.columns
        assert rows <= before.count() or name == "mixing"
    assert rows > 0
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_run_leaves_only_what_the_result_reads(spark, sf_dir):
    files = HadoopFiles(spark, checkpoints(spark))
    stages = lambda: {tuple(n.split("/")[:2]) for n in files.list("") if n.startswith("pipeline-")}
    before = stages()
    corpus_pipeline.run(spark, sf_dir)
    assert [n for _, n in stages() - before] == ["mixing"]


def test_every_operator_is_registered():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(f"op{i}" for i in range(1, 11)) and set(ORACLE) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "mixing", "bpe"]
