"""The query catalogue: each entry is a Spark query and, where SQL can express it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata import schema as S
from strata.functions import keys as K
from strata.operators import bloom, reads, storage, versions
from strata.sources.scratch import checkpoints
from strata.sources.tables import events_log, orders_log
from strata.store import Store, open_store
from strata.streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

E_LOG = """e AS (SELECT lpad(CAST(user_id AS VARCHAR), 16, '0') AS key, event_id + 1 AS seq,
  CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS kind,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events)"""
O_LOG = """o AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 16, '0') AS key, o_orderkey + 1 AS seq,
  CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS kind,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS value FROM orders)"""
LATEST = """SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn
  FROM {log} WHERE {where}) WHERE rn = 1 AND kind = 1"""
RUN_MANIFEST = """runs AS (SELECT CAST((seq - 1) // 500 AS BIGINT) AS file_num, count(*) AS entries, min(key) AS lo, max(key) AS hi,
  min(seq) AS min_seq, max(seq) AS max_seq FROM e GROUP BY 1),
m AS (SELECT file_num, CASE WHEN file_num % 4 = 3 THEN 0 ELSE file_num % 4 END AS level, entries, entries * 80 AS size, lo, hi, min_seq, max_seq FROM runs)"""


def key(n: int) -> str:
    return f"{n:016d}"


def view(where: str = "true", log: str = "e") -> str:
    return f"WITH {E_LOG if log == 'e' else O_LOG} " + LATEST.format(log=log, where=where)


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def run_log(spark: SparkSession, d: str) -> DataFrame:
    """The events log dealt into runs of 500 entries of 80 bytes."""
    return events_log(spark, d).withColumn("run_id", storage.run_of(F.col("seq"), 80, 40_000))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """The runs as a manifest over levels 0 to 2."""
    m = storage.run_stats(run_log(spark, d)).withColumnRenamed("run_id", "file_num")
    level = F.when(F.col("file_num") % 4 == 3, F.lit(0)).otherwise(F.col("file_num") % 4)
    return m.withColumns({"level": level.cast("long"), "size": F.col("entries") * 80})


# Point-in-time views.
add("kv_latest", lambda s, d: reads.visible_at(events_log(s, d)), view())
add("kv_latest_orders", lambda s, d: reads.visible_at(orders_log(s, d)), view(log="o"))
for _s in (2500, 5000, 7500):
    add(f"kv_snapshot_scan_{_s}" if _s != 5000 else "kv_snapshot_scan", lambda s, d, q=_s: reads.visible_at(events_log(s, d), q), view(f"seq <= {_s}"))


def _get_sql(k: str, where: str = "true") -> str:
    return f"""WITH {E_LOG}, n AS (SELECT * FROM e WHERE key = '{k}' AND {where} ORDER BY seq DESC LIMIT 1)
SELECT '{k}' AS key, coalesce((SELECT kind = 1 FROM n), false) AS found, (SELECT value FROM n WHERE kind = 1) AS value"""


add("kv_get_hit", lambda s, d: reads.get(events_log(s, d), key(7)), _get_sql(key(7)))
add("kv_get_absent", lambda s, d: reads.get(events_log(s, d), "absent"), _get_sql("absent"))
add("kv_get_as_of", lambda s, d: reads.get(events_log(s, d), key(7), 2500), _get_sql(key(7), "seq <= 2500"))


def kv_get_deleted(spark: SparkSession, d: str) -> DataFrame:
    """The smallest key whose newest version is a tombstone, looked up: it is not found."""
    log = events_log(spark, d)
    dead = versions.tombstones(log).select("key").orderBy("key").limit(1)
    return reads.multi_get(log, dead)


add("kv_get_deleted", kv_get_deleted, f"""WITH {E_LOG}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM e)
SELECT min(key) AS key, false AS found, CAST(NULL AS DOUBLE) AS value FROM l WHERE rn = 1 AND kind = 2""")


def kv_multi_get(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.range(0, 400, 7).select(K.padded_key(F.col("id")).alias("key"))
    return reads.multi_get(events_log(spark, d), wanted)


add("kv_multi_get", kv_multi_get, f"""WITH {E_LOG}, v AS ({LATEST.format(log='e', where='true')}),
w AS (SELECT lpad(CAST(i AS VARCHAR), 16, '0') AS key FROM range(0, 400, 7) t(i))
SELECT w.key, v.key IS NOT NULL AS found, v.value FROM w LEFT JOIN v ON w.key = v.key""")

# Ordered scans and seeks.
LO, HI = key(10), key(50)
add("kv_range_scan", lambda s, d: reads.range_scan(events_log(s, d), LO, HI), view(f"key >= '{LO}' AND key < '{HI}'"))
add("kv_range_lower_only", lambda s, d: reads.range_scan(events_log(s, d), key(100)), view(f"key >= '{key(100)}'"))
add("kv_range_upper_only", lambda s, d: reads.range_scan(events_log(s, d), None, key(20)), view(f"key < '{key(20)}'"))
add("kv_range_between_keys", lambda s, d: reads.range_scan(events_log(s, d), LO + "a", key(30) + "a"), view(f"key >= '{LO}a' AND key < '{key(30)}a'"))
add("kv_range_as_of", lambda s, d: reads.range_scan(events_log(s, d), LO, HI, 5000), view(f"key >= '{LO}' AND key < '{HI}' AND seq <= 5000"))
add(
    "kv_range_empty_bounds",
    lambda s,
    d: reads.range_scan(events_log(s, d), LO, LO).agg(F.count("*").alias("n")),
    f"WITH {E_LOG} SELECT count(*) AS n FROM ({LATEST.format(log='e', where=f"key >= '{LO}' AND key < '{LO}'")})",
)
add("kv_range_empty_upper", lambda s, d: reads.range_scan(events_log(s, d), None, "").agg(F.count("*").alias("n")), "SELECT CAST(0 AS BIGINT) AS n")
add("kv_first", lambda s, d: reads.seek_ge(events_log(s, d)), view() + " ORDER BY key LIMIT 1")
add("kv_seek_ge", lambda s, d: reads.seek_ge(events_log(s, d), key(40) + "x"), view(f"key >= '{key(40)}x'") + " ORDER BY key LIMIT 1")
add(
    "kv_seek_clamped",
    lambda s,
    d: reads.seek_ge(events_log(s, d), key(1), key(60), key(90)),
    view(f"key >= '{key(60)}' AND key < '{key(90)}'") + " ORDER BY key LIMIT 1",
)
add("kv_next", lambda s, d: reads.next_after(events_log(s, d), key(10)), view(f"key > '{key(10)}'") + " ORDER BY key LIMIT 1")
add("kv_first_n", lambda s, d: reads.first_n(events_log(s, d), 10), view() + " ORDER BY key LIMIT 10")
add("kv_key_only_scan", lambda s, d: reads.visible_at(events_log(s, d)).select("key"), f"SELECT key FROM ({view()})")
add("kv_scan_count", lambda s, d: reads.visible_at(events_log(s, d)).agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM ({view()})")


def kv_ordered_position(spark: SparkSession, d: str) -> DataFrame:
    """The rank of each live key: prefix sums over buckets of keys that share their last three digits' thousand."""
    live = reads.visible_at(events_log(spark, d)).withColumn("bucket", F.substring("key", 1, 13))
    return versions.prefix_sums(live, [], "bucket", [F.col("key")], {"before": F.lit(1)}).select("key", (F.col("before") + 1).cast("long").alias("position"))


add("kv_ordered_position", kv_ordered_position, f"SELECT key, row_number() OVER (ORDER BY key) AS position FROM ({view()})")
add(
    "kv_next_key",
    lambda s,
    d: reads.neighbours(reads.visible_at(events_log(s, d)), F.substring("key", 1, 14)).select("key", "next_key"),
    f"SELECT key, lead(key) OVER (ORDER BY key) AS next_key FROM ({view()})",
)
add("kv_reverse_first_n", lambda s, d: reads.visible_at(events_log(s, d)).orderBy(F.desc("key")).limit(5), view() + " ORDER BY key DESC LIMIT 5")

# Version analytics.
add("kv_snapshot_diff", lambda s, d: versions.snapshot_diff(events_log(s, d), 2500, 7500), f"""WITH {E_LOG}, a AS ({LATEST.format(log='e', where='seq <= 2500')}), b AS ({LATEST.format(log='e', where='seq <= 7500')})
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change, a.value AS old_value, b.value AS new_value
FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.value IS DISTINCT FROM b.value""")
add(
    "kv_version_history",
    lambda s,
    d: versions.version_history(events_log(s, d)),
    f"WITH {E_LOG} SELECT *, lead(seq) OVER w AS next_seq, row_number() OVER w AS version FROM e WINDOW w AS (PARTITION BY key ORDER BY seq)",
)
GC = "SELECT key, seq, kind, value FROM (SELECT *, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS newer FROM e) WHERE newer IS NULL OR newer > {oldest}"
add("kv_gc_no_snapshots", lambda s, d: versions.gc_versions(events_log(s, d)), f"WITH {E_LOG} {GC.format(oldest=S.MAX_SEQ)}")
add("kv_gc_with_snapshot", lambda s, d: versions.gc_versions(events_log(s, d), 5000), f"WITH {E_LOG} {GC.format(oldest=5000)}")
add(
    "kv_gc_bottommost",
    lambda s,
    d: versions.drop_tombstones(versions.gc_versions(events_log(s, d), 5000), 5000),
    f"WITH {E_LOG}, g AS ({GC.format(oldest=5000)}) SELECT * FROM g WHERE NOT (kind = 2 AND seq <= 5000)",
)
DEEPER = [(key(20), key(40)), (key(35), key(60)), (key(100), key(110))]
DEEPER_SQL = "r AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in DEEPER) + ") t(lo, hi))"
SHADOW_SQL = f"WITH {E_LOG}, g AS ({GC.format(oldest=7500)}), {DEEPER_SQL} SELECT * FROM g WHERE NOT (kind = 2 AND seq <= 7500 AND NOT EXISTS (SELECT 1 FROM r WHERE g.key BETWEEN r.lo AND r.hi))"
add("kv_tombstone_shadow", lambda s, d: versions.drop_tombstones(versions.gc_versions(events_log(s, d), 7500), 7500, DEEPER), SHADOW_SQL)
add(
    "kv_tombstone_shadow_join",
    lambda s,
    d: versions.drop_covered_tombstones(versions.gc_versions(events_log(s, d), 7500), 7500, s.createDataFrame(DEEPER, "lo string, hi string")),
    SHADOW_SQL,
)


def kv_gc_preserves_answers(spark: SparkSession, d: str) -> DataFrame:
    log = events_log(spark, d)
    kept = versions.drop_tombstones(versions.gc_versions(log, 5000), 5000)
    counts = [versions.answers_changed(log, kept, q).agg(F.count("*").alias("changed")).select(F.lit(q or 0).cast("long").alias("at"), "changed") for q in (5000, 7500, None)]
    return counts[0].union(counts[1]).union(counts[2])


add("kv_gc_preserves_answers", kv_gc_preserves_answers, "SELECT CAST(x AS BIGINT) AS at, CAST(0 AS BIGINT) AS changed FROM (VALUES (5000), (7500), (0)) t(x)")


def kv_oldest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    pins = spark.createDataFrame([(7500,), (2500,), (5000,)], "seq long")
    return reads.oldest_snapshot(pins).select(F.lit("pinned").alias("pins"), "oldest").union(reads.oldest_snapshot(pins.where("false")).select(F.lit("none").alias("pins"), "oldest"))


add("kv_oldest_snapshot", kv_oldest_snapshot, f"SELECT 'pinned' AS pins, CAST(2500 AS BIGINT) AS oldest UNION ALL SELECT 'none', CAST({S.MAX_SEQ} AS BIGINT)")
add("kv_live_keys_over_time", lambda s, d: versions.live_keys_over_time(events_log(s, d)), f"""WITH {E_LOG}, d AS (SELECT seq, (kind = 1)::BIGINT - coalesce(lag((kind = 1)::BIGINT) OVER (PARTITION BY key ORDER BY seq), 0) AS delta FROM e)
SELECT seq, CAST(sum(delta) OVER (ORDER BY seq) AS BIGINT) AS live_keys FROM d""")


def kv_prefix_state_size(spark: SparkSession, d: str) -> DataFrame:
    """Live keys at each atomic batch boundary."""
    t = versions.live_keys_over_time(events_log(spark, d)).withColumn("batch_id", F.floor((F.col("seq") - 1) / 50))
    return t.groupBy("batch_id").agg(F.max_by("live_keys", "seq").alias("live_keys"))


add(
    "kv_prefix_state_size",
    kv_prefix_state_size,
    f"SELECT batch_id, arg_max(live_keys, seq) AS live_keys FROM (SELECT *, CAST((seq - 1) // 50 AS BIGINT) AS batch_id "
    f"FROM ({ORACLE['kv_live_keys_over_time']})) GROUP BY batch_id",
)

# Batches.
add(
    "kv_seq_assignment",
    lambda s,
    d: versions.assign_seq(orders_log(s, d).select("key", (F.col("seq") * 3).alias("ordinal")), 1000).select("key", "seq"),
    f"WITH {O_LOG} SELECT key, 999 + row_number() OVER (ORDER BY seq) AS seq FROM o",
)


def batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 50 with the mutation numbered 4567 torn off."""
    return versions.batch_frontier(events_log(spark, d).where("seq != 4567"), F.floor((F.col("seq") - 1) / 50), F.lit(50))


TORN = """b AS (SELECT CAST((seq - 1) // 50 AS BIGINT) AS batch_id, max(seq) AS last_seq, count(*) AS entries, 50 AS expected, count(*) = 50 AS complete FROM e WHERE seq <> 4567 GROUP BY 1)"""
add("kv_batch_frontier", batches, f"WITH {E_LOG}, {TORN} SELECT * FROM b")
add(
    "kv_atomic_visibility",
    lambda s,
    d: reads.visible_at(versions.atomic_prefix(events_log(s, d).where("seq != 4567"), batches(s, d))),
    f"WITH {E_LOG}, {TORN}, f AS (SELECT max(last_seq) AS s FROM b WHERE batch_id < coalesce((SELECT min(batch_id) FROM b WHERE NOT complete), 9e18)) " + LATEST.format(log="e", where="seq <= (SELECT s FROM f)"),
)


def kv_batch_bytes(spark: SparkSession, d: str) -> DataFrame:
    log = events_log(spark, d).withColumn("value", F.col("value").cast("int").cast("string"))
    size = K.entry_bytes(F.col("kind"), F.col("key"), F.col("value"))
    return log.groupBy(F.floor((F.col("seq") - 1) / 50).alias("batch_id")).agg((F.sum(size) + S.BATCH_HEADER_BYTES).alias("bytes"), F.count("*").alias("entries"))


add("kv_batch_bytes", kv_batch_bytes, f"""WITH {E_LOG} SELECT CAST((seq - 1) // 50 AS BIGINT) AS batch_id,
CAST(12 + sum(1 + 1 + 16 + CASE WHEN kind = 1 THEN 1 + length(CAST(CAST(trunc(value) AS INTEGER) AS VARCHAR)) ELSE 0 END) AS BIGINT) AS bytes, count(*) AS entries FROM e GROUP BY 1""")


def kv_validation(spark: SparkSession, d: str) -> DataFrame:
    """Documents as entries: lang as key, doubled in length by its source; some keys are empty or too long."""
    size = F.col("doc_id") % 5
    k = F.when(size == 0, F.lit("")).when(size == 1, F.repeat(F.lit("k"), S.MAX_KEY_BYTES)).when(size == 2, F.repeat(F.lit("k"), S.MAX_KEY_BYTES + 1)).when(size == 3, F.col("lang"))
    docs = spark.read.parquet(f"{d}/documents.parquet").select(K.valid_key(k).alias("valid_key"), K.valid_value(F.lit(S.SET), F.col("text")).alias("valid_value"))
    return docs.groupBy("valid_key", "valid_value").agg(F.count("*").alias("n"))


add("kv_validation", kv_validation, """SELECT doc_id % 5 = 1 OR (doc_id % 5 = 3 AND coalesce(length(lang), 0) > 0) AS valid_key,
coalesce(octet_length(encode(text)), 0) <= 4194304 AS valid_value, count(*) AS n FROM documents GROUP BY 1, 2""")

# Replay and merging.
add("kv_replay_prefix", lambda s, d: versions.valid_prefix(events_log(s, d), "seq", F.col("seq") % 7777 != 0), f"WITH {E_LOG} SELECT * FROM e WHERE seq < 7777")
add("kv_replay_idempotent", lambda s, d: reads.visible_at(versions.dedupe_replay(events_log(s, d).unionByName(events_log(s, d)))), view())


def kv_merge_runs(spark: SparkSession, d: str) -> DataFrame:
    log = events_log(spark, d)
    return versions.merge_runs(log.where("seq % 3 = 0"), log.where("seq % 3 <> 0"), log.where("seq % 6 = 0"))


add("kv_merge_runs", kv_merge_runs, f"WITH {E_LOG} SELECT * FROM e")

# Storage planning.
add("kv_run_assignment", lambda s, d: run_log(s, d).select("seq", "run_id"), f"WITH {E_LOG} SELECT seq, CAST((seq - 1) // 500 AS BIGINT) AS run_id FROM e")
add(
    "kv_run_stats",
    lambda s,
    d: storage.run_stats(run_log(s, d)),
    f"WITH {E_LOG}, {RUN_MANIFEST} SELECT file_num AS run_id, entries, lo, hi, min_seq, max_seq FROM runs",
)


def clustered(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of disjoint files: keys of the orders log dealt by hundreds."""
    rows = orders_log(spark, d).withColumn("file_num", F.floor(F.col("key").cast("long") / 100))
    return storage.run_stats(rows, "file_num")


CLUSTERED = "c AS (SELECT CAST(CAST(key AS BIGINT) // 100 AS BIGINT) AS file_num, count(*) AS entries, min(key) AS lo, max(key) AS hi, min(seq) AS min_seq, max(seq) AS max_seq FROM o GROUP BY 1)"
add(
    "kv_file_pruning",
    lambda s,
    d: storage.prune_files(clustered(s, d), key(250), key(470)).select("file_num", "lo", "hi"),
    f"WITH {O_LOG}, {CLUSTERED} SELECT file_num, lo, hi FROM c WHERE hi >= '{key(250)}' AND lo < '{key(470)}'",
)
add(
    "kv_file_point_pruning",
    lambda s,
    d: storage.covering_files(clustered(s, d), key(333)).select("file_num", "entries"),
    f"WITH {O_LOG}, {CLUSTERED} SELECT file_num, entries FROM c WHERE '{key(333)}' BETWEEN lo AND hi",
)
SCORES = """s AS (SELECT level, count(*) AS tables, CAST(sum(size) AS BIGINT) AS bytes,
CASE WHEN level = 0 THEN count(*) / 4 ELSE CAST(sum(size) AS DOUBLE) / (20000.0::DOUBLE * pow(10.0::DOUBLE, level - 1)) END AS score FROM m WHERE level < 6 GROUP BY level)"""
add("kv_level_scores", lambda s, d: storage.level_scores(manifest(s, d), 4, 20_000), f"WITH {E_LOG}, {RUN_MANIFEST}, {SCORES} SELECT * FROM s")
add(
    "kv_pick_compaction",
    lambda s,
    d: storage.pick_level(storage.level_scores(manifest(s, d), 4, 20_000)).select("level", "score"),
    f"WITH {E_LOG}, {RUN_MANIFEST}, {SCORES} SELECT level, score FROM s WHERE score >= 1 ORDER BY score DESC, level DESC LIMIT 1",
)
add(
    "kv_compaction_inputs",
    lambda s,
    d: storage.compaction_inputs(manifest(s, d), 1),
    f"WITH {E_LOG}, {RUN_MANIFEST} SELECT a.file_num AS src, b.file_num AS dst FROM m a LEFT JOIN m b ON b.level = 2 AND a.lo <= b.hi "
    f"AND a.hi >= b.lo WHERE a.level = 1",
)
add(
    "kv_level_overlap",
    lambda s,
    d: storage.overlapping(clustered(s, d), key(140), key(260)).select("file_num"),
    f"WITH {O_LOG}, {CLUSTERED} SELECT file_num FROM c WHERE lo <= '{key(260)}' AND hi >= '{key(140)}'",
)
add(
    "kv_level_metrics",
    lambda s,
    d: storage.level_metrics(manifest(s, d)),
    f"WITH {E_LOG}, {RUN_MANIFEST} SELECT level, count(*) AS tables, CAST(sum(size) AS BIGINT) AS bytes FROM m GROUP BY level",
)


def kv_write_amplification(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of the events log as users write it, logged, flushed and rewritten once by garbage collection."""
    log = events_log(spark, d)
    sums = log.agg(F.sum(F.lit(24)).alias("user"), F.sum(F.lit(36)).alias("wal"), F.sum(F.lit(80)).alias("flushed"))
    kept = versions.drop_tombstones(versions.gc_versions(log)).agg(F.coalesce(F.sum(F.lit(80)), F.lit(0)).alias("compacted"))
    return sums.join(F.broadcast(kept)).select(*[a.alias(n) for n, a in storage.amplification(F.col("user"), F.col("wal"), F.col("flushed"), F.col("compacted"), F.col("compacted")).items()])


add("kv_write_amplification", kv_write_amplification, f"""WITH {E_LOG}, k AS (SELECT count(*) AS n FROM ({LATEST.format(log='e', where='true')})), t AS (SELECT count(*) AS n FROM e)
SELECT (t.n * 116 + k.n * 80)::DOUBLE / (t.n * 24)::DOUBLE AS write_amp, (k.n * 80)::DOUBLE / (t.n * 24)::DOUBLE AS space_amp FROM k, t""")

# Integrity: violations of a sound layout and of one broken on purpose.


def _counts(spark: SparkSession, sound: DataFrame, broken: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("layout"), "violations")
    return n(sound, "sound").union(n(broken, "broken"))


def kv_inv_disjoint(spark: SparkSession, d: str) -> DataFrame:
    c = clustered(spark, d).withColumn("level", F.lit(1))
    return _counts(spark, storage.disjoint_violations(c), storage.disjoint_violations(c.withColumn("hi", F.when(F.col("file_num") == 2, F.concat("hi", F.lit("9999"))).otherwise(F.concat("hi", F.lit("")))).withColumn("lo", F.when(F.col("file_num") == 3, F.lit(key(250))).otherwise(F.col("lo")))))


add("kv_inv_disjoint", kv_inv_disjoint, "SELECT 'sound' AS layout, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'broken', 1")


def kv_inv_ascending(spark: SparkSession, d: str) -> DataFrame:
    rows = orders_log(spark, d).withColumn("file_num", F.floor(F.col("key").cast("long") / 100))
    rank = F.row_number().over(Window.partitionBy("file_num").orderBy("key", F.desc("seq")))
    good = rows.withColumn("position", rank)
    return _counts(spark, storage.order_violations(good), storage.order_violations(good.withColumn("position", -F.col("position"))))


add(
    "kv_inv_ascending",
    kv_inv_ascending,
    f"WITH {O_LOG} SELECT 'sound' AS layout, CAST(0 AS BIGINT) AS violations UNION ALL "
    f"SELECT 'broken', CAST(count(*) - count(DISTINCT CAST(key AS BIGINT) // 100) AS BIGINT) FROM o",
)


def kv_inv_lastseq(spark: SparkSession, d: str) -> DataFrame:
    log = events_log(spark, d)
    return _counts(spark, storage.seq_violations(log, F.lit(10_000_000)), storage.seq_violations(log, F.lit(900)))


add(
    "kv_inv_lastseq",
    kv_inv_lastseq,
    f"WITH {E_LOG} SELECT 'sound' AS layout, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'broken', count(*) FROM e WHERE seq > 900",
)


def kv_inv_orphans(spark: SparkSession, d: str) -> DataFrame:
    m = manifest(spark, d)
    return _counts(spark, storage.orphans(m, m), storage.orphans(m, m.where("level > 0")))


add(
    "kv_inv_orphans",
    kv_inv_orphans,
    f"WITH {E_LOG}, {RUN_MANIFEST} SELECT 'sound' AS layout, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'broken', count(*) FROM m "
    f"WHERE level = 0",
)


def kv_inv_missing(spark: SparkSession, d: str) -> DataFrame:
    m = manifest(spark, d)
    listing = m.where("level > 0").withColumn("size", F.when(F.col("level") == 1, F.col("size") + 1).otherwise(F.col("size")))
    return _counts(spark, storage.missing(m, m), storage.missing(listing, m))


add(
    "kv_inv_missing",
    kv_inv_missing,
    f"WITH {E_LOG}, {RUN_MANIFEST} SELECT 'sound' AS layout, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'broken', count(*) FROM m "
    f"WHERE level < 2",
)


def kv_bloom_no_false_negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = run_log(spark, d).withColumnRenamed("run_id", "file_num")
    hits = bloom.probe(bloom.build(rows, "file_num"), rows, "file_num")
    return hits.where(~F.col("maybe")).agg(F.count("*").alias("false_negatives"))


add("kv_bloom_no_false_negatives", kv_bloom_no_false_negatives, "SELECT CAST(0 AS BIGINT) AS false_negatives")

# Binary keys: one or two bytes, of which one key may be the beginning of another.
def bytes_log(spark: SparkSession, d: str) -> DataFrame:
    n = F.pmod(F.col("key").cast("long") * 37, F.lit(65536))
    wide, short = F.lpad(F.hex(n), 4, "0"), F.lpad(F.hex(n % 256), 2, "0")
    return events_log(spark, d).withColumn("key", F.unhex(F.when(n % 3 == 0, short).otherwise(wide)))


BYTES_LOG = f"""{E_LOG}, n AS (SELECT *, CAST(key AS BIGINT) * 37 % 65536 AS n FROM e),
x AS (SELECT CASE WHEN n % 3 = 0 THEN printf('%02X', n % 256) ELSE printf('%04X', n) END AS key, seq, kind, value FROM n)"""
BYTES_VIEW = LATEST.format(log="x", where="{where}")


def of_bytes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.hex("key"))


add("kv_bytes_latest", lambda s, d: of_bytes(reads.visible_at(bytes_log(s, d))), f"WITH {BYTES_LOG} " + BYTES_VIEW.format(where="true"))
add(
    "kv_bytes_range",
    lambda s,
    d: of_bytes(reads.range_scan(bytes_log(s, d), b"\x00\x80", b"\x0f\x00")),
    f"WITH {BYTES_LOG} " + BYTES_VIEW.format(where="key >= '0080' AND key < '0F00'"),
)
add(
    "kv_bytes_seek",
    lambda s,
    d: of_bytes(reads.seek_ge(bytes_log(s, d), b"\x00\x00")),
    f"WITH {BYTES_LOG} " + BYTES_VIEW.format(where="key >= '0000'") + " ORDER BY key LIMIT 1",
)
add(
    "kv_bytes_next",
    lambda s,
    d: of_bytes(reads.next_after(bytes_log(s, d), b"\x0a")),
    f"WITH {BYTES_LOG} " + BYTES_VIEW.format(where="key > '0A'") + " ORDER BY key LIMIT 1",
)

# The persistent store: the events log written, maintained and read again.
SMALL = S.Options(memtable_bytes=1 << 16, base_level_bytes=1 << 17, target_file_bytes=1 << 16, l0_trigger=2, auto_compact=False)


def mutations(spark: SparkSession, d: str) -> DataFrame:
    """The events log as frames that a store takes: values as text in bytes."""
    text = lambda c: F.encode(F.col(c).cast("string"), "utf-8").alias(c)
    return events_log(spark, d).select(F.col("seq").alias("ordinal"), text("key"), "kind", text("value"))


def new_store(spark: SparkSession) -> Store:
    return open_store(spark, f"{checkpoints(spark)}/stores/{uuid4().hex}", SMALL)


def filled(spark: SparkSession, d: str, *after: int) -> Store:
    """A new store with the log in frames cut after the given sequence numbers, flushed behind each."""
    store, rows = new_store(spark), mutations(spark, d)
    for lo, hi in zip((0, *after), (*after, S.MAX_SEQ)):
        store.write_frame(rows.where((F.col("ordinal") > lo) & (F.col("ordinal") <= hi)))
        store.flush()
    return store


def shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.decode("key", "utf-8").alias("key"), F.decode("value", "utf-8").cast("double").alias("value"))


def kv_store_ingest_scan(spark: SparkSession, d: str) -> DataFrame:
    store = filled(spark, d)
    out = shown(store.scan())
    store.close()
    return out


def kv_store_compact_scan(spark: SparkSession, d: str) -> DataFrame:
    """Four flushed frames, compacted down the levels and vacuumed, closed and opened again."""
    store = filled(spark, d, 2500, 5000, 7500)
    store.compact()
    store.vacuum()
    store.close()
    again = open_store(spark, store.files.root, SMALL)
    out = shown(again.scan())
    again.close()
    return out


def kv_store_snapshot_scan(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot taken in the middle and read after all else was written and compacted."""
    store, rows = new_store(spark), mutations(spark, d)
    store.write_frame(rows.where("ordinal <= 5000"))
    snap = store.snapshot()
    store.write_frame(rows.where("ordinal > 5000"))
    store.compact()
    store.compact_level(0) if store.state.levels[0] else None
    out = shown(snap.scan())
    snap.close()
    store.close()
    return out


def kv_store_range_scan(spark: SparkSession, d: str) -> DataFrame:
    store = filled(spark, d, 5000)
    store.compact()
    out = shown(store.scan(LO.encode(), HI.encode()))
    store.close()
    return out


def kv_store_multi_get(spark: SparkSession, d: str) -> DataFrame:
    store = filled(spark, d, 5000)
    wanted = spark.range(0, 400, 7).select(F.encode(K.padded_key(F.col("id")), "utf-8").alias("key"))
    out = store.view().multi_get(wanted)
    store.close()
    return out.select(F.decode("key", "utf-8").alias("key"), "found", F.decode("value", "utf-8").cast("double").alias("value"))


def kv_store_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Entries and sequence numbers of the runs of three frames, before anything is compacted."""
    store = filled(spark, d, 3000, 6000)
    out = store.manifest().select("entries", "min_seq", "max_seq", F.decode(F.unhex("lo"), "utf-8").alias("lo"), F.decode(F.unhex("hi"), "utf-8").alias("hi"))
    store.close()
    return out


def kv_store_stream(spark: SparkSession, d: str) -> DataFrame:
    """The log by Structured Streaming, one commit a micro-batch."""
    store, folder = new_store(spark), f"{checkpoints(spark)}/streams/{uuid4().hex}"
    mutations(spark, d).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("ordinal long, key binary, kind int, value binary").parquet(f"{folder}/in")
    ingest(store, stream, "events", f"{folder}/progress").awaitTermination()
    out = shown(store.scan())
    store.close()
    return out


_STORED = f"SELECT key, value FROM ({view()})"
add("kv_store_ingest_scan", kv_store_ingest_scan, _STORED)
add("kv_store_compact_scan", kv_store_compact_scan, _STORED)
add("kv_store_stream", kv_store_stream, _STORED)
add("kv_store_snapshot_scan", kv_store_snapshot_scan, f"SELECT key, value FROM ({view('seq <= 5000')})")
add("kv_store_range_scan", kv_store_range_scan, f"""SELECT key, value FROM ({view(f"key >= '{LO}' AND key < '{HI}'")})""")
add("kv_store_multi_get", kv_store_multi_get, ORACLE["kv_multi_get"])
add(
    "kv_store_manifest",
    kv_store_manifest,
    f"WITH {E_LOG} SELECT count(*) AS entries, min(seq) AS min_seq, max(seq) AS max_seq, min(key) AS lo, max(key) AS hi FROM e "
    f"GROUP BY least((seq - 1) // 3000, 2)",
)
