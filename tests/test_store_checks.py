"""Frames that are rejected or change while they are read, bulk runs, checks, cursors that fail, the ticker, hot keys."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strata import errors
from strata import schema as S
from strata.operators import versions
from strata.sources.files import LocalFiles
from strata.store import STAGE, Batch, open_store
from test_store import TINY, live

MUTATIONS = "ordinal long, key binary, kind int, value binary"


@pytest.fixture
def store(spark, tmp_path):
    s = open_store(spark, str(tmp_path / "db"), TINY)
    yield s
    if not s.closed:
        s.handles = 0
        s.close()


@pytest.mark.parametrize(
    "bad, error",
    [
        ((None, b"n", 1, b"0"), errors.InvalidOrdinalError),
        ((1, b"n", 1, b"0"), errors.InvalidOrdinalError),
        ((9, b"", 1, b"0"), errors.InvalidKeyError),
        ((9, None, 1, b"0"), errors.InvalidKeyError),
        ((9, b"n", 3, b"0"), errors.CorruptionError),
        ((9, b"n", None, b"0"), errors.CorruptionError),
    ],
)
def test_frames_are_taken_whole_or_rejected(spark, store, bad, error):
    rows = [(1, b"a", 1, b"1"), (2, b"b", 1, None), (3, b"a", 2, b"gone")]
    with pytest.raises(error):
        store.write_frame(spark.createDataFrame([*rows, bad], MUTATIONS))
    assert store.state.version == 0 and not store.files.list(STAGE)
    store.write_frame(spark.createDataFrame(rows, MUTATIONS))
    assert live(store.view()) == {b"b": b""} and store.state.last_seq == 3
    store.write_frame(spark.createDataFrame([], MUTATIONS))
    assert store.state.last_seq == 3


def test_a_source_that_changes_is_read_once(spark, store):
    rows = spark.range(500).select(F.col("id").alias("ordinal"), F.encode(F.col("id").cast("string"), "utf-8").alias("key"), F.lit(1).alias("kind"), F.encode(F.rand().cast("string"), "utf-8").alias("value"))
    store.write_frame(rows.where("rand() < 0.5"))
    got = live(store.view())
    assert 100 < len(got) < 400 and store.state.last_seq == len(got) == store.state.tail[0].entries and live(store.view()) == got


def test_bulk_frames_are_runs_of_disjoint_files(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "db"), S.Options(memtable_bytes=2000, target_file_bytes=2000, auto_compact=False))
    n = 400
    rows = [(i, b"k%04d" % (i * 7 % n), 1, b"v%d" % i) for i in range(n)]
    store.write_frame(spark.createDataFrame(rows, MUTATIONS))
    (run,) = store.state.levels[0]
    assert not store.state.tail and run.entries == n and run.max_seq == n
    ends = store.read([run]).groupBy(F.col("_metadata.file_path")).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
    ends = sorted((bytes(r["lo"]), bytes(r["hi"])) for r in ends)
    assert len(ends) > 2 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert live(store.view()) == {k: v for _, k, _, v in rows} and store.check().count() == 0
    w = store.amplification().first()
    assert w["write_amp"] > 1 and w["space_amp"] > 0
    store.close()


def test_check_reports_content_order_and_unreadable_files(spark, tmp_path, store):
    for i in range(3):
        store.write(Batch().put(b"a%d" % i, b"1").put(b"b%d" % i, b"2"))
    assert store.check().count() == 0
    first, second, third = (next((tmp_path / "db" / r.path).glob("*.parquet")) for r in store.state.tail)
    whole = first.read_bytes()
    first.write_bytes(b"x" * len(whole))
    turned = str(tmp_path / "turned")
    spark.read.schema(S.LOG).parquet(str(second)).orderBy(F.desc("key")).coalesce(1).write.parquet(turned)
    new = next((tmp_path / "turned").glob("*.parquet")).read_bytes()
    second.write_bytes(new)
    (second.parent / f".{second.name}.crc").unlink()
    tags = {(r["tag"], r["detail"]) for r in store.check().collect()}
    paths = [r.path for r in store.state.tail]
    assert ("content", paths[0]) in tags and ("order", paths[1]) in tags and not any(p == paths[2] for _, p in tags)
    (tmp_path / "db/manifest/v1.json.7.tmp").write_text("torn")
    assert ("temporary", "manifest/v1.json.7.tmp") in {(r["tag"], r["detail"]) for r in store.check().collect()}
    assert "temporary" not in {r["tag"] for r in store.check(strict=False).collect()}


def test_a_cursor_tells_failure_from_the_end(store):
    store.write(Batch().put(b"a", b"1").put(b"b", b"2"))
    c = store.cursor()
    assert c.first() and c.next() and not c.next() and c.error() is None

    def broken():
        raise OSError("injected")
        yield

    c.first()
    c.rows = broken()
    assert not c.next() and not c.valid() and isinstance(c.error(), OSError)
    assert c.first() and c.error() is None
    c.close()


def test_held_batches_are_committed_when_the_interval_has_passed(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "db"), S.Options(sync=S.SYNC_INTERVAL, sync_interval_ms=300, auto_compact=False))
    store.put(b"a", b"1")
    assert store.pending
    end = time.monotonic() + 20
    while store.pending and time.monotonic() < end:
        time.sleep(0.05)
    store.sync()  # waits for the ticker's commit
    assert store.state.last_seq == 1 and store.state.version == 1
    store.close()


def test_multi_get_reads_only_runs_that_can_hold_the_keys(spark, store):
    for p in (b"a", b"m", b"z"):
        store.write(Batch().put(p + b"1", p).put(p + b"2", p))
    keys = spark.createDataFrame([(bytearray(b"m1"),), (bytearray(b"m3"),), (bytearray(b"m1"),)], "key binary")
    got = store.view().multi_get(keys)
    assert sorted((bytes(r["key"]), r["found"]) for r in got.collect()) == [(b"m1", True), (b"m3", False)]
    assert len({f.split("/runs/")[1].split("/")[0] for f in got.inputFiles()}) == 1
    assert store.view().multi_get(keys.where("false")).count() == 0


def hot_log(spark, n=3000):
    """A third of all rows under one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 40))
    return spark.range(1, n + 1).select(key.alias("key"), F.col("id").alias("seq"), F.when(F.col("id") % 7 == 0, 2).otherwise(1).alias("kind"), F.col("id").cast("string").alias("value"))


@pytest.mark.parametrize("oldest", [0, 1500, 3000, S.MAX_SEQ])
def test_gc_with_a_hot_key(spark, oldest):
    log = hot_log(spark)
    rows, want = [tuple(r) for r in log.collect()], set()
    by_key = {}
    for r in sorted(rows, key=lambda r: r[1]):
        by_key.setdefault(r[0], []).append(r)
    for seen in by_key.values():
        want |= {r for r, newer in zip(seen, [*seen[1:], None]) if newer is None or newer[1] > oldest}
    kept = versions.gc_versions(log, oldest)
    assert {tuple(r) for r in kept.collect()} == want
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_history_and_live_keys_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(versions, "SEQ_BUCKET", 64)
    log = hot_log(spark).where("seq % 11 != 0")
    rows = sorted((tuple(r) for r in log.collect()), key=lambda r: r[1])
    seen, alive, live_after, want = {}, set(), {}, {}
    for r in rows:
        seen.setdefault(r[0], []).append(r[1])
        (alive.add if r[2] == S.SET else alive.discard)(r[0])
        live_after[r[1]] = len(alive)
    for key, seqs in seen.items():
        want |= {s: (key, after, i + 1) for i, (s, after) in enumerate(zip(seqs, [*seqs[1:], None]))}
    monkeypatch.setattr(versions, "seq_bucket", lambda width=64: F.floor(F.col("seq") / 64))
    got = {r["seq"]: (r["key"], r["next_seq"], r["version"]) for r in versions.version_history(log).collect()}
    assert got == want
    assert {r["seq"]: r["live_keys"] for r in versions.live_keys_over_time(log, 64).collect()} == live_after


class Crashing(LocalFiles):
    """The n-th operation that changes something crashes: before it, after it, or in the middle of what it writes."""

    def __init__(self, root):
        super().__init__(root)
        self.left, self.mode = None, "before"

    def _crash(self, run, name, text=None):
        if self.left is None:
            return run()
        self.left -= 1
        if self.left:
            if self.left < 0:
                raise OSError("crashed")
            return run()
        if self.mode == "after":
            run()
        if self.mode == "torn" and text is not None:
            super().create(f"{name}.1.tmp", text[: len(text) // 2])
        raise OSError("crashed")

    def create(self, name, text):
        return self._crash(lambda: super(Crashing, self).create(name, text), name, text)

    def delete(self, name):
        return self._crash(lambda: super(Crashing, self).delete(name), name)


@pytest.mark.parametrize("mode", ["before", "after", "torn"])
def test_a_crash_at_any_file_operation(spark, tmp_path, mode):
    """Every operation that changes a file crashes once: what was acknowledged is there, and the store opens by itself."""
    for n in range(1, 40):
        files = Crashing(str(tmp_path / f"db{n}"))
        store = open_store(spark, files.root, TINY, files)
        files.left, files.mode = n, mode
        acknowledged, crashed, sent = {}, False, {}
        try:
            for step in (b"x", b"y"):
                sent = acknowledged | {b"a": step, step: b"1"}
                store.write(Batch().put(b"a", step).put(step, b"1"))
                acknowledged = sent
                store.flush()
            store.compact_level(0)
            store.vacuum()
        except Exception:
            crashed = True
        files.left = None
        files.delete("LOCK")
        again = open_store(spark, files.root, TINY, LocalFiles(files.root))
        assert live(again.view()) in (acknowledged, sent) and again.check(strict=False).count() == 0
        again.close()
        if not crashed:
            break
    assert n > 4 and not crashed
