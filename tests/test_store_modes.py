"""Reads of compacted runs without a shuffle, grouped commits, maintenance that fails, leases of dead processes."""

import json
import random
import socket
import subprocess
import sys

import pytest

from strata import errors
from strata import schema as S
from strata.plans.reading import split_plain
from strata.sources.files import LocalFiles
from strata.sources.manifest import Run
from strata.store import Batch, open_store
from test_store import TINY, Failing, live


def run(num, lo, hi, plain):
    return Run(num, f"runs/{num}", 1, 1, lo.encode().hex(), hi.encode().hex(), 1, 1, plain)


def test_split_plain():
    a, b, c, d = run(1, "a", "c", True), run(2, "c", "e", True), run(3, "f", "g", True), run(4, "h", "i", False)
    plain, mixed = split_plain([d, c, b, a])
    assert plain == [c] and mixed == [a, b, d]
    wide, inner = run(5, "a", "z", True), run(6, "b", "c", True)
    assert split_plain([inner, wide, run(7, "y", "zz", True)])[0] == []
    assert split_plain([]) == ([], [])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_compacted_keys_are_read_without_a_shuffle(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "db"), TINY)
    r, want = random.Random(1), {}
    for _ in range(3):
        b = Batch()
        for _ in range(60):
            k = b"k%03d" % r.randrange(80)
            if r.random() < 0.8:
                want[k] = b"v%d" % r.randrange(1000)
                b.put(k, want[k])
            else:
                want.pop(k, None)
                b.delete(k)
        store.write(b)
    assert "Exchange" in plan(store.scan())
    store.flush()
    store.compact_level(0)
    assert all(x.plain for x in store.state.runs()) and "Exchange" not in plan(store.scan(b"k01"))
    assert live(store.view()) == want
    old = store.state.last_seq
    store.write(Batch().put(b"k005", b"new").delete(b"k006").put(b"zz", b"9"))
    after = {k: v for k, v in want.items() if k != b"k006"} | {b"k005": b"new", b"zz": b"9"}
    assert live(store.view()) == after and live(store.view(old)) == want
    asked = spark.createDataFrame([(bytearray(k),) for k in (b"k005", b"k006", b"zz", b"none", b"k079", b"k079")], "key binary")
    got = {bytes(x["key"]): bytes(x["value"]) if x["found"] else None for x in store.view().multi_get(asked).collect()}
    assert got == {k: after.get(k) for k in (b"k005", b"k006", b"zz", b"none", b"k079")}
    store.vacuum()
    assert store.check().count() == 0
    store.close()


def test_runs_with_versions_or_tombstones_are_not_plain(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "db"), TINY)
    store.put(b"a", b"1")
    snap = store.snapshot()
    store.write(Batch().put(b"a", b"2").delete(b"b"))
    store.flush()
    store.compact_level(0)
    assert not any(x.plain for x in store.state.runs())
    assert live(snap) == {b"a": b"1"} and live(store.view()) == {b"a": b"2"}
    snap.close()
    store.close()


@pytest.mark.parametrize("mode", [S.SYNC_OFF, S.SYNC_INTERVAL])
def test_grouped_commits(spark, tmp_path, mode):
    now = [0.0]
    options = S.Options(sync=mode, sync_interval_ms=100, auto_compact=False)
    store = open_store(spark, str(tmp_path / "db"), options, clock=lambda: now[0])
    for i in range(50):
        store.put(b"k%d" % (i % 7), b"%d" % i)
    store.delete(b"k0")
    assert store.state.version == 0 and len(store.pending) == 51
    now[0] = 0.2
    store.write(Batch().put(b"x", b"1").put(b"y", b"2"))
    assert bool(store.pending) == (mode == S.SYNC_OFF)
    want = {b"k%d" % k: b"%d" % max(i for i in range(50) if i % 7 == k) for k in range(1, 7)} | {b"x": b"1", b"y": b"2"}
    assert live(store.view()) == want and store.state.last_seq == 53 and store.state.version == 1
    store.put(b"last", b"3")
    store.close()
    again = open_store(spark, str(tmp_path / "db"), options)
    assert live(again.view()) == want | {b"last": b"3"} and again.state.last_seq == 54
    again.close()


def test_a_held_batch_is_lost_whole_or_not_at_all(spark, tmp_path):
    files = Failing(str(tmp_path / "db"))
    store = open_store(spark, str(tmp_path / "db"), S.Options(sync=S.SYNC_OFF), files)
    store.write(Batch().put(b"a", b"1").put(b"b", b"2"))
    files.left, files.after = 1, False
    with pytest.raises(OSError):
        store.sync()
    with pytest.raises(errors.StoreFailedError):
        store.put(b"c", b"3")
    assert live(store.view()) == {}
    store.close()


def test_automatic_maintenance_may_fail_twice(spark, tmp_path):
    files = Failing(str(tmp_path / "db"))
    store = open_store(spark, str(tmp_path / "db"), S.Options(memtable_bytes=1), files)
    for i, n in enumerate((2, 2, 2)):  # each commit's own manifest succeeds, that of the flush behind it fails
        files.left, files.after = n, i == 1  # the second failure comes after the manifest was there
        store.put(b"k%d" % i, b"v")
        assert store.failures == i + 1
    with pytest.raises(errors.StoreFailedError):
        store.put(b"no", b"v")
    assert live(store.view()) == {b"k%d" % i: b"v" for i in range(3)}
    store.close()
    files.left = None
    again = open_store(spark, str(tmp_path / "db"), S.Options(memtable_bytes=1), files)
    again.put(b"yes", b"v")
    again.vacuum()
    assert again.failures == 0 and not again.state.tail and again.check().count() == 0
    again.close()


def test_lease_of_a_dead_process_is_broken_once(spark, tmp_path):
    files = LocalFiles(str(tmp_path / "db"))
    dead = subprocess.run([sys.executable, "-c", "import os; print(os.getpid())"], capture_output=True, text=True, check=True).stdout
    stale = {"host": socket.gethostname(), "pid": int(dead), "token": "t1"}
    files.create("LOCK", json.dumps(stale))
    files.create(f"pins/{int(dead)}-1-0.json", json.dumps({"seq": 0, "version": 0}))
    store = open_store(spark, str(tmp_path / "db"))
    assert not store.pins() and store.oldest_snapshot() == S.MAX_SEQ
    with pytest.raises(errors.LockedError):
        open_store(spark, str(tmp_path / "db"))
    store.close()
    for held in (stale, stale | {"host": "elsewhere", "token": "t2"}, {"pid": 1}):
        files.create("LOCK", json.dumps(held))
        with pytest.raises(errors.LockedError):
            open_store(spark, str(tmp_path / "db"))
        files.delete("LOCK")
