"""Levels far over their bytes: few steps down however many files, the same answers, disjoint files, stable snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from strata import schema as S
from strata.plans import compaction
from strata.sources.manifest import Run, State
from strata.store import open_store
from test_store import live

LOW = S.Options(memtable_bytes=1 << 40, l0_trigger=2, target_file_bytes=4096, base_level_bytes=4096, auto_compact=False).resolved()


def run(num, lo, hi, plain=True, size=1024):
    return Run(num, f"runs/{num}", size, 1, (b"%04d" % lo).hex(), (b"%04d" % hi).hex(), 1, 1, plain)


def at(one, two=(), **kw):
    return State(last_seq=9, levels=((), tuple(one), tuple(two), *((),) * (S.LEVELS - 3)), **kw)


def nums(picked):
    return [[r.num for r in runs] for runs in picked]


def test_as_many_runs_as_a_level_is_over():
    many = [run(i, 10 * i, 10 * i + 5) for i in range(100)]
    assert nums(compaction.inputs(at(many), 1, LOW)) == [list(range(97)), []]  # 3 of 1,024 bytes stay below 4,096
    assert nums(compaction.inputs(at(many, cursors={"1": (b"%04d" % 970).hex()}), 1, LOW)) == [[98, 99], []]
    assert nums(compaction.inputs(at(many, cursors={"1": (b"%04d" % 990).hex()}), 1, LOW)) == [list(range(97)), []]
    assert nums(compaction.inputs(at(many[:2]), 1, LOW)) == [[0], []]  # asked for, though not due


def test_runs_that_go_as_they_are_and_runs_to_merge_go_apart():
    many = [run(i, 10 * i, 10 * i + 5, plain=i not in (4, 6)) for i in range(20)]
    assert nums(compaction.inputs(at(many), 1, LOW)) == [[0, 1, 2, 3], []]
    below = [run(100, 0, 2), run(101, 6, 9), run(102, 75, 79), run(103, 400, 500)]
    assert nums(compaction.inputs(at(many, below), 1, LOW)) == [list(range(8)), [100, 101, 102]]
    assert nums(compaction.inputs(at(many, [run(100, 0, 2), run(101, 71, 79)]), 1, LOW)) == [list(range(8)), [100, 101]]
    assert nums(compaction.inputs(at(many[7:], [run(101, 200, 300)]), 1, LOW)) == [list(range(7, 17)), []]


@pytest.mark.parametrize("snapshots", [False, True])
def test_a_large_level_goes_down_in_few_steps(spark, tmp_path, snapshots):
    r, want, snaps = random.Random(5), {}, []
    store = open_store(spark, str(tmp_path / "db"), LOW)
    for n in range(3):
        rows = []
        for i in range(1500):
            k = b"k%05d" % r.randrange(*((0, 4000), (4000, 8000), (1000, 7000))[n])
            v = None if r.random() < 0.2 else b"%032x" % r.getrandbits(128)
            rows.append((i, bytearray(k), S.DELETE if v is None else S.SET, v and bytearray(v)))
            want.pop(k, None) if v is None else want.__setitem__(k, v)
        store.write_frame(spark.createDataFrame(rows, "ordinal long, key binary, kind int, value binary"))
        store.flush()
        store.compact_level(0)
        if snapshots:
            snaps.append((store.snapshot(), dict(want)))
        before = store.counters["compactions"]
        store.compact()
        assert store.counters["compactions"] - before <= 6
        assert max(compaction.scores(store.state, LOW).values()) < 1 and sum(bool(x) for x in store.state.levels) >= 2
        assert live(store.view()) == want
    for snap, then in snaps:
        assert live(snap) == then
    store.vacuum()
    assert store.check(strict=False).count() == 0
    for snap, then in snaps:
        assert live(snap) == then
        snap.close()
    store.vacuum()
    assert store.check().count() == 0
    store.close()
    again = open_store(spark, str(tmp_path / "db"), LOW)
    assert live(again.view()) == want and live(again.view(store.state.last_seq)) == want
    again.close()


def test_files_are_as_many_as_what_is_kept_fills(spark, tmp_path):
    """Twelve versions of each key in runs of many files become one version in few; a small file's key filter is small."""
    store = open_store(spark, str(tmp_path / "db"), LOW)
    rows = spark.range(12 * 300).select(
        F.col("id").alias("ordinal"), F.encode(F.lpad((F.col("id") % 300).cast("string"), 8, "0"), "utf-8").alias("key"),
        F.lit(S.SET).alias("kind"), F.unhex(F.md5(F.col("id").cast("string"))).alias("value"),
    )
    store.write_frame(rows)
    store.flush()
    kept = 300 * (8 + 9 + 16)
    assert store.state.levels[0][0].size > 8 * kept
    want = live(store.view())
    store.compact_level(0)
    made = store.state.levels[1]
    assert sum(r.entries for r in made) == 300 and 2 <= len(made) <= kept // LOW.target_file_bytes + 2
    assert max(r.size for r in made) < 2 * LOW.target_file_bytes
    assert live(store.view()) == want and store.check(strict=False).count() == 0
    store.close()


def test_versions_that_a_snapshot_keeps_are_rewritten_once(spark, tmp_path):
    """Below level 0 nothing can be dropped until the snapshot ends: runs with many versions go down as they are."""
    store = open_store(spark, str(tmp_path / "db"), LOW)
    rows = spark.range(4000).select(
        F.col("id").alias("ordinal"), F.encode(F.lpad((F.col("id") % 500).cast("string"), 8, "0"), "utf-8").alias("key"),
        F.when(F.col("id") % 7 == 0, S.DELETE).otherwise(S.SET).alias("kind"), F.unhex(F.md5(F.col("id").cast("string"))).alias("value"),
    )
    store.write_frame(rows.where("ordinal < 900"))
    store.flush()
    snap = store.snapshot()
    then = live(snap)
    store.write_frame(rows.where("ordinal >= 900"))
    store.flush()
    now = live(store.view())
    store.compact_level(0)
    assert not all(r.plain for r in store.state.levels[1]) and {r.settled for r in store.state.levels[1]} == {900}
    written = store.counters["compaction_bytes"]
    store.compact()
    assert store.counters["compaction_bytes"] == written and len([x for x in store.state.levels if x]) >= 2
    assert live(snap) == then and live(store.view()) == now and live(store.view(900)) == then
    snap.close()
    store.close()
    store = open_store(spark, str(tmp_path / "db"), LOW)
    for _ in range(2 * sum(map(len, store.state.levels))):  # asked for until every run has gone by once
        level = next(n for n, x in enumerate(store.state.levels) if x)
        if all(r.plain for r in store.state.runs()):
            break
        store.compact_level(level)
    assert all(r.plain for r in store.state.runs()) and sum(r.entries for r in store.state.runs()) == len(now)
    store.vacuum()
    assert live(store.view()) == now and store.check().count() == 0
    store.close()
