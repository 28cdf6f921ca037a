"""The store's API against a dictionary, across flush, compaction, reopening and injected failures."""

import random

import pytest

from strata import errors
from strata import schema as S
from strata.sources import manifest as M
from strata.sources.files import LocalFiles
from strata.store import Batch, open_store
from strata.streaming.ingest import ingest

TINY = S.Options(memtable_bytes=1 << 40, l0_trigger=2, target_file_bytes=4096, base_level_bytes=8192, auto_compact=False)


def live(view):
    return {bytes(r["key"]): bytes(r["value"]) for r in view.scan().collect()}


@pytest.fixture
def store(spark, tmp_path):
    s = open_store(spark, str(tmp_path / "db"), TINY)
    yield s
    if not s.closed:
        s.handles = 0
        s.close()


def test_round_trip_and_reopen(spark, tmp_path, store):
    store.write(Batch().put(b"a", b"1").put(b"b", b"2").put(b"a", b"3").delete(b"zz"))
    store.put(b"c")
    store.delete(b"b")
    assert live(store.view()) == {b"a": b"3", b"c": b""}
    assert store.get(b"c") == b"" and store.state.last_seq == 6
    for k in (b"b", b"nope"):
        with pytest.raises(errors.NotFoundError):
            store.get(k)
    with pytest.raises(errors.LockedError):
        open_store(spark, str(tmp_path / "db"))
    store.close()
    with pytest.raises(errors.ClosedError):
        store.close()
    again = open_store(spark, str(tmp_path / "db"), TINY)
    assert live(again.view()) == {b"a": b"3", b"c": b""}
    again.close()


def test_snapshots_survive_flush_and_compaction(store):
    store.write(Batch().put(b"k", b"old").put(b"gone", b"present"))
    snap = store.snapshot()
    store.write(Batch().put(b"k", b"new").delete(b"gone"))
    store.flush()
    store.compact_level(0)
    assert live(snap) == {b"k": b"old", b"gone": b"present"}
    assert live(store.view(2)) == live(snap)
    assert live(store.view()) == {b"k": b"new"}
    with pytest.raises(errors.OpenHandlesError):
        store.close()
    store.vacuum()
    assert live(snap) == {b"k": b"old", b"gone": b"present"}
    snap.close()
    store.compact_level(1)
    store.vacuum()
    assert live(store.view()) == {b"k": b"new"} and store.read(store.state.runs()).count() == 1
    assert store.check().count() == 0


def test_cursor(store):
    store.write(Batch().put(b"b", b"2").put(b"c", b"3").put(b"d", b"4").put(b"e", b"5"))
    c = store.cursor(b"c", b"e")
    store.put(b"cc", b"late")
    seen = []
    ok = c.first()
    while ok:
        seen.append(c.key())
        ok = c.next()
    assert seen == [b"c", b"d"]
    assert c.seek_ge(b"a") and c.key() == b"c" and c.seek_ge(b"cz") and c.value() == b"4" and not c.seek_ge(b"e")
    c.close()
    with pytest.raises(errors.ClosedError):
        c.close()


def test_batch_rules(store):
    b = Batch().put(b"before", b"1").put(b"", b"2").put(b"after", b"3")
    with pytest.raises(errors.InvalidKeyError):
        store.write(b)
    assert live(store.view()) == {} and store.state.last_seq == 0
    assert Batch().put(b"k1", b"v1").delete(b"k2").encoded_bytes() == 23
    with pytest.raises(errors.InvalidValueError):
        store.put(b"k", b"x" * (S.MAX_VALUE_BYTES + 1))
    store.write(Batch())
    assert store.state.version == 0


def test_model(store):
    r, model, at, = random.Random(4), {}, {}
    snaps = []
    for step in range(18):
        x = r.random()
        if x < 0.6:
            b = Batch()
            for _ in range(r.randint(1, 5)):
                k = b"key-%02d" % r.randrange(12)
                if r.random() < 0.7:
                    v = b"v%d" % r.randrange(1000)
                    b.put(k, v)
                    model[k] = v
                else:
                    b.delete(k)
                    model.pop(k, None)
            store.write(b)
        elif x < 0.72:
            store.flush()
        elif x < 0.84:
            store.compact()
        elif len(snaps) < 3:
            snaps.append((store.snapshot(), dict(model)))
        else:
            snaps.pop(0)[0].close()
        at[store.state.last_seq] = dict(model)
    assert live(store.view()) == model
    for s, want in snaps:
        assert live(s) == want
        s.close()
    store.vacuum()
    assert store.check().count() == 0


class Failing(LocalFiles):
    """Fails the n-th creation, before or after it took place."""

    def __init__(self, root):
        super().__init__(root)
        self.left, self.after = None, False

    def create(self, name, text):
        if self.left is not None and name.startswith("manifest"):
            self.left -= 1
            if self.left == 0:
                if self.after:
                    super().create(name, text)
                raise OSError("injected")
        return super().create(name, text)


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("step", ["write", "flush", "compact_level"])
def test_failed_commit_is_sticky_and_recovers(spark, tmp_path, step, after):
    files = Failing(str(tmp_path / "db"))
    s = open_store(spark, str(tmp_path / "db"), TINY, files)
    s.put(b"a", b"1")
    if step == "compact_level":
        s.flush()
    files.left, files.after = 1, after
    with pytest.raises(OSError):
        s.put(b"b", b"2") if step == "write" else s.flush() if step == "flush" else s.compact_level(0)
    with pytest.raises(errors.StoreFailedError):
        s.put(b"c", b"3")
    assert s.get(b"a") == b"1"
    s.close()
    files.left = None
    again = open_store(spark, str(tmp_path / "db"), TINY, files)
    assert live(again.view()) == {b"a": b"1"} | ({b"b": b"2"} if step == "write" and after else {})
    again.put(b"d", b"4")
    assert again.check().count() == 0
    again.close()


def test_manifest_rejects_every_flip_and_prefix():
    run = M.Run(1, "runs/000001", 10, 2, "61", "62", 1, 2)
    text = M.encode(M.State(version=3, next_num=2, last_seq=2, tail=(run,)))
    assert M.encode(M.decode(text)) == text
    for i in range(len(text)):
        for bad in (text[:i], text[:i] + chr(ord(text[i]) ^ 1) + text[i + 1 :]):
            with pytest.raises(errors.CorruptionError):
                M.decode(bad)


def test_manifests_of_changes_lead_to_the_same_states(tmp_path):
    files, r, number = LocalFiles(str(tmp_path)), random.Random(3), iter(range(1, 10_000))
    state = M.install(files, M.State())
    states = {0: state}

    def run():
        n, lo = next(number), bytes(r.randrange(256) for _ in range(2))
        return M.Run(n, f"runs/{n}", 10, 2, lo.hex(), (lo + b"z").hex(), n, n + 1)

    for _ in range(3 * M.FULL_EVERY):
        before, x, levels = state, r.random(), list(state.levels)
        if x < 0.6:
            new = {"tail": (*state.tail, run())}
        elif x < 0.8:
            levels[0] = (*levels[0], run())
            new = {"tail": (), "levels": tuple(levels)}
        else:
            levels[1] = tuple(sorted((*levels[1][1:], run(), run()), key=lambda r: bytes.fromhex(r.lo)))
            new = {"levels": ((), *levels[1:]), "cursors": {"0": "61"}, "streams": {"s": 4}}
        state = M.install(files, before.changed(next_num=10_000, last_seq=20_000, **new), before)
        states[state.version] = state
    assert all(M.load(files, v) == s for v, s in states.items()) and M.load(files) == state
    assert M.needed(files, {95, 40}) == {*range(64, 96), *range(32, 41)}
    sizes = files.list(M.FOLDER)
    assert sizes[M.name_of(95)] < sizes[M.name_of(64)]
    files.delete(M.name_of(70))
    with pytest.raises(errors.CorruptionError):
        M.load(files, 95)
    assert M.load(files, 69) == states[69] and M.load(files) == state
    text = files.read(M.name_of(90))
    for i in range(len(text)):
        with pytest.raises(errors.CorruptionError):
            M.decode(M.encode(states[89]), text[:i] + chr(ord(text[i]) ^ 1) + text[i + 1 :])


def test_damage_is_reported(spark, tmp_path, store):
    store.put(b"a", b"1")
    store.put(b"b", b"2")
    (tmp_path / "db/runs/000099").mkdir()
    (tmp_path / "db/runs/000099/part-0.parquet").write_bytes(b"x")
    gone = next((tmp_path / "db/runs").glob("000001-*/*.parquet"))
    gone.unlink()
    tags = {r["tag"] for r in store.check().collect()}
    assert tags == {"orphan", "missing"}
    (tmp_path / "db/manifest/v0000000002.json").write_text("{}")
    store.close()
    with pytest.raises(errors.CorruptionError):
        open_store(spark, str(tmp_path / "db"))


def test_stream_is_exactly_once(spark, tmp_path, store):
    src = str(tmp_path / "in")
    rows = [(i, b"k%d" % (i % 7), S.DELETE if i % 5 == 0 else S.SET, b"v%d" % i) for i in range(40)]
    schema = "ordinal long, key binary, kind byte, value binary"
    spark.createDataFrame(rows, schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    ingest(store, stream, "s", str(tmp_path / "c1")).awaitTermination()
    want = {}
    for _, k, kind, v in rows:
        want.pop(k, None)
        if kind == S.SET:
            want[k] = v
    assert live(store.view()) == want
    last = store.state.last_seq
    ingest(store, stream, "s", str(tmp_path / "c2")).awaitTermination()  # a lost checkpoint replays batch 0
    assert store.state.last_seq == last == 40 and live(store.view()) == want
