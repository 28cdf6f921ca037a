"""A persistent store: mutation runs as Parquet, a manifest swapped atomically, reads as lazy DataFrames.

A commit writes its rows as one delta and installs a manifest that names it, so a batch is seen whole or not at all.
flush() turns deltas into one run of level 0, compact() rewrites runs down the levels, and neither changes an answer: a
handle reads the files of its own manifest version. Files go only by vacuum(), once no manifest in use names them.
"""

from __future__ import annotations

import json
import os
import socket
import threading
import time
from collections import Counter
from dataclasses import replace
from functools import wraps
from itertools import count
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from strata import errors, schema as S
from strata.functions import keys as K
from strata.operators import reads, storage, versions
from strata.plans import compaction, reading
from strata.sources import manifest as M
from strata.sources.files import files_for

LOCK, BROKEN, RUNS, PINS, STAGE = "LOCK", "broken", "runs", "pins", "stage"
#: A run that is written by many tasks has files of this share of the target size at least.
LEAST_SHARE = 16
#: Sizes of the key's filter that a file is written with, each half the one before, from Parquet's greatest (1 MiB) down to 32
#: bytes; the least that has the rate of false positives stays. Of Parquet's own five the least takes 64 KiB, in a file of any size.
FILTER_SIZES = 16
#: Failures of automatic maintenance in a row that make a store read-only.
MOST_FAILURES = 3


def exclusive(method):
    """A method of a store that the ticker's thread must not run into."""
    @wraps(method)
    def run(self, *args, **options):
        with self._mutex:
            return method(self, *args, **options)

    return run


def varint_size(n: int) -> int:
    return 1 if n < 128 else (n.bit_length() + 6) // 7


class Batch:
    """Mutations committed together; the first invalid entry makes every later call and the commit fail."""

    __slots__ = ("rows", "error", "size", "user")

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.rows: list[tuple[int, bytes, bytes | None]] = []
        self.error: Exception | None = None
        self.size, self.user = S.BATCH_HEADER_BYTES, 0

    def _add(self, kind: int, key: bytes, value: bytes | None) -> Batch:
        if self.error is not None:
            return self
        k, v = len(key), len(value) if value else 0
        if not 1 <= k <= S.MAX_KEY_BYTES:
            self.error = errors.InvalidKeyError(f"key of {k} bytes")
        elif v > S.MAX_VALUE_BYTES:
            self.error = errors.InvalidValueError(f"value of {v} bytes")
        else:
            self.rows.append((kind, bytes(key), None if kind == S.DELETE else bytes(value or b"")))
            self.size += 1 + varint_size(k) + k + (varint_size(v) + v if kind == S.SET else 0)
            self.user += k + v
        return self

    def put(self, key: bytes, value: bytes | None = b"") -> Batch:
        return self._add(S.SET, key, value)

    def delete(self, key: bytes) -> Batch:
        return self._add(S.DELETE, key, None)

    def __len__(self) -> int:
        return len(self.rows)

    def encoded_bytes(self) -> int:
        """Bytes that the batch takes in the log, its header included."""
        return self.size


class View:
    """Reads at one sequence number over one manifest version."""

    def __init__(self, store: Store, state: M.State, seq: int):
        self.store, self.state, self.seq, self.closed = store, state, seq, False

    def log(self, lower: bytes | None = None, upper: bytes | None = None) -> DataFrame:
        """Mutations up to the view's seq whose files can hold keys in [lower, upper)."""
        if self.closed:
            raise errors.ClosedError("view")
        return reads.as_of(self.store.read(r for r in self.state.runs() if r.meets(lower, upper)), self.seq)

    def parts(self, lower: bytes | None = None, upper: bytes | None = None) -> tuple[DataFrame | None, DataFrame | None]:
        """(log, plain): rows in [lower, upper) among which the newest must be found, and rows that are it; None for no runs."""
        if self.closed:
            raise errors.ClosedError("view")
        plain, mixed = reading.split_plain([r for r in self.state.runs() if r.meets(lower, upper)])
        rows = lambda runs: reads.as_of(self.store.read(runs).where(reads.in_bounds(lower, upper)), self.seq)
        return rows(mixed) if mixed or not plain else None, rows(plain) if plain else None

    def scan(self, lower: bytes | None = None, upper: bytes | None = None) -> DataFrame:
        return reads.live_rows(*self.parts(lower, upper)).select("key", "value")

    def get(self, key: bytes) -> bytes:
        row = reads.get(self.log(key, key + b"\0"), key).first()
        if not row["found"]:
            raise errors.NotFoundError(key)
        return bytes(row["value"])

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """A row (key, found, value) for each distinct key; only runs that can hold keys from the least to the greatest are read."""
        ends = keys.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
        bounds = (None, None) if ends["lo"] is None else (bytes(ends["lo"]), bytes(ends["hi"]) + b"\0")
        log, plain = self.parts(*bounds)
        return reads.multi_get(log, keys, plain=plain)

    def cursor(self, lower: bytes | None = None, upper: bytes | None = None) -> Cursor:
        return Cursor(self, lower, upper)


class Cursor:
    """An ordered walk over a view's live rows in [lower, upper)."""

    def __init__(self, view: View, lower: bytes | None, upper: bytes | None):
        self.view, self.lower, self.upper = View(view.store, view.state, view.seq), lower, upper
        self.rows, self.row, self.closed, self.failure = None, None, False, None
        view.store.handles += 1

    def _from(self, start: bytes | None) -> bool:
        if self.closed:
            raise errors.ClosedError("cursor")
        self.failure = None
        try:
            self.rows = self.view.scan(start, self.upper).orderBy("key").toLocalIterator()
        except Exception as e:
            self.rows, self.row, self.failure = None, None, e
            return False
        return self.next()

    def first(self) -> bool:
        return self._from(self.lower)

    def seek_ge(self, key: bytes | None) -> bool:
        return self._from(max((x for x in (key, self.lower) if x is not None), default=None))

    def next(self) -> bool:
        """Step on; False at the end, and after a failure, which error() tells apart."""
        try:
            self.row = next(self.rows, None) if self.rows is not None and not self.closed else None
        except Exception as e:
            self.rows, self.row, self.failure = None, None, e
        return self.row is not None

    def error(self) -> Exception | None:
        """What ended the walk before its end; a new first() or seek_ge() starts afresh."""
        return self.failure

    def valid(self) -> bool:
        return self.row is not None

    def key(self) -> bytes:
        return bytes(self.row["key"])

    def value(self) -> bytes:
        return bytes(self.row["value"])

    def close(self) -> None:
        if self.closed:
            raise errors.ClosedError("cursor")
        self.closed, self.row = True, None
        self.view.store.handles -= 1


class Snapshot(View):
    """A pinned view: garbage collection keeps what it sees, vacuum() its files, until close()."""

    def __init__(self, store: Store, state: M.State, seq: int, pin: str):
        super().__init__(store, state, seq)
        self.pin = pin

    def close(self) -> None:
        if self.closed:
            raise errors.ClosedError("snapshot")
        self.closed = True
        self.store.files.delete(self.pin)
        self.store.handles -= 1


class Store:
    """An open store; one writer holds its lease."""

    def __init__(self, spark: SparkSession, path: str, options: S.Options | None = None, files=None, clock=time.monotonic):
        self.spark, self.files, self.options = spark, files or files_for(spark, path), (options or S.Options()).resolved()
        self.clock, self.pending, self.pending_bytes, self.pending_user, self.synced, self.failures = clock, [], 0, 0, clock(), 0
        if not self._lock():
            raise errors.LockedError(path)
        try:
            state = M.load(self.files)
            if state is None:
                if self.files.list(RUNS):
                    raise errors.CorruptionError("runs without a manifest")
                state = M.install(self.files, M.State())
            for pin in self.files.list(PINS):  # of holders before this one: their snapshots ended with them
                self.files.delete(pin)
            sizes = sizes_by_path(self.files.list(RUNS))
            if lost := [r.path for r in state.runs() if r.path not in sizes]:
                raise errors.CorruptionError(f"missing {lost}")
        except BaseException:
            self.files.delete(LOCK)
            raise
        self.state, self.handles, self.failure, self.closed = state, 0, None, False
        self.counters: Counter = Counter()
        self.last_error: Exception | None = None  # of automatic maintenance or of the ticker
        self._pins, self._mutex, self._ticker = count(1), threading.RLock(), None

    def _lock(self) -> bool:
        """Take the lease, also from a process of this host that is no more.

        A dead holder's lease, named by its token, is broken by who creates the file of that name: one process only, ever.
        """
        mine = json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "token": uuid4().hex})
        if self.files.create(LOCK, mine):
            return True
        try:
            held = json.loads(self.files.read(LOCK))
            if held["host"] != socket.gethostname():
                return False
            os.kill(held["pid"], 0)
            return False
        except ProcessLookupError:
            if not self.files.create(f"{BROKEN}/{held['token']}", mine):
                return False
            self.files.delete(LOCK)
            return self.files.create(LOCK, mine)
        except (OSError, ValueError, KeyError):
            return False

    # Reading.

    def read(self, runs) -> DataFrame:
        paths = [self.files.path(r.path) for r in runs]
        return self.spark.read.schema(S.LOG).parquet(*paths) if paths else self.spark.createDataFrame([], S.LOG)

    def view(self, seq: int | None = None) -> View:
        """Reads as of a sequence number, by default the newest."""
        self._open()
        self.sync()
        return View(self, self.state, self.state.last_seq if seq is None else seq)

    def get(self, key: bytes) -> bytes:
        self.counters["gets"] += 1
        return self.view().get(key)

    def scan(self, lower: bytes | None = None, upper: bytes | None = None, seq: int | None = None) -> DataFrame:
        return self.view(seq).scan(lower, upper)

    def cursor(self, lower: bytes | None = None, upper: bytes | None = None) -> Cursor:
        return self.view().cursor(lower, upper)

    def snapshot(self) -> Snapshot:
        self._open()
        self.sync()
        pin = f"{PINS}/{os.getpid()}-{next(self._pins)}-{self.state.version}.json"
        self.files.create(pin, json.dumps({"seq": self.state.last_seq, "version": self.state.version}))
        self.handles += 1
        return Snapshot(self, self.state, self.state.last_seq, pin)

    def pins(self) -> list[dict]:
        return [json.loads(self.files.read(n)) for n in self.files.list(PINS)]

    def oldest_snapshot(self) -> int:
        return min((p["seq"] for p in self.pins()), default=S.MAX_SEQ)

    # Writing.

    def put(self, key: bytes, value: bytes | None = b"") -> None:
        self.counters["puts"] += 1
        self.write(Batch().put(key, value))

    def delete(self, key: bytes) -> None:
        self.counters["deletes"] += 1
        self.write(Batch().delete(key))

    def write(self, batch: Batch) -> None:
        """Commit a batch; an empty one takes no sequence number.

        With SYNC_ALWAYS it is durable on return. Otherwise batches are held on the driver and committed together, by
        sync(): once memtable_bytes are held, sync_interval_ms have passed (SYNC_INTERVAL), or something is read, flushed
        or closed. A crash loses the batches held, each as a whole.
        """
        if batch.error:
            raise batch.error
        if len(batch) > S.MAX_BATCH_ENTRIES or batch.encoded_bytes() > S.MAX_BATCH_BYTES:
            raise errors.BatchTooLargeError(f"{len(batch)} entries")
        self._writable()
        if not batch.rows:
            return
        with self._mutex:
            self.pending += batch.rows
            self.pending_bytes += batch.size
            self.pending_user += batch.user
            mode = self.options.sync
            late = mode == S.SYNC_INTERVAL and (self.clock() - self.synced) * 1000 >= self.options.sync_interval_ms
            if mode == S.SYNC_ALWAYS or late or self.pending_bytes >= self.options.memtable_bytes:
                self.sync()
            elif mode == S.SYNC_INTERVAL and self.clock is time.monotonic and self._ticker is None:
                self._ticker = threading.Timer(self.options.sync_interval_ms / 1000, self._tick)
                self._ticker.daemon = True
                self._ticker.start()

    def _tick(self) -> None:
        """Commit what is held when the interval has passed, also if nothing else is called."""
        with self._mutex:
            self._ticker = None
            try:
                if not self.closed:
                    self.sync()
            except Exception as e:
                self.last_error = e  # the store is read-only now, as after any failed commit

    @exclusive
    def sync(self) -> None:
        """Commit the batches held; a store that failed keeps them unseen."""
        if not self.pending or self.failure:
            return
        kinds, keys, values = zip(*self.pending)
        seqs = range(self.state.last_seq + 1, self.state.last_seq + 1 + len(keys))
        columns = [pa.array(keys, pa.binary()), pa.array(seqs, pa.int64()), pa.array(kinds, pa.int8()), pa.array(values, pa.binary())]
        payload, user, self.pending, self.pending_bytes, self.pending_user = self.pending_bytes, self.pending_user, [], 0, 0
        self._commit(self.spark.createDataFrame(pa.table(columns, names=S.LOG.names)).coalesce(1), payload, user)
        self.synced = self.clock()

    @exclusive
    def write_frame(self, rows: DataFrame, stream: tuple[str, int] | None = None) -> None:
        """Commit rows (ordinal, key, kind, value) of any number as one batch, numbered in the order of `ordinal`, which must
        be neither null nor repeated.

        With stream = (name, batch id), a batch id that the manifest already names is skipped: replays change nothing.
        The rows are written to a folder of the store first, so a source that gives other rows each time it is evaluated is
        evaluated once: what is checked, numbered and committed are the same rows.
        """
        self._writable()
        if stream and stream[1] <= self.state.streams.get(stream[0], -1):
            return
        folder = f"{STAGE}/{uuid4().hex}"
        try:
            self._write_staged(rows, folder, stream)
        finally:
            self.files.delete(folder)

    def _write_staged(self, rows: DataFrame, folder: str, stream: tuple[str, int] | None) -> None:
        seen, key, kind, value = Observation(), F.col("key"), F.col("kind"), F.col("value")
        rows = rows.select("ordinal", "key", "kind", "value").observe(
            seen,
            F.count("*").alias("n"),
            F.count_if(~K.valid_key(key)).alias("keys"),
            F.count_if(~K.valid_value(kind, value)).alias("values"),
            F.count_if(F.coalesce(~kind.isin(S.SET, S.DELETE), F.lit(True))).alias("kinds"),
            F.count_if(F.col("ordinal").isNull()).alias("ordinals"),
            F.sum(K.entry_bytes(kind, key, value)).alias("bytes"),
            F.sum(F.octet_length(key) + F.when(kind == S.SET, F.coalesce(F.octet_length(value), F.lit(0))).otherwise(0)).alias("user"),
        )
        rows.write.parquet(self.files.path(folder))
        found = seen.get
        if found["keys"]:
            raise errors.InvalidKeyError(f"{found['keys']} keys")
        if found["values"]:
            raise errors.InvalidValueError(f"{found['values']} values")
        if found["kinds"]:
            raise errors.CorruptionError(f"{found['kinds']} entries of no kind")
        if found["ordinals"]:
            raise errors.InvalidOrdinalError(f"{found['ordinals']} null ordinals")
        if not found["n"]:
            return
        staged = self.spark.read.schema(rows.schema).parquet(self.files.path(folder))
        if staged.select("ordinal").distinct().count() != found["n"]:
            raise errors.InvalidOrdinalError("ordinals stand twice")
        self.sync()
        numbered = versions.assign_seq(staged, self.state.last_seq + 1)
        put = F.when(F.col("kind") == S.SET, F.coalesce(F.col("value"), F.lit(b"")))
        log = numbered.select("key", "seq", F.col("kind").cast("byte").alias("kind"), put.alias("value"))
        self._commit(log, found["bytes"] + S.BATCH_HEADER_BYTES, found["user"], stream, bulk=found["bytes"] >= self.options.memtable_bytes)

    def _commit(self, log: DataFrame, payload: int, user: int, stream: tuple[str, int] | None = None, bulk: bool = False) -> None:
        """Publish a log as a delta; a bulk one at once as a run of level 0, in files of disjoint keys, which flush() would make of it."""
        if len(self.state.levels[0]) >= self.options.l0_stall and self.options.auto_compact:
            self.counters["stalls"] += 1
            self.compact()
        with self._sticky():
            num, state = self.state.next_num, self.state
            rows = self._clustered(log, self._files(payload)) if bulk else log.sortWithinPartitions("key", F.desc("seq"))
            (run,) = self._write_run(rows, num, whole=True)
            streams = state.streams | ({stream[0]: stream[1]} if stream else {})
            placed = {"levels": ((*state.levels[0], run), *state.levels[1:])} if bulk else {"tail": (*state.tail, run)}
            self.state = M.install(self.files, state.changed(next_num=num + 1, last_seq=run.max_seq, streams=streams, **placed), state)
        self.counters["log_bytes"] += payload
        self.counters["user_bytes"] += user
        if bulk:
            self.counters["flush_bytes"] += run.size
        if bulk or sum(r.size for r in self.state.tail) >= self.options.memtable_bytes:
            self._maintain()

    def _maintain(self) -> None:
        """Flush, and compact if that is due. The commit before stands whether or not this works.

        After a failure the newest manifest says what took place, since no one else holds the lease; the next commit
        tries again. MOST_FAILURES in a row make the store read-only.
        """
        try:
            self.flush()
            if self.options.auto_compact and compaction.pick(self.state, self.options) is not None:
                self.compact()
            self.failures = 0
        except Exception as e:
            self.last_error = e
            self.failures += 1
            self.counters["failed_maintenance"] += 1
            if self.failures < MOST_FAILURES:
                self.state, self.failure = M.load(self.files), None

    def _write_run(self, rows: DataFrame, num: int, whole: bool, single: bool = False) -> list[M.Run]:
        """Write rows as Parquet and describe them: as one run, or each file as a run of its own; single: one version a key."""
        folder = f"{RUNS}/{num:06d}-{uuid4().hex[:8]}"  # a number may come again after a failed commit
        stats = [
            F.count("*").alias("n"), F.hex(F.min("key")).alias("lo"), F.hex(F.max("key")).alias("hi"),
            F.min("seq").alias("a"), F.max("seq").alias("b"), F.count_if(F.col("kind") != S.SET).alias("dead"),
        ]
        seen = Observation()
        out = rows.observe(seen, *stats) if whole else rows
        options = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        options["parquet.bloom.filter.candidates.number#key"] = str(FILTER_SIZES)
        options["parquet.bloom.filter.fpp#key"] = f"{0.6185 ** self.options.bloom_bits_per_key:.6f}"
        out.write.options(**options).option("parquet.block.size", self.options.block_bytes).parquet(self.files.path(folder))
        sizes = sizes_by_path(self.files.list(folder))
        if whole:  # its figures were taken while it was written
            r = seen.get
            return [M.Run(num, folder, sizes[folder], r["n"], r["lo"], r["hi"], r["a"], r["b"], single and not r["dead"])] if r["n"] else []
        # One file a run: narrow columns are read back for each file's figures.
        back = self.spark.read.schema(S.LOG).parquet(self.files.path(folder)).withColumn("file", F.col("_metadata.file_name"))
        found = back.groupBy("file").agg(*stats).where("n > 0").collect()
        out = []
        for i, r in enumerate(sorted(found, key=lambda r: bytes.fromhex(r["lo"]))):
            path = f"{folder}/{r['file']}"
            out.append(M.Run(num + i, path, sizes[path], r["n"], r["lo"], r["hi"], r["a"], r["b"], single and not r["dead"]))
        return out

    def _files(self, size: int) -> int:
        """Files of a run of level 0: of the target size, or smaller ones if that keeps more cores busy."""
        target = self.options.target_file_bytes
        return max(1, -(-size // target), min(self.spark.sparkContext.defaultParallelism, size * LEAST_SHARE // target))

    # Maintenance.

    @exclusive
    def flush(self) -> None:
        """Make one level-0 run of all deltas."""
        self._writable()
        self.sync()
        if not self.state.tail:
            return
        with self._sticky():
            state, num = self.state, self.state.next_num
            rows = self._clustered(self.read(state.tail), self._files(sum(r.size for r in state.tail)), replayed=True)
            (run,) = self._write_run(rows, num, whole=True)
            levels = ((*state.levels[0], run), *state.levels[1:])
            self.state = M.install(self.files, state.changed(next_num=num + 1, tail=(), levels=levels), state)
            self.counters["flushes"] += 1
            self.counters["flush_bytes"] += run.size

    def _clustered(self, rows: DataFrame, files: int, replayed: bool = False) -> DataFrame:
        """Rows in files of disjoint keys: ranges are of the key alone, so all versions of a key lie in one file, and what was
        replayed is collapsed there without a shuffle of its own."""
        dealt = rows.repartitionByRange(files, "key") if files > 1 else rows.coalesce(1)
        dealt = versions.dedupe_replay(dealt) if replayed else dealt
        return dealt.sortWithinPartitions("key", F.desc("seq"))

    @exclusive
    def compact(self) -> None:
        """Flush, then rewrite levels until none is due."""
        self.flush()
        while (level := compaction.pick(self.state, self.options)) is not None:
            self.compact_level(level)

    @exclusive
    def compact_level(self, level: int) -> None:
        """Merge a level's chosen runs with those of the next that they overlap, dropping what no snapshot can see.

        Runs of a level below 0 that overlap none and have nothing to drop change their level in the manifest alone.
        """
        self._writable()
        with self._sticky():
            state, num = self.state, self.state.next_num
            oldest = min(self.oldest_snapshot(), state.last_seq)
            mine, below = compaction.inputs(state, level, self.options, oldest)
            used = {r.num for r in (*mine, *below)}
            moved = level > 0 and not below and all(compaction.nothing_to_drop(mine, oldest))
            made = [replace(r, num=num + i) for i, r in enumerate(mine)] if moved else self._merged(level, mine, below, oldest)
            levels = [tuple(r for r in x if r.num not in used) for x in state.levels]
            levels[level + 1] = tuple(sorted((*levels[level + 1], *made), key=lambda r: bytes.fromhex(r.lo)))
            cursors = state.cursors | {str(level): max(bytes.fromhex(r.lo) for r in mine).hex()}
            self.state = M.install(self.files, state.changed(next_num=num + max(1, len(made)), levels=tuple(levels), cursors=cursors), state)
            self.counters["compactions"] += 1
            self.counters["compaction_bytes"] += 0 if moved else sum(r.size for r in made)

    def _merged(self, level: int, mine: list[M.Run], below: list[M.Run], oldest: int) -> list[M.Run]:
        """The runs of the next level that a level's runs and those below them become."""
        state, runs = self.state, [*mine, *below]
        log = self.read(runs)
        kept = versions.latest_versions(log, oldest)
        if oldest < state.last_seq:  # some snapshot needs older versions: all that came after it stay
            kept = log.where(F.col("seq") > oldest).unionByName(kept)
        deeper = versions.merged_ranges(compaction.deeper_ranges(state, level + 1, *compaction.key_range(runs)))
        if deeper:
            kept = versions.drop_covered_tombstones(kept, oldest, self.spark.createDataFrame(deeper, "lo binary, hi binary"))
        else:
            kept = versions.drop_tombstones(kept, oldest)
        size, target = sum(r.size for r in runs), self.options.target_file_bytes
        files = 1 if size <= target else max(2, -(-min(size, kept_bytes(log, oldest)) // target))  # one: read by one task
        made = self._write_run(self._clustered(kept, files, oldest < state.last_seq), state.next_num, whole=False, single=oldest >= state.last_seq)
        return made if deeper else [replace(r, settled=oldest) for r in made]

    @exclusive
    def vacuum(self) -> list[str]:
        """Delete runs and manifests that neither the newest manifest nor a pinned one needs; the names that went."""
        self._writable()
        wanted = {self.state.version, *(p["version"] for p in self.pins())}
        live = {r.path for v in wanted for r in M.load(self.files, v).runs()}
        gone = self.unused(live)
        kept = M.needed(self.files, wanted)
        gone += [M.name_of(v) for v in M.versions(self.files) if v not in kept]
        for n in gone:
            self.files.delete(n)
        return gone

    def unused(self, live: set[str]) -> list[str]:
        """Run folders that no live path lies in, and single files of the others; what a writer left staged."""
        there = self.files.list(RUNS)
        used = {folder_of(p) for p in live}
        dead = {folder_of(n) for n in there} - used
        return sorted(dead) + [n for n in there if folder_of(n) in used and n not in live and folder_of(n) not in live]

    def close(self) -> None:
        """Give the lease up; deltas stay deltas."""
        self._open()
        if self.handles:
            raise errors.OpenHandlesError(f"{self.handles} open")
        with self._mutex:
            self.sync()
            self.closed = True
            if self._ticker:
                self._ticker.cancel()
        self.files.delete(LOCK)

    # State and checks.

    def manifest(self) -> DataFrame:
        """(level, file_num, path, size, entries, lo, hi, min_seq, max_seq); unflushed deltas are level -1."""
        rows = [(-1, r) for r in self.state.tail] + [(n, r) for n, level in enumerate(self.state.levels) for r in level]
        cols = "level int, file_num long, path string, size long, entries long, lo string, hi string, min_seq long, max_seq long"
        return self.spark.createDataFrame([(n, r.num, r.path, r.size, r.entries, r.lo, r.hi, r.min_seq, r.max_seq) for n, r in rows], cols)

    def metrics(self) -> DataFrame:
        """(name, value): counters, and tables and bytes of each level; also after close()."""
        rows = sorted(self.counters.items()) + [(f"level_{n}_{k}", v) for n, x in enumerate(self.state.levels) for k, v in (("tables", len(x)), ("bytes", sum(r.size for r in x)))]
        return self.spark.createDataFrame(rows, "name string, value long")

    def amplification(self) -> DataFrame:
        """(write_amp, space_amp) of this handle: bytes written against the users' bytes, and bytes of runs against those of live rows."""
        row = self.view().scan().agg(F.sum(F.octet_length("key") + F.octet_length("value")).cast("long").alias("live"))
        c, size = self.counters, sum(r.size for r in self.state.runs())
        user, live = F.lit(c["user_bytes"]), F.col("live")
        out = storage.amplification(user, F.lit(c["log_bytes"]), F.lit(c["flush_bytes"]), F.lit(c["compaction_bytes"]), live)
        return row.select(F.when(user > 0, out["write_amp"]).alias("write_amp"), (F.lit(size) / live).alias("space_amp"))

    def check(self, strict: bool = True) -> DataFrame:
        """Violations (tag, detail) of the store's invariants; none on a sound store.

        Without `strict`, what a crash may leave (orphans, staged and temporary files) is no violation.
        """
        there, state, rows = self.files.list(RUNS), self.state, []
        sizes, known = sizes_by_path(there), {r.path for r in state.runs()}
        rows += [("missing", r.path) for r in state.runs() if sizes.get(r.path) != r.size]
        if strict:
            rows += [("orphan", n) for n in there if n not in known and folder_of(n) not in known]
            rows += [("temporary", n) for f in (M.FOLDER, PINS, STAGE) for n in self.files.list(f) if f == STAGE or n.endswith(".tmp")]
        rows += [("number", r.path) for r in state.runs() if r.num >= state.next_num]
        rows += [("last_seq", r.path) for r in state.runs() if r.max_seq > state.last_seq]
        for level in state.levels[1:]:
            ordered = sorted(level, key=lambda r: bytes.fromhex(r.lo))
            rows += [("disjoint", a.path) for a, b in zip(ordered, ordered[1:]) if bytes.fromhex(b.lo) <= bytes.fromhex(a.hi)]
        out = self.spark.createDataFrame(rows, "tag string, detail string")
        runs = [r for r in state.runs() if r.path in sizes]
        return out.unionByName(self._content(runs, there)) if runs else out

    def _content(self, runs: list[M.Run], there: dict[str, int]) -> DataFrame:
        """Violations of what runs hold, by one scan over all: an unreadable file is reported, not raised."""
        of = {r.path: r for r in runs}
        files = [(n, p) for n in there for p in (n, folder_of(n)) if p in of and n.endswith(".parquet")]
        rows = self.spark.read.schema(S.LOG).option("ignoreCorruptFiles", "true").parquet(*[self.files.path(n) for n, _ in files])
        name = F.regexp_extract(F.col("_metadata.file_path"), f"{RUNS}/[^/]+/[^/]+$", 0)
        rows = rows.select("key", "seq", "kind", name.alias("file"), F.col("_metadata.row_index").alias("position"))
        before = Window.partitionBy("file").orderBy("position")  # a file has a bounded size
        rows = rows.withColumns({"last": F.lag("key").over(before), "last_seq": F.lag("seq").over(before)})
        same = F.col("last") == F.col("key")
        stats = rows.groupBy("file").agg(
            F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.max("seq").alias("seq"), F.count_if(F.col("kind") != S.SET).alias("dead"),
            F.count_if((F.col("last") > F.col("key")) | (same & (F.col("last_seq") <= F.col("seq")))).alias("unordered"), F.count_if(same).alias("again"),
        )
        held = self.spark.createDataFrame(files, "file string, path string").join(stats, "file", "left")
        held = held.groupBy("path").agg(
            F.sum("n").alias("n"), F.hex(F.min("lo")).alias("lo"), F.hex(F.max("hi")).alias("hi"), F.max("seq").alias("seq"),
            F.sum("dead").alias("dead"), F.sum("unordered").alias("unordered"), F.sum("again").alias("again"),
        )
        told = [(r.path, r.entries, r.lo.upper(), r.hi.upper(), r.max_seq, r.plain) for r in runs]
        both = held.join(self.spark.createDataFrame(told, "path string, entries long, low string, high string, last long, plain boolean"), "path")
        like = (F.col("n") == F.col("entries")) & (F.col("lo") == F.col("low")) & (F.col("hi") == F.col("high")) & (F.col("seq") == F.col("last"))
        like = like & ~(F.col("plain") & ((F.col("dead") > 0) | (F.col("again") > 0)))
        tags = F.array(F.when(~F.coalesce(like, F.lit(False)), "content"), F.when(F.col("unordered") > 0, "order"))
        return both.select(F.explode(F.array_compact(tags)).alias("tag"), F.col("path").alias("detail"))

    def _open(self) -> None:
        if self.closed:
            raise errors.ClosedError("store")

    def _writable(self) -> None:
        self._open()
        if self.failure:
            raise errors.StoreFailedError("an earlier write failed") from self.failure

    def _sticky(self):
        return _Sticky(self)


def kept_bytes(log: DataFrame, oldest: int) -> int:
    """About the bytes, as they stand before they are encoded, of what a compaction keeps of a log: all that came after the
    oldest snapshot and one version of each key before. It decides the number of files alone, so keys are counted with HyperLogLog."""
    late, size = F.col("seq") > oldest, F.octet_length("key") + 9 + F.coalesce(F.octet_length("value"), F.lit(0))
    told = log.agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.count_if(late).alias("late"), F.approx_count_distinct(F.when(~late, F.col("key"))).alias("keys")).first()
    return (told["late"] + told["keys"]) * told["bytes"] // told["n"]


def folder_of(path: str) -> str:
    """The run folder that a file below it, or the folder itself, belongs to."""
    return "/".join(path.split("/")[:2])


def sizes_by_path(files: dict[str, int]) -> dict[str, int]:
    """Bytes of each Parquet file, and of each run folder's together."""
    out: Counter = Counter()
    for n, size in files.items():
        if n.endswith(".parquet"):
            out[n] += size
            out[folder_of(n)] += size
    return out


class _Sticky:
    """A failure inside makes the store read-only: whether a commit took place may be unknown until it is opened again."""

    def __init__(self, store: Store):
        self.store = store

    def __enter__(self):
        return self

    def __exit__(self, kind, error, trace):
        if isinstance(error, Exception):
            self.store.failure = error
        return False


def open_store(spark: SparkSession, path: str, options: S.Options | None = None, files=None, clock=time.monotonic) -> Store:
    """Open or create the store below a path. A run that no manifest names was never committed; it is removed."""
    store = Store(spark, path, options, files, clock)
    for n in [*store.unused({r.path for r in store.state.runs()}), STAGE]:
        store.files.delete(n)
    return store
