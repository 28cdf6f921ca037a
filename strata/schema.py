"""The mutation log's schema, limits and option defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T

SET, DELETE = 1, 2
MAX_SEQ = (1 << 56) - 1
MAX_KEY_BYTES = 65_536
MAX_VALUE_BYTES = 4 << 20
MAX_BATCH_BYTES = 64 << 20
MAX_BATCH_ENTRIES = 1_000_000
BATCH_HEADER_BYTES = 12
#: Bytes that an entry occupies in memory beside its key, trailer and value.
ENTRY_OVERHEAD_BYTES, TRAILER_BYTES = 48, 8
LEVELS = 7

LOG = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("seq", T.LongType()),
    T.StructField("kind", T.ByteType()),
    T.StructField("value", T.BinaryType()),
])

SYNC_ALWAYS, SYNC_OFF, SYNC_INTERVAL = 0, 1, 2


@dataclass(frozen=True)
class Options:
    """Store options; any number <= 0 means its default. Sizes are those of Parquet files and row groups, not of an engine
    in one process: block_bytes is a row group's, bloom_bits_per_key sets the rate of false positives of the key's filter."""

    memtable_bytes: int = 64 << 20
    block_bytes: int = 8 << 20
    bloom_bits_per_key: int = 10
    l0_trigger: int = 4
    l0_stall: int = 12
    base_level_bytes: int = 1 << 30
    target_file_bytes: int = 128 << 20
    sync_interval_ms: int = 100
    sync: int = SYNC_ALWAYS
    auto_compact: bool = True

    def resolved(self) -> Options:
        known = {f.name: f.default for f in fields(self)}
        mine = {k: getattr(self, k) for k in known}
        free = ("sync", "auto_compact")
        return Options(**{k: v if k in free or v > 0 else known[k] for k, v in mine.items()})
