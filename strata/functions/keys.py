"""Key codecs, validation predicates and encoded sizes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata import schema as S


def padded_key(number: Column, width: int = 16) -> Column:
    """Zero-padded decimal text: its bytewise order is the numeric order of non-negative numbers."""
    return F.lpad(number.cast("string"), width, "0")


def big_endian_key(number: Column) -> Column:
    """Eight big-endian bytes of a non-negative long."""
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def valid_key(key: Column) -> Column:
    """True for 1 to 64 KiB; null keys are invalid."""
    return F.coalesce(F.octet_length(key).between(1, S.MAX_KEY_BYTES), F.lit(False))


def valid_value(kind: Column, value: Column) -> Column:
    """True for values up to 4 MiB; a null value counts as empty, a tombstone's is ignored."""
    return (kind == S.DELETE) | (F.coalesce(F.octet_length(value), F.lit(0)) <= S.MAX_VALUE_BYTES)


def varint_bytes(n: Column) -> Column:
    """Bytes of an unsigned LEB128 number below 2^35."""
    steps = [F.when(n < (1 << (7 * k)), F.lit(k)) for k in range(1, 5)]
    return F.coalesce(*steps, F.lit(5))


def entry_bytes(kind: Column, key: Column, value: Column) -> Column:
    """Encoded size of one batch entry; tombstones carry no value."""
    k, v = F.octet_length(key), F.coalesce(F.octet_length(value), F.lit(0))
    return (1 + varint_bytes(k) + k + F.when(kind == S.SET, varint_bytes(v) + v).otherwise(0)).cast("long")


def memory_bytes(key: Column, value: Column) -> Column:
    """Bytes an entry retains before it is flushed."""
    return (F.octet_length(key) + S.TRAILER_BYTES + F.coalesce(F.octet_length(value), F.lit(0)) + S.ENTRY_OVERHEAD_BYTES).cast("long")
