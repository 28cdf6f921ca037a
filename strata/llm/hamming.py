"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each component above zero. Codes are cut into segments of 16 bits. Equal codes are one
entry with their least ids, as many as can matter, so copies cost nothing. Entries are dealt by hash into blocks of
bounded size and distinct query codes into blocks too; every block of queries meets every block of entries, keyed by
the latter. In a pair of blocks an index by segment is searched with growing radii, one segment at a time: after all m
segments up to radius r - 1, and a of them at r, every code within m * r + a - 1 bits has been met. A query ends as soon as
its k-th verified distance is within that bound, so ties are complete too. The best of all blocks are then merged.

An id may own many codes: a query's own id is left out inside the search, so it asks for no more than k others.

Nulls and edges: rows with a null vector or id are in no result; null components count as zero; shorter vectors are padded with
zero bits; ties go to the smaller id; rows of one id and one code count once; a row is no neighbour of its own id, and an id of
several codes is asked and found by each; fewer than k others give fewer rows; an empty table gives an empty result; ids may
be numbers or text, and text that is no whole number asks nothing.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import checkpoints, picked

SEGMENT = 16
K, EVERY = 10, 20
#: Entries and queries in a block.
ENTRIES, QUERIES = 50_000, 128

#: For each radius, the 16-bit masks of that many ones.
MASKS = [np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT), r)], dtype=np.uint16) for r in range(SEGMENT + 1)]


def with_codes(rows: DataFrame, bits: int) -> DataFrame:
    """(id, code) from (vec_id, embedding); a code is its segments' little-endian bytes."""
    width = -(-bits // SEGMENT) * SEGMENT
    schema = rows.select(F.col("vec_id").alias("id"), F.lit(b"").alias("code")).schema

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            flat = pc.fill_null(pc.greater(lists.flatten(), 0), False).to_numpy(zero_copy_only=False)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.zeros((b.num_rows, width), dtype=bool)
            row = np.repeat(np.arange(b.num_rows), size)
            out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
            packed = np.packbits(out, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in packed], pa.binary())], names=["id", "code"])

    return rows.mapInArrow(run, schema)


class Index:
    """Entries sorted by the value of each segment."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes  # entries, segments
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(codes.shape[1])]
        self.first = [np.searchsorted(codes[o, s], np.arange((1 << SEGMENT) + 1)) for s, o in enumerate(self.order)]

    def at(self, segment: int, value: int, radius: int) -> np.ndarray:
        """Entries whose segment differs from the value in exactly `radius` bits."""
        spots = MASKS[radius] ^ np.uint16(value)
        a, n = self.first[segment][spots], self.first[segment][spots.astype(np.int64) + 1]
        n = n - a
        hit = n > 0
        a, n = a[hit], n[hit]
        if not len(a):
            return np.zeros(0, dtype=np.int64)
        return self.order[segment][np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]

    def nearest(self, code: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(entries, distances) of all entries up to the distance at which their weights, summed, reach k."""
        m = len(code)
        seen = np.zeros(len(self.codes), dtype=bool)
        inside = np.zeros(m * SEGMENT + 1, dtype=np.int64)  # weight verified at each distance
        found, apart = [], []
        for r in range(SEGMENT + 1):
            for s in range(m):
                new = self.at(s, int(code[s]), r)
                new = new[~seen[new]]
                if len(new):
                    seen[new] = True
                    d = np.bitwise_count(self.codes[new] ^ code).sum(axis=1, dtype=np.int64)
                    found.append(new)
                    apart.append(d)
                    inside += np.bincount(d, weights=weight[new], minlength=len(inside)).astype(np.int64)
                covered = m * r + s
                if inside[: covered + 1].sum() >= k:
                    break
            else:
                continue
            break
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        e, d = np.concatenate(found), np.concatenate(apart)
        reach = np.flatnonzero(np.cumsum(inside) >= k)
        keep = d <= (reach[0] if len(reach) else len(inside))
        return e[keep], d[keep]


def nearest_ids(codes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(asker, code, distance, id): for each asked (id, code) its k nearest rows (id, code) of other ids, and ties in each block."""
    spark = codes.sparkSession
    least = Window.partitionBy("code").orderBy("id")
    # A code's k + 1 least ids: without the asker's own, k are left.
    entries = codes.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = entries.checkpoint()
    blocks = max(1, -(-entries.count() // ENTRIES))
    dealt = entries.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int"))
    parts = max(1, -(-asked.count() // QUERIES))
    queries = asked.withColumn("part", F.pmod(F.xxhash64("id", "code"), F.lit(parts)).cast("int"))
    # Blocks as packed rows, dealt by the entries' block and a lane of queries: a block of entries is copied to each
    # lane, so lanes are as few as keep all cores busy, or as hold 200 blocks of queries.
    lanes = max(-(-parts // 200), min(parts, -(-2 * spark.sparkContext.defaultParallelism // blocks)))
    shelf = dealt.groupBy("block").agg(F.collect_list(F.struct("code", "ids")).alias("entries"))
    shelf = shelf.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    trays = queries.groupBy("part").agg(F.collect_list(F.struct("id", "code")).alias("asked"))
    trays = trays.select("asked", (F.col("part") % lanes).alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt_out = lambda df: df.repartition(lanes * blocks, "block", "lane")
    pairs = dealt_out(trays).join(dealt_out(shelf).hint("shuffle_hash"), ["block", "lane"])
    schema = asked.select(F.col("id").alias("asker"), "code", F.lit(0).alias("distance"), "id").schema

    def search(batches):
        last = None
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                column = lambda n: row.column(row.schema.get_field_index(n))  # noqa: E731, B023
                block = column("block")[0].as_py()
                if block != last:
                    held, last = column("entries").flatten(), block
                    raw, ids = held.field("code").to_pylist(), held.field("ids").to_pylist()
                    index = Index(np.frombuffer(b"".join(raw), dtype=np.uint16).reshape(len(raw), -1))
                    counts, owned = np.array([len(x) for x in ids]), {}
                    for e, x in enumerate(ids):
                        for v in x:
                            owned.setdefault(v, []).append(e)
                out: list[tuple] = []
                for q in column("asked").flatten().to_pylist():
                    weight = counts
                    if q["id"] in owned:
                        weight = counts.copy()
                        weight[owned[q["id"]]] -= 1
                    e, d = index.nearest(np.frombuffer(q["code"], dtype=np.uint16), weight, k)
                    near = sorted((int(y), v) for x, y in zip(e, d) for v in ids[x] if v != q["id"])[:k]
                    out += [(q["id"], q["code"], y, v) for y, v in near]
                columns = list(zip(*out)) or [()] * 4
                kind = held.field("ids").type.value_type
                arrays = [pa.array(c, t) for c, t in zip(columns, (kind, pa.binary(), pa.int32(), kind))]
                yield pa.RecordBatch.from_arrays(arrays, names=["asker", "code", "distance", "id"])

    return pairs.select("block", "asked", "entries").mapInArrow(search, schema)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest other rows of each row whose id is divisible by `every`."""
    checkpoints(vectors.sparkSession)
    rows = picked(vectors, "vec_id", "embedding").where("vec_id is not null and embedding is not null")
    bits = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    codes = with_codes(rows, bits).distinct().checkpoint()
    asked = codes.where(F.col("id").try_cast("long") % every == 0)
    best = Window.partitionBy("asker", "code").orderBy("distance", "id")
    near = nearest_ids(codes, asked, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return near.select(F.col("asker").alias("vec_id"), "rank", F.col("id").alias("neighbour_id"), "distance")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: coalesce(x, 0) > 0) AS bits FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
d AS (SELECT q.vec_id, b.vec_id AS neighbour_id, CAST(list_sum(list_transform(list_zip(q.bits, b.bits), lambda x: CASE WHEN x[1] <> x[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank, neighbour_id, distance FROM d) WHERE rank <= 10
"""
