"""SimHash near-duplicates: fingerprints, a byte-position inverted index with count filtering, and components.

A fingerprint has 8 bytes. Two that differ in at most 4 bits share at least 4 bytes at their positions. Posting lists
of one byte each would hold a 256th of all fingerprints, so the index is keyed by sets of byte positions instead: a
family of 20 sets of three positions of which every four positions contain one (or all 70 sets of four, where there
are more than `wide_from` fingerprints, by default 2^26; both find the same links), so a pair sharing four bytes meets in a
list of 1 / 2^24 (or 2^32) of them. Within a list the shared positional bytes of a pair are tallied, pairs with at least 4 are
kept, and their bits are compared. Equal fingerprints are one entry. A list is searched as a graph: each fingerprint
reached is compared with those not reached yet, and only the edge that reaches one is emitted, so a list of near
copies costs about its length in edges and no pair list is made. A list of more than `longest` entries isn't held by one
task: it is dealt into blocks, and every two of its blocks meet in a task of their own; no list is cut.

Components come from alternating large-star and small-star rounds over distinct fingerprints, each written by
checkpoint(), until nothing changes; nothing is collected but two numbers a round. Least ids reach the fingerprints of a
component over salted keys; rows of one fingerprint meet it in a join that adaptive execution may split.

Nulls and edges: a null text is empty; texts without words have fingerprint zero and link like any other; texts of
fewer than four words are one shingle; a null doc_id takes its component but names none; repeated rows stay.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import checkpoints, packed, picked, slices, unpacked

WORDS, SEED, MOST_BITS, BYTES = 4, 42, 4, 8
LEAST_SHARED = BYTES - MOST_BITS
#: Distinct fingerprints beyond which lists are keyed by four bytes instead of three.
WIDE_FROM = 1 << 26
#: Entries of a posting list that one task holds, and salts of a component's key.
LONGEST, SALTS = 1 << 16, 16
EDGE, ENTRY, END = 0, 1, 2


def position_sets(width: int) -> list[tuple[int, ...]]:
    """Sets of `width` byte positions such that any LEAST_SHARED positions contain one.

    For three: deal the positions into three groups in a circle; take sets inside a group, and those with two in a
    group and one in the next. Of any four positions, three lie like that.
    """
    if width == LEAST_SHARED:
        return list(combinations(range(BYTES), width))
    group = [i % 3 for i in range(BYTES)]
    out = []
    for s in combinations(range(BYTES), 3):
        g = [group[i] for i in s]
        pair = next((x for x in g if g.count(x) >= 2), None)
        if pair is not None and (g.count(pair) == 3 or next(x for x in g if x != pair) == (pair + 1) % 3):
            out.append(s)
    return out


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint, unsigned: a bit is set if more than half of the shingle hashes set it."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(words) - WORDS + 1)
    spans = zip(starts[:k].tolist(), ends[min(WORDS, len(words)) - 1 :].tolist())
    h = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans], dtype=">u8")
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, k, 4096):
        votes += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > k).tobytes(), "big")


def with_fingerprint(rows: DataFrame) -> DataFrame:
    """Add `fp`, the fingerprint as a signed long, for `text`; the text goes."""
    at, keep = rows.columns.index("text"), [n for n in rows.columns if n != "text"]
    schema = rows.drop("text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(t) for t in b.column(at).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in keep), pa.array(fps)], names=[*keep, "fp"])

    return rows.mapInArrow(run, schema)


def list_keys(fp: Column, width: int) -> Column:
    """The keys of the posting lists of a fingerprint: the set's number and the bytes at its positions."""
    def key(n: int, positions: tuple[int, ...]) -> Column:
        out = F.lit(n).cast("long")
        for p in positions:
            out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(0xFF))
        return out

    return F.array(*[key(n, s) for n, s in enumerate(position_sets(width))])


def search_list(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the fingerprints of a list along links: a graph search that compares each with those not reached yet."""
    edges, rest = [], fps
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            diff = rest ^ x
            shared = (diff.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)  # the tally of positional bytes
            near = np.flatnonzero(shared >= LEAST_SHARED)
            near = near[np.bitwise_count(diff[near]) <= MOST_BITS]
            if len(near):
                found = rest[near]
                edges += [(int(x), int(y)) for y in found]
                frontier += list(found)
                rest = np.delete(rest, near)
    return edges


def linked(fps: np.ndarray) -> np.ndarray:
    """The edges of a list of fingerprints, given signed and perhaps repeated, as two columns."""
    edges = search_list(np.unique(fps).view(np.uint64)) if len(fps) > 1 else []
    return np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)


def parts_of(batches, names: tuple[str, ...]):
    """(first, key, columns) of the runs of equal keys in batches sorted by the first of `names`; a run that spans batches
    comes in parts, of which only the first says so. Runs of one row inside a batch, most of all, are left out."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
        keys = columns[0]
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(cuts, len(keys)))
        size[[0, -1]] += 1  # these may go on in other batches
        for r in np.flatnonzero(size > 1):
            i, j = cuts[r], cuts[r + 1] if r + 1 < len(cuts) else len(keys)
            yield r > 0 or keys[i] != last, int(keys[i]), [c[i:j] for c in columns[1:]]
        last = keys[-1]


def rows_of(kind: int, u, v) -> pa.RecordBatch:
    u, v = (np.ascontiguousarray(x, dtype=np.int64) for x in (u, v))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u), pa.array(v)], names=["kind", "u", "v"])


def search_lists(longest: int):
    """From batches (key, fp) sorted by both: EDGE rows (u, v) of each posting list; of a list longer than `longest`
    instead its ENTRY rows (key, fp) as they come, and an END row (key, entries)."""
    def run(batches):
        key, held, size, ready = None, [], 0, 0
        edges: list[np.ndarray] = []

        def finish():
            nonlocal ready
            if size > longest:
                return rows_of(END, [key], [size])
            if size > 1:
                edges.append(linked(np.concatenate(held)))
                ready += len(edges[-1])
            return None

        for first, k, (fps,) in parts_of(batches, ("key", "fp")):
            if first:
                if (end := finish()) is not None:
                    yield end
                key, held, size = k, [], 0
            size += len(fps)
            held.append(fps)
            if size > longest:
                yield from (rows_of(ENTRY, np.full(len(h), key), h) for h in held)
                held = []
            if ready > 10_000:
                yield rows_of(EDGE, *np.concatenate(edges).T)
                edges.clear()
                ready = 0
        if key is not None and (end := finish()) is not None:
            yield end
        if edges:
            yield rows_of(EDGE, *np.concatenate(edges).T)

    return run


def search_blocks(batches):
    """EDGE rows of each pair of blocks, from batches (pair, fp) sorted by pair."""
    held: list[np.ndarray] = []
    for first, _, (fps,) in parts_of(batches, ("pair", "fp")):
        if first and held:
            yield rows_of(EDGE, *linked(np.concatenate(held)).T)
            held = []
        held.append(fps)
    if held:
        yield rows_of(EDGE, *linked(np.concatenate(held)).T)


def links(prints: DataFrame, count: int, longest: int = LONGEST, wide_from: int = WIDE_FROM) -> DataFrame:
    """Distinct edges (u, v) that join linked fingerprints, from rows (fp) without repeats."""
    checkpoints(prints.sparkSession)
    width, schema = 3 if count <= wide_from else LEAST_SHARED, "kind int, u long, v long"
    lists = prints.select(F.explode(list_keys(F.col("fp"), width)).alias("key"), "fp")
    found = lists.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(search_lists(longest), schema).checkpoint()
    # One row a list of more than `longest` entries: at most their number / longest, so it may be broadcast.
    ends = found.where(F.col("kind") == END).select(F.col("u").alias("key"), F.ceil(F.col("v") / (longest / 2)).cast("int").alias("blocks"))
    entries = found.where(F.col("kind") == ENTRY).select(F.col("u").alias("key"), F.col("v").alias("fp"))
    dealt = entries.join(F.broadcast(ends), "key").withColumn("mine", F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int"))
    other = dealt.select("key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # A hash names the pair of blocks; pairs that share one by chance are searched as one, which loses nothing.
    pairs = other.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("pair"), "fp")
    more = pairs.repartition("pair").sortWithinPartitions("pair").mapInArrow(search_blocks, schema)
    edges = found.where(F.col("kind") == EDGE).unionByName(more)
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u > v), root the least node reachable."""
    spark = edges.sparkSession
    checkpoints(spark)
    mark = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 40)), F.lit(0))).first())
    edges = edges.checkpoint()
    now = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        to_least = lambda c: F.struct(F.col(c).alias("u"), F.col("m").alias("v"))
        turned = star.join(low, "u").select(F.explode(F.array(to_least("v"), to_least("u"))).alias("e"))
        turned = turned.select("e.*").where("u != v").distinct()
        edges, before = turned.checkpoint(), now
        now = mark(edges)
        if now == before:
            break
    nodes = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def grouped(rows: DataFrame, longest: int = LONGEST, wide_from: int = WIDE_FROM) -> DataFrame:
    """Add `fp` and `component_id`, the least doc_id of the rows linked, to rows (doc_id, text, ...); the text goes."""
    checkpoints(rows.sparkSession)
    marked = with_fingerprint(rows).checkpoint()  # narrow: texts stay behind
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("first")).checkpoint()
    roots = components(links(prints.select("fp"), prints.count(), longest, wide_from))
    # Only linked fingerprints have a root; many may share one, so they meet their component's least id over salts.
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
    linked = prints.join(roots, prints["fp"] == roots["node"]).select("fp", "first", "root").withColumn("salt", salt)
    least = linked.groupBy("root", "salt").agg(F.min("first").alias("least")).groupBy("root").agg(F.min("least").alias("least"))
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = linked.join(spread, ["root", "salt"]).select("fp", "root", "least")
    component = F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")
    whole = prints.join(known, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), component)
    return marked.join(whole.checkpoint(), "fp")  # alone in its stage: a join that adaptive execution can split


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each document."""
    out = grouped(picked(docs, "doc_id", "text"), **options)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, that of the least doc_id (a null id only where there is no other), with its own columns.

    Survivors are chosen among narrow rows, named by a digest of id and text; the documents meet them by that digest
    and are shuffled once. Rows equal in both are one.
    """
    name = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))
    first = Window.partitionBy("root").orderBy(F.asc_nulls_last("doc_id"), "name")
    narrow = grouped(picked(docs, "doc_id", "text").withColumn("name", name), **options)
    chosen = narrow.withColumn("rank", F.row_number().over(first)).where("rank = 1").select("name")
    rows = packed(docs, "doc_id", "text").select("row", name.alias("name")).join(chosen, "name")
    one = Window.partitionBy("name").orderBy(F.lit(1))
    return unpacked(rows.withColumn("rank", F.row_number().over(one)).where("rank = 1"), docs)
