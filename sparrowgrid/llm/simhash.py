"""Operator 3: SimHash near-duplicates through pigeonhole blocks.

The fingerprint of 64 bits with a small radius finds all but copies with the same majority bits.
``similar_links`` serves the rest, near copies whose shingles agree to a share of ``SIMILAR`` or
more: blocks of a wider fingerprint (minima of the shingles' hashes) are joined in the same way,
and pairs that share one are verified by their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, connected_components, cut, labels_of, marked, marks, slot, slots_of, table

SHINGLE = 4
BITS = 4
#: Rows of one bucket that one task compares; larger buckets are dealt as pairs of tiles.
TILE = 4096
#: Similarity of shingle sets, and blocks of so many minima each that candidates must share one of.
#: A pair of similarity 0.8 shares none with a probability of (1 - 0.8^4)^20 = 0.00003.
SIMILAR = 0.8
SIMILAR_SHINGLE = 5
BLOCKS = 20
MINIMA = 4
SIMILAR_TILE = 2048
_SHIPPED = 8 << 20
_ODD = np.random.default_rng(3).integers(0, 1 << 63, BLOCKS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of all shingles of lowered words, repeats included; fewer words are one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[i:j], 42) for i, j in zip(starts, ends[shingle - 1 :].tolist())])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def majority(h: np.ndarray) -> int:
    """Bits that over half the hashes have; none: 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the hashes of all shingles; no words: 0."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, fp), one for each row of ``docs``: ``row`` hashes the text, fp is the
    fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "row", "fp"])

    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.col("text").cast("binary"))
    return docs.mapInArrow(run, "doc_id long, row long, fp long")


def plan_blocks(n: int, bits: int, fill: int = 64) -> tuple[list[int], int]:
    """Edges of the blocks, and how many blocks a key joins.

    Of ``m`` blocks at least ``m - bits`` agree within ``bits`` differences, so every pair
    shares some key of that many blocks, whatever ``m`` is. ``m`` only follows the number of
    fingerprints, to keep random buckets near ``fill`` rows.
    """
    for m in range(bits + 1, 2 * bits + 1):
        if n / 2 ** (64 * (m - bits) / m) <= fill:
            break
    return [round(64 * i / m) for i in range(m + 1)], m - bits


def link_sorted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Edges among rows that share a bucket, as a star per component of each bucket.

    Batches hold (bucket, tile, side, fp, rep) sorted by bucket and tile. Inside a bucket the
    rows are compared at offsets 1, 2, ... at once for all buckets; side 0 is compared with
    everything, sides 1 and 2 only with each other.
    """
    rest: tuple[np.ndarray, ...] | None = None

    def work(cols):
        bucket, tile, side, fp, rep = cols
        n, fp = len(fp), fp.view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
        new = np.ones(n, bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1])
        group = np.cumsum(new)
        lab, at, off = np.arange(n), np.arange(n), 1
        while True:
            at = at[at + off < n]
            at = at[group[at + off] == group[at]]
            if not len(at):
                break
            near = np.bitwise_count(fp[at] ^ fp[at + off]) <= bits
            near &= (side[at] == 0) | (side[at] != side[at + off])
            if near.any():
                lab = labels_of(n, at[near], at[near] + off, lab)
            off += 1
        moved = np.flatnonzero(lab != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[lab[moved]])], ["a", "b"])

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        if not len(cols[0]):
            continue
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        whole = int(np.argmax(last))
        rest = tuple(c[whole:] for c in cols)
        if whole:
            yield work([c[:whole] for c in cols])
    if rest is not None:
        yield work(rest)


def _tiles() -> F.Column:
    """Pairs of tiles that a row of tile ``mine`` of ``t`` meets others in, and the side it stands on."""
    return F.transform(
        F.sequence(F.lit(0), F.col("t") - 1),
        lambda o: F.struct(
            (F.least("mine", o) * F.col("t") + F.greatest("mine", o)).cast("long").alias("tile"),
            F.when(o == F.col("mine"), 0).when(F.col("mine") < o, 1).otherwise(2).alias("side"),
        ),
    )


def hamming_links(reps: DataFrame, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """(a, b): edges that connect all (fp, rep) rows within ``bits`` of each other.

    ``reps`` has one row per different fingerprint. Each row goes to one bucket per choice of
    blocks. A bucket above ``tile`` rows is dealt to all pairs of its tiles, so no task holds
    more than two tiles of it; nothing is capped. Buckets of one row are not shipped to Python.
    """
    edges, take = plan_blocks(reps.count(), bits)
    spans = list(zip(edges, edges[1:]))

    def key(i: int, chosen) -> F.Column:
        mask = sum(((1 << (hi - lo)) - 1) << lo for lo, hi in chosen)
        return F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))

    keys = [key(i, chosen) for i, chosen in enumerate(combinations(spans, take))]
    rows = reps.select("fp", "rep", F.explode(F.array(*keys)).alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(full, "bucket").withColumn("t", F.ceil(F.col("n") / tile).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("t")).cast("int"))
    dealt = (
        rows.select("bucket", F.explode(_tiles()).alias("o"), "fp", "rep")
        .select("bucket", "o.tile", "o.side", "fp", "rep")
        .repartition("bucket", "tile")
        .sortWithinPartitions("bucket", "tile")
    )
    return dealt.mapInArrow(lambda it: link_sorted(it, bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, row, fp, root, component_id), one for each row of ``docs``; ``row`` hashes its text.

    Documents whose fingerprints differ in at most ``bits`` bits are linked; component_id is
    the smallest doc_id reachable. The fingerprint is the node of the graph (``root`` is the
    smallest of a component), so exact copies collapse before any comparison, a group of
    thousands of copies costs one row, and different texts under one doc_id stay apart.

    Nulls: a null text has no words (fingerprint 0, which links like any other); a null
    doc_id links and bridges like any other but never names a component, unless that has no
    other id (then null). Repeated doc_ids stay separate rows. Empty table: empty result.
    """
    fps = cut(fingerprints(docs, shingle))
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = connected_components(hamming_links(reps.select("fp", F.col("fp").alias("rep")), bits))
    rooted = reps.join(comp, reps.fp == comp.node, "left").select(F.col("fp").alias("f"), F.coalesce("component", "fp").alias("root"), "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = rooted.select("f", "root").join(named, "root")
    return fps.join(rooted, F.col("fp") == F.col("f")).select("doc_id", "row", "fp", "root", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of ``docs`` for each component, all columns.

    It is the row of the smallest doc_id; a null doc_id represents only components that no other
    id has. Among rows that share that id, the smallest hash of the text decides, and of rows
    alike in both any one stays. The text is shuffled once, by (doc_id, hash).
    """
    groups = near_duplicates(docs, shingle, bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    best = groups.groupBy("root").agg(first.alias("first"))
    best = best.select(F.coalesce("first.doc_id", F.lit(0)).alias("_id"), F.xxhash64("first.row", "first.none").alias("_row"))
    own = F.xxhash64(F.xxhash64("text"), F.col("doc_id").isNull())
    rows = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_row": own})
    return rows.join(best, ["_id", "_row"], "left_semi").dropDuplicates(["_id", "_row"]).select(*docs.columns)


def blocks(h: np.ndarray) -> np.ndarray:
    """BLOCKS keys of a set of shingles, each made of MINIMA minima; a set without shingles has none."""
    if not len(h):
        return np.zeros(0, np.int64)
    low = np.full(len(_ODD), ~np.uint64(0))
    for at in range(0, len(h), 16384):
        low = np.minimum(low, (h[None, at : at + 16384] * _ODD[:, None]).min(axis=1))
    key = np.arange(BLOCKS, dtype=np.uint64)
    for m in low.reshape(BLOCKS, MINIMA).T:
        key = (key ^ m) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def link_similar(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges that connect the rows of a bucket whose sets agree to ``least`` or more.

    A search from row to row: what a component has reached is compared only with rows that none
    has reached yet, so a group of near copies costs a few passes over it and not all pairs. Side 0
    is compared with everything, sides 1 and 2 only with each other.
    """
    size = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.cumsum(size) - size
    mark = np.zeros(int(codes.max()) + 1, bool)
    left = np.ones(len(sets), bool)
    out = []
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo and left.any():
            f = todo.pop()
            near = left & (size >= least * size[f]) & (size * least <= size[f])
            near &= (side == 0) if side[f] == 0 else (side != side[f])
            rest = np.flatnonzero(near)
            if not len(rest):
                continue
            own = codes[first[f] : first[f] + size[f]]
            mark[own] = True
            ends = np.cumsum(size[rest])
            flat = np.repeat(first[rest] - ends + size[rest], size[rest]) + np.arange(ends[-1])
            both = np.add.reduceat(mark[codes[flat]].astype(np.int32), ends - size[rest])
            mark[own] = False
            found = rest[both >= least * (size[f] + size[rest] - both) - 1e-9]
            left[found] = False
            out += [(int(nodes[f]), int(nodes[x])) for x in found]
            todo += found.tolist()
    return out


def signatures(docs: DataFrame, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """(node, fp, keys) of (node, text): the fingerprint and the keys of the blocks, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, keys = [], []
            for t in b.column(1):
                h = shingle_hashes(t.as_py(), shingle)
                fps.append(majority(h))
                keys.append(blocks(np.unique(h)))
            sizes = np.cumsum([0, *map(len, keys)])
            flat = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), flat], ["node", "fp", "keys"])

    return docs.select("node", F.col("text").cast("binary")).mapInArrow(run, "node long, fp long, keys array<long>")


def similar_links(docs: DataFrame, signed: DataFrame, shingle: int = SIMILAR_SHINGLE, least: float = SIMILAR, tile: int = SIMILAR_TILE) -> DataFrame:
    """(a, b): edges that connect all rows of (node, text) whose sets of shingles agree to ``least``.

    ``signed`` holds their ``signatures``. Keys of blocks are counted; only rows in a block that
    several rows share bring their shingles (four bytes each), filtered where they are read by a
    mark set. Blocks above ``tile`` rows are dealt to all pairs of their tiles, each of which
    returns a forest and not its pairs. Texts without words have no shingles and link with none here.
    """
    shared = cut(signed.select(F.explode("keys").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    held = docs.sparkSession.sparkContext.broadcast(marks(shared.select(slot("bucket"))))  # fixed size

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(out):
            k, node, small = zip(*out)
            at = pa.array(np.repeat(np.arange(len(k)), [len(x) for x in k]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(k)), pa.array(node, pa.int64()).take(at), pa.array(small, pa.binary()).take(at)], ["bucket", "node", "set"])

        for b in batches:
            out, size = [], 0
            for node, t in zip(b.column(0).to_pylist(), b.column(1)):
                h = np.unique(shingle_hashes(t.as_py(), shingle))
                k = blocks(h)
                k = k[marked(held.value, slots_of(k))]
                if len(k):
                    out.append((k, node, np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes()))
                    size += len(k) * len(out[-1][2])
                if size > _SHIPPED:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)

    wide = shared.where(F.col("n") > tile).select(F.col("bucket").alias("k"), F.ceil(F.col("n") / tile).cast("int").alias("t"))
    rows = docs.select("node", F.col("text").cast("binary")).mapInArrow(bring, "bucket long, node long, set binary")
    dealt = rows.join(wide, F.col("bucket") == F.col("k"), "left").drop("k").fillna(1, ["t"])
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(7)), F.col("t")).cast("int"))
    dealt = dealt.select("bucket", F.explode(_tiles()).alias("o"), "node", "set").select("bucket", "o.tile", "o.side", "node", "set")
    dealt = dealt.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            at, held = None, []
            for b in batches:
                for k, tile, side, node, s in zip(*(b.column(i).to_pylist() for i in range(5))):
                    if at != (k, tile):
                        yield held
                        at, held = (k, tile), []
                    held.append((node, side, np.frombuffer(s, np.uint32)))
            yield held

        for group in groups():
            if len(group) > 1:
                nodes, side, sets = zip(*group)
                if found := link_similar(np.array(nodes), list(sets), np.array(side), least):
                    a, b = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(link, "a long, b long").where("a <> b").distinct()


def distinct_documents(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, bits: int = BITS, least: float = SIMILAR, tile: int = SIMILAR_TILE) -> DataFrame:
    """One row of ``docs`` for each group of copies and near copies, all columns.

    Rows link if their texts are equal, if their fingerprints differ in ``bits`` bits at most, or
    if their sets of ``shingle``-word shingles agree to ``least`` or more. Of a group the row of the
    smallest doc_id stays (a null one only if there is no other), then that of the smallest hash of
    the text; of rows alike in both any one. The text is shuffled once, to leave exact copies
    out; after that only rows near a copy move.

    Null, empty and blank texts have no words and are one group. Empty table: no rows.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("node"))
    key = F.struct(F.col("id").isNull().alias("none"), "id")
    first = rows.groupBy("node").agg(F.min(key).alias("k")).select(F.col("k.id").alias("i"), F.col("node").alias("n"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("node") == F.col("n"))
    single = Stored(rows.join(first, same, "left_semi").dropDuplicates(["id", "node"])).rows  # a row for each different text
    texts = single.select("node", F.col("doc.text").alias("text"))
    signed = Stored(signatures(texts, shingle)).rows
    by_fp = signed.groupBy("fp").agg(F.min("node").alias("rep"))
    alike = signed.select("node", F.col("fp").alias("f")).join(by_fp, F.col("f") == F.col("fp")).select(F.col("node").alias("a"), F.col("rep").alias("b"))
    edges = alike.unionByName(hamming_links(by_fp, bits)).unionByName(similar_links(texts, signed, shingle, least, tile))
    comp = connected_components(edges.where("a <> b")).withColumnRenamed("node", "n")
    members = single.select("id", "node").join(comp, F.col("node") == F.col("n")).select("component", "id", "node")
    stays = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))
    best = members.groupBy(F.col("component").alias("c")).agg(stays.alias("best"))
    gone = Stored(members.join(best, F.col("component") == F.col("c")).where(F.col("node") != F.col("best.node")).select("node")).rows
    held = docs.sparkSession.sparkContext.broadcast(marks(gone.select(slot("node"))))  # fixed size

    def asked(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(marked(held.value, slots_of(b.column(2).to_numpy())) == inside))

        return run

    rest = single.mapInArrow(asked(True), single.schema).join(gone, "node", "left_anti")  # the mark set lets some through
    return single.mapInArrow(asked(False), single.schema).select("doc.*").unionByName(rest.select("doc.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
