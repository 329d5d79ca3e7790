"""Operator 13: remove byte strings that start earlier too, through run-length indexes of shards.

A window is ``size`` consecutive bytes of one document. Its anchor is the smallest hash among its
``GRAM``-byte strings, so equal windows have equal anchors. Consecutive windows of a document with
one anchor form a context, at most ``SPAN`` windows long. A window can only repeat if its anchor
does, and only among the contexts of that anchor; a shard is some anchors with all their
different contexts, in the order (doc_id, start) of their first copies.

Each shard gets a Burrows-Wheeler transform, kept as runs, in which suffixes stand by their first
``size`` bytes and then by text order. Rows whose windows are equal are neighbours, and the first
of them is the earliest start: these interval ends are the sampled positions. The shard's contexts
are streamed through the runs from their last byte to their first, by backward search that keeps
the longest match up to ``size`` bytes; a window whose match starts earlier than itself is marked.
An anchor whose contexts are all equal (and cannot repeat a window of their own) is one entry of
its dictionary: every copy but the first goes, and no search is needed.

Texts are read three times (anchors are counted, contexts of repeated anchors are listed, bytes
are fetched of contexts that an index needs) and filtered where they are read by mark sets of
fixed size; what they let through beside costs time and is found not to repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, join_heavy, marked, marks, slot, slots_of, table

WINDOW = 100
GRAM = 48
#: Windows of a context; more with the same anchor, as in periodic texts, are further contexts.
SPAN = 256
#: Bytes of a shard, and contexts of one anchor that a shard takes; fuller anchors go by window.
SHARD = 1 << 18
CONTEXTS = 2048
_SLICE = 1 << 18
_BLOCK = 1 << 15
_TEXT = 4 << 20
_PACK = 7
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0x94D049BB133111EB]


def _spread(x: np.ndarray, span: int, least: Callable) -> np.ndarray:
    """Minimum or maximum of each ``span`` consecutive values, over spans that double."""
    have = 1
    while have < span:
        step = min(have, span - have)
        x = least(x[: len(x) - step], x[step:])
        have += step
    return x


def _anchors(data: np.ndarray, size: int, twice: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of the bytes, as unsigned 64-bit numbers, and those that some window
    may hold at two places (if asked for): only their contexts can repeat a window of their own."""
    gram = min(GRAM, size // 2 & ~7)
    span = size - gram + 1
    grams, out = np.empty(len(data) - gram + 1, np.uint64), np.empty(len(data) - size + 1, np.uint64)
    for at in range(0, len(out), _BLOCK):  # blocks that stay in the cache
        part = np.ascontiguousarray(data[at : at + _BLOCK + size - 1])
        eight = np.ndarray((len(part) - 7,), "<u8", part, 0, (1,))
        n = len(part) - gram + 1
        h = eight[:n] * np.uint64(_ODD[0])
        for k in range(8, gram, 8):
            h += eight[k : k + n] * np.uint64(_ODD[k // 8])
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(_ODD[5])
        h ^= h >> np.uint64(31)
        grams[at : at + n] = h
        out[at : at + n - span + 1] = _spread(h, span, np.minimum)
    if not twice:
        return out, out[:0]
    # a gram is the anchor of a window that holds it if it equals the largest anchor of these
    edge = np.zeros(span - 1, np.uint64)
    chosen = grams[grams == _spread(np.concatenate((edge, out, edge)), span, np.maximum)]
    return out, np.unique(chosen[1:][chosen[1:] == chosen[:-1]])


def _ranges(edges: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of window starts: some whole texts each, or a part of a long one. The cuts inside a
    text depend on the text alone, so that every pass finds the same contexts."""
    lo = 0
    while lo + 1 < len(edges):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + _SLICE, "right")) - 1)
        stop = int(edges[hi]) - size + 1
        for at in range(int(edges[lo]), stop, _SLICE):
            yield at, min(at + _SLICE, stop)
        lo = hi


def contexts(data: np.ndarray, edges: np.ndarray, size: int, own: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """(h, text, first, windows, own) of the contexts of the texts data[edges[k] : edges[k + 1]], some
    at a time; ``first`` counts from the start of ``data``, ``own``: may it
    repeat a window of its own? (False unless asked for.)"""
    for at, to in _ranges(edges, size):
        h, twice = _anchors(data[at : to + size - 1], size, own)
        cut = np.flatnonzero(h[1:] != h[:-1]) + at + 1
        bounds = np.concatenate((edges, edges - size + 1))  # a text's windows start in [edge, next edge - size]
        cut = np.unique(np.concatenate(([at], cut, bounds[(bounds > at) & (bounds < to)])))
        text = np.searchsorted(edges, cut, "right") - 1
        many = np.append(cut[1:], to) - cut
        good = cut + size <= edges[text + 1]
        cut, text, many = cut[good], text[good], many[good]
        pieces = -(-many // SPAN)
        if (pieces > 1).any():
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            cut, text, many = np.repeat(cut, pieces) + nth * SPAN, np.repeat(text, pieces), np.repeat(many, pieces) - nth * SPAN
            many = np.minimum(many, SPAN)
        if len(cut):
            yield h[cut - at], text, cut, many, np.isin(h[cut - at], twice)


def _bytes_of(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, one text after the other, and the edges of the texts."""
    c = c.fill_null(b"") if c.null_count else c
    edges = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
    if not len(c) or edges[-1] == edges[0]:
        return np.zeros(0, np.uint8), np.zeros(len(c) + 1, np.int64)
    return np.frombuffer(c.buffers()[2], np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def _slices(batches: Iterator[pa.RecordBatch], size: int, own: bool = True) -> Iterator[tuple]:
    """(batch, bytes, edges, contexts...); who reads these lets go of them before the next, so that one
    batch of texts is in memory at a time."""
    for b in batches:
        data, edges = _bytes_of(b.column(2))
        for found in contexts(data, edges, size, own):
            yield b, data, edges, *found
        del b, data, edges
        pa.default_memory_pool().release_unused()


def _repeated_anchors(docs: DataFrame, size: int) -> np.ndarray:
    """Mark set of the anchors of two contexts, or of one that may repeat itself; counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, _, h, _, _, _, own in _slices(batches, size):
            del b, data
            h, at, n = np.unique(h.view(np.int64), return_inverse=True, return_counts=True)
            n[at[own]] += 1
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    counted = docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    return marks(counted.select(slot("h")))


def _listed(docs: DataFrame, size: int, again: np.ndarray) -> DataFrame:
    """(d, r, h, c, a, w, own): contexts whose anchor is in ``again``; c: hash of the bytes, a: first window, w: windows."""
    held = docs.sparkSession.sparkContext.broadcast(again)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, edges, *found in _slices(batches, size):
            keep = marked(held.value, slots_of(found[0].view(np.int64)))
            h, text, first, many, own = (x[keep] for x in found)
            view = memoryview(data)
            c = [xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(first.tolist(), (first + many + size - 1).tolist())]
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(h.view(np.int64)), pa.array(np.array(c, np.uint64).view(np.int64)),
                 pa.array((first - edges[text]).astype(np.int64)), pa.array(many.astype(np.int32)), pa.array(own)],
                ["d", "r", "h", "c", "a", "w", "own"],
            )
            del b, data, view, at

    return docs.mapInArrow(run, "d long, r long, h long, c long, a long, w int, own boolean")


def _fetched(docs: DataFrame, size: int, wanted: np.ndarray) -> DataFrame:
    """(h, c, bytes): the bytes of contexts whose anchor is in ``wanted``, once for each slice of the texts."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, _, *found in _slices(batches, size, False):
            keep = marked(held.value, slots_of(found[0].view(np.int64)))
            h, _, first, many, _ = (x[keep] for x in found)
            view = memoryview(data)
            each = {(x, bytes(view[i:j])) for x, i, j in zip(h.view(np.int64).tolist(), first.tolist(), (first + many + size - 1).tolist())}
            keys, texts = zip(*each) if each else ((), ())
            c = np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(c), pa.array(texts, pa.binary())], ["h", "c", "bytes"])
            del b, data, view, each, texts

    return docs.mapInArrow(run, "h long, c long, bytes binary")


class RunIndex:
    """Run-length Burrows-Wheeler transform of byte strings, for matches of up to ``size`` bytes.

    Kept of the transform: its runs, their places in the order of (symbol, run), and the intervals
    of repeated windows, each with its sampled first position. Symbol 0 separates the strings.
    """

    def __init__(self, texts: list[bytes], size: int):
        self.size, pad = size, size + _PACK
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        n = int((self.lengths + 1).sum()) + pad
        self.text = np.zeros(n, np.uint16)
        inside = np.arange(self.lengths.sum()) + np.repeat(np.arange(len(texts)), self.lengths)
        self.text[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
        order, same, almost = self._sorted(n)
        symbols = self.text[order - 1]
        self.run = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
        self.n, r = n, len(self.run)
        self.key = symbols[self.run].astype(np.int64) * (r + 1) + np.arange(r)
        by = np.argsort(self.key)
        self.key = self.key[by]
        self.before = np.concatenate(([0], np.cumsum(np.diff(np.append(self.run, n))[by])))
        self.low, self.high = self._intervals(almost, n)
        self.first, end = self._intervals(same, n)
        self.sample = order[self.first]
        self.heads = r + 1

    def _sorted(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions by their next ``size`` symbols, then by position; where rows differ from the row
        before in ``size`` symbols, and in one less."""
        key = np.zeros(n, np.int64)
        longer = np.concatenate((self.text, np.zeros(_PACK, np.uint16))).astype(np.int64)
        for k in range(_PACK):
            key |= longer[k : k + n] << 9 * (_PACK - 1 - k)
        have = _PACK
        rank, at = self._ranked(key), np.arange(n)
        after = lambda step: rank[np.minimum(at + step, n - 1)]  # noqa: E731  the text ends in separators
        while 2 * have < self.size:
            rank = self._ranked(rank * n + after(have))
            have *= 2
        key = rank * n + after(self.size - have)
        order = np.argsort(key, kind="stable")
        differ = lambda x: np.concatenate(([True], x[1:] != x[:-1]))
        return order, differ(key[order]), differ((rank * n + after(self.size - 1 - have))[order])

    @staticmethod
    def _ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1])))
        return rank

    @staticmethod
    def _intervals(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the intervals of two rows or more."""
        start = np.flatnonzero(starts)
        end = np.append(start[1:], n)
        more = end - start > 1
        return start[more], end[more]

    def _step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows before those that start with the symbol and go on like the rows from ``row`` on."""
        run = np.searchsorted(self.run, row, "right") - 1
        key = symbol * self.heads + run
        at = np.searchsorted(self.key, key)
        hit = self.key[np.minimum(at, len(self.key) - 1)] == key
        return self.before[at] + np.where(hit, row - self.run[run], 0)

    def matches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(string, window, earliest start in the text) for the windows that occur twice or more,
        by streaming all strings from their ends."""
        by = np.argsort(-self.lengths, kind="stable")
        length, start = self.lengths[by], self.starts[by]
        low, high = np.zeros(len(by), np.int64), np.full(len(by), self.n)
        for t in range(int(length[0]) if len(by) else 0):
            k = int(np.searchsorted(-length, -t, "left"))  # strings longer than t
            low, high = low[:k], high[:k]
            if t >= self.size:  # the match loses its last byte
                p = np.searchsorted(self.low, low, "right") - 1
                inside = (p >= 0) & (low < self.high[p]) if len(self.low) else np.zeros(k, bool)
                low, high = np.where(inside, self.low[p] if len(self.low) else low, low), np.where(inside, self.high[p] if len(self.low) else high, low + 1)
            symbol = self.text[start[:k] + length[:k] - 1 - t].astype(np.int64)
            many = np.flatnonzero(high - low > 1)
            up = self._step(symbol[many], high[many])
            low = self._step(symbol, low)
            high = low + 1  # one row's match is the string itself
            high[many] = up
            if t + 1 >= self.size:
                again = np.flatnonzero(high - low > 1)
                if len(again):
                    yield by[again], length[again] - 1 - t, self.sample[np.searchsorted(self.first, low[again])]

    def repeated(self) -> list[np.ndarray]:
        """For each string, in ascending order, its windows that start earlier in the text too."""
        found = list(self.matches())
        if not found:
            return [np.zeros(0, np.int64)] * len(self.lengths)
        string, window, earliest = (np.concatenate(x) for x in zip(*found))
        later = earliest < self.starts[string] + window
        string, window = string[later], window[later]
        by = np.lexsort((window, string))
        return np.split(window[by], np.searchsorted(string[by], np.arange(1, len(self.lengths))))


def spans_of(windows: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal spans that windows starting at these ascending places cover."""
    if not len(windows):
        return []
    new = np.concatenate(([True], np.diff(windows) > size))
    first = np.flatnonzero(new)
    return list(zip(windows[first].tolist(), (windows[np.append(first[1:], len(windows)) - 1] + size).tolist()))


def _judged(size: int, shard: int) -> Callable:
    """Rows (h, c, bytes) in the order of h and of first copies; an index for each shard."""

    def judge(group: list[tuple]) -> pa.RecordBatch:
        windows = RunIndex([x[2] for x in group], size).repeated()
        out = [(h, c, spans_of(w, size)) for (h, c, _), w in zip(group, windows) if len(w)]
        h, c, s = zip(*out) if out else ((),) * 3
        spans = pa.array([[{"i": i, "j": j} for i, j in x] for x in s], pa.list_(pa.struct([("i", pa.int64()), ("j", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), spans], ["h", "c", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = [], 0
        for b in batches:
            for row in zip(*(x.to_pylist() for x in b.columns)):
                if held > shard and group[-1][0] != row[0]:
                    yield judge(group)
                    group, held = [], 0
                group.append(row)
                held += len(row[2])
        if group:
            yield judge(group)

    return run


def _by_window(size: int) -> Callable:
    """(h, c, key, i) for each window of the contexts (h, c, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                h, c, x = (b.column(k).slice(at, 256).to_pylist() for k in range(3))
                n = [len(t) - size + 1 for t in x]
                keys = [xxhash.xxh3_128_digest(t[i : i + size]) for t, k in zip(x, n) for i in range(k)]
                i = np.concatenate([np.arange(k) for k in n])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(h, np.int64), n)), pa.array(np.repeat(np.array(c, np.int64), n)), pa.array(keys, pa.binary()), pa.array(i)], ["h", "c", "key", "i"])

    return run


_ORDER = ("z", "d", "r", "a")
_SPANS = "h long, c long, spans array<struct<i: long, j: long>>"


def removed_spans(docs: DataFrame, size: int = WINDOW, shard: int = SHARD, most: int = CONTEXTS) -> Stored:
    """(d, r, spans): spans (i, j) of a document's bytes that go; they may touch or overlap.
    ``docs``: (doc_id, row, text), one row for each doc_id and ``row``, the hash of the text.

    What moves: a number for each anchor and slice (one in about 28 bytes); contexts whose anchor
    repeats, as numbers, once to find the first copy and once to meet the verdict, for which keys
    that hold a 4096th of all contexts or more meet it by broadcast; the bytes of different
    contexts where an anchor has several. An anchor with over ``most`` different contexts would be
    a shard without bound: its windows are grouped by their hash instead, with partial minima.
    """
    found = Stored(_listed(docs, size, _repeated_anchors(docs, size)))
    order = F.struct(F.col("d").isNull().alias("z"), "d", "r", "a")
    kinds = Stored(found.rows.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.bool_or("own").alias("own")))
    several = Stored(kinds.rows.groupBy("h").agg(F.count("*").alias("kinds"), F.bool_or("own").alias("own")).where("kinds > 1 or own").drop("own"))
    texts = _fetched(docs, size, marks(several.rows.select(slot("h")))).dropDuplicates(["h", "c"])
    dealt = join_heavy(kinds.rows, several.rows, ["h"], "kinds").select("h", "c", "kinds", *[F.col("first")[x].alias(x) for x in _ORDER])
    dealt = Stored(dealt.join(texts, ["h", "c"]))
    few = dealt.rows.where(F.col("kinds") <= most).repartition("h").sortWithinPartitions("h", *_ORDER, "c")
    judged = few.select("h", "c", "bytes").mapInArrow(_judged(size, shard), _SPANS)
    full = dealt.rows.where(F.col("kinds") > most)
    windows = full.select("h", "c", "bytes").mapInArrow(_by_window(size), "h long, c long, key binary, i long")
    windows = Stored(windows.join(full.select("h", "c", *_ORDER), ["h", "c"]).select("h", "c", "key", "i", F.struct(*_ORDER, "i").alias("at")))
    # one of each group of equal windows is its first; the others go
    first = windows.rows.groupBy("h", "key").agg(F.count("*").alias("times"), F.min("at").alias("least")).where("times > 1")
    late = join_heavy(windows.rows, Stored(first).rows, ["h", "key"], "times").where("at <> least")
    late = late.groupBy("h", "c").agg(F.collect_list(F.struct("i", (F.col("i") + size).alias("j"))).alias("spans"))
    spans = Stored(judged.unionByName(late))
    verdicts = Stored(kinds.rows.drop("own").join(spans.rows, ["h", "c"], "left").where("n > 1 or spans is not null"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("i"), (F.col("w") + size - 1).cast("long").alias("j")))
    is_first = F.col("first") == order
    each = join_heavy(found.rows, verdicts.rows, ["h", "c"], "n").withColumn("s", F.when(is_first, F.col("spans")).otherwise(whole))
    each = each.select("d", "r", "a", F.explode("s").alias("s")).select("d", "r", F.struct((F.col("a") + F.col("s.i")).alias("i"), (F.col("a") + F.col("s.j")).alias("j")).alias("s"))
    out = Stored(each.groupBy("d", "r").agg(F.collect_set("s").alias("spans")))
    for t in (found, kinds, several, dealt, windows, spans, verdicts):
        t.drop()
    return out


def _cut(data: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """(kept bytes, removed bytes, maximal removed runs)."""
    kept, at, gone, runs = [], 0, 0, 0
    stop = -1
    for i, j in sorted((x["i"], x["j"]) for x in spans):
        if i > stop:
            kept.append(data[at:i])
            runs += 1
            gone += j - i
            stop = at = j
        elif j > stop:
            gone += j - stop
            stop = at = j
    kept.append(data[at:])
    return b"".join(kept), gone, runs


def remove_repeats(docs: DataFrame, size: int = WINDOW, shard: int = SHARD, most: int = CONTEXTS) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) for each row of ``docs``; ``kept`` is binary.

    A byte goes if a ``size``-byte string that covers it also starts earlier: in a smaller doc_id,
    or further left in the same text. Nulls: a null text has no bytes; rows with a null doc_id come
    after all others. Ties: rows that share a doc_id come in the order of their texts' hashes; of
    rows alike in doc_id and text one is the first, and the others lose every byte if they have
    ``size`` or more. Texts shorter than ``size`` lose nothing. Other columns are ignored. Empty
    table: empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    alike = Stored(rows.groupBy("doc_id", "row").agg(F.count("*").alias("times")).where("times > 1").select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "times"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))
    extra = None
    if not alike.rows.isEmpty():
        once = Stored(rows.join(alike.rows, same).dropDuplicates(["doc_id", "row"]).select("doc_id", "row", "text", "times"))
        again = once.rows.withColumn("copy", F.explode(F.sequence(F.lit(2), "times")))
        n, gone = F.octet_length("text").cast("long"), F.octet_length("text") >= size
        extra = again.select(
            "doc_id", F.when(gone, F.lit(b"")).otherwise(F.col("text")).alias("kept"), n.alias("n_bytes"),
            F.when(gone, n).otherwise(F.lit(0).cast("long")).alias("n_removed"), gone.cast("long").alias("n_spans"),
        )
        rows = rows.join(alike.rows, same, "left_anti").unionByName(once.rows.drop("times"))
    spans = removed_spans(rows, size, shard, most).rows

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for i, (d, t, s) in enumerate(zip(b.column(0), b.column(1), b.column(2))):
                data = t.as_py()
                out.append((d.as_py(), *_cut(data, s.as_py()), len(data)))
                held += len(data)
                if held > _TEXT or i + 1 == b.num_rows:
                    ids, kept, gone, runs, n = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, gone, runs))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
                    )
                    out, held = [], 0

    joined = rows.join(spans, same, "left")  # its shuffles serve both halves; only texts that lose bytes go on to Python
    hit = joined.where("spans is not null").select("doc_id", "text", "spans")
    zero = F.lit(0).cast("long")
    other = joined.where("spans is null").select(
        "doc_id", F.col("text").alias("kept"), F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans")
    )
    out = hit.mapInArrow(cutting, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long").unionByName(other)
    return out.unionByName(extra) if extra is not None else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, unnest(generate_series(1, len(x) // 2)) AS p, x FROM t),
k AS (SELECT doc_id, p, substr(x, 2 * p - 1, 2) AS b, CASE WHEN 2 * (p + 99) <= len(x) THEN md5_number(substr(x, 2 * p - 1, 200)) END AS k FROM w),
e AS (SELECT doc_id, p, b, (k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1)::int AS late FROM k),
g AS (SELECT doc_id, p, b, max(late) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM e),
r AS (SELECT doc_id, p, b, gone, (gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) = 0)::int AS starts FROM g),
s AS (
  SELECT doc_id, sum(gone) AS n_removed, sum(starts) AS n_spans, coalesce(string_agg(b, '' ORDER BY p) FILTER (WHERE gone = 0), '') AS kept
  FROM r GROUP BY doc_id
)
SELECT t.doc_id, (len(x) // 2)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN s ON t.doc_id IS NOT DISTINCT FROM s.doc_id
"""
