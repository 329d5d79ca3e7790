"""Operator 10: remove passages that occur elsewhere, through suffix automata of reference shards.

A window is ``size`` consecutive words. Its anchor is the smallest hash among its ``gram``-word
sequences (the leftmost, on ties), so equal windows have equal anchors at equal offsets. The
windows of a document that share an anchor form a context, and each window lies in one context
only. A window can only repeat if its anchor does, and only among the contexts of that anchor:
those are the reference shards, each small enough for an automaton of its own. That keeps
reference and stream together by key, where broadcasting automata of a corpus-sized reference
to every task would not scale.

Texts and contexts are filtered where they are read, by mark sets of fixed size, so that what
does not repeat is not shuffled. A mark set lets some keys through that it should not, more so
as the corpus outgrows it; these cost time and are then found not to repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, marked, marks, slot, slots_of, table

WINDOW = 35
GRAM = 14
#: Contexts of one anchor that one automaton takes; the windows of fuller anchors are counted by hash.
CONTEXTS = 1000
_TEXT = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 16)
        _powers[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(m, b, np.uint64)))) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sums(words: list[bytes]) -> np.ndarray:
    """Prefix sums of word hashes times powers of the base; see ``_hash``."""
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.concatenate(([np.uint64(0)], np.cumsum(w * _pow(len(w))[0])))


def _hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of words[start:stop], the same wherever those words stand."""
    return _mix((sums[stop] - sums[start]) * _pow(len(sums))[1][start] + (stop - start).astype(np.uint64))


def anchors(words: list[bytes], size: int = WINDOW, gram: int = GRAM):
    """(h, c, a, b): anchor hash, context hash, and the context's first and last window start."""
    n = len(words) - size + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    sums = _sums(words)
    at = np.arange(len(words) - gram + 1)
    v = _hash(sums, at, at + gram)
    best, have, span = at, 1, size - gram + 1
    while have < span:  # leftmost minimum of spans that double
        step = min(have, span - have)
        left, right = best[: len(best) - step], best[step:]
        best, have = np.where(v[right] < v[left], right, left), have + step
    first = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
    last = np.append(first[1:] - 1, n - 1)
    return v[best[first]], _hash(sums, first, last + size), first, last


class Automaton:
    """Suffix automaton of several word sequences, each counted with its multiplicity."""

    def __init__(self):
        self.next, self.link, self.length, self.count = [{}], [-1], [0], [0]

    def _add(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._split(last, word, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        self.count.append(0)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.count.append(0)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def feed(self, words: list[int], times: int) -> None:
        last = 0
        for w in words:
            last = self._add(last, w)
            self.count[last] += times

    def close(self) -> None:
        """Occurrences of each state's words: those of all states that it is a suffix of."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def repeated(self, words: list[int], size: int) -> list[bool]:
        """For each window of the sequence: does it occur twice or more? Matching statistics."""
        out, state, match = [], 0, 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                match = self.length[state]
            if w in self.next[state]:
                state, match = self.next[state][w], match + 1
            while self.length[self.link[state]] >= size if state else False:
                state = self.link[state]
                match = self.length[state]
            if i + 1 >= size:
                out.append(match >= size and self.count[state] >= 2)
        return out


def _runs(flags: list[bool], first: int, size: int) -> list[tuple[int, int]]:
    """Maximal word spans covered by the flagged windows."""
    out: list[list[int]] = []
    for i, f in enumerate(flags):
        if f:
            if out and first + i <= out[-1][1]:
                out[-1][1] = first + i + size
            else:
                out.append([first + i, first + i + size])
    return [tuple(x) for x in out]


def _found(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, int, list, list]]:
    """(batch, first row, contexts by row, their numbers), for about 100,000 contexts at a time."""
    for b in batches:
        rows, sizes, held = [], [], 0
        for i, t in enumerate(b.column(2)):
            rows.append(anchors((t.as_py() or b"").split(), size))
            sizes.append(len(rows[-1][0]))
            held += sizes[-1]
            if held > 100_000 or i + 1 == b.num_rows:
                yield b, i + 1 - len(rows), rows, sizes
                rows, sizes, held = [], [], 0


def _repeated_anchors(docs: DataFrame, size: int) -> np.ndarray:
    """Mark set of the anchors that several contexts have; counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows, _ in _found(batches, size):
            h, n = np.unique(np.concatenate([x[0] for x in rows]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    counted = docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    return marks(counted.select(slot("h")))


def _contexts(docs: DataFrame, size: int, again: np.ndarray) -> DataFrame:
    """(doc_id, row, slot, h, c, az) of the contexts whose anchor is in ``again``; az: first window
    and, in the last 16 bits, the number of further ones; slot: place of the document."""
    held = docs.sparkSession.sparkContext.broadcast(again)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, start, rows, sizes in _found(batches, size):
            h, c, a, z = (np.concatenate(x) for x in zip(*rows))
            keep = marked(held.value, slots_of(h.view(np.int64)))
            at = pa.array(np.repeat(np.arange(start, start + len(rows)), sizes)[keep])
            az = (a << 16 | z - a)[keep]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), b.column(3).take(at), pa.array(h[keep].view(np.int64)), pa.array(c[keep].view(np.int64)), pa.array(az)],
                ["doc_id", "row", "slot", "h", "c", "az"],
            )

    return docs.mapInArrow(run, "doc_id long, row long, slot long, h long, c long, az long")


def _only(docs: DataFrame, held) -> DataFrame:
    """Documents whose slot is in a broadcast mark set; filtered where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(marked(held.value, b.column(3).to_numpy())))

    return docs.mapInArrow(run, docs.schema)


def _automata(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, n, words) sorted by h; an automaton for each h, and its contexts streamed through."""
    group: list[tuple] = []

    def judge(group):
        ids: dict[bytes, int] = {}
        coded = [[ids.setdefault(w, len(ids)) for w in words.split()] for _, _, _, words in group]
        auto = Automaton()
        for (_, _, n, _), words in zip(group, coded):
            auto.feed(words, n)
        auto.close()
        out = []
        for (h, c, n, _), words in zip(group, coded):
            if n == 1:
                out += [(h, c, i, j) for i, j in _runs(auto.repeated(words, size), 0, size)]
        h, c, i, j = zip(*out) if out else ((),) * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(i, pa.int32()), pa.array(j, pa.int32())], ["h", "c", "i", "j"]
        )

    for b in batches:
        for row in zip(*(x.to_pylist() for x in b.columns)):
            if group and group[0][0] != row[0]:
                yield judge(group)
                group = []
            group.append(row)
    if group:
        yield judge(group)


def _same(a: str, b: str, c: str, d: str) -> F.Column:
    return F.col(a).eqNullSafe(F.col(b)) & (F.col(c) == F.col(d))


def repeated_spans(docs: DataFrame, size: int = WINDOW, most: int = CONTEXTS) -> Stored:
    """(d, r, slot, spans): spans (i, j) of a document, words i..j-1, that repeated windows
    cover; they may touch or overlap. ``docs``: (doc_id, row, text, slot); ``row`` is the hash of the text.

    What moves: a number for each anchor and task (a context is about one in seven words); the
    contexts whose anchor repeats, once to be counted and once to meet their spans. Equal
    contexts are counted, so a passage in a third of all documents is one row a task. Words are
    fetched, once for each different context, only for anchors that have several contexts of
    which some stand alone, from documents that hold such. An anchor with more than ``most``
    contexts would need an automaton without bound: the windows of its lone contexts are hashed
    and counted instead, again with partial sums.
    """
    found = Stored(_contexts(docs, size, _repeated_anchors(docs, size)))
    kinds = found.rows.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "az", "slot")).alias("at"))
    kinds = Stored(kinds.select("h", "c", "n", "at.*"))
    by_h = kinds.rows.groupBy(F.col("h").alias("g")).agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    open_ = Stored(by_h.where("kinds > 1 and least = 1").drop("least"))  # a plain shuffle in the join, so that AQE splits hot anchors
    asked = kinds.rows.join(open_.rows, F.col("h") == F.col("g")).drop("g")
    whole = kinds.rows.where("n > 1").select("h", "c", F.lit(0).alias("i"), F.lit(-1).alias("j"))

    # the words of the contexts in question
    asked = Stored(
        asked.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("slot").alias("s"))
        .agg(F.collect_list(F.struct("h", "c", "n", "kinds", "az")).alias("asked"))
    )
    texts = _only(docs, docs.sparkSession.sparkContext.broadcast(marks(asked.rows.select("s")))).join(asked.rows, _same("doc_id", "d", "row", "r")).select("text", "asked")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, asked in zip(b.column(0), b.column(1)):
                words = (t.as_py() or b"").split()
                out = [(x["h"], x["c"], x["n"], x["kinds"], b" ".join(words[x["az"] >> 16 : (x["az"] >> 16) + (x["az"] & 0xFFFF) + size])) for x in asked.as_py()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["h", "c", "n", "kinds", "words"]
                )

    # rows alike in doc_id and text bring a context more than once; its place decides
    worded = Stored(texts.mapInArrow(fetch, "h long, c long, n long, kinds long, words binary").dropDuplicates(["h", "c"]))
    asked.drop()
    open_.drop()
    few = worded.rows.where(F.col("kinds") <= most).select("h", "c", "n", "words").repartition("h").sortWithinPartitions("h")
    judged = few.mapInArrow(lambda it: _automata(it, size), "h long, c long, i int, j int")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c, n, words in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
                sums = _sums(words.as_py().split())
                at = np.arange(len(sums) - size)
                k = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, x.as_py())) for x in (h, c, n)] + [pa.array(_hash(sums, at, at + size).view(np.int64)), pa.array(at.astype(np.int32))],
                    ["h", "c", "n", "w", "i"],
                )

    many = worded.rows.where(F.col("kinds") > most).select("h", "c", "n", "words").mapInArrow(windows, "h long, c long, n long, w long, i int")
    twice = many.groupBy("h", "w").agg(F.sum("n").alias("times")).where("times > 1").select("h", "w")
    hot = many.where("n = 1").join(twice, ["h", "w"]).select("h", "c", "i", (F.col("i") + size).alias("j"))
    spans = Stored(whole.unionByName(judged).unionByName(hot))
    kinds.drop()
    worded.drop()
    a = F.shiftright("az", 16)
    each = found.rows.join(spans.rows, ["h", "c"]).select(
        F.col("doc_id").alias("d"), F.col("row").alias("r"), "slot",
        (a + F.col("i")).cast("int").alias("i"),
        F.when(F.col("j") < 0, a + F.col("az").bitwiseAND(0xFFFF) + size).otherwise(a + F.col("j")).cast("int").alias("j"),
    )
    out = Stored(each.groupBy("d", "r", "slot").agg(F.collect_set(F.struct("i", "j")).alias("spans")))
    found.drop()
    spans.drop()
    return out


def remove_repeats(docs: DataFrame, size: int = WINDOW, most: int = CONTEXTS) -> DataFrame:
    """(doc_id, text, n_words, n_removed) for each row of ``docs``: kept words joined by a space.

    Words covered by a window that starts anywhere else too go, in all places; windows are
    judged on the input. Only documents that lose words are shuffled. Nulls: a null text has no
    words; a null doc_id is kept and judged by its text. Rows that repeat are occurrences of
    their own, so both copies lose all windows. Other columns are ignored. Empty table: empty
    result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("text"))
    rows = rows.withColumn("slot", slot("doc_id", "row"))
    spans = repeated_spans(rows, size, most).rows
    touched = docs.sparkSession.sparkContext.broadcast(marks(spans.select("slot")))  # fixed size
    hit = _only(rows, touched).join(spans.drop("slot"), _same("doc_id", "d", "row", "r"), "left").select("doc_id", "text", "spans")

    def cut_out(words: list[bytes], spans) -> list[bytes]:
        edge = np.zeros(len(words) + 1, np.int64)
        for x in spans:
            edge[x["i"]] += 1
            edge[x["j"]] -= 1
        return [w for w, k in zip(words, (np.cumsum(edge[:-1]) == 0).tolist()) if k]

    def made(ids: pa.Array, each: Iterator[tuple[list[bytes], list[bytes]]]) -> Iterator[pa.RecordBatch]:
        """Rows from (words, kept words) of each text, a few megabytes at a time."""
        texts, totals, gone, held = [], [], [], 0
        for i, (words, kept) in enumerate(each):
            texts.append(b" ".join(kept).decode("utf-8", "replace"))
            totals.append(len(words))
            gone.append(len(words) - len(kept))
            held += len(texts[-1])
            if held > _TEXT or i + 1 == len(ids):
                part = ids.slice(i + 1 - len(texts), len(texts))
                yield pa.RecordBatch.from_arrays([part, pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])
                texts, totals, gone, held = [], [], [], 0

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = ((t.as_py() or b"").split() for t in b.column(1))
            yield from made(b.column(0), ((w, cut_out(w, s.as_py()) if s.is_valid else w) for w, s in zip(split, b.column(2))))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~marked(touched.value, b.column(3).to_numpy())))
            yield from made(b.column(0), ((w, w) for w in ((t.as_py() or b"").split() for t in b.column(2))))

    kind = "doc_id long, text string, n_words long, n_removed long"
    return hit.mapInArrow(cutting, kind).unionByName(rows.mapInArrow(passing, kind))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
         generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i
  FROM documents
), k AS (
  SELECT doc_id, i, word, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS k
  FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), r AS (SELECT doc_id, i, word, (n = 35 AND count(*) OVER (PARTITION BY n, k) > 1)::int AS again FROM k),
g AS (
  SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r
), t AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone = 1) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept
  FROM g GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""
