"""Operator 4: benchmark decontamination by latent semantic retrieval.

Passages and benchmark items are TF-IDF vectors over all words of the corpus, hashed to a fixed
number of buckets; document frequencies come from the whole corpus. A randomised SVD, whose
products are sums over partitions of all passages, gives one latent space for all items. Candidates are the passages
whose latent cosine with an item is high, and beside them those that share so many words with it
that a passage holding the item cannot share fewer, in windows of the item's length and of twice
that. Candidates are verified by their longest common subsequence of words, by the item's answer,
and, where too few words stand in order for that, by the cosine of the part that they span.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, table

BUCKETS = 1 << 14
RANK = 96
#: Words of a passage of the latent space, and passages that a product takes at once.
PASSAGE = 64
PASSAGES = 8192
BLOCK = 16
SAME = 0.8
#: Common subsequence that is enough if the answer stands in the passage too.
WITH_ANSWER = 0.6
#: Common subsequence that is enough if the part that it spans has a latent cosine of LATENT or more;
#: random passages were seen to reach 0.41.
REWORDED = 0.5
#: The same for a passage that shares SAME of the item's words in any order.
REORDERED = 0.4
LATENT = 0.9
#: Leading dimensions in which candidates are searched, and the cosine there that makes a window of
#: whole blocks one: foreign words at its ends lower it.
SEARCH = 32
NEAR = 0.8
#: Items whose shared words are counted at once.
GROUP = 128
#: Commonest words whose repeats are taken off before shared words are counted on both sides.
COMMON = 16
#: Items of one pass over the documents: bounds what is broadcast.
ITEMS = 2_000
ITEM_CHARS = 4_000_000
#: Bytes of text that are split and searched at once, if no text is longer.
CHUNK = 600_000
#: Longest word, in bytes, that is hashed beside others.
SHORT = 24
FOUND = "doc_id long, item_id long, start int, stop int, cosine double, overlap double, answered boolean"
# Letters are lowered, ASCII marks part words; one table for items and documents.
_MARKS = b".,;:!?\"()[]{}<>*%$#&|=_~/\\"
_TABLE = bytes(32 if c in _MARKS or c < 32 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: bytes | str | None) -> list[bytes]:
    """Words between blanks and ASCII marks, A-Z lowered."""
    return (text.encode() if isinstance(text, str) else text or b"").translate(_TABLE).split()


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = crc >> np.uint32(1) ^ (crc & np.uint32(1)) * np.uint32(0xEDB88320)
    return crc


_CRC = _crc_table()


class Words:
    """The words of ``words_of`` of some texts, as places in one buffer: text i has those from edge[i] to edge[i + 1]."""

    def __init__(self, texts: list[bytes | str | None]):
        texts = [t.encode() if isinstance(t, str) else t or b"" for t in texts]
        self.data = np.frombuffer(b" ".join([*texts, b" " * 8]).translate(_TABLE), np.uint8)
        turn = np.flatnonzero(np.diff(self.data != 32, prepend=False))  # the last bytes are blanks
        self.start, self.size = turn[::2], turn[1::2] - turn[::2]
        self.edge = np.searchsorted(self.start, np.cumsum([0] + [len(t) + 1 for t in texts]))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.size[i]].tobytes()

    @cached_property
    def hashes(self) -> np.ndarray:
        """zlib.crc32 of each word, byte by byte for all that are long enough."""
        out = np.empty(len(self.size), np.uint32)
        long = np.flatnonzero(self.size > SHORT)
        out[long] = [zlib.crc32(self.word(i)) for i in long.tolist()]
        order = np.argsort(np.minimum(self.size, SHORT + 1).astype(np.uint8), kind="stable")[: len(out) - len(long)][::-1]
        left = np.cumsum(np.bincount(self.size[order], minlength=SHORT + 1)[::-1])[::-1]  # words of that size or more
        crc, at = np.full(len(order), 0xFFFFFFFF, np.uint32), self.start[order]
        for i in range(1, SHORT + 1):
            c = crc[: left[i]]
            c[:] = _CRC[self.data[at[: left[i]] + (i - 1)] ^ c.astype(np.uint8)] ^ c >> np.uint32(8)
        out[order] = ~crc
        return out

    def eight(self, word: np.ndarray, at: int) -> np.ndarray:
        """Eight bytes of words that are longer than ``at``, from there, zeros after their end."""
        every = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        rest = np.maximum(8 - (self.size[word] - at), 0).astype(np.uint64) * np.uint64(8)
        return every[self.start[word] + at] << rest

    def per_text(self, x: np.ndarray) -> list[np.ndarray]:
        edge = self.edge.tolist()
        return [x[a:z] for a, z in zip(edge, edge[1:])]


class Vocabulary:
    """Words by their hash, for looking up many at once; hits are compared byte by byte."""

    def __init__(self, words: list[bytes]):
        self.words = Words(words)  # word i is text i
        self.order = np.argsort(self.words.hashes, kind="stable")
        self.keys = self.words.hashes[self.order]
        bits = min(len(words).bit_length() + 3, 24)
        self.shift = np.uint32(32 - bits)
        self.edge = np.searchsorted(self.keys, np.arange((1 << bits) + 1) << 32 - bits).astype(np.int32)

    def numbers(self, found: Words) -> np.ndarray:
        """Number of each word, -1 for other words."""
        out = np.full(len(found.size), -1)
        slot = found.hashes >> self.shift
        at, stop = self.edge[slot], self.edge[slot + 1]
        left = np.flatnonzero(at < stop)
        at, stop = at[left], stop[left]
        while len(left):
            mine = self.order[at]
            same = (self.keys[at] == found.hashes[left]) & (found.size[left] == self.words.size[mine])
            check, done = np.flatnonzero(same), 0
            while len(check):
                equal = found.eight(left[check], done) == self.words.eight(mine[check], done)
                same[check[~equal]] = False
                done += 8
                check = check[equal & (found.size[left[check]] > done)]
            out[left[same]] = mine[same]
            more = np.flatnonzero(~same & (at + 1 < stop))  # the next word of that slot
            left, at, stop = left[more], at[more] + 1, stop[more]
        return out


def chunks(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """(row of the first, words) of some CHUNK bytes of texts at a time."""
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(t.as_py())
        size += len(held[-1] or b"")
        if size >= CHUNK or i + 1 == len(texts):
            yield i + 1 - len(held), Words(held)
            held, size = [], 0


def answer_of(text: str | None) -> list[bytes]:
    """The item's last sentence of three words or more (whole item if there is none)."""
    for part in reversed((text or "").replace("\n", ". ").split(". ")):
        if len(found := words_of(part)) >= 3:
            return found
    return words_of(text)


def buckets_of(words: list[bytes]) -> np.ndarray:
    """Bucket of each word, whether the benchmark has it or not."""
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS


class Space:
    """Weights of the buckets, and their places in the latent space: the same for all items."""

    def __init__(self, df: np.ndarray, n: int):
        self.idf = np.log((n + 1) / (df + 1)) + 0.01
        self.latent = np.zeros((BUCKETS, 0), np.float32)

    def project(self, basis: np.ndarray) -> None:
        self.latent = (basis * self.idf[:, None]).astype(np.float32)

    @cached_property
    def leading(self) -> np.ndarray:
        """The dimensions of the search, on the worker, and a row for no word."""
        return np.vstack([self.latent[:, :SEARCH], np.zeros((1, min(SEARCH, self.latent.shape[1])), np.float32)])

    def place(self, buckets: np.ndarray) -> np.ndarray:
        """Unit vector of a passage in the latent space; 0 for one without words."""
        v = self.latent[buckets].sum(axis=0, dtype=np.float64)
        return v / (np.sqrt(v @ v) + 1e-12)


class Model:
    """What is broadcast of the items: bounded by ITEMS, ITEM_CHARS (or the longest item) and RANK."""

    def __init__(self, items: list[tuple[int, str | None]], space: Space | None = None):
        split = [(i, words_of(t), answer_of(t)) for i, t in items]
        split = [x for x in split if x[1]]
        vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws, _ in split for w in ws}))}
        self.vocabulary = vocabulary
        self.items = [i for i, _, _ in split]
        self.words = [np.array([vocabulary[w] for w in ws]) for _, ws, _ in split]
        self.said = [np.array([vocabulary[w] for w in a], np.int64) for _, _, a in split]
        self.answers = [" ".join(map(str, a.tolist())) for a in self.said]
        self.sizes = np.array([len(ws) for ws in self.words])
        self.scale = -(-self.sizes // BLOCK) + 1
        self.places = np.stack([space.place(buckets_of(ws)) for _, ws, _ in split]).astype(np.float32) if space and split else None

    @cached_property
    def lookup(self) -> Vocabulary:
        """On the worker."""
        return Vocabulary(list(self.vocabulary))

    def shared(self, k: int, ids: np.ndarray) -> int:
        """Words that a passage shares with item ``k``, each as often as the rarer side has it."""
        words, times = np.unique(self.words[k], return_counts=True)
        here, held = np.unique(ids[ids >= 0], return_counts=True)
        _, i, j = np.intersect1d(words, here, assume_unique=True, return_indices=True)
        return int(np.minimum(times[i], held[j]).sum())

    @cached_property
    def leading(self) -> np.ndarray:
        """Unit vectors of the items in the dimensions of the search, on the worker."""
        places = self.places[:, :SEARCH]
        return places / (np.sqrt(np.einsum("ij,ij->i", places, places)) + 1e-12)[:, None]

    @cached_property
    def groups(self) -> list[tuple]:
        """(items, row of each word or -1, its times in each item, whether it has any), on the worker."""
        order = np.argsort(self.scale, kind="stable")
        out = []
        for which in np.array_split(order, -(-len(order) // GROUP)):
            used = np.unique(np.concatenate([self.words[k] for k in which]))
            local = np.full(len(self.vocabulary), -1, np.int32)
            local[used] = np.arange(len(used))
            times = np.zeros((len(used), len(which)), np.int16 if self.sizes[which].max() < 1 << 15 else np.int32)
            for c, k in enumerate(which):
                np.add.at(times[:, c], local[self.words[k]], 1)
            member = np.vstack([times > 0, np.zeros((1, len(which)), bool)]).view(np.uint8)
            out.append((which, local, times, member))
        return out

    @cached_property
    def openings(self) -> tuple[np.ndarray, dict[int, list[int]]]:
        """Hashes of the first three words of answers that are less than their item."""
        at: dict[int, list[int]] = {}
        for k, a in enumerate(self.said):
            if 3 <= len(a) < len(self.words[k]):
                at.setdefault(int(triples(a[:3])[0]), []).append(k)
        return np.array(sorted(at), np.int64), at


def triples(ids: np.ndarray) -> np.ndarray:
    """A hash of each three words in a row."""
    return ids[:-2] * np.int64(0x9E3779B97F4A7C1) + ids[1:-1] * np.int64(0xC2B2AE3D27D4EB) + ids[2:]


def lcs(a: np.ndarray, masks: dict[int, int], m: int, until: int | None = None) -> int:
    """Length of the longest common subsequence, bit-parallel; masks: positions in the item. With
    ``until``: the number of words of ``a`` after which it has that length."""
    v = full = (1 << m) - 1
    for i, x in enumerate(a.tolist()):
        if u := v & masks.get(x, 0):
            v = ((v + u) | (v - u)) & full
            if until is not None and m - v.bit_count() >= until:
                return i + 1
    return m - v.bit_count()


def positions(words: np.ndarray) -> dict[int, int]:
    """Bit mask of the places of each word."""
    masks: dict[int, int] = {}
    for i, x in enumerate(words.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def matched(a: np.ndarray, words: np.ndarray, masks: dict[int, int], length: int) -> tuple[int, int]:
    """(first, last + 1) of the part of ``a`` that ends first with a common subsequence of that length."""
    stop = lcs(a, masks, len(words), length)
    return stop - lcs(a[:stop][::-1], positions(words[::-1]), len(words), length), stop


def near(model: Model, space: Space, buckets: list[np.ndarray]) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Test of the leading dimensions for pairs of windows and items: whether the latent cosine of the
    blocks from ``start`` to ``stop`` with item ``k`` is NEAR or more, all texts laid out block by block."""
    sizes = np.array([len(x) for x in buckets])
    blocks = -(-sizes // BLOCK)
    inside = np.arange(sizes.sum()) + np.repeat(np.cumsum(blocks) * BLOCK - blocks * BLOCK - np.cumsum(sizes) + sizes, sizes)
    slots = np.full(int(blocks.sum()) * BLOCK, BUCKETS)  # the last row is empty
    slots[inside] = np.concatenate(buckets)
    rows = np.zeros((len(slots) // BLOCK + 1, space.leading.shape[1]), np.float64)
    block = np.zeros((len(rows) - 1, rows.shape[1]), np.float32)
    for i in range(BLOCK):
        block += space.leading.take(slots[i::BLOCK], axis=0)
    np.cumsum(block, axis=0, out=rows[1:])

    def test(start: np.ndarray, stop: np.ndarray, k: np.ndarray) -> np.ndarray:
        kept = np.zeros(len(start), bool)
        for part in np.array_split(np.arange(len(start)), len(start) // 65536 + 1):
            v = (rows[stop[part]] - rows[start[part]]).astype(np.float32)
            size = np.sqrt(np.einsum("ij,ij->i", v, v)) + 1e-12
            kept[part] = np.einsum("ij,ij->i", v, model.leading[k[part]]) >= NEAR * size
        return kept

    return test


def candidates(model: Model, texts: list[np.ndarray], same: float = SAME, space: Space | None = None, buckets: list[np.ndarray] | None = None) -> list[list[tuple]]:
    """For each text (word numbers) its (item, start, stop), windows of whole blocks of the item's
    length and one more, or of twice that length.

    All texts are laid out block by block. A common subsequence is no longer than the number of
    words of the window that stand in the item, nor than the words both share, each as often as
    the rarer side has it. Windows below ``same`` of the item by either bound go, or below
    WITH_ANSWER where the answer stands in them: no window that verify() accepts for its order is
    lost. With a ``space``, windows that share the words which verify() asks of these come too, if their
    latent cosine is NEAR.
    """
    out: list[list[tuple]] = [[] for _ in texts]
    sizes = np.array([len(x) for x in texts])
    blocks = -(-sizes // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))
    n = int(first[-1])
    if not n:
        return out
    owner = np.repeat(np.arange(len(texts)), blocks)
    ids = np.concatenate(texts)
    shift = np.repeat(first[:-1] * BLOCK - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    at = np.flatnonzero(ids >= 0)
    word, place = ids[at], at + shift[at]
    answers: dict[int, list[int]] = {}  # item: where its answer may start
    keys, items = model.openings
    if len(ids) > 2 and len(keys):
        h = triples(ids)
        i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        for p in np.flatnonzero(keys[i] == h).tolist():
            for k in items[int(h[p])]:
                answers.setdefault(k, []).append(int(p + shift[p]))
    full = np.maximum(1, np.ceil(same * model.sizes - 1e-9))
    less = np.maximum(1, np.ceil(min(same, WITH_ANSWER) * model.sizes - 1e-9))
    # reworded or reordered, a passage shares REWORDED or ``same`` of the words with the item
    least = np.maximum(1, np.ceil(min(same, REWORDED) * model.sizes - 1e-9))
    alike = near(model, space, buckets) if space is not None and model.places is not None else None
    for which, local, times, member in model.groups:
        row = local[word]
        mine = np.flatnonzero(row >= 0)
        if not len(mine):
            continue
        row, here = row[mine], place[mine]
        excess = _excess(row, here // BLOCK, n, times)
        slots = np.full(n * BLOCK, len(times), np.int32)  # the last row of member is empty
        slots[here] = row
        # running sums may wrap around: differences of one window fit
        kind = np.min_scalar_type(int(BLOCK * (2 * model.scale[which].max() - 1)))
        total = np.zeros((n + 1, len(which)), kind)
        for i in range(BLOCK):
            total[1:] += member.take(slots[i::BLOCK], axis=0)
        np.cumsum(total, axis=0, out=total)
        for scale in np.unique(model.scale[which]).tolist():
            cols = np.flatnonzero(model.scale[which] == scale)
            for wide in (False, True):
                stop = np.minimum(np.arange(n) + (2 * scale - 1 if wide else scale), first[owner + 1])
                many = total[:, cols[0] : cols[-1] + 1]  # items are in order of scale
                many = many[stop] - many[:-1]
                w, c = np.divmod(np.flatnonzero(many >= full[which[cols]].astype(kind)), len(cols))
                found = [(w, c, full[which[cols[c]]])]
                for j, k in enumerate(which[cols].tolist()) if not wide else ():
                    if k in answers:  # windows that hold the answer whole
                        p = np.array(answers[k])[:, None]
                        begin = np.unique((p // BLOCK - np.arange(scale)).clip(0))
                        begin = begin[many[begin, j] >= less[k]]
                        found.append((begin, np.full(len(begin), j), np.full(len(begin), less[k])))
                if not wide and alike:
                    begin, j = np.divmod(np.flatnonzero(many >= least[which[cols]].astype(kind)), len(cols))
                    more = alike(begin, stop[begin], which[cols[j]])
                    found.append((begin[more], j[more], least[which[cols[j[more]]]]))
                w, c, need = map(np.concatenate, zip(*found))
                few = many[w, c] - excess(w, stop[w], cols[c]) >= need
                w, c, need = w[few], c[few], need[few]
                if not len(w):
                    continue
                w, c = _shared(w, c, need, stop, row, here, times[:, cols])
                w, c = np.divmod(np.unique(w * len(cols) + c), len(cols))
                for i, j in zip(w.tolist(), c.tolist()):
                    d = int(owner[i])
                    start, end = ((int(x) - int(first[d])) * BLOCK for x in (i, stop[i]))
                    out[d].append((int(which[cols[j]]), start, min(end, int(sizes[d]))))
    return out


def _excess(row: np.ndarray, block: np.ndarray, n: int, times: np.ndarray) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """For windows and items: how often the COMMON commonest words of these texts stand in the window beyond the
    item's count, for the words that it has."""
    common = np.argsort(-np.bincount(row, minlength=len(times)), kind="stable")[:COMMON]
    column = np.full(len(times), -1)
    column[common] = np.arange(len(common))
    held = column[row] >= 0
    total = np.bincount((block[held] + 1) * len(common) + column[row[held]], minlength=(n + 1) * len(common))
    total = np.cumsum(total.reshape(n + 1, -1), axis=0, dtype=np.int32)
    most = np.where(times[common] > 0, times[common].astype(np.int32), np.iinfo(np.int32).max).T

    def more(start: np.ndarray, stop: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.maximum(total[stop] - total[start] - most[c], 0).sum(axis=1)

    return more


def _shared(w, c, need, stop, row, here, times):
    """Of the pairs of windows and items those with ``need`` words in common, counted on both sides."""
    windows, inverse = np.unique(w, return_inverse=True)
    a, z = np.searchsorted(here, windows * BLOCK), np.searchsorted(here, stop[windows] * BLOCK)
    size = z - a
    flat = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    key, held = np.unique(np.repeat(np.arange(len(windows)), size) * np.int64(len(times)) + row[flat], return_counts=True)
    edge = np.searchsorted(key, np.arange(len(windows) + 1) * np.int64(len(times)))
    key %= len(times)
    kept = np.zeros(len(w), bool)
    for part in np.array_split(np.arange(len(w)), len(w) // 65536 + 1):
        a, size = edge[inverse[part]], np.diff(edge)[inverse[part]]  # no window of a pair is empty
        new = np.concatenate(([0], np.cumsum(size)[:-1]))
        flat = np.repeat(a - new, size) + np.arange(size.sum())
        both = np.minimum(held[flat], times[key[flat], np.repeat(c[part], size)])
        kept[part] = np.add.reduceat(both, new) >= need[part]
    return w[kept], c[kept]


def verify(model: Model, ids: np.ndarray, found: list[tuple], same: float = SAME, space: Space | None = None, buckets: np.ndarray | None = None) -> list[tuple]:
    """(item, start, stop, cosine, overlap, answered) for each candidate that is the item."""
    out: list[tuple] = []
    best: dict[int, list] = {}
    masks: dict[int, dict[int, int]] = {}
    cosine = lambda k, x, y: float(space.place(buckets[x:y]) @ model.places[k]) if space is not None else 0.0
    for k, start, stop in sorted(found):
        words, passage = model.words[k], ids[start:stop]
        if k not in masks:
            masks[k] = positions(words)
        length = lcs(passage, masks[k], len(words))
        overlap = length / len(words)
        if overlap < min(same, REORDERED):
            continue
        said = f" {model.answers[k]} " in f" {' '.join(map(str, passage.tolist()))} "
        good = overlap >= same or said and overlap >= WITH_ANSWER
        if not good and space is not None:  # reworded in order, or the same words in another
            first, last = matched(passage, words, masks[k], length)
            good = overlap >= REWORDED and cosine(k, start + first, start + last) >= LATENT or model.shared(k, passage) >= same * len(words) and cosine(k, start, stop) >= LATENT
        if good:
            best.setdefault(k, []).append((overlap, start - stop, -start, stop, said, length))
    for k, hits in best.items():  # of overlapping windows the best, and of these the shortest
        taken: list[tuple[int, int]] = []
        for overlap, _, start, stop, said, length in sorted(hits, reverse=True):
            if all(stop <= x or -start >= y for x, y in taken):
                first, last = matched(ids[-start:stop], model.words[k], masks[k], length)
                out.append((model.items[k], first - start, last - start, cosine(k, -start, stop), overlap, said))
                taken.append((-start, stop))
    return out


def _frequencies(words: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, and documents: sums over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            df[BUCKETS] += b.num_rows
            for at in range(0, b.num_rows, 256):
                held = [np.frombuffer(x.as_py(), np.uint16) for x in b.column(0).slice(at, 256)]
                key = np.sort(np.repeat(np.arange(len(held), dtype=np.int32) * np.int32(BUCKETS), list(map(len, held))) + np.concatenate(held))
                if len(key):
                    df[:BUCKETS] += np.bincount(key[starts(key)] % BUCKETS, minlength=BUCKETS)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["bucket", "n"])

    rows = words.where("document").select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:  # at most BUCKETS + 1
        df[r.bucket] = r.n
    return df[:BUCKETS], int(df[BUCKETS])


def passages(texts: Iterator[bytes], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(passage, bucket, weight), by passage: the entries of unit TF-IDF vectors of some PASSAGES passages
    of PASSAGE words, of texts given as their words' buckets. No passage crosses texts."""
    held, n = [], 0

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in held])
        each = -(-sizes // PASSAGE)
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = (np.repeat(np.cumsum(each) - each, sizes) + inside // PASSAGE).astype(np.int32) * np.int32(BUCKETS)
        key = np.sort(key + np.concatenate(held))
        first = starts(key)
        passage, bucket = np.divmod(key[first], BUCKETS)
        w = np.diff(first, append=len(key)) * idf[bucket]
        edge = starts(passage)
        size = np.maximum(np.sqrt(np.add.reduceat(w * w, edge)), 1e-12)
        return passage, bucket, (w / size[passage]).astype(np.float32)

    for raw in texts:
        x = np.frombuffer(raw, np.uint16)
        for at in range(0, len(x), PASSAGE * PASSAGES):
            held.append(x[at : at + PASSAGE * PASSAGES])
            n += -(-len(held[-1]) // PASSAGE)
            if n >= PASSAGES:
                yield made()
                held, n = [], 0
    if n:
        yield made()


def starts(key: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))


def add_sums(out: np.ndarray, key: np.ndarray, at: np.ndarray, w: np.ndarray, rows: np.ndarray) -> None:
    """Adds to ``out[k]`` the sum of ``w * rows[at]`` over the entries of key k; keys ascend. Sums are made in
    the type of ``out``, for all keys of as many entries at once."""
    first = starts(key)
    size = np.diff(first, append=len(key))
    order = np.argsort(size, kind="stable")
    for same in np.split(order, starts(size[order])[1:]):
        n = int(size[same[0]])
        for part in np.array_split(same, len(same) * n // 4096 + 1):
            i = first[part][:, None] + np.arange(n)
            held = rows.take(at.take(i), axis=0).astype(out.dtype, copy=False)
            out[key[first[part]]] += np.matmul(w.take(i)[:, None].astype(out.dtype), held)[:, 0]


def _space(docs: DataFrame, benchmark: DataFrame, rank: int) -> Space:
    """The latent space: leading right singular vectors of the TF-IDF matrix A of the passages of all
    documents and all items, by randomised subspace iteration. Words are read once, as buckets of two
    bytes; each product A'(AX) is a sum over partitions of all passages. After q = orth(A'A X) for a random
    X, y = A'A q gives the Nystroem form y (q'y)^-1 y' of A'A, whose eigenvectors are the space. It does
    not depend on in which slice an item is. Sums over passages are in double precision and q is rounded to
    a grid, so that their order does not show."""
    sc = docs.sparkSession.sparkContext

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, found in chunks(b.column(0)):
                edge, n = found.edge.astype(np.int32) * 2, len(found.edge) - 1
                held = [None, pa.py_buffer(edge), pa.py_buffer((found.hashes % BUCKETS).astype(np.uint16))]
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), n, held), b.column(1).slice(first, n)], ["buckets", "document"])

    texts = docs.select("text", F.lit(True).alias("document")).unionByName(benchmark.select(F.col("text").cast("binary").alias("text"), F.lit(False).alias("document")))
    held = Stored(texts.mapInArrow(words, "buckets binary, document boolean"))
    space = Space(*_frequencies(held.rows))
    idf = sc.broadcast(space.idf)  # BUCKETS numbers

    def product(x: np.ndarray) -> np.ndarray:
        sent = sc.broadcast(x.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(sent.value.shape)
            for passage, bucket, w in passages((t.as_py() for b in batches for t in b.column(0)), idf.value):
                placed = np.zeros((passage[-1] + 1, out.shape[1]), np.float32)
                add_sums(placed, passage, bucket, w, sent.value)
                order = np.argsort(bucket.astype(np.uint16), kind="stable")
                add_sums(out, bucket[order], passage[order], w[order], placed)
            live = np.flatnonzero(out.any(axis=1))
            for at in np.array_split(live, len(live) // 2048 + 1):
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * out.shape[1]), pa.array(out[at].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(at), v], ["bucket", "v"])

        # a task for each core: what is shuffled is BUCKETS rows a task
        parts = held.rows.select("buckets").coalesce(sc.defaultParallelism).mapInArrow(run, "bucket long, v array<double>")
        total = np.zeros(x.shape)
        sums = parts.groupBy("bucket").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(x.shape[1])]).alias("v"))
        for r in sums.toLocalIterator():  # BUCKETS rows at most
            total[r.bucket] = r.v
        sent.destroy()
        return total

    q = np.linalg.qr(product(np.random.default_rng(7).standard_normal((BUCKETS, rank + 8))))[0]
    q *= 2.0**22  # rounded, in place, to what single precision holds too
    np.round(q, out=q)
    q /= 2.0**22
    y = product(q)
    held.drop()
    idf.destroy()
    e, u = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
    del q
    live = e > max(e[-1], 0) * 1e-9
    y = y @ (u[:, live] / np.sqrt(e[live]))
    space.project(np.linalg.svd(y, full_matrices=False)[0][:, :rank])
    return space


def find(docs: DataFrame, benchmark: DataFrame, same: float = SAME, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, start, stop, cosine, overlap, answered): benchmark items found in documents.

    Every passage of every whole text is compared with every item. Start and stop count words
    that are more than marks. An item counts as found where ``same`` of its words stand in order, in
    a window of its length in blocks of BLOCK words and one more or of twice that length; or
    WITH_ANSWER of them and its answer (last sentence) word for word; or REWORDED of them where the
    part that they span has a latent cosine of LATENT or more; or REORDERED of them in a window
    that has that cosine and ``same`` of the words in any order. ``rank`` 0 leaves the latent space out.

    The benchmark is the stated query set. It is read in slices of ITEMS items or ITEM_CHARS
    characters, each one pass over the documents, so what is broadcast stays bounded; all slices
    share one latent space, and the documents are never shuffled. Null or empty items find
    nothing, null texts hold nothing, null ids are carried. Rows that repeat are found each. Other
    columns are ignored. Empty tables: empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    parts = [_search_all(rows, held, same) for held in _models(rows, benchmark, rank)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], FOUND)


def _models(rows: DataFrame, benchmark: DataFrame, rank: int) -> Iterator[tuple]:
    """(space, model), both broadcast, for each slice of the benchmark; rank 0: no space."""
    sc = rows.sparkSession.sparkContext
    size = benchmark.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    slices = max(1, -(-size.n // ITEMS), -(-size.chars // ITEM_CHARS))
    space = _space(rows, benchmark, rank) if rank and size.chars else None
    held = sc.broadcast(space)  # BUCKETS x RANK numbers
    for i in range(slices):
        chosen = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i).select(F.col("item_id").cast("long"), "text")
        model = Model(sorted(((r.item_id, r.text) for r in chosen.toLocalIterator()), key=str), space)
        if model.items:
            yield held, sc.broadcast(model)


def _hits(held: tuple, texts: pa.Array, same: float) -> Iterator[tuple[int, list[tuple]]]:
    """(row, items found in it) for the rows of a batch that hold any, CHUNK bytes at a time."""
    space, model = (x.value for x in held)
    for first, words in chunks(texts):
        ids = words.per_text(model.lookup.numbers(words))
        buckets = words.per_text((words.hashes % BUCKETS).astype(np.int64)) if space is not None else [None] * len(ids)
        for j, (x, y, some) in enumerate(zip(ids, buckets, candidates(model, ids, same, space, buckets)), first):
            if some and (hits := verify(model, x, some, same, space, y)):
                yield j, hits


def _search_all(rows: DataFrame, held: tuple, same: float) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("cosine", pa.float64()), ("overlap", pa.float64()), ("answered", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            out = [(doc_ids[i], *x) for i, found in _hits(held, b.column(1), same) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return rows.mapInArrow(run, FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, same: float = SAME, rank: int = RANK) -> DataFrame:
    """The rows of ``docs`` in which ``find`` finds no item, all columns.

    Each row is judged by its own text and passed on or not where it is read: no join, no
    shuffle, and rows with a null or repeated doc_id are judged like any other. Null and empty
    texts stay. Empty tables: no rows, or all of them.
    """
    at = docs.columns.index("text")

    def passing(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                stays = np.ones(b.num_rows, bool)
                stays[[i for i, _ in _hits(held, b.column(at), same)]] = False
                yield b.filter(pa.array(stays))

        return run

    kept = docs
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    for held in _models(rows, benchmark, rank):
        kept = kept.mapInArrow(passing(held), docs.schema)
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
