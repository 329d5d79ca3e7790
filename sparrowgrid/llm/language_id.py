"""Operator 7: language identification with bit-sliced Bloom filters of n-grams.

Slot i of the filter is a bitmask of languages (a 64-bit word for each 64 of them), so the k
slots of an n-gram, and-ed together, are all languages that contain it. A text's score for a language is the share of its n-grams
whose mask has the language's bit, corrected for the filter's false-positive rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

SLOTS = 1 << 20
HASHES = 3
#: An n-gram belongs to a language if it makes up this share of its n-grams at least: at most
#: 1 / SHARE n-grams a language, whatever the corpus.
SHARE = 2e-5
#: ... and this part of the share that it has in the language where it is most common.
RATIO = 0.05
#: More values than that are no languages, and an error; the filter takes 8 MB for each 64.
MOST_LANGS = 4096
_CHARS = 1 << 20

_tables: list[np.ndarray] = []


def _lower() -> np.ndarray:
    """Code point -> code point of its lower-case letter, 0 for what is no letter."""
    if not _tables:
        out = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _tables.append(out)
    return _tables[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, and the number of each text.

    Four characters of which the inner two are letters, and three around a letter that stands
    alone; what is no letter counts as one kind of character.
    """
    raw = np.frombuffer(("\0\0" + "\0\0".join(texts) + "\0\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _lower()[raw].astype(np.uint64)
    p = np.uint64(0x9E3779B97F4A7C15)
    two = (c[:-1] + np.uint64(1)) * p + c[1:]
    four = two[:-2] * p + two[2:]
    letter = c != 0
    inner = letter[1:-2] & letter[2:-1]
    alone = letter[1:-2] & ~letter[:-3] & ~letter[2:-1]
    at = np.flatnonzero(inner | alone)
    h = mix(np.where(inner[at], four[at], c[at + 1] * p + np.uint64(7)))
    ends = np.cumsum([len(t) + 2 for t in texts])
    return h, np.diff(np.searchsorted(at, ends - 1), prepend=0)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of about _CHARS characters, so that memory follows neither rows nor batches."""
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= _CHARS or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, h, n): n-grams of each language, summed within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}

        def fold(parts: list) -> tuple[np.ndarray, np.ndarray]:
            h, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            return h, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch, texts in _texts(batches, 1):
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs):
                h, _ = ngrams([t for t, x in zip(texts, langs) if x == lang])
                parts = sums.setdefault(lang, [])
                parts.append(np.unique(h, return_counts=True))
                if len(parts) > 8:
                    sums[lang] = [fold(parts)]
        for lang, parts in sums.items():
            h, n = fold(parts)
            for at in range(0, len(h), 65536):
                part = slice(at, at + 65536)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(h[part])), pa.array(h[part].view(np.int64)), pa.array(n[part])], ["lang", "h", "n"]
                )

    return docs.select("lang", "text").mapInArrow(run, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, slots, false-positive rate of each language) from all rows of (lang, text).

    The driver gets the filled slots: at most SLOTS numbers for each 64 languages, whatever the
    corpus. Null languages are not learned, null texts have no n-grams. Rows that repeat count
    each. Empty table: no languages.
    """
    counts = gram_counts(docs.where("lang is not null"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = sorted(r.lang for r in totals.select("lang").limit(MOST_LANGS + 1).collect())
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} values of lang")
    words = -(-len(langs) // 64) or 1
    bits = [(name, i // 64, 1 << i % 64 if i % 64 < 63 else -(1 << 63)) for i, name in enumerate(langs)]
    bits = docs.sparkSession.createDataFrame(bits, "lang string, word int, bit long")
    known = F.broadcast(totals.join(bits, "lang"))  # <= MOST_LANGS rows
    shared = counts.join(known, "lang").withColumn("share", F.col("n") / F.col("total"))
    kept = shared.where(F.col("share") >= SHARE).withColumn("most", F.max("share").over(W.partitionBy("h")))
    grams = kept.where(F.col("share") >= RATIO * F.col("most")).groupBy("h", "word").agg(F.bit_or("bit").alias("mask"))
    slots = np.zeros((words, SLOTS), np.uint64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            rest = [pa.array(np.tile(c.to_numpy(), HASHES)) for c in b.columns[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(h))), *rest], ["slot", "word", "mask"])

    filled = grams.mapInArrow(place, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    slots[filled["word"].to_numpy(), filled["slot"].to_numpy()] = filled["mask"].to_numpy().astype(np.int64).view(np.uint64)
    fill = np.array([((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
    return langs, slots, fill**HASHES


def _places(h: np.ndarray) -> list[np.ndarray]:
    """Slots of each hash: its bits, taken 20 at a time."""
    return [((h >> np.uint64(20 * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` (any columns, text among them) with lang_pred and score.

    lang_pred is the language with the largest corrected share (ties: the first by name);
    'und', score 0, if the text is null or has no letter, or nothing was learned. Columns that
    are named like the results give way to them. Repeated rows stay; an empty table gives no rows.
    """
    langs, slots, wrong = model
    held = docs.sparkSession.sparkContext.broadcast((langs, slots, wrong))  # 8 MB for each 64 languages, whatever the corpus
    other = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    rows = docs.select("text", *other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, slots, wrong = held.value
        for batch, texts in _texts(batches, 0):
            h, n = ngrams(texts)
            places = _places(h)
            mask = np.stack([np.bitwise_and.reduce([word[p] for p in places]) for word in slots])
            ends = np.cumsum(n)
            shares = np.zeros((len(langs), len(texts)))
            for i in range(len(langs)):
                hits = np.concatenate(([0], np.cumsum((mask[i // 64] >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)))
                seen = (hits[ends] - hits[ends - n]) / np.maximum(n, 1)
                shares[i] = (seen - wrong[i]) / max(1 - wrong[i], 1e-9)
            best = shares.argmax(axis=0) if langs else np.zeros(len(texts), int)
            known = (n > 0) & bool(langs)
            pred = [langs[b] if k else "und" for b, k in zip(best, known)]
            score = np.where(known, np.clip(shares.max(axis=0), 0, 1), 0.0) if langs else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*other, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}{', ' if kinds else ''}lang_pred string, score double")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
