"""Operator 11: vectors compressed to codes of four bytes by integer product quantisation.

Components become integers and vectors are cut into parts; each part has a codebook, fitted in
a few rounds of nearest entries and means. The nearest entry is found by partial distances:
dimensions are added in descending variance of the codebook, and an entry is dropped as soon as
its sum so far is above the best complete distance known for the vector. All arithmetic is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, join_heavy, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
_ROWS = 1024
#: Dimensions added between two looks at which entries can go.
_STEP = 4


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of ``book`` for each row; ties to the lower index.

    An entry is dropped only when its partial distance strictly exceeds a complete distance, so
    the nearest entry and all that tie with it stay to the end.
    """
    rows, width, size = len(x), x.shape[1], len(book)
    spread = size * (book * book).sum(axis=0) - book.sum(axis=0) ** 2
    dims = np.argsort(-spread, kind="stable")
    complete = lambda row, entry: ((x[row] - book[entry]) ** 2).sum(axis=1)
    far = np.zeros((rows, size), np.int64)
    for d in dims[:_STEP]:
        far += (x[:, d, None] - book[None, :, d]) ** 2
    best = complete(np.arange(rows), far.argmin(axis=1))
    row, entry = np.nonzero(far <= best[:, None])
    far = far[row, entry]
    for at in range(_STEP, width, _STEP):
        for d in dims[at : at + _STEP]:
            far += (x[row, d] - book[entry, d]) ** 2
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        lead = np.minimum.reduceat(far, first)
        if at + _STEP < width:  # the leader so far may give a smaller complete distance
            leader = _first_equal(far, lead, first, len(row))
            best = np.minimum(best, complete(row[leader], entry[leader]))
            stay = far <= best[row]
            row, entry, far = row[stay], entry[stay], far[stay]
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    lead = np.minimum.reduceat(far, first)
    return entry[_first_equal(far, lead, first, len(row))], lead


def _first_equal(values: np.ndarray, lead: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Place of the first value of each group that equals the group's ``lead``."""
    hit = np.flatnonzero(values == np.repeat(lead, np.diff(np.append(first, n))))
    return hit[np.searchsorted(hit, first)]


def _assigned(batches: Iterator[pa.RecordBatch], at: int, books: list[np.ndarray]) -> Iterator[tuple]:
    """(batch, vectors, indexes, distances) for some rows at a time; the vectors are column ``at``."""
    width = books[0].shape[1]
    for whole in batches:
        for lo in range(0, whole.num_rows, _ROWS):
            b = whole.slice(lo, _ROWS)
            x = b.column(at).flatten().to_numpy().reshape(b.num_rows, -1).astype(np.int64)
            found = [nearest(x[:, p * width : (p + 1) * width], book) for p, book in enumerate(books)]
            yield b, x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(part, entry, n, s0, s1, ...): number and sums of the parts nearest to each entry; a task sends a row an entry."""
    held = rows.sparkSession.sparkContext.broadcast(books)  # size set by parameters
    parts, (size, width) = len(books), books[0].shape
    at = rows.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for _, x, code, _ in _assigned(batches, at, held.value):
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=size)
                np.add.at(s[p], code[:, p], x[:, p * width : (p + 1) * width])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), *(pa.array(s[p, e, d]) for d in range(width))],
            ["part", "entry", "n", *(f"s{d}" for d in range(width))],
        )

    sums = [f"s{d}" for d in range(width)]
    made = rows.mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"{c} long" for c in sums))
    return made.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *sums)])


def _coded(rows: DataFrame, books: list[np.ndarray], label: str) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(books)  # size set by parameters
    at = rows.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, code, far in _assigned(batches, at, held.value):
            text = [bytes(c).hex() for c in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text), pa.array(far.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part. ``rows`` (vec_id, x), x as long as ``parts`` times some width.
    The driver sees ``entries`` vectors, and a row for each part and entry in each round."""
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    if not start:
        return [np.zeros((0, 1), np.int64)] * parts
    books = list(np.array([r.x for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        new = [b.copy() for b in books]
        for part, entry, n, *s in _sums(rows, books).collect():
            new[part][entry] = np.array(s, np.int64) // n
        books = new
    return books


def _integers(scale: int, parts: int, dims: int) -> Column:
    """Floors of the scaled components, with zeros up to a multiple of ``parts``. They are held to a
    bound within which squared distances of whole vectors fit a long."""
    most = float(2 ** ((62 - max(dims, 1).bit_length()) // 2 - 1))
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(most)), F.lit(-most))).cast("int" if most < 2**31 else "long"))
    return F.concat(whole, F.array_repeat(F.lit(0), max(-dims % parts, parts - dims if dims < parts else 0)))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256), a row for each vector kept.

    Vectors that are null or hold null or non-finite components are dropped, and so are those
    whose length is not the commonest one (of equally common, the longer). A length that ``parts``
    does not divide is filled up with zeros. Integers beyond about 2^26 (fewer for more
    dimensions) are held to that bound, where distances would leave a long. Of rows that repeat a
    vec_id those with the smaller integers come first; null ids come last. Null labels
    are one label. With fewer than ``entries`` vectors the codebooks have as many entries. Other
    columns are ignored. Empty table: empty result.

    The integers are written once and read in each round; what moves is a row a task, part and
    entry. Sums over a label are joined back with its heavy values apart.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", finite))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = usual.d if usual else 0
    rows = rows.where(F.size("v") == dims).select("vec_id", "label", _integers(scale, parts, dims).alias("x"))
    whole = Stored(rows)
    books = codebooks(whole.rows, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))  # null is a key of its own
    coded = Stored(_coded(whole.rows, books, dict(rows.dtypes)["label"]).withColumn("key", key))
    whole.drop()
    totals = Stored(coded.rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("many")))
    out = join_heavy(coded.rows, totals.rows, ["key"], "many")
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


def _sql() -> str:
    out = """
WITH e AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT i, part, list_slice(x, part * len(x) // 4 + 1, (part + 1) * len(x) // 4) AS x FROM e, (SELECT unnest([0, 1, 2, 3]) AS part)
), c0 AS (SELECT part, i - 1 AS entry, x AS c FROM p WHERE i <= 256)"""
    for r in range(5):
        out += f""", a{r} AS (
  SELECT i, part, any_value(x) AS x, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::bigint * 256 + entry) AS best
  FROM p JOIN c{r} USING (part) GROUP BY i, part
)"""
        if r < 4:
            out += f""", v{r} AS (SELECT part, best % 256 AS entry, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{r}),
m{r} AS (SELECT part, entry, pos, floor(sum(v) / count(*)) AS v FROM v{r} GROUP BY part, entry, pos),
n{r} AS (SELECT part, entry, list(v ORDER BY pos) AS c FROM m{r} GROUP BY part, entry),
c{r + 1} AS (SELECT c{r}.part, c{r}.entry, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (part, entry))"""
    return (
        out
        + """, f AS (
  SELECT i, string_agg(lpad(lower(hex(best % 256)), 2, '0'), '' ORDER BY part) AS code, sum(best // 256)::bigint AS error FROM a4 GROUP BY i
), b AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::bigint), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256 FROM e JOIN f USING (i), b
"""
    )


SQL = _sql()
