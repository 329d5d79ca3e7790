"""Operator 9: embedding near-duplicates through int8 tiles with exact error bounds.

Vectors are quantised once. Tile products see the int8 codes only, an eighth of the bytes; their
bounds settle nearly all pairs. Doubles are fetched for the rows of a tile pair that have a pair
the bounds leave open, and only those pairs are computed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, connected_components, labels_of, table

COSINE = 0.98
TILE = 2048
_CHUNK = 1 << 18
_PAIRS = 1 << 15
_PAIR = "label {label}, d int, i int, j int"
_KEY = ["label", "d", "i", "j"]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which is exact, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, norm of the coded vector, norm of the error) of the rows' unit vectors."""
    x = scaled(x)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(x - coded, axis=1)


def bounded_pairs(x: tuple, y: tuple, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sure) of the pairs of two tiles whose cosine may reach ``least``, a chunk at a time.

    A tile is (codes, scale, norm, error). The cosine differs from the product of the codes by at
    most |cx||ey| + |ex||cy| + |ex||ey| (Cauchy-Schwarz on the errors): ``sure`` pairs reach it
    by their lower bound. Codes multiply exactly in float32 up to 1040 components, beyond in
    float64.
    """
    (cx, sx, nx, ex), (cy, sy, ny, ey) = x, y
    kind = np.float32 if cx.shape[1] <= 1040 else np.float64
    fy = cy.astype(kind).T
    rows = max(1, _CHUNK // max(1, len(cy)))
    for at in range(0, len(cx), rows):
        to = at + rows
        dots = (cx[at:to].astype(kind) @ fy) * (sx[at:to, None] * sy)
        slack = nx[at:to, None] * ey + ex[at:to, None] * (ny + ey) + 1e-9
        i, j = np.nonzero(dots + slack >= least)
        yield i + at, j, (dots - slack)[i, j] >= least


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, int]:
    """Rows in order, and how many stand on side 1; 0 if a tile meets itself, -1 if one is empty."""
    sides = set(pdf["side"])
    if sides in ({1}, {2}):
        return pdf, -1
    return pdf.sort_values(["side", "node"], kind="stable"), int((pdf["side"] == 1).sum())


def _tiles(pdf: pd.DataFrame, split: int) -> tuple[tuple, tuple]:
    codes = np.frombuffer(b"".join(pdf["codes"]), np.int8).reshape(len(pdf), -1)
    whole = (codes, *(pdf[c].to_numpy() for c in ("scale", "norm", "error")))
    return (whole, whole) if not split else (tuple(z[:split] for z in whole), tuple(z[split:] for z in whole))


def _compare(least: float, exact: bool):
    """One pair of tiles: (n > 0) link counts of ``a``, edges a-b of a star per component, and, in
    the first pass, ``ask``: rows that have a pair which the bounds leave open."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, split = _sides(pdf)
        none = np.zeros(0, np.int64)
        if split < 0:
            return _result(pdf, none, none, none, none, none, none)
        node, many, n = pdf["node"].to_numpy(), pdf["many"].to_numpy(), len(pdf)
        v = scaled(np.stack(pdf["v"].to_numpy())) if exact else None
        norm = np.linalg.norm(v, axis=1) if exact else None
        lab, count, open_ = np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
        for i, j, sure in bounded_pairs(*_tiles(pdf, split), least):
            j = j + split
            if not split:
                i, j, sure = i[i < j], j[i < j], sure[i < j]
            if exact:  # the first pass has counted the sure ones
                i, j, good = i[~sure], j[~sure], np.zeros((~sure).sum(), bool)
                for at in range(0, len(i), _PAIRS):
                    p, q = i[at : at + _PAIRS], j[at : at + _PAIRS]
                    good[at : at + _PAIRS] = np.einsum("ij,ij->i", v[p], v[q]) / (norm[p] * norm[q]) >= least
            else:
                open_[i[~sure]] = open_[j[~sure]] = True
                good = sure
            i, j = i[good], j[good]
            np.add.at(count, i, many[j])
            np.add.at(count, j, many[i])
            lab = labels_of(n, i, j, lab)
        linked, moved = np.flatnonzero(count), np.flatnonzero(lab != np.arange(n))
        return _result(pdf, node[linked], count[linked], node[moved], node[lab[moved]], node[open_], pdf["side"].to_numpy()[open_])

    return run


def _result(pdf, a, n, moved, to, asked, side) -> pd.DataFrame:
    size = len(a) + len(moved) + len(asked)
    zero = lambda *x: np.concatenate([np.asarray(z, np.int64) for z in x])
    out = {c: np.repeat(pdf[c].iloc[:1].to_numpy(), size) for c in _KEY}
    out["a"] = zero(a, moved, asked)
    out["b"] = zero(a, to, asked)
    out["n"] = zero(n, np.zeros(len(moved)), np.zeros(len(asked)))
    out["ask"] = zero(np.full(len(a) + len(moved), -1), side)
    return pd.DataFrame(out)


def _coded(reps: DataFrame) -> DataFrame:
    """``reps`` (node, v, ...) with int8 codes, scale, norm and error; each vector quantised once."""
    at = reps.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(at)
            size, flat = pc.list_value_length(v).to_numpy(), v.flatten().to_numpy()
            first = np.cumsum(size) - size
            codes, numbers = [b""] * len(v), np.zeros((3, len(v)))
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                x = flat[first[rows][:, None] + np.arange(d)].astype(np.float64)
                q, *numbers[:, rows] = quantise(x)
                for r, c in zip(rows.tolist(), q):
                    codes[r] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary()), *map(pa.array, numbers)], [*b.schema.names, "codes", "scale", "norm", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reps.schema.fields)
    return reps.mapInArrow(run, f"{kinds}, codes binary, scale double, norm double, error double")


def near_duplicates(vectors: DataFrame, least: float = COSINE, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors``.

    Vectors are compared within a label (and a length) only. Equal vectors collapse to one
    representative that carries their number. A label's representatives are dealt to tiles of
    about ``tile`` rows by hash, and every pair of tiles is one task's work: a label with a
    third of all rows is dealt over many tasks, and none holds more than two tiles. A pair
    of tiles returns link counts and a spanning star of its components, never its pairs.

    Nulls: vectors that are null, empty or zero or hold null or non-finite components, and
    those without a label, link with nothing; so does a null vec_id. Rows that repeat a vec_id
    count as vectors of their own, each with its own links and component; the component is
    named by its smallest vec_id. Other columns are ignored. Empty table: empty result.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v")
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    )
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # zero is one value, whatever its sign
    good = rows.where("usable").select("vec_id", "label", F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x)).alias("v"))
    reps = good.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"))
    # the written table fixes the number of each representative
    reps = Stored(_coded(reps.withColumns({"node": F.monotonically_increasing_id(), "d": F.size("v")}))).rows
    sizes = reps.groupBy("label", "d").agg(F.ceil(F.count("*") / tile).cast("int").alias("t"))
    dealt = reps.drop("v", "least").join(sizes, ["label", "d"])
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("t")).cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), F.col("t") - 1),
        lambda o: F.struct(
            F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j"),
            F.when(o == F.col("mine"), 0).when(F.col("mine") < o, 1).otherwise(2).alias("side"),
        ),
    )
    dealt = dealt.withColumn("o", F.explode(others)).select("label", "d", "o.*", "node", "many", "codes", "scale", "norm", "error")
    kinds = _PAIR.format(label=dict(rows.dtypes)["label"]) + ", a long, b long, n long, ask int"
    found = Stored(dealt.groupBy(*_KEY).applyInPandas(_compare(least, False), kinds)).rows
    asked = found.where("ask >= 0").select(*_KEY, F.col("a").alias("node"), F.col("ask").alias("side"))
    again = asked.join(reps.drop("label", "d", "least"), "node")
    open_ = Stored(again.groupBy(*_KEY).applyInPandas(_compare(least, True), kinds)).rows
    both = found.where("ask < 0").unionByName(open_)
    comp = connected_components(both.select("a", "b"))
    links = both.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    named = (
        reps.select("node", "label", "v", "least", "many").join(links, F.col("node") == F.col("a"), "left").drop("a")
        .join(comp.withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left")
        .withColumn("root", F.coalesce("component", "node"))
    )
    name = named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    named = named.join(name, F.col("root") == F.col("r")).select(
        F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id"
    )
    members = good.join(named, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::double[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), r AS (SELECT a AS vec_id, b AS seen FROM p UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.seen = p.a),
c AS (SELECT vec_id, min(least(vec_id, seen)) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT t.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, t.vec_id) AS component_id,
       coalesce(component_id, t.vec_id) = t.vec_id AS kept
FROM embeddings t LEFT JOIN n ON n.vec_id = t.vec_id LEFT JOIN c ON c.vec_id = t.vec_id
"""
