"""Operator 6: mix sources to target weights by entropy balancing. DataFrame functions only."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2.0
#: Rows of one (source, size) cell that one task ranks; larger cells are dealt by hash.
CELL = 256
ROUNDS = 80
STARTS = 32


def word_count(c) -> F.Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, total, target) from (source, total): shares of ``budget`` times all totals.

    Weights go by code point order of the sources, null last. Where a share exceeds ``most``
    times the source, it stops there and the excess is shared anew by weight. The fixed point
    of that resharing has a closed form: with sources ordered by cap over weight, those capped
    are a prefix, and one level fills the others. The windows run over one row per source.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    fill = W.orderBy("ratio", F.col("source").isNull(), "source")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    s = sources.withColumn(
        "w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    )
    s = s.withColumn("cap", F.col("total") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    s = s.withColumn("sum", F.sum("total").over(W.partitionBy()) * budget).withColumn("ws", F.sum("w").over(W.partitionBy()))
    s = s.withColumn(
        "level",
        (F.col("sum") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("ws") - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    )
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(W.partitionBy())
    return s.select("source", "total", F.coalesce(F.least("cap", F.col("w") * level), F.col("cap")).alias("target"))


def exact(c: F.Column) -> F.Column:
    """A sum that does not depend on the order of its terms, so that reruns agree to the last bit."""
    return F.sum(c.cast("decimal(32,8)")).cast("double")


def solve_tilts(cells: DataFrame, goals: DataFrame, most: float = MOST, rounds: int = ROUNDS) -> DataFrame:
    """(source, total, target, unit, tilt): Newton on the convex dual, all sources at once.

    The rate of a document of size x is min(most, exp(tilt * x / unit)): the rates closest to
    1 in relative entropy whose words meet the source's target. The dual separates by source
    and its gradient, words minus target, grows with the tilt. A round is one join and one
    aggregation over (source, size, n); a Newton step that leaves the bracket is halved. The
    only thing the driver sees is how many sources have not met their target yet.
    """
    state = goals.withColumn("unit", F.greatest(F.col("mean"), F.lit(1.0))).drop("mean")
    state = state.withColumns({"tilt": F.lit(0.0), "lo": F.lit(-1e6), "hi": F.lit(1e6)})
    state = cut(state.withColumn("open", (F.col("target") > 0) & (F.col("target") < F.col("total") * most * (1 - 1e-12))))
    for i in range(rounds):
        x = F.col("size") / F.col("unit")
        power = x * F.col("tilt")
        free = power < F.log(F.lit(most))
        rate = F.when(free, F.exp(F.least(power, F.lit(700.0)))).otherwise(most)
        sums = (
            cells.join(state.where("open").select(F.col("source").alias("s"), "unit", "tilt"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s")
            .agg(
                exact(F.col("n") * F.col("size") * rate).alias("got"),
                exact(F.when(free, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"),
            )
        )
        short = F.col("got") < F.col("target")
        lo, hi = F.when(short, F.col("tilt")).otherwise(F.col("lo")), F.when(short, F.col("hi")).otherwise(F.col("tilt"))
        step = F.col("tilt") - F.try_divide(F.col("got") - F.col("target"), F.col("slope"))
        met = F.abs(F.col("got") - F.col("target")) <= 1e-9 * F.col("target")
        state = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").withColumns({"lo2": lo, "hi2": hi})
        inside = (step > F.col("lo2")) & (step < F.col("hi2"))
        state = cut(
            state.select(
                "source", "total", "target", "unit",
                F.when(F.col("open") & ~F.coalesce(met, F.lit(True)), F.when(inside, step).otherwise((F.col("lo2") + F.col("hi2")) / 2))
                .otherwise(F.col("tilt")).alias("tilt"),
                F.when(F.col("open"), F.col("lo2")).otherwise(F.col("lo")).alias("lo"),
                F.when(F.col("open"), F.col("hi2")).otherwise(F.col("hi")).alias("hi"),
                (F.col("open") & ~F.coalesce(met, F.lit(True))).alias("open"),
            )
        )
        if state.where("open").isEmpty():
            break
    else:
        warnings.warn(f"some sources are off their target after {rounds} rounds")
    return state


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = 2, cell: int = CELL) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) for each row of ``docs``.

    Sizes are counted once and cut; the text never moves. Rates depend only on (source,
    size), so the Newton rounds run over those cells. Rounding is systematic: documents lie
    on a line by (size, hash of doc_id) within their source, each as long as its rate, and
    each gets the whole marks that it covers. A prefix of the line is then never off by more
    than one copy, so a source's words are within twice its longest document of the target;
    of ``STARTS`` first marks each source takes the one that comes nearest.
    The rank that this needs inside a cell comes from hash buckets of about ``cell`` rows and
    their running counts, so a hot cell is dealt over many tasks.

    Nulls: a null text has size 0; a null source is a source of its own, last in order; a null
    doc_id ranks by its hash like any other. Rows alike in doc_id, source and size are
    interchangeable. All sizes 0: targets 0. Empty table: empty result.
    """
    sizes = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    cells = cut(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    sums = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("total"), F.sum("n").alias("rows"))
    goals = targets(sums.select("source", "total"), weights, budget, most)
    goals = goals.join(
        sums.select(F.col("source").alias("s"), (F.col("total") / F.col("rows")).alias("mean")), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")
    state = solve_tilts(cells, goals, most).withColumnRenamed("source", "s").drop("lo", "hi", "open")
    power = F.col("tilt") * F.col("size") / F.col("unit")
    rate = (
        F.when(F.col("target") >= F.col("total") * most * (1 - 1e-12), F.lit(float(most)))
        .when(F.col("target") <= 0, F.lit(0.0))
        .otherwise(F.least(F.lit(float(most)), F.exp(F.least(power, F.lit(700.0)))))
    )
    line = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    rated = (
        cells.join(state, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("rate", rate)
        .withColumn("at", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(line), F.lit(0.0)))
        .select(
            F.col("source").alias("s"), F.col("size").alias("z"), "rate", (F.col("at") - F.floor("at")).alias("at"), "target",
            F.col("total").alias("source_size"), F.ceil(F.col("n") / cell).cast("long").alias("parts"),
        )
    )
    placed = cut(
        sizes.join(rated, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
        .withColumn("h", F.xxhash64("doc_id"))
        .withColumn("part", F.pmod("h", "parts"))
        .drop("s", "z")
    )
    cell_line = W.partitionBy("source", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.where("parts > 1").groupBy("source", "size", "part").agg(F.count("*").alias("c"))
        .select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), F.coalesce(F.sum("c").over(cell_line), F.lit(0)).alias("offset"))
    )
    rank = F.row_number().over(W.partitionBy("source", "size", "part").orderBy("h", "doc_id")) - 1
    ranked = cut(
        placed.withColumn("k", rank)
        .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p")), "left")
        .withColumn("from", F.col("at") + (F.col("k") + F.coalesce("offset", F.lit(0))) * F.col("rate"))
        .select("doc_id", "source", "size", "source_size", "target", "rate", "from")
    )

    def copies(start: F.Column) -> F.Column:
        marks = F.floor(F.col("from") + F.col("rate") + start) - F.floor(F.col("from") + start)
        return F.least(F.greatest(marks, F.lit(0)), F.lit(most)).cast("long")

    starts = [i / STARTS for i in range(STARTS)]
    off = lambda x: F.struct(F.abs(F.sum(F.col("size") * copies(F.lit(x))) - F.first("target")).alias("off"), F.lit(x).alias("start"))
    best = ranked.groupBy(F.col("source").alias("s")).agg(F.least(*[off(x) for x in starts])["start"].alias("start"))
    done = ranked.join(best, F.col("source").eqNullSafe(F.col("s")))
    return done.select("doc_id", "source", "size", "source_size", "target", "rate", copies(F.col("start")).alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )
