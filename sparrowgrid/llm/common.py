"""What the operators of this subpackage share: table access, lineage cuts, graph components."""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and SQL class of the separators that every word and key contract names.
SPACES = " \t\n\x0b\x0c\r"
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LOCAL_CHECKPOINTS = "/tmp/checkpoints/sparrowgrid"
#: Bits of a mark set: 8 MB, whatever the data. Beyond some ten million keys it lets more and more through.
MARK_BITS = 1 << 26
_PAGE = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer partitions than there are cores, such as a single file, is dealt by its first column."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    few = df._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return df.repartition(cores, df.columns[0]) if few else df


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one of our own only in local mode with none set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or LOCAL_CHECKPOINTS)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Collects the driver's garbage, in Python and in the JVM. Spark drops the broadcasts, shuffles and
    checkpoints of tables that are gone only then, and by itself only when the driver's heap is full."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


class Stored:
    """A table written to the cluster's shared folder: cuts lineage like ``cut``, column by column
    and compressed, and can be dropped once later tables stand in for it."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
        df.write.option("parquet.block.size", 8 << 20).parquet(self.path)  # small row groups: a writer buffers one
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def slot(*columns: str) -> Column:
    """Place of a key in a mark set."""
    return F.pmod(F.xxhash64(*columns), F.lit(MARK_BITS))


def marks(slots: DataFrame) -> np.ndarray:
    """Mark set of the one column of ``slots``: a bit for each place, MARK_BITS of them at most
    reaching the driver. Test with ``marked``; keys that are not there pass now and then."""
    s = F.col(slots.columns[0])
    paged = slots.select(F.floor(s / _PAGE).cast("int").alias("page"), (s % _PAGE).alias("bit")).repartition("page")
    out = np.zeros(MARK_BITS // 8, np.uint8)
    for r in paged.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        out[r.page * (_PAGE // 8) : (r.page + 1) * (_PAGE // 8)] = np.frombuffer(r.bits, np.uint8)
    return out


def spark_hash(x: np.ndarray) -> np.ndarray:
    """xxhash64 of longs with Spark's seed."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: v << np.uint64(r) | v >> np.uint64(64 - r)
    h = np.uint64(42 + int(p5) + 8) ^ turn(x.view(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return (h ^ h >> np.uint64(32)).view(np.int64)


def slots_of(x: np.ndarray) -> np.ndarray:
    """``slot`` of one column of longs."""
    return spark_hash(x) % np.int64(MARK_BITS)


def marked(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 != 0


#: A key with this share of all rows or more is heavy; there cannot be more such keys than this.
HEAVY = 4096


def join_heavy(rows: DataFrame, keyed: DataFrame, on: list[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, in which a key stands once with ``count``, its number of
    ``rows``. Keys with a share of 1/HEAVY of the counted rows, HEAVY at most, meet their rows by
    broadcast, where these are; the others by a shuffle that no key can crowd. Keys are not null;
    both sides should be written tables, since they are read twice."""
    total = keyed.agg(F.sum(count)).first()[0]
    heavy = F.col(count) * HEAVY >= (total or 0)
    few = F.broadcast(keyed.where(heavy))
    return rows.join(few, on).unionByName(rows.join(few, on, "left_anti").join(keyed.where(~heavy), on))


def ascii_lower(c: Column) -> Column:
    """A-Z only. Pure ASCII strings take the fast path of lower()."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, *LOWER))


def labels_of(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member index of each node's component, for n local nodes and edges a-b."""
    lab = np.arange(n) if label is None else label
    while True:
        la, lb = lab[a], lab[b]
        if (la == lb).all():
            return lab
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Alternating large-star and small-star steps. Only minima are grouped, so a hub with
    millions of neighbours is never gathered: its rows stay spread over the join, which
    AQE may split. Each round is cut, and ends when the edge set no longer changes.
    """
    e = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct()
    )
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
