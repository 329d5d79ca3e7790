"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, what its predecessor
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparrowgrid.llm import decontamination, line_dedup, mixing, simhash, toxicity
from sparrowgrid.llm.common import cut, release, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 5 predicts toxic go; the model is fitted on the training fold."""
    model = toxicity.model_of(spark, sf_dir, docs)
    return toxicity.score(docs, model, *COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that operator 2 drops, n_chars counted anew. All rows stay."""
    return line_dedup.rebuilt(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies (five-word shingles, fingerprints of operator 3 or a
    similarity of 0.8) one row stays, that of the smallest doc_id."""
    return simhash.distinct_documents(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which operator 4 finds a benchmark item go."""
    return decontamination.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of operator 6: documents that it takes, with ``copies``, the number of times.

    Rows alike in doc_id, source and size share the copies of all of them, as evenly as can be.
    """
    key = {"_id": F.coalesce("doc_id", F.lit(0)), "_at": F.xxhash64(F.col("doc_id").isNull(), "source", "size")}
    taken = mixing.mix(docs).withColumns(key).groupBy("_id", "_at").agg(
        F.first("rate").alias("rate"), F.sum("copies").alias("_all"), F.count("*").alias("_rows")
    )
    rows = docs.select(*COLUMNS, mixing.word_count(F.col("text")).alias("size")).withColumns(key)
    turn = F.row_number().over(W.partitionBy("_id", "_at").orderBy(F.xxhash64("text", "lang", "n_chars")))
    copies = F.floor(F.col("_all") / F.col("_rows")) + (turn <= F.col("_all") % F.col("_rows")).cast("long")
    mixed = rows.join(taken.where("_all > 0"), ["_id", "_at"]).withColumn("copies", copies)
    return mixed.where("copies > 0").select(*COLUMNS, "size", "rate", "copies")


def released(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, begun without what the ones before left in the driver's memory."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", released(drop_toxic)),
    ("line_dedup", released(drop_lines)),
    ("simhash_near_dedup", released(drop_near_copies)),
    ("decontamination", released(decontaminate)),
    ("mixing", released(mix_sources)),
]
#: Models, fingerprints and Newton steps have no SQL form; tests/llm/test_pipeline.py holds each stage to a
#: plain version on what the one before kept, and run() to the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
