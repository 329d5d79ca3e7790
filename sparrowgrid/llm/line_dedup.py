"""Operator 2: drop lines that many documents repeat. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, cut, table

MIN_CHARS = 40
MIN_DOCS = 5


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): each row of ``docs`` without its repeated lines.

    A line's key is the line stripped of ASCII blanks and with A-Z lowered. Keys of
    ``min_chars`` code points or more held by ``min_docs`` documents or more lose their
    lines everywhere except in the largest doc_id that holds them.

    Only hashes travel: 96 bits a long line are counted (distinct documents, with partial
    aggregation, so that a line in a third of all documents is a row per task), joined back
    by hash (AQE splits hot hashes) and gathered as positions per document. The text is
    shuffled once, for the reassembly.

    Nulls: a null text is one empty line; a null doc_id is no document to count and never
    the keeper. Rows that share a doc_id count as one document; each is rebuilt from its
    own text. Empty table: empty result. Other columns are ignored.
    """
    return rebuilt(docs.select("doc_id", "text"), min_chars, min_docs)


def rebuilt(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs``, the text without its repeated lines, n_lines and n_dropped."""
    other = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    held = F.struct(*other) if other else F.lit(None).cast("int")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held.alias("held")).withColumn("row", F.xxhash64("text"))
    lines = (
        rows.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .withColumn("line", F.trim("line", F.lit(SPACES)))
        .where(F.length("line") >= min_chars)
        .withColumn("key", ascii_lower(F.col("line")))
        .select("doc_id", "row", "pos", F.xxhash64("key").alias("h"), F.hash("key").alias("g"))
    )
    # cut, so that both sides of the join are plain shuffles, of which AQE splits hot hashes
    frequent = cut(
        lines.groupBy("h", "g")
        .agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
    )
    drops = (
        lines.join(frequent.drop("n"), ["h", "g"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    parts = (
        rows.join(drops, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
        .withColumn("parts", F.split("text", "\n", -1))
        .withColumn("n_lines", F.size("parts").cast("long"))
        .withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone"))
    )
    kept = F.array_join(F.transform("stay", lambda p: F.get("parts", p)), "\n")
    return parts.select(
        "doc_id",
        *[F.col("held")[c].alias(c) for c in other],
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        "n_lines",
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
