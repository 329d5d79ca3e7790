"""Operator 12: fill-in-middle examples through an index of distinct texts.

Identical texts are grouped by their content. The token boundaries of each distinct text, an
ascending list of code point positions, are kept once as an Elias-Fano list; documents join back
to it by the digest of their text and select the two boundaries of their seeded cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HEAVY, Stored, table

MARKERS = ("<P>", "<S>", "<M>")
FORMED, SPM = 90, 20  # percent of texts that are cut, and of those, suffix first
#: Ones of the upper bits between two places of the directory.
_EVERY = 512


def boundaries(text: str) -> np.ndarray:
    """Ends of the tokens, in code points: a token is a run of ASCII letters or any one other code point."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    lower = (x | 32) - np.uint32(97) < 26
    letter = lower & (x < 128)
    inside = np.append(letter[:-1] & letter[1:], False) if len(x) else letter
    return np.flatnonzero(~inside) + 1


def encode(values: np.ndarray) -> bytes:
    """Elias-Fano list of ascending numbers: lower bits as they are, upper bits in unary, and a
    directory of every ``_EVERY``-th one among the upper bits."""
    n = len(values)
    if not n:
        return np.zeros(3, "<u4").tobytes()
    low = max(0, int(int(values[-1]) // n).bit_length() - 1)
    ones = (values >> low) + np.arange(n)
    upper = np.zeros(int(ones[-1]) + 1, bool)
    upper[ones] = True
    lower = (values[:, None] >> np.arange(low) & 1).astype(bool).ravel()
    places = ones[::_EVERY].astype("<u4")
    return b"".join((np.array([n, low, len(places)], "<u4").tobytes(), places.tobytes(), np.packbits(lower).tobytes(), np.packbits(upper).tobytes()))


def select(blob: bytes, i: int) -> int:
    """The i-th number of the list, from 0; reads the bits between two places of the directory."""
    n, low, k = (int(x) for x in np.frombuffer(blob, "<u4", 3))
    places = np.frombuffer(blob, "<u4", k, 12)
    at = 12 + 4 * k
    upper = at + -(-n * low // 8)
    block, rest = divmod(i, _EVERY)
    start = int(places[block])
    stop = int(places[block + 1]) if block + 1 < k else 8 * (len(blob) - upper)
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, -(-stop // 8) - start // 8, upper + start // 8))
    one = start // 8 * 8 + int(np.flatnonzero(bits[start % 8 :])[rest]) + start % 8
    value = one - i << low
    if low:
        first = i * low
        held = np.unpackbits(np.frombuffer(blob, np.uint8, -(-(first + low) // 8) - first // 8, at + first // 8))
        value |= int((held[first % 8 : first % 8 + low].astype(np.int64) << np.arange(low)).sum())
    return value


def _ends(text: pd.Series) -> pd.DataFrame:
    found = [boundaries(t) for t in text]
    return pd.DataFrame({"n": [len(x) for x in found], "ends": [encode(x) for x in found]})


def _places(ends: pd.Series, tokens: pd.Series) -> pd.Series:
    """Code points of the first so many tokens, for each number that is asked of a text."""
    return pd.Series([[select(blob, k - 1) if k > 0 else 0 for k in asked] for blob, asked in zip(ends, tokens)])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows (key, text) of a batch, each text once, compared as a whole."""
    for b in batches:
        seen: set[str] = set()
        stay = [t not in seen and not seen.add(t) for t in b.column(1).to_pylist()]
        yield b.filter(pa.array(stay, pa.bool_()))


def _hash_group(seed: Column, k: int) -> Column:
    """The k-th group of eight digits of a document's seed."""
    return F.conv(F.substring(seed, 8 * k - 7, 8), 16, 10).cast("long")


def rebuilt(output: Column, form: Column) -> Column:
    """The text that an output was made of. No text that is cut contains a marker, and no marker
    begins with the end of another, so the first three in an output are those set here."""
    part = F.split(output, "|".join(MARKERS), -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def transform(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``docs``.

    Seeds come from the doc_id, see the module's contract; a null doc_id seeds like an empty one,
    and rows that share a doc_id share the seed. A null text is empty; an empty text, and one that
    holds a marker, is plain. Other columns are ignored. Empty table: empty result.

    The texts are shuffled once, by the SHA-256 of their content, copies in a batch already
    dropped; in their partition equal texts are grouped by the texts themselves, and the ids of a
    text meet it there as one list. Digests that hold a share of 1/HEAVY of all rows or more (HEAVY
    at most) go another way: their texts are few, are sent to as many slots as their share asks
    for, and their ids are dealt to these, so that no list is longer than such a share.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))
    counts = Stored(rows.groupBy("key").agg(F.count("*").alias("rows"))).rows
    total = counts.agg(F.sum("rows")).first()[0] or 0
    slots = F.ceil(F.col("rows") * HEAVY / F.lit(max(total, 1))).cast("int")
    heavy = Stored(counts.where(F.col("rows") * HEAVY >= total).where("rows > 1").select("key", slots.alias("slots"))).rows
    few = F.broadcast(heavy)  # HEAVY digests at most
    ids = rows.select("doc_id", "key")
    texts = rows.select("key", "text")
    kind = "key binary, text string"
    ends, places = F.pandas_udf(_ends, "n long, ends binary"), F.pandas_udf(_places, "array<long>")
    listed = lambda df, *by: df.groupBy(*by).agg(F.collect_list(F.struct("doc_id")).alias("ids"))  # noqa: E731  a struct keeps null ids

    light = texts.join(few, "key", "left_anti").mapInArrow(_once, kind).repartition("key").groupBy("key", "text").agg(F.lit(1).alias("one"))
    light = light.join(listed(ids.join(few, "key", "left_anti"), "key").hint("shuffle_hash"), "key").withColumn("ends", ends("text"))
    copied = texts.join(few.select("key"), "key", "left_semi").mapInArrow(_once, kind).groupBy("key", "text").agg(F.lit(1).alias("one"))
    copied = copied.withColumn("ends", ends("text")).join(few, "key").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    dealt = ids.join(few, "key").withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.col("slots")).cast("int"))
    copied = copied.repartition("key", "slot").join(listed(dealt, "key", "slot").hint("shuffle_hash"), ["key", "slot"])

    both = light.select("text", "ends", "ids").unionByName(copied.select("text", "ends", "ids"))
    n = F.col("ends.n")
    seed = F.transform("ids", lambda x: F.struct(x["doc_id"].alias("doc_id"), F.sha2(F.concat(F.lit("1:"), F.coalesce(x["doc_id"].cast("string"), F.lit(""))), 256).alias("seed")))
    both = both.withColumn("ids", seed)
    both = both.withColumn("tokens", F.flatten(F.transform("ids", lambda x: F.array_sort(F.array(*[_hash_group(x["seed"], k) % (n + 1) for k in (1, 2)])))))
    both = both.withColumn("at", places("ends.ends", "tokens"))
    each = both.select("text", n.alias("n"), "at", F.posexplode("ids").alias("i", "id"))
    p, m = F.get("at", F.col("i") * 2), F.get("at", F.col("i") * 2 + 1)
    marked = F.lit(False)
    for mark in MARKERS:
        marked |= F.contains("text", F.lit(mark))
    plain = (F.col("n") == 0) | marked | (_hash_group(F.col("id.seed"), 3) % 100 >= FORMED)
    form = F.when(plain, "plain").when(_hash_group(F.col("id.seed"), 4) % 100 < SPM, "spm").otherwise("psm")
    each = each.select(F.col("id.doc_id").alias("doc_id"), "n", "text", p.alias("p"), m.alias("m"), form.alias("form"))
    p, m = F.col("p"), F.col("m")
    parts = {
        "<P>": F.substring("text", F.lit(1), p.cast("int")), "<M>": F.substring("text", (p + 1).cast("int"), (m - p).cast("int")),
        "<S>": F.substring("text", (m + 1).cast("int"), (F.length("text") - m).cast("int")),
    }
    joined = lambda *order: F.concat(*[x for k in order for x in (F.lit(k), parts[k])])
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", joined("<P>", "<S>", "<M>")).otherwise(joined("<S>", "<P>", "<M>"))
    cut_only = lambda c: F.when(F.col("form") != "plain", c)
    return each.select("doc_id", "n", "form", cut_only(p).alias("prefix_chars"), cut_only(m - p).alias("middle_chars"), output.alias("output"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::varchar, '')) AS s
  FROM documents
), h AS (
  SELECT *, len(u) AS n, ('0x' || substr(s, 1, 8))::bigint AS h1, ('0x' || substr(s, 9, 8))::bigint AS h2,
         ('0x' || substr(s, 17, 8))::bigint AS h3, ('0x' || substr(s, 25, 8))::bigint AS h4
  FROM t
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM f
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p
), r AS (SELECT *, string_split_regex(output, '<P>|<S>|<M>') AS x FROM o)
SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::bigint AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::bigint AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN x[2] || x[4] || x[3] ELSE x[3] || x[4] || x[2] END) AS restored_sha256
FROM r
"""
