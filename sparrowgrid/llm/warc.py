"""Operator 8: WARC not-modified revisits, resolved by an as-of join on the canonical URL."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Query parameters that never select content.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")
#: Headers of a 304 that may replace those of the stored response (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")
#: Time slices, each with about as many records; a URL captured without end is dealt over that many tasks.
SLICES = 1024
_STEP = 32


def canonical_url(url: Column) -> Column:
    """Scheme-less, lower-cased host without www. or m., no default port, fragment, tracking
    parameters, .html suffix or trailing slash; remaining parameters in order. Null: null."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^(www\.|m\.)|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"\.html?$", ""), r"/+$", "")
    pairs = F.filter(
        F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"),
        lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING),
    )
    query = F.array_join(F.array_sort(pairs), "&")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _slice(ts: Column, edges: list[int]) -> Column:
    """Number of a time slice, rising with time: sorted edges, looked up in two steps."""
    groups = [edges[i : i + _STEP] for i in range(0, len(edges), _STEP)] or [[]]
    below = lambda values: F.size(F.filter(values, lambda e: e < ts))
    longs = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    group = below(longs([g[0] for g in groups[1:]]))
    return group * (_STEP + 1) + below(F.get(F.array(*[longs(g) for g in groups]), group))


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """Attach to each revisit the latest earlier full response of its canonical URL.

    ``records``: record_id, type ('response' or 'revisit'), url, ts (long), etag,
    last_modified, headers (map<string,string>), and refers_to where there is one. Adds
    canon_url, ref_id, status and merged_headers:

    - a response: status 'full', its own id and headers;
    - a revisit whose validators agree: 'resolved', the response's headers overlaid with the
      permitted headers of the revisit. The etag decides if both have one, else last_modified,
      else refers_to if it names the response; without any of these it is 'unverified' and
      nothing is merged;
    - validators that disagree: 'mismatch'; no earlier response: 'orphan' (ref_id null).

    Responses at the same ts count as earlier than revisits, and of several the largest
    record_id. Payloads never move: the caller joins them by ref_id. The as-of join is a
    running last() over slices of (URL, time), plus one carried value a slice. Slices end at
    quantiles of ts, so that a URL that holds a third of all captures is dealt over its share of
    ``slices`` tasks whatever the spread of times. Null url or ts: 'orphan', or 'full' for a
    response; such rows meet no other and are not shuffled. Rows that repeat stay. Other columns
    are ignored. Empty table: empty result.
    """
    named = F.col("refers_to") if "refers_to" in records.columns else F.lit(None)
    light = records.select("record_id", "type", "url", "ts", "etag", "last_modified", "headers", named.cast(dict(records.dtypes)["record_id"]).alias("refers_to"))
    light = light.withColumns({"canon_url": canonical_url(F.col("url")), "late": (F.col("type") != "response").cast("int")})
    known = F.col("canon_url").isNotNull() & F.col("ts").isNotNull()
    usable = (F.col("type") == "response") & known
    light = light.withColumn("full", F.when(usable, F.struct("ts", "record_id", "etag", "last_modified", F.map_entries("headers").alias("entries"))))
    quantiles = [i / slices for i in range(1, slices)]
    edges = records.agg(F.percentile_approx("ts", quantiles, 10 * slices)).first()[0] if quantiles else None  # ``slices`` numbers
    keyed = light.where(known).withColumn("slice", _slice(F.col("ts"), sorted(set(edges or []))))
    ends = keyed.where("full is not null").groupBy("canon_url", "slice").agg(F.max_by("full", F.struct("ts", "record_id")).alias("full"))
    steps = keyed.select("canon_url", "slice").distinct().join(ends, ["canon_url", "slice"], "left")
    before = W.partitionBy("canon_url").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = steps.select(
        F.col("canon_url").alias("u"), F.col("slice").alias("s"), F.last("full", ignorenulls=True).over(before).alias("carried")
    ).where("carried is not null")
    run = W.partitionBy("canon_url", "slice").orderBy("ts", "late", "record_id").rowsBetween(W.unboundedPreceding, 0)
    seen = keyed.withColumn("ref", F.last("full", ignorenulls=True).over(run))
    seen = seen.join(carried, (F.col("canon_url") == F.col("u")) & (F.col("slice") == F.col("s")), "left")
    seen = seen.withColumn("ref", F.when(F.col("late") == 0, F.col("full")).otherwise(F.coalesce("ref", "carried"))).drop("u", "s", "slice", "carried")
    seen = seen.unionByName(light.where(~known).withColumn("ref", F.col("full")))
    told = F.when(F.col("refers_to") == F.col("ref.record_id"), True)
    agree = F.coalesce(F.col("etag") == F.col("ref.etag"), F.col("last_modified") == F.col("ref.last_modified"), told)
    status = (
        F.when(F.col("type") == "response", "full")
        .when(F.col("ref").isNull(), "orphan")
        .when(agree, "resolved")
        .when(~agree, "mismatch")
        .otherwise("unverified")
    )
    new = F.filter(F.map_entries("headers"), lambda e: F.lower(e.key).isin(*PERMITTED))
    names = F.transform(new, lambda e: F.lower(e.key))
    old = F.filter(F.col("ref.entries"), lambda e: ~F.array_contains(F.coalesce(names, F.array().cast("array<string>")), F.lower(e.key)))
    merged = F.when(F.col("status") == "resolved", F.map_from_entries(F.concat(F.coalesce(old, F.array().cast(_ENTRIES)), F.coalesce(new, F.array().cast(_ENTRIES)))))
    return seen.withColumn("status", status).select(
        "record_id", "type", "url", "canon_url", "ts",
        F.when(F.col("type") == "response", F.col("record_id")).otherwise(F.col("ref.record_id")).alias("ref_id"),
        "status",
        F.when(F.col("type") == "response", F.col("headers")).otherwise(merged).alias("merged_headers"),
    )


_ENTRIES = "array<struct<key:string,value:string>>"


def captures(pages: DataFrame) -> DataFrame:
    """A crawl log made of ``pages``: pages with page_id % 3 < 2 are full responses at time
    page_id; every page is probed again 1000 ticks later and answers 304 with its validators."""
    tag = F.md5(F.coalesce("html", F.lit("")))
    full = F.create_map(
        F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    )
    brief = F.create_map(F.lit("ETag"), tag, F.lit("Date"), (F.col("page_id") + 1000).cast("string"), F.lit("Content-Length"), F.lit("0"))
    base = pages.select("page_id", "url", tag.alias("etag"), full.alias("full"), brief.alias("brief"))
    kinds = F.when(F.col("page_id") % 3 < 2, F.array(F.lit("response"), F.lit("revisit"))).otherwise(F.array(F.lit("revisit")))
    rows = base.select("*", F.explode(kinds).alias("type"))
    again = F.col("type") == "revisit"
    return rows.select(
        (F.col("page_id") * 2 + again.cast("long")).alias("record_id"), "type", "url",
        (F.col("page_id") + F.when(again, 1000).otherwise(0)).alias("ts"), "etag", F.lit(None).cast("string").alias("last_modified"),
        F.when(again, F.col("brief")).otherwise(F.col("full")).alias("headers"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures(table(spark, sf_dir, "pages")))
    text = F.array_join(
        F.array_sort(F.transform(F.map_entries("merged_headers"), lambda e: F.concat(F.lower(e.key), F.lit(":"), e.value))), "|"
    )
    return out.select("record_id", "canon_url", "ref_id", "status", F.coalesce(text, F.lit("")).alias("headers"))


SQL = r"""
WITH c AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS tag, strlen(coalesce(html, '')) AS bytes,
         regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages
), d AS (
  SELECT page_id, tag, bytes,
         regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^(www\.|m\.)|:(80|443)$', '', 'g')
         || regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '\.html?$', ''), '/+$', '') AS base,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
           lambda p: p <> '' AND split_part(p, '=', 1) NOT IN
             ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','ref','fbclid','gclid'))), '&') AS q
  FROM c
), e AS (SELECT page_id, tag, bytes, base || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canon_url FROM d),
f AS (SELECT * FROM e WHERE page_id % 3 < 2),
r AS (
  SELECT e.page_id, e.canon_url, e.tag, f.page_id AS ref, f.tag AS ref_tag, f.bytes AS ref_bytes,
         row_number() OVER (PARTITION BY e.page_id ORDER BY f.page_id DESC NULLS LAST) AS n
  FROM e LEFT JOIN f ON e.canon_url = f.canon_url AND f.page_id <= e.page_id + 1000
)
SELECT page_id * 2 AS record_id, canon_url, page_id * 2 AS ref_id, 'full' AS status,
       'content-length:' || bytes || '|content-type:text/html|etag:' || tag AS headers
FROM f
UNION ALL
SELECT page_id * 2 + 1, canon_url, ref * 2,
       CASE WHEN ref IS NULL THEN 'orphan' WHEN tag = ref_tag THEN 'resolved' ELSE 'mismatch' END,
       CASE WHEN tag = ref_tag THEN 'content-length:' || ref_bytes || '|content-type:text/html|date:' || (page_id + 1000) || '|etag:' || tag
            ELSE '' END
FROM r WHERE n = 1
"""


def write_warc(records: list[dict]) -> bytes:
    """WARC/1.1 bytes, one gzip member a record, from dicts with type, url, date, headers (a dict or
    pairs), payload, and record_id and refers_to where there are such."""
    out = []
    for r in records:
        status = "304 Not Modified" if r["type"] == "revisit" else "200 OK"
        fields = r.get("headers") or {}
        body = f"HTTP/1.1 {status}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in (fields.items() if isinstance(fields, dict) else fields)) + "\r\n"
        block = body.encode() + (r.get("payload") or b"")
        more = "".join(f"{name}: {r[key]}\r\n" for key, name in (("record_id", "WARC-Record-ID"), ("refers_to", "WARC-Refers-To")) if r.get(key))
        head = f"WARC/1.1\r\nWARC-Type: {r['type']}\r\n{more}WARC-Target-URI: {r['url']}\r\nWARC-Date: {r['date']}\r\nContent-Length: {len(block)}\r\n\r\n"
        out.append(gzip.compress(head.encode() + block + b"\r\n\r\n", mtime=0))
    return b"".join(out)


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields; those that repeat are joined by a comma (RFC 9110, 5.3), names as first met."""
    out: dict[str, tuple[str, str]] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip(), value.strip()
            first, held = out.get(name.lower(), (name, None))
            out[name.lower()] = (first, value if held is None else f"{held}, {value}")
    return dict(out.values())


def parse_record(data: bytes) -> dict | None:
    """A record from its first header line on; None if it is cut short or its length is no number."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, v in _fields(head.decode("utf-8", "replace").split("\r\n")[1:]).items()}
    size = fields.get("content-length", "0")
    if not size.isascii() or not size.isdigit() or len(rest) < int(size):
        return None
    http, _, payload = rest[: int(size)].partition(b"\r\n\r\n")
    return {
        "record_id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
        "refers_to": fields.get("warc-refers-to"), "headers": _fields(http.decode("utf-8", "replace").split("\r\n")[1:]), "payload": payload,
    }


def inflate(data: bytes) -> bytes:
    """Contents of concatenated gzip members, up to where the data breaks off; other data as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out)


_MARK = b"\r\n\r\nWARC/1."


def _stitched(pieces: Iterator[tuple[str, bytes]]) -> Iterator[dict]:
    """Records of (file, piece) in order; a payload that holds the mark itself is put together again."""
    at, held = None, b""
    for file, piece in pieces:
        joined = held + _MARK + piece if held and file == at else b""
        if joined and (found := parse_record(joined)) is not None:
            yield found
            held = b""
            continue
        whole = parse_record(piece)
        if whole is not None and (b"WARC-Type" in piece.partition(b"\r\n\r\n")[0] or not joined):
            yield whole
            held = b""
        else:
            at, held = file, joined or piece


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or gzipped by record. A record that is cut short is left out."""
    return _stitched(("", p) for p in inflate(data).split(_MARK) if p.strip())


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, type, url, ts, date, etag, last_modified, refers_to, headers, payload) of all
    WARC files under a path, what ``resolve_revisits`` takes.

    Spark's text reader streams the files, plain or gzipped, record by record, so memory follows
    the largest record and not the file; plain files are also split. ts is WARC-Date in
    microseconds. A file that breaks off, in a record or in its compression, gives what is whole
    before that. Fields that are missing are null; no files: empty result.
    """
    kinds = "record_id string, type string, url string, date string, refers_to string, headers map<string,string>, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)))

        names = ["record_id", "type", "url", "date", "refers_to", "headers", "payload"]
        types = [pa.string()] * 5 + [pa.map_(pa.string(), pa.string()), pa.binary()]
        for r in _stitched((f, p) for f, p in pieces() if p.strip()):
            yield pa.RecordBatch.from_arrays([pa.array([list(r[n].items()) if n == "headers" else r[n]], t) for n, t in zip(names, types)], names)

    text = spark.read.option("lineSep", _MARK.decode()).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary")).mapInArrow(run, kinds)
    low = F.transform_keys("headers", lambda k, _: F.lower(k))
    return rows.withColumns({"etag": low["etag"], "last_modified": low["last-modified"], "ts": F.unix_micros(F.try_to_timestamp("date"))}).select(
        "record_id", "type", "url", "ts", "date", "etag", "last_modified", "refers_to", "headers", "payload"
    )
