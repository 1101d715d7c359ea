"""WARC archives with revisit records.

Headers are shuffled by payload digest to find the first page of every payload; pages whose payload has been seen become
revisit records that refer to it. Archives are written by Spark as gzip text in the shared folder and read back record by
record, guided by Content-Length, and revisits are resolved against the responses they refer to.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreview.llm.common import cut, lookup, shared_dir, table, whole

#: Fixed values of the format.
VERSION, EOL = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MIN_PAYLOAD = 100
"""Smaller payloads are always written out."""
RECORDS_PER_FILE = 5000


def _record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("urn:sha256:"), F.sha2(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("")), digest).cast("binary"), 256))


def find_revisits(headers: DataFrame) -> DataFrame:
    """(page_id, digest, first) for the pages of `headers(page_id, digest, bytes)` that repeat the payload of `first`.

    A null page_id comes after all others. Rows that share the smallest id and the payload are all responses.
    """
    large = headers.filter(F.col("bytes") >= MIN_PAYLOAD).select("page_id", "digest").distinct()
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    seen = lookup(large, firsts.select("digest", "first"), "digest", "page_id")
    return seen.filter(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the two line ends that close it; a header with a null value is left out."""
    block_bytes = F.octet_length(block).cast("string")
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in [*headers, ("Content-Length", block_bytes)]]
    return F.concat(F.concat_ws(EOL, F.lit(VERSION), *lines), F.lit(EOL * 2), block)


def to_records(pages: DataFrame) -> DataFrame:
    """(record): one WARC record per row of `pages(page_id, url, html, ...)`; null html is an empty payload."""
    html = whole("html")
    rows = pages.select("page_id", F.regexp_replace(whole("url"), r"\s", "%20").alias("url"), html.alias("html"),
                        F.sha2(html.cast("binary"), 256).alias("digest"))
    headers = cut(pages.select("page_id", F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("bytes")))
    revisits = find_revisits(headers).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first")
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    again = F.col("first").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
                    F.octet_length("html").cast("string"), F.lit(EOL * 2))
    return rows.select(_record([
        ("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", F.concat(F.lit("<"), _record_id(F.col("page_id"), F.col("digest")), F.lit(">"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.when(F.col("url") != "", F.col("url"))),
        ("WARC-Profile", F.when(again, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(again, F.concat(F.lit("<"), _record_id(F.col("first"), F.col("digest")), F.lit(">")))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("X-Page-Id", F.col("page_id").cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    ], F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))).alias("record"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Deduplicated archives of `pages` under `path`, a folder that every executor reaches."""
    (to_records(pages).write.option("lineSep", EOL * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


_FIELDS = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Payload-Digest", "X-Page-Id")
_SCHEMA = "record_type string, record_id string, refers_to_id string, url string, digest string, page_id long, payload string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from the lines of whole files in order; holds one record and a batch of about 8 MB at a time."""
    path, header, block, missing, rows, held = None, {}, [], -1, [], 0

    def batch() -> pa.RecordBatch:
        kinds = [pa.string()] * 5 + [pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 7, kinds)],
                                          [c.split()[0] for c in _SCHEMA.split(", ")])

    for part in batches:
        for file, line in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            if file != path:
                if missing > 0:
                    raise ValueError(f"the last record of {path} is cut off")
                path, header, missing = file, {}, -1
            if missing < 0:  # among the headers
                if line:
                    name, _, value = line.partition(": ")
                    header[name] = value
                elif header:
                    missing, block = int(header["Content-Length"]), []
                    if not missing:
                        raise ValueError(f"a record without HTTP headers in {path}")
                continue
            missing -= len(line.encode()) + 2 * bool(block)
            block.append(line)
            if missing > 0:
                continue
            if missing < 0:
                raise ValueError(f"Content-Length does not match in {path}")
            kind, own, refers, url, digest, page = (header.get(f) for f in _FIELDS)
            body = EOL.join(block)[len(header_end(block)):] if kind == "response" else None
            rows.append((kind, own.strip("<>"), refers and refers.strip("<>"), url, digest.removeprefix("sha256:"),
                         None if page is None else int(page), body))
            held += len(body or "") + 200
            header, missing, block = {}, -1, []
            if held > 8 << 20:
                yield batch()
                rows, held = [], 0
    if missing > 0:
        raise ValueError(f"the last record of {path} is cut off")
    yield batch()


def header_end(block: list[str]) -> str:
    """The HTTP headers of a block with the empty line that ends them."""
    return EOL.join(block[:block.index("") + 1]) + EOL


def read_warc(spark, path: str) -> DataFrame:
    """Records of the archives under `path`: the columns of _SCHEMA, payload null for revisits."""
    lines = spark.read.option("lineSep", EOL).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.mapInArrow(_parse, _SCHEMA)


def resolve(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), a revisit taking the payload's figures from the
    response it refers to. A revisit whose response is not in the archives, or has another digest, is an error."""
    heads = cut(records.select("record_type", "record_id", "refers_to_id", "digest", "page_id", F.octet_length("payload").cast("long").alias("bytes"),
                               F.sha2(F.col("payload").cast("binary"), 256).alias("actual")))
    responses = heads.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.min("page_id").alias("refers_to"), F.min("bytes").alias("full"), F.min("actual").alias("original"))
    found = lookup(heads, responses, "refers_to_id", "record_id")
    digest = F.coalesce("original", "actual")
    checked = F.when(digest.eqNullSafe(F.col("digest")), digest).otherwise(
        F.raise_error(F.concat(F.lit("payload of "), F.col("record_id"), F.lit(" does not match its digest"))))
    return found.select("page_id", F.coalesce("full", "bytes").alias("payload_bytes"), checked.alias("payload_digest"),
                        "record_type", "refers_to")


def op5_warc(spark, sf_dir):
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return resolve(read_warc(spark, path))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first, strlen(html) AS bytes FROM p)
SELECT page_id, bytes::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""
