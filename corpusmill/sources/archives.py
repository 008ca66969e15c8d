"""Text lines, JSON lines and web archives as DataFrames; every path goes through Spark's readers."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARK = "WARC/1.0\r\n"
LEAST_BYTES, MOST_BYTES = 128, 4 * 2**20


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row a line (plain or gzip): path, text, with escaped line feeds restored."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.withColumn("text", F.replace("text", F.lit("\\n"), F.lit("\n")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, offset, text: lines of each file (plain or gzip) with their number and byte offset from 0.

    Lines of a file keep their order of reading; a file is one group, as its offsets are one sum.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    order = Window.partitionBy("path").orderBy("start", "id")
    before = F.coalesce(F.sum(F.octet_length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("path", (F.row_number().over(order) - 1).cast("long").alias("line_no"), before.cast("long").alias("offset"), "text")


def content(line: Column, field: str = "text", other: str | None = None) -> Column:
    """The field of a JSON line (else the ``other`` field); a line that is no JSON is its own content."""
    found = [F.get_json_object(line, f"$.{name}") for name in (field, other) if name]
    return F.when(line.startswith("{"), F.coalesce(*found)).otherwise(line)


def read_jsonl(spark: SparkSession, path: str, field: str = "text", other: str | None = None) -> DataFrame:
    return spark.read.text(path).select(content(F.col("value"), field, other).alias("text"))


def _header(block: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(block, rf"(?im)^{name}:([^\r\n]*)", 1))


def parse_warc(records: DataFrame) -> DataFrame:
    """``value`` (a record without its first line) to warc_type, url, content_type, length, payload.

    Payload is what follows the protocol's header block, or the whole body if there is none.
    """
    body = F.regexp_replace("value", r"(?s)^.*?\r\n\r\n", "")
    rows = records.filter(F.length("value") > 0).select(F.substring_index("value", "\r\n\r\n", 1).alias("head"), body.alias("body"))
    http = F.col("body").startswith("HTTP/")
    block = F.when(http, F.substring_index("body", "\r\n\r\n", 1)).otherwise(F.lit(""))
    payload = F.when(http, F.regexp_replace("body", r"(?s)^.*?\r\n\r\n", "")).otherwise(F.col("body"))
    kind = F.when(http, _header(block, "Content-Type")).otherwise(_header(F.col("head"), "Content-Type"))
    return rows.select(
        _header(F.col("head"), "WARC-Type").alias("warc_type"), _header(F.col("head"), "WARC-Target-URI").alias("url"),
        F.lower(F.trim(F.substring_index(kind, ";", 1))).alias("content_type"),
        F.expr("try_cast(" + "trim(regexp_extract(head, '(?im)^Content-Length:([^\\\\r\\\\n]*)', 1)) AS bigint)").alias("length"),
        F.regexp_replace(payload, r"(\r\n)+$", "").alias("payload"),
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of (gzip) archives, one row each, split by Spark's text reader at the version line.

    Text is decoded as UTF-8, so binary payloads (pdf) are damaged; read those with ``binaryFile``.
    """
    return parse_warc(spark.read.option("lineSep", MARK).text(path))


def records_of(raw: bytes) -> list[tuple]:
    """(warc_type, url, content_type, length, payload) of the records of an archive's bytes; a cut-off record keeps what is there."""
    out, at = [], raw.find(b"WARC/1.")
    while 0 <= at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            break
        head = {}
        for line in raw[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        length = int(head[b"content-length"]) if head.get(b"content-length", "").isdigit() else None
        body = raw[end + 4 : end + 4 + length] if length is not None else raw[end + 4 :]
        kind, payload = head.get(b"content-type", ""), body
        if body.startswith(b"HTTP/"):
            block, _, payload = body.partition(b"\r\n\r\n")
            kinds = [x.partition(b":")[2].strip().decode("utf-8", "replace") for x in block.split(b"\r\n") if x.lower().startswith(b"content-type:")]
            kind = kinds[0] if kinds else ""
        out.append((head.get(b"warc-type", ""), head.get(b"warc-target-uri", ""), kind.split(";")[0].strip().lower(), length, payload))
        at = raw.find(b"WARC/1.", end + 4 + len(body))
    return out


def read_warc_binary(spark: SparkSession, path: str) -> DataFrame:
    """Records of (gzip) archives with their payload as bytes, so pdf and other encodings stay whole. One file is one row's work."""
    schema = pa.schema([("warc_type", pa.string()), ("url", pa.string()), ("content_type", pa.string()), ("length", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                raw = raw.as_py()
                rows = records_of(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
                for start in range(0, len(rows), 256):
                    columns = zip(*rows[start : start + 256], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], names=schema.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "warc_type string, url string, content_type string, length long, payload binary")


def reject_reason(types: tuple[str, ...] = ("text/html", "application/xhtml+xml", "application/pdf")) -> Column:
    """Why a record is skipped, or null."""
    size = F.coalesce("length", F.lit(0))
    return F.when(F.col("warc_type") == "metadata", "metadata").when(size < LEAST_BYTES, "short").when(size > MOST_BYTES, "long").when(~F.col("content_type").isin(*types), "type")
