"""Sources and sinks: what is written is read again and gives the table's own rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill.registry import query
from corpusmill.session import _shared_folder, table
from corpusmill.sources import archives, sinks


def _folder(spark, name):
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, lang, md5(text) AS digest FROM documents")
def records_round_trip(spark, sf_dir):
    """JSON lines, compressed."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    path = _folder(spark, "records")
    sinks.write_records(docs, path, compress=True)
    return sinks.read_records(spark, path, docs.schema).select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT md5(text) AS digest, count(*)::BIGINT AS n FROM documents GROUP BY text")
def lines_round_trip(spark, sf_dir):
    """Texts as escaped lines of gzip files."""
    path = _folder(spark, "lines")
    sinks.write_lines(table(spark, sf_dir, "documents", "text"), path)
    return sinks.read_escaped(spark, path).groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY lang, source")
def counters_round_trip(spark, sf_dir):
    path = _folder(spark, "counters")
    sinks.write_counters(table(spark, sf_dir, "documents", "lang", "source"), ["lang", "source"], path)
    return sinks.read_records(spark, path, "lang string, source string, n long")


@query("SELECT vec_id, len(embedding)::INT AS size, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def vectors_round_trip(spark, sf_dir):
    path = _folder(spark, "vectors")
    sinks.write_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v)
    return sinks.read_vectors(spark, path).select("vec_id", F.size("embedding").alias("size"), F.round(total, 4).alias("total"))


@query("SELECT doc_id, md5(coalesce(CASE WHEN doc_id % 2 = 0 THEN text END, source)) AS digest FROM documents")
def json_content(spark, sf_dir):
    """The field of a JSON line, else another."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    line = F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("text"), "source"))
    return docs.select("doc_id", F.md5(archives.content(line, "text", "source").cast("binary")).alias("digest"))


@query("SELECT url, 'response' AS warc_type, 'text/html' AS content_type, md5(html) AS digest, (CASE WHEN length(html) + 60 > 4194304 THEN 'long' END) AS reason FROM pages")
def archive_records(spark, sf_dir):
    """Pages written as web archives and read again, with the reason to skip a record."""
    pages = table(spark, sf_dir, "pages", "url", "html")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), "url", F.lit("\r\nContent-Length: "), (F.octet_length("html") + 60).cast("string"), F.lit("\r\n\r\n"))
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "html", F.lit("\r\n\r\n"))
    path = _folder(spark, "archive")
    pages.select(F.concat(head, body).alias("value")).write.option("lineSep", "\r\n").text(path)
    found = archives.read_warc(spark, path).withColumn("reason", archives.reject_reason())
    return found.select("url", "warc_type", "content_type", F.md5(F.col("payload").cast("binary")).alias("digest"), "reason")
