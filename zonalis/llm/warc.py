"""WARC archives: revisit records for equal payloads, written with fresh headers and resolved again on reading."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.shared import small_side, text_or_empty, work_folder, written

#: Fixed values of the format.
END = "\r\n"
BETWEEN = END * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a record's headers, about; how many times larger than the mean record a payload of its class of files may be.
HEADERS, SPAN = 600, 8
HTTP = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}{END}"


def _record_id(page_id: Column, url: Column) -> Column:
    """A stable identifier: the same page has the same one in every run."""
    h = F.md5(F.concat_ws("|", F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("null")), F.coalesce(url, F.lit(""))))
    part = lambda at, n: F.substr(h, F.lit(at), F.lit(n))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)))


def resolve_revisits(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, original_id, original_url): original_* name the record that holds the payload, for records that revisit it, else null.

    Of records with equal payloads of at least least_bytes, the one with the largest id is the original (its exact repetitions are originals too; null ids are smallest).
    Only headers are grouped by digest, with partial maxima before the shuffle. The digests that stand more than once are joined without moving payloads as long as they
    are few; else a digest that many records share is split by the adaptive skew join. Null payloads are empty, null urls stay null.
    """
    payload = text_or_empty(payload_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.col(url_col).cast("string"), r"[\r\n]+", " ").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    long = F.col("payload_bytes") >= least_bytes
    groups = rows.where(long).groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("original"), F.count(F.lit(1)).alias("n"))
    many = written(groups.where("n > 1").select(F.col("payload_digest").alias("digest"), F.col("original.page_id").alias("_id"), F.col("original.url").alias("_url")), "originals")
    joined = rows.join(small_side(many, many.count()), long & (F.col("payload_digest") == F.col("digest")), "left")
    revisit = F.col("digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_id"))
    return joined.select(*rows.columns, revisit.alias("is_revisit"), F.when(revisit, F.col("_id")).alias("original_id"), F.when(revisit, F.col("_url")).alias("original_url"))


def _bits(size: Column) -> Column:
    """Binary digits of a size: sizes of so many are below two to that power."""
    return F.length(F.bin(size))


def payload_sizes(sizes: DataFrame) -> dict[int, tuple[int, int]]:
    """{binary digits: (payloads, bytes)} of a table of sizes (payload_bytes): one entry for each power of two."""
    rows = sizes.groupBy(_bits(F.col("payload_bytes")).alias("bits")).agg(F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("bytes"))
    return {r["bits"]: (r["n"], r["bytes"]) for r in rows.collect()}


def file_classes(sizes: dict[int, tuple[int, int]], file_bytes: int) -> list[tuple[int, int, int]]:
    """(least bits, most bits, records a file) of each class of payload sizes that occurs. The first class holds payloads up to SPAN times the mean record, each later one payloads up to SPAN times
    larger, so a file's payloads are at most SPAN times file_bytes in all, or a single one. There is a class for an empty table too."""
    mean = HEADERS + sum(b for _, b in sizes.values()) / max(1, sum(n for n, _ in sizes.values()))
    step = SPAN.bit_length() - 1
    low, high, records = 0, int(SPAN * mean).bit_length() - 1, file_bytes / mean
    found = [(low, high, max(1, int(records)))]
    while high < max(sizes, default=0):
        low, high = high + 1, high + step
        if any(low <= b <= high for b in sizes):
            found.append((low, high, max(1, SPAN * file_bytes >> high)))
    return found


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 1 << 24, sizes: dict[int, tuple[int, int]] | None = None) -> None:
    """WARC 1.1 records of resolve_revisits, gzipped, in files of about file_bytes before compression. Spark's text writer counts records and not bytes, so payloads far larger than the mean are written
    apart, fewer to a file (file_classes); sizes: payload_sizes of the records, if known. The writer ends every record with the blank lines that the format wants, and its committer makes the files survive lost executors."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END))).otherwise("")
    plain = lambda name, value: F.lit(f"{name}: {value}{END}")
    wrapped = lambda value: F.concat(F.lit("<"), value, F.lit(">"))
    original = _record_id(F.col("original_id"), F.col("original_url"))
    shared = [line("WARC-Record-ID", wrapped(_record_id(F.col("page_id"), F.col("url")))), plain("WARC-Date", date), line("WARC-Target-URI", F.col("url")), line("Page-ID", F.col("page_id").cast("string")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))]
    length = F.octet_length("payload") + F.lit(len(HTTP.encode()))
    response = F.concat(F.lit(f"WARC/1.1{END}WARC-Type: response{END}"), *shared, plain("Content-Type", "application/http; msgtype=response"), line("Content-Length", length.cast("string")), F.lit(END + HTTP), F.col("payload"))
    revisit = F.concat(F.lit(f"WARC/1.1{END}WARC-Type: revisit{END}"), *shared, plain("WARC-Profile", PROFILE), line("WARC-Refers-To", wrapped(original)), line("WARC-Refers-To-Target-URI", F.col("original_url")), plain("Content-Length", 0), F.lit(END))
    classes = file_classes(payload_sizes(resolved) if sizes is None else sizes, file_bytes)
    for least, most, records in classes:
        part = resolved if len(classes) == 1 else resolved.where(_bits(F.col("payload_bytes")).between(least, most))
        out = part.select(F.when(F.col("is_revisit"), revisit).otherwise(response).alias("value"))
        out.write.mode("append").option("lineSep", BETWEEN).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record. Blocks are read by their stated length, so they may hold anything."""
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record begins here: {first[:40]!r}")
        headers = {}
        while (row := stream.readline()).strip():
            name, _, value = row.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends inside a record")
        yield headers, block


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for headers, block in parse_records(gzip.GzipFile(fileobj=io.BytesIO(content))):
                payload = block.partition(b"\r\n\r\n")[2] if headers["warc-type"] == "response" else b""
                page = headers.get("page-id")
                rows.append((headers["warc-record-id"][1:-1], headers["warc-type"], int(page) if page else None, headers.get("warc-refers-to", "<>")[1:-1] or None, headers.get("warc-payload-digest", "").removeprefix("sha1:"), len(payload), hashlib.sha1(payload).hexdigest()))
            out = pd.DataFrame(rows, columns=["record_id", "record_type", "page_id", "refers_to_id", "stated_digest", "payload_bytes", "payload_digest"])
            yield out.astype({"page_id": "Int64", "payload_bytes": "int64"})


RECORD = "record_id string, record_type string, page_id long, refers_to_id string, stated_digest string, payload_bytes long, payload_digest string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under path: its headers, and length and digest of the payload that it holds itself. A task holds one compressed file and one record at a time."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInPandas(_parsed, RECORD)


def resolved_records(records: DataFrame) -> DataFrame:
    """records with the payload's length and digest, which revisits take from the response they refer to, and that response's page_id. A revisit whose response is missing has null there."""
    responses = records.where("record_type = 'response'").groupBy("record_id").agg(F.max("page_id").alias("_page"), F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_digest"))
    revisits = records.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to_id").join(responses.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left")
    own = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(revisits.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to")))


def revisit_report(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), a row for each page: writes the archives of all pages, reads them back and resolves the revisits. Null html is an empty payload; null ids are the smallest; repeated rows keep a row each; an empty table gives an empty result."""
    spark = pages.sparkSession
    path = f"{work_folder(spark)}/warc"
    sizes = payload_sizes(pages.select(F.octet_length(text_or_empty("html")).alias("payload_bytes")))
    write_archives(resolve_revisits(pages.select("page_id", "url", "html")), path, sizes=sizes)
    return resolved_records(written(read_archives(spark, path), "records"))
