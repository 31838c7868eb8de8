"""WARC archives from a chunked record table.

Payloads are cut inside the JVM into rows of (record, chunk number, bytes) before anything
else sees them. The rows of a record follow one another, so a SHA-1 state is carried from
chunk to chunk and each row tells the bytes and the digest up to its end; the last one's
are those of the payload. Which records are responses and which revisit them is decided on
those last rows without their bytes. The stored chunk table then becomes archives: a chunk
is one WARC record, the first a response (or a revisit without payload), later ones
continuation segments as WARC/1.1 defines them. Spark's own text writer puts them into
gzip files, so archives go wherever Spark can write and a lost task leaves none behind.
Reading streams the lines of each file through a parser that never holds more than a
chunk's line, and computes each record's digest anew from its segments.

From the cut on nothing holds more than a batch of chunks; only the scan of the source
table has a payload whole, as its reader returns values.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.sources.checkpoints import cut as stored_table
from factmill.sources.checkpoints import release, shared_folder

from .common import cut

#: Bytes of payload in a chunk at most, and chunks or lines that Python is given at once.
CHUNK = 1 << 16
BATCH = 256
RECORD_END = "\r\n\r\n"


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode("ascii")


@contextmanager
def small_batches(spark: SparkSession):
    """While this lasts, Arrow batches hold BATCH rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def chunk_rows(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """record, page_id, url, payload_bytes, chunk_no, n_chunks, data, upto, digest: the payloads in pieces of `chunk` bytes.

    record numbers the rows; upto and digest are the count and the SHA-1 (base32) of the
    record's bytes up to the piece's end. An empty or null payload is one empty piece.
    """
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    whole = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    size = F.octet_length("payload")
    numbered = whole.select("*", size.cast("long").alias("payload_bytes"), F.greatest(F.ceil(size / chunk), F.lit(1)).cast("int").alias("n_chunks"))
    pieces = numbered.select("*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_no"))
    names = ["record", "page_id", "url", "payload_bytes", "chunk_no", "n_chunks", "data"]
    pieces = pieces.withColumn("data", F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})")).select(*names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, upto = hashlib.sha1(), 0
        for batch in batches:
            sizes, digests = [], []
            for number, data in zip(batch.column(4).to_pylist(), batch.column(6)):
                if number == 0:
                    state, upto = hashlib.sha1(), 0
                piece = data.as_buffer()
                state.update(piece)
                upto += piece.size
                sizes.append(upto)
                digests.append(digest_text(state.digest()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=[*names, "upto", "digest"])

    return pieces.mapInArrow(each, "record long, page_id long, url string, payload_bytes long, chunk_no int, n_chunks int, data binary, upto long, digest string")


def kinds(chunks: DataFrame, least_bytes: int = 0) -> DataFrame:
    """record, payload_digest, refers_to, refers_record: of every record, from its last chunk's row alone."""
    last = chunks.where("chunk_no = n_chunks - 1").select("record", "page_id", "payload_bytes", F.col("digest").alias("payload_digest"))
    largest = last.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "record")).alias("first"))
    again = (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    both = last.join(largest, ["payload_digest", "payload_bytes"])
    return both.select("record", "payload_digest", F.when(again, F.col("first.page_id")).alias("refers_to"), F.when(again, F.col("first.record")).alias("refers_record"))


def records(chunks: DataFrame, kind: DataFrame) -> DataFrame:
    """value: one WARC record for each chunk of the responses and one for each revisit, in order within a partition."""
    both = chunks.join(kind.hint("shuffle_hash"), "record")
    both = both.where("refers_record is null or chunk_no = 0").sortWithinPartitions("record", "chunk_no")
    id_of = lambda page, record: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("none")), F.lit("/"), F.col(record).cast("string"))
    own, revisit, first, part = id_of("page_id", "record"), F.col("refers_record").isNotNull(), F.col("chunk_no") == 0, F.col("n_chunks") > 1
    data = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("data"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, "revisit").when(first, "response").otherwise("continuation")),
        line("WARC-Record-ID", F.concat(own, F.when(first, ">").otherwise(F.concat(F.lit("/"), (F.col("chunk_no") + 1).cast("string"), F.lit(">"))))),
        line("WARC-Target-URI", F.regexp_replace(F.trim("url"), r"\s+", " ")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Page-Id", F.col("page_id")),
        line("X-Payload-Length", F.col("payload_bytes")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, line("WARC-Refers-To", F.concat(id_of("refers_to", "refers_record"), F.lit(">")))),
        F.when(part & ~revisit, line("WARC-Segment-Number", F.col("chunk_no") + 1)),
        F.when(~first, line("WARC-Segment-Origin-ID", F.concat(own, F.lit(">")))),
        F.when(part & ~revisit & (F.col("chunk_no") == F.col("n_chunks") - 1), line("WARC-Segment-Total-Length", F.col("payload_bytes"))),
        line("Content-Length", F.octet_length(data)),
    )
    # the cast keeps the bytes as they are, also where a chunk ends within a character
    return both.select(F.concat(header, F.lit(RECORD_END), data.cast("string")).alias("value"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0, chunk: int = CHUNK) -> None:
    """Archives of all pages in a folder: one record per row, revisits where an equal payload is a response.

    Of records with equal payloads of least_bytes or more, those with the largest page_id
    are responses and the others revisit it; smaller ones are all responses. Rows that
    share page_id and payload are both responses if theirs is the largest. A row without
    a page_id is a response unless a row with one has its payload. A null payload counts
    as empty; further columns are ignored; an empty table gives no records. The chunk
    table is stored beside the checkpoints while this runs, and deleted then.
    """
    spark = pages.sparkSession
    with small_batches(spark):
        stored = stored_table(chunk_rows(pages, chunk), compression="zstd")
    records(stored, kinds(stored, least_bytes)).write.mode("overwrite").option("compression", "gzip").option("lineSep", RECORD_END).text(folder)
    release(stored)


class _Parser:
    """Records from the lines of one archive, a line at a time."""

    def __init__(self):
        self.state, self.left, self.header, self.first = "start", 0, {}, True

    def feed(self, line: bytes) -> Iterator[tuple[str, object]]:
        """("header", fields), ("data", bytes) and ("end", None) events; line has no line feed."""
        while True:
            if self.state == "start":
                if line.strip():
                    if not line.startswith(b"WARC/"):
                        raise ValueError(f"no WARC record begins with {line[:40]!r}")
                    self.state, self.header = "header", {}
                return
            if self.state == "header":
                line = line.rstrip(b"\r")
                if line:
                    name, _, value = line.decode("utf-8").partition(":")
                    self.header[name.strip().lower()] = value.strip()
                    return
                self.left, self.state, self.first = int(self.header["content-length"]), "data", True
                yield "header", self.header
                if not self.left:
                    yield "end", None
                    self.state = "start"
                return
            data = line if self.first else b"\n" + line
            self.first = False
            if len(data) < self.left:
                self.left -= len(data)
                yield "data", data
                return
            yield "data", data[: self.left]
            yield "end", None
            self.state, line, self.left = "start", data[self.left :], 0


def read(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, page_id, record_type, payload_bytes, payload_digest, refers_to, intact of every record.

    Size and digest of a response are computed from its segments as they stream by;
    intact says whether they equal the stored ones. Those of a revisit are the stored ones.
    """
    lines = spark.read.option("lineSep", "\n").text(folder).select(F.col("_metadata.file_path").alias("file"), "value")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, parser, open_, out = None, _Parser(), None, []

        def closed(record: dict) -> tuple:
            size, digest = record["size"], digest_text(record["sha"].digest())
            told = record["told"]
            kept = told["warc-payload-digest"].removeprefix("sha1:")
            page = int(told["x-page-id"]) if "x-page-id" in told else None
            if told["warc-type"] == "revisit":
                refers = told["warc-refers-to"].removeprefix("<urn:page:").partition("/")[0]
                return told["warc-record-id"], page, "revisit", int(told["x-payload-length"]), kept, int(refers) if refers.lstrip("-").isdigit() else None, True
            return told["warc-record-id"], page, "response", size, digest, None, digest == kept and size == int(told["x-payload-length"])

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                names=["record_id", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "intact"],
            )

        for batch in batches:
            values = batch.column(1).cast(pa.binary())
            for name, value in zip(batch.column(0), values, strict=True):
                if (name := name.as_py()) != file:
                    file, parser = name, _Parser()
                for event, what in parser.feed(value.as_py()):
                    if event == "header" and what["warc-type"] == "continuation":
                        if open_ is None or open_["told"]["warc-record-id"] != what["warc-segment-origin-id"]:
                            raise ValueError(f"segment {what['warc-record-id']} doesn't follow its origin")
                    elif event == "header":
                        if open_ is not None:
                            out.append(closed(open_))
                        open_ = {"told": dict(what), "size": 0, "sha": hashlib.sha1()}
                    elif event == "data":
                        open_["size"] += len(what)
                        open_["sha"].update(what)
            if len(out) >= 1000:
                yield table(out)
                out = []
        if open_ is not None:
            out.append(closed(open_))
        if out:
            yield table(out)

    schema = "record_id string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean"
    return lines.mapInArrow(each, schema)


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The records of all pages, written to archives in the shared checkpoint folder and read back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, least_bytes)
    with small_batches(spark):
        return cut(read(spark, folder))


def oracle_sql() -> str:
    """DuckDB SQL for the query's rows: each five hexadecimal digits of a SHA-1 are four letters of base32."""
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> (5 * (3 - k))) % 32 + 1 AS BIGINT), 1)"
    return f"""
WITH hexed AS (SELECT row_number() OVER () AS r, page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
digits AS (SELECT r, g, k, CAST('0x' || substr(hex, 5 * g + 1, 5) AS BIGINT) AS v FROM hexed, range(8) AS t(g), range(4) AS u(k)),
named AS (SELECT r, string_agg({letter}, '' ORDER BY g, k) AS payload_digest FROM digits GROUP BY r),
found AS (SELECT page_id, payload_bytes, payload_digest, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM hexed JOIN named USING (r))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM found
"""
