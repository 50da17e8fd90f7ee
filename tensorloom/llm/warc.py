"""A content-addressed WARC archive: payloads once, headers apart, records by joins.

Writing: of records with equal payloads of at least 1000 bytes the one with the largest
page_id is the response and holds the payload, the others revisit it; smaller payloads
are all responses. The records become WARC files (`warc/`, gzip), written by Spark's text
writer whose line end is the record end. Beside them `headers/` keeps the header block
that each record has in its original, unfolded form (a response with its length), with
the digests that lead to its payload.

Reading: the files are parsed by their Content-Length, every payload is digested again
and held against its header, and originals come back by joining headers to payloads. A
payload or a record that is missing raises.

Payloads move only into their files: which record keeps a payload is decided on digests.
A file is one gzip stream, bounded in bytes before compression.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looked_up, map_batches, shared_folder, written

LEAST_SHARED = 1000
END = "\r\n\r\n"
#: Fixed, so that the same pages give the same archive.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digest of a block without bytes.
EMPTY = hashlib.sha256(b"").hexdigest()
#: Bytes of the payloads of a file, at most (but for a single larger payload).
FILE_BYTES = 256 << 20
#: Payloads up to each of these sizes share files; so do those that are larger than all.
SIZES = (64 << 10, 4 << 20)


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _header(kind: Column, page_id: Column, url: Column, sha1: Column, sha256: Column, refers: Column, length: Column) -> Column:
    """The header block of a record, up to the empty line before its content."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    return F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _urn(page_id)),
        line("WARC-Date", F.lit(DATE)),
        # a line end inside a URL would end the header field
        line("WARC-Target-URI", F.regexp_replace(url, "[\r\n]", "%0A")),
        # a revisit has an empty block of its own; the digest that names its payload is the one by which it is stored
        line("WARC-Payload-Digest", F.when(kind == "revisit", F.concat(F.lit("sha256:"), sha256)).otherwise(F.concat(F.lit("sha1:"), sha1))),
        line("WARC-Block-Digest", F.when(kind == "revisit", F.lit(f"sha256:{EMPTY}")).otherwise(F.concat(F.lit("sha256:"), sha256))),
        line("WARC-Refers-To", _urn(refers)),
        F.when(kind == "revisit", F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html"),
        line("Content-Length", length.cast("string")),
    )


def assign(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, length, sha1, sha256, refers_to (null for responses).

    The keeper of each digest is found by aggregation before the shuffle, on identifiers
    and digests alone, and sent to the pages.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    payload = F.encode(html, "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("length"),
        F.sha1(payload).alias("sha1"),
        F.sha2(payload, 256).alias("sha256"),
    )
    counted = rows.filter(F.col("length") >= LEAST_SHARED).groupBy("sha256", "length").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    keepers = written(counted.filter("n > 1").drop("n"), "warc-keepers")
    held = looked_up(rows, keepers, keepers.count(), ["sha256", "length"], F.struct("page_id", "url"), 200)
    return held.withColumn("refers_to", F.when(F.col("keeper") != F.col("page_id"), F.col("keeper"))).drop("keeper")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write warc/ and headers/ below path; pages of a size class go into files of their own.

    A header field can't hold a line end, so one in a URL is escaped there; headers/ has the exact URL.
    """
    rows = assign(pages, id_col, url_col, html_col)
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    args = (F.col("page_id"), F.col("url"), F.col("sha1"), F.col("sha256"))
    stored = F.when(kind == "response", F.col("length")).otherwise(0)
    record = F.concat(
        _header(kind, *args, F.col("refers_to"), stored), F.lit(END), F.when(kind == "response", F.col("html")).otherwise("")
    )
    no_ref = F.lit(None).cast("long")
    original = _header(F.lit("response"), *args, no_ref, F.col("length"))
    rows.select("page_id", "url", "refers_to", "length", "sha1", "sha256", original.alias("header")).write.parquet(f"{path}/headers")

    lengths = pages.select(F.coalesce(F.octet_length(F.col(html_col).cast("string")), F.lit(0)).alias("n"))
    bounds = [-1, *SIZES, 1 << 62]
    classes = list(zip(bounds, bounds[1:]))
    most = lengths.agg(*[F.max(F.when((F.col("n") > low) & (F.col("n") <= high), F.col("n"))) for low, high in classes]).first()
    for (low, high), longest in zip(classes, most):
        if longest is None and (low >= 0 or any(m is not None for m in most)):
            continue  # a class without pages; an empty table still gets its empty folder
        per_file = max(1, FILE_BYTES // min(high, max(longest or 1, SIZES[0])))
        part = rows.filter((F.col("length") > low) & (F.col("length") <= high)).select(record.alias("value"))
        part.write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(f"{path}/warc")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record of a gzip WARC file, one at a time."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
        while version := f.readline():
            if not version.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {version[:40]!r}")
            fields = {}
            while (line := f.readline()) != b"\r\n":
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                fields[name] = value
            n = int(fields["Content-Length"])
            block = f.read(n)
            if len(block) != n or f.read(len(END)) != END.encode():
                raise ValueError(f"truncated record {fields.get('WARC-Record-ID')}")
            yield fields, block


SCHEMA = "page_id long, record_type string, refers_to long, url string, sha1 string, sha256 string, payload binary"
BATCH_BYTES = 16 << 20


def _number(urn: str | None) -> int | None:
    """The number in a record's name; a record of a page without page_id has none."""
    return int(urn[len("<urn:page:") : -1]) if urn else None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files below path/warc; a payload that misses its digest raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
        for b in batches:
            for content in b.column("content"):
                rows, held = [], 0
                for fields, block in parse(content.as_py()):
                    kind, payload, sha256 = fields["WARC-Type"], fields["WARC-Payload-Digest"], fields["WARC-Block-Digest"].removeprefix("sha256:")
                    sha1 = payload.removeprefix("sha1:") if kind == "response" else None
                    if hashlib.sha256(block).hexdigest() != sha256 or sha1 not in (None, hashlib.sha1(block).hexdigest()):
                        raise ValueError(f"payload of {fields.get('WARC-Record-ID')} misses its digest")
                    rows.append((_number(fields.get("WARC-Record-ID")), kind, _number(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"), sha1, sha256 if sha1 else payload.removeprefix("sha256:"), block if kind == "response" else None))
                    held += len(block)
                    if held > BATCH_BYTES:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{path}/warc").select("content")
    return map_batches(files, run, SCHEMA)


def _missing(what: str, column: str) -> Column:
    """column, or an error where it is null."""
    return F.coalesce(F.col(column), F.raise_error(F.concat(F.lit(f"{what} of record "), F.coalesce(F.col("page_id").cast("string"), F.lit("without page_id")))))


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit takes length and digest from the response that it refers to, by a join; if
    that is missing, reading it raises. Files without the records that headers/ lists, or
    with others, raise at once.
    """
    read = read_warc(spark, path).select("page_id", "record_type", "refers_to", "sha256", "sha1", F.octet_length("payload").cast("long").alias("payload_bytes"))
    read = written(read, "warc-read")  # files are parsed once
    listed = spark.read.parquet(f"{path}/headers").select("page_id", "sha256", F.lit(-1).alias("n"))
    uneven = listed.unionByName(read.select("page_id", "sha256", F.lit(1).alias("n"))).groupBy("page_id", "sha256").agg(F.sum("n").alias("n")).filter("n != 0")
    if not uneven.isEmpty():
        raise ValueError(f"records and headers of {path} differ at page {uneven.first()['page_id']}")
    held = read.filter("record_type = 'response'")
    stored = held.filter(F.col("payload_bytes") >= LEAST_SHARED).select(
        "sha256", F.col("page_id").alias("refers_to"), F.col("sha1").alias("_sha1"), F.col("payload_bytes").alias("_bytes")
    )
    visits = read.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "sha256")
    visited = visits.select("sha256", "refers_to").distinct()
    stored = written(stored.join(visited, ["sha256", "refers_to"], "left_semi").dropDuplicates(["sha256", "refers_to"]), "warc-visited")
    found = looked_up(visits, stored, stored.count(), ["sha256", "refers_to"], F.col("page_id"), 250)
    found = found.withColumns({"payload_bytes": _missing("payload", "_bytes"), "payload_digest": _missing("payload", "_sha1")})
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return held.withColumnRenamed("sha1", "payload_digest").select(columns).unionByName(found.select(columns))


def originals(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the exact original record (header block, empty line, payload) of each page; a missing payload raises.

    Payloads under 1000 bytes are many to a digest, so each distinct one is sent on once,
    as are all others; a header of a hot payload meets it in one of several parts.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = read_warc(spark, path).filter("record_type = 'response'").select("sha256", "payload").dropDuplicates(["sha256"])
    size = payloads.agg(F.sum(F.octet_length("payload") + 200)).first()[0] or 0
    found = looked_up(headers, payloads, size, ["sha256"], F.struct("page_id", "header"), 1)
    whole = F.concat(F.encode(F.col("header"), "UTF-8"), F.encode(F.lit(END), "UTF-8"), _missing("payload", "payload"))
    return found.select("page_id", whole.alias("record"))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages to a new archive in the shared folder and return its records, read back.

    Null html is an empty payload; a null url leaves its header field out; rows that
    repeat a page_id are records of their own (equal payloads under the largest page_id
    are then all responses). An empty table gives an archive without records. Further
    columns of pages are not read.
    """
    path = shared_folder(pages.sparkSession, "warc")
    write_archive(pages, path, id_col, url_col, html_col)
    return records(pages.sparkSession, path)
