"""WARC archives: a native writer and a PySpark Python data source.

Writing is one DataFrame text write (records are separated by the CRLF CRLF
that ends a WARC record), so it works on any file system Spark can write.
Reading is the data source ``warc``: the driver lists the files once, small
files are packed into partitions by size, record-type and header predicates
are pushed into the reader, headers are parsed first and the payload of a
record that fails a predicate (or whose payload isn't asked for) is passed
over without being decoded.

A payload's digest is its bare upper-case base32 SHA-1.  Of records with
equal payloads (SHA-256) of at least ``least`` bytes the one with the
smallest page_id is a ``response``, the others are ``revisit`` records that
refer to it and carry no payload; smaller ones are all ``response``.  Null
html is an empty payload.  A repeated page_id gives a record per row, each
with the same type if the payloads are equal; a null page_id is never the
record referred to unless no other has that payload.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from causeway.session import ensure_checkpoint_dir

from .common import cut

_CRLF = "\r\n"
SCHEMA = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
          "refers_to long, payload binary")
PARTITION_BYTES = 32 * 1024 * 1024


def sha1_base32(body: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 4 x 40 bits, 8 digits each."""
    h = F.sha1(body)
    part = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*part), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def classify(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest,
    record_type and refers_to.

    The smallest id per payload is a grouped minimum (copies are combined
    before the shuffle); the join back is on the digest and AQE splits it
    where one payload has very many copies.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    p = (pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
         .withColumn("payload_bytes", F.octet_length("html").cast("long"))
         .withColumn("payload_key", F.sha2(F.col("html").cast("binary"), 256)))
    first = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(body, 256).alias("payload_key"))
             .groupBy("payload_key").agg(F.min("page_id").alias("first_id")))
    joined = p.join(first, "payload_key")
    revisit = ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("payload_bytes") >= least)
    return (joined.withColumn("payload_digest", sha1_base32(F.col("html").cast("binary")))
            .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(revisit, F.col("first_id")))
            .drop("payload_key", "first_id"))


def _header(name: str, value: Column) -> Column:
    """One header line; none if the value is null.  Line breaks are escaped."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(_CRLF)), F.lit(""))


def _urn(col: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.col(col).cast("string"), F.lit(">"))


def write_archives(classified: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z",
                   records_per_file: int = 50_000, compression: str = "gzip") -> None:
    """Writes a folder of WARC files from classify()'s rows."""
    response = F.col("record_type") == "response"
    payload = F.when(response, F.col("html")).otherwise("")
    record = F.concat(
        F.lit("WARC/1.0" + _CRLF),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", _urn("page_id")),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _header("WARC-Payload-Length", F.col("payload_bytes")),
        _header("WARC-Profile", F.when(~response, F.lit(
            "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        _header("WARC-Refers-To", F.when(~response, _urn("refers_to"))),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.octet_length(payload)),
        F.lit(_CRLF), payload)
    (classified.select(record.alias("value")).write.option("lineSep", _CRLF * 2)
     .option("maxRecordsPerFile", records_per_file).option("compression", compression)
     .mode("errorifexists").text(path))


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the archives in a folder, by Spark's own file system."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(str(s.getPath().toString()), int(s.getLen())) for s in fs.listStatus(folder)]
    return sorted((p, n) for p, n in found if not p.rsplit("/", 1)[-1].startswith(("_", ".")))


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of a folder of archives; ``payload`` False leaves that
    column null and passes over all payloads.  Filters on the result's
    header columns reach the reader (filter push-down is switched on)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return (spark.read.format("warc").option("files", json.dumps(list_files(spark, path)))
            .option("payload", str(payload).lower()).load())


class WarcSource(DataSource):
    """``spark.read.format("warc")`` with options files (JSON list of [path,
    bytes]) and payload (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(json.loads(self.options.get("files", "[]")),
                          self.options.get("payload", "false") == "true")


class WarcPart(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    _COLUMNS = ("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to")

    def __init__(self, files: list[list], payload: bool):
        self.files = files
        self.payload = payload
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Keeps comparisons of one header column with a value; the rest is
        left to Spark."""
        from pyspark.sql import datasource as d

        ops = {d.EqualTo: "=", d.EqualNullSafe: "<=>", d.GreaterThan: ">", d.GreaterThanOrEqual: ">=",
               d.LessThan: "<", d.LessThanOrEqual: "<=", d.In: "in", d.IsNull: "null", d.IsNotNull: "not null"}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in ops and name in self._COLUMNS:
                self.tests.append((name, ops[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[WarcPart]:
        """Whole files, packed in order up to PARTITION_BYTES."""
        parts: list[WarcPart] = []
        size = PARTITION_BYTES
        for path, n in self.files:
            if size + n > PARTITION_BYTES:
                parts.append(WarcPart([]))
                size = 0
            parts[-1].paths.append(path)
            size += n
        return parts

    def read(self, partition: WarcPart) -> Iterator[tuple]:
        for path in partition.paths:
            with _open(path) as stream:
                yield from _records(stream, self.tests, self.payload)


def _open(path: str) -> io.BufferedReader:
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path)
    return io.BufferedReader(where.open_input_stream(inner, compression="detect"), 1 << 20)


def _passes(row: dict, tests: list[tuple[str, str, object]]) -> bool:
    for name, op, value in tests:
        x = row[name]
        if op == "null":
            ok = x is None
        elif op == "<=>":
            ok = x == value
        elif x is None:
            ok = False
        else:
            ok = (op == "not null" or op == "=" and x == value or op == "in" and x in value
                  or op == ">" and x > value or op == ">=" and x >= value
                  or op == "<" and x < value or op == "<=" and x <= value)
        if not ok:
            return False
    return True


def _page(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:"):-1]) if urn else None


def _body(stream: io.BufferedReader, n: int) -> bytes:
    body = stream.read(n)
    if len(body) < n:
        raise ValueError(f"a record ends {n - len(body)} bytes early")
    return body


def _skip(stream: io.BufferedReader, n: int) -> None:
    while n > 0:
        n -= len(_body(stream, min(n, 1 << 20)))


def _records(stream: io.BufferedReader, tests: list, payload: bool) -> Iterator[tuple]:
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            continue
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            head[name.decode().lower()] = value.decode().strip()
        length = int(head["content-length"])
        row = {"page_id": _page(head.get("warc-record-id")), "url": head.get("warc-target-uri"),
               "record_type": head.get("warc-type"),
               "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
               "payload_bytes": int(head.get("warc-payload-length", length)),
               "refers_to": _page(head.get("warc-refers-to"))}
        if payload and _passes(row, tests):
            body = _body(stream, length)
            yield (*row.values(), body if row["record_type"] != "revisit" else None)
        else:
            keep = not payload and _passes(row, tests)
            _skip(stream, length)
            if keep:
                yield (*row.values(), None)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a
    folder of archives, length and digest taken from the payloads as read: those
    of a response from its own, those of a revisit from the response it refers
    to.  Both record types are asked for by a pushed predicate; revisits are
    read without payloads.  A revisit whose response isn't there, or has other
    bytes than the revisit's header names, has a null length and digest."""
    body = F.coalesce("payload", F.lit(b""))
    responses = (read_archives(spark, path, payload=True).where("record_type = 'response'")
                 .select("page_id", F.octet_length(body).cast("long").alias("payload_bytes"),
                         sha1_base32(body).alias("payload_digest"), "record_type", "refers_to"))
    # one row per id and payload: copies of a response are equal here
    known = responses.select(F.col("page_id").alias("known_id"), F.col("payload_bytes").alias("known_bytes"),
                             F.col("payload_digest").alias("known_digest")).distinct()
    revisits = read_archives(spark, path).where("record_type = 'revisit'")
    same = F.col("refers_to").eqNullSafe(F.col("known_id")) & (F.col("payload_digest") == F.col("known_digest"))
    return responses.unionByName(revisits.join(known, same, "left").select(
        "page_id", F.col("known_bytes").alias("payload_bytes"), F.col("known_digest").alias("payload_digest"),
        "record_type", "refers_to"))


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the pages to a fresh folder of archives beside the checkpoints
    (shared by all executors), reads it back, payloads and all, and deletes it."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(classify(pages, least), path)
    out = cut(read_back(spark, path))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out
