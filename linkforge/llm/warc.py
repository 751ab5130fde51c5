"""WARC archives: written by Spark's text writer, read by a Python data source.

A record's bytes are one row, and the writer's line separator is the CR LF CR LF that ends a
record, so the files are plain WARC 1.1 on any file system, laid down and committed by Spark.

The reader (format "warc") plans partitions of whole files, or, where option splitbytes is given, of ranges of plain files: a record is
read by the range that it begins in, found by the first line WARC/ after an empty line. Leave splitbytes out for archives whose payloads may
hold such lines themselves. Filters on record_type and on the
named header columns are pushed down: each record's header is parsed first, and where it fails
a filter, or payloads aren't asked for, the payload is skipped without being read or decoded.
Gzipped archives (.gz) are read as streams. What is no record, or has no length, is passed over up to
the next line that begins one. Line ends in keys and addresses become spaces. read() switches on
Spark's pushdown of filters to Python sources for the session.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from linkforge.session import settled

END = "\r\n\r\n"
#: Payloads below this many bytes never become revisits; rows below which the table of revisits is broadcast.
LEAST_PAYLOAD, BROADCAST_ROWS = 100, 200_000
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to_record": "WARC-Refers-To",
    "page_id": "X-Page-Id",
    "refers_to": "X-Refers-To-Page-Id",
    "payload_length": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{k} string" for k in HEADERS) + ", payload binary"


def with_revisits(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """pages with payload_digest, payload_length and refers_to (the first page of an equal payload; null for a response).

    Digests are aggregated before anything is joined, and only those that occur twice go on. A
    null html is an empty payload. Repeated rows of the first page are all responses; a null key
    stays a response and is never referred to. A key that comes with several payloads is judged by
    each of them apart. Columns named like the new ones are replaced.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    slim = pages.select(F.col(key).alias("k"), F.sha2(payload, 256).alias("d"), F.octet_length(payload).alias("n")).where((F.col("n") >= LEAST_PAYLOAD) & F.col("k").isNotNull())
    slim = settled(slim, "digests")
    first = slim.groupBy("d").agg(F.min("k").alias("first"), F.count("*").alias("c")).where("c > 1").select("d", "first")
    later = settled(slim.join(first, "d").where("k != first").select(F.col("k").alias("_k"), F.col("d").alias("payload_digest"), F.col("first").alias("refers_to")).distinct(), "revisits")
    small = later.count() <= BROADCAST_ROWS
    kept = pages.drop(*(c for c in pages.columns if c.lower() in ("payload_digest", "payload_length", "refers_to", "_payload", "_k") and c not in (key, html)))
    full = kept.withColumns({"_k": F.col(key), "payload_digest": F.sha2(payload, 256), "payload_length": F.octet_length(payload).cast("long"), "_payload": payload})
    return full.join(F.broadcast(later) if small else later, ["_k", "payload_digest"], "left").drop("_k")


def _urn(key: Any, digest: Any) -> Any:
    h = F.md5(F.concat(F.lit("record:"), key.cast("string"), F.lit(":"), digest))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, b),)), F.lit(">"))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """A record per page under path: a response, or a revisit of the first page with an equal payload."""
    rows = with_revisits(pages.select(*dict.fromkeys((key, url, html))), key, html)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_length").cast("string"), F.lit(END))
    block = F.when(revisit, F.lit("").cast("binary")).otherwise(F.concat(http.cast("binary"), F.col("_payload")))
    page = F.coalesce(F.regexp_replace(F.col(key).cast("string"), r"[\r\n]+", " "), F.lit(""))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.when(revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(page, F.col("payload_digest"))),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(F.regexp_replace(F.col(url), r"[\r\n]+", " "), F.lit(""))),
        F.lit(f"WARC-Date: {date}"),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.regexp_replace(F.col("refers_to").cast("string"), r"[\r\n]+", " "), F.col("payload_digest")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("X-Page-Id: "), page),
        F.concat(F.lit("X-Refers-To-Page-Id: "), F.regexp_replace(F.col("refers_to").cast("string"), r"[\r\n]+", " ")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_length").cast("string")),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    record = F.concat(F.concat(head, F.lit(END)).cast("binary"), block)
    rows.select(record.cast("string").alias("record")).write.option("lineSep", END).text(path)


class _Files(InputPartition):
    """Files, each with the range of bytes in which records begin; no end means the whole file."""

    def __init__(self, paths: list[tuple[str, int, int | None]]):
        self.paths = paths


def _plain(uri: str) -> str:
    """s3a and s3n are Hadoop's names of s3."""
    scheme, sep, rest = uri.partition("://")
    return f"s3://{rest}" if sep and scheme in ("s3a", "s3n") else uri


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.size = int(options.get("partitionbytes", 16 << 20))
        self.split = int(options.get("splitbytes", 0))
        self.tests: list[tuple[str, str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, membership, prefix and not-null tests of header columns; Spark keeps the rest."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append(("in", name, {f.value}))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append(("in", name, set(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append(("prefix", name, f.value))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append(("set", name, None))
            else:
                yield f

    def _passes(self, head: dict[str, str]) -> bool:
        for kind, name, value in self.tests:
            got = head.get(HEADERS[name].lower()) or None
            if got is None or kind == "in" and got not in value or kind == "prefix" and not got.startswith(value):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        """Runs of files of about size bytes together."""
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(_plain(self.path))
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        out, held, n = [], [], 0
        for path, size in files:
            if held and n + size > self.size:
                out, held, n = [*out, _Files(held)], [], 0
            if self.split and size > self.split and not path.endswith(".gz"):
                out += [_Files([(path, at, min(size, at + self.split))]) for at in range(0, size, self.split)]
                continue
            held.append((path, 0, None))
            n += size
        return [*out, _Files(held)] if held else out

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(_plain(self.path))
        rows: list[tuple] = []
        n = 0
        for path, begin, end in partition.paths:
            with system.open_input_file(path) as f:
                for head, payload in self._records(gzip.GzipFile(fileobj=f) if path.endswith(".gz") else f, begin, end):
                    rows.append((*(head.get(h.lower()) or None for h in HEADERS.values()), payload))
                    n += len(payload or b"") + 500
                    if n > 4 << 20:
                        yield self._batch(rows)
                        rows, n = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        names = [*HEADERS, "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "payload" else pa.string()) for k, c in zip(names, cols)], names=names)

    @staticmethod
    def _next(f: Any, at: int, mark: bytes = b"\nWARC/") -> tuple[int, bytes]:
        """(place, bytes from there on) of the next line that begins a record at or after a place; the file's end if there is none."""
        lead = len(mark) - 5
        at, held = max(0, at - lead), b""
        f.seek(at)
        while more := f.read(1 << 16):
            held += more
            if (k := held.find(mark)) >= 0:
                return at + k + lead, held[k + lead :]
            at, held = at + max(0, len(held) - len(mark) + 1), held[-(len(mark) - 1) :]
        return at + len(held), b""

    def _records(self, f: Any, begin: int = 0, stop: int | None = None) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """Each record that begins in the range and passes: its header, and its payload where that is asked for."""
        at, held = self._next(f, begin, END.encode() + b"WARC/") if begin else (0, b"")
        while stop is None or at < stop:
            while (end := held.find(END.encode())) < 0:
                f.seek(at + len(held))
                more = f.read(4096)
                if not more:
                    return
                held += more
            head = {}
            for line in held[:end].decode("utf-8", "replace").split("\r\n")[1:]:
                name, _, value = line.partition(":")
                head[name.strip().lower()] = value.strip()
            size, body = head.get("content-length", ""), at + end + 4
            if not (held.startswith(b"WARC/") and size.isascii() and size.isdigit()):
                # No record, or one without a length: go on where the next one begins.
                at, held = self._next(f, at + 1)
                continue
            size = int(size)
            rest = held[end + 4 :]
            if self._passes(head):
                payload = None
                if self.payload and head.get("warc-type") != "revisit":
                    if len(rest) < size:
                        f.seek(body + len(rest))
                        rest += f.read(size - len(rest))
                    block = rest[:size]
                    cut = block.find(END.encode()) if "http" in head.get("content-type", "") else -4
                    payload = block[cut + 4 :]
                yield head, payload
            at = body + size + 4
            held = rest[size + 4 :] if len(rest) >= size + 4 else b""


class WarcSource(DataSource):
    """spark.read.format("warc").load(path); option payload=false leaves payloads out."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, path: str, payload: bool = True, split_bytes: int = 0) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("splitbytes", split_bytes).load(path)
