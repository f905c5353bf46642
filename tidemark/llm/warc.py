"""WARC archives as a Python data source.

Records are gzip members of their own, and each member's header carries the skip-lengths field "sl" of
the WARC standard (compressed and uncompressed length). So a reader inflates a record's headers first
and, unless the record is wanted, goes on to the next member without inflating the payload.
"""

from __future__ import annotations

import base64
import hashlib
import operator
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from tidemark.llm.common import own
from tidemark.llm.filesets import FileSet
from tidemark.session import work_folder

FILE_BYTES = 256 << 20  # a file is closed when it has reached this size
PIECE_BYTES = 8 << 20  # the manifest names a record's start after so many bytes, where a file may be cut
BATCH_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# gzip member: magic, deflate, flag "extra field", no time, no flags, unknown system, 12 bytes extra.
_FIXED = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x0c\x00sl\x08\x00"
_LENGTHS = struct.Struct("<II")
_HEAD = len(_FIXED) + _LENGTHS.size
_LINE = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")

#: Columns that stand in the headers, and what header and type they have.
COLUMNS = {
    "page_id": ("WARC-Record-ID", "long"),
    "record_type": ("WARC-Type", "string"),
    "target_uri": ("WARC-Target-URI", "string"),
    "payload_digest": ("WARC-Payload-Digest", "string"),
    "payload_bytes": ("X-Payload-Length", "long"),
    "refers_to": ("WARC-Refers-To", "long"),
}


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _uri(page_id: int | None) -> str:
    return "<urn:page:>" if page_id is None else f"<urn:page:{page_id}>"


def _line(name: str, value: str) -> bytes:
    """A header line; what would break the line is percent-encoded."""
    safe = re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)
    return f"{name}: {safe}\r\n".encode("utf-8", "surrogatepass")


def _unline(value: bytes) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value.decode("utf-8", "surrogatepass"))


def member(data: bytes) -> bytes:
    """A gzip member with its skip lengths."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = _HEAD + len(body) + len(tail)
    if max(size, len(data)) > 0xFFFFFFFF:
        raise ValueError("a record is larger than 4 GiB")
    return _FIXED + _LENGTHS.pack(size, len(data)) + body + tail


def record(page_id, kind: str, uri: str | None, digest: str, length: int, refers_to, payload: bytes) -> bytes:
    lines = [b"WARC/1.1\r\n", _line("WARC-Type", kind), _line("WARC-Record-ID", _uri(page_id))]
    lines.append(_line("WARC-Date", DATE))
    if uri is not None:
        lines.append(_line("WARC-Target-URI", uri))
    lines.append(_line("WARC-Payload-Digest", f"sha1:{digest}"))
    lines.append(_line("X-Payload-Length", str(length)))
    if kind == "revisit":
        lines += [_line("WARC-Refers-To", _uri(refers_to)), _line("WARC-Profile", PROFILE)]
    body = payload if kind == "response" else b""
    lines += [_line("Content-Type", "text/html"), _line("Content-Length", str(len(body)))]
    return member(b"".join(lines) + b"\r\n" + body + b"\r\n\r\n")


@dataclass
class Written(WriterCommitMessage):
    entries: list[dict]


class _Writer(DataSourceArrowWriter):
    """Takes page_id, url, html, sha1 (hexadecimal), payload_bytes, record_type, refers_to."""

    def __init__(self, path: str, file_bytes: int) -> None:
        self.files, self.file_bytes = FileSet(path), file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        entries, stream, name, size, count, starts = [], None, "", 0, 0, []
        for batch in iterator:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                if stream is None:
                    (name, stream), size, count, starts = self.files.create(".warc.gz"), 0, 0, []
                if not starts or size - starts[-1] >= PIECE_BYTES:
                    starts.append(size)
                row = {n: c[i].as_py() for n, c in columns.items()}
                data = record(
                    row["page_id"],
                    row["record_type"],
                    row["url"],
                    base32(bytes.fromhex(row["sha1"])),
                    row["payload_bytes"],
                    row["refers_to"],
                    (row["html"] or "").encode("utf-8", "surrogatepass"),
                )
                stream.write(data)
                size, count = size + len(data), count + 1
                if size >= self.file_bytes:
                    stream.close()
                    entries.append({"name": name, "bytes": size, "records": count, "starts": starts})
                    stream = None
        if stream is not None:
            stream.close()
            entries.append({"name": name, "bytes": size, "records": count, "starts": starts})
        return Written(entries)

    def commit(self, messages: list[Written]) -> None:
        self.files.publish([e for m in messages if m for e in m.entries])

    def abort(self, messages: list[Written]) -> None:
        self.files.remove([e["name"] for m in messages if m for e in m.entries])


_COMPARED = {
    EqualTo: operator.eq,
    GreaterThan: operator.gt,
    GreaterThanOrEqual: operator.ge,
    LessThan: operator.lt,
    LessThanOrEqual: operator.le,
    StringStartsWith: str.startswith,
    StringEndsWith: str.endswith,
    StringContains: operator.contains,
}


def _test(found: Filter) -> tuple[str, Callable] | None:
    """Column and test of a filter that headers can answer; None leaves it to Spark.

    A comparison with a null is unknown, and so is its negation: neither is in the result. Tests for
    null and null-safe equality are never unknown.
    """
    asked = found.child if isinstance(found, Not) else found
    path, value = getattr(asked, "attribute", ()), getattr(asked, "value", None)
    if len(path) != 1 or path[0] not in COLUMNS:
        return None
    certain = True
    if isinstance(asked, IsNull):
        test = lambda x: x is None
    elif isinstance(asked, IsNotNull):
        test = lambda x: x is not None
    elif isinstance(asked, EqualNullSafe):
        test = lambda x: x == value
    elif isinstance(asked, In) and None not in value:
        certain, test = False, lambda x: x in value
    elif type(asked) in _COMPARED and value is not None:
        certain, test = False, lambda x: _COMPARED[type(asked)](x, value)
    else:
        return None
    if isinstance(found, Not):
        return path[0], lambda x: (certain or x is not None) and not test(x)
    return path[0], lambda x: (certain or x is not None) and test(x)


@dataclass
class Files(InputPartition):
    spans: tuple[tuple[str, int, int], ...]  # name, first byte, byte behind the last


class _Reader(DataSourceReader):
    """payload: ``bytes`` returns payloads, ``verify`` checks them against the digest, ``none`` skips."""

    def __init__(self, path: str, payload: str, split_bytes: int) -> None:
        if payload not in ("bytes", "verify", "none"):
            raise ValueError("payload is one of bytes, verify, none")
        self.files, self.payload, self.split_bytes, self.tests = FileSet(path), payload, split_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for found in filters:
            test = _test(found)
            if test:
                self.tests.append(test)
            else:
                yield found

    def partitions(self) -> list[Files]:
        """Up to ``split_bytes`` each: small files share a partition, large ones are cut where a record
        starts."""
        found, spans, size = [], [], 0
        for e in self.files.entries():
            for start, end in zip(e["starts"], [*e["starts"][1:], e["bytes"]]):
                if spans and size + end - start > self.split_bytes:
                    found.append(Files(tuple(spans)))
                    spans, size = [], 0
                size += end - start
                if spans and spans[-1][0] == e["name"]:
                    start = spans.pop()[1]
                spans.append((e["name"], start, end))
        return [*found, Files(tuple(spans))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for name, start, end in partition.spans:
            with self.files.open(name) as stream:
                for row in self.records(stream, start, end):
                    rows.append(row)
                    size += 200 + (len(row[-1]) if self.payload == "bytes" else 0)
                    if size >= BATCH_BYTES:
                        yield self.batch(rows)
                        rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64() if t == "long" else pa.string() for _, t in COLUMNS.values()]
        names = [*COLUMNS]
        if self.payload == "bytes":
            kinds, names = [*kinds, pa.binary()], [*names, "payload"]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def records(self, stream, at: int, end: int) -> Iterator[tuple]:
        end = min(end, stream.size())
        while at < end:
            stream.seek(at)
            head = stream.read(_HEAD)
            if len(head) < _HEAD or not head.startswith(_FIXED):
                raise ValueError(f"no record with skip lengths at byte {at}")
            size, length = _LENGTHS.unpack_from(head, len(_FIXED))
            inflate, headers, rest = zlib.decompressobj(-15), b"", size - _HEAD
            while b"\r\n\r\n" not in headers:  # the headers alone, a little at a time
                taken = stream.read(min(rest, 512))
                if not taken:
                    raise ValueError(f"the record at byte {at} has no end of headers")
                rest -= len(taken)
                headers += inflate.decompress(taken)
            headers, _, body = headers.partition(b"\r\n\r\n")
            fields = {k.decode().lower(): v for k, v in _LINE.findall(headers + b"\r\n")}
            row = tuple(_value(fields, *c) for c in COLUMNS.values())
            values = dict(zip(COLUMNS, row))
            if all(test(values[c]) for c, test in self.tests):
                payload = b""
                if self.payload != "none":
                    body += inflate.decompress(stream.read(rest)) if rest else b""
                    payload = body[: int(fields["content-length"])]
                    if len(headers) + 4 + len(body) != length:
                        raise ValueError(f"the record at byte {at} is cut off")
                    if values["record_type"] == "response":
                        digest = base32(hashlib.sha1(payload).digest())
                        if digest != values["payload_digest"] or len(payload) != values["payload_bytes"]:
                            raise ValueError(f"the payload at byte {at} does not match its digest")
                yield (*row, payload) if self.payload == "bytes" else row
            at += size


def _value(fields: dict[str, bytes], header: str, kind: str):
    raw = fields.get(header.lower())
    if raw is None:
        return None
    text = _unline(raw)
    if header in ("WARC-Record-ID", "WARC-Refers-To"):
        text = text.removeprefix("<urn:page:").removesuffix(">")
    elif header == "WARC-Payload-Digest":
        text = text.removeprefix("sha1:")
    return (int(text) if text else None) if kind == "long" else text


class Warc(DataSource):
    """Format ``warc``. Options: path, payload, split_bytes; to write: file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        columns = [f"{name} {kind}" for name, (_, kind) in COLUMNS.items()]
        if self.options.get("payload", "bytes") == "bytes":
            columns.append("payload binary")
        return ", ".join(columns)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)))

    def reader(self, schema) -> _Reader:
        payload = self.options.get("payload", "bytes")
        return _Reader(self.options["path"], payload, int(self.options.get("split_bytes", 32 << 20)))


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html with sha1, payload_bytes, record_type and refers_to.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is
    the response and the others revisit it; smaller payloads are all responses. A null html is empty.
    A null page_id is smaller than any; rows of equal payload without any id are all responses, and
    so are rows that repeat the largest id. Payloads are compared by SHA-1 and length. The largest id
    is a map-side maximum, and the groups, one row each, meet the pages in a join that Spark can
    split where one payload is frequent; the payload itself moves once at most.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    sha1, length, largest, g_sha1, g_length = map(own, ("sha1", "length", "largest", "g", "g"))
    base = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias(sha1)).withColumn(
        length, F.octet_length("html").cast("long")
    )
    groups = (
        base.where(F.col(length) >= min_bytes)
        .groupBy(F.col(sha1).alias(g_sha1), F.col(length).alias(g_length))
        .agg(F.max("page_id").alias(largest), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col(largest).isNotNull())
        .drop("n")
    )
    same = (F.col(sha1) == F.col(g_sha1)) & (F.col(length) == F.col(g_length))
    again = F.col(largest).isNotNull() & ~F.col("page_id").eqNullSafe(F.col(largest))
    return base.join(groups, same, "left").select(
        "page_id",
        "url",
        "html",
        F.col(sha1).alias("sha1"),
        F.col(length).alias("payload_bytes"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col(largest)).alias("refers_to"),
    )


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record per row of ``pages`` (page_id, url, html); see :func:`with_roles`."""
    pages.sparkSession.dataSource.register(Warc)
    with_roles(pages, min_bytes).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: str = "bytes") -> DataFrame:
    """Records of the archives at ``path``. Filters on columns that stand in headers are pushed down.

    The session's setting for filters of Python data sources is turned on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("payload", payload).load(path)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` below the shared folder and read them back, every payload checked.

    Responses are read with their payloads, revisits from their headers alone; both conditions are
    answered by the source, so a record that isn't asked for costs its headers.
    """
    path, spark = work_folder(pages.sparkSession, "warc"), pages.sparkSession
    write_warc(pages, path, min_bytes)
    responses = read_warc(spark, path, "verify").where(F.col("refers_to").isNull())
    revisits = read_warc(spark, path, "none").where(F.col("record_type") == "revisit")
    return responses.unionByName(revisits)
