"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A file is a header, one zstandard frame per document, an index and a trailer:

    header   "TMTOKEN1", bytes per id (1 byte), SHA-256 of the dictionary (32 bytes; zeros: none)
    frames   each document's ids, little-endian, compressed by itself with the dictionary
    index    zstandard frame of four little-endian arrays: doc_id (int64), has id (uint8),
             offset of the frame (uint64, one more than documents), number of ids (uint64)
    trailer  offset of the index, number of documents (uint64 each), "TMTOKEN1"

The folder also holds the dictionary, named by its hash, and the manifest.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from tidemark.llm.common import own
from tidemark.llm.filesets import FileSet
from tidemark.llm.tokens import encoder
from tidemark.session import work_folder

MAGIC = b"TMTOKEN1"
HEADER = struct.Struct("<8sB32s")
TRAILER = struct.Struct("<QQ8s")
NO_DICTIONARY = bytes(32)
DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS = 400  # documents the dictionary is trained on, at most
SAMPLE_CHARS = 8000  # code points of each, at most
LEVEL = 3
BATCH_BYTES = 8 << 20


def dictionary_of(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on serialized id arrays; empty where there is too little to train on."""
    if len(samples) < 8 or sum(map(len, samples)) < 8 * 1024:
        return b""
    size = min(size, max(1024, sum(map(len, samples)) // 8))
    return zstandard.train_dictionary(size, samples).as_bytes()


def dictionary_name(digest: bytes) -> str:
    return f"dictionary-{digest.hex()}.zdict"


def _parameters(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


class FileWriter:
    """One file, written document by document."""

    def __init__(self, stream, dictionary: bytes, width: int) -> None:
        self.stream, self.width = stream, width
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, **_parameters(dictionary))
        digest = hashlib.sha256(dictionary).digest() if dictionary else NO_DICTIONARY
        stream.write(HEADER.pack(MAGIC, width, digest))
        self.offsets, self.ids, self.counts = [HEADER.size], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        if self.width == 2:
            array = np.frombuffer(ids, "<u4")
            if array.size and int(array.max()) > 0xFFFF:
                raise ValueError("an id doesn't fit in two bytes; write with width 4")
            data = array.astype("<u2").tobytes()
        else:
            data = ids
        frame = self.compressor.compress(data)
        self.stream.write(frame)
        self.offsets.append(self.offsets[-1] + len(frame))
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)

    def close(self) -> None:
        index = b"".join(
            [
                np.array([i or 0 for i in self.ids], "<i8").tobytes(),
                np.array([i is not None for i in self.ids], "u1").tobytes(),
                np.array(self.offsets, "<u8").tobytes(),
                np.array(self.counts, "<u8").tobytes(),
            ]
        )
        self.stream.write(zstandard.ZstdCompressor().compress(index))
        self.stream.write(TRAILER.pack(self.offsets[-1], len(self.ids), MAGIC))
        self.stream.close()


class FileReader:
    """One file; any document can be read by itself."""

    def __init__(self, files: FileSet, name: str) -> None:
        self.stream = files.open(name)
        size = self.stream.size()
        self.stream.seek(size - TRAILER.size)
        at, count, magic = TRAILER.unpack(self.stream.read(TRAILER.size))
        self.stream.seek(0)
        first, self.width, self.digest = HEADER.unpack(self.stream.read(HEADER.size))
        if magic != MAGIC or first != MAGIC:
            raise ValueError(f"{name} is no token file")
        self.stream.seek(at)
        index = zstandard.ZstdDecompressor().decompress(self.stream.read(size - TRAILER.size - at))
        cuts = np.cumsum([0, 8 * count, count, 8 * (count + 1), 8 * count])
        parts = [index[a:b] for a, b in zip(cuts, cuts[1:])]
        self.doc_ids, self.has_id, self.offsets, self.counts = (
            np.frombuffer(p, kind) for p, kind in zip(parts, ("<i8", "u1", "<u8", "<u8"))
        )
        dictionary = b""
        if self.digest != NO_DICTIONARY:
            dictionary = files.get(dictionary_name(self.digest))
            if hashlib.sha256(dictionary).digest() != self.digest:
                raise ValueError(f"{name} was written with another dictionary")
        self.decompressor = zstandard.ZstdDecompressor(**_parameters(dictionary))

    def document(self, i: int) -> bytes:
        """The ids of the file's i-th document, little-endian unsigned 32-bit."""
        begin, end = int(self.offsets[i]), int(self.offsets[i + 1])
        self.stream.seek(begin)
        data = self.decompressor.decompress(self.stream.read(end - begin))
        if self.width == 2:
            data = np.frombuffer(data, "<u2").astype("<u4").tobytes()
        if len(data) != 4 * int(self.counts[i]):
            raise ValueError("a frame and the index disagree")
        return data


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    documents: int
    tokens: int


class _Writer(DataSourceArrowWriter):
    """Takes doc_id and ids or, where a tokenizer is given, the text to encode."""

    def __init__(self, path: str, dictionary: bytes, width: int, tokenizer: str) -> None:
        self.files, self.dictionary, self.width = FileSet(path), dictionary, width
        self.tokenizer = tokenizer

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, stream = self.files.create(".tokens")
        out = FileWriter(stream, self.dictionary, self.width)
        ids_of = encoder(self.tokenizer).document if self.tokenizer else bytes
        for batch in iterator:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                out.add(doc_id, ids_of(value.as_py()))
        out.close()
        return Written(TaskContext.get().partitionId(), name, len(out.counts), sum(out.counts))

    def commit(self, messages: list[Written]) -> None:
        entries, start = [], 0
        for m in sorted((m for m in messages if m and m.documents), key=lambda m: m.partition):
            entries.append({"name": m.name, "documents": m.documents, "tokens": m.tokens, "start": start})
            start += m.tokens
        self.files.publish(entries)

    def abort(self, messages: list[Written]) -> None:
        self.files.remove([m.name for m in messages if m])


@dataclass
class File(InputPartition):
    name: str
    start: int


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.files = FileSet(path)

    def partitions(self) -> list[File]:
        return [File(e["name"], e["start"]) for e in self.files.entries()] or [File("", 0)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        file = FileReader(self.files, partition.name)
        starts = np.cumsum(np.concatenate([[partition.start], file.counts[:-1].astype(np.int64)]))
        rows, size = [], 0
        for i in range(len(file.counts)):
            data = file.document(i)
            doc_id = int(file.doc_ids[i]) if file.has_id[i] else None
            rows.append((doc_id, int(starts[i]), int(file.counts[i]), data))
            size += len(data)
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])


class TokenFiles(DataSource):
    """Format ``token_files``. Options: path; to write: dictionary (hexadecimal, or none), width, and
    tokenizer, a file by which the second column's texts are encoded."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        path = self.options["path"]
        digest = bytes.fromhex(self.options.get("dictionary", ""))
        dictionary = FileSet(path).get(dictionary_name(digest)) if digest else b""
        width, tokenizer = int(self.options.get("width", "2")), self.options.get("tokenizer", "")
        return _Writer(path, dictionary, width, tokenizer)

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def trained_dictionary(
    docs: DataFrame, tokenizer: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, width: int = 2
) -> bytes:
    """A dictionary from a bounded sample: the ``rows`` rows with the smallest hash, of each a stretch of
    ``chars`` code points at a hashed place.

    Only rows whose hash is below a bound by the count, about twice as many as are taken, are sent to
    the driver, however large the table is.
    """
    mark = own("mark")
    texts = docs.where(F.col("text").isNotNull()).select("text", F.xxhash64("doc_id", "text").alias(mark))
    share = min(1.0, (2 * rows + 100) / max(texts.count(), 1))
    place = F.pmod(F.col(mark), F.greatest(F.length("text") - chars + 1, F.lit(1)).cast("long")) + 1
    drawn = texts.where(F.col(mark) / F.lit(2.0**64) + F.lit(0.5) <= share).select(
        mark, F.substring("text", place.cast("int"), F.lit(chars)).alias("text")
    )
    found = sorted((r[mark], r["text"]) for r in drawn.collect())[:rows]
    encode = encoder(tokenizer).document
    sample = [encode(text) for _, text in found]
    if width == 2:
        sample = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in sample]
    return dictionary_of(sample)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, width: int = 2) -> None:
    """Encode every row's whole text and write it to token files at ``path``, ascending by doc_id.

    Null ids come first; rows of one id are in the order of their texts' hash, and repeated rows are
    written each. A null or empty text is the end id alone. The rows are range-partitioned, one file a
    partition, and encoded after that, so texts are what is shuffled, once. An empty table writes no
    file.
    """
    dictionary = trained_dictionary(docs, tokenizer, width=width)
    digest = hashlib.sha256(dictionary).digest() if dictionary else b""
    if dictionary:
        FileSet(path).put(dictionary_name(digest), dictionary)
    docs.sparkSession.dataSource.register(TokenFiles)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sorted_docs = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    options = {"dictionary": digest.hex(), "width": width, "tokenizer": tokenizer}
    sorted_docs.write.format("token_files").options(**options).mode("append").save(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit)."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").load(path)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to files below the shared folder and read them back, with ``ids_crc32``."""
    path = work_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path).withColumn("ids_crc32", F.crc32("ids"))
