"""Packing by power-of-two decomposition: pieces of binary lengths, each a sequence of its own."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import ranked, written
from tidemark.llm.tokens import encoder

LONGEST = 1024
OUT_BYTES = 8 << 20


def lengths(total: int, longest: int = LONGEST) -> list[int]:
    """The pieces of ``total`` tokens: as many of ``longest`` as fit, then the rest's powers of two."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    found = [longest] * (total // longest)
    rest, power = total % longest, longest >> 1
    while power:
        if rest & power:
            found.append(power)
        power >>= 1
    return found


def pieces(
    docs: DataFrame,
    tokenizer: str,
    longest: int = LONGEST,
    with_ids: bool = True,
    place: Sequence[str] = (),
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked, ids of every piece of every row.

    The columns ``place`` of a row go with each of its pieces, behind the others.
    The ids are little-endian unsigned 32-bit integers, and the checksum is theirs.
    A null or empty text is the end id alone: one piece of length 1. A repeated row is cut like any
    other. Rows are cut where they lie, without a shuffle.
    """
    lengths(0, longest)
    schema = docs.select("doc_id").schema
    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        schema = schema.add(name, "long")
    if with_ids:
        schema = schema.add("ids", "binary")
    arrow = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(schema) - 1]
    for field in docs.select(*place).schema:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).document

        def batch_of(batch, at, rows) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), arrow)]
            taken = [batch.column(i).take(pa.array(at, pa.int64())) for i in (0, *range(2, batch.num_columns))]
            return pa.RecordBatch.from_arrays([taken[0], *columns, *taken[1:]], names=schema.names)

        for batch in batches:
            at, rows, size = [], [], 0
            for number, text in enumerate(batch.column(1)):
                data = encode(text.as_py())
                total, start = len(data) // 4, 0
                for length in lengths(total, longest):
                    piece = data[4 * start : 4 * (start + length)]
                    row = (start, length, zlib.crc32(piece), total)
                    rows.append((*row, piece) if with_ids else row)
                    at.append(number)
                    size += len(piece) if with_ids else 40
                    start += length
                    if size >= OUT_BYTES:
                        yield batch_of(batch, at, rows)
                        at, rows, size = [], [], 0
            if rows:
                yield batch_of(batch, at, rows)

    return docs.select("doc_id", "text", *place).mapInArrow(run, schema)


def packed(
    docs: DataFrame,
    tokenizer: str,
    longest: int = LONGEST,
    with_ids: bool = True,
    place: Sequence[str] = (),
) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: every piece is one sequence, of its length.

    Lengths are powers of two, so nothing is padded and no sequence crosses documents. Sequences are
    numbered 0, 1, … by length, longest first, so those of one length, which can share a batch, are
    neighbours: within a length by the columns ``place`` if any are named, which are not returned,
    then doc_id (nulls first), start, and checksum. The pieces are numbered by a range partitioning on
    all of that, so a length that most pieces have is spread.
    """
    made = written(pieces(docs, tokenizer, longest, with_ids, place), "pieces")
    within = [F.col("doc_id").asc_nulls_first(), F.col("start"), F.col("ids_crc32")]
    order = [F.col("length").desc(), *[F.col(c) for c in place], *within]
    numbered = ranked(made, order, "sequence_id", "packing").drop(*place)
    return numbered.withColumn("offset", F.lit(0).cast("long"))
