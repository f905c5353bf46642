"""SimHash near-duplicates found by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import own, written
from tidemark.llm.components import connected

SHINGLE = 3
RADIUS = 2
SEED = 42


def fingerprint_of(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text: words are split by ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    count = len(words) - size + 1
    spans = zip(starts[:count].tolist(), ends[size - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, count)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):  # a long text's bits are unpacked piece by piece
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > count).tobytes(), "big")


def fingerprints(docs: DataFrame, out: str, shingle: int = SHINGLE) -> DataFrame:
    """Every row of ``docs`` without its text, with ``out``: the SimHash as a signed long.

    A text of fewer words than a shingle is one shingle; one without words, or null, has zero.
    """
    rest = [c for c in docs.columns if c not in ("text", out)]
    schema = docs.select(*[f"`{c}`" for c in rest]).schema.add(out, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            # One text at a time: the longest decides about memory, not the batch.
            found = [fingerprint_of(t.as_py() or "", shingle) for t in texts]
            prints = pa.array(np.array(found, np.uint64).view(np.int64))
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, prints], names=schema.names)

    return docs.select(*[f"`{c}`" for c in rest], "text").mapInArrow(run, schema)


def ball(fingerprint: Column, radius: int) -> Column:
    """All 64-bit values within ``radius`` flipped bits, the value itself first."""
    found, flips = F.array(fingerprint), F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)])
    for _ in range(radius):
        near = F.flatten(F.transform(found, lambda x: F.transform(flips, lambda f: x.bitwiseXOR(f))))
        found = F.array_distinct(F.concat(found, near))
    return found


def collisions(prints: DataFrame, column: str, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a < b, that connect all distinct values of ``column`` at ``radius`` bits or less.

    Every distinct value emits all variants within half the radius. Two values within the radius meet
    at a variant midway, so grouping by variant finds them. A variant gathers no more values than its
    ball has (65 for radius 2), however many documents there are, as equal values were merged before.
    Members of a variant are all within the radius of each other, so its smallest member is linked to
    the others, which keeps every connection without emitting all pairs. Links found at several
    variants are merged and checked bit by bit. An odd radius is refused.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even")
    values = prints.select(F.col(column).alias("_value")).where(F.col(column).isNotNull()).distinct()
    # Values are short and their variants many, so they are spread once more, by number: a shuffle
    # that was asked for with a number is not merged by size, as that of the distinct values is.
    spread = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = values.repartition(spread, F.xxhash64("_value"))
    variants = values.select(F.explode(ball(F.col("_value"), radius // 2)).alias("_variant"), "_value")
    met = variants.groupBy("_variant").agg(F.collect_list("_value").alias("_members"))
    links = (
        met.where(F.size("_members") > 1)
        .select(F.array_min("_members").alias("a"), F.explode("_members").alias("b"))
        .where("a < b")
        .distinct()
    )
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _labelled(docs: DataFrame, shingle: int, radius: int, value: str, root: str, least: str) -> DataFrame:
    """Every row without its text, with its fingerprint, its component's smallest fingerprint and id."""
    node = own("node")
    prints = written(fingerprints(docs, value, shingle), "simhash")
    links = written(collisions(prints, value, radius), "simhash-links")
    found = connected(links, "a", "b").select(F.col("node").alias(node), F.col("root").alias(root))
    classes = prints.groupBy(value).agg(F.min("doc_id").alias(least)).join(
        found, F.col(value) == F.col(node), "left"
    ).select(F.col(value).alias(node), F.coalesce(root, value).alias(root), least)
    ids = classes.groupBy(root).agg(F.min(least).alias(least))
    labels = classes.select(node, root).join(ids, root)
    return prints.join(labels, F.col(value) == F.col(node)).drop(node)


def components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Every row of ``docs`` without its text, with ``fingerprint`` (16 hex digits), ``component_id``.

    Documents are linked if their fingerprints differ in ``radius`` bits or fewer; ``component_id`` is
    the smallest doc_id reachable over links, itself included. Equal fingerprints are one node, so
    copies cost one row each and no pairs. Texts without words (empty or null ones too) have
    fingerprint zero and are linked like any other. Repeated rows are returned each; null ids are
    passed over: a component's id is null only if all its ids are. Columns named ``fingerprint`` or
    ``component_id`` are replaced.
    """
    rest = [c for c in docs.columns if c not in ("text", "fingerprint", "component_id")]
    value, root, least = own("value"), own("root"), own("least")
    source = docs.select(*[f"`{c}`" for c in rest], "text")
    return _labelled(source, shingle, radius, value, root, least).select(
        *[F.col(f"`{c}`") for c in rest],
        F.lower(F.lpad(F.hex(value), 16, "0")).alias("fingerprint"),
        F.col(least).alias("component_id"),
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest doc_id.

    Of rows that share that doc_id the one with the smallest hash of all columns stays, and of equal
    rows one. A row without an id stays only where its whole component has none. Only ids, fingerprints
    and hashes are shuffled to find what stays; a component's first row is a map-side minimum, so a
    large component is no burden.
    """
    row, value, root, least = own("row"), own("value"), own("root"), own("least")
    marked = docs.withColumn(row, F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    labelled = _labelled(marked.select("doc_id", row, "text"), shingle, radius, value, root, least)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(row).alias("h"))
    stay = labelled.groupBy(root).agg(F.min(order).alias("_first"))
    stay = stay.select(F.col("_first.h").alias("_h"), F.col("_first.d").alias("_d")).distinct()
    same = (marked[row] == stay["_h"]) & marked["doc_id"].eqNullSafe(stay["_d"])
    kept = marked.hint("shuffle_merge").join(stay, same, "left_semi")
    return kept.dropDuplicates([row]).select(*[F.col(f"`{c}`") for c in docs.columns])
