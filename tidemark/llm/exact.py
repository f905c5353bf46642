"""Exact deduplication against a history indexed by minimal perfect hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import LOWER, UPPER, own, whole_text, written

SHARD = 1 << 16  # distinct digests a shard holds on average
GAMMA = 1.5  # bits of a level for each digest that reaches it
LEVELS = 48  # digests that no level has placed are kept in order behind the others
DIGEST = 32  # bytes

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _spread(words: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of every digest (four words a row) for one level."""
    with np.errstate(over="ignore"):
        x = np.full(len(words), np.uint64(level + 1) * _MIX[0])
        for column in words.T:
            x = x ^ column
            x = (x ^ (x >> np.uint64(30))) * _MIX[1]
            x = (x ^ (x >> np.uint64(27))) * _MIX[2]
            x = x ^ (x >> np.uint64(31))
    return x


def _words(digests: np.ndarray) -> np.ndarray:
    return digests.view("<u8").reshape(-1, DIGEST // 8)


class PerfectHash:
    """A minimal perfect hash of distinct digests: n of them have the slots 0 to n - 1.

    A level gives every digest that reaches it a bit; those alone at theirs stay and set it, the
    others go on to the next. A digest's slot is the number of bits set before its own, over all
    levels. One that isn't in the set gets any slot, or none, so what the slot holds must be compared.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray) -> None:
        self.levels, self.rest = levels, rest
        self.before = [np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]) for bits in levels]
        self.count = sum(int(b[-1]) for b in self.before) + len(rest)

    @classmethod
    def of(cls, digests: np.ndarray) -> PerfectHash:
        """From distinct digests, a row of bytes each."""
        left, levels = _words(digests), []
        while len(left) and len(levels) < LEVELS:
            size = int(GAMMA * len(left)) + 8
            at = (_spread(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        rest = np.ascontiguousarray(left).view(f"S{DIGEST}").ravel() if len(left) else np.empty(0, f"S{DIGEST}")
        return cls(levels, np.sort(rest))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 where it is certain that it isn't in the set."""
        words = _words(digests)
        found, left, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
        for level, (bits, before) in enumerate(zip(self.levels, self.before)):
            at = (_spread(words[left], level) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at]
            found[left[here]] = base + before[at[here]]
            left, base = left[~here], base + int(before[-1])
        if len(self.rest) and len(left):
            asked = np.ascontiguousarray(words[left]).view(f"S{DIGEST}").ravel()
            at = np.searchsorted(self.rest, asked).clip(max=len(self.rest) - 1)
            found[left] = np.where(self.rest[at] == asked, base + at, -1)
        return found

    def dump(self) -> dict:
        return {
            "sizes": [len(b) for b in self.levels],
            "bits": b"".join(np.packbits(b).tobytes() for b in self.levels),
            "rest": _words(np.frombuffer(self.rest.tobytes(), np.uint8)).tobytes(),
        }

    @classmethod
    def load(cls, sizes: list[int], bits: bytes, rest: bytes) -> PerfectHash:
        levels, at = [], 0
        for size in sizes:
            stored = np.frombuffer(bits, np.uint8, -(-size // 8), at)
            levels.append(np.unpackbits(stored, count=size).astype(bool))
            at += len(stored)
        return cls(levels, np.frombuffer(rest, f"S{DIGEST}"))


def digest(column: str = "text") -> Column:
    """SHA-256 (32 bytes) of the text in UTF-8 with A-Z lower-cased; a null counts as empty."""
    return F.unhex(F.sha2(F.translate(whole_text(column), UPPER, LOWER), 256))


#: What a group of equal texts is known by: its winner's locator and its number of rows.
LOCATOR = "struct<id: long, row: long>"
INDEX = (
    "shard int, sizes array<int>, bits binary, rest binary, digests binary, winners_id array<long>, "
    "winners_row array<long>, members array<long>"
)


def _winner() -> Column:
    """The locator of the row that stays: the largest id, nulls below all; then the largest row."""
    return F.max(F.struct(F.col("id"), F.col("row"))).alias("winner")


def grouped(digests: DataFrame) -> DataFrame:
    """(digest, winner, members) for every distinct digest; a group is a map-side maximum and count."""
    return digests.groupBy("digest").agg(_winner(), F.count(F.lit(1)).alias("members"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    """A column of digests as one row of bytes after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def index(groups: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the perfect hash of its digests, and by slot the whole digest, the winner's
    locator (id and row) and the number of members.

    A shard holds ``SHARD`` digests or so, as they are spread by hash, whatever their groups' sizes.
    """

    def build(key: tuple, table: pa.Table) -> pa.Table:
        digests = _bytes(table["digest"])
        hashed = PerfectHash.of(digests)
        order = np.empty(hashed.count, np.int64)
        order[hashed.slots(digests)] = np.arange(hashed.count)
        by_slot = table.take(pa.array(order))
        winner = by_slot["winner"].combine_chunks()
        row = hashed.dump() | {
            "shard": key[0].as_py(),
            "digests": b"".join(by_slot["digest"].to_pylist()),
            "winners_id": winner.field("id").to_pylist(),
            "winners_row": winner.field("row").to_pylist(),
            "members": by_slot["members"].to_pylist(),
        }
        return pa.Table.from_pylist([row], schema)

    schema = pa.schema(
        [("shard", pa.int32()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("rest", pa.binary())]
        + [("digests", pa.binary()), ("winners_id", pa.list_(pa.int64()))]
        + [("winners_row", pa.list_(pa.int64())), ("members", pa.list_(pa.int64()))]
    )
    marked = groups.select(_shard(shards), "digest", "winner", "members")
    return marked.groupBy("shard").applyInArrow(build, INDEX)


def looked_up(groups: DataFrame, indexed: DataFrame, shards: int) -> DataFrame:
    """Every row of ``groups`` with ``past`` and ``past_members``: what the index holds of its digest.

    A slot counts only if all 32 bytes it holds are the digest's; both are null for a digest that the
    index doesn't have. A shard meets the distinct digests of its own hash range, never its documents.
    """
    names = ["digest", "winner", "members", "past", "past_members"]
    pair = pa.struct([("id", pa.int64()), ("row", pa.int64())])
    schema = pa.schema(
        [("digest", pa.binary()), ("winner", pair), ("members", pa.int64()), ("past", pair)]
        + [("past_members", pa.int64())]
    )

    def ask(asked: pa.Table, stored: pa.Table) -> pa.Table:
        count = asked.num_rows
        past, members = [None] * count, [None] * count
        if count and stored.num_rows:
            shard = stored.to_pylist()[0]
            hashed = PerfectHash.load(shard["sizes"], shard["bits"], shard["rest"])
            digests = _bytes(asked["digest"])
            slots = hashed.slots(digests)
            held = np.frombuffer(shard["digests"], np.uint8).reshape(-1, DIGEST)
            same = (held[slots.clip(min=0)] == digests.reshape(-1, DIGEST)).all(axis=1) & (slots >= 0)
            for k, slot in zip(np.flatnonzero(same).tolist(), slots[same].tolist()):
                past[k] = {"id": shard["winners_id"][slot], "row": shard["winners_row"][slot]}
                members[k] = shard["members"][slot]
        columns = [*(asked[c] for c in names[:3]), pa.array(past, pair), pa.array(members, pa.int64())]
        return pa.table([c.cast(t) for c, t in zip(columns, schema.types)], names=names)

    marked = groups.select(_shard(shards), "digest", "winner", "members")
    found = marked.groupBy("shard").cogroup(indexed.groupBy("shard")).applyInArrow(
        ask, f"digest binary, winner {LOCATOR}, members long, past {LOCATOR}, past_members long"
    )
    return found


def deduplicated(docs: DataFrame, history: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, with ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Rows for which ``history`` holds are the past: their distinct digests make a minimal perfect hash,
    whose slots have the digest, the row that stays so far and the number of rows. The digests of all
    other rows are looked up in it and compared whole; those that are members join their group, the
    rest are grouped among themselves. ``history`` decides how a copy is found, not the result.

    Texts are equal when their bytes are after lower-casing A-Z (a null is empty), told by SHA-256 of
    all of it. The row with the largest id stays (a null id is below all), of rows that share that id
    one. A repeated row counts as a row. ``keep_id`` is null only where all ids of the group are.
    ``id`` is a whole number. Columns of the new names are replaced; an empty table gives none.

    Texts are hashed where they lie. What moves is a digest, an id and a row number a row, once to the
    groups (map-side maximum) and once to the answer, where a group's side has one row a digest, so
    Spark can split a group that holds most rows.
    """
    rest = [c for c in docs.columns if c not in (text, "keep_id", "group_size", "kept", "text_sha256")]
    row, key, past = own("row"), own("digest"), own("past")
    carried = [F.col(f"`{c}`") for c in rest]
    hashed = written(
        docs.select(
            *carried,
            digest(text).alias(key),
            F.coalesce(history, F.lit(False)).alias(past),
            F.monotonically_increasing_id().alias(row),
        ),
        "digests",
    )
    short = hashed.select(past, F.col(key).alias("digest"), F.col(f"`{id}`").cast("long").alias("id"), F.col(row).alias("row"))
    known = written(grouped(short.where(F.col(past))), "digests-past")
    fresh = written(grouped(short.where(~F.col(past))), "digests-new")
    shards = 1 + max(known.count(), fresh.count()) // SHARD
    indexed = written(index(known, shards), "digest-index")
    found = written(looked_up(fresh, indexed, shards), "digest-answers")
    # A member's group is the past one and the rows that joined it; the rest of the past is as it was.
    new = F.greatest("winner", "past")  # a null is passed over
    asked = found.select("digest", new.alias("winner"), (F.col("members") + F.coalesce("past_members", F.lit(0))).alias("members"))
    untouched = known.join(found.select("digest"), "digest", "left_anti")
    groups = asked.unionByName(untouched).select(
        F.col("digest").alias("_digest"), F.col("winner").alias("_winner"), F.col("members").alias("_members")
    )
    return hashed.join(groups, F.col(key) == F.col("_digest")).select(
        *carried,
        F.col("_winner.id").alias("keep_id"),
        F.col("_members").alias("group_size"),
        (F.col(row) == F.col("_winner.row")).alias("kept"),
        F.lower(F.hex(key)).alias("text_sha256"),
    )


def history(id: str = "doc_id") -> Column:
    """The rows that the query takes as the past: every other one by the checksum of the id."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % 2 == 0


