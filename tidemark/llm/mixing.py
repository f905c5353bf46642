"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import own, ranked, written

BLOCK = 16  # rows of one source that stay together
FRAME = 4096  # slots of a frame for which weights are rounded, where that is asked for
BATCH = 1 << 14  # blocks of the schedule that are written at a time
EXPONENT = 0.7  # without given weights, a source weighs its number of rows to this power
SEED = 17
BROADCAST = 100_000  # sources up to which their table, a short row each, is broadcast


def shares(weights: Mapping[object, float], frame: int = FRAME) -> dict[object, int]:
    """Slots per frame for each source, by largest remainder; at least one each, ``frame`` in all."""
    if not weights:
        return {}
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    if len(weights) > frame:
        raise ValueError(f"{len(weights)} sources need a frame of as many slots, not {frame}")
    total, free = sum(weights.values()), frame - len(weights)
    exact = {s: free * w / total for s, w in weights.items()}
    found = {s: 1 + int(x) for s, x in exact.items()}
    rest = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))
    for s in rest[: frame - sum(found.values())]:
        found[s] += 1
    return found


def course(weights: Sequence[int], blocks: Sequence[int]) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """(source, number, release, deadline, slot, on_target) for every block, slot by slot.

    The block numbered i of a source with the share w of all weights may run from slot floor(i / w)
    and must have run before slot ceil((i + 1) / w), in whole numbers without rounding. Each slot
    takes, of the blocks released, the one with the earliest deadline (ties: the source named first).
    As the shares sum up to one, every block meets its deadline, so in every prefix no source is a
    whole block ahead of its share or behind it. Where a source should run and has no block left,
    ``on_target`` ends: the sources with blocks left start again from that slot at their proportions.
    """
    done, slot, on_target = [0] * len(blocks), 0, True
    while active := [k for k, n in enumerate(blocks) if done[k] < n]:
        if on_target:
            active = list(range(len(blocks)))
        total, origin, started = sum(weights[k] for k in active), slot, done.copy()
        waiting = [(origin, k) for k in active]  # (release, source)
        ready: list[tuple[int, int, int]] = []
        while True:
            while waiting and waiting[0][0] <= slot:
                release, k = heapq.heappop(waiting)
                ahead = done[k] - started[k] + 1
                heapq.heappush(ready, (origin - (-ahead * total // weights[k]), k, release))
            deadline, k, release = heapq.heappop(ready)
            if done[k] == blocks[k]:
                on_target = False
                break
            if slot >= deadline:
                raise AssertionError("a deadline was missed")
            yield k, done[k], release, min(deadline, (1 << 63) - 1), slot, on_target
            done[k] += 1
            slot += 1
            heapq.heappush(waiting, (origin + (done[k] - started[k]) * total // weights[k], k))


def schedule(slots: Mapping[object, int]) -> list[tuple[object, int, int, int, int]]:
    """(source, number, release, deadline, slot) for each block of one frame, see ``course``."""
    names = sorted(slots, key=str)
    found = course([slots[s] for s in names], [slots[s] for s in names])
    return [(names[k], *rest[:-1]) for k, *rest in found]


def whole(weights: Mapping[object, float]) -> dict[object, int]:
    """The weights in whole numbers of exactly their proportions."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*[x.denominator for x in exact.values()])
    return {s: int(x * unit) for s, x in exact.items()}


def _courses(spark: SparkSession, weights: Sequence[int], blocks: Sequence[int], names: Sequence[str]) -> DataFrame:
    """``course`` as a table, made by one task that holds a heap of the sources and one batch."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = course(weights, blocks)
                while part := list(itertools.islice(found, BATCH)):
                    columns = [pa.array(c, t) for c, t in zip(zip(*part), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, names=list(names))

    types = ("int", "long", "long", "long", "long", "boolean")
    made = spark.range(0, 1, 1, 1).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types)))
    return written(made, "mix-schedule")


def target_weights(docs: DataFrame, source: str = "source", exponent: float = EXPONENT) -> dict:
    """Weights by the number of rows to the power ``exponent``: 1 in proportion, 0 all alike."""
    counts = docs.groupBy(source).count().collect()  # one row per source
    return {r[0]: r[1] ** exponent for r in counts}


def mixed(
    docs: DataFrame,
    weights: Mapping[object, float] | None = None,
    source: str = "source",
    block: int = BLOCK,
    frame: int | None = None,
    exponent: float = EXPONENT,
    seed: int = SEED,
    default: float | None = None,
) -> DataFrame:
    """Every row of ``docs`` once, with ``mix_block``, ``mix_release``, ``mix_deadline``, ``mix_slot``,
    ``mix_place`` (its place in the block) and ``on_target``. Sorted by (mix_slot, mix_place) the
    rows interleave the sources.

    A source's rows are put in the order of a seeded hash of their id (ties by all columns) and cut
    into blocks of ``block``. All blocks are scheduled over the whole length at the weights as they
    are (``course``), so in every prefix of slots each source is less than one block from its target
    however many sources there are, as long as it has blocks left: ``on_target`` is true for the slots
    up to where the first source runs out. After it the others go on in their proportions, each less
    than a block from them counted from where a source last ran out. Slots are 0, 1, … without gaps.
    With ``frame`` the weights are rounded to ``shares`` of so many slots first.

    The schedule is made in one pass by one task, a step a block; it reads and holds no rows, and each
    source that runs out costs it a step a source. It meets the rows in a join by block.
    A block's slot is unique, so an order by (mix_slot, mix_place) has no ties. No row is dropped or
    repeated whatever the weights.

    Sources absent from ``weights`` have the weight ``default``; without one they are refused, since
    they have no target. A null source is a source.
    Without weights they follow ``target_weights``. Sources number ``frame`` at most, if given. Repeated rows
    are rows of their own. Existing columns of the new names are replaced. Rows are numbered by a
    range partitioning on (source, hash), so a source with most rows is spread like any other.
    """
    new = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place", "on_target")
    kept = [c for c in docs.columns if c not in new]
    spark = docs.sparkSession
    columns = [F.col(f"`{c}`") for c in kept]
    counted = {r[0]: r[1] for r in docs.groupBy(source).count().collect()}  # one row per source
    if weights is None:
        weights = {s: n**exponent for s, n in counted.items()}
    absent = [s for s in counted if s not in weights]
    if absent and default is None:
        raise ValueError(f"no weight for {absent[:5]}")
    weights = {s: weights.get(s, default) for s in counted}
    slots = whole(weights) if frame is None else shares(weights, frame)
    row, order, start = own("row"), own("order"), own("start")
    texts = [c.cast("string") for c in columns]
    hashed = docs.select(*columns, F.xxhash64(F.lit(seed), F.col("doc_id")).alias(order))
    placed = ranked(
        hashed,
        [F.col(source).asc_nulls_first(), F.col(order), F.col("doc_id"), F.xxhash64(*texts)],
        row,
        "mixing",
    )
    kind = docs.schema[source].dataType.simpleString()
    begins, before = {}, 0
    for s in sorted(counted, key=lambda s: (s is not None, s)):
        begins[s] = before
        before += counted[s]
    names = sorted(counted, key=str)
    own_source, number, of, at = own("source"), own("number"), own("of"), own("at")
    sources = spark.createDataFrame(
        [(s, k, begins[s]) for k, s in enumerate(names)], f"{own_source} {kind}, {number} int, {start} long"
    )
    new_columns = ("mix_release", "mix_deadline", "mix_slot", "on_target")
    blocks = [-(-counted[s] // block) for s in names]
    table = _courses(spark, [slots[s] for s in names], blocks, (of, at, *new_columns))
    inside = F.col(row) - F.col(start)
    if len(names) <= BROADCAST:
        sources = F.broadcast(sources)
    numbered = placed.join(sources, F.col(source).eqNullSafe(F.col(own_source))).withColumn(
        "mix_block", F.floor(inside / F.lit(block)).cast("long")
    )
    numbered = numbered.withColumn("mix_place", F.pmod(inside, F.lit(block)).cast("int"))
    same = (F.col(number) == F.col(of)) & (F.col("mix_block") == F.col(at))
    return numbered.join(table, same).select(
        *columns, "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place", "on_target"
    )
