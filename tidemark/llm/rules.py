"""Quality rules: a ledger of failure bits and measurements, and policies applied to the bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SPACE_BYTES = b" \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
GRAM = 5

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _share(part: str, whole: str) -> Column:
    """part / whole, and 0 where the whole is 0."""
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


#: When each rule fails. Its place is its bit and never changes; new rules are added at the end.
RULES = {
    "too_few_words": lambda: F.col("n_words") < 10,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
    "many_symbols": lambda: _share("n_symbols", "n_words") > 0.1,
    "repeated_lines": lambda: _share("n_dup_lines", "n_lines") > 0.5,
    "long_words": lambda: _share("word_chars", "n_words") > 40,
    "short_words": lambda: (F.col("n_words") > 0) & (_share("word_chars", "n_words") < 1.5),
}
BITS = {name: bit for bit, name in enumerate(RULES)}

#: Policies by version. A policy rejects a document that fails any of its rules.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "many_symbols", "repeated_lines"),
    "v2": tuple(RULES),
}
POLICY = "v2"


def repeated_words(words: list[bytes], gram: int = GRAM) -> int:
    """Words in ``gram``-word windows found twice or more, the first occurrence included."""
    count = len(words) - gram + 1
    if count < 2:
        return 0
    ids: dict[bytes, int] = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    mixed = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + numbers[k : k + count]
        mixed ^= mixed >> np.uint64(29)
    order = np.sort(mixed)
    if not (order[1:] == order[:-1]).any():
        return 0  # different hashes are different windows
    # Some hash occurs twice: number the windows exactly, one word wider at a time.
    exact = numbers[:count].astype(np.int64)
    for k in range(1, gram):
        exact = exact * len(ids) + numbers[k : k + count].astype(np.int64)
        _, exact = np.unique(exact, return_inverse=True)
    inside = np.zeros(len(words) + 1, np.int64)
    again = np.bincount(exact)[exact] > 1
    inside[:count] += again
    inside[gram : gram + count] -= again
    return int((np.cumsum(inside) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASUREMENTS."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are split at ASCII white space alone
    spaces = sum(map(raw.count, (SPACE_BYTES[i : i + 1] for i in range(6))))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - spaces,
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` without its text: measurements and ``failures``, a bit per failed rule.

    Each rule is evaluated once, here; policies only read the bits. A null text has no words. Columns
    of ``docs`` with the name of a measurement or ``failures`` are replaced. Rows pass through one by
    one, without a shuffle; repeated rows are entered each.
    """
    rest = [c for c in docs.columns if c not in ("text", "failures", *MEASUREMENTS)]
    schema = docs.select(*[f"`{c}`" for c in rest]).schema
    for name in MEASUREMENTS:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            rows = [measure(t.as_py() or "") for t in batch.column(last)]
            found = np.array(rows, np.int64).reshape(len(rows), len(MEASUREMENTS))
            arrays = [batch.column(i) for i in range(last)]
            arrays += [pa.array(found[:, i]) for i in range(len(MEASUREMENTS))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    measured = docs.select(*[f"`{c}`" for c in rest], "text").mapInArrow(run, schema)
    failures = F.lit(0).cast("long")
    for name, rule in RULES.items():
        failures = failures.bitwiseOR(F.when(rule(), F.lit(1 << BITS[name])).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failures", failures)


def mask(policy: str) -> int:
    return sum(1 << BITS[rule] for rule in POLICIES[policy])


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and kept without it.

    The rows are counted once per pattern of failed bits (at most two to the number of rules), and
    the patterns answer for every rule; no text and no rule is evaluated again. An empty ledger gives
    zeros.
    """
    bits = F.lit(mask(policy)).cast("long")
    patterns = entries.groupBy(F.col("failures").bitwiseAND(bits).alias("pattern")).agg(
        F.count(F.lit(1)).alias("n")
    )
    n = F.coalesce(F.col("n"), F.lit(0))
    sums = [
        F.sum(F.when(F.col("pattern").bitwiseAND(1 << BITS[r]) != 0, n).otherwise(0)).alias(f"f_{r}")
        for r in POLICIES[policy]
    ]
    sums += [
        F.sum(F.when(F.col("pattern") == 1 << BITS[r], n).otherwise(0)).alias(f"o_{r}")
        for r in POLICIES[policy]
    ]
    kept = F.sum(F.when(F.col("pattern") == 0, n).otherwise(0)).alias("kept")
    totals = patterns.agg(kept, *sums)
    each = F.array(
        *[
            F.struct(
                F.lit(r).alias("rule"),
                F.coalesce(F.col(f"f_{r}"), F.lit(0)).alias("failed"),
                F.coalesce(F.col(f"o_{r}"), F.lit(0)).alias("rejected_alone"),
                (F.coalesce(F.col("kept"), F.lit(0)) + F.coalesce(F.col(f"o_{r}"), F.lit(0))).alias("kept_without"),
            )
            for r in POLICIES[policy]
        ]
    )
    return totals.select(F.inline(each))
