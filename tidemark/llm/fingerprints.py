"""Document fingerprints by winnowing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import own, ranked, whole_text

GRAM = 5  # words in a k-gram
WINDOW = 8  # k-grams in a window; texts sharing WINDOW + GRAM - 1 words in a row share a fingerprint
PRIME = (1 << 31) - 1
BASE = 1_000_003
LAST = (1 << 32) - 1


def _windowed(df: DataFrame, level: str, wide: str, size: int, step: int, join) -> DataFrame:
    """Column ``wide``: at each i, ``join`` of ``level`` at i and at i + step, over ``size`` entries."""
    n = F.size(level)
    length = F.greatest(n - size + 1, F.lit(0))
    return df.withColumn(
        wide, F.zip_with(F.slice(level, 1, length), F.slice(level, step + 1, length), join)
    )


def fingerprinted(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add ``out``: the winnowed fingerprint of the column ``text``, an array of longs.

    Words are runs of letters and digits, lower-cased. The hash of ``gram`` words is the polynomial
    rolling hash of their hashes modulo a 31-bit prime; in every ``window`` successive hashes the
    smallest is chosen, of equal ones the rightmost. An entry holds the hash in its upper 32 bits and,
    from the end of the 32-bit range, the number of the k-gram's first word in the lower; so the
    smallest entry is the rightmost smallest hash. Any ``window + gram - 1`` successive words that two
    texts share give them a common hash.

    A text with fewer k-grams than the window is one window; one with fewer words than ``gram`` is one
    k-gram; one without words (or null) has an empty fingerprint. Both hash and minimum double their
    reach step by step, so the cost does not grow with the sizes of k-gram and window.
    """
    if gram < 1 or window < 1:
        raise ValueError("gram and window are at least 1")
    before = list(df.columns)
    words, hashes, grams, entries = own("words"), own("hashes"), own("grams"), own("entries")
    split = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    df = df.withColumn(words, F.array_remove(split, ""))
    df = df.withColumn(hashes, F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME))))

    def joined(length: int):
        shift = pow(BASE, length, PRIME)
        return lambda a, b: F.pmod(a * F.lit(shift) + b, F.lit(PRIME))

    # power: hashes of 1, 2, 4, … words; done: of the words taken so far, until they are ``gram``.
    power, reach, done, length, rest = hashes, 1, None, 0, gram
    while rest:
        if rest & 1:
            if done is None:
                done, length = power, reach
            else:
                n = F.greatest(F.size(done) - reach, F.lit(0))
                wider = own("gram")
                df = df.withColumn(
                    wider,
                    F.zip_with(F.slice(done, 1, n), F.slice(power, length + 1, n), joined(reach)),
                )
                done, length = wider, length + reach
        rest >>= 1
        if rest:
            wider = own("power")
            df = _windowed(df, power, wider, reach + 1, reach, joined(reach))
            power, reach = wider, 2 * reach
    whole = F.array(F.pmod(F.xxhash64(F.array_join(words, " ")), F.lit(PRIME)))
    df = df.withColumn(
        grams,
        F.when(F.size(words) >= gram, F.col(done))
        .when(F.size(words) > 0, whole)
        .otherwise(F.array().cast("array<bigint>")),
    )
    # Shifted by hand: a hash below 2^31 leaves the entry positive.
    df = df.withColumn(
        entries,
        F.transform(grams, lambda h, i: h * F.lit(1 << 32) + (F.lit(LAST) - i.cast("long"))),
    )
    level, reach = entries, 1
    least = lambda a, b: F.least(a, b)
    while reach < window:
        step = min(reach, window - reach)
        wider = own("minimum")
        df = _windowed(df, level, wider, step + 1, step, least)
        level, reach = wider, reach + step
    short = F.when(F.size(entries) > 0, F.array(F.array_min(entries))).otherwise(F.col(entries))
    chosen = F.when(F.size(entries) >= window, F.array_distinct(F.col(level))).otherwise(short)
    return df.withColumn(out, chosen).select(*[F.col(f"`{c}`") for c in before if c != out], out)


def hashes_of(fingerprint: str) -> Column:
    """The set of a fingerprint's hashes, as ints."""
    return F.array_distinct(F.transform(fingerprint, lambda e: F.shiftright(e, 32).cast("int")))


def as_text(fingerprint: str) -> Column:
    """``hash:position`` of every entry, the hash in hexadecimal."""
    position = lambda e: (F.lit(LAST) - e.bitwiseAND(F.lit(LAST))).cast("string")
    return F.array_join(
        F.transform(fingerprint, lambda e: F.concat(F.hex(F.shiftright(e, 32)), F.lit(":"), position(e))),
        " ",
    )


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two arrays of hashes; 1 if both are empty, 0 if one is."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def edited_pairs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: its text, the edited text, and the fingerprints of both and of the next.

    The edited text is the text with its last floor(n / 2) of n code points replaced by the first as
    many, or all, of the next document's. The next document is the next larger (doc_id, hash of the
    text), null ids first; the last one's is the first, so a single document follows itself. Repeated
    rows are one document with one next one, and each of them is returned. A null text is empty. Only
    doc_id and text are read.

    A document's text is shuffled once, on (doc_id, hash); the half that goes to the document before is
    shuffled once more, with its fingerprint's hashes. Numbering sees no text.
    """
    base = docs.select("doc_id", whole_text().alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("_key")
    )
    ids = base.select("doc_id", "_key", F.length("text").alias("_n")).distinct()
    order = [F.col("doc_id").asc_nulls_first(), F.col("_key"), F.col("_n")]
    row = ranked(ids, order, "_row", "fingerprint-order")
    total = row.count()
    following = row.select(
        F.col("doc_id").alias("_next_id"),
        F.col("_key").alias("_next_key"),
        F.pmod(F.col("_row") - 1, F.lit(max(total, 1))).alias("_row"),
    )
    links = row.join(following, "_row").select(
        F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "_n", "_next_id", "_next_key"
    )
    # Both joins shuffle the same columns on the same key, so Spark does it once for both.
    follower = base.join(
        links, base["doc_id"].eqNullSafe(links["_next_id"]) & (base["_key"] == links["_next_key"])
    ).select("_id", "_k", "text", F.expr("left(text, _n div 2)").alias("_head"))
    follower = fingerprinted(follower, "text", "_print", gram, window).select(
        "_id", "_k", "_head", hashes_of("_print").alias("_next")
    )
    # One row per document also where the next one is repeated.
    follower = follower.groupBy("_id", "_k").agg(
        F.first("_head").alias("_head"), F.first("_next").alias("_next")
    )
    paired = base.join(
        follower, base["doc_id"].eqNullSafe(follower["_id"]) & (base["_key"] == follower["_k"])
    ).select(
        "doc_id",
        "text",
        F.length("text").cast("long").alias("n_chars"),
        F.expr("left(text, length(text) - length(text) div 2) || _head").alias("edited"),
        F.col("_next").alias("next_hashes"),
    )
    paired = fingerprinted(paired, "text", "print", gram, window)
    return fingerprinted(paired, "edited", "edited_print", gram, window)


def compare_edits(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """The digest of :func:`edited_pairs`: see there for nulls, ties and repeated rows."""
    hashed = edited_pairs(docs, gram, window).withColumns(
        {"_own": hashes_of("print"), "_edited": hashes_of("edited_print")}
    )
    return hashed.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("print").alias("fingerprint"),
        as_text("edited_print").alias("edited_fingerprint"),
        likeness("_own", "_edited").alias("near_edited"),
        likeness("_own", "next_hashes").alias("near_next"),
    )
