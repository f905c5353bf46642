"""Line dedup: drop the lines that many documents share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import LOWER, SPACES, UPPER, own, whole_text, written

MIN_DOCUMENTS = 10
MIN_CHARS = 1


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def drop_common_lines(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS,
    by_id: bool = False,
    by_text: bool = False,
    spare_whole: bool = False,
) -> DataFrame:
    """Every row of ``docs`` with its ``text`` cut, ``n_lines`` before and ``n_dropped``.

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased. A key of at
    least ``min_chars`` code points found in at least ``min_documents`` rows loses all its lines, in
    every document; the other lines stay as they are, in their order.

    Each row counts as a document, a repeated row too, and once however often it has the line. With
    ``by_id`` each distinct id does, however many rows have it, and a row without an id for none, as
    in SQL's count of distinct ids; it still loses the lines that others make common. With ``by_text``
    each distinct text does, however many copies there are, so a group of copies makes none of its own
    lines common. A null or empty text is one empty line, and so is a text that loses all its lines;
    with ``spare_whole`` a text that would be left without a word stays whole instead. Null ids are ids
    like any other. Other columns pass through, except that columns named ``n_lines``, ``n_dropped``
    are replaced.

    Keys are compared by 96 bits of hash. Lines leave a document as (position, hash), so that the
    shuffles hold no text but the documents themselves, once, on their way to their list of dropped
    positions. A hot line is one row per map task in the count; where the lines meet the counts
    again, Spark can split a hot key, as the counts are unique.
    """
    text_hash, doc, same, lines_of, positions = map(own, ("text_hash", "doc", "same", "lines", "positions"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # A document is known by its id and its text's hash: rows that agree in both lose the same lines.
    base = docs.select(
        *[F.col(f"`{c}`") for c in kept if c != "text"],
        whole_text().alias("text"),
        F.xxhash64(whole_text()).alias(text_hash),
    )
    keys = F.transform(F.split("text", "\n", -1), line_key)
    lines = base.select("doc_id", text_hash, F.posexplode(keys).alias("_position", "_key")).where(
        F.length("_key") >= max(min_chars, 1)
    )
    hashed = lambda key: (F.xxhash64(key).alias("_h"), F.crc32(F.encode(key, "UTF-8")).alias("_c"))
    counted = (
        base.select("doc_id", text_hash, F.explode(F.array_distinct(keys)).alias("_key"))
        .where(F.length("_key") >= max(min_chars, 1))
        .select("doc_id", text_hash, *hashed(F.col("_key")))
    )
    # Dealt by hash and id or text, so the rows of a hot line are spread before they are counted.
    if by_text:
        counted = counted.drop("doc_id").distinct()
    elif by_id:
        counted = counted.drop(text_hash).where(F.col("doc_id").isNotNull()).distinct()
    counts = counted.groupBy("_h", "_c").agg(F.count(F.lit(1)).alias("_n"))
    # Written, so that the join below has a shuffle of its own, whose hot keys Spark can split.
    common = written(counts.where(F.col("_n") >= min_documents).select("_h", "_c"), "common-lines")
    dropped = (
        lines.select("doc_id", text_hash, "_position", *hashed(F.col("_key")))
        .join(common, ["_h", "_c"])
        .groupBy(F.col("doc_id").alias(doc), F.col(text_hash).alias(same))
        .agg(F.collect_set("_position").alias(positions))
    )
    joined = base.join(
        dropped,
        base["doc_id"].eqNullSafe(dropped[doc]) & (base[text_hash] == dropped[same]),
        "left",
    ).withColumn(lines_of, F.split("text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines_of) - 1), F.col(positions))
    cut = F.array_join(F.transform(F.array_sort(stay), lambda i: F.get(F.col(lines_of), i)), "\n")
    if spare_whole:
        left = F.btrim(cut, F.lit(SPACES)) != ""
        joined = joined.withColumn(positions, F.when(left, F.col(positions)))
    text = F.when(F.col(positions).isNull(), F.col("text")).otherwise(cut)
    return joined.select(
        *[(text.alias("text") if c == "text" else F.col(f"`{c}`")) for c in kept],
        F.size(lines_of).cast("long").alias("n_lines"),
        F.coalesce(F.size(positions), F.lit(0)).cast("long").alias("n_dropped"),
    )
