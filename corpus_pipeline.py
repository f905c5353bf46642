"""A corpus in five stages: language, repeated lines, near-duplicates, source mix, packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm import langid, line_dedup, mixing, packing, simhash
from tidemark.llm.common import own
from tidemark.llm.tokens import vocabulary
from tidemark.session import work_folder

#: A document whose language has less than this share of probability is rejected.
MIN_SCORE = 0.3


def _documents(spark: SparkSession, sf_dir: str, docs: DataFrame | None) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs


def by_language(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language; it becomes their ``lang``.

    Rejected are texts without a letter (null and empty ones too) and texts no language is likely for.
    The network learns as in the query of the operator, never from the documents it is measured on.
    """
    docs = _documents(spark, sf_dir, docs)
    found = langid.identified(docs, langid.fitted(docs, ~langid.held_out()))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*[f"`{c}`" for c in docs.columns])


def without_common_lines(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many different texts share; ``n_chars`` follows.

    A group of copies counts once for each of its lines, and a text that would be left without a word
    stays whole, so no document is emptied and every group of copies reaches the next stage. A null
    text becomes an empty one, repeated rows are returned each, an empty table gives none.
    """
    docs = _documents(spark, sf_dir, docs)
    cut = line_dedup.drop_common_lines(docs, by_text=True, spare_whole=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Of rows that share it one stays; one without an id stays only where its whole group has none.
    Texts without words are one group. An empty table gives none.
    """
    return simhash.keep_one(_documents(spark, sf_dir, docs))


def source_mix(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    """All documents, sorted so that the sources interleave at their target weights.

    The rows are sorted over all partitions, so the files, read by number, hold the mix in its order,
    from which packing numbers its sequences. A null source is a source, repeated rows are rows of
    their own, an empty table gives none.
    """
    docs = _documents(spark, sf_dir, docs)
    mix = mixing.mixed(docs)
    return mix.orderBy("mix_slot", "mix_place").select(*[f"`{c}`" for c in docs.columns])


def file_order() -> list[Column]:
    """The place of a row in the files of its table: by the number in the file's name, then in the file."""
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long")
    return [number, F.col("_metadata.file_path"), F.col("_metadata.row_index")]


def pack(
    spark: SparkSession, docs: DataFrame | None, sf_dir: str, order: Sequence[Column] | None = None
) -> DataFrame:
    """Pieces of binary lengths with their ids; each is a sequence.

    Pieces of one length are numbered in ``order`` of their documents: by default that of their files,
    which is the mix of the stage before, so ``docs`` must be read from files unless an order is given.
    A null text is empty, a repeated row is packed like any other, an empty table gives none.
    """
    docs = _documents(spark, sf_dir, docs)
    order = file_order() if order is None else order
    place = [own(f"place{n}") for n in range(len(order))]
    placed = docs.select("*", *[c.alias(p) for c, p in zip(order, place)])
    return packing.packed(placed, vocabulary(), place=place)


STAGES = [
    ("language_id", by_language),
    ("line_dedup", without_common_lines),
    ("simhash_near_dedup", one_of_each_group),
    ("source_mix", source_mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
