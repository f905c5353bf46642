import zlib
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import llm_samples as samples
from __spark_entry__ import SMOKE_DIR, oracle_sql, queries
from compare import connect, differences
from test_llm_line_dedup import key_of
from test_llm_simhash import brute_print, roots
from test_llm_tokens import ids_of
from tidemark.llm import mixing
from tidemark.llm.langid import Labeller, fitted, held_out
from tidemark.llm.packing import lengths
from tidemark.llm.queries import ORACLE, QUERIES

pytestmark = pytest.mark.skipif(not Path(SMOKE_DIR).exists(), reason="supplied tables are absent")


@pytest.mark.parametrize("name", list(ORACLE))
def test_queries_with_sql(spark, name):
    assert differences(QUERIES[name](spark, SMOKE_DIR), connect(SMOKE_DIR), ORACLE[name]) == []


def test_registered():
    assert {*QUERIES, "pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_native_queries_run_no_python(spark):
    for name in ("op1_fingerprints", "op10_line_dedup"):
        plan = QUERIES[name](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, before, SMOKE_DIR).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        assert after.dtypes == docs.dtypes
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    assert before.count() > 0.8 * docs.count()
    order = [r["source"] for r in before.orderBy("doc_id").collect()]
    mixed = Counter(r["source"] for r in before.collect())
    assert mixed == Counter(order)
    pieces = corpus_pipeline.run(spark, SMOKE_DIR)
    assert pieces.select("doc_id").distinct().count() == before.count()


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    rows = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    assert docs.columns[:2] == ["doc_id", "text"]
    labels = Labeller(fitted(docs, ~held_out())).label([r[1] for r in rows])
    kept = [r for r, (lang, score) in zip(rows, labels) if lang != "und" and score >= corpus_pipeline.MIN_SCORE]
    # Lines count once for each different text, and no text is emptied.
    counts = Counter(k for t in {r[1] or "" for r in kept} for k in {key_of(x) for x in t.split("\n")})
    texts = {}
    for r in kept:
        lines = (r[1] or "").split("\n")
        left = "\n".join(x for x in lines if not (key_of(x) and counts[key_of(x)] >= 10))
        texts[r[0]] = left if left.strip(" \t\n\x0b\f\r") else r[1] or ""
    prints = {i: brute_print(t) for i, t in texts.items()}
    near = roots(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    firsts = {}
    for i in sorted(texts):
        firsts.setdefault(near[prints[i]], i)
    expected = []
    for i in firsts.values():
        data, start = ids_of(texts[i]), 0
        for length in lengths(len(data) // 4):
            expected.append((i, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
            start += length
    found = corpus_pipeline.run(spark, SMOKE_DIR).select("doc_id", "start", "length", "ids_crc32")
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_the_mix_lies_in_the_order_of_its_files(spark, tmp_path):
    docs = samples.table(spark, samples.documents(n=300))
    corpus_pipeline.source_mix(spark, docs, SMOKE_DIR).write.parquet(str(tmp_path / "mix"))
    read = [
        r.as_py()
        for file in sorted((tmp_path / "mix").glob("part-*.parquet"))
        for r in pq.read_table(file)["source"]
    ]
    again = mixing.mixed(docs).orderBy("mix_slot", "mix_place").select("source").collect()
    assert read == [r["source"] for r in again]


def test_every_group_of_copies_keeps_a_document(spark, tmp_path):
    rows = [r for r in samples.documents(n=80) if r[0] is not None]
    rows += [(5000 + i, "the same text\nin every one of these", "en", "s1", 1, 1) for i in range(40)]
    docs = samples.table(spark, rows)
    cut = corpus_pipeline.without_common_lines(spark, docs, SMOKE_DIR)
    assert cut.count() == len(rows)
    one = {r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, cut, SMOKE_DIR).collect()}
    assert len(one & set(range(5000, 5040))) == 1 and 5000 in one


def test_files_are_ordered_by_number(spark):
    names = [("part-99999-x.parquet", 0), ("part-100000-x.parquet", 0), ("part-00002-x.parquet", 1), ("other.parquet", 0)]
    rows = spark.createDataFrame([({"file_name": n, "file_path": f"/a/{n}", "row_index": r},) for n, r in names],
                                 "_metadata struct<file_name: string, file_path: string, row_index: long>")
    order = [r["_metadata"]["file_name"].split("-")[1:2] for r in rows.orderBy(*corpus_pipeline.file_order()).collect()]
    assert order == [[], ["00002"], ["99999"], ["100000"]]


def test_stages_take_awkward_and_empty_tables(spark, tmp_path):
    for name, docs in (("awkward", samples.table(spark)), ("empty", samples.empty(spark))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{k}")
            stage(spark, docs, SMOKE_DIR).write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() == 0) == (name == "empty")


def numbered_by_brute_force(docs):
    """(sequence_id, doc_id, start, length, ids_crc32) with the documents in the order of their mix."""
    made = []
    for place, r in enumerate(mixing.mixed(docs).orderBy("mix_slot", "mix_place").select("doc_id", "text").collect()):
        data, start = ids_of(r["text"]), 0
        for length in lengths(len(data) // 4):
            made.append((-length, place, start, r["doc_id"], zlib.crc32(data[4 * start : 4 * (start + length)])))
            start += length
    return [(n, i, start, -length, crc) for n, (length, _, start, i, crc) in enumerate(sorted(made, key=lambda x: x[:3]))]


def test_sequences_are_numbered_in_the_order_of_the_mix(spark, tmp_path):
    columns = ("sequence_id", "doc_id", "start", "length", "ids_crc32")
    supplied = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    for name, docs in (("awkward", samples.table(spark, parts=3)), ("supplied", supplied)):
        path = str(tmp_path / name)
        corpus_pipeline.source_mix(spark, docs, SMOKE_DIR).write.parquet(path)
        expected = numbered_by_brute_force(docs)
        assert expected != sorted(expected, key=lambda r: (-r[3], r[1] is not None, r[1] or 0, r[2], r[4]))
        held = mixing.mixed(docs)
        by_files = corpus_pipeline.pack(spark, spark.read.parquet(path), SMOKE_DIR)
        by_order = corpus_pipeline.pack(spark, held, SMOKE_DIR, [F.col("mix_slot"), F.col("mix_place")])
        for found in (by_files, by_order):
            assert "ids" in found.columns and not any(c.startswith("_") for c in found.columns)
            assert sorted(map(tuple, found.select(*columns).collect())) == expected
