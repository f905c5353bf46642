from collections import Counter

import pytest

import llm_samples as samples
from tidemark.llm import line_dedup
from tidemark.llm.queries import ORACLE, QUERIES

SPACES = " \t\n\x0b\f\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(rows, least, chars=1):
    split = [(r[1] or "").split("\n") for r in rows]
    counts = Counter(k for lines in split for k in {key_of(x) for x in lines})
    out = []
    for r, lines in zip(rows, split):
        gone = [len(key_of(x)) >= chars and counts[key_of(x)] >= least for x in lines]
        out.append((r[0], "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least, chars", [(10, 1), (2, 1), (2, 5), (1, 1)])
def test_against_brute_force(spark, least, chars):
    found = line_dedup.drop_common_lines(samples.table(spark), least, chars)
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in found.collect()]
    assert sorted(got, key=repr) == brute(samples.documents(), least, chars)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "_key", "n_lines", "n_dropped"]


def test_empty_table_and_long_documents(spark):
    assert line_dedup.drop_common_lines(samples.empty(spark)).count() == 0
    text = "\n".join(f"line {i % 70_000}" for i in range(100_000))
    rows = [(1, text, None, None, None, None), (2, "line 5\nown", None, None, None, None)]
    found = line_dedup.drop_common_lines(samples.table(spark, rows), 2).orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_dropped"]) for r in found] == [(100_000, 2), (2, 1)]
    assert found[1]["text"] == "own" and found[0]["text"].count("\n") == 99_997


def test_repeated_rows_count_once_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, "only here\nshared", "en", "s", 0, 0)] * 10  # one document, ten rows
    rows += [(i, f"own {i}\nshared", "en", "s", 0, 0) for i in range(2, 11)]
    rows += [(None, "without id\nshared", "en", "s", 0, 0)] * 12
    samples.table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.sql(f"select doc_id, n_lines, n_dropped from ({ORACLE['op10_line_dedup']})").fetchall()
    found = QUERIES["op10_line_dedup"](spark, str(tmp_path)).groupBy("doc_id").agg({"n_lines": "sum", "n_dropped": "sum"})
    got = [tuple(r) for r in found.select("doc_id", "sum(n_lines)", "sum(n_dropped)").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr) and (1, 20, 10) in got


def test_copies_make_no_line_common_and_no_text_is_emptied(spark):
    copies = [(i, "one line\nanother line", "en", "s", 0, 0) for i in range(30)]
    edited = [(100 + i, f"one line\nedit {i}", "en", "s", 0, 0) for i in range(8)]
    boiler = [(200 + i, "cookies\nlogin" if i % 2 else "login\ncookies", "en", "s", 0, 0) for i in range(4)]
    others = [(300 + i, f"login\nown {i}\nCOOKIES", "en", "s", 0, 0) for i in range(12)]
    docs = samples.table(spark, copies + edited + boiler + others)
    found = line_dedup.drop_common_lines(docs, 10, by_text=True, spare_whole=True)
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in found.collect()}
    assert all(got[i] == ("one line\nanother line", 0) for i in range(30))  # nine texts have the line
    assert all(got[100 + i] == (f"one line\nedit {i}", 0) for i in range(8))
    assert all(got[200 + i][1] == 0 and "login" in got[200 + i][0] for i in range(4))
    assert all(got[300 + i] == (f"own {i}", 2) for i in range(12))
