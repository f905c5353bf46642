import base64
import gzip
import hashlib
from collections import defaultdict

import pyarrow as pa
import pyspark.sql.datasource as ds
import pytest

from pyspark.sql import functions as F
from tidemark.llm import warc
from tidemark.llm.filesets import FileSet

SCHEMA = "page_id long, url string, html string, record_type string"


def pages(spark):
    rows = [(i, f"http://x/{i}", f"<p>page {i % 11}</p>" + "é" * (i % 11), "clash") for i in range(80)]
    rows += [
        (100, None, None, None),
        (101, "http://x/a\r\nb%20 :é", "", None),
        (102, "u", "x" * 200_000 + "\r\n\r\nWARC/1.1\r\n", None),
        (None, "n", "<p>page 1</p>é", None),
        (None, None, "only nulls have this", None),
        (None, "m", "only nulls have this", None),
        (79, "http://x/79", "<p>page 2</p>éé", "a row repeated"),
        (103, "big", "long line " * 50_000, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), rows


def expected(rows, least=0):
    groups = defaultdict(list)
    for page_id, _, html, _ in rows:
        groups[(html or "").encode()].append(page_id)
    out = []
    for page_id, url, html, _ in rows:
        raw = (html or "").encode()
        known = [i for i in groups[raw] if i is not None]
        again = len(raw) >= least and known and page_id != max(known)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page_id, "revisit" if again else "response", url, digest, len(raw), max(known) if again else None))
    return sorted(out, key=repr)


def got(frame):
    columns = ("page_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to")
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("least", [0, 14])
def test_round_trip(spark, least):
    frame, rows = pages(spark)
    assert got(warc.round_trip(frame, least)) == expected(rows, least)


def test_payloads_filters_and_plain_gzip(spark, tmp_path):
    frame, rows = pages(spark)
    path = str(tmp_path / "archive")
    warc.write_warc(frame, path)
    whole = warc.read_warc(spark, path)
    for r in whole.collect():
        digest = base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
        assert (digest == r["payload_digest"]) if r["record_type"] == "response" else r["payload"] == b""
    every = expected(rows)
    lean = warc.read_warc(spark, path, "none")
    assert got(lean) == every
    tests = {
        "record_type = 'revisit'": lambda r: r[1] == "revisit",
        "payload_bytes > 1000 and record_type = 'response'": lambda r: r[4] > 1000 and r[1] == "response",
        "page_id in (3, 79, 102)": lambda r: r[0] in (3, 79, 102),
        "refers_to is not null and page_id <= 5": lambda r: r[5] is not None and r[0] is not None and r[0] <= 5,
        "target_uri like 'http%' and page_id >= 75": lambda r: (r[2] or "").startswith("http") and (r[0] or 0) >= 75,
        "refers_to is null": lambda r: r[5] is None,
        "page_id is null and target_uri is not null": lambda r: r[0] is None and r[2] is not None,
        "refers_to <=> 79": lambda r: r[5] == 79,
        "refers_to <=> null": lambda r: r[5] is None,
        "not (refers_to <=> 79)": lambda r: r[5] != 79,
        "refers_to <> 79": lambda r: r[5] not in (None, 79),
        "not (refers_to > 75)": lambda r: r[5] is not None and r[5] <= 75,
        "page_id not in (3, 79)": lambda r: r[0] not in (None, 3, 79),
        "page_id in (3, null)": lambda r: r[0] == 3,
        "page_id not in (3, null)": lambda r: False,
        "target_uri like '%/7' or target_uri like '%x%'": lambda r: "x" in (r[2] or ""),
        "target_uri like '%7'": lambda r: (r[2] or "").endswith("7"),
        "target_uri like '%x/1%'": lambda r: "x/1" in (r[2] or ""),
        "not target_uri like 'http%'": lambda r: r[2] is not None and not r[2].startswith("http"),
        "payload_bytes = null": lambda r: False,
        "page_id < 5 and payload_bytes >= 13 and record_type < 'z'": lambda r: r[0] is not None and r[0] < 5 and r[4] >= 13,
    }
    for condition, test in tests.items():
        assert got(lean.where(condition)) == [r for r in every if test(r)], condition
    # Any gzip reader finds whole records.
    files = FileSet(path)
    for entry in files.entries():
        text = gzip.decompress(files.get(entry["name"]))
        assert text.count(b"WARC-Record-ID") == entry["records"] and text.startswith(b"WARC/1.1\r\n")


def test_every_kind_of_filter_is_answered_or_left_to_spark():
    kinds = {k for k in vars(ds).values() if isinstance(k, type) and issubclass(k, ds.Filter)} - {ds.Filter}
    values = [None, 1, 2, 3]
    want = {
        ds.EqualTo: (2, [2], [1, 3]),
        ds.EqualNullSafe: (2, [2], [None, 1, 3]),
        ds.GreaterThan: (2, [3], [1, 2]),
        ds.GreaterThanOrEqual: (2, [2, 3], [1]),
        ds.LessThan: (2, [1], [2, 3]),
        ds.LessThanOrEqual: (2, [1, 2], [3]),
        ds.In: ((1, 2), [1, 2], [3]),
    }
    assert kinds == {*want, ds.IsNull, ds.IsNotNull, ds.Not, ds.StringContains, ds.StringStartsWith, ds.StringEndsWith}
    for kind, (value, yes, no) in want.items():
        asked = kind(("page_id",), value)
        for found, kept in ((asked, yes), (ds.Not(asked), no)):
            name, test = warc._test(found)
            assert name == "page_id" and [v for v in values if test(v)] == kept, found
    for asked, yes in ((ds.IsNull(("page_id",)), [None]), (ds.IsNotNull(("page_id",)), [1, 2, 3])):
        assert [v for v in values if warc._test(asked)[1](v)] == yes
        assert [v for v in values if warc._test(ds.Not(asked))[1](v)] == [v for v in values if v not in yes]
    uris = [None, "abc", "bcd"]
    for kind, yes in ((ds.StringStartsWith, "abc"), (ds.StringContains, "abc"), (ds.StringEndsWith, "abc")):
        assert [v for v in uris if warc._test(kind(("target_uri",), "abc"))[1](v)] == [yes]
        assert [v for v in uris if warc._test(ds.Not(kind(("target_uri",), "abc")))[1](v)] == ["bcd"]
    left = [ds.EqualTo(("payload",), b""), ds.EqualTo(("page_id", "x"), 1), ds.EqualTo(("page_id",), None)]
    left += [ds.In(("page_id",), (1, None)), ds.Not(ds.Not(ds.IsNull(("page_id",))))]
    assert [warc._test(f) for f in left] == [None] * len(left)


def test_a_large_file_is_read_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PIECE_BYTES", 1000)
    path = str(tmp_path / "archive")
    frame, rows = pages(spark)
    writer = warc._Writer(path, 1 << 30)
    written = writer.write(iter(pa.Table.from_pylist(
        [r.asDict() for r in warc.with_roles(frame).collect()]).to_batches()))
    writer.commit([written])
    (entry,) = FileSet(path).entries()
    assert len(entry["starts"]) > 5
    for split in (1, 2500, 1 << 30):
        reader = warc._Reader(path, "none", split)
        parts = reader.partitions()
        assert sum(b - a for p in parts for _, a, b in p.spans) == entry["bytes"]
        assert (len(parts) == len(entry["starts"])) if split == 1 else (len(parts) > 1) == (split == 2500)
        found = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert sorted(str(r["page_id"]) for r in found) == sorted(str(r[0]) for r in rows)


def test_unwanted_payloads_are_not_inflated(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_warc(pages(spark)[0], path)
    files = FileSet(path)
    reader = warc._Reader(path, "none", 1)
    read = 0
    for entry in files.entries():
        with files.open(entry["name"]) as stream:
            real, taken = stream.read, []

            class Counted:
                size, seek = stream.size, stream.seek

                def read(self, n):
                    taken.append(n)
                    return real(n)

            assert len(list(reader.records(Counted(), 0, entry["bytes"]))) == entry["records"]
            read += sum(taken)
    sizes = sum(e["bytes"] for e in files.entries())
    assert len(reader.partitions()) >= len(files.entries()) and read < sizes


def test_damage_is_noticed(spark, tmp_path):
    one = spark.createDataFrame([(1, "u", "some payload that is long enough", None)], SCHEMA)
    path = str(tmp_path / "archive")
    warc.write_warc(one, path)
    files = FileSet(path)
    name = files.entries()[0]["name"]
    record = warc.record(1, "response", "u", "A" * 32, 9, None, b"not those")
    files.put(name, record)
    assert warc.read_warc(spark, path, "none").count() == 1
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_warc(spark, path, "verify").where(F.col("page_id") > 0).collect()


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
