import hashlib
import random
import zlib

import numpy as np
import pytest

import llm_samples as samples
from tidemark.llm import packing, token_files, tokens
from tidemark.llm.filesets import FileSet

PATH = tokens.vocabulary()


def ids_of(text):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids
    return np.array([*found, 0], "<u4").tobytes()


def test_parts_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 50)
    encoder = tokens.Encoder(PATH)
    whole = tokens.Encoder(PATH)
    rng = random.Random(4)
    alphabet = [" ", " ", " ", "\n", "\t", " ", "\x1c", " ", "a", "b", "é", "'s", "1", "22", "!", "?!", "\U0001f600"]
    alphabet += ["word", "The", ".", ",", "|", ":\n", "don't", "'ll", "ı", "ª", "²", "ⅷ", "<|endoftext|>", "\x85", "　", "_"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(20_000)]
    texts += [r[1] for r in samples.documents()]
    for text in texts:
        assert encoder.encode(text) == whole.whole(text or "") if text else encoder.encode(text) == b""
    assert len(encoder.spaced) <= 50 and len(encoder.bare) <= 50


def test_a_rare_word_with_a_mark_takes_one_place():
    encoder = tokens.Encoder(PATH)
    for kept in ({"qwertz"}, {"qwertz", "qwertz,"}):
        assert encoder.encode("a qwertz,") == encoder.whole("a qwertz,")
        assert set(encoder.spaced) == kept


def test_marks_and_line_ends_are_cut_off_where_that_is_certain():
    encoder = tokens.Encoder(PATH)
    whole = tokens.Encoder(PATH)
    encoder.encode("a qwertz, uiopa. asdfg\nhjklz, yxcvb, nm")
    assert not [p for p in encoder.spaced if p[:1] != "\0" and p[-1:] in ",.\n"]
    assert {"qwertz", "uiopa", "asdfg", "\0hjklz", "yxcvb"} <= set(encoder.spaced)
    rng = random.Random(8)
    alphabet = ["word", "Ünï", "7", " ", " ", ", ", ". ", ".\n", ",\n", "\n", "!, ", ".. ", "'s, ", "e\u0301. ", "_, ", "\0", "\xa0"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 12))) for _ in range(20_000)]
    for text in [*texts, ", a", ". ", "a, ", "a,\n", "\na", "a\n", "a\n\nb, c", "a \nb, c", "a, \0b, c", "\0, a"]:
        assert encoder.encode(text) == whole.whole(text), text


def test_parts_that_come_once_take_no_place(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 800)
    encoder = tokens.Encoder(PATH)
    rng = random.Random(5)
    words = ["".join(rng.choices("bcdfghjklmnpqrstvwxyz", k=12)) for _ in range(700)]
    for text, most in ((" ".join(words), 110), (" ".join(words[:300]), 310)):
        assert encoder.encode(text) == encoder.whole(text)
        assert len(encoder.spaced) + len(encoder.spaced.older) <= most
    assert set(words[1:300]) <= set(encoder.spaced)


def brute(rows):
    """Rows in the order of their ids, as long as ids are unique."""
    start, out = 0, []
    for r in sorted(rows, key=lambda r: r[0]):
        data = ids_of(r[1])
        out.append((r[0], start, len(data) // 4, zlib.crc32(data), data))
        start += len(data) // 4
    return out


def unique(rows):
    ids = [r[0] for r in rows]
    return [r for r in rows if r[0] is not None and ids.count(r[0]) == 1]


def test_files_round_trip(spark, tmp_path):
    rows = unique(samples.documents())
    path = str(tmp_path / "files")
    token_files.write_tokens(samples.table(spark, rows), path, PATH)
    found = token_files.read_tokens(spark, path).orderBy("doc_id").collect()
    expected = brute(rows)
    assert [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"]), bytes(r["ids"])) for r in found] == expected
    # One document alone, by the index, with the dictionary that the header names.
    files = FileSet(path)
    by_id = {x[0]: x[4] for x in expected}
    for entry in files.entries():
        reader = token_files.FileReader(files, entry["name"])
        assert reader.digest != token_files.NO_DICTIONARY
        assert hashlib.sha256(files.get(token_files.dictionary_name(reader.digest))).digest() == reader.digest
        last = len(reader.counts) - 1
        assert reader.document(last) == by_id[int(reader.doc_ids[last])]


def test_awkward_rows_round_trip(spark):
    rows = samples.documents()
    found = token_files.round_trip(samples.table(spark), PATH).collect()
    expected = sorted((str(r[0]), zlib.crc32(ids_of(r[1]))) for r in rows)
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in found) == expected
    order = sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] is None for r in order[:3]] == [True, True, False]
    assert order[0]["start"] == 0
    for a, b in zip(order, order[1:]):
        assert b["start"] == a["start"] + a["n_tokens"]
        assert a["doc_id"] is None or a["doc_id"] <= b["doc_id"]


def test_empty_table_and_little_to_train_on(spark):
    assert token_files.round_trip(samples.empty(spark), PATH).count() == 0
    one = token_files.round_trip(samples.table(spark, [(1, "x y", None, None, None, None)]), PATH).collect()
    assert [(r["doc_id"], r["n_tokens"], r["start"]) for r in one] == [(1, 3, 0)]


def test_lengths():
    for total in (0, 1, 2, 3, 1023, 1024, 1025, 5000):
        found = packing.lengths(total)
        assert sum(found) == total and all(n & (n - 1) == 0 and 0 < n <= 1024 for n in found)
        assert found == sorted(found, reverse=True) and len(set(n for n in found if n < 1024)) == len([n for n in found if n < 1024])
    with pytest.raises(ValueError):
        packing.lengths(5, 1000)


def test_packed_pieces(spark):
    rows = unique(samples.documents())
    found = packing.packed(samples.table(spark, rows), PATH).collect()
    of = {}
    for r in found:
        of.setdefault(r["doc_id"], []).append(r)
        assert r["offset"] == 0 and len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
    for r in rows:
        pieces = sorted(of[r[0]], key=lambda p: p["start"])
        assert b"".join(bytes(p["ids"]) for p in pieces) == ids_of(r[1])
        assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:i]) for i in range(len(pieces))]
        assert {p["doc_tokens"] for p in pieces} == {len(ids_of(r[1])) // 4}
    assert sorted(r["sequence_id"] for r in found) == list(range(len(found)))
    in_order = [r["length"] for r in sorted(found, key=lambda r: r["sequence_id"])]
    assert in_order == sorted(in_order, reverse=True)
    everything = packing.packed(samples.table(spark), PATH, with_ids=False)
    assert everything.where("start = 0").count() == len(samples.documents())
    assert packing.packed(samples.empty(spark), PATH).count() == 0
