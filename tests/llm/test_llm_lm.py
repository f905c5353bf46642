import math
import zlib
from collections import Counter

import numpy as np
import pytest

import llm_samples as samples
from tidemark.llm import lm
from tidemark.llm.elias_fano import Sequence, Trie, quantised


@pytest.mark.parametrize("size, universe", [(0, 10), (1, 1), (1, 1 << 64), (5000, 6000), (5000, 1 << 64), (300, 1 << 40), (7, 3)])
def test_sequences(size, universe):
    rng = np.random.default_rng(size)
    draw = lambda n: rng.integers(0, universe, n, np.uint64, endpoint=False) if universe < 1 << 64 else rng.integers(0, 1 << 64, n, np.uint64)
    values = np.sort(draw(size))
    data = Sequence.of(values, universe).to_bytes()
    found, end = Sequence.from_buffer(b"12345678" + data, 8)
    assert end == 8 + len(data) and found.size == size
    assert (found.get(np.arange(size)) == values).all()
    ask = np.concatenate([values, draw(2000), values[:50] + np.uint64(1)]) if size else draw(100)
    ask = ask[ask < np.uint64(universe - 1)]
    at, equal = found.successor(ask)
    assert (at == np.searchsorted(values, ask)).all()
    assert (equal == np.isin(ask, values)).all()


def test_trie_finds_every_pair_and_no_other():
    rng = np.random.default_rng(2)
    contexts = np.unique(rng.integers(0, 1 << 64, 300, np.uint64))
    pairs = sorted({(int(rng.integers(len(contexts) - 1)), int(rng.integers(1 << 32))) for _ in range(4000)})
    parents, children = (np.array(x) for x in zip(*pairs))
    shares = rng.random(len(pairs)) + 1e-6
    trie = Trie.from_buffer(Trie.of(contexts, parents, children, shares).to_bytes())
    counts = np.bincount(parents, minlength=len(contexts))
    codes = trie.find(contexts, counts, children.astype(np.uint32))
    assert (codes > 0).all() and np.abs(np.log(trie.codebook[codes] / shares)).max() < 0.2
    assert not trie.find(contexts, counts, (children + 1).astype(np.uint32)).any()
    assert not trie.find(contexts + np.uint64(1), counts, children.astype(np.uint32)).any()
    empty = Trie.of(contexts[:0], parents[:0], children[:0], shares[:0])
    assert not empty.find(contexts, counts, children.astype(np.uint32)).any()


def test_few_values_are_kept_exactly():
    shares = np.array([0.5, 0.25, 0.5, 0.125], np.float32)
    codes, book = quantised(shares)
    assert np.allclose(book[codes], shares, rtol=1e-6) and codes.min() == 1
    codes, book = quantised(np.geomspace(1e-9, 1, 100_000))
    assert np.abs(np.log10(book[codes] / np.geomspace(1e-9, 1, 100_000))).max() < 0.05


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w] + [None]


def brute(rows, mu, nu=None):
    """Scores by one word before, or by two where nu is given."""
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows]
    single, pairs, triples = Counter(), Counter(), Counter()
    for r, h in zip(rows, held):
        if not h:
            words = words_of(r[1])
            single.update(words)
            pairs.update(zip([None, *words], words))
            triples.update(zip([None, *words], words, words[1:]))
    n, v = sum(single.values()), len(single)
    out = []
    for r, h in zip(rows, held):
        words = words_of(r[1])
        p = {w: (single[w] + 0.5) / (n + 0.5 * (v + 1)) for w in words}
        base = sum(math.log10(p[w]) for w in words)
        score = 0.0
        for i, w in enumerate(words):
            before = words[i - 1] if i else None
            q = (pairs[before, w] + mu * p[w]) / (single[before] + mu)
            if nu and i:
                first = words[i - 2] if i > 1 else None
                q = (triples[first, before, w] + nu * q) / (pairs[first, before] + nu)
            score += math.log10(q)
        out.append((str(r[0]), h, len(words), sum(single[w] > 0 for w in words), n, base, score))
    return sorted(out)


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("block, hot, per_shard", [(1 << 25, 200_000, 3 << 20), (2000, 3, 500)])
def test_scores_against_brute_force(spark, monkeypatch, block, hot, per_shard, order):
    for name, value in {"BLOCK_BYTES": block, "HOT": hot, "PAIRS_PER_SHARD": per_shard, "WORDS_PER_SHARD": per_shard}.items():
        monkeypatch.setattr(lm, name, value)
    rows = samples.documents()
    found = sorted((str(r[0]), *r[1:]) for r in lm.scored(samples.table(spark), lm.held_out(), order=order).collect())
    expected = brute(rows, lm.MU, lm.NU if order == 3 else None)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    for a, b in zip(found, expected):
        assert math.isclose(a[5], b[5], rel_tol=1e-9)
        assert math.isclose(a[6], b[6], rel_tol=2e-3)  # shares are quantised


def test_orders_are_two_or_three(spark):
    with pytest.raises(ValueError):
        lm.scored(samples.table(spark), lm.held_out(), order=4)


def test_numbers_are_packed_whole():
    rng = np.random.default_rng(4)
    for kind in ("u1", "<u4", "<u8"):
        for n in (0, 1, 1000):
            values = rng.integers(0, np.iinfo(kind).max, n, kind)
            assert (lm._unpacked(lm._packed(values), kind) == values).all()


def test_a_trie_of_three_levels():
    rng = np.random.default_rng(3)
    seen = sorted({tuple(int(x) for x in rng.integers(1, 40, 3)) for _ in range(3000)})
    pairs = sorted({x[:2] for x in seen})
    firsts = sorted({x[0] for x in seen})
    shares = rng.random(len(seen)) + 1e-6
    trie = Trie.from_buffer(
        Trie.of(
            np.array(firsts, np.uint64),
            *(np.array(x) for x in zip(*((firsts.index(u), v) for u, v in pairs))),
            *(np.array(x) for x in zip(*((pairs.index(x[:2]), x[2]) for x in seen))),
            shares,
        ).to_bytes()
    )
    value = dict(zip(seen, shares))
    asked = [(u, v, w) for u in range(50) for v in range(50) for w in (1, 7, 39, 70)]
    codes = trie.find(
        np.arange(50, dtype=np.uint64),
        np.full(50, 50),
        np.tile(np.arange(50), 50),
        np.full(2500, 4),
        np.array([x[2] for x in asked]),
    )
    for x, code in zip(asked, codes):
        assert (code > 0) == (x in value)
        if code:
            assert abs(math.log(trie.codebook[code] / value[x])) < 0.2


def test_probabilities_sum_to_one():
    rows = [(i, "a b a c", *[None] * 4) for i in range(9)]
    single, pairs = Counter(), Counter()
    for r in rows:
        words = words_of(r[1])
        single.update(words)
        pairs.update(zip([None, *words], words))
    n, v = sum(single.values()), len(single)
    plain = {w: (c + 0.5) / (n + 0.5 * (v + 1)) for w, c in single.items()}
    unknown = 0.5 / (n + 0.5 * (v + 1))
    for before in single:
        total = sum((pairs[before, w] + lm.MU * p) / (single[before] + lm.MU) for w, p in plain.items())
        assert math.isclose(total + lm.MU * unknown / (single[before] + lm.MU), 1)


def test_nothing_to_learn_from(spark):
    assert lm.scored(samples.empty(spark), lm.held_out()).count() == 0
    from pyspark.sql import functions as F

    one = samples.table(spark, [(1, "a b", None, None, None, None)])
    row = lm.scored(one, F.lit(True)).collect()[0]
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0, 0)
