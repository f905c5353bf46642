import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

import llm_samples as samples
from tidemark.llm import mixing


@pytest.mark.parametrize("weights", [(1,), (1, 1), (5, 3, 1), (0.001, 7, 2, 2), tuple(range(1, 40))])
def test_a_frame_stays_within_one_block(weights):
    slots = mixing.shares(dict(enumerate(weights)), 512)
    assert sum(slots.values()) == 512 and min(slots.values()) >= 1
    assert all(abs(n - 512 * w / sum(weights)) <= len(weights) for n, w in zip(slots.values(), weights))
    done = Counter()
    for source, number, release, deadline, slot in sorted(mixing.schedule(slots), key=lambda x: x[4]):
        assert release <= slot < deadline and number == done[source]
        done[source] += 1
        for s, n in slots.items():
            assert abs(done[s] - Fraction(n * (slot + 1), 512)) < 1
    assert done == slots


def test_refusals():
    for bad in ({"a": 0.0}, {"a": -1}, {i: 1 for i in range(9)}):
        with pytest.raises(ValueError):
            mixing.shares(bad, 8)


def test_all_rows_in_order(spark):
    rows = samples.documents(n=400)
    rng = random.Random(2)
    rows = [r if rng.random() < 0.6 else (*r[:3], "s0", *r[4:]) for r in rows]
    docs = samples.table(spark, rows)
    mix = mixing.mixed(docs, block=4, frame=32).collect()
    assert Counter(tuple(r)[:6] for r in mix) == Counter(tuple(r) for r in rows)
    counts = Counter(r[3] for r in rows)
    slots = mixing.shares({s: n**mixing.EXPONENT for s, n in counts.items()}, 32)
    blocks, used = defaultdict(list), {}
    for r in mix:
        blocks[r["source"], r["mix_block"]].append(r["mix_place"])
        assert used.setdefault(r["mix_slot"], (r["source"], r["mix_block"])) == (r["source"], r["mix_block"])
        assert r["mix_release"] <= r["mix_slot"] < r["mix_deadline"]
    for (source, block), places in blocks.items():
        size = 4 if (block + 1) * 4 <= counts[source] else counts[source] % 4
        assert sorted(places) == list(range(size))
    # In every prefix of slots before the first source runs out, each is within a block of its share.
    on_target = {r["mix_slot"] for r in mix if r["on_target"]}
    assert on_target and sorted(on_target) == list(range(len(on_target)))
    done = Counter()
    for slot in sorted(on_target):
        done[used[slot][0]] += 1
        for s, n in slots.items():
            assert abs(done[s] - Fraction(n * (slot + 1), 32)) < 1


def test_given_weights_and_empty(spark):
    docs = samples.table(spark)
    with pytest.raises(ValueError):
        mixing.mixed(docs, {"s0": 1.0})
    given = {s: w for s, w in zip(("s0", "s1", "s2", "s3", None), (8, 4, 2, 1, 1))}
    assert mixing.mixed(docs, given, block=2, frame=16).count() == docs.count()
    assert mixing.mixed(samples.empty(spark)).count() == 0
    assert mixing.mixed(mixing.mixed(docs)).columns == mixing.mixed(docs).columns


def deviation(order, weights):
    """The largest distance of a source from its target over all prefixes of ``order``, in blocks."""
    total, done, worst = sum(weights), [0] * len(weights), 0
    for slot, k in enumerate(order):
        done[k] += 1
        worst = max(worst, *(abs(n * total - w * (slot + 1)) for n, w in zip(done, weights)))
    return Fraction(worst, total)


@pytest.mark.parametrize("small", [19, 300])
def test_the_target_holds_over_many_frames(small):
    exact = mixing.whole({k: w for k, w in enumerate([1 / 3, *[2 / 3 / small] * small])})
    weights, frames = list(exact.values()), 5 if small < 100 else 1
    slots = frames * mixing.FRAME
    found = [r for r, _ in zip(mixing.course(weights, [slots] * len(weights)), range(slots))]
    assert [r[4] for r in found] == list(range(slots)) and all(r[5] for r in found)
    assert deviation([r[0] for r in found], weights) < 1
    rounded = [n for n in mixing.shares(exact).values()]
    assert abs(Fraction(rounded[0], mixing.FRAME) - Fraction(weights[0], sum(weights))) * slots > 1


def test_rows_hold_the_target_and_all_blocks_are_scheduled(spark):
    rows = [(i, None, None, "hot" if i % 3 == 0 else f"s{i % 40}", None, None) for i in range(3000)]
    given = {s: 1 / 3 if s == "hot" else 2 / 3 / 40 for s in {r[3] for r in rows}}
    mix = mixing.mixed(samples.table(spark, rows), given, block=1).collect()
    assert sorted(r["mix_slot"] for r in mix) == list(range(3000))
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in mix)
    names, exact = sorted(given), mixing.whole(given)
    on_target = sorted((r["mix_slot"], names.index(r["source"])) for r in mix if r["on_target"])
    assert [slot for slot, _ in on_target] == list(range(len(on_target))) and len(on_target) > 1000
    assert deviation([k for _, k in on_target], [exact[s] for s in names]) < 1


def edf(weights, blocks):
    """Slot by slot: of the blocks that are released, the one with the earliest deadline."""
    total, slots = sum(weights), []
    done = [0] * len(blocks)
    for slot in range(sum(blocks)):
        ready = []
        for k, w in enumerate(weights):
            share = Fraction(w, total)
            if math.floor(done[k] / share) <= slot:
                ready.append((math.ceil((done[k] + 1) / share), k))
        deadline, k = min(ready)
        if done[k] == blocks[k]:  # from here on the proportions are those of the sources left
            return slots
        slots.append((k, done[k], math.floor(done[k] / Fraction(weights[k], total)), deadline, slot))
        done[k] += 1
    return slots


@pytest.mark.parametrize("seed", range(6))
def test_the_course_against_brute_force(seed):
    rng = random.Random(seed)
    weights = [rng.randint(1, 9) for _ in range(rng.randint(1, 7))]
    blocks = [rng.randint(1, 60) for _ in weights]
    want = edf(weights, blocks)
    found = list(mixing.course(weights, blocks))
    assert len(found) == sum(blocks) and [r[:5] for r in found[: len(want)]] == want
    assert all(r[5] for r in found[: len(want)]) and not any(r[5] for r in found[len(want) :])


def test_named_weights_with_a_default(spark):
    docs = samples.table(spark, [(i, "x", "en", f"s{i % 4}", 1, 1) for i in range(400)])
    mix = mixing.mixed(docs, {"s0": 5.0, "s1": 3.0}, block=1, default=1.0).collect()
    first = [r for r in mix if r["on_target"]]
    counts = Counter(r["source"] for r in first)
    assert abs(counts["s0"] - len(first) / 2) < 1 and abs(counts["s3"] - len(first) / 10) < 1
