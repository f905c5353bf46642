import random

import numpy as np
import xxhash

import llm_samples as samples
from pyspark.sql import functions as F
from tidemark.llm import simhash
from tidemark.llm.components import connected


def brute_print(text, size=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, linked):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {v: find(v) for v in values}


def test_fingerprints_equal_spark_hashes(spark):
    for text in ("a b c d", "One", "", " x\ty ", "Ä b C", "w " * 70_000):
        assert simhash.fingerprint_of(text) == brute_print(text)
    words = ["a b c", "b c d"]
    hashes = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()
    assert [xxhash.xxh64_intdigest(w, 42) for w in words] == [h[0] % (1 << 64) for h in hashes]




def test_collisions_connect_what_is_near(spark):
    rng = random.Random(5)
    values = []
    for _ in range(12):
        base = rng.getrandbits(64)
        values.append(base)
        for _ in range(6):  # chains of near values
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                base ^= 1 << bit
            values.append(base)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    prints = spark.createDataFrame([(v,) for v in signed + signed[:5] + [None]], "v long")
    links = simhash.collisions(prints, "v")
    for a, b in links.collect():
        assert a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    found = {r["node"]: r["root"] for r in connected(links, "a", "b").collect()}
    expected = roots(set(signed), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {v: found.get(v, v) for v in set(signed)} == expected


def test_components_of_random_graphs(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    edges += [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(60)] + [(None, 3), (4, None)]
    frame = spark.createDataFrame(edges, "x long, y long")
    found = {r["node"]: r["root"] for r in connected(frame, "x", "y").collect()}
    real = {(a, b) for a, b in edges if a is not None and b is not None and a != b}
    nodes = {n for e in real for n in e}
    expected = {}
    for n in nodes:
        reach, ahead = {n}, [n]
        while ahead:
            at = ahead.pop()
            for a, b in real:
                for x, y in ((a, b), (b, a)):
                    if x == at and y not in reach:
                        reach.add(y)
                        ahead.append(y)
        expected[n] = min(reach)
    assert found == expected
    assert connected(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_documents_against_brute_force(spark):
    rows = samples.documents()
    found = simhash.components(samples.table(spark).drop("lang", "source", "n_chars")).collect()
    prints = [brute_print(r[1]) for r in rows]
    near = roots(set(prints), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            least[near[p]] = min(r[0], least.get(near[p], r[0]))
    expected = [(r[0], f"{p:016x}", least.get(near[p])) for r, p in zip(rows, prints)]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert simhash.components(samples.empty(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = samples.documents()
    docs = samples.table(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    prints = {i: brute_print(r[1]) for i, r in enumerate(rows)}
    near = roots(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    groups = {near[p] for p in prints.values()}
    got = kept.collect()
    assert len(got) == len(groups)
    for r in got:
        ids = [x[0] for i, x in enumerate(rows) if near[prints[i]] == near[brute_print(r["text"])]]
        known = [i for i in ids if i is not None]
        assert r["doc_id"] == (min(known) if known else None)
    assert simhash.keep_one(samples.empty(spark)).count() == 0


def test_fingerprints_are_spread_once_more_before_their_variants(spark):
    """The spreading shuffle is in the plan that ran, and its partitions were not merged."""
    prints = spark.range(300).select(F.xxhash64("id").alias("v"))
    links = simhash.collisions(prints, "v")
    links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(xxhash64(_value" in plan and "REPARTITION_BY_NUM" in plan
