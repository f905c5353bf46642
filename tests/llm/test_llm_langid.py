import numpy as np

import llm_samples as samples
from pyspark.sql import functions as F
from tidemark.llm import langid


def test_gradients_by_differences():
    network = langid.Network(["a", "b", "c"], hidden=3, seed=1)
    network.weights = {k: w.astype(np.float64) for k, w in network.weights.items()}
    steps, sizes = langid.laid_out([b"abc", b"a", b"cabbage"])
    labels = np.array([0, 2, 1])

    def loss():
        p = network.positions(steps, sizes)[0]
        real = np.arange(len(steps))[:, None] < sizes
        return -(np.log(p[:, np.arange(3), labels]) * real).sum() / real.sum()

    found = network.gradients(steps, sizes, labels)
    rng = np.random.default_rng(0)
    for name, weight in network.weights.items():
        for _ in range(12):
            at = tuple(rng.integers(n) for n in weight.shape)
            if name.startswith("E"):
                at = (ord("a") + at[0] % 3, at[1])
            before, step = weight[at], 1e-4
            weight[at] = before + step
            up = loss()
            weight[at] = before - step
            down = loss()
            weight[at] = before
            assert abs((up - down) / (2 * step) - found[name][at]) < 1e-3


def test_padding_and_caching_change_nothing():
    network = langid.Network(["a", "b"], hidden=4)
    words = [b"x", b"abcd", b"w" * 60, b"longer words", b"x"]
    together = network.pooled(words)
    assert np.allclose(together, [network.pooled([w])[0] for w in words], atol=1e-4)
    assert together[:, -1].tolist() == [len(w) for w in words]
    labeller = langid.Labeller(network)
    first = labeller.label(["some text here", None, "", "12 !!", "text here some"])
    assert first[1:4] == [("und", 0.0)] * 3
    again = labeller.label(["some text here"])[0]
    assert again[0] == first[0][0] and abs(again[1] - first[0][1]) < 1e-6


def test_held_out_accuracy(spark):
    rows = samples.documents(n=240)
    docs = samples.table(spark, rows)
    network = langid.fitted(docs, ~langid.held_out())
    assert network.languages == ["de", "en"]
    found = langid.identified(docs.withColumn("held", langid.held_out()), network).collect()
    assert len(found) == len(rows)
    tested = [r for r in found if r["held"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    right = sum(r["lang_pred"] == r["lang"] for r in tested)
    assert len(tested) > 30 and right >= 0.95 * len(tested)
    for r in found:
        no_letter = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == no_letter and 0 <= r["score"] <= 1


def test_languages_are_no_input_and_empty_tables(spark):
    docs = samples.table(spark)
    network = langid.fitted(docs, ~langid.held_out())
    ids = ["doc_id", "text", "lang_pred", F.round("score", 3).alias("score")]
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    a = langid.identified(docs, network).select(*ids).collect()
    b = langid.identified(other, network).select(*ids).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
        assert x[:3] == y[:3] and abs(x["score"] - y["score"]) < 0.002
    nothing = langid.fitted(samples.empty(spark), F.lit(True))
    assert {r["lang_pred"] for r in langid.identified(docs, nothing).collect()} == {"und"}
    assert langid.identified(samples.empty(spark), network).count() == 0
