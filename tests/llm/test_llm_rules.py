import random
import re

import llm_samples as samples
from tidemark.llm import rules


def brute_repeats(words, size=5):
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    often = {w for w in windows if windows.count(w) > 1}
    return len({i + k for i, w in enumerate(windows) if w in often for k in range(size)})


def test_repeated_words():
    rng = random.Random(1)
    for n in (0, 3, 5, 6, 40, 120):
        for kinds in (1, 2, 3, 50):
            words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
            assert rules.repeated_words(words) == brute_repeats(words)


def test_measurements():
    text = "one #two\n one #two\n\n\t\none #two\nüñ x <|>"
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert rules.measure(text) == (len(words), sum(map(len, words)), 6, 4, 1, 0)
    assert rules.measure("") == (0, 0, 0, 0, 0, 0)


def test_ledger_policies_and_ablations(spark):
    rows = samples.documents()
    entries = rules.ledger(samples.table(spark)).cache()
    assert entries.count() == len(rows)
    assert entries.columns[:5] == ["doc_id", "lang", "source", "n_chars", "_key"]
    got = {(r["doc_id"], r["n_words"]): r for r in entries.collect()}
    for r in rows:
        measured = rules.measure(r[1] or "")
        entry = got[r[0], measured[0]]
        assert tuple(entry[m] for m in rules.MEASUREMENTS) == measured
        base = measured[0] < 10 or 100 * measured[5] > 20 * measured[0]
        assert (entry["failures"] & rules.mask("base") != 0) == base
    all_failures = [r["failures"] for r in entries.collect()]
    for policy in rules.POLICIES:
        bits = rules.mask(policy)
        assert entries.where(rules.passes(policy)).count() == sum(not f & bits for f in all_failures)
        for a in rules.ablations(entries, policy).collect():
            bit = 1 << rules.BITS[a["rule"]]
            assert a["failed"] == sum(bool(f & bit) for f in all_failures)
            assert a["rejected_alone"] == sum(f & bits == bit for f in all_failures)
            assert a["kept_without"] == sum(not f & bits & ~bit for f in all_failures)
    nothing = rules.ledger(samples.empty(spark))
    assert nothing.count() == 0
    assert {a["kept_without"] for a in rules.ablations(nothing).collect()} == {0}
