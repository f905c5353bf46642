import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tidemark.llm import dialogs

SCHEMA = "conv_id long, turn long, role string, text string, key string"
BLANKS = " \t\n\x0b\f\r"


def damaged(rows):
    found = []
    for conv, turn, role, text, *_ in rows:
        named = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fate = zlib.crc32(named.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        found += [(conv, turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return found


def faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        said = text.rstrip(BLANKS)
        if not said:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("ok" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def cheapest(rows, kinds):
    """(cost, audit, lines) by trying everything from the end, inserted turns included."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    written = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(at, state, inserted):
        options = []
        if at == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserted < 3:
            for new in set(follows[state]) - {"s"}:
                cost, audit, lines = best(at, new, inserted + 1)
                options.append((cost + 5, "I" + audit, (written[new] + ":", *lines)))
        if at < len(rows):
            _, _, role, text = rows[at]
            cost, audit, lines = best(at + 1, state, 0)
            options.append((cost + 2, "D" + audit, lines))
            if kinds[at] in ("ok", "truncated"):
                extra = 5 * (kinds[at] == "truncated")
                for new in follows[state]:
                    if role[:1] == new:
                        cost, audit, lines = best(at + 1, new, 0)
                        options.append((cost + extra, "K" + audit, (f"{role}:{text}", *lines)))
                    if new != "s":
                        cost, audit, lines = best(at + 1, new, 0)
                        options.append((cost + 1 + extra, "R" + audit, (f"{written[new]}:{text}", *lines)))
        return min(options, default=(10**6, "", ()))

    return best(0, "", 0)


def expected(rows, before):
    by_turn = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    found = {}
    for conv in {r[0] for r in before}:
        own = sorted((r for r in rows if r[0] == conv), key=by_turn)
        kinds = faults(own)
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        cost, audit, lines = cheapest(own, kinds)
        found[conv] = (
            gaps,
            *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return found


def conversations(seed, count, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", " \t", "", None, "é done!\n", "a\nb", "Yes.", "x" * 300 + "."]
    rows = []
    for conv in range(count):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"])
            at = None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 0, 1, -3])
            rows.append((conv, at, role, rng.choice(texts) if rng.random() < 0.5 else f"Turn {conv} {turn}.", "x"))
    rows += [(None, 1, "user", "Hi.", "x"), (None, 0, "system", "Be brief.", "x"), (10**6, None, None, None, None)]
    return rows


@pytest.mark.parametrize("seed, block, longest", [(1, 1024, 9), (2, 7, 9), (3, 4, 30)])
def test_against_brute_force(spark, monkeypatch, seed, block, longest):
    """Blocks of 4 and 7 rows cut most conversations, several times."""
    monkeypatch.setattr(dialogs, "BLOCK", block)
    rows = conversations(seed, 40 if longest < 30 else 12, longest)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = dialogs.report(dialogs.damaged(frame), frame).collect()
    want = expected(damaged(rows), rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r
    # No damage, and the turns themselves.
    plain = [tuple(" " if x is None else x for x in r[2:4]) for r in rows]
    plain = [(*r[:2], *p) for r, p in zip(rows, plain)]
    want = expected(plain, rows)
    lines = {}
    for r in dialogs.repaired(frame).orderBy("conv_id", "position").collect():
        lines.setdefault(r["conv_id"], []).append(r)
    for r in dialogs.report(frame, frame).collect():
        own = lines.get(r["conv_id"], [])
        assert tuple(r)[1:] == want[r["conv_id"]]
        assert [x["position"] for x in own] == list(range(len(own)))
        text = "\n".join(f"{x['role']}:{x['text']}" for x in own)
        assert hashlib.sha256(text.encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][0] for x in own))
        assert "".join(x["edit"] for x in own) == r["audit"].replace("D", "")


def test_prices_are_exact_and_work_grows_with_the_rows(monkeypatch):
    """Against all cheapest ways by dynamic programming, and without a longer search in long ones."""
    rng, steps = random.Random(5), []
    plain = dialogs.Lattice.arcs
    monkeypatch.setattr(dialogs.Lattice, "arcs", lambda self, node: (steps.append(1), plain(self, node))[1])
    for n in (0, 1, 2, 50, 4000):
        rows = [(rng.choice("suax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        steps.clear()
        lattice = dialogs.Lattice(rows, dialogs.ENDS, True)
        assert len(steps) < 40 * (n + 1)
        for node in range(lattice.end):
            assert lattice.prices[node] == min(c + lattice.prices[j] for c, j, _ in lattice.arcs(node))
    crossing = dialogs.matrix([("u", 0), ("s", 0)])
    assert crossing[0][0] == 4 and crossing[1][1] == 4 and crossing[2][0] == dialogs.FAR


def test_one_conversation_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(dialogs, "BLOCK", 16)
    rows = [(7, t // 2, ["user", "assistant"][t % 2], f"Said {t}.", "") for t in range(600)]
    rows += [(100 + t // 4, t % 4, ["user", "assistant"][t % 2], "Well.", "") for t in range(1200)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r["conv_id"]: r for r in dialogs.report(frame, frame).collect()}
    assert len(found) == 301
    assert len(found[7]["audit"].replace("I", "")) == 600


def test_empty_and_dropped(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert dialogs.report(dialogs.damaged(nothing), nothing).count() == 0
    assert dialogs.repaired(nothing).count() == 0
    some = spark.createDataFrame([(1, 2, "user", "Hi.", "")], SCHEMA)
    got = dialogs.report(some.where(F.lit(False)), some).collect()
    assert tuple(got[0]) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
