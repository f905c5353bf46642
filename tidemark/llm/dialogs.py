"""Repair of conversation structure: cheapest edits by the auction algorithm for shortest paths."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import SPACES, ranked, written

#: What edits cost, and the pairs of role initials that may follow each other.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")

BLOCK = 1024  # rows whose lattice one call holds
FAR = 1 << 40  # the cost of what can't be reached

#: What has come out so far: nothing, a system turn, a user's, an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (0, FAR, FAR, 0)  # a conversation may end with nothing or an assistant's turn
BEHIND = (0, 2 * INSERT, INSERT, 0)  # the same, counting the turns that have to be inserted
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
REACH = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))  # states that can still follow each state
WANTED = "uuau"  # the role that each state wants next

OK, BLANK, DUPLICATE, CUT = range(4)  # a row's fault


def _insertion(state: int) -> tuple[int, int, int, str]:
    return (INSERT, 0, NEXT[state, WANTED[state]], WANTED[state])


def _arcs(initial: str, fault: int) -> list[list[tuple[int, int, int, str]]]:
    """By state, the edits (cost, rows consumed, next state, step) of a row, by ASCII of their initials.

    A step says more than its initial: an inserted turn is ``u`` or ``a``, a rerole ``U`` or ``A``.
    """
    found = []
    for state in range(4):
        edits = [(DELETE, 1, state, "D"), _insertion(state)]
        if fault in (OK, CUT):
            extra, role = TRUNCATED * (fault == CUT), WANTED[state]
            if (state, initial) in NEXT:
                edits.append((extra, 1, NEXT[state, initial], "K"))
            edits.append((REROLE + extra, 1, NEXT[state, role], role.upper()))
        found.append(edits)
    return found


_known = {(i, f): _arcs(i, f) for i in ("s", "u", "a", "") for f in (OK, BLANK, DUPLICATE, CUT)}


class Lattice:
    """Rows by states, and the prices that the auction algorithm finds: the cost from a node to the end.

    A node is 4 * row + state. ``exits`` is the cost of leaving behind the last row by state; turns
    are inserted there only at the end of a conversation (``last``), else before the next row.
    """

    def __init__(self, rows: Sequence[tuple[str, int]], exits: Sequence[int], last: bool) -> None:
        self.rows, self.exits, self.last = rows, exits, last
        self.end = 4 * (len(rows) + 1)
        self.prices = [0] * (self.end + 1)
        self.settled = [False] * self.end + [True]
        self._converge()

    def arcs(self, node: int) -> Iterator[tuple[int, int, str]]:
        """(cost, next node, step) of each arc, by ASCII of the edits' initials; leaving comes first."""
        row, state = divmod(node, 4)
        if row < len(self.rows):
            initial, fault = self.rows[row]
            for cost, ahead, to, step in _known[initial if initial in "sua" else "", fault][state]:
                yield cost, 4 * (row + ahead) + to, step
            return
        yield self.exits[state], self.end, ""
        if self.last:
            cost, _, to, step = _insertion(state)
            yield cost, 4 * row + to, step

    def _converge(self) -> None:
        """Exact prices of all nodes: every node is the origin once, from the last row to the first.

        Prices begin as lower bounds that no arc violates (p <= cost + p of its end): the least price
        behind the row among the states that can follow.
        """
        for row in range(len(self.rows), -1, -1):
            for state in range(4):
                if row < len(self.rows):
                    low = min(self.prices[4 * row + 4 + s] for s in REACH[state])
                else:
                    low = min(self.exits[s] for s in (REACH[state] if self.last else (state,)))
                self.prices[4 * row + state] = low
            for state in range(4):
                self.auction(4 * row + state)

    def auction(self, origin: int) -> None:
        """Extend a path of tight arcs from ``origin`` until it meets a node whose price is exact.

        At the path's last node, either its price is below what its best arc costs: it rises to that,
        and the path contracts by the node. Or the arc is tight, and the path is extended by it. All
        arcs on the path stay tight, and a cycle costs something, so no node comes up twice in a path.
        """
        prices, path = self.prices, [origin]
        while not self.settled[path[-1]]:
            node = path[-1]
            best, to = min((cost + prices[j], j) for cost, j, _ in self.arcs(node))
            if prices[node] < best:
                prices[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for node in path:
            self.settled[node] = True

    def trace(self, state: int) -> tuple[str, int] | None:
        """(steps, state behind them) of the cheapest path from a state whose initials are ASCII-least.

        Prices are exact, so the tight arcs are those of cheapest paths, and the first one leads on.
        """
        node, steps = state, []
        if self.prices[node] >= FAR:
            return None
        while True:
            to, step = next((j, s) for cost, j, s in self.arcs(node) if self.prices[node] == cost + self.prices[j])
            if to == self.end:
                return "".join(steps), node % 4
            steps.append(step)
            node = to


def matrix(rows: Sequence[tuple[str, int]]) -> list[list[int]]:
    """What it costs to get from each state before the rows to each state behind them."""
    columns = [Lattice(rows, [0 if s == to else FAR for s in range(4)], False).prices[:4] for to in range(4)]
    return [[min(FAR, column[state]) for column in columns] for state in range(4)]


def audit(steps: Column) -> Column:
    """The initials of edits (Keep, Rerole, Delete, Insert)."""
    return F.translate(steps, "uaUA", "IIRR")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after deterministic damage by the checksum of ``conv_id:turn`` mod 20:
    0 drops the row, 1 empties its text, 2 removes its full stops, 3 repeats it, 4 makes it a user's.

    A null is one space in the checksum, and as role or text; conv_id and turn stay null.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fate = F.crc32(F.concat_ws(":", *named).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return turns.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy"),
    ).drop("_copy")


def _key() -> Column:
    """A conversation's name; that of rows without an id is like no other."""
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))


def _numbered(turns: DataFrame) -> DataFrame:
    """All turns, numbered through by conversation and turn (nulls first; ties by role, then text)."""
    text = F.coalesce("text", F.lit(" "))
    rows = turns.select(
        _key().alias("key"),
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        text.alias("text"),
        F.sha2(text, 256).alias("digest"),
        F.rand(1).alias("any"),  # equal rows may be cut anywhere
    )
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.left("text", F.lit(200)), F.col("digest")]
    found = ranked(rows, [*order, F.col("any")], "number", "turns").drop("any")
    return found.withColumn("block", F.floor(F.col("number") / BLOCK).cast("long"))


def _judged(rows: DataFrame) -> DataFrame:
    """key, block, number, initial and fault of each numbered row, without its text."""
    said = F.rtrim(F.col("text"), F.lit(SPACES))
    short = rows.select(
        "key", "block", "number", "role", "digest", (said == "").alias("blank"), F.right(said, F.lit(1)).alias("end")
    )
    again = short.groupBy("key", "role", "digest").agg(F.min("number").alias("earliest"), F.count(F.lit(1)).alias("n"))
    again = again.where("n > 1").drop("n")
    fault = (
        F.when(F.col("blank"), BLANK)
        .when(F.col("number") > F.col("earliest"), DUPLICATE)
        .when(~F.col("end").isin(".", "!", "?"), CUT)
        .otherwise(OK)
    )
    marked = short.join(again, ["key", "role", "digest"], "left")
    return marked.select("key", "block", "number", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))


def _runs(table: pa.Table) -> Iterator[tuple[str, list[dict]]]:
    return groupby(table.sort_by("number").to_pylist(), key=lambda r: r["key"])


def _exits(judged: DataFrame) -> DataFrame:
    """(key, block, first, exits) of the pieces of conversations that lie in several blocks.

    A piece's cheapest crossings are a 4 by 4 table, whatever its length; chained from the
    conversation's end they give what it costs behind each piece, by state.
    """
    pieces = judged.groupBy("key", "block").agg(F.count(F.lit(1)).alias("rows"))
    long = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1")

    def cross(table: pa.Table) -> pa.Table:
        rows = [(r["initial"], r["fault"]) for r in table.sort_by("number").to_pylist()]
        costs = [c for line in matrix(rows) for c in line]
        return pa.table({"key": table["key"][:1], "block": table["block"][:1], "costs": pa.array([costs], pa.list_(pa.int64()))})

    def chain(table: pa.Table) -> pa.Table:
        behind, found = list(BEHIND), []
        pieces = table.sort_by("block").to_pylist()
        for number in range(len(pieces) - 1, -1, -1):
            piece = pieces[number]
            found.append({"key": piece["key"], "block": piece["block"], "first": number == 0, "exits": None if number == len(pieces) - 1 else behind})
            costs = [piece["costs"][4 * s : 4 * s + 4] for s in range(4)]
            behind = [min(FAR, *(c + b for c, b in zip(line, behind))) for line in costs]
        kinds = [("key", pa.string()), ("block", pa.int64()), ("first", pa.bool_()), ("exits", pa.list_(pa.int64()))]
        return pa.Table.from_pylist(found, pa.schema(kinds))

    crossed = judged.join(long.select("key"), "key", "left_semi").groupBy("key", "block")
    costs = crossed.applyInArrow(cross, "key string, block long, costs array<long>")
    return costs.groupBy("key").applyInArrow(chain, "key string, block long, first boolean, exits array<long>")


_PIECE = (
    "key string, block long, first long, start string, end string, blank long, duplicate long, truncated long, "
    "illegal long, steps array<string>, ends array<int>, costs array<long>, whole boolean"
)
_PIECE_ARROW = pa.schema(
    [("key", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("start", pa.string()), ("end", pa.string())]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]
    + [("steps", pa.list_(pa.string())), ("ends", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64()))]
    + [("whole", pa.bool_())]
)


def _steps_cost(steps: str, faults: Sequence[int]) -> int:
    cost, row = 0, 0
    for step in steps:
        cost += {"D": DELETE, "K": 0, "U": REROLE, "A": REROLE}.get(step, INSERT)
        if step in "DKUA":
            cost += TRUNCATED * (step != "D" and faults[row] == CUT)
            row += 1
    return cost


def _pieces(judged: DataFrame, exits: DataFrame) -> DataFrame:
    """Each conversation's piece of each block, with its cheapest edits from each state it may begin in."""

    def solve(table: pa.Table) -> pa.Table:
        found = []
        for key, run in _runs(table):
            run = list(run)
            head, faults = run[0], [r["fault"] for r in run]
            initials = [r["initial"] for r in run]
            # Pieces of one block have no row in ``exits``: they are first and last.
            whole = head["is_first"] is None
            last = head["exits"] is None
            lattice = Lattice(list(zip(initials, faults)), ENDS if last else head["exits"], last)
            states = range(4) if head["is_first"] is False else (NOTHING,)
            traced = {s: lattice.trace(s) for s in states}
            steps = [traced[s][0] if traced.get(s) else None for s in range(4)]
            found.append(
                {
                    "key": key,
                    "block": head["block"],
                    "first": head["number"],
                    "start": initials[0],
                    "end": initials[-1],
                    "blank": faults.count(BLANK),
                    "duplicate": faults.count(DUPLICATE),
                    "truncated": faults.count(CUT),
                    "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
                    "steps": steps,
                    "ends": [traced[s][1] if traced.get(s) else None for s in range(4)],
                    "costs": [None if s is None else _steps_cost(s, faults) for s in steps],
                    "whole": whole,
                }
            )
        return pa.Table.from_pylist(found, _PIECE_ARROW)

    known = exits.select("key", "block", F.col("first").alias("is_first"), "exits")
    return judged.join(known, ["key", "block"], "left").groupBy("block").applyInArrow(solve, _PIECE)


def _entered(pieces: DataFrame) -> DataFrame:
    """(key, block, state, clash) of the pieces of longer conversations: the state each begins in, and
    whether its first row is illegal behind the row before."""

    def follow(table: pa.Table) -> pa.Table:
        state, before, found = NOTHING, None, []
        for piece in table.sort_by("block").to_pylist():
            clash = int(before is not None and before + piece["start"] not in LEGAL)
            found.append({"key": piece["key"], "block": piece["block"], "state": state, "clash": clash})
            state, before = piece["ends"][state], piece["end"]
        kinds = [("key", pa.string()), ("block", pa.int64()), ("state", pa.int32()), ("clash", pa.int64())]
        return pa.Table.from_pylist(found, pa.schema(kinds))

    several = pieces.where(~F.col("whole")).select("key", "block", "start", "end", "ends")
    return several.groupBy("key").applyInArrow(follow, "key string, block long, state int, clash long")


def _solved(rows: DataFrame) -> DataFrame:
    """The pieces of all conversations with the steps that were chosen and their cost."""
    judged = written(_judged(rows), "turns-judged")
    exits = written(_exits(judged), "turns-exits")
    pieces = written(_pieces(judged, exits), "turns-pieces")
    found = pieces.join(_entered(pieces), ["key", "block"], "left")
    state = F.coalesce("state", F.lit(NOTHING))
    return found.select(
        "key",
        "block",
        "first",
        "blank",
        "duplicate",
        "truncated",
        (F.col("illegal") + F.coalesce("clash", F.lit(0))).alias("illegal"),
        F.get("steps", state).alias("steps"),
        F.get("costs", state).alias("cost"),
    )


_STEP = re.compile("([ua]*)([KUAD]?)")
_ROLES = {"u": "user", "a": "assistant", "U": "user", "A": "assistant"}


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, object, str, str, str]]:
    """(key, turn, role, text, edit) of every repaired turn, from steps and turns in their order."""
    steps, inserted, edit = iter(()), "", ""
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("key", "steps", "turn", "role", "text"))):
            key, path, turn, role, text = r
            if path is not None:
                steps = iter(_STEP.findall(path))
                inserted, edit = next(steps)
                continue
            for new in inserted:
                yield key, None, _ROLES[new], "", "I"
            if edit != "D":
                yield key, turn, _ROLES.get(edit, role), text, "K" if edit == "K" else "R"
            inserted, edit = next(steps, ("", ""))
            if inserted and not edit:  # behind the last row of a conversation
                for new in inserted:
                    yield key, None, _ROLES[new], "", "I"
                inserted = ""


def _in_order(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """Each piece's steps in front of its turns, a conversation in one partition, in order."""
    blank = F.lit(None).cast("string")
    steps = solved.select("key", F.col("first").alias("number"), "steps", F.lit(None).cast("long").alias("turn"), blank.alias("role"), blank.alias("text"))
    turns = rows.select("key", "number", blank.alias("steps"), "turn", "role", "text")
    return steps.union(turns).repartition("key").sortWithinPartitions("key", "number", F.col("steps").isNull())


def _hashes(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of conversations that keep or get a turn; texts are hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {"key": [], "repaired_sha256": []}
        for key, lines in groupby(_lines(batches), key=lambda r: r[0]):
            hashed, cut = hashlib.sha256(), ""
            for _, _, role, text, _ in lines:
                hashed.update(f"{cut}{role}:{text}".encode("utf-8", "surrogatepass"))
                cut = "\n"
            found["key"].append(key)
            found["repaired_sha256"].append(hashed.hexdigest())
            if len(found["key"]) == 4096:
                yield pa.RecordBatch.from_pydict(found)
                found = {"key": [], "repaired_sha256": []}
        if found["key"]:
            yield pa.RecordBatch.from_pydict(found)

    return _in_order(rows, solved).mapInArrow(run, "key string, repaired_sha256 string")


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, text, edit of every turn of the repaired conversations.

    ``edit`` is K, R or I (an inserted turn has an empty text and no turn). Positions begin at 0.
    See ``report`` for what is repaired and how.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "position", "turn", "role", "text", "edit")
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        made, size = [], 0
        for key, lines in groupby(_lines(batches), key=lambda r: r[0]):
            for position, (_, turn, role, text, edit) in enumerate(lines):
                made.append((key, position, turn, role, text, edit))
                size += 64 + len(text)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names)
                    made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names)

    rows = _numbered(turns)
    schema = "key string, position long, turn long, role string, text string, edit string"
    made = _in_order(rows, _solved(rows)).mapInArrow(run, schema)
    kind = turns.schema["conv_id"].dataType.simpleString()
    conv_id = F.when(F.col("key") != "n", F.substr("key", F.lit(2))).cast(kind)
    return made.select(conv_id.alias("conv_id"), "position", "turn", "role", "text", "edit")


def report(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """What is wrong with each of ``conversations`` (conv_id) by its ``turns``, and its cheapest repair.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Turns
    are taken in the order of ``turn`` (nulls first; equal ones by role, then text). The edits are
    Keep, Rerole, Delete and Insert at the costs above; they leave role initials ``(s?(ua)+)?``. Of
    equally cheap ones those with the ASCII-least initials are taken, which also fixes all roles.

    Rows by states form a lattice of whole costs, solved by Bertsekas' auction algorithm: prices rise
    and a path is extended and contracted until they are exact, then the tight arcs are traced.
    Turns are numbered by a range partitioning and solved in blocks of ``BLOCK`` rows. A
    conversation that lies in several is solved piece by piece: a piece counts in the chain by its 16
    crossing costs, and by one path from each of four states. Texts are not in these steps; they move
    once to be numbered and once to be hashed, where a conversation streams through a task in order,
    as its one SHA-256 asks for, and is never held.

    A null role or text is one space, a null turn comes first and counts for no gap (the difference of
    turns beyond a long is null). Rows without conv_id are one conversation. A conversation without
    turns has zeros, an empty audit and the hash of an empty string; one that is all deleted too, but
    for its cost and audit. Repeated rows are duplicates. Extra columns are ignored.
    """
    rows = _numbered(turns)
    solved = written(_solved(rows), "turns-solved")
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    # A piece's steps are one letter a row; a conversation's audit is one value by its definition.
    parts = F.sort_array(F.collect_list(F.struct("block", "steps")))
    steps = F.array_join(F.transform(parts, lambda p: p["steps"]), "")
    totals = solved.groupBy("key").agg(*[F.sum(c).alias(c) for c in counts], audit(steps).alias("audit"))
    turn = rows.where("turn is not null").groupBy("key", "turn").agg(F.lit(1).alias("one"))
    span = F.try_subtract(F.max("turn"), F.min("turn"))
    gaps = turn.groupBy("key").agg(F.try_add(span, 1 - F.count(F.lit(1))).alias("gaps"), F.lit(True).alias("any"))
    named = conversations.select("conv_id", _key().alias("key")).distinct()
    found = named.join(totals, "key", "left").join(gaps, "key", "left").join(_hashes(rows, solved), "key", "left")
    zero = F.lit(0).cast("long")
    return found.select(
        "conv_id",
        F.when(F.col("any"), F.col("gaps")).otherwise(zero).alias("gaps"),
        *[F.coalesce(c, zero).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
