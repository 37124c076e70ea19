"""Conversation structure repair: a Viterbi search over role states whose edits are emitted once all survivors share an ancestor."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States: nothing yet, after the system's turn, after the user's, after the assistant's. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept turn leads by its role's initial, and the role that an edit may put in a state.
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
PUT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Cost at most of going on from the second state as from the first, with the same letters behind those that are put before them (second: None, where letters in between
#: are others; then only a greater cost counts). Whoever costs that much more than another can't win.
LIKE = {
    (SYSTEM, ASSISTANT): (0, True), (SYSTEM, START): (0, True), (SYSTEM, USER): (2, True), (ASSISTANT, START): (0, True), (ASSISTANT, USER): (2, True), (ASSISTANT, SYSTEM): (4, True),
    (USER, ASSISTANT): (2, True), (USER, START): (2, True), (USER, SYSTEM): (2, True), (START, ASSISTANT): (3, False), (START, USER): (5, False), (START, SYSTEM): (4, False),
}
ILLEGAL_NOT = {("s", "u"), ("u", "a"), ("a", "u")}
WHITE = " \t\n\x0b\x0c\r"


@cache
def moves(state: int, initial: str, forced: bool, truncated: bool) -> list[tuple[int, int, str, int | None]]:
    """(target, cost, letters, role put) of the ways over one turn: up to two inserted turns, then the turn kept, put to another role or deleted."""
    out, at, letters, cost = [], state, "", 0
    for _ in range(3):
        out.append((at, cost + DELETE, letters + "D", None))
        if not forced:
            if (at, initial) in KEEP:
                out.append((KEEP[at, initial], cost + truncated * TRUNCATED, letters + "K", None))
            out.append((PUT[at], cost + REROLE + truncated * TRUNCATED, letters + "R", PUT[at]))
        at, letters, cost = PUT[at], letters + "I", cost + INSERT
    return out


class Node:
    """A turn's edits on a survivor's path; below: the nodes that go on from here, which are its references."""

    __slots__ = ("above", "below", "state", "letters", "turn")

    def __init__(self, above: Node | None, state: int, letters: str, turn: tuple | None):
        self.above, self.state, self.letters, self.turn, self.below = above, state, letters, turn, set()


class Repair:
    """The cheapest edits of one conversation, of equal ones those whose letters are ASCII-least.

    Of each state the best path so far survives. Each stands at the end of a turn, so no survivor's letters begin another's, and their order is kept as a rank: two ties
    that go on from different survivors compare by it, which is to compare their whole unresolved suffixes, and two that go on from one compare by what they add.
    A survivor that can't win any more goes (LIKE). Paths are a tree of back pointers; a node that nothing goes on from is dropped, and when the root has one successor
    only, all survivors share it: it becomes the root and its edits are emitted. So what is held is the part of the conversation that is still open: a few turns, but
    all of one in which two different ways stay equally cheap to the end, as where only users speak and the number of turns decides.
    """

    def __init__(self, emit: Callable[[str, str | None, tuple | None], None]):
        self.emit, self.root = emit, Node(None, START, "", None)
        self.alive: dict[int, tuple[int, int, Node]] = {START: (0, 0, self.root)}

    def push(self, initial: str, forced: bool, truncated: bool, turn: tuple) -> None:
        best: dict[int, tuple] = {}
        for state, (cost, rank, node) in self.alive.items():
            for target, more, letters, _ in moves(state, initial, forced, truncated):
                one = (cost + more, rank, letters, state)
                if target not in best or one < best[target]:
                    best[target] = one
        place = {target: k for k, target in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        keep = {}
        for target, (cost, *_) in best.items():
            for other, (its, *_) in best.items():
                if other != target:
                    more, same = LIKE[target, other]
                    if its + more < cost or same and its + more == cost and place[other] < place[target]:
                        break
            else:
                keep[target] = cost
        was, self.alive = self.alive, {}
        for target, cost in keep.items():
            _, _, letters, state = best[target]
            above = was[state][2]
            node = Node(above, target, letters, turn)
            above.below.add(node)
            self.alive[target] = (cost, place[target], node)
        for _, _, node in was.values():
            self._drop(node)
        self._settle()

    def _drop(self, node: Node) -> None:
        while not node.below and node.above is not None and node is not self.root:
            above, node.above = node.above, None
            above.below.discard(node)
            node = above

    def _settle(self) -> None:
        while len(self.root.below) == 1:
            (node,) = self.root.below
            self._tell(self.root.state, node.letters, node.turn)
            node.above, self.root = None, node

    def _tell(self, state: int, letters: str, turn: tuple | None) -> None:
        for x in letters:
            if x == "I" or x == "R":
                state = PUT[state]
                self.emit(x, ROLES[state], turn if x == "R" else None)
            else:
                self.emit(x, None, turn)
                if x == "K":
                    state = KEEP[state, turn[0][:1]]

    def finish(self) -> int:
        """Emit the rest; the cost."""
        ends = []
        for state, (cost, rank, _) in self.alive.items():
            at, letters = state, ""
            while at not in (START, ASSISTANT):
                at, letters = PUT[at], letters + "I"
            ends.append((cost + INSERT * len(letters), rank, letters, state))
        cost, _, letters, state = min(ends)
        path, node = [], self.alive[state][2]
        while node is not self.root:
            path.append(node)
            node = node.above
        for n in reversed(path):
            self._tell(n.above.state, n.letters, n.turn)
        self._tell(state, letters, None)
        return cost


# ---------------------------------------------------------------- over a table


def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, n, role, text, alive): turns as they come out of a fixed damage, by crc32 of `id:turn` modulo 20. 0 drops the turn (alive is false: the row only tells that
    there is a conversation), 1 empties its text, 2 removes . ! ? from it, 3 repeats it, 4 makes it the user's. A null role or text, and a null in the key, is one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = conversations.select(F.col(id_col).alias("c"), F.col(turn_col).alias("n"), space(role_col).alias("role"), space(text_col).alias("text"), (F.crc32(F.concat(space(id_col), F.lit(":"), space(turn_col)).cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    d = d.select("c", "n", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") != 0).alias("alive"), "k")
    return d.select("c", "n", "role", "text", "alive", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy_")).drop("copy_")


def faults(turns: DataFrame) -> DataFrame:
    """turns (c, n, role, text, alive) by conversation and in its order, with the first fault of each: 1 blank, 2 duplicate, 3 truncated, else 0.

    The order is by n (nulls first), then role and text by code point; equal turns stand beside each other. One shuffle, by conversation; that a turn was there before
    is a row number in its own partition, sorted by spilling, and not a set in memory.
    """
    before = F.row_number().over(Window.partitionBy("c", "alive", "role", "text").orderBy("n")) > 1
    last: Column = F.substring(F.expr(f"trim(TRAILING '{WHITE.encode('unicode_escape').decode()}' FROM text)"), -1, 1)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 1).when(before, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    return turns.repartition("c").withColumn("fault", fault).sortWithinPartitions("c", "n", "role", "text", F.col("fault") == 2)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(c, n, role, text, alive, fault) of a stream of batches, one turn at a time."""
    for b in batches:
        yield from zip(*[b.column(k).to_pylist() for k in ("c", "n", "role", "text", "alive", "fault")], strict=True)


def _walk(batches: Iterator[pa.RecordBatch], begin: Callable, row: Callable, end: Callable) -> Iterator:
    """Calls by conversation; what row and end yield goes on."""
    now = state = None
    for c, *turn in _conversations(batches):
        if state is None or c != now:
            if state is not None:
                yield from end(now, state)
            now, state = c, begin()
        yield from row(now, state, *turn)
    if state is not None:
        yield from end(now, state)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield flush()
            held = []
    if held:
        yield flush()


def _arrow(turns: DataFrame, fields: str) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType().add("conv_id", turns.schema["c"].dataType)
    for f in fields.split(", "):
        schema.add(*f.split(" "))
    return schema, to_arrow_schema(schema)


def repaired(turns: DataFrame) -> DataFrame:
    """The edits themselves: (conv_id, place, edit, role, text) in order, place 0, 1, ...; edit K, R, D or I; role and text of the repaired turn (of a deleted one: what it had).

    turns as damage() gives them. Rows leave while a conversation is still read. Cases as in summary().
    """
    schema, arrow = _arrow(turns, "place long, edit string, role string, text string")

    def run(batches):
        def begin():
            out: list = []
            return {"out": out, "n": 0, "repair": Repair(lambda edit, role, turn: out.append((edit, role or turn[0], turn[1] if turn else "")))}

        def flush(c, s):
            for edit, role, text in s["out"]:
                yield c, s["n"], edit, role, text
                s["n"] += 1
            s["out"].clear()

        def row(c, s, n, role, text, alive, fault):
            if alive:
                s["repair"].push(role[:1], fault in (1, 2), fault == 3, (role, text))
            return flush(c, s)

        def end(c, s):
            s["repair"].finish()
            return flush(c, s)

        return _batches(_walk(batches, begin, row, end), arrow)

    return faults(turns).mapInArrow(run, schema)


def summary(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    turns as damage() gives them. A turn's first fault counts. gaps: turn numbers missing between the least and the greatest. illegal: neighbours whose roles' initials
    aren't su, ua or au. cost and audit: the cheapest edits (Keep 0, Rerole to user or assistant 2, Delete 3, which blank and duplicate turns need, Insert an empty turn of user
    or assistant 2, and 1 for a truncated turn that stays) that give role initials (s?(ua)+)?, and their initials; of equal costs the ASCII-least. repaired_sha256 is of
    `role:text` of the repaired turns, joined by newlines, and grows with the edits that are emitted.

    Null ids are one conversation; null turn numbers come first and don't count for gaps; turns with one number are in order of role and text; repeated rows are duplicates.
    A conversation whose turns are all dropped: zeros, empty audit, the hash of the empty string. Texts of any length are held while they are open only. Empty table: no
    rows. Other columns aren't read. A conversation is one task's stream: it isn't collected, but the value of its audit has a letter for each edit.
    """
    schema, arrow = _arrow(turns, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")

    def run(batches):
        def begin():
            s = {"counts": [0, 0, 0, 0], "illegal": 0, "last": None, "least": None, "most": None, "numbers": 0, "audit": [], "done": io.StringIO(), "hash": hashlib.sha256(), "any": False}

            def emit(edit, role, turn):
                s["audit"].append(edit)
                if edit != "D":
                    text = turn[1] if turn else ""
                    s["hash"].update(("\n" * s["any"] + f"{role or turn[0]}:{text}").encode("utf-8", "surrogatepass"))
                    s["any"] = True

            s["repair"] = Repair(emit)
            return s

        def row(c, s, n, role, text, alive, fault):
            if alive:
                s["counts"][fault] += 1
                if n is not None and (s["most"] is None or n != s["most"]):
                    s["least"], s["most"], s["numbers"] = n if s["least"] is None else s["least"], n, s["numbers"] + 1
                s["illegal"] += s["last"] is not None and (s["last"], role[:1]) not in ILLEGAL_NOT
                s["last"] = role[:1]
                s["repair"].push(role[:1], fault in (1, 2), fault == 3, (role, text))
                if len(s["audit"]) > 4096:  # a list's entry takes more room than a letter
                    s["done"].write("".join(s["audit"]))
                    s["audit"].clear()
            return ()

        def end(c, s):
            cost = s["repair"].finish()
            gaps = 0 if s["most"] is None else min(s["most"] - s["least"] + 1 - s["numbers"], 2**63 - 1)
            yield c, int(gaps), *s["counts"][1:], int(s["illegal"]), cost, s["done"].getvalue() + "".join(s["audit"]), s["hash"].hexdigest()

        return _batches(_walk(batches, begin, row, end), arrow)

    return faults(turns).mapInArrow(run, schema)
