"""Repair of conversations that lost their alternation, by branch and bound over edits.

A sound conversation is an optional system row, then user and assistant rows
in turn, the assistant last. Rows can be kept, given another role or deleted,
and empty rows inserted, each at a price. The edits of least cost are searched
for depth first with an explicit stack; a conversation enters the search as
one letter per row, and equal letters are searched once in a task. Texts never
leave the JVM.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.llm.common import pick

DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
PRICE = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
# More for a truncated row that stays.
TRUNCATED_PRICE = 3

# What the conversation has come to: nothing yet, a system row, a user row, an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
# The role that may come next besides a first system row, and what it costs to end here.
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_TO_END = {NOTHING: 0, SYSTEM: 2 * PRICE[INSERT], USER: PRICE[INSERT], ASSISTANT: 0}
_ROLE = {USER: "user", ASSISTANT: "assistant"}

# Letters of rows by initial of the role (s, u, a, any other): sound, truncated, and to be deleted.
SOUND, CUT, DOOMED = "suao", "SUAO", "1234"
_KIND = {letter: (kind, fault) for fault, letters in enumerate((SOUND, CUT, DOOMED)) for kind, letter in enumerate(letters)}
_LEGAL = {(0, 1), (1, 2), (2, 1)}

# Rows searched at a time. At the border the best way to each state is kept.
WINDOW = 64
# From any state any other way of going on can be had for this much more at most.
_SLACK = PRICE[DELETE] + PRICE[INSERT]
_RUN = 3


@lru_cache(maxsize=None)
def moves(letter: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(edit, cost, next state) of what can be done with a row, in the order of edits."""
    kind, fault = _KIND[letter]
    out = [(DELETE, PRICE[DELETE], state)]
    if fault != 2:
        more = TRUNCATED_PRICE if fault == 1 else 0
        fits = kind == 0 and state == NOTHING or kind == _NEXT[state] - 1
        if fits:
            out.append((KEEP, PRICE[KEEP] + more, SYSTEM if kind == 0 else _NEXT[state]))
        if not fits or kind == 0:
            out.append((REROLE, PRICE[REROLE] + more, _NEXT[state]))
    return tuple(out)


@lru_cache(maxsize=1 << 16)
def _run_bound(letters: str) -> int:
    """The least cost of these rows, whatever came before and comes after."""
    costs = dict.fromkeys(_NEXT, 0)
    for letter in letters:
        for _ in range(2):
            for state, after in _NEXT.items():
                costs[after] = min(costs[after], costs[state] + PRICE[INSERT])
        after_row: dict[int, int] = {}
        for state, cost in costs.items():
            for _, price, then in moves(letter, state):
                after_row[then] = min(after_row.get(then, cost + price), cost + price)
        costs = {state: after_row.get(state, min(after_row.values()) + _SLACK) for state in _NEXT}
    return min(costs.values())


def suffix_bounds(letters: str) -> list[int]:
    """For each place a lower bound of what the rows from there cost: the dearest cover by short runs."""
    bounds = [0] * (len(letters) + 1)
    for at in range(len(letters) - 1, -1, -1):
        bounds[at] = max(
            _run_bound(letters[at:at + size]) + bounds[at + size] for size in range(1, min(_RUN, len(letters) - at) + 1)
        )
    return bounds


def _dive(letters: str, state: int, last: bool) -> int:
    """The cost of taking the cheapest way at each row, after up to two insertions."""
    total = 0
    for letter in letters:
        ways, here = [], state
        for inserted in range(3):
            ways += [(price + inserted * PRICE[INSERT], then) for _, price, then in moves(letter, here)]
            here = _NEXT[here]
        price, state = min(ways)
        total += price
    return total + (_TO_END[state] if last else 0)


def _search(letters: str, entries: list[tuple], last: bool) -> list[tuple]:
    """Best ways on through a window: entries and exits are (state, cost, trail so far), least audit first.

    Edits are tried in the order of their letters, so ways come up in the order
    of their audits: of two ways to a node at the same cost the first is the
    better, and a node's later ways must be cheaper. A way ends where its cost
    and the bound of the rows to come exceed the incumbent. Within the last
    window the incumbent is a whole repair. Before it, a way may be dearer than
    the best exit by what it costs to change from one state to another.
    """
    bounds, size = suffix_bounds(letters), len(letters)
    limit = min(cost + _dive(letters, state, last) for state, cost, _ in entries) + (0 if last else _SLACK)
    # The cheapest way to each node (place, state) so far: a dearer prefix cannot win.
    table: dict[tuple[int, int], int] = {}
    exits: dict[int, tuple] = {}
    trail: list[str] = []
    stack = [(0, state, cost, number, 0, "") for number, (state, cost, _) in enumerate(entries)][::-1]
    while stack:
        at, state, cost, number, depth, edit = stack.pop()
        if cost + bounds[at] + (_TO_END[state] if last and at == size else 0) > limit:
            continue
        if not last and at == size:
            if state not in exits or cost < exits[state][0]:
                exits[state] = (cost, number, "".join(trail[:depth - 1]) + edit)
                limit = min(limit, cost + _SLACK)
            continue
        if table.get((at, state), cost + 1) <= cost:
            continue
        table[at, state] = cost
        if depth:
            trail[depth - 1:] = [edit]
        if at == size and _TO_END[state] == 0:
            exits = {state: (cost, number, "".join(trail[:depth]))}
            # From here on only what is cheaper: what costs the same has a later audit.
            limit = cost - 1
            continue
        children = [(at, _NEXT[state], cost + PRICE[INSERT], number, depth + 1, INSERT)]
        if at < size:
            children += [(at + 1, then, cost + price, number, depth + 1, e) for e, price, then in moves(letters[at], state)]
        stack += sorted(children, key=lambda child: child[-1], reverse=True)
    ordered = sorted((number, piece, state, cost) for state, (cost, number, piece) in exits.items())
    return [(state, cost, (entries[number][2], piece)) for number, piece, state, cost in ordered]


def cheapest_edits(letters: str, window: int = WINDOW) -> tuple[int, str]:
    """(cost, audit): the least cost, and of the edits that have it those whose letters come first."""
    ways = [(NOTHING, 0, None)]
    for at in range(0, max(len(letters), 1), window):
        ways = _search(letters[at:at + window], ways, at + window >= len(letters))
    _, cost, trail = ways[0]
    pieces = []
    while trail is not None:
        trail, piece = trail
        pieces.append(piece)
    return cost, "".join(reversed(pieces))


def plan_of(letters: str, audit: str) -> list[tuple[int, str | None]]:
    """(row or -1 if inserted, role or None if kept) of each row of the repaired conversation."""
    out, state, row = [], NOTHING, 0
    for edit in audit:
        if edit == KEEP and _KIND[letters[row]][0] == 0:
            state = SYSTEM
            out.append((row, None))
        elif edit != DELETE:
            state = _NEXT[state]
            out.append((-1 if edit == INSERT else row, None if edit == KEEP else _ROLE[state]))
        row += edit != INSERT
    return out


def illegal_pairs(letters: str) -> int:
    kinds = [_KIND[letter][0] for letter in letters]
    return sum(pair not in _LEGAL for pair in zip(kinds, kinds[1:]))


_PLAN = "struct<cost:long,audit:string,illegal:long,plan:array<struct<row:int,role:string>>>"


def _solved(letters: pa.Array) -> pa.Array:
    known: dict[str, tuple] = {}
    out = []
    for text in letters.to_pylist():
        if text not in known:
            cost, audit = cheapest_edits(text)
            plan = [{"row": row, "role": role} for row, role in plan_of(text, audit)]
            known[text] = {"cost": cost, "audit": audit, "illegal": illegal_pairs(text), "plan": plan}
        out.append(known[text])
    plan = pa.list_(pa.struct([("row", pa.int32()), ("role", pa.string())]))
    return pa.array(out, pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("plan", plan)]))


_BLANKS = " \t\n\x0b\x0c\r"


def _fault(text: Column, number: Column) -> Column:
    """The first fault of a row: blank, duplicate, truncated, or none."""
    last = F.substring(F.rtrim(text, F.lit(_BLANKS)), -1, 1)
    return (
        F.when(F.btrim(text, F.lit(_BLANKS)) == "", "blank").when(number > 1, "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated")
    )


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns.

    Rows are taken by turn, null first, then role and text; null role and null
    text are one space; a null conv_id is a conversation of its own. A row is
    blank without any character but blanks, else a duplicate if role and text
    came up before, else truncated if its last character but blanks is no full
    stop, exclamation or question mark. ``gaps`` are turns missing between the
    least and the greatest, ``illegal`` neighbours whose roles' initials cannot
    follow each other. ``audit`` has a letter per edit: Keep, Rerole, Delete,
    Insert; ``turns`` is what the edits make of the rows, as an array of (role,
    text). A conversation is one row, so its texts must fit in a task. Extra
    columns are not read; without rows the result is empty.
    """
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    alike = W.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    # Dealt by conversation once: the window and the grouping both find its rows together.
    rows = rows.repartition("conv_id").withColumn("number", F.row_number().over(alike))
    rows = rows.withColumn("fault", _fault(F.col("text"), F.col("number")))
    rows = rows.withColumn("letter", _letter(F.col("role"), F.col("fault")))
    # False sorts before true, and so null turns before others; of equal rows the first is no duplicate.
    row = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text", "number", "letter")
    counts = [F.count_if(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("blank", "duplicate", "truncated")]
    gathered = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(row)).alias("source"), F.size(F.collect_set("turn")).alias("turns"),
        F.min("turn").alias("least"), F.max("turn").alias("most"), *counts,
    )
    letters = F.array_join(F.transform("source", lambda r: r["letter"]), "")
    solved = gathered.withColumn("solved", F.arrow_udf(_solved, _PLAN)(letters))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).cast("long")

    def made(step: Column) -> Column:
        own = F.get(F.col("source"), step["row"])
        return F.struct(
            F.coalesce(step["role"], own["role"]).alias("role"), F.coalesce(own["text"], F.lit("")).alias("text")
        )

    return solved.select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "solved.illegal", "solved.cost", "solved.audit",
        F.transform("solved.plan", made).alias("turns"),
    )


def _letter(role: Column, fault: Column) -> Column:
    kind = F.position(F.substring(role, 1, 1), F.lit(SOUND[:3]))
    kind = F.when((role == "") | (kind == 0), len(SOUND)).otherwise(kind)

    def of(letters: str) -> Column:
        return F.substring(F.lit(letters), kind, F.lit(1))

    return F.when(fault == "truncated", of(CUT)).when(fault.isNotNull(), of(DOOMED)).otherwise(of(SOUND))


def damage(conversations: DataFrame, modulus: int = 20) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults chosen by a checksum of conversation and turn.

    Of every ``modulus`` remainders, 0 drops the row, 1 empties its text, 2
    takes its full stops, exclamation and question marks, 3 repeats it, 4 makes
    it a user's. Null role and text become one space, as null ids do in the
    checksum.
    """
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    rows = rows.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        F.pmod(F.crc32(name), F.lit(modulus)).alias("code"),
    ).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", ""))
    times = F.when(F.col("code") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy"),
    ).drop("copy")
