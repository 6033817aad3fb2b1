"""Conversation repair: the search against every possible edit and against a plain table, and awkward rows."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from clickloom.llm import repair
from clickloom.llm.queries import op11_conversation_repair

LETTERS = repair.SOUND + repair.CUT + repair.DOOMED


def outcome(letters, audit):
    """The cost of an audit, None if it does not apply or repairs nothing; roles are free to choose for R and I."""
    row, cost, options = 0, 0, [""]
    for edit in audit:
        if edit == "I":
            cost += 3
            options = [o + r for o in options for r in "ua"]
            continue
        if row == len(letters):
            return None
        letter, row = letters[row], row + 1
        kind, cut, doomed = letter.lower(), letter in "SUAO", letter in "1234"
        if edit == "D":
            cost += 4
            continue
        if doomed:
            return None
        cost += 3 * cut + 3 * (edit == "R")
        options = [o + r for o in options for r in ("ua" if edit == "R" else kind)]
    sound = any(o == "" or (o[1:] if o[0] == "s" else o) == "ua" * (len(o) // 2) != "" for o in options)
    return cost if row == len(letters) and sound else None


def every_edit(letters):
    found = []
    for n in range(len(letters) + 4):
        for audit in itertools.product("DIKR", repeat=n):
            if (cost := outcome(letters, audit)) is not None:
                found.append((cost, "".join(audit)))
    return min(found)


def plain_table(letters):
    """(cost, audit) by a table over rows and states, whole audits in it."""
    state_of = {"": "", "s": "s", "u": "u", "a": "a"}
    ways = {"": (0, "")}
    after = {"": "u", "s": "u", "a": "u", "u": "a"}

    def inserted(ways):
        for _ in range(2):
            for state, (cost, audit) in list(ways.items()):
                new = (cost + 3, audit + "I")
                ways[after[state]] = min(ways.get(after[state], new), new)
        return ways

    for letter in letters:
        then = {}
        kind, cut, doomed = letter.lower(), letter in "SUAO", letter in "1234"
        for state, (cost, audit) in inserted(ways).items():
            steps = [("D", 4, state)]
            if not doomed:
                if kind == after[state] or kind == "s" and state == "":
                    steps.append(("K", 3 * cut, state_of[kind]))
                steps.append(("R", 3 + 3 * cut, after[state]))
            for edit, price, to in steps:
                new = (cost + price, audit + edit)
                then[to] = min(then.get(to, new), new)
        ways = then
    ways = inserted(ways)
    return min(ways[s] for s in ("", "a") if s in ways)


@pytest.mark.parametrize("size", [0, 1, 2, 3])
def test_the_table_is_right(size):
    rng = random.Random(size)
    for letters in itertools.product(LETTERS, repeat=size) if size < 2 else [rng.choices(LETTERS, k=size) for _ in range(15)]:
        assert plain_table(letters) == every_edit("".join(letters))


@pytest.mark.parametrize("window", [1, 2, 7, 64])
def test_search_gives_the_least_cost_and_audit(window):
    rng = random.Random(window)
    for _ in range(600):
        weights = [rng.random() ** 3 for _ in LETTERS]
        letters = "".join(rng.choices(LETTERS, weights, k=rng.randrange(40)))
        got = repair.cheapest_edits(letters, window)
        assert got == plain_table(letters), letters
        assert outcome(letters, got[1]) == got[0] if len(letters) < 12 else True


def test_bounds_never_exceed_what_rows_cost():
    rng = random.Random(5)
    for _ in range(300):
        letters = "".join(rng.choices(LETTERS, k=rng.randrange(1, 12)))
        assert repair.suffix_bounds(letters)[0] <= plain_table(letters)[0]


@pytest.mark.parametrize("pattern", ["ua", "uu", "sUo1a", "o", "1", "sssuA", "UA"])
def test_very_long_conversations(pattern):
    letters = pattern * (6_000 // len(pattern))
    assert repair.cheapest_edits(letters) == plain_table(letters)


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (1, 3, "assistant", "Hello."),
    (2, 5, "user", "one"), (2, 5, "user", "one"), (2, None, "assistant", "first."), (2, 9, None, None), (2, 6, "tool", "x?"),
    (3, None, None, None), (None, 1, "user", "no id."), (None, 2, "user", " \t\r\n"), (None, 4, "", "Role.\x0b"),
    (4, -3, "assistant", "Ends so。"), (4, 7, "umpire", "u it is!"), (4, 7, "assistant", "é."), (4, 8, "Assistant", "big."),
    (5, 1, "user", "a:b\nc."), (5, 2, "assistant", " " * 9 + "."), (6, 1, "user", "word " * 50_000 + "."),
]


def brute_force(rows):
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        own = sorted(
            ((t is not None, t or 0, " " if r is None else r, " " if x is None else x, t) for c, t, r, x in rows if c == conv)
        )
        seen, letters = set(), ""
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text, _ in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kind = "sua".find(role[:1]) if role else 3
            letters += {"": "suao", "truncated": "SUAO"}.get(fault, "1234")[kind]
        turns = {o[4] for o in own if o[4] is not None}
        initials = [o[2][:1] for o in own]
        cost, audit = plain_table(letters)
        made, row = [], 0
        for edit in audit:
            if edit == "K":
                made.append(own[row][2:4])
            elif edit in "RI":
                made.append(("assistant" if made and made[-1][0][:1] == "u" else "user", "" if edit == "I" else own[row][3]))
            row += edit != "I"
        whole = "\n".join(f"{r}:{t}" for r, t in made)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256(whole.encode()).hexdigest(),
        )
    return out


def found(frame):
    lines = F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["text"]))
    done = repair.repair(frame).withColumn("turns", F.sha2(F.array_join(lines, "\n"), 256))
    return {r[0]: tuple(r)[1:] for r in done.collect()}


@pytest.fixture(scope="module")
def conversations(spark):
    def make(rows):
        frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        for name in ("fault", "letter", "source", "cost", "known"):
            frame = frame.selectExpr("*", f"map('a', 1) AS {name}")
        return frame

    return make


def test_awkward_rows(conversations):
    assert found(conversations(ROWS).repartition(3)) == brute_force(ROWS)
    assert found(conversations([])) == {}


def test_damage_and_digest(spark, conversations, tmp_path):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Turn {t}. It says {c % 3}!") for c in range(40) for t in range(8)]
    rows += [(c, 0, "user", "all of it is lost.") for c in range(1000, 1060)] + ROWS
    conversations(rows).drop("fault", "letter", "source", "cost", "known").write.parquet(str(tmp_path / "conversations.parquet"))
    harmed = []
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code:
            text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
            harmed += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    wanted = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv in {r[0] for r in rows}}
    assert len(wanted) > len(brute_force(harmed))
    wanted |= brute_force(harmed)
    got = op11_conversation_repair(spark, str(tmp_path)).collect()
    assert len(got) == len(wanted) and {r[0]: tuple(r)[1:] for r in got} == wanted
