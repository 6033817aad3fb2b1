"""Line dedup: against brute force, the hash itself, crowded shards."""

import hashlib

import numpy as np
import pytest
from awkward import AWKWARD
from pyspark.sql import functions as F

from clickloom.llm import line_dedup
from clickloom.llm.line_dedup import PerfectHash

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(BLANKS).translate(LOWER)


def brute_force(rows):
    """(doc_id, lines, dropped, kept) of each row, by the words of the docstring."""
    holders = {}
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            ids = holders[key(line)]
            owner = min((i for i in ids if i is not None), default=None)
            if len(key(line)) < 10 or len(ids) < 2 or doc_id == owner:
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def spark_result(frame, **settings):
    return sorted((tuple(r) for r in line_dedup.remove_repeated_lines(frame, **settings).collect()), key=str)


SHARED = [
    (21, "A shared line of text\nown line of twenty-one\n  a SHARED line of text\t\nshort"),
    (22, "a shared line of text\nshort\na shared line of text"), (20, "before it\nA Shared Line Of Text\r"),
    (23, "\n\n"), (24, "ten chars!\nnine char"), (25, "ten chars!\nnine char"), (26, "ÄÖÜ äöü éà"), (27, "äöü äöü éà"),
    (28, "日本語の共有された行です\n"), (29, " 日本語の共有された行です"), (None, "a shared line of text"), (None, "日本語の共有された行です"),
    (30, "only its own twice\nonly its own twice"), (31, "same id\nsame id again and"), (31, "same id again and\nonly null has"),
    (None, "only null has it here"), (None, "only null has it here"), (22, "a shared line of text\nshort\na shared line of text"),
]


@pytest.mark.parametrize("settings", [{}, {"shard_lines": 2, "shard_probes": 2}])
def test_same_as_brute_force(documents, settings):
    rows = AWKWARD + SHARED
    assert spark_result(documents(rows).repartition(3), **settings) == brute_force(rows)


def test_nothing(nothing):
    assert spark_result(nothing) == []


def test_other_types_of_id(spark):
    rows = [("b", "a line that two hold"), ("a", "A line that two hold\nx")]
    frame = spark.createDataFrame(rows, "doc_id string, text string").withColumn("m", F.expr("map('a', 1)"))
    assert spark_result(frame) == brute_force(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_slots_are_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    first = rng.integers(0, 1 << 64, n, np.uint64) // np.uint64(3) * np.uint64(3)
    second = np.arange(n, dtype=np.uint64)
    first[: n // 2] = 7  # equal first hashes, told apart by the second
    index = PerfectHash.build(first, second)
    assert sorted(index.slots(first, second)) == list(range(n))
    assert 8 * len(index.bits) <= 6 * n + 64
    again = PerfectHash(index.sizes, index.bits)
    foreign = again.slots(first + np.uint64(1), second)
    assert ((foreign >= -1) & (foreign < max(n, 1))).all()


def test_lines_that_no_document_held_are_unknown(documents):
    held = line_dedup.hashed_lines(line_dedup.keyed_rows(documents([(i, f"line number {i} held") for i in range(500)])))
    index, shards = line_dedup.build_index(held, 100)
    foreign = line_dedup.hashed_lines(line_dedup.keyed_rows(documents([(i, f"line number {i} not held") for i in range(500)])))
    assert shards == 5
    assert line_dedup.ask(foreign, index, shards).count() == 0
    assert line_dedup.ask(held, index, shards).where("documents = 1 AND owned").count() == 500


def test_askers_of_a_common_line_are_dealt_over_copies(documents):
    """A line in every document: no task gets more than a few times the lines of a copy."""
    frame = documents([(i, f"the common line of all\nown line number {i}") for i in range(2_000)])
    lines = line_dedup.hashed_lines(line_dedup.keyed_rows(frame))
    index, shards = line_dedup.build_index(lines, 1_000)
    groups = index.select(F.ceil(F.col("asked") / 100)).collect()
    assert shards == 3 and sum(r[0] for r in groups) >= 40
    answers = line_dedup.ask(lines, index, shards, 100)
    assert answers.where("documents = 2000").count() == 2_000 and answers.where("documents = 2000 AND owned").count() == 1


def test_kept_text_is_hashed_whole(spark):
    from clickloom.llm.queries import op13_line_dedup

    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op13_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got == {d: (n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in brute_force(docs)}
    assert any(m for _, m, _ in got.values())
