"""Exact dedup, mixing and chat formatting: against SQL twins, and cases the tables lack."""

import hashlib

import pytest
from compare import assert_same, oracle_connection
from awkward import AWKWARD
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from clickloom.llm import chat, exact_dedup, mixing, simhash
from clickloom.llm.queries import LLM_ORACLE, LLM_QUERIES
from clickloom.sources.scratch import fresh_folder

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_same_rows_as_sql(spark, name):
    assert_same(LLM_QUERIES[name](spark, SF_DIR), oracle_connection(SF_DIR), LLM_ORACLE[name])


def test_index_goes_on_with_new_batches(spark):
    folder = fresh_folder(spark, "t")

    def batch(*rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        return docs.select("doc_id", exact_dedup.digest(docs.text).alias("digest"))

    exact_dedup.DigestIndex(spark, folder, 4).append(batch((1, "a"), (5, "a"), (2, "b")))
    index = exact_dedup.DigestIndex(spark, folder, 4)
    index.append(batch((9, "a"), (3, "c"), (4, None), (6, "")))
    rows = {bytes(r.digest): r.keep_id for r in index.read().collect()}
    assert rows == {hashlib.sha256(t).digest(): k for t, k in ((b"a", 5), (b"b", 2), (b"c", 3), (b"", 6))}
    plan = index.unseen(batch((1, "a")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_exact_dedup_of_awkward_rows(awkward, nothing):
    rows = exact_dedup.verdicts(awkward).collect()
    assert len(rows) == len(AWKWARD)
    texts = {}
    for doc_id, text, *_ in AWKWARD:
        texts.setdefault(hashlib.sha256((text or "").encode()).digest(), []).append(doc_id)
    for r in rows:
        ids = texts[bytes(r.digest)]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in rows) == len(texts)
    kept = exact_dedup.deduplicate(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str((r.doc_id, (r.text or "")[:9])) for r in kept.collect()) == sorted(
        str((max((i for i in texts[d] if i is not None), default=None), t[:9]))
        for d, t in {hashlib.sha256((t or "").encode()).digest(): t or "" for _, t, *_ in AWKWARD}.items()
    )
    assert exact_dedup.verdicts(nothing).count() == exact_dedup.deduplicate(nothing).count() == 0


def test_mix_of_awkward_rows(awkward, nothing):
    plan = {(r.doc_id, r.size): r for r in mixing.plan_mix(awkward).collect()}
    assert len(plan) == len({(r[0], len((r[1] or "").split())) for r in AWKWARD})
    assert all(r.taken <= 2 * r.size for r in plan.values())
    assert mixing.mix(awkward).columns == awkward.columns
    assert mixing.plan_mix(nothing).count() == mixing.mix(nothing).count() == 0


def test_mix_hits_targets_and_agrees_with_itself(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "'a b c' AS text")
    plan = mixing.plan_mix(docs)
    by_source = plan.groupBy("target", "source_size").agg({"taken": "sum", "size": "sum"}).collect()
    assert sum(r["target"] for r in by_source) == pytest.approx(90_000, rel=1e-9)
    for r in by_source:
        assert r["target"] <= 2 * r["source_size"]
        assert r["sum(taken)"] == pytest.approx(r["target"], rel=0.05)
    copies = {r.doc_id: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
    assert copies == {r.doc_id: r.copies for r in plan.collect() if r.copies}


ODD = st.sampled_from(["<|im_end|>", "<|im_start|>", "<\\|", "<|", "\\", "|", "<", ">", "\n", "%0A", "%25", "x", "é"])
TURN = st.tuples(st.lists(ODD, max_size=3).map("".join), st.lists(ODD, max_size=6).map("".join))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(TURN, min_size=1, max_size=4), min_size=1, max_size=30))
def test_chat_round_trip(spark, conversations):
    rows = [(c, t, role, text) for c, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    done = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    spans = done.withColumn("spans", chat.loss_spans(done.formatted, ("x",)))
    for r in spans.collect():
        assert [(t.role, t.text) for t in r.turns] == conversations[r.conv_id]
        assert r.formatted.count(chat.START) == r.formatted.count(chat.CLOSE) == len(r.turns)
        masked = [r.formatted[s.start:s.end].replace("<\\|", "<|") for s in r.spans]
        wanted = [t.text for t in r.turns if t.role == "x"]
        assert len(masked) == len(wanted)
        if not any("\\" in t for t in wanted):
            assert masked == wanted


def test_chat_of_awkward_rows(spark):
    rows = [
        (1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "user", "a"), (None, 0, "assistant", ""),
        (2, 0, "assistant", "x" * 300_000),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS turns", "2 AS formatted", "3 AS source", "4 AS plain"
    )
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.format_conversations(frame).collect()}
    assert got == {
        1: [("", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("assistant", "")],
        2: [("assistant", "x" * 300_000)],
    }
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_index_keeps_its_number_of_buckets(spark):
    folder = fresh_folder(spark, "t")
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    rows = docs.select("doc_id", exact_dedup.digest(docs.text).alias("digest"))
    exact_dedup.DigestIndex(spark, folder, 4).append(rows)
    with pytest.raises(ValueError, match="4 buckets"):
        exact_dedup.DigestIndex(spark, folder, 8)
    again = exact_dedup.DigestIndex(spark, folder)
    assert again.unseen(rows).count() == 0
    again.append(rows)
    assert again.read().count() == 200
    again.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(again._table)]


def test_index_of_many_buckets(spark):
    docs = spark.range(3_000).selectExpr("id AS doc_id", "concat('text ', id % 1000) AS text")
    index = exact_dedup.DigestIndex(spark, fresh_folder(spark, "t"), 1024)
    judged = exact_dedup.verdicts(docs, index)
    assert judged.where("kept").count() == 1000 and judged.where("kept AND doc_id < 2000").count() == 0


NESTED = {
    "m": "map('b', 2, 'a', doc_id)", "am": "array(map(1, text))", "sm": "struct(map('k', map('i', 1)) AS deep)",
    "mm": "map('a', map('b', 1))", "a": "array(1, 2)", "s": "struct(1 AS x)", "n": "null",
}


@pytest.mark.parametrize("keep", [exact_dedup.deduplicate, simhash.representatives])
def test_extra_columns_of_any_type(documents, keep):
    rows = [(1, "same words here"), (1, "same words here"), (2, "same words here"), (3, "quite another text of some words")]
    frame = documents(rows)
    for name, sql in NESTED.items():
        frame = frame.selectExpr("*", f"{sql} AS {name}")
    kept = keep(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == ([2, 3] if keep is exact_dedup.deduplicate else [1, 3])
