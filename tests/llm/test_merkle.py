"""Merkle manifest: against a plain tree, tampering, positions in groups that span tasks."""

import hashlib

import pytest
from awkward import AWKWARD
from pyspark.sql import functions as F

from clickloom.llm import merkle
from clickloom.llm.ranks import ranked


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    fields = (doc_id, source, lang, n_chars, text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def nulls_first(value):
    return (value is not None, value if value is not None else 0)


def tree(digests, arity):
    """The root, and for each leaf its path of (before, after)."""
    paths = [[] for _ in digests]
    spans = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        up, above = [], []
        for at in range(0, len(digests), arity):
            run = digests[at:at + arity]
            for slot, leaves in enumerate(spans[at:at + arity]):
                for i in leaves:
                    paths[i].append(("".join(run[:slot]), "".join(run[slot + 1:])))
            up.append(h("".join(run)))
            above.append(sum(spans[at:at + arity], []))
        digests, spans = up, above
    return digests[0], paths


def brute_force(rows, arity, add=lambda doc_id: 0):
    trees, out = {}, []
    for doc_id, text, lang, source in rows:
        trees.setdefault(lang, []).append((nulls_first(doc_id), leaf(doc_id, text, lang, source, 1), (doc_id, text, lang, source)))
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    built = {}
    for lang in order:
        trees[lang].sort(key=lambda x: x[:2])
        built[lang] = tree([x[1] for x in trees[lang]], arity)
    root, heads = tree([built[lang][0] for lang in order], arity)
    for lang, head in zip(order, heads):
        for (_, digest, row), path in zip(trees[lang], built[lang][1]):
            at = leaf(*row, 1 + add(row[0]))
            for before, after in path + head:
                at = h(before + at + after)
            proof = h("".join(b + a for b, a in path + head))
            out.append((row[0], digest, built[lang][0], root, proof, at, at == root))
    return sorted(out, key=str)


def spark_result(frame, arity=2, **settings):
    done = merkle.manifest(frame, arity, **settings).select(
        "doc_id", *[merkle.spelled(F.col(c)) for c in ("leaf", "subroot", "root")],
        F.sha2(merkle.proof_text(F.col("path")), 256), "folded_root", "verified",
    )
    return sorted((tuple(r) for r in done.collect()), key=str)


MORE = [(100 + i, f"text {i}", ("en", "é", "Z", None)[i % 4] if i % 9 else "en", "s") for i in range(23)] + [(200, "alone", "zz", "s")]


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_same_as_a_plain_tree(documents, arity):
    rows = [r if len(r) == 4 else (*r, "en", "s") for r in AWKWARD + MORE]
    got = spark_result(documents(rows).repartition(4), arity)
    assert got == brute_force(rows, arity)
    assert all(r[-1] for r in got)


def test_one_document_and_none(documents, nothing):
    assert spark_result(documents([(1, "only")])) == brute_force([(1, "only", "en", "s")], 2)
    assert spark_result(nothing) == []


def test_changed_documents_are_found(documents):
    altered = {"n_chars": F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = spark_result(documents(MORE), altered=altered)
    assert got == brute_force(MORE, 2, lambda doc_id: doc_id % 5 == 0)
    assert {r[0] for r in got if not r[-1]} == {r[0] for r in MORE if r[0] % 5 == 0}
    swapped = spark_result(documents(MORE), altered={"text": F.lit("text 3")})
    assert [r[0] for r in swapped if r[-1]] == [103]


def test_a_run_must_have_room():
    with pytest.raises(ValueError):
        merkle.manifest(None, arity=1)


def test_places_in_a_group_over_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(0, 3_000, 1, 5).selectExpr(
            "if(id % 10 = 0, cast(null as string), if(id % 3 = 0, 'b', 'a')) AS g", "id * 7919 % 1000 AS v"
        )
        placed = ranked(rows, ["g"], ["v"], "t")
        parts = sum("t-placed" in file for file in placed.inputFiles())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts >= 4
    groups = {}
    for r in placed.collect():
        groups.setdefault(r.g, []).append((r.idx, r.v, r.n))
    assert set(groups) == {None, "a", "b"}
    for found in groups.values():
        found.sort()
        assert [f[0] for f in found] == list(range(len(found))) and {f[2] for f in found} == {len(found)}
        assert [f[1] for f in found] == sorted(f[1] for f in found)
