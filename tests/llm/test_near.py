"""SimHash and repeated passages against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from awkward import AWKWARD

from clickloom.llm import graph, repeated_phrases, simhash

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def some(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    return Counter(
        (doc_id, prints[i], min((d for d in least[find(i)] if d is not None), default=None))
        for i, (doc_id, _) in enumerate(rows)
    )


def found_components(docs, **settings):
    rows = simhash.near_duplicates(docs, **settings).collect()
    return Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in rows)


@pytest.mark.parametrize("crowded", [simhash.CROWDED, 1])
def test_components_equal_brute_force(spark, some, crowded):
    rows = [(r.doc_id, r.text) for r in some.limit(150).collect()]
    # Near copies: one word less at the end moves few bits.
    rows += [(1000 + d, " ".join(WORD.findall(t)[:-1])) for d, t in rows[:40]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = plain_components(rows)
    assert len({c for _, _, c in wanted}) < len(wanted)
    assert found_components(docs, crowded=crowded) == wanted


def test_dense_ball_of_fingerprints():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    values = np.unique([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3))) for _ in range(300)])
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    classes = np.arange(len(values))
    for _ in range(len(values)):
        classes = np.array([classes[near[i]].min() for i in range(len(values))])
    got = simhash.links_of(values, 2)
    assert len(set(zip(classes, got))) == len(set(classes)) == len(set(got))


def test_walsh_coordinates_tell_blocks_apart():
    table = simhash.distance_table(np.arange(1 << 16, dtype=np.uint64))[:, :16]
    assert len(np.unique(table, axis=0)) == 1 << 16


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.sql("SELECT 900L AS a, 900L AS b"))
    rows = graph.components(edges).collect()
    assert {(r.node, r.root) for r in rows} == {(i, 0) for i in range(301)} and len(rows) == 301


def test_simhash_of_awkward_rows(awkward, nothing):
    assert found_components(awkward) == plain_components([r[:2] for r in AWKWARD])
    kept = simhash.representatives(awkward)
    assert kept.columns == awkward.columns
    components = {(r.root, r.component_id) for r in simhash.near_duplicates(awkward).collect()}
    assert kept.count() == len(components)
    assert simhash.near_duplicates(nothing).count() == simhash.representatives(nothing).count() == 0


def plain_removal(rows, window):
    texts = [WORD.findall(text or "") for _, text in rows]
    counts = Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    out = Counter()
    for (doc_id, _), words in zip(rows, texts):
        gone = set()
        for i in range(len(words) - window + 1):
            if counts[tuple(words[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id, len(words), len(gone), kept] += 1
    return out


def found_removal(docs, **settings):
    return Counter(tuple(r) for r in repeated_phrases.remove_repeats(docs, **settings).collect())


@pytest.mark.parametrize("window,shingle,crowded", [(35, 8, 200_000), (35, 8, 1), (6, 3, 200_000), (4, 1, 2)])
def test_removal_equals_brute_force(some, window, shingle, crowded):
    rows = [(r.doc_id, r.text) for r in some.collect()]
    wanted = plain_removal(rows, window)
    assert sum(key[2] for key in wanted)
    assert found_removal(some, window=window, shingle=shingle, crowded=crowded) == wanted


def test_removal_within_one_text_and_of_awkward_rows(documents, awkward, nothing):
    rows = [(1, "a b c d " * 3), (2, "x x x x x x x"), (3, "a  b\tc\nd e"), (4, "d e f g h i"), *[r[:2] for r in AWKWARD]]
    for window in (4, 35):
        got = found_removal(documents(rows), window=window, shingle=2)
        assert got == plain_removal(rows, window)
    assert found_removal(awkward) == plain_removal([r[:2] for r in AWKWARD], 35)
    assert repeated_phrases.remove_repeats(nothing).count() == 0
