"""Language, quality and decontamination: held-out accuracy, planted cases, brute force."""

import random
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from awkward import AWKWARD
from pyspark.sql import functions as F

from clickloom.llm import decontaminate, language_id, quality

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


def test_held_out_languages(docs):
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97 and rows.where("score < 0 OR score > 1").count() == 0


def test_false_positives_are_corrected():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 1 << 63, (2, 4_000), dtype=np.uint64)
    model = language_id.LanguageFilter.build(["a", "b"], list(own), "a")
    strange = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    masks = model.masks(strange)[:, 0]
    for i in range(2):
        assert np.mean((masks >> np.uint64(i)) & np.uint64(1)) == pytest.approx(model.chance[i], abs=2e-3)
        assert ((model.masks(own[i])[:, 0] >> np.uint64(i)) & np.uint64(1)).all()


def test_language_of_awkward_rows(awkward, nothing, documents):
    rows = language_id.identify(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.lang_pred for r in rows} <= {"en", "de", "fr", "und"}
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert language_id.identify(nothing).count() == 0
    unlabelled = documents([(1, "text", None, "s")])
    assert [r.lang_pred for r in language_id.identify(unlabelled).collect()] == ["und"]


def test_quality_of_labelled_rows(docs, labels):
    judged = quality.assess(docs, labels).join(labels, "doc_id")
    shares = {
        (r.quality, r.toxic): r.kept
        for r in judged.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    }
    assert shares[1, 0] > 0.98 and shares[0, 0] < 0.05 and shares[0, 1] < 0.05 and shares[1, 1] < 0.3


def test_sparse_sites_shrink_towards_their_parents(spark):
    bad = " | ".join(["spam"] * 30)
    good = "A plain sentence, with several words in it. Another one follows here, as it should."
    rows = [(i, bad if i % 20 < 10 else good + f" {i}", "en", f"h{i % 20}/p") for i in range(2_000)]
    rows += [(5_000, good + " z", "en", "h0/p"), (5_001, good + " z", "en", "new/p"), (5_002, good + " z", "en", "h15/p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.range(400).selectExpr("id AS doc_id", "int(id % 20 >= 10) AS quality", "0 AS toxic")
    site = {r.doc_id: r.p_site for r in quality.assess(docs, labels).where("doc_id >= 5000").collect()}
    assert site[5_000] < 0.2 < site[5_001] < site[5_002]


def test_quality_of_awkward_rows(awkward, nothing, spark, labels):
    some = spark.createDataFrame([(7, 0, None), (9, 1, 0), (4, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, some, some.limit(0)):
        assert quality.assess(awkward, given).count() == len(AWKWARD)
        assert quality.keep_good(awkward, given).columns == awkward.columns
    assert quality.keep_good(awkward, some.limit(0)).count() == len(AWKWARD)
    assert quality.assess(nothing, labels).count() == quality.keep_good(nothing, labels).count() == 0


def distance(a, b):
    """Least word edits from ``a`` to any stretch of ``b``."""

    @cache
    def d(i, j):
        if i == 0:
            return 0
        if j == 0:
            return i
        return min(d(i - 1, j - 1) + (a[i - 1] != b[j - 1]), d(i - 1, j) + 1, d(i, j - 1) + 1)

    return min(d(len(a), j) for j in range(len(b) + 1))


def test_edit_distances_equal_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        words = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 14))]
        item = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 8))]
        got, start, end = decontaminate.edit_distances(
            np.array([*words, 0], np.uint64), np.array([0]), np.array([len(words)]), np.array(item, np.uint64)
        )
        assert got[0] == distance(tuple(item), tuple(words))
        stretch = tuple(words[start[0]:end[0]])
        assert distance(tuple(item), stretch) == got[0]


def test_edited_items_are_found_and_clean_texts_left_alone(spark, docs):
    rng = random.Random(2)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = [r.text for r in docs.where("doc_id % 7 = 1").limit(60).collect()]
    index = decontaminate.ItemIndex(items)
    index_of = {item: words for item, words in zip(index.ids, index.words)}
    texts, planted = [], set()
    for number in range(120):
        item, text = rng.choice(items)
        words = text.split()
        for _ in range(rng.randint(0, int(0.2 * len(index_of[item])))):
            at = rng.randrange(len(words))
            words[at:at + 1] = rng.choice([[], ["changed"], [words[at], "added"]])
        texts.append(f"{' '.join(rng.choice(clean).split()[:80])} {' '.join(words).upper()} {rng.choice(clean)}")
        planted.add((number, item))
    texts += clean
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(frame, benchmark).collect()}
    assert len(planted & set(found)) >= 0.97 * len(planted)
    # Whatever else is reported is a leak by brute force.
    column = pa.array(texts)
    for row, words, firsts in decontaminate.words_of(column):
        for (doc, item), d in found.items():
            if (doc, item) not in planted:
                text = words[firsts[doc - row]:firsts[doc - row + 1]]
                got, _, _ = decontaminate.edit_distances(
                    np.append(text, np.uint64(0)), np.array([0]), np.array([len(text)]), index_of[item]
                )
                assert got[0] == d <= int(0.2 * len(index_of[item]))


def test_leaks_of_awkward_rows(spark, awkward, nothing, monkeypatch):
    items = [(1, "same row twice here"), (2, None), (3, ""), (4, "..."), (5, "one"), (6, "same row twice here")]
    benchmark = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "1 AS distance")
    wanted = [(4, 5), (7, 1), (7, 1), (7, 6), (7, 6)]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(awkward, benchmark).collect()) == wanted
    kept = decontaminate.remove_leaked(awkward, benchmark)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 3
    assert decontaminate.leaks(awkward, benchmark.limit(0)).count() == 0
    assert decontaminate.leaks(nothing, benchmark).count() == decontaminate.remove_leaked(nothing, benchmark).count() == 0
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 1)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(awkward, benchmark).collect()) == wanted


def test_three_hundred_languages(spark):
    """Each language has an alphabet of its own letters, some shared with its neighbour."""
    rng = random.Random(3)
    rows = []
    for number in range(300):
        letters = [chr(0x4E00 + 20 * number + i) for i in range(28)]
        for _ in range(8):
            words = ["".join(rng.choices(letters, k=rng.randrange(2, 6))) for _ in range(60)]
            rows.append((len(rows), " ".join(words), f"l{number:03}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_slots_in_spark_are_those_of_the_filter(spark):
    rng = np.random.default_rng(2)
    hashed = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    frame = spark.createDataFrame([(int(h),) for h in hashed.view(np.int64)], "gram long")
    for size in (1 << 12, 1 << 21):
        got = [set(r[0]) for r in frame.select(language_id.slots_of(F.col("gram"), size)).collect()]
        wanted = list(zip(*language_id.LanguageFilter._where(hashed, size)))
        assert got == [set(map(int, w)) for w in wanted]


def test_a_filter_is_bounded_in_size():
    for members, languages in ((10**9, 1), (10**9, 300), (10**7, 5_000)):
        size = language_id.table_size(members, languages)
        assert size * 8 * ((languages + 63) // 64) <= language_id.MOST_BYTES or size == language_id.FEWEST_SLOTS
    assert language_id.table_size(0, 4) >= 8
