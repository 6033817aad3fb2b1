"""What bounds on work must not cost: results stay whole beyond them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from clickloom.llm import chat, decontaminate, pii
from clickloom.llm.queries import op10_chat_format


def edited(rng, words, edits):
    words = list(words)
    for number in range(edits):
        at = rng.randrange(len(words))
        words[at:at + 1] = rng.choice([[], [f"changed{number}"], [words[at], f"added{number}"]])
    return words


@pytest.mark.parametrize("n,items,walks", [(40, 40, 1), (1_200, 6, 24)])
def test_edited_leaks_are_all_found_where_walks_do_not_suffice(monkeypatch, n, items, walks):
    monkeypatch.setattr(decontaminate, "MOST_WALKS", walks)
    rng = random.Random(n)
    common = [f"w{i}" for i in range(3_000)]
    listed = [(i, " ".join(rng.choices(common, k=n))) for i in range(items)]
    index = decontaminate.ItemIndex(listed)
    found, exact = {}, {}
    for i, text in listed:
        around = [" ".join(rng.choices(common, k=50)) for _ in range(2)]
        document = f"{around[0]} {' '.join(edited(rng, text.split(), n // 5))} {around[1]}"
        for _, words, firsts in decontaminate.words_of(pa.array([around[0], "", document, around[1]])):
            found[i] = list(index.search(words, firsts))
            low, high = firsts[2:3], firsts[3:4]
            d, a, b = decontaminate.edit_distances(np.append(words, np.uint64(0)), low, high, index.words[i])
            exact[i] = [(2, i, int(d[0]), int(a[0] - low[0]), int(b[0] - low[0]))]
    assert all(x[0][2] <= n // 5 for x in exact.values())
    assert found == exact


def phones(hop, n):
    return [f"{hop:03d}{i:03d}5550" for i in range(n)]


def test_beliefs_spread_over_many_hops(spark):
    rows = [("hop0" + twin, value, "phone") for twin in "abc" for value in phones(0, 6)]
    for hop in range(5):
        for twin in "abc":
            rows += [(f"hop{hop}{twin}", value, None) for value in phones(hop + 1, 6)]
            rows += [(f"hop{hop}{twin}", value, None) for value in phones(hop, 6) if hop]
    graph = spark.createDataFrame(rows, "pattern string, value string, kind string")
    found = {r.value for r in pii.believed(graph, share=0.3, belief=0.6).collect()}
    assert found == {value for hop in range(1, 6) for value in phones(hop, 6)}


def test_rounds_go_on_while_rising_scores_may_bring_more(spark):
    """Nothing new is believed in the second round, but the values believed are surer, so that a pattern counts in the third."""
    rows = [("first", value, "phone") for value in phones(0, 30)] + [("first", value, None) for value in phones(1, 10)]
    rows += [("second", value, None) for value in phones(1, 10) + phones(2, 1)]
    graph = spark.createDataFrame(rows, "pattern string, value string, kind string")
    found = {(r.pattern, r.value) for r in pii.believed(graph, share=0.7, belief=0.7).collect()}
    assert ("second", phones(2, 1)[0]) in found


def test_the_loss_is_what_the_mask_cuts_from_the_output(spark, monkeypatch):
    sf_dir, mask = "/root/testdata/sf0.001", chat.loss_spans
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    wanted = {r.conv_id: r.n for r in rows.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()}
    got = {r.conv_id: r.loss_chars for r in op10_chat_format(spark, sf_dir).collect()}
    assert wanted and got == {conv: wanted.get(conv, 0) for conv in got} | {-1: len("<|im_end|><|im_start|>assistant ok")}
    monkeypatch.setattr(chat, "loss_spans", lambda formatted, roles=("nobody",): mask(formatted, ("nobody",)))
    assert {r.loss_chars for r in op10_chat_format(spark, sf_dir).collect()} == {0}
