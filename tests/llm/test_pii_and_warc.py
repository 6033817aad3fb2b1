"""Personal data and web archives against plain Python, and their awkward cases."""

import gzip
import hashlib
import random
import re
from base64 import b32encode
from pathlib import Path

import pytest
from awkward import AWKWARD
from hypothesis import given, settings
from hypothesis import strategies as st

from clickloom.llm import pii, warc
from clickloom.llm.queries import op1_pii
from clickloom.sources.scratch import fresh_folder

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")))
                or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 8 <= len(digits) <= 15)
            ):
                out.append((kind, m.start(), m.end()))
    return out


def pieces():
    rng = random.Random(11)
    parts = [
        "a@b.c", "x_y", ".d", "@", "@e.f-g", "1.2.3.4", ".5", "256", "4111 1111 1111 1111", "4111111111111111", "-", "+1 ",
        "(017) 555-7713", " ", "é", "😀", "\n", "9" * 30, "%", "..", "a.b", "0000255.1.1.1", "+44", "()",
    ]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(1_500)]


def test_forms_equal_plain_search(documents):
    texts = pieces() + [" ".join(f"10.0.{i % 256}.{i % 7}" for i in range(1_000)), "a" * 200_000 + "@" + "b." * 50_000]
    got = {r.doc_id: [tuple(s) for s in r.proven] for r in pii.find(documents(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain_spans(text), text[:200]


def test_query_over_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op1_pii(spark, sf_dir).collect():
        base = plain_spans(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in FORMS]
        assert set(text.split(",")) <= set(r.spans.split(","))


def test_contexts_find_what_no_form_proves(documents):
    rows = [(i, f"please reach my phone number +1 (017) 555-{1000 + i} today") for i in range(12)]
    rows += [(50 + i, f"write to mail address user{i}@example.com soon") for i in range(12)]
    unseen = [(100, "please reach my phone number 017-555-9999 today"), (101, "write to mail address ann(at)example now")]
    clean = [
        (200, "in version 017-555-9999 of the manual"), (201, "the phone number 12 is short"), (202, "phone number of the house"),
        (203, "at mail address 4.0. nothing"),
    ]
    found = {r.doc_id: [tuple(s) for s in r.found] for r in pii.find(documents(rows + unseen + clean)).collect() if r.found}
    assert found == {100: [("phone", 29, 41)], 101: [("email", 22, 36)]}


def test_a_belief_spreads_over_patterns(documents):
    """A value believed after one pattern supports another pattern, which then finds more."""
    rows = [(i, f"call number +1 (017) 555-{1000 + i} now") for i in range(30)]
    rows += [(40 + i, f"call number 017-555-{2000 + i} now") for i in range(6)]
    rows += [(60 + i, f"dial extension 017-555-{2000 + i} now") for i in range(6)]
    rows += [(80, "dial extension 017-555-3333 now")]
    found = {r.doc_id for r in pii.find(documents(rows), share=0.7).collect() if r.found}
    assert 80 in found and set(range(40, 46)) <= found


def test_personal_data_of_awkward_rows(awkward, nothing):
    rows = pii.find(awkward).collect()
    assert len(rows) == len(AWKWARD) and not any(r.proven or r.found for r in rows)
    assert pii.find(nothing).count() == 0


PAGES = [
    (1, "http://a.example.com/x?q=1#f", "<p>one</p>"), (2, "https://www.a.example.com:8080/", "<p>one</p>"),
    (3, "http://bad url\r\nX: y", "WARC/1.1\r\n\r\nbody\r\n\r\nWARC/1.1\r\n"), (4, None, None), (5, "", ""),
    (-9, "http://[broken", "<p>one</p>"), (None, "http://b.example.org/", "é日本😀"), (6, "http://b.example.org/", "x" * 500_000),
    (6, "http://b.example.org/", "x" * 500_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS value")


def test_archives_give_back_what_went_in(spark, pages):
    rows = {(r.page_id, r.payload_digest): r for r in warc.capture_histories(pages.repartition(3), records_per_file=2).collect()}
    assert len(rows) == len(set(PAGES))
    first = {}
    for page_id, _, html in PAGES:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        r = rows[page_id, b32encode(hashlib.sha1(payload).digest()).decode()]
        assert r.payload_bytes == len(payload)
        original = first.get(html or "", page_id)
        assert (r.record_type, r.refers_to) == (("response", None) if page_id == original else ("revisit", original))


def test_archives_are_warc_files(spark, pages):
    folder = fresh_folder(spark, "t")
    warc.write_archives(pages, folder, min_bytes=20)
    files = sorted(Path(folder.removeprefix("file:")).glob("*.gz"))
    records = [r for f in files for r in warc.parse_records(gzip.open(f))]
    assert len(records) == len(PAGES)
    # Of payloads under 20 bytes none revisits another.
    assert {fields["warc-type"] for _, fields, _ in records} == {"response"}


def test_the_index_is_in_order(spark):
    html = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    hot = spark.range(300).selectExpr("id + 10000 AS page_id", "'http://hot.example.com/' AS url", "concat('p', id) AS html")
    index = warc.capture_histories(html.unionByName(hot).repartition(5), records_per_file=40)
    rows = [(r.url_key, r.captured, r.page_id) for r in sorted(index.collect(), key=lambda r: (r.part, r.place))]
    assert rows == sorted(rows) and len(rows) == html.count() + 300
    assert warc.capture_histories(html.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=8), max_size=9))
def test_loser_tree_merges(runs):
    def row(run, at, x):
        return (f"k{x}", x, at, "", "", None, 0, "", f"r{run}", at)

    rows = [sorted((row(r, i, x) for i, x in enumerate(run)), key=warc._order) for r, run in enumerate(runs)]
    assert list(warc.LoserTree(rows)) == sorted((x for run in rows for x in run), key=warc._order)
