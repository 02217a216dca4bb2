"""Model replies of every shape, and free-text search by postings."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quoin.operators import geometry, replies, search

TOOL = replies.TOOLS["1"]


def message(*inputs, name=TOOL, kind="tool_use"):
    return json.dumps({"content": [{"type": "text", "text": "x"}, *({"type": kind, "name": name, "input": i} for i in inputs)]})


GOOD = {"original": "mot", "corrected": "mots", "category": "A", "page_hint": 4}
REPLIES = [
    message({"corrections": [GOOD]}),
    message({"corrections": ["bare", GOOD, 3, None, [], {"original": "b", "page_hint": "12"}]}),
    message({"corrections": [GOOD]}, {"corrections": [{"original": "c", "page_hint": 2.9}]}),
    message({"corrections": GOOD}),
    message({"corrections": None}),
    message({}),
    message([GOOD]),
    message({"corrections": [GOOD]}, name="other"),
    message({"corrections": [GOOD]}, kind="text"),
    message({"corrections": [{"original": 5, "page_hint": None}, {"original": None, "page_hint": "x"}, {}]}),
    message({"corrections": [GOOD]})[:-3],
    json.dumps([GOOD]),
    '"text"',
    "",
    None,
    "{",
]


def by_hand(reply):
    try:
        found = json.loads(reply or "")
    except ValueError:
        return []
    out = []
    for block in found.get("content", []) if isinstance(found, dict) else []:
        if isinstance(block, dict) and block.get("type") == "tool_use" and block.get("name") == TOOL and isinstance(block.get("input"), dict):
            listed = block["input"].get("corrections")
            out += listed if isinstance(listed, list) else []
    word = lambda x: x if isinstance(x, str) else None
    hint = lambda x: (int(x) if x.strip().lstrip("+-").isdigit() else None) if isinstance(x, str) else int(x) if isinstance(x, (int, float)) else None
    return [(k, word(e.get("original")), word(e.get("corrected")), word(e.get("category")), hint(e.get("page_hint"))) for k, e in enumerate(out) if isinstance(e, dict)]


def test_replies_of_every_shape(spark):
    frame = spark.createDataFrame(list(enumerate(REPLIES)), "id int, reply string")
    rows = replies.raw_corrections(frame).collect()
    got = sorted((r.id, r.nth, str(r.original), str(r.corrected), str(r.category), str(r.page_hint)) for r in rows)
    want = sorted((i, k, *map(str, rest)) for i, reply in enumerate(REPLIES) for k, *rest in by_hand(reply))
    assert got == want and len(got) == 8
    assert replies.raw_corrections(frame.limit(0)).count() == 0


def test_facts_of_replies(spark):
    items = [{"text": " Victor Hugo ", "item_type": "proper_noun", "page_hint": 3}, {"text": "ab"}, {"text": "1802", "item_type": "date", "context": "c" * 500}, {"text": "Titre", "item_type": "odd", "page_hint": "x"}, "bare", {"text": None}]
    frame = spark.createDataFrame([(message({"fact_check_items": items}), 6)], "reply string, page_number int")
    rows = replies.facts(frame, "page_number").orderBy("nth").collect()
    assert [(r.text, r.item_type, len(r.context), r.page_hint) for r in rows] == [("Victor Hugo", "proper_noun", 11, 3), ("1802", "date", 300, 7), ("Titre", "proper_noun", 5, 7)]


def test_metadata_of_fenced_replies(spark):
    cases = [('```json\n{"author": "Zola"}\n```', "", "Zola"), ('{"author": "Zola"}', "Hugo", "Hugo"), ('```\n{"author": "', "", None), ('{"author": ""}', "", None), ("not json", None, None), (None, "", None), ('{"author": "' + "x" * 500 + '"}', "", "x" * 400)]
    rows = spark.createDataFrame([c[:2] for c in cases], "reply string, own string").select(replies.metadata("reply", "author", F.col("own")).alias("a")).collect()
    assert [r.a for r in rows] == [c[2] for c in cases]


# ── search ─────────────────────────────────────────────────────────────────


@pytest.mark.parametrize("bucket_rows", [20_000, 7])
def test_search_equals_a_scan(spark, tmp_path, monkeypatch, bucket_rows):
    monkeypatch.setattr(search, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", "".join(rng.choice("abÉ .") for _ in range(rng.randint(1, 40)))])
    rows = [(f"r{i}", text(), text()) for i in range(60)] + [("long", "aB" * 400, None), ("odd", "a\x1fb", "É")]
    frame = spark.createDataFrame(rows, "id string, one string, two string")
    path = str(tmp_path / "i")
    search.write_index(frame, "id", ["one", "two"], path)
    needles = ["a", "É", ".", "ab", "é.", "aba", "abab", "a b", "ababa", "b.a", "ab" * 15, "zzz", "zz", "a.bé a", *{(r[1] or "")[3:k] for r in rows[:12] for k in (7, 12, 33)} - {""}]
    for needle in needles:
        want = sorted(i for i, *texts in rows if any(needle.lower() in (t or "").lower() for t in texts))
        assert sorted(r.id for r in search.find(spark, path, needle).collect()) == want, needle
    assert search.find(spark, path, "a\x1fb").count() == 0
    plan = search.find(spark, path, "abab")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [Or(EqualTo(gram" in plan or "gram IN" in plan
    search.write_index(frame.limit(0), "id", ["one", "two"], str(tmp_path / "none"))
    assert search.find(spark, str(tmp_path / "none"), "abc").count() == 0


@pytest.mark.parametrize("band", [1, 4])
def test_near_places_equal_a_filter_of_all(spark, band):
    rng = random.Random(band)
    pages = spark.createDataFrame([(d, p, " ".join(rng.choice(["un", "deux", "trois"]) for _ in range(rng.randint(0, 6)))) for d in range(3) for p in range(40)], "doc_id long, page_num int, text string")
    asked = spark.createDataFrame([(i, rng.randint(0, 3), rng.randint(-2, 42), rng.choice(["un", "un deux", "trois deux", "", "quatre"])) for i in range(60)], "request_id long, doc_id long, page_num int, original_text string")
    want = geometry.matches(asked, pages).where(F.abs(F.col("found_page") - F.col("page_num")).between(1, band))
    assert sorted(map(tuple, geometry.near_matches(asked, pages, band).collect())) == sorted(map(tuple, want.collect())) != []
