"""Plans and writes that must not grow faster than the input."""

import contextlib
import io
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quoin.operators import corrections, geometry, items, mining, search
from quoin.plans import QUERIES
from quoin.plans import corrections as correction_plans
from quoin.plans import tables as plans
from quoin.plans.mining import NOUN
from quoin.sources import page_files
from quoin.streaming import machines


def test_phrase_search_sends_no_side_whole(spark, capsys):
    rng = random.Random(3)
    letters = ["a", "b", "l’œil", "L'OEIL", "c", "…"]
    texts = [(d, p, " ".join(rng.choice(letters) for _ in range(rng.randrange(9)))) for d in range(4) for p in range(12)]
    asks = [(k, rng.randrange(5), rng.randrange(12), " ".join(rng.choice(letters) for _ in range(rng.randrange(4)))) for k in range(60)]
    pages = spark.createDataFrame(texts, "doc_id long, page_num int, text string")
    asked = spark.createDataFrame(asks, "request_id long, doc_id long, page_num int, original_text string")
    folded = lambda text: text.lower().replace("’", "'").replace("œ", "oe").replace("…", "...").split()
    want = {}
    for k, d, page, text in asks:
        ph = folded(text)
        for at, p, t in texts:
            ws = folded(t)
            places = [i for i in range(len(ws)) if ph and at == d and ws[i : i + len(ph)] == ph]
            if places:
                want[k, d, page, p] = (places[0], len(ph))
    found = geometry.matches(asked, pages)
    assert {tuple(r)[:4]: tuple(r)[4:] for r in found.collect()} == want != {}
    placed = geometry.placed_words(pages)
    where = geometry.located(asked, pages)
    for frame in (found, where, geometry.near_matches(asked, pages), geometry.rectangles(where, placed), geometry.strategies(asked, pages)):
        frame.explain()
        assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_names_equal_their_sql_beside_letters_outside_the_class(spark):
    duckdb = pytest.importorskip("duckdb")
    texts = ["Il vit Esra Auß ici", "Jean Dupontœ", "Jean Paul-Pierre Marie", "x²Jean Dupont", "éJean Dupont, Marie Curie", "Jean\u00a0Dupont", "Jean\x0bDupont Zola", "A\u0301Jean Dupont", "Anne Jean Paul Luc Marie Curie", "Jean Dupont_", "Jean\nDupont"]
    con = duckdb.connect()
    want = [con.execute(f"SELECT {NOUN} FROM (SELECT ? AS text)", [t]).fetchone()[0] for t in texts]
    pages = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, page_num int, text string")
    got = {r.doc_id: list(r.names) for r in mining.proper_nouns(pages).groupBy("doc_id").agg(F.collect_list("name").alias("names")).collect()}
    assert [got.get(i, []) for i in range(len(texts))] == want
    assert want[0] == ["Esra Au"]
    mined = mining.mined(pages).where("stage = 2").groupBy("doc_id").agg(F.count("*").alias("n"))
    assert {r.doc_id: r.n for r in mined.collect()} == {i: len(w) for i, w in enumerate(want) if w}


def test_index_cuts_a_text_of_many_rows_once(spark, tmp_path):
    rows = [(i, f"mot {i % 5}", "la même suite", None) for i in range(400)]
    search.write_index(spark.createDataFrame(rows, "id long, one string, two string, three string"), "id", ["one", "two", "three"], str(tmp_path))
    places = spark.read.parquet(f"{tmp_path}/grams").select(F.sum(F.size("places"))).first()[0]
    assert places == 5 * len("mot 0") + len("la même suite")
    found = {(r.needle, r.id) for r in search.find_all(spark, str(tmp_path), ["SUITE", "t 3", "mot 0m", ""]).collect()}
    assert found == {("SUITE", i) for i in range(400)} | {("", i) for i in range(400)} | {("t 3", i) for i in range(3, 400, 5)}


def test_requests_of_a_client_are_judged_in_frames(monkeypatch):
    class Held:
        def __init__(self):
            self.map, self.value = {}, None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def containsKey(self, key):  # noqa: N802
            return key in self.map

        def getValue(self, key):  # noqa: N802
            return self.map[key]

        def updateValue(self, key, value):  # noqa: N802
            self.map[key] = value

        def removeKey(self, key):  # noqa: N802
            del self.map[key]

        def keys(self):
            return list(self.map)

    monkeypatch.setattr(machines, "ANSWERS", 7)
    rng = random.Random(1)
    judge = machines.Minutes({"a": 2, "b": 4})
    judge.made, judge.newest = Held(), Held()
    made, newest, number = {}, None, 0
    for begin in (100, 130, 60, 400):
        batch = [((begin + rng.randrange(-20, 20)) * machines.MINUTE + rng.randrange(50), number + i) for i in range(60)]
        number += 60
        want = {}
        for us, i in sorted(batch):
            minute = us // machines.MINUTE
            late = newest is not None and minute <= newest - 60
            if not late:
                made[minute] = made.get(minute, 0) + 1
                newest = minute if newest is None else max(newest, minute)
            want[i] = (late, not late and made[minute] <= 2, not late and made[minute] <= 4)
        made = {m: n for m, n in made.items() if m > newest - 60}
        frames = [pd.DataFrame(batch[k : k + 13], columns=["us", "event_id"]) for k in range(0, 60, 13)]
        got = pd.concat(judge.handleInputRows((3,), iter(frames), None))
        assert {r.event_id: (r.late, r.a_accepted, r.b_accepted) for r in got.itertuples()} == want
        assert judge.made.map == {(m,): (n,) for m, n in made.items()}


def test_resent_rows_do_not_make_their_view_again(spark, sf_dir, monkeypatch):
    sent = []
    insert = plans.tables.insert_by_job
    monkeypatch.setattr(plans.tables, "insert_by_job", lambda rows, path: (sent.append(rows.inputFiles()), insert(rows, path))[1])
    plans.reset_and_retried(spark, sf_dir)
    assert len(sent) >= 5 and not [f for files in sent for f in files if "lineitem" in f]


def test_only_large_pages_are_cut_to_grams(spark, monkeypatch):
    rng = random.Random(5)
    sizes = {page: rng.choice([1, 3, 6, 7, 25]) for page in range(20)}
    rows = [("j", page, at, rng.choice("ABCDEFGHX"), "".join(rng.choice("aab ") for _ in range(rng.choice([2, 4, 5, 6, 9])))) for page, n in sizes.items() for at in range(n)]
    want = set()
    for page in sizes:
        kept = []
        for _, _, at, category, text in sorted((r for r in rows if r[1] == page), key=lambda r: ("ABCDEFGHX".index(r[3]), r[2])):
            k = re.sub(r"^\s+|\s+$", "", text).lower()
            if not any(min(len(k), len(y)) >= 5 and (k in y or y in k) for y in kept):
                kept.append(k)
                want.add((page, at))
    cut_up = []
    containments = corrections.containments
    monkeypatch.setattr(corrections, "MOST_AT_ONCE", 6)
    monkeypatch.setattr(corrections, "containments", lambda texts: (cut_up.append(texts.count()), containments(texts))[1])
    frame = spark.createDataFrame(rows, "job_id string, page_number int, position int, category string, original_text string")
    assert {(r.page_number, r.position) for r in corrections.undominated(frame).collect()} == want
    assert cut_up == [sum(n for n in sizes.values() if n > 6)]
    assert len(want) < len(rows)


def test_de_duplication_stages_no_column_that_it_does_not_read(spark, sf_dir, monkeypatch):
    staged = []
    real = corrections.staged
    monkeypatch.setattr(corrections, "staged", lambda rows: (staged.append(rows.columns), real(rows))[1])
    for name in ("d03_overlap", "d04_repeat_cap", "d05_result_order", "a01_live_counts", "a09_category_map"):
        QUERIES[name](spark, sf_dir)
    assert len(staged) == 5 and not [c for columns in staged for c in columns if c in ("description", "explanation", "corrected_text", "source", "created_at")]


def test_passes_insert_rows_of_a_view_made_once_and_parse_in_compiled_code(spark, sf_dir, monkeypatch):
    sent = []
    append = correction_plans.append_rows
    monkeypatch.setattr(correction_plans, "append_rows", lambda rows, path: (sent.append(rows), append(rows, path))[1])
    QUERIES["s11_insert_corrections"](spark, sf_dir)
    assert len(sent) == 2 and not [f for rows in sent for f in rows.inputFiles() if "lineitem" in f]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # the JVM compiles no method of more than 8,000 bytes
        for frame in (*sent, QUERIES["p_parse_all"](spark, sf_dir)):
            out = io.StringIO()
            with contextlib.redirect_stdout(out):
                frame.explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
            assert sizes and max(sizes) < 8_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_pages_are_mined_once_for_items(spark, sf_dir, monkeypatch):
    written = []
    staged = items.staged
    monkeypatch.setattr(items, "staged", lambda rows: (written.append(rows), staged(rows))[1])
    for name in ("i08_fact_only_items", "i09_prompt", "i03_attested_exclusion"):
        QUERIES[name](spark, sf_dir)
    assert len(written) == 3
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES["i08_fact_only_items"](spark, sf_dir).explain()
    # only how names look for their pages reads the orders, the patterns do not
    assert out.getvalue().count("orders.parquet") == 1 and "regexp_extract_all" not in out.getvalue()


def test_small_splits_share_tasks(tmp_path):
    for f in range(50):
        (tmp_path / f"{f}.txt").write_bytes(b"\f".join(b"page %d" % i for i in range(40)))
    reader = page_files.PageReader({"path": str(tmp_path), "splitbytes": "16"})
    tasks = reader.partitions()
    pieces = [(p.path, p.split) for t in tasks for p in t.pieces]
    assert len(tasks) == 1 and len(pieces) == len(set(pieces)) > 50 * 10
    got = {}
    for batch in (b for t in tasks for b in reader.read(t)):
        got.setdefault(batch["path"][0].as_py(), []).extend(batch["text"].to_pylist())
    assert len(got) == 50 and all(texts == [f"page {i}" for i in range(40)] for texts in got.values())
    (tmp_path / "large.txt").write_bytes(b"x" * (page_files.TASK_BYTES * 2))
    assert len(page_files.PageReader({"path": str(tmp_path), "splitbytes": str(1 << 20)}).partitions()) == 3


def test_rules_make_their_rows_once(spark, sf_dir):
    for name in ("f_rules", "f07_filtered", "a21_removed_by_rule", "f18_quality_ratios"):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            QUERIES[name](spark, sf_dir).explain()
        assert out.getvalue().count("lineitem.parquet") == 1
