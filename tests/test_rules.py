"""Pinned cases of the ordered rules, the de-duplication, names, dates and words on pages."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quoin.functions import text as t
from quoin.operators import batching, corrections, geometry, items, mining, report
from quoin.sources import files, page_files

ROW = "job_id string, seq long, page_number int, category string, original_text string, corrected_text string, description string, explanation string, confidence string"


def rows_of(spark, rows):
    return spark.createDataFrame([("j", i, 0, *r, "Probable") for i, r in enumerate(rows, 1)], ROW)


CASES = [
    ("A", "mot", "mots", "d", "Aucune erreur ici", "explication_negative"),
    ("A", "Mot", "mot", "d", "", "original_eq_correction"),
    ("C", "« a b »", "«a b»", "guillemet", "", "guillemets_français_présents"),
    ("C", '"a b"', "«a b»", "guillemet", "", "guillemets_extraction_artefact"),
    ("C", "lecole", "lécole", "apostrophe", "", "apostrophe_absente"),
    ("A", "mot²", "mot", "d", "", "chiffre_renvoi"),
    ("A", "ab", "abc", "d", "", "texte_trop_court"),
    ("C", "XIXe", "XIXᵉ", "d", "", "siecle_romain"),
    ("D", "XIXe", "XIXᵉ", "d", "", None),
    ("A", "681", "68", "d", "", "chiffre_renvoi_extrait"),
    ("A", "6812", "68", "d", "", "chiffre_renvoi_extrait"),
    ("A", "68123", "68", "d", "", None),
    ("A", "auteur2", "Auteur", "d", "", "chiffre_renvoi_mot_extrait"),
    ("C", "piteu-sement", "pieusement", "d", "", "coupure_substitution_erronee"),
    ("C", "piteu-sement", "piteusement", "d", "", None),
    ("B", "mot", "mots", "Coupure syllabique", "", "coupure_syllabique_artefact"),
    ("A", "17e", "17ᵉ", "d", "", "ordinal_expose_extraction"),
    ("E", "mot", "mot [Texte manquant]", "d", "", "phrase_tronquee_artefact"),
    ("G", "mot", "x", "d", "signalement préventif", "placeholder_preventif"),
    ("G", "mot", "à compléter", "aucun placeholder", "", "placeholder_preventif"),
    ("D", "mot", "x", "retour à la ligne", "", "saut_de_ligne_artefact"),
    ("F", "mot", "x", "interligne", "", "interligne_mise_en_page"),
    ("E", "mot", "x", "interligne", "", None),
    ("C", "deux  mots", "deux mots", "d", "", "double_espace_justification"),
    ("C", "deux  mots", None, "d", "", None),
    ("H", "mot", None, "d", "", None),
]


def test_each_rule(spark):
    rows = rows_of(spark, [c[:5] for c in CASES])
    marks = spark.createDataFrame([("j", 4)], "job_id string, guillemets int")
    got = {r.seq: r.fp_rule for r in corrections.with_rule(rows, marks).collect()}
    assert [got[i] for i in range(1, len(CASES) + 1)] == [c[5] for c in CASES]
    few = spark.createDataFrame([("j", 3)], "job_id string, guillemets int")
    assert {r.seq: r.fp_rule for r in corrections.with_rule(rows, few).collect()}[4] is None


def test_facts_are_never_sure(spark):
    rows = rows_of(spark, [("H", "Victor Hugo", None, "d", "e"), ("A", "mot juste", "mots", "d", "e")])
    assert {r.category: r.confidence for r in corrections.filtered(rows).collect()} == {"H": "À vérifier", "A": "Probable"}


PRIORITY = {c: i for i, c in enumerate("ABCDEFGH", 1)}


def spec(rows):
    """The de-duplication as an ordered walk over a list."""
    import unicodedata

    def overlap(a, b):
        short, long = sorted((a, b), key=len)
        return len(short) >= 5 and short in long

    fuzzy = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x.lower().strip()) if not unicodedata.combining(c))
    for key in (fuzzy, lambda x: x.lower().strip()):
        seen = {}
        for row in rows:
            k = (row[1], key(row[3]))
            if k not in seen or PRIORITY[row[2]] < PRIORITY[seen[k][2]]:
                seen[k] = row
        rows = list(seen.values())
    kept = []
    for row in sorted(rows, key=lambda r: PRIORITY[r[2]]):
        if not any(k[1] == row[1] and overlap(row[3].lower().strip(), k[3].lower().strip()) for k in kept):
            kept.append(row)
    counts, out = {}, []
    for row in kept:
        k = (row[2], row[3].lower().strip())
        counts[k] = counts.get(k, 0) + 1
        if row[2] not in "ABC" or counts[k] <= 3:
            out.append(row)
    return sorted(r[0] for r in out)


WORDS = ["été", "Ete", "short phrase", "this is a short phrase longer", "mot", "MOT", "un mot long", "mot long", "long", "phrase"]


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6))
def test_deduplication_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(6), rng.choice("ABCDEFGH"), rng.choice(WORDS)) for i in range(1, 120)]
    frame = spark.createDataFrame([("j", i, p, c, x, None, "", "", "Probable") for i, p, c, x in rows], ROW)
    assert sorted(r.seq for r in corrections.deduplicated(frame).collect()) == spec(rows)


@pytest.mark.parametrize(
    "rows, left",
    [
        ([(0, "C", "faute"), (0, "A", "faute")], {2}),
        ([(0, "A", "Faute"), (0, "A", "faute")], {1}),
        ([(0, "A", "faute"), (1, "A", "faute")], {1, 2}),
        ([(0, "B", "this is a short phrase longer"), (0, "A", "short phrase")], {2}),
        ([(0, "B", "this is a short phrase longer"), (1, "A", "short phrase")], {1, 2}),
        ([(0, "H", "Victor Hugo"), (0, "A", "Victor Hugo")], {2}),
        ([(0, "A", "abcd"), (0, "B", "abcd efgh")], {1, 2}),
        ([(0, "A", "abcde"), (0, "B", "abcde efgh")], {1}),
    ],
)
def test_golden_duplicates(spark, rows, left):
    frame = spark.createDataFrame([("j", i, p, c, x, None, "", "", "Probable") for i, (p, c, x) in enumerate(rows, 1)], ROW)
    assert {r.seq for r in corrections.deduplicated(frame).collect()} == left


def found(spark, text, pattern, group=0):
    return spark.createDataFrame([(text,)], "text string").select(F.expr(f"regexp_extract_all(text, {t.literal(pattern)}, {group})").alias("x")).first().x


@pytest.mark.parametrize(
    "pattern, text, n",
    [
        (mining.DATE_NUMERIC, "le 14/07-1789", 0),
        (mining.DATE_NUMERIC, "le 14/07/1789 et 3.4.1850", 2),
        (mining.DATE_WITH_MONTH, "en MARS 1800", 1),
        (mining.DATE_WITH_MONTH, "le 14 juillet prochain", 0),
        (mining.DATE_WITH_MONTH, "26 FÉVRIER 1802", 1),
        (mining.YEAR_ALONE, "En 1800, en 1801, vers 1802, (1803) et 1804", 3),
        (mining.PROPER_NOUN, "Émile Zola écrivit", 1),
        (mining.PROPER_NOUN, "La grande maison", 0),
        (mining.PROPER_NOUN, "Charles de Gaulle et Jean d'Ormesson", 2),
        (mining.PLACEHOLDER, "voir tbd, ILLU123 et XXXX", 3),
        (mining.PLACEHOLDER, "un taxi", 0),
        (mining.TITLE_QUOTED, "« Les Misérables » et « court »", 1),
    ],
)
def test_patterns(spark, pattern, text, n):
    assert len(found(spark, text, pattern)) == n


@pytest.mark.parametrize("name, ok", [("Victor Hugo", True), ("Le La", False), ("Victor\nHugo", False), ("Hugo", False), ("Jo Al", False), ("Marie de Médicis", True), ("Victor h Hugo", False), ("Victor H Hugo", True)])
def test_valid_names(spark, name, ok):
    assert spark.createDataFrame([(name,)], "n string").select(mining.valid_name(F.col("n")).alias("v")).first().v is ok


def test_lines_are_joined(spark):
    text = "pas-\nsage, cou-\nPé  deux  mots,\nsuite\nFin so­cio"
    assert spark.createDataFrame([(text,)], "t string").select(mining.joined_lines(F.col("t")).alias("v")).first().v == "pas-sage, cou-\nPé deux mots, suite\nFin socio"


@pytest.mark.parametrize("text, ok", [("12/07", False), ("1234", False), ("abc", False), ("abcd", True), ("   ", False), ("Éric 2", True)])
def test_item_validity(spark, text, ok):
    assert spark.createDataFrame([(text,)], "t string").select(items.valid(F.col("t")).alias("v")).first().v is ok


@pytest.mark.parametrize("pages", [1, 29, 31, 101])
def test_batches_cover_every_page(spark, pages):
    frame = spark.createDataFrame([(1, i, " " if i % 7 == 3 else "texte") for i in range(pages)], "doc_id long, page_num int, text string")
    size = 3 if pages <= 30 else 4 if pages <= 100 else 5
    stride = size - 1 if size >= 4 else size
    filled = [i for i in range(pages) if i % 7 != 3]
    want = {(b, p) for b, s in enumerate(range(0, len(filled), stride)) for p in filled[s : s + size]}
    assert {(r.batch, r.page_num) for r in batching.batches(frame).collect()} == want


@pytest.mark.parametrize("seed", range(6))
def test_chunks_equal_the_walk(spark, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["mot ", "long texte ", "\n--- PAGE 3 ---\n"]) for _ in range(rng.randrange(400)))
    single, size, lap, most = 900, 800, 100, 4
    want, offset = [], 0
    if len(text) <= single:
        want = [(0, len(text))]
    while len(text) > single and offset < len(text) and len(want) < most:
        end = min(offset + size, len(text))
        if end < len(text):
            cut = text.rfind("\n--- PAGE ", offset + size // 2, end)
            end = cut if cut != -1 else end
        want.append((offset, end))
        offset = max(offset + 1, end - lap)
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r.start, r.stop) for r in batching.chunks(frame, single, size, lap, most).orderBy("chunk").collect()] == want


def test_phrase_on_two_lines_gives_two_rectangles(spark):
    pages = spark.createDataFrame([(1, 0, " ".join(f"m{i}" for i in range(25))), (1, 7, "rien")], "doc_id long, page_num int, text string")
    asked = spark.createDataFrame([(1, 7, 5, "M9  m10"), (1, 7, 6, "absent")], "doc_id long, page_num int, request_id long, original_text string")
    where = geometry.located(asked, pages)
    assert [(r.request_id, r.found_page, r.word_idx, r.step) for r in where.collect()] == [(5, 0, 9, 2)]
    boxes = geometry.rectangles(where, geometry.placed_words(pages)).orderBy("line").collect()
    assert [(r.x0, r.y0, r.x1, r.y1) for r in boxes] == [(450.0, 0.0, 495.0, 12.0), (0.0, 14.5, 45.0, 26.5)]


def test_summary_text(spark):
    frame = spark.createDataFrame([("« L’œuvre » —\n été…" + "x" * 40,)], "t string")
    assert frame.select(report.ascii_safe(F.col("t")).alias("v")).first().v == "<< L'oeuvre >> -- ete..." + "x" * 11 + "..."


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text("page une\fpage deux\f")
    pages = page_files.read_pages(spark, str(tmp_path / "a.txt"))
    assert [(r.page_num, r.text) for r in pages.orderBy("page_num").collect()] == [(0, "page une"), (1, "page deux")]
    rows = spark.createDataFrame([(1, None, 'a "b", c')], "id int, note string, text string")
    files.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "csv"))
    assert back.columns == ["id", "note", "text"] and back.first().note is None
    files.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().text == 'a "b", c'
    assert files.header_line(rows).startswith("﻿id,")
