"""The editorial data model over the given tables.

The tables hold trade data and prose, not manuscripts under correction. These views derive
the model's frames from them: one SQL text for each view, in the part of SQL that Spark and
DuckDB share, so a query and its SQL start from equal rows. Views name what they read in
braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "labels", "benchmark", "embeddings")

DOC_TYPES = ["roman", "nouvelle", "poesie", "jeunesse", "biographie", "histoire", "philosophie", "documentaire", "beaux_arts", "tourisme", "cuisine", "sport", "manuel_scolaire", "parascolaire", "essai", "autre"]
#: Candidate corrections of every kind: category, original, corrected, description,
#: explanation. None leaves what the row has by itself.
KINDS: list[tuple[str | None, str | None, str | None, str, str]] = [
    (None, None, None, "accord", "aucune erreur dans ce passage"),
    (None, "Mot répété", "mot répété", "casse", "forme"),
    ("C", "« mot juste »", "«mot juste»", "guillemet à revoir", "typographie"),
    ("C", '"mot juste"', "«mot juste»", "guillemet droit", "typographie"),
    ("C", "lecole", "l’ecole", "apostrophe manquante", "typographie"),
    (None, "renvoi²", "renvoi", "note", "appel de note"),
    (None, "ab", "abc", "mot court", "trop bref"),
    ("H", None, None, "fait", "date douteuse"),
    ("A", "XIXe", "XIXᵉ", "siècle", "chiffres romains"),
    (None, "681", "68", "nombre", "chiffre"),
    (None, "auteur2", "auteur", "mot", "renvoi"),
    ("C", "piteu-sement", "pieusement", "mot", "tiret"),
    (None, None, "terme", "Coupure syllabique détectée", "césure"),
    ("A", "17e", "17ᵉ", "ordinal", "exposant"),
    (None, None, "suite [texte manquant]", "phrase", "phrase tronquée"),
    ("G", None, "terme", "placeholder", "signalement préventif"),
    (None, None, "terme", "mise en page", "un saut de ligne parasite"),
    ("F", None, "terme", "interligne irrégulier", "blanc"),
    ("C", "deux  mots", "deux mots", "espace", "espaces"),
    ("G", None, "à compléter", "aucun placeholder", "vide"),
]


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _pick(key: str, values: list[str | None], other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {_quoted(v)}" for i, v in enumerate(values) if v is not None) + f" ELSE {other} END"


MONTHS = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]
NAMES = ["Victor Hugo", "Victor Marie Hugo", "Charles de Gaulle", "Marie Curie", "Émile Zola", "Jean d'Ormesson", "Le La", "Anne Sylvestre Martin"]
_month = "CASE month(o_orderdate) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MONTHS, 1)) + " END"
_name = lambda shift: _pick(f"(o_orderkey + {shift}) % {len(NAMES)}", NAMES, "''")
_s = lambda x: f"CAST({x} AS STRING)"

VIEWS: dict[str, str] = {
    "manuscript": f"""
        SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS page_num,
          concat(CASE o_orderkey % 7
            WHEN 0 THEN concat('Le ', {_s('day(o_orderdate)')}, ' ', {_month}, ' ', {_s('year(o_orderdate)')}, ' fut signé un acte. En ', upper({_month}), ' 1800 aussi.')
            WHEN 1 THEN concat('Acte du ', {_s('day(o_orderdate)')}, '/', {_s('month(o_orderdate)')}, '/', {_s('year(o_orderdate)')}, ', non du 14/07-1789 ni du 3.4.1850.')
            WHEN 2 THEN concat('Il naquit en ', {_s('year(o_orderdate) - 90')}, ' et mourut vers ', {_s('year(o_orderdate)')}, ' (', {_s('year(o_orderdate) - 1')}, ').')
            WHEN 3 THEN concat('Il lut « Les Fleurs du ', o_orderpriority, ' » puis _La Légende des ', o_orderstatus, '_ sans « fin ».')
            WHEN 4 THEN 'Texte XXX à revoir, voir tbd et ILLU12, ou TODO.'
            WHEN 5 THEN concat('Un pas-', chr(10), 'sage cou-', chr(10), 'pé avec  deux espaces,', chr(10), 'et la so', chr(173), 'ciologie.')
            ELSE '' END,
            CASE WHEN o_orderkey % 7 = 6 AND o_orderkey % 5 = 0 THEN '' ELSE concat(chr(10), 'Alors ', {_name(0)}, ' rencontra ', {_name(3)}, ' chez eux.') END) AS text
        FROM {{orders}}""",
    "corrections": f"""
        SELECT job_id, seq, page_number, coalesce(kind_category, category) AS category,
          coalesce(kind_original, original) AS original_text,
          CASE WHEN kind_no % 40 = 0 THEN upper(original) WHEN kind_corrected IS NOT NULL THEN kind_corrected WHEN seq % 9 = 0 THEN NULL ELSE concat(coalesce(kind_original, original), 's') END AS corrected_text,
          description, explanation, CASE WHEN seq % 4 = 0 THEN '' ELSE 'usage' END AS source, confidence, located, x0, y0, created_at, concat(job_id, '-', {_s('seq')}) AS id
        FROM (
          SELECT concat('job', {_s('l_suppkey')}) AS job_id,
            row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS seq,
            CAST(l_orderkey % 20 AS INT) AS page_number, substr('ABCDEFGH', CAST(l_partkey % 8 AS INT) + 1, 1) AS category,
            CASE l_orderkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN translate(p_name, 'ei', 'éî') WHEN 2 THEN concat(p_name, ' deluxe') WHEN 3 THEN concat('le ', p_name) ELSE p_name END AS original,
            (l_partkey * 7 + l_orderkey) % 40 AS kind_no,
            {_pick('(l_partkey * 7 + l_orderkey) % 40', [k[0] for k in KINDS], 'NULL')} AS kind_category,
            {_pick('(l_partkey * 7 + l_orderkey) % 40', [k[1] for k in KINDS], 'NULL')} AS kind_original,
            {_pick('(l_partkey * 7 + l_orderkey) % 40', [k[2] for k in KINDS], 'NULL')} AS kind_corrected,
            {_pick('(l_partkey * 7 + l_orderkey) % 40', [k[3] for k in KINDS], "'forme'")} AS description,
            {_pick('(l_partkey * 7 + l_orderkey) % 40', [k[4] for k in KINDS], "'règle usuelle'")} AS explanation,
            CASE l_returnflag WHEN 'R' THEN 'Certain' WHEN 'A' THEN 'Probable' ELSE 'À vérifier' END AS confidence,
            l_discount > 0 AS located, l_quantity AS x0, l_tax * 1000 AS y0, l_shipdate AS created_at
          FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey) AS t""",
    "feedback": f"""
        SELECT concat('fb-', id) AS id, id AS correction_id, job_id, category, original_text, corrected_text, description, confidence,
          {_pick('CAST(substr(job_id, 4) AS BIGINT) % 16', DOC_TYPES, "'autre'")} AS doc_type, 'false_positive' AS feedback_type,
          CASE seq % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'already_correct' WHEN 3 THEN 'wrong_correction' WHEN 4 THEN 'author_style' WHEN 5 THEN 'faithful_quote'
            WHEN 6 THEN 'fictional_term' WHEN 7 THEN 'wrong_context' WHEN 8 THEN 'hallucination_text' WHEN 9 THEN 'passage_confusion' ELSE 'other' END AS reason_code,
          CASE WHEN seq % 5 = 0 THEN NULL ELSE 'vu' END AS comment, created_at
        FROM {{corrections}} WHERE confidence = 'Certain' AND seq % 3 = 0""",
    "jobs": f"""
        SELECT concat('job', {_s('s_suppkey')}) AS id, concat('Ms ', {_s('s_suppkey % 30')}, CASE WHEN s_suppkey % 2 = 0 THEN '.pdf' ELSE '.PDF' END) AS filename,
          CASE s_suppkey % 8 WHEN 0 THEN 'error' WHEN 1 THEN 'awaiting_confirmation' WHEN 2 THEN 'processing' WHEN 3 THEN 'extracting' ELSE 'done' END AS status,
          s_nationkey AS user_id, {_pick('s_suppkey % 16', DOC_TYPES, "'autre'")} AS doc_type, min(l_shipdate) AS created_at,
          CAST(3 + s_suppkey % 140 AS INT) AS pages_count, CAST((3 + s_suppkey % 140) * 250 AS INT) AS word_count, CAST((3 + s_suppkey % 140) * 1500 AS INT) AS n_chars,
          CAST(s_suppkey % 5 AS INT) AS annotated_count, CAST(s_suppkey % 3 AS INT) AS h_not_annotated_count, s_acctbal / 1000 AS actual_cost_usd,
          CAST(count(*) AS INT) AS corrections_count, {_pick('s_suppkey % 4', ['complete', 'quick', 'coherence', 'facts'], "'complete'")} AS preset,
          sum(l_quantity) * 100 AS tokens_in, sum(l_quantity) * 20 AS tokens_out, sum(l_quantity) * 5 AS tokens_cached
        FROM {{supplier}} JOIN {{lineitem}} ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_nationkey, s_acctbal""",
    "users": """
        SELECT n_nationkey AS id, concat('  ', n_name, '@Example.org ') AS email, n_name AS name, CASE WHEN n_nationkey % 6 = 0 THEN 'admin' WHEN n_nationkey % 7 = 0 THEN 'guest' ELSE 'user' END AS role,
          n_nationkey % 9 <> 0 AS is_active, CASE WHEN n_nationkey % 5 = 0 THEN 0.0 ELSE 11.0 END AS monthly_limit_usd, n_nationkey * 0.75 AS current_month_spend_usd,
          CASE WHEN n_nationkey % 4 = 0 THEN TIMESTAMP '1998-07-15 10:00:00' ELSE TIMESTAMP '1998-08-02 09:00:00' END AS last_reset_at
        FROM {nation}""",
    "raw": """
        SELECT id, job_id, seq, page_number, CASE WHEN seq % 6 = 0 THEN NULL ELSE category END AS category,
          CASE seq % 5 WHEN 0 THEN concat(' <em>', original_text, '</em> ') WHEN 1 THEN concat('*', original_text, '*') WHEN 2 THEN substr(original_text, 1, 1) ELSE original_text END AS original,
          CASE seq % 8 WHEN 0 THEN 'Voir commentaire' WHEN 1 THEN '—' WHEN 2 THEN concat(original_text, ' X') WHEN 3 THEN upper(original_text) WHEN 4 THEN concat('<sup>', replace(original_text, 'le ', 'la '), '</sup>') ELSE corrected_text END AS corrected,
          CASE WHEN seq % 7 = 0 THEN NULL ELSE page_number + 1 - CAST(seq % 3 AS INT) END AS page_hint,
          description, explanation, CASE WHEN seq % 4 = 0 THEN '' ELSE source END AS source, CASE WHEN seq % 10 = 0 THEN 'Sûr' ELSE confidence END AS confidence,
          CASE seq % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'title' WHEN 2 THEN 'proper_noun' ELSE 'unknown' END AS item_type
        FROM {corrections}""",
    "matches": """
        SELECT id, CASE seq % 7 WHEN 0 THEN 'GUILLEMETS' WHEN 1 THEN 'POINT' WHEN 2 THEN 'UPPERCASE_SENTENCE_START' WHEN 3 THEN 'FR_ESPACE_X' WHEN 4 THEN 'AGREEMENT' WHEN 5 THEN 'UNPAIRED_BRACKETS' ELSE 'MISC' END AS rule_id,
          CASE seq % 5 WHEN 0 THEN 'typography' WHEN 1 THEN 'GRAMMAR' WHEN 2 THEN 'quotes_misc' ELSE 'MISC' END AS category_id, CASE WHEN seq % 13 = 0 THEN 'mot étranger ici' ELSE 'message' END AS message,
          CASE seq % 3 WHEN 0 THEN 'Un titre court' WHEN 1 THEN 'Il est venu ; elle a vu' ELSE repeat('long ', 30) END AS context,
          CASE seq % 6 WHEN 0 THEN '.....' WHEN 1 THEN '- - -a' WHEN 2 THEN '' ELSE original_text END AS original
        FROM {corrections}""",
    "searches": """
        SELECT doc_id, page_num, page_num AS seq, CASE (doc_id + page_num) % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'title' ELSE 'proper_noun' END AS item_type,
          CASE (doc_id + page_num) % 3 WHEN 0 THEN CASE (doc_id + page_num) % 4 WHEN 0 THEN '(1805)' WHEN 1 THEN '12 mars 1802' ELSE '3 avril 1850' END
            WHEN 1 THEN CASE (doc_id + page_num) % 4 WHEN 0 THEN 'Les Fleurs du mal' WHEN 1 THEN 'Mémoires intérieurs' ELSE 'La Fleuriste obscure' END
            ELSE CASE (doc_id + page_num) % 4 WHEN 0 THEN 'Victor Hugo' WHEN 1 THEN 'Victor Hugau' ELSE 'Maria Curie' END END AS text,
          substr(text, 1, 40) AS context,
          CASE WHEN (doc_id + page_num) % 5 = 0 THEN NULL ELSE concat(text, ' Voir « Les Fleurs du bien » et Victor Hugot.') END AS results,
          CASE page_num % 4 WHEN 0 THEN '' WHEN 1 THEN 'le 12 mars 1802' WHEN 2 THEN 'en mars 1803, puis 1804' ELSE 'vers 1805' END AS answer
        FROM {manuscript}""",
    "requests": """
        SELECT doc_id, page_num, doc_id * 1000 + page_num AS request_id, substr('ABCDEFGH', CAST((doc_id + page_num) % 8 AS INT) + 1, 1) AS category,
          CASE (doc_id + page_num) % 6 WHEN 0 THEN 'Victor Hugo' WHEN 1 THEN 'chez eux.' WHEN 2 THEN 'absent du texte' WHEN 3 THEN 'RENCONTRA' WHEN 4 THEN 'rencontra Charles de Gaulle chez' ELSE 'Il naquit en' END AS original_text,
          CASE WHEN page_num % 3 = 0 THEN NULL ELSE 'forme' END AS corrected_text, 'motif' AS description, 'explication' AS explanation, CASE WHEN page_num % 4 = 0 THEN '' ELSE 'usage' END AS source,
          CASE page_num % 4 WHEN 0 THEN 'Certain' WHEN 1 THEN 'Probable' WHEN 2 THEN 'À vérifier' ELSE 'Autre' END AS confidence
        FROM {manuscript}""",
    "spans": """
        SELECT job_id AS doc_id, page_number AS page_num, CAST(floor(seq / 4) AS INT) AS line, CAST(seq % 4 AS INT) AS span, CASE WHEN seq % 11 = 0 THEN ' ' ELSE original_text END AS text, CASE WHEN x0 > 35 THEN 48.0 ELSE 12.0 END AS size
        FROM {corrections}""",
    "states": """
        SELECT user_id AS job_id, ts, event_id, event_type, CASE event_type WHEN 'click' THEN 'processing' WHEN 'view' THEN 'extracting' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'awaiting_confirmation' ELSE 'error' END AS status, value
        FROM {events}""",
}


def needed(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)) if n in TABLES or n in VIEWS]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view with all that it reads."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql, **{n: frame(spark, sf_dir, n) for n in needed(sql)})


def duck(sql: str) -> str:
    """DuckDB SQL whose braces name views: those become common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for n in needed(VIEWS[name]):
            visit(n)
        order.append(name)

    for n in needed(sql):
        visit(n)
    plain = lambda text: re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES or m[1] in VIEWS else m[0], text)
    body = plain(sql).strip()
    views = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    if not views:
        return body
    if (m := re.match(r"WITH\s+(RECURSIVE\s+)?", body)):
        return f"WITH {m[1] or ''}{views}, {body[m.end():]}"
    return f"WITH {views} {body}"
