"""Queries over windows of ordered text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.operators import batching as b
from quoin.operators import mining as m
from quoin.plans.corrections import KEY
from quoin.plans.mining import FORMS, LINES
from quoin.plans.registry import query

BLANK = r"[\s\x{A0}\x{202F}]"
TEXT = rf"""{LINES}, page AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_pages FROM line),
  nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1 AS nth, count(*) OVER (PARTITION BY doc_id) AS n_text FROM page WHERE regexp_replace(text, '{BLANK}', '', 'g') <> '')"""
SIZE = "CASE WHEN n_pages <= 30 THEN 3 WHEN n_pages <= 100 THEN 4 ELSE 5 END"

query("w01_batch_size", ["documents"], lambda d: m.totals(m.pages_of(d)).select("doc_id", b.batch_size(F.col("total_pages")).alias("size")), f"WITH {TEXT} SELECT DISTINCT doc_id, {SIZE} AS size FROM page")
query(
    "w02_batches",
    ["documents"],
    lambda d: b.batches(m.pages_of(d)),
    f"WITH {TEXT}, st AS (SELECT *, CASE WHEN size >= 4 THEN size - 1 ELSE size END AS stride FROM (SELECT *, {SIZE} AS size FROM nb)), starts AS (SELECT doc_id, size, stride, unnest(range(0, n_text, stride)) AS s FROM (SELECT DISTINCT doc_id, size, stride, n_text FROM st)) SELECT st.doc_id, (s // starts.stride)::INT AS batch, page_num FROM starts JOIN st ON st.doc_id = starts.doc_id AND nth >= s AND nth < s + starts.size",
)


def condensed_sql(most: int, source: str = "nb") -> str:
    return rf"""cs AS (SELECT *, chr(10) || '--- PAGE ' || (page_num + 1) || ' ---' || chr(10) AS head, length(text) AS n FROM {source}),
  cw AS (SELECT *, sum(length(head) + n) OVER (PARTITION BY doc_id) AS whole, sum(n) OVER (PARTITION BY doc_id) AS chars FROM cs),
  cb AS (SELECT *, (200 + floor(greatest(0, {most} - n_text * 225) * (n::DOUBLE / chars::DOUBLE)))::INT AS budget FROM cw),
  ck AS (SELECT *, substr(text, 1, budget) AS kept FROM cb),
  cx AS (SELECT *, CASE WHEN strpos(reverse(kept), ' ') > 0 THEN length(kept) - strpos(reverse(kept), ' ') ELSE -1 END AS space FROM ck),
  condensed AS (SELECT doc_id, string_agg(head || CASE WHEN whole <= {most} THEN text WHEN n > budget AND NOT regexp_matches(substr(text, budget + 1, 1), '{BLANK}') AND space > 200 THEN substr(kept, 1, space) ELSE kept END, '' ORDER BY page_num) AS text FROM cx GROUP BY doc_id)"""


for name, most in (("w03_condensed", 160_000), ("w03_condensed_proof", 80_000)):
    query(name, ["documents"], lambda d, most=most: b.condensed(m.pages_of(d), most), f"WITH {TEXT}, {condensed_sql(most)} SELECT * FROM condensed")
CH = (90_000, 80_000, 10_000, 6)
query(
    "w04_chunks",
    ["documents"],
    lambda d: b.chunks(b.condensed(m.pages_of(d), 1 << 30), *CH),
    f"""WITH RECURSIVE {TEXT}, {condensed_sql(1 << 30)}, walk AS (
      SELECT doc_id, text, length(text) AS total, 0 AS chunk, 0 AS start, NULL::INT AS stop FROM condensed WHERE length(text) > {CH[0]}
      UNION ALL SELECT doc_id, text, total, chunk + 1, greatest(start + 1, e - {CH[2]})::INT, e::INT FROM (SELECT *, CASE WHEN hard < total AND back > 0 THEN start + {CH[1] // 2} + length(half) - back - 10 + 1 ELSE hard END AS e FROM (
        SELECT *, strpos(reverse(half), reverse(chr(10) || '--- PAGE ')) AS back FROM (SELECT *, least(start + {CH[1]}, total) AS hard, substr(text, start + {CH[1] // 2} + 1, least(start + {CH[1]}, total) - start - {CH[1] // 2}) AS half FROM walk WHERE start < total AND chunk < {CH[3]})))
    ), steps AS (SELECT doc_id, chunk - 1 AS chunk, lag(start) OVER (PARTITION BY doc_id ORDER BY chunk) AS start, stop FROM walk)
    SELECT * FROM steps WHERE chunk >= 0 UNION ALL SELECT doc_id, 0, 0, length(text) FROM condensed WHERE length(text) <= {CH[0]}""",
)
query("w05_chunk_dedupe", ["corrections"], lambda k: b.first_of_key(k).select("id"), f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY job_id, page_number, category, {KEY} ORDER BY seq) AS n FROM {{corrections}}) WHERE n = 1")
MS = r"""page AS (SELECT doc_id, page_num, text, count(*) OVER (PARTITION BY doc_id) AS n_pages FROM {manuscript}),
  nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1 AS nth, count(*) OVER (PARTITION BY doc_id) AS n_text FROM page WHERE regexp_replace(text, '[\s\x{A0}\x{202F}]', '', 'g') <> '')"""
few = lambda k: k.where("confidence = 'Certain' AND NOT located").select(F.substring("job_id", 4, 20).cast("long").alias("doc_id"), "page_number", "category")
query(
    "w06_grey_pages",
    ["manuscript", "corrections"],
    lambda p, k: b.grey_pages(p, few(k)),
    f"WITH {MS}, fixed AS (SELECT DISTINCT substr(job_id, 4)::BIGINT AS doc_id, page_number AS page_num FROM {{corrections}} WHERE confidence = 'Certain' AND NOT located AND category IN ('A', 'B', 'C', 'D')), g AS (SELECT nb.doc_id, nb.page_num, row_number() OVER (PARTITION BY nb.doc_id ORDER BY nb.page_num) AS rank FROM nb ANTI JOIN fixed USING (doc_id, page_num) WHERE n_pages >= 8) SELECT doc_id, page_num, ((rank - 1) // 5)::INT AS batch FROM g WHERE rank <= 30",
)
query("w07_fact_groups", ["raw"], lambda r: b.groups_of(r, "job_id", ["seq"], 4).select("id", "grp"), "SELECT id, ((row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1) // 4)::INT AS grp FROM {raw}")
query("w08_fixed_chunks", ["documents"], lambda d: b.fixed_chunks(d.select("doc_id", "text"), 15_000), "SELECT doc_id, s::INT AS start, substr(text, s::INT + 1, 15000) AS piece FROM (SELECT doc_id, text, unnest(range(0, length(text), 15000)) AS s FROM {documents} WHERE length(text) > 0)")
query("w09_metadata_sample", ["documents"], lambda d: b.sample(m.pages_of(d), 15, 25_000), f"WITH {TEXT}, n2 AS (SELECT * REPLACE (count(*) OVER (PARTITION BY doc_id) AS n_text) FROM nb WHERE nth < 15), {condensed_sql(25_000, 'n2')} SELECT * FROM condensed")
query("w10_names_message", ["manuscript"], lambda p: b.names_message(m.variants(p)), f"WITH {FORMS}, g AS (SELECT doc_id, name, list_sort(list_distinct(list(form))) AS forms, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS nth FROM form_ GROUP BY doc_id, name) SELECT doc_id, string_agg('  • ' || name || CASE WHEN len(forms) > 1 THEN ' — variantes : ' || array_to_string(forms, ', ') || ' → à signaler en F' ELSE '' END, chr(10) ORDER BY nth) AS message FROM g WHERE nth <= 30 GROUP BY doc_id")
query("w11_already_found", ["corrections"], b.already_found, "WITH r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM {corrections} WHERE category IN ('A', 'B', 'C')) SELECT job_id, string_agg('  p.' || (page_number + 1) || ' [' || category || '] « ' || substr(original_text, 1, 60) || ' »', chr(10) ORDER BY n) AS context FROM r WHERE n <= 100 GROUP BY job_id")
