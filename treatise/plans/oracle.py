"""SQL that gives the rows of plans.queries on the same tables, written from the rules and not from the operators."""

from __future__ import annotations

import re

from ..operators.questions import PROMPT
from ..operators.retriever import ID_PROMPT, PATH_PROMPT
from .queries import NOISE_SQL, OUTLINE_SQL

_OUTLINE = OUTLINE_SQL.format(region="region", nation="nation", supplier="supplier")

_NODES = f"""
WITH o AS ({_OUTLINE}),
p AS (SELECT o.*, (SELECT max(b.position) FROM o b WHERE b.book = o.book AND b.position < o.position AND b.level < o.level) AS parent_position FROM o),
q AS (SELECT p.*, u.title AS t1, u.parent_position AS pp1 FROM p LEFT JOIN p u ON u.book = p.book AND u.position = p.parent_position),
r AS (SELECT q.*, v.title AS t2 FROM q LEFT JOIN p v ON v.book = q.book AND v.position = q.pp1),
n AS (SELECT book, position, level, title, parent_position,
  'node-' || printf('%03d', position) AS id, CASE WHEN parent_position IS NOT NULL THEN 'node-' || printf('%03d', parent_position) END AS parent_id,
  concat_ws(' > ', t2, t1, title) AS canonical_path, coalesce(t2, t1, title) AS root,
  coalesce(lead(level) OVER (PARTITION BY book ORDER BY position) <= level, true) AS is_leaf FROM r),
nodes AS (SELECT *, CAST(len(string_split(canonical_path, ' > ')) AS INT) AS depth,
  is_leaf AND starts_with(root, 'Chapter ') AND lower(trim(title)) <> 'media attributions' AS is_retrieval_leaf FROM n)
"""

_LINES = "lines AS (SELECT doc_id, CAST(i - 1 AS INT) AS nr, l[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d, unnest(range(1, len(l) + 1)) AS u(i))"

_PARAGRAPHS = f"""
{_LINES},
pre AS (SELECT doc_id, CAST(nr + 1 AS INT) AS position, line FROM lines WHERE trim(line) <> ''),
paragraphs AS (SELECT doc_id AS leaf_id, position, trim({NOISE_SQL}) AS text, CAST(position // 40 + 1 AS INT) AS page_start, CAST(position // 40 + 1 AS INT) AS page_end,
  doc_id || '-p' || printf('%03d', position) AS id FROM pre),
f AS (SELECT *, CASE
   WHEN max(CASE WHEN lower(text) = 'media attributions' THEN 1 ELSE 0 END) OVER (PARTITION BY leaf_id ORDER BY position) = 1 THEN 'media_attribution_tail'
   WHEN regexp_matches(text, '(?i)^(an|one or more)\\s+interactive(\\s+H5P)?\\s+elements?\\s+has\\s+been\\s+excluded\\s+from\\s+this\\s+version\\s+of\\s+the\\s+text\\.') THEN 'interactive_element_placeholder'
   WHEN regexp_full_match(text, '(?i)([•◦*-]\\s*)?((online\\s+here|url)\\s*:\\s*)?\\(?https?://\\S+\\)?') THEN 'url_only' END AS first FROM paragraphs),
g AS (SELECT *, first IS NULL AND length(text) <= 40 AND contains(text, '/') AND regexp_full_match(text, '[A-Za-z0-9._~:/?#\\[\\]@!$&''()*+,;=%-]+') AS orphan FROM f),
h AS (SELECT *, last_value(CASE WHEN NOT orphan THEN coalesce(first, 'kept') END IGNORE NULLS) OVER (PARTITION BY leaf_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g),
marked AS (SELECT id, leaf_id, position, text, page_start, page_end, CASE WHEN orphan THEN CASE WHEN before = 'url_only' THEN 'orphan_url_tail' END ELSE first END AS reason FROM h),
units AS (SELECT leaf_id, position, text, page_start, page_end, id AS source_ids, '' AS reasons FROM marked WHERE reason IS NULL)
"""

_BULLET = "regexp_matches({0}, '^([•●*-]\\s+|[◦▪])')"
_ENDS = "regexp_matches({0}, '[.!?…][”\"''’)\\]]*$')"
_BAND = "regexp_full_match({0}, '(?i)\\d+\\s*[–—-]\\s*\\d+(\\s+months?)?')"


_UNIT_COLUMNS = "leaf_id, position, text, page_start, page_end, source_ids, reasons"


def _islands(name: str, source: str, joins: str, reason: str) -> str:
    """CTEs that merge the rows of `source` that `joins` marks (a column of it) with the row before."""
    return f"""
{name}_k AS (SELECT *, sum(CASE WHEN {joins} THEN 0 ELSE 1 END) OVER (PARTITION BY leaf_id ORDER BY position) AS island FROM {source}),
{name} AS (SELECT leaf_id, min(position) AS position, string_agg(CASE WHEN {joins} THEN CASE WHEN {_BULLET.format('text')} THEN chr(10) ELSE ' ' END ELSE '' END || text, '' ORDER BY position) AS text,
  min(page_start) AS page_start, max(page_end) AS page_end, string_agg(source_ids, ',' ORDER BY position) AS source_ids,
  coalesce(string_agg(nullif(concat_ws(',', nullif(reasons, ''), CASE WHEN {joins} THEN '{reason}' END), ''), ',' ORDER BY position), '') AS reasons
FROM {name}_k GROUP BY leaf_id, island)"""


def _backward(name: str, source: str) -> str:
    return f"""
{name}_i AS (SELECT *, lag(text) OVER (PARTITION BY leaf_id ORDER BY position) AS before FROM {source}),
{name}_j AS (SELECT *, coalesce(before IS NOT NULL AND length(text) <= 40 AND NOT {_BULLET.format('text')} AND NOT {_BAND.format('text')} AND NOT {_ENDS.format('before')}, false) AS joins FROM {name}_i),{_islands(name, f'{name}_j', 'joins', 'short_continuation_backward')}"""


def _pairs(name: str, source: str, opens: str, reason: str) -> str:
    return f"""
{name}_a AS (SELECT *, CAST({opens} AS INT) AS opens FROM {source}),
{name}_b AS (SELECT *, sum(1 - opens) OVER (PARTITION BY leaf_id ORDER BY position) AS run FROM {name}_a),
{name}_c AS (SELECT *, opens = 1 AND sum(opens) OVER (PARTITION BY leaf_id, run ORDER BY position) % 2 = 1 AS takes FROM {name}_b),
{name}_j AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY leaf_id ORDER BY position), false) AS joins FROM {name}_c),{_islands(name, f'{name}_j', 'joins', reason)}"""


def _folded(name: str, source: str, joins: str, reason: str) -> str:
    """CTEs that walk through a leaf's rows s with the open unit f and merge where `joins` and the cap allow it."""
    j = f"(length(f.text) + 1 + length(s.text) <= 3000 AND ({joins}))"
    either = lambda yes, no: f"CASE WHEN {j} THEN {yes} ELSE {no} END"
    text = f"rtrim(f.text, ' ' || chr(10)) || CASE WHEN {_BULLET.format('s.text')} THEN chr(10) ELSE ' ' END || ltrim(s.text, ' ' || chr(10))"
    return f"""
{name}_s AS (SELECT *, row_number() OVER (PARTITION BY leaf_id ORDER BY position) AS k FROM {source}),
{name}_f AS (SELECT k, {_UNIT_COLUMNS} FROM {name}_s WHERE k = 1 UNION ALL
  SELECT s.k, s.leaf_id, {either('f.position', 's.position')}, {either(text, 's.text')}, {either('least(f.page_start, s.page_start)', 's.page_start')}, {either('greatest(f.page_end, s.page_end)', 's.page_end')},
    {either("f.source_ids || ',' || s.source_ids", 's.source_ids')}, {either(f"concat_ws(',', nullif(f.reasons, ''), nullif(s.reasons, ''), {reason})", 's.reasons')}
  FROM {name}_f f JOIN {name}_s s ON s.leaf_id = f.leaf_id AND s.k = f.k + 1),
{name} AS (SELECT {_UNIT_COLUMNS} FROM {name}_f QUALIFY k = max(k) OVER (PARTITION BY leaf_id, position))"""


_NESTED = "regexp_matches({0}, '^[◦▪]')"
_PARENT = "regexp_matches({0}, '^[•●*-]\\s+')"
_LOWER = "(NOT " + _BULLET + " AND regexp_matches(regexp_extract({0}, '\\p{{L}}'), '\\p{{Ll}}'))"


def _bullets(name: str, source: str) -> str:
    return _folded(name, source, f"{_NESTED.format('s.text')} OR ({_PARENT.format('s.text')} AND {_PARENT.format('f.text')})", f"CASE WHEN {_NESTED.format('s.text')} THEN 'nested_bullet_backward' ELSE 'adjacent_bullets' END")


def _continuations(name: str, source: str) -> str:
    return _folded(name, source, f"regexp_full_match(s.text, '\\(.*\\)\\.?') OR {_LOWER.format('s.text')}", "'artifact_continuation_backward'")


def _completed(name: str, source: str) -> str:
    return _folded(name, source, f"contains(f.reasons, 'short_label_forward') AND NOT regexp_matches(f.text, '[•●◦▪]') AND NOT {_ENDS.format('f.text')}", "'label_sentence_completion'")


def _units_after(*steps: str) -> str:
    return f"WITH RECURSIVE {_PARAGRAPHS}," + ",".join(steps)


_LABEL = f"(lower(text) IN ('did you know…', 'months milestones') OR (length(text) <= 60 AND NOT {_BULLET.format('text')} AND NOT {_ENDS.format('text')}))"
_BANDS, _LABELLED = (_BAND.format("text"), "age_band_forward"), (_LABEL, "short_label_forward")
_REQUESTED = "CASE WHEN length(line) <= 100 THEN 2 WHEN length(line) <= 250 THEN 4 WHEN length(line) <= 500 THEN 6 WHEN length(line) <= 1000 THEN 8 ELSE 10 END"

_UNITS = """units AS (SELECT CAST(o_orderkey AS VARCHAR) AS unit_id, CAST(o_custkey AS VARCHAR) AS leaf_id, CAST(o_orderkey % 7 + 1 AS BIGINT) AS n_questions,
  CASE WHEN o_orderkey % 50 = 0 THEN 'train_only' END AS split_constraint FROM orders),
a AS (SELECT *, sha256('42:' || unit_id) AS unit_key, split_constraint IS NOT NULL AS fixed FROM units),
b AS (SELECT *, CASE WHEN fixed THEN NULL ELSE row_number() OVER (PARTITION BY leaf_id, fixed ORDER BY unit_key) + CAST(bool_or(fixed) OVER (PARTITION BY leaf_id) AS INT) END AS nth FROM a),
c AS (SELECT *, CASE WHEN fixed OR nth = 1 THEN 'train' WHEN nth = 2 THEN 'test' END AS early FROM b),
covered AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN row_number() OVER (PARTITION BY leaf_id, early IS NULL ORDER BY n_questions, unit_key) = 1 THEN 'dev' END AS split FROM c)"""

_LABELS = _NODES + """, labels_ AS (SELECT root || '/' || id AS leaf_id, title, canonical_path FROM nodes WHERE is_retrieval_leaf),
asked AS (SELECT leaf_id || '?q' AS id, 'Where is ' || title || '?' AS query, leaf_id AS gold_leaf_id, CASE WHEN length(leaf_id) % 3 = 0 THEN 'elsewhere' ELSE canonical_path END AS gold_path FROM labels_),
made AS (SELECT id, query, gold_leaf_id, method, CASE WHEN method = 'id' THEN leaf_id ELSE canonical_path END AS target FROM asked JOIN labels_ ON gold_leaf_id = leaf_id, (VALUES ('id'), ('path')) AS m(method))"""

_TRIE = _NODES + """, t AS (SELECT book, list_append(string_split(canonical_path, ' '), '<eos>') AS t FROM nodes WHERE is_leaf),
trie AS (SELECT book, array_to_string(t[1:n], ' ') AS prefix, array_to_string(list_sort(list(DISTINCT t[n + 1])), '|') AS next_tokens FROM t, unnest(range(0, len(t))) AS u(n) GROUP BY ALL)"""

_TOKENS = "regexp_extract_all(replace(lower(coalesce({0}, '')), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+')"
_BM25 = f"""
tok AS (SELECT doc_id AS leaf_id, {_TOKENS.format('text')} AS t FROM documents),
posted AS (SELECT leaf_id, dl, term, count(*) AS tf FROM (SELECT leaf_id, len(t) AS dl, unnest(t) AS term FROM tok) x GROUP BY ALL),
size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM posted GROUP BY term) x, size),
weights AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
golds AS (SELECT item_id AS query_id, min(doc_id) AS gold_leaf_id FROM documents JOIN benchmark b ON contains(documents.text, b.text) GROUP BY 1),
asked AS (SELECT item_id AS query_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark),
times AS (SELECT query_id, term, count(*) AS times FROM asked GROUP BY ALL),
scored AS (SELECT query_id, leaf_id, round(sum(times * idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score FROM times JOIN posted USING (term) JOIN weights USING (term), size GROUP BY ALL),
ranked AS (SELECT g.query_id, d.doc_id AS leaf_id, d.lang, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY g.query_id ORDER BY coalesce(score, 0) DESC, d.doc_id) AS rank
  FROM golds g CROSS JOIN documents d LEFT JOIN scored s ON s.query_id = g.query_id AND s.leaf_id = d.doc_id),
ranks AS (SELECT r.query_id, leaf_id AS gold_leaf_id, lang, CAST(rank AS INT) AS gold_rank FROM ranked r JOIN golds g ON g.query_id = r.query_id AND g.gold_leaf_id = r.leaf_id)"""


_RETRIEVERS = f"""{_BM25},
shared AS (SELECT query_id, leaf_id, CAST(count(*) AS DOUBLE) AS score FROM times JOIN posted USING (term) GROUP BY ALL),
ranked_b AS (SELECT g.query_id, d.doc_id AS leaf_id, row_number() OVER (PARTITION BY g.query_id ORDER BY coalesce(score, 0) DESC, d.doc_id) AS rank FROM golds g CROSS JOIN documents d LEFT JOIN shared s ON s.query_id = g.query_id AND s.leaf_id = d.doc_id),
both_ AS (SELECT a.query_id, a.lang, a.gold_rank AS ra, b.rank AS rb FROM ranks a JOIN ranked_b b ON b.query_id = a.query_id AND b.leaf_id = a.gold_leaf_id)"""


def _means(rank: str = "gold_rank") -> str:
    recall = ", ".join(f"avg(CASE WHEN {rank} <= {k} THEN 1.0 ELSE 0.0 END) AS recall_at_{k}" for k in (1, 3, 5))
    return f"{recall}, avg(coalesce(1.0 / {rank}, 0.0)) AS mrr, avg(CASE WHEN {rank} <= 3 THEN 1.0 / log2({rank} + 1) ELSE 0.0 END) AS ndcg_at_3, avg({rank}) AS mean_rank"


_MEASURES = ["recall_at_1", "recall_at_3", "recall_at_5", "mrr", "ndcg_at_3", "mean_rank"]
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in _MEASURES)

_PAIRED = """paired AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS gold_leaf_id, doc_id * 7 % 3 + 1 = 1 AS correct_a, doc_id * 11 % 4 + 1 = 1 AS correct_b, 3 AS depth FROM documents),
strata AS (SELECT gold_leaf_id, count(*) AS n, avg(correct_a::INT) AS recall_a, avg(correct_b::INT) AS recall_b, avg((correct_a OR correct_b)::INT) AS recall_either FROM paired GROUP BY 1),
results AS (SELECT gold_leaf_id AS method, CASE WHEN length(gold_leaf_id) > 4 THEN recall_a END AS a, recall_b AS b, recall_either AS e FROM strata)"""



def _prompt(n: str, text: str) -> str:
    """The prompt with its two counts and the passage put in."""
    parts = [p.replace("'", "''") for p in re.split("%[ds]", PROMPT)]
    return " || ".join(f"'{p}'" + (f" || {v}" if v else "") for p, v in zip(parts, (n, n, text, "")))


def _order_free(rows: str) -> str:
    """CTEs l1 to l3: the hash of hashes h in `rows`, by their first four and first two digits."""
    joined = "sha256(string_agg(h, chr(0) ORDER BY h) || chr(0))"
    return f"l1 AS (SELECT substr(h, 1, 4) AS b, {joined} AS h FROM {rows} GROUP BY 1), l2 AS (SELECT substr(b, 1, 2) AS b, {joined} AS h FROM l1 GROUP BY 1), l3 AS (SELECT {joined} AS h FROM l2)"


_NORMAL = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_TITLE = _NORMAL.format("CASE WHEN nr % 5 = 4 THEN substr(line, 1, 24) ELSE line END")

_BEAMS = "b AS (SELECT doc_id AS id, 'src' || (doc_id % 20) AS gold_leaf_id, i, (doc_id * 7 + i * 5) % 23 AS t FROM documents, unnest(range(0, 5)) AS u(i) WHERE doc_id % 9 <> 0 OR i < 4)"

# Quotes and backslashes go from a line before it becomes a question; documents with number 3 of 5 have no array.
_G4 = f"""q AS (SELECT doc_id, nr, {_NORMAL.format("replace(replace(line, '\"', ''), chr(92), '') || '?'")} AS q FROM lines), k AS (SELECT *, replace(lower(q), 'ß', 'ss') AS key FROM q),
f AS (SELECT doc_id, arg_min(q, nr) AS q, min(nr) AS nr FROM k GROUP BY doc_id, key), t AS (SELECT doc_id, array_to_string(list(q ORDER BY nr)[1:6], '|') AS questions, count(*) AS n FROM f GROUP BY doc_id)
SELECT doc_id AS unit_id, CASE WHEN doc_id % 5 <> 3 AND n > 1 THEN questions END AS questions, CASE WHEN doc_id % 5 = 3 THEN 'no array' WHEN n < 2 THEN 'too few valid questions' END AS error FROM t"""

_P3 = f"""b AS (SELECT doc_id, nr, {_TITLE} AS title, CASE nr % 5 WHEN 1 THEN 'x' || chr(10) || line || chr(10) || 'y' WHEN 2 THEN '7 ' || upper({_TITLE}) WHEN 3 THEN {_TITLE} || ' | 12' ELSE line END AS block, line FROM lines WHERE trim(line) <> ''),
n AS (SELECT *, {_NORMAL.format('block')} AS t, replace(lower(title), 'ß', 'ss') AS wanted FROM b), k AS (SELECT *, replace(lower(t), 'ß', 'ss') AS key FROM n), f AS (SELECT *, starts_with(key, wanted) AND contains(t, '|') AS footer FROM k)
SELECT doc_id, nr AS block_no, CAST(CASE WHEN key = wanted THEN 0 WHEN nr % 5 = 1 THEN 1 WHEN contains(t, upper(title)) AND NOT footer THEN 2 WHEN footer THEN 3 END AS INT) AS priority FROM f"""

_P9 = f"""b AS (SELECT doc_id, nr, nr // 12 AS segment, CAST(nr // 30 + 1 AS INT) AS page, {_NORMAL.format('line')} AS t, CASE WHEN nr % 5 = 3 THEN 70.0 ELSE 57.0 END AS x0, CASE WHEN nr % 4 = 1 THEN 400.0 ELSE 555.0 END AS x1, 30.0 + nr % 30 * 25.0 AS y0, 30.0 + nr % 30 * 25.0 + CASE WHEN nr % 7 = 0 THEN 10.0 ELSE 22.0 END AS y1 FROM lines),
r AS (SELECT * FROM b WHERE nr % 12 <> 0 AND segment % 3 <> 2 AND t <> '' AND y1 > 40 AND y0 < 792 - 45),
m AS (SELECT *, CASE WHEN x0 > 56.7 + 5 OR (lag(x1) OVER w < 557.7 - 20 AND regexp_matches(lag(t) OVER w, '[.!?][”"''’)\\]]*$')) OR y0 - lag(y1) OVER w > 6 OR regexp_matches(t, '^([•●▪◦*-]|\\d+[.)]|[A-Za-z][.)])\\s+') THEN 1 ELSE 0 END AS starts FROM r WINDOW w AS (PARTITION BY doc_id, segment ORDER BY nr)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, segment ORDER BY nr) AS run FROM m),
p AS (SELECT doc_id, segment, run, min(page) AS page_start, max(page) AS page_end, trim(string_agg(t || CASE WHEN ends_with(t, '-') THEN '' ELSE ' ' END, '' ORDER BY nr)) AS text FROM g GROUP BY ALL)
SELECT doc_id, doc_id || '-' || segment AS leaf_id, doc_id || '-' || segment || '-p' || printf('%03d', row_number() OVER (PARTITION BY doc_id, segment ORDER BY run)) AS id, page_start, page_end, text, CAST(length(text) AS INT) AS character_count FROM p"""

_PAGES = "texts AS (SELECT page_id AS page, regexp_replace(html, '<[^>]*>', chr(10), 'g') AS text, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title FROM pages)"
_KEY = "replace(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), 'ß', 'ss')"

_EXAMPLES = """ex AS (SELECT o_orderkey AS id, list_transform(range(1, o_orderkey % 9 + 2), lambda i: i * 3) AS p, list_transform(range(1, o_custkey % 5 + 2), lambda i: i * 2) AS t FROM orders),
examples AS (SELECT id, list_append(list_concat(p, t), 0) AS x, list_append(list_concat(list_transform(p, lambda i: -100), t), 0) AS y FROM ex)"""


def oracle_sql() -> dict[str, str]:
    lines = f"WITH {_LINES}"
    return {
        "t1_outline_nodes": _NODES + "SELECT book, position, level, title, parent_position, id, parent_id, canonical_path, depth, is_leaf, is_retrieval_leaf FROM nodes",
        "s1_json_array": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
        "s2_jsonl": "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer",
        "s3_missing": "SELECT c_custkey, c_name FROM customer WHERE false",
        "s4_first_record": "SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 1",
        "s7_text_blocks": f"WITH {_PAGES}, l AS (SELECT page, string_split(text, chr(10)) AS l FROM texts) SELECT page, CAST(i - 1 AS INT) AS block_no, l[i] AS text FROM l, unnest(range(1, len(l) + 1)) AS u(i)",
        "s9_vectors": "SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding)::INT AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings",
        "k4_batches": "SELECT CAST(r_regionkey % 2 AS INT) AS batch, r_name AS name FROM region",
        "k5_quarantine": "SELECT o_orderkey AS unit_id, CASE WHEN o_orderkey % 7 = 0 THEN 'no array' END AS error, o_orderkey % 7 <> 0 AS accepted FROM orders",
        "k6_manifest": f"""WITH r AS (SELECT sha256(to_json({{'n_name': n_name, 'n_nationkey': n_nationkey, 'n_regionkey': n_regionkey}})::VARCHAR) AS h FROM nation), {_order_free('r')}
SELECT 'nation' AS name, (SELECT count(*) FROM nation) AS n_rows, h AS sha256 FROM l3""",
        "k7_replace": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0",
        "t8_profile": f"SELECT count(*) AS n_nodes, max(level) AS max_level FROM ({_OUTLINE}) AS x",
        "t9_repeated_titles": _NODES + "SELECT title, count(*) AS n, string_agg(book || '/' || id, ',' ORDER BY book || '/' || id) AS ids FROM nodes WHERE is_leaf GROUP BY title HAVING count(*) > 1",
        "t10_heading_coverage": f"WITH {_PAGES} SELECT page, title, contains({_KEY.format('CASE WHEN page % 3 <> 0 THEN text ELSE ' + chr(39) * 2 + ' END')}, {_KEY.format('title')}) AS covered FROM texts",
        "t11_block_coverage": f"""WITH {_PAGES}, blocks AS (SELECT page, text FROM (SELECT page, unnest(string_split(text, chr(10))) AS text FROM texts) x WHERE page % 4 <> 0 OR length(text) < 20),
heads AS (SELECT page, CASE WHEN page % 5 = 0 THEN substr(title, 1, 12) ELSE title END AS title FROM texts)
SELECT h.page, h.title, CASE coalesce(max(CASE WHEN {_KEY.format('b.text')} = {_KEY.format('h.title')} THEN 2 WHEN contains({_KEY.format('b.text')}, {_KEY.format('h.title')}) THEN 1 ELSE 0 END), 0) WHEN 2 THEN 'exact' WHEN 1 THEN 'contained' ELSE 'missing' END AS coverage
FROM heads h LEFT JOIN blocks b ON b.page = h.page GROUP BY h.page, h.title""",
        "t12_labels": _NODES + "SELECT id AS leaf_id, title, canonical_path FROM nodes WHERE is_retrieval_leaf",
        "k3_render_outline": f"SELECT book, string_agg(repeat('  ', level - 1) || '- ' || title, chr(10) ORDER BY position) AS outline FROM ({_OUTLINE}) AS x GROUP BY book",
        "s8_parse_outline": f"SELECT book, position, trim(title) AS title, level FROM ({_OUTLINE}) AS x",
        "p2_sections": f"""{lines}, pg AS (SELECT doc_id, CAST(nr // 10 + 1 AS INT) AS page, string_agg(line, chr(10) ORDER BY nr) AS text FROM lines GROUP BY ALL),
heads AS (SELECT l.doc_id, CAST(nr // 10 + 1 AS INT) AS page FROM lines l WHERE nr % 10 = 0 AND trim(line) <> ''),
nxt AS (SELECT *, lead(page) OVER (PARTITION BY doc_id ORDER BY page) AS end_page FROM heads),
s AS (SELECT n.doc_id, n.page AS position, n.page, trim(string_agg(p.text, chr(10) ORDER BY p.page)) AS text FROM nxt n JOIN pg p ON p.doc_id = n.doc_id AND p.page >= n.page AND p.page < coalesce(n.end_page, 1000000) GROUP BY ALL)
SELECT doc_id, position, page, trim(text, ' ' || chr(10)) AS text, CAST(length(trim(text, ' ' || chr(10))) AS INT) AS character_count FROM s""",
        "p3_heading_priority": f"{lines}, {_P3}",
        "p9_paragraphs": f"{lines}, {_P9}",
        "p10_length_stats": f"{lines} SELECT count(*) AS n, median(length(line)) AS median_length, CAST(min(length(line)) AS INT) AS min_length, CAST(max(length(line)) AS INT) AS max_length FROM lines",
        "p11_extremes": """SELECT * FROM (SELECT doc_id AS id, CAST(length(text) AS INT) AS character_count, 'shortest' AS "end" FROM documents ORDER BY length(text), doc_id LIMIT 5) x
UNION ALL SELECT * FROM (SELECT doc_id, CAST(length(text) AS INT), 'longest' FROM documents ORDER BY length(text) DESC, doc_id LIMIT 5) y""",
        "u5_removals": f"WITH {_PARAGRAPHS} SELECT id, leaf_id, reason FROM marked",
        "u6_backward_fragments": _units_after(_backward("a", "units")) + f" SELECT {_UNIT_COLUMNS} FROM a",
        "u7_age_bands": _units_after(_pairs("a", "units", *_BANDS)) + f" SELECT {_UNIT_COLUMNS} FROM a",
        "u8_labels": _units_after(_pairs("a", "units", *_LABELLED)) + f" SELECT {_UNIT_COLUMNS} FROM a",
        "u9_bullets": _units_after(_bullets("a", "units")) + f" SELECT {_UNIT_COLUMNS} FROM a",
        "u10_continuations": _units_after(_continuations("a", "units")) + f" SELECT {_UNIT_COLUMNS} FROM a",
        "u11_label_sentences": _units_after(_pairs("a", "units", *_LABELLED), _completed("b", "a")) + f" SELECT {_UNIT_COLUMNS} FROM b",
        "u12_foreign_sources": "SELECT '' AS id, 0::BIGINT AS leaf_id WHERE false",
        "u13_units": _units_after(_backward("a", "units"), _pairs("b", "a", *_BANDS), _pairs("c", "b", *_LABELLED), _bullets("d", "c"), _continuations("e", "d"), _completed("f_", "e"))
        + " SELECT leaf_id || '-g' || printf('%03d', row_number() OVER (PARTITION BY leaf_id ORDER BY position)) AS id, leaf_id, text, page_start, page_end, source_ids, reasons, CAST(length(text) AS INT) AS character_count FROM f_",
        "u14_provenance": "SELECT '' AS id, '' AS problem WHERE false",
        "u15_reason_histogram": _units_after(_pairs("merged", "units", *_BANDS)) + " SELECT 'removal' AS kind, reason, count(*) AS n FROM marked WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'merge', r, count(*) FROM (SELECT unnest(string_split(reasons, ',')) AS r FROM merged WHERE reasons <> '') x GROUP BY r",
        "g1_counts": f"{lines} SELECT {_REQUESTED} AS requested, count(*) AS n FROM lines GROUP BY 1",
        "g2_prompts": f"{lines} SELECT doc_id || '-' || nr AS id, sha256({_prompt(f'({_REQUESTED})', 'line')}) AS prompt_sha256 FROM lines",
        "g4_clean_questions": f"{lines}, {_G4}",
        "g5_pending": f"{lines} SELECT doc_id || '-' || nr AS id FROM lines WHERE nr % 3 <> 0",
        "g6_first_pending": f"{lines} SELECT doc_id || '-' || nr AS id, CAST(length(line) AS INT) AS character_count FROM lines ORDER BY 1 LIMIT 10",
        "g7_planned_totals": f"{lines} SELECT count(*) AS n_units, CAST(sum({_REQUESTED}) AS BIGINT) AS n_questions FROM lines",
        "g8_batches": f"{lines} SELECT doc_id || '-' || nr AS id, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY nr) - 1) // 4 AS BIGINT) AS batch FROM lines",
        "g10_fenced": f"""{lines} SELECT doc_id, nr AS line_no, replace(replace(line, '"', ''), chr(92), '') || '?' || CASE WHEN nr % 3 = 0 THEN '|' || replace(replace(line, '"', ''), chr(92), '') || '!' ELSE '' END AS questions FROM lines""",
        "d2_targets": f"""WITH {_UNITS}, totals AS (SELECT leaf_id, sum(n_questions) AS total FROM units GROUP BY 1),
x AS (SELECT leaf_id, total, i, split, total * w // 3190 AS base, total * w % 3190 AS rest FROM totals, (VALUES (0, 'train', 1056), (1, 'dev', 388), (2, 'test', 1746)) AS s(i, split, w))
SELECT leaf_id, split, CAST(base + CAST(row_number() OVER (PARTITION BY leaf_id ORDER BY rest DESC, i) <= total - sum(base) OVER (PARTITION BY leaf_id) AS INT) AS BIGINT) AS target FROM x""",
        "d6_covered": f"WITH {_UNITS} SELECT unit_id, leaf_id, split FROM covered",
        "d7_interleaved": f"WITH {_UNITS} SELECT unit_id, CAST(row_number() OVER (PARTITION BY leaf_id ORDER BY unit_key) - 1 AS INT) AS depth, sha256('42:' || leaf_id) AS leaf_key FROM covered WHERE split IS NULL",
        "d9_questions": f"WITH {_UNITS} SELECT unit_id || '-q' || printf('%02d', i) AS id, 'What is ' || i || ' of ' || unit_id || '?' AS query, leaf_id AS gold_leaf_id, split, unit_id AS source_unit_id FROM covered, unnest(range(1, n_questions + 1)) AS u(i)",
        "d10_split_counts": f"WITH {_UNITS} SELECT split, count(*) AS n_units, CAST(sum(n_questions) AS BIGINT) AS n_questions, count(DISTINCT leaf_id) AS n_leaves FROM covered WHERE split IS NOT NULL GROUP BY split",
        "r1_label_violations": _LABELS + "SELECT a.id, gold_leaf_id, CASE WHEN l.leaf_id IS NULL THEN 'unknown leaf' ELSE 'other path' END AS problem FROM asked a LEFT JOIN (SELECT * FROM labels_ WHERE leaf_id NOT LIKE '%7') l ON l.leaf_id = gold_leaf_id WHERE l.leaf_id IS NULL OR l.canonical_path <> gold_path",
        "r2_method_rows": _LABELS + "SELECT id, query, gold_leaf_id, method, target FROM made",
        "r3_prompts": _LABELS + f""", toc AS (SELECT book, string_agg(repeat('  ', level - 1) || '- ' || title, chr(10) ORDER BY position) AS toc, max(CASE WHEN level = 1 THEN title END) AS root FROM o GROUP BY book)
SELECT id, method, sha256(CASE WHEN method = 'id' THEN replace('{ID_PROMPT}', '{{query}}', query) ELSE replace(replace('{PATH_PROMPT}', '{{toc}}', toc), '{{query}}', query) END) AS prompt_sha256 FROM made JOIN toc ON root = string_split(gold_leaf_id, '/')[1]""",
        "r4_catalog": _LABELS + "SELECT DISTINCT method, target, gold_leaf_id AS leaf_id FROM made",
        "r5_trie": _TRIE + "SELECT book, prefix, next_tokens FROM trie",
        "r6_allowed_next": _TRIE + ", w AS (SELECT DISTINCT book, array_to_string(list_filter(t, lambda x: x <> '<eos>')[1:2], ' ') AS prefix FROM t), v AS (SELECT * FROM w UNION ALL SELECT book, prefix || ' nowhere' FROM w) SELECT v.book, v.prefix, coalesce(next_tokens, '<eos>') AS next_tokens FROM v LEFT JOIN trie ON trie.book = v.book AND trie.prefix = v.prefix",
        "r7_beams": f"WITH {_BEAMS} SELECT id, gold_leaf_id, CAST(min(CASE WHEN t < 20 AND 'src' || t = gold_leaf_id THEN i + 1 END) AS INT) AS gold_rank_at_k, count(*) FILTER (WHERE t >= 20) AS n_unknown FROM b GROUP BY ALL",
        "r7_ranked_targets": f"WITH {_BEAMS} SELECT id, CAST(i + 1 AS INT) AS rank, 't' || t AS target, CASE WHEN t < 20 THEN 'src' || t END AS leaf_id, CAST(-0.5 * i AS DOUBLE) AS sequence_score FROM b",
        "r7_beam_violations": f"WITH {_BEAMS} SELECT DISTINCT id, NULL::VARCHAR AS target, 'beam count' AS problem FROM b WHERE id % 9 = 0 UNION ALL SELECT id, 't' || t, 'unknown target' FROM b WHERE t >= 20",
        "r8_examples": f"WITH {_EXAMPLES} SELECT id, array_to_string(x, ' ') AS input_ids, array_to_string(y, ' ') AS labels, len(x) > 13 AS too_long FROM examples",
        "r9_padded": f"""WITH {_EXAMPLES}, w AS (SELECT *, CAST(ceil(max(len(x)) OVER (PARTITION BY id // 16) / 8) * 8 AS INT) - len(x) AS gap FROM examples WHERE len(x) <= 13)
SELECT id, array_to_string(list_concat(x, list_transform(range(0, gap), lambda i: 1)), ' ') AS input_ids, array_to_string(list_concat(y, list_transform(range(0, gap), lambda i: -100)), ' ') AS labels,
  array_to_string(list_concat(list_transform(x, lambda i: 1), list_transform(range(0, gap), lambda i: 0)), ' ') AS attention_mask FROM w""",
        "r10_schedule": """WITH r AS (SELECT c_custkey AS run, CAST(ceil(ceil((c_custkey % 2000 + 20) / 8) / 2) AS BIGINT) AS u FROM customer),
w AS (SELECT run, u, u * 5 AS total, greatest(1, CAST(round_even(u * 5 * 0.1, 0) AS BIGINT)) AS warmup, unnest(range(1, 6)) AS epoch FROM r)
SELECT run, epoch, u AS updates_per_epoch, total AS total_updates, warmup, u * epoch AS updates_done, round(CASE WHEN u * epoch < warmup THEN 2e-4 * u * epoch / warmup ELSE 2e-4 * (total - u * epoch) / (total - warmup) END, 12) AS learning_rate FROM w""",
        "r11_early_stopping": """WITH h AS (SELECT l_orderkey AS run, CAST(l_linenumber AS INT) AS epoch, max(CAST(l_quantity AS DOUBLE)) AS score FROM lineitem GROUP BY ALL),
i AS (SELECT *, coalesce(score > max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved, max(score) OVER (PARTITION BY run ORDER BY epoch) AS best FROM h),
s AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS since FROM i)
SELECT run, epoch, improved, best, CAST(since AS INT) AS since, since >= 2 AS stop FROM s""",
        "q1_tokens": f"SELECT doc_id, CAST(len({_TOKENS.format('text')}) AS INT) AS n_tokens, sha256(array_to_string({_TOKENS.format('text')}, ' ')) AS tokens_sha256 FROM documents",
        "q2_postings": f"WITH {_BM25} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM posted GROUP BY term",
        "q4_top_k": f"""WITH {_BM25}, every AS (SELECT item_id AS query_id, d.doc_id AS leaf_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(score, 0) DESC, d.doc_id) AS rank
  FROM benchmark b CROSS JOIN documents d LEFT JOIN scored s ON s.query_id = b.item_id AND s.leaf_id = d.doc_id)
SELECT query_id, leaf_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM every WHERE rank <= 5""",
        "q4_ranking": f"WITH {_BM25} SELECT query_id, leaf_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked",
        "q5_gold_ranks": f"WITH {_BM25} SELECT query_id, gold_leaf_id, gold_rank FROM ranks",
        "q13_report": f"WITH {_BM25} SELECT r.query_id, CAST(rank AS INT) AS rank, r.leaf_id, round(score, 6) AS score, r.leaf_id = g.gold_leaf_id AS is_gold, gold_rank FROM ranked r JOIN ranks g USING (query_id) WHERE rank <= 5",
        "q14_fingerprint": f"WITH h AS (SELECT sha256(doc_id || chr(0) || coalesce(text, '') || chr(0)) AS h FROM documents), {_order_free('h')} SELECT (SELECT count(*) FROM h) AS n_rows, h AS fingerprint FROM l3",
        "q10_dense": """WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS leaf_id, round(100 * list_dot_product(q.v, c.v), 6) AS score FROM e q, e c WHERE q.vec_id % 20 = 0)
SELECT query_id, leaf_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, leaf_id) AS INT) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, leaf_id) <= 5""",
        "q12_pairwise": """WITH q AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings),
f AS (SELECT label, arg_min(v, vec_id) AS v FROM q GROUP BY label)
SELECT q.vec_id AS query_id, round(list_dot_product(q.v, a.v), 6) AS gold_score, round(list_dot_product(q.v, b.v), 6) AS other_score FROM q JOIN f a ON a.label = q.label JOIN f b ON b.label = (q.label + 1) % (SELECT count(*) FROM f)""",
        "m1_micro": f"WITH {_BM25}, m AS (SELECT count(*) AS n_queries, {_means()}, list_sort(list(gold_rank))[count(*) // 2 + 1] AS median_rank FROM ranks) SELECT n_queries, {_ROUNDED}, CAST(median_rank AS BIGINT) AS median_rank FROM m",
        "m5_leaf": f"WITH {_BM25}, m AS (SELECT lang, count(*) AS n_queries, {_means()} FROM ranks GROUP BY lang) SELECT lang, n_queries, {_ROUNDED} FROM m",
        "m6_macro": f"WITH {_BM25}, m AS (SELECT lang, {_means()} FROM ranks GROUP BY lang) SELECT count(*) AS n_leaves, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in _MEASURES) + " FROM m",
        "m7_truncated": f"WITH {_BM25}, t AS (SELECT CASE WHEN gold_rank <= 5 THEN gold_rank END AS gold_rank FROM ranks), m AS (SELECT count(*) AS n_queries, {_means()} FROM t) SELECT n_queries, " + ", ".join(f"round({m}, 6) AS {m}" for m in _MEASURES[:-1]) + " FROM m",
        "m9_latency": "SELECT c_custkey AS run, round(CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_acctbal AS DOUBLE) * 1000 / (c_custkey % 7) END, 6) AS ms_per_query FROM customer",
        "c1_pairing": "SELECT CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 10 WHEN 4 THEN 'only in second' WHEN 3 THEN 'only in first' ELSE 'fields differ' END AS problem FROM documents WHERE doc_id % 10 IN (3, 4, 5)",
        "c3_outcomes": f"WITH {_PAIRED} SELECT outcome, (SELECT count(*) FROM paired WHERE CASE WHEN correct_a AND correct_b THEN 'both_correct' WHEN correct_a THEN 'first_only' WHEN correct_b THEN 'second_only' ELSE 'both_wrong' END = outcome) AS n FROM (VALUES ('both_correct'), ('first_only'), ('second_only'), ('both_wrong')) AS o(outcome)",
        "c2_retrievers": f"WITH {_RETRIEVERS} SELECT CAST(query_id AS VARCHAR) AS id, lang AS gold_leaf_id, ra = 1 AS correct_a, rb = 1 AS correct_b, CASE WHEN ra = 1 AND rb = 1 THEN 'both_correct' WHEN ra = 1 THEN 'first_only' WHEN rb = 1 THEN 'second_only' ELSE 'both_wrong' END AS outcome, 2 AS depth FROM both_",
        "c6_retrievers": f"WITH {_RETRIEVERS}, s AS (SELECT lang, count(*) AS n, avg((ra = 1)::INT) AS a, avg((rb = 1)::INT) AS b, avg((ra = 1 OR rb = 1)::INT) AS e FROM both_ GROUP BY lang) SELECT lang AS gold_leaf_id, n, round(a, 6) AS recall_a, round(b, 6) AS recall_b, round(e, 6) AS recall_either, round(b - a, 6) AS delta FROM s",
        "k8_retrievers": f"""WITH {_RETRIEVERS}, r AS (SELECT 'BM25' AS method, ra AS r FROM both_ UNION ALL SELECT 'Shared terms', rb FROM both_),
s AS (SELECT method, avg((r <= 1)::INT) AS a, avg((r <= 3)::INT) AS b, avg((r <= 5)::INT) AS c, avg(1.0 / r) AS m FROM r GROUP BY method)
SELECT '| Method | R@1 | R@3 | R@5 | MRR |' || chr(10) || '| --- | ---: | ---: | ---: | ---: |' || chr(10) || string_agg(printf('| %s | %.4f | %.4f | %.4f | %.4f |', method, a, b, c, m), chr(10) ORDER BY a DESC, method) AS markdown FROM s""",
        "c4_mcnemar": """WITH p AS (SELECT DISTINCT c_custkey % 60 AS b, c_custkey % 47 AS c FROM customer)
SELECT b, c, round(least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM unnest(range(0, least(b, c) + 1)) AS u(i))), 9) AS p_value FROM p""",
        "c7_strata": f"WITH {_PAIRED} SELECT depth, gold_leaf_id, n, round(recall_a, 6) AS recall_a, round(recall_b, 6) AS recall_b, round(recall_either, 6) AS recall_either, round(recall_b - recall_a, 6) AS delta FROM strata, (SELECT 3 AS depth) x",
        "c8_features": """WITH s AS (SELECT source, count(*) FILTER (WHERE doc_id % 10 < 7) AS train_count, count(*) FILTER (WHERE doc_id % 10 = 7 AND length(source) > 4) > 0 AS leaf_in_dev FROM documents GROUP BY 1)
SELECT CAST(doc_id AS VARCHAR) AS id, source AS gold_leaf_id, 2 AS depth, leaf_in_dev, train_count FROM documents JOIN s USING (source)""",
        "c9_relative": f"WITH {_PAIRED} SELECT gold_leaf_id, round(CASE WHEN recall_a <> 0 THEN (recall_b - recall_a) / recall_a END, 6) AS relative_change FROM strata",
        "c10_extremes": f"""WITH {_PAIRED}, s AS (SELECT gold_leaf_id, round(recall_b - recall_a, 9) AS delta FROM strata)
SELECT gold_leaf_id, round(delta, 6) AS delta, 'lowest' AS "end" FROM (SELECT * FROM s ORDER BY delta, gold_leaf_id LIMIT 5) x UNION ALL SELECT gold_leaf_id, round(delta, 6), 'highest' FROM (SELECT * FROM s ORDER BY delta DESC, gold_leaf_id LIMIT 5) y""",
        "c11_freeze": f"WITH {_PAIRED} SELECT method, round(coalesce(a, b), 6) AS recall_at_1 FROM results",
        "c12_tolerance": f"WITH {_PAIRED} SELECT method AS metric, CASE WHEN method <> 'src3' THEN round(b, 6) END AS actual, round(b, 3) AS expected FROM results WHERE method = 'src3' OR abs(b - round(b, 3)) > 5.1e-5",
        "k8_leaderboard": f"WITH {_PAIRED} SELECT '| Method | R@1 | R@3 | R@5 | MRR |' || chr(10) || '| --- | ---: | ---: | ---: | ---: |' || chr(10) || string_agg(printf('| %s | %.4f | %.4f | %.4f | %.4f |', method, b, e, 1.0::DOUBLE, e), chr(10) ORDER BY b DESC, method) AS markdown FROM results",
        "v1_ids": """WITH o AS (SELECT CASE WHEN doc_id % 17 = 0 THEN doc_id || 'x' WHEN doc_id % 19 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS id FROM (SELECT doc_id FROM documents WHERE doc_id % 11 <> 2 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 13 = 1) x)
SELECT CAST(doc_id AS VARCHAR) AS id, 'missing' AS problem FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT id FROM o)
UNION ALL SELECT DISTINCT id, 'extra' FROM o WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)
UNION ALL SELECT id, 'duplicate' FROM o GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'empty' FROM o WHERE id = ''""",
        "v2_counts": "SELECT coalesce(w.lang, g.lang) AS lang, expected, n FROM (VALUES ('en', 620::BIGINT), ('fr', 1), ('xx', 3)) AS w(lang, expected) FULL JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) g ON g.lang = w.lang WHERE expected IS DISTINCT FROM n",
        "v3_consistency": """WITH d AS (SELECT *, doc_id % 50 = 0 AS off, doc_id % 5 > doc_id % 7 AS turned, doc_id % 13 = 0 AS renamed, doc_id % 17 = 0 AS moved FROM documents)
SELECT doc_id AS id, problem FROM d, (VALUES ('empty'), ('character_count'), ('page range'), ('leaf title'), ('path')) AS p(problem)
WHERE CASE problem WHEN 'empty' THEN trim(text) = '' WHEN 'character_count' THEN length(text) <> n_chars + CASE WHEN off THEN 1 ELSE 0 END WHEN 'page range' THEN turned WHEN 'leaf title' THEN renamed ELSE moved END""",
        "v4_numbering": f"{lines} SELECT * FROM (SELECT doc_id || '-' || nr AS id, doc_id AS leaf_id, CAST(nr + 1 AS INT) AS number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS INT) AS expected FROM lines WHERE nr % 9 <> 4) x WHERE number <> expected",
        "v5_patterns": f"{lines} SELECT doc_id || '-' || nr AS id, problem FROM lines, (VALUES ('licence', '(?i)licen[cs]ed under'), ('mail', '@'), ('capitals', '[A-Z]{{6}}')) AS p(problem, pattern) WHERE regexp_matches(line, pattern)",
        "v6_questions": f"""{lines}, q AS (SELECT doc_id AS unit_id, line || CASE WHEN nr % 6 = 5 THEN '.' ELSE '?' END AS question FROM lines), k AS (SELECT *, {_KEY.format('question')} AS key FROM q)
SELECT unit_id, key, 'ill-formed' AS problem FROM k WHERE NOT ends_with(question, '?') OR question <> trim(question)
UNION ALL SELECT unit_id, key, 'repeated in unit' FROM k GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT min(unit_id), key, 'repeated across units' FROM k GROUP BY key HAVING count(DISTINCT unit_id) > 1""",
        "v7_unresolved": "SELECT doc_id AS unit_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 <> 1 AND doc_id % 6 <> 0",
        "v9_leakage": "SELECT doc_id AS source_unit_id, 2::BIGINT AS n_splits FROM documents WHERE doc_id % 40 = 7",
        "v10_coverage": f"""WITH {_UNITS}, bad AS (SELECT leaf_id, CASE WHEN leaf_id LIKE '%3' THEN 'train' WHEN leaf_id LIKE '%5' AND split = 'train' THEN 'test' ELSE coalesce(split, 'train') END AS split FROM covered),
h AS (SELECT leaf_id, count(*) AS n_units, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'test') AS b, count(*) FILTER (WHERE split = 'dev') AS c FROM bad GROUP BY 1)
SELECT leaf_id, n_units, split FROM h, (VALUES ('train'), ('test'), ('dev')) AS s(split) WHERE CASE split WHEN 'train' THEN a = 0 WHEN 'test' THEN (n_units >= 2) <> (b > 0) ELSE (n_units >= 3) <> (c > 0) END""",
        "v11_constraints": f"WITH {_UNITS} SELECT unit_id, 'dev' AS split FROM covered WHERE split_constraint = 'train_only' AND length(unit_id) = 4",
        "v12_difference": """SELECT doc_id, lang, sha256(text) AS text_sha256, 'first' AS side FROM documents WHERE doc_id % 21 = 0 OR doc_id % 25 = 1
UNION ALL SELECT doc_id, 'zz', sha256(text), 'second' FROM documents WHERE doc_id % 21 <> 0 AND doc_id % 25 = 1""",
        "v13_drift": _LABELS + "SELECT id, CASE WHEN length(query) % 4 = 0 THEN 'query' ELSE 'target' END AS problem FROM made WHERE method = 'id' AND (length(query) % 4 = 0 OR gold_leaf_id LIKE '%3')",
    }
