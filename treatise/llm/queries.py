"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, line_dedup, media, minhash, packing, pii, quality, sharding, suffix
from ._store import table


def _over_documents(operator: Callable[..., DataFrame], *more: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*(table(spark, sf_dir, t) for t in ("documents", *more)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": _over_documents(minhash.near_duplicate_digests),
        "op2_personal_data": _over_documents(pii.personal_data_digests),
        "op3_chat_format": lambda spark, sf_dir: chat.format_chats(table(spark, sf_dir, "conversations")),
        "op4_quality": _over_documents(quality.quality_scores, "labels"),
        "op5_packing": _over_documents(packing.pack_documents),
        "op6_sharding": _over_documents(sharding.shard_digests),
        "op7_media": _over_documents(media.media_digests),
        "op8_line_dedup": _over_documents(line_dedup.dedup_digests),
        "op9_repeated_bytes": _over_documents(suffix.repeat_digests),
        "op10_decontamination": _over_documents(decontamination.contamination_digests, "benchmark"),
    }


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = "regexp_extract_all(" + _LOWER.format("text") + ", '[^\\x20\\x09-\\x0D]+')"
_WORDS = "regexp_extract_all(" + _LOWER.format("text") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END, ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_ AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.b, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_ l ON l.a = d.doc_id"""

_OP3 = """
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1099511627776) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
  string_agg('<|' || role || '|>' || chr(10) || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prefix FROM t),
whole AS (SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE k = n GROUP BY ALL)
SELECT conv_id, 0 AS part, n AS n_turns, n_copies, prefix AS rendered FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.k < q.n AND q.k = w.n AND q.prefix = w.prefix)"""

_OP8 = f"""
WITH l AS (SELECT doc_id, i, t[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents) d, unnest(range(1, len(t) + 1)) AS u(i)),
k AS (SELECT *, {_LOWER.format("regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')")} AS key FROM l),
h AS (SELECT doc_id, i, line, length(key) < 10 OR doc_id = min(doc_id) OVER (PARTITION BY key) AS kept FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT kept) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE kept), '')) AS kept_sha256 FROM h GROUP BY doc_id"""

_OP10 = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM doc, (SELECT DISTINCT n FROM win) z, unnest(range(1, len(w) - n + 2)) AS u(i)),
hit AS (SELECT doc_id, i, n, item_id FROM place JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS v(p) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS x FROM hit GROUP BY doc_id)
SELECT doc.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(x), 0) AS n_items, sha256(coalesce(array_to_string(x, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN words ON words.doc_id = doc.doc_id LEFT JOIN items ON items.doc_id = doc.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The others need tokens, fitted weights, random draws, checksums of 8-bit samples or byte strings: tests/llm has plain versions of them."""
    return {"op1_near_duplicates": _OP1, "op3_chat_format": _OP3, "op8_line_dedup": _OP8, "op10_decontamination": _OP10}
