"""The operators applied to the driver's tables, one query per operator or chain of operators.

Hosts adapt the tables: regions, nations and suppliers are outlines; lines of documents are blocks and paragraphs
(some replaced by lines that the cleaning rules are about); benchmark items are queries and documents candidates;
orders are units of questions and their customers the leaves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import rounded
from ..functions.settled import settle, shared_folder
from ..operators import checks, cleaning, metrics, outline, questions, ranking, retriever, sections, split
from ..sources import io
from ..sources.io import read_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


# --- hosts -----------------------------------------------------------------------------------------------------

OUTLINE_SQL = """
SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY b, c) AS INT) AS position, CAST(level AS INT) AS level, title,
       CAST(floor((row_number() OVER (PARTITION BY book ORDER BY b, c) - 1) / 10) AS INT) + 1 AS page
FROM (SELECT r_name AS book, -1 AS b, -1 AS c, 1 AS level, CASE WHEN r_regionkey % 2 = 0 THEN 'Chapter ' ELSE 'Part ' END || r_name AS title FROM {region}
      UNION ALL SELECT r_name, n_nationkey, -1, 2, n_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
      UNION ALL SELECT r_name, n_nationkey, s_suppkey, 3, CASE WHEN s_suppkey % 9 = 0 THEN ' Media Attributions ' ELSE s_name END
      FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey) AS o
"""


def _outline(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(OUTLINE_SQL, region=_table(spark, d, "region"), nation=_table(spark, d, "nation"), supplier=_table(spark, d, "supplier"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return outline.outline_nodes(_outline(spark, d), ["book"])


def _lines(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))


# What stands in for a line, by the remainder of 31 * doc_id + position; shared with the SQL.
NOISE = {
    0: "'URL: http://example.org/a'",
    1: "'ab/cd'",
    2: "'An interactive H5P element has been excluded from this version of the text. See it.'",
    3: "'12-18 months'",
    4: "'• ' || line",
    5: "'and so on, at length'",
    6: "'◦ ' || line",
    7: "CASE WHEN position > 6 THEN 'Media Attributions' ELSE line END",
    8: "'(Smith, 2001).'",
}
NOISE_SQL = "CASE " + " ".join(f"WHEN (31 * doc_id + position) % 23 = {k} THEN {v}" for k, v in NOISE.items()) + " ELSE line END"


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).where("trim(line) <> ''").select("doc_id", (F.col("at") + 1).cast("int").alias("position"), "line")
    page = (F.floor(F.col("position") / 40) + 1).cast("int")
    return rows.select(F.col("doc_id").alias("leaf_id"), "position", F.trim(F.expr(NOISE_SQL)).alias("text"), page.alias("page_start"), page.alias("page_end"), F.format_string("%s-p%03d", F.col("doc_id").cast("string"), F.col("position")).alias("id"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each line is a block; its geometry follows from its number, and every 12th block is a heading."""
    n = F.col("at")
    rows = _lines(spark, d).select("doc_id", (F.floor(n / 30) + 1).cast("int").alias("page"), (n % 30).cast("int").alias("block_no"), F.col("line").alias("text"), "at")
    y0 = 30.0 + F.col("block_no") * 25.0
    x0 = F.when(F.col("at") % 5 == 3, 70.0).otherwise(57.0)
    x1 = F.when(F.col("at") % 4 == 1, 400.0).otherwise(555.0)
    leaf = F.struct(F.when(F.floor(F.col("at") / 12) % 3 != 2, F.concat_ws("-", F.col("doc_id").cast("string"), F.floor(F.col("at") / 12).cast("string"))).alias("leaf_id"), F.col("text").alias("leaf_title"))
    rows = rows.withColumn("heading", F.when(F.col("at") % 12 == 0, leaf))
    return rows.select("doc_id", "page", "block_no", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + F.when(F.col("at") % 7 == 0, 10.0).otherwise(22.0)).alias("y1"), "text", F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), "heading")


def _corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidates (leaf_id, text) and queries (query_id, query)."""
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("leaf_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs, _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    """Gold ranks of the items that a document holds as they are, which is their gold."""
    ranks = ranking.gold_ranks(*_searched(spark, d))
    return ranks.join(_table(spark, d, "documents").select(F.col("doc_id").alias("gold_leaf_id"), "lang"), "gold_leaf_id")


def _units(spark: SparkSession, d: str) -> DataFrame:
    """Orders as units with one to seven questions; every 50th may only be trained on."""
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("unit_id"), F.col("o_custkey").cast("string").alias("leaf_id"), "o_orderkey")
    return rows.select("unit_id", "leaf_id", (F.col("o_orderkey") % 7 + 1).cast("bigint").alias("n_questions"), F.when(F.col("o_orderkey") % 50 == 0, "train_only").alias("split_constraint"))


def _paired(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings of the same queries, as formulas of the document's number."""
    docs = _table(spark, d, "documents").select("doc_id", "lang", "source")
    rank = lambda a, m: F.col("doc_id") * a % m + 1
    base = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("gold_leaf_id"), F.concat_ws(" > ", F.lit("root"), "lang", "source").alias("canonical_path"), rank(7, 3).alias("ra"), rank(11, 4).alias("rb"))
    a = base.select("id", "gold_leaf_id", "canonical_path", F.col("ra").alias("gold_rank"))
    b = base.select("id", F.when(F.col("rb") <= 3, F.col("rb")).alias("gold_rank"))
    return metrics.pair(a, b)


# --- queries ---------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


def s1_json_array(spark, d):
    """Nations written as one array and read again."""
    rows, path = _table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), _folder(spark)
    io.write_json_array(rows, path, "n_nationkey")
    return io.read_json_array(spark, path, rows.schema)


def s2_jsonl(spark, d):
    """S2, K2; fields that are null are left out of their line and come back as null."""
    rows = _table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    path = _folder(spark)
    io.write_jsonl(rows, path)
    return io.read_jsonl(spark, path, rows.schema)


def s3_missing(spark, d):
    return io.read_jsonl(spark, f"{_folder(spark)}/none.jsonl", _table(spark, d, "customer").select("c_custkey", "c_name").schema, missing_ok=True)


def s4_first_record(spark, d):
    rows, path = _table(spark, d, "region").select("r_regionkey", "r_name"), _folder(spark)
    io.write_jsonl(rows.coalesce(1).sortWithinPartitions("r_regionkey"), path)
    return io.first_record(spark, path, rows.schema)


def s7_text_blocks(spark, d):
    return io.text_blocks(_page_texts(spark, d), [])


def s9_vectors(spark, d):
    path = _folder(spark)
    rows = _table(spark, d, "embeddings")
    io.replace_table(rows.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")), path)
    return io.read_vectors(spark, path).select("id", F.size("embedding").alias("n"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


def k4_batches(spark, d):
    """Batch 0 is written twice, as after a failure."""
    rows, path = _table(spark, d, "region").select(F.col("r_name").alias("name"), "r_regionkey"), _folder(spark)
    for batch, part in ((0, rows.where("r_regionkey = 0")), (1, rows.where("r_regionkey % 2 = 1")), (0, rows.where("r_regionkey % 2 = 0"))):
        io.append_batch(part.select("name"), path, batch)
    return spark.read.schema("name string, batch int").json(path)


def k5_quarantine(spark, d):
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").alias("unit_id"), F.array(F.lit("q?")).alias("questions"), F.when(F.col("o_orderkey") % 7 == 0, "no array").alias("error"))
    kept, failed = (f"{_folder(spark)}/{x}" for x in ("kept", "failed"))
    io.write_quarantine(*questions.route(rows), kept, failed)
    accepted = spark.read.schema("unit_id bigint, questions array<string>").json(kept).select("unit_id", F.lit(None).cast("string").alias("error"), F.lit(True).alias("accepted"))
    return accepted.unionByName(spark.read.schema("unit_id bigint, error string").json(failed).select("unit_id", "error", F.lit(False).alias("accepted")))


def k6_manifest(spark, d):
    return io.manifest({"nation": _table(spark, d, "nation")})


def k7_replace(spark, d):
    rows, path = _table(spark, d, "supplier").select("s_suppkey", "s_name"), _folder(spark)
    for keep in (1, 0):
        io.replace_table(rows.where(F.col("s_suppkey") % 2 == keep), path)
    return spark.read.parquet(path)


def t1_outline_nodes(spark, d):
    return _nodes(spark, d).select("book", "position", "level", "title", "parent_position", "id", "parent_id", "canonical_path", "depth", "is_leaf", "is_retrieval_leaf")


def t8_profile(spark, d):
    return outline.profile(_outline(spark, d))


def t9_repeated_titles(spark, d):
    return outline.repeated_titles(_nodes(spark, d).where("is_leaf").select("title", F.concat_ws("/", "book", "id").alias("id")))


def _page_texts(spark, d):
    body = F.regexp_replace("html", "<[^>]*>", "\n")
    return _table(spark, d, "pages").select(F.col("page_id").alias("page"), body.alias("text"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"))


def t10_heading_coverage(spark, d):
    pages = _page_texts(spark, d)
    return outline.heading_coverage(pages.select("page", "title"), pages.select("page", F.when(F.col("page") % 3 != 0, F.col("text")).alias("text")))


def t11_block_coverage(spark, d):
    pages = _page_texts(spark, d)
    blocks = pages.select("page", F.explode(F.split("text", "\n")).alias("text")).where((F.col("page") % 4 != 0) | (F.length("text") < 20))
    return outline.block_coverage(pages.select("page", F.when(F.col("page") % 5 == 0, F.substring("title", 1, 12)).otherwise(F.col("title")).alias("title")), blocks)


def t12_labels(spark, d):
    return outline.retrieval_labels(_nodes(spark, d)).select("leaf_id", "title", "canonical_path")


def k3_render_outline(spark, d):
    return outline.render_outline(_outline(spark, d), ["book"])


def s8_parse_outline(spark, d):
    return outline.parse_outline(outline.render_outline(_outline(spark, d).withColumn("title", F.trim("title")), ["book"]), ["book"])


def p2_sections(spark, d):
    """Lines of a document in pages of 10; the first line of every page, whole, is a heading."""
    rows = _lines(spark, d).select("doc_id", (F.floor(F.col("at") / 10) + 1).cast("int").alias("page"), "at", "line")
    pages = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l")).select("doc_id", "page", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    nodes = rows.where("at % 10 = 0 AND trim(line) <> ''").select("doc_id", (F.floor(F.col("at") / 10) + 1).cast("int").alias("position"), "page", F.trim("line").alias("title"))
    return sections.slice_sections(sections.locate_headings(nodes, pages, ["doc_id"]), pages, ["doc_id"]).select("doc_id", "position", "page", "text", "character_count")


def p3_heading_priority(spark, d):
    """Blocks around the whole line; each fifth one is asked for a title that may be only its beginning."""
    rows = _lines(spark, d).where("trim(line) <> ''")
    kind = F.col("at") % 5
    title = T.normalize(F.when(kind == 4, F.substring("line", 1, 24)).otherwise(F.col("line")))
    block = F.when(kind == 1, F.concat(F.lit("x\n"), "line", F.lit("\ny"))).when(kind == 2, F.concat(F.lit("7 "), F.upper(title))).when(kind == 3, F.concat(title, F.lit(" | 12"))).otherwise(F.col("line"))
    return rows.select("doc_id", F.col("at").alias("block_no"), sections.heading_priority(block, title).cast("int").alias("priority"))


def p4_heading_blocks(spark, d):
    blocks = _blocks(spark, d).drop("heading")
    nodes = blocks.where("block_no % 6 = 2").select("doc_id", "page", F.col("block_no").alias("position"), F.col("text").alias("title")).where("trim(title) <> ''")
    return sections.assign_headings(nodes, blocks, ["doc_id"])


def p9_paragraphs(spark, d):
    return sections.paragraphs(_blocks(spark, d), ["doc_id"]).select("doc_id", "leaf_id", "id", "page_start", "page_end", "text", "character_count")


def p10_length_stats(spark, d):
    return sections.length_stats(_lines(spark, d).select(F.length("line").alias("character_count")))


def p11_extremes(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("character_count"))
    return sections.extremes(docs, 5, True).withColumn("end", F.lit("shortest")).unionByName(sections.extremes(docs, 5, False).withColumn("end", F.lit("longest")))


def u5_removals(spark, d):
    return cleaning.classify_noise(_paragraphs(spark, d), ["leaf_id"]).select("id", "leaf_id", "reason")


def _step(*steps):
    def run(spark, d):
        units, _ = cleaning.remove_noise(_paragraphs(spark, d), ["leaf_id"])
        for step in steps:
            units = step(units, ["leaf_id"])
        return units.select("leaf_id", "position", "text", "page_start", "page_end", F.array_join("source_ids", ",").alias("source_ids"), F.array_join("reasons", ",").alias("reasons"))

    return run


u6_backward_fragments = _step(cleaning.merge_backward_fragments)
u7_age_bands = _step(cleaning.merge_age_bands)
u8_labels = _step(cleaning.merge_labels)
u9_bullets = _step(cleaning.group_bullets)
u10_continuations = _step(cleaning.merge_continuations)
u11_label_sentences = _step(cleaning.merge_labels, cleaning.complete_labels)


def u13_units(spark, d):
    units, _ = cleaning.generation_units(_paragraphs(spark, d), ["leaf_id"])
    return units.select("id", "leaf_id", "text", "page_start", "page_end", F.array_join("source_ids", ",").alias("source_ids"), F.array_join("reasons", ",").alias("reasons"), "character_count")


def u12_foreign_sources(spark, d):
    paragraphs = _paragraphs(spark, d)
    units, _ = cleaning.generation_units(paragraphs, ["leaf_id"])
    return cleaning.foreign_sources(units, paragraphs, ["leaf_id"])


def u14_provenance(spark, d):
    paragraphs = _paragraphs(spark, d)
    units, removed = cleaning.remove_noise(paragraphs, ["leaf_id"])
    return cleaning.unaccounted(paragraphs, cleaning.merge_labels(units, ["leaf_id"]), removed)


def u15_reason_histogram(spark, d):
    units, removed = cleaning.remove_noise(_paragraphs(spark, d), ["leaf_id"])
    return cleaning.reason_histogram(cleaning.merge_age_bands(units, ["leaf_id"]), removed)


def _sized(spark, d):
    return _lines(spark, d).select(F.format_string("%d-%d", "doc_id", "at").alias("id"), "doc_id", "at", F.col("line").alias("text"), F.length("line").alias("character_count"))


def g1_counts(spark, d):
    return _sized(spark, d).groupBy(questions.requested_count(F.col("character_count")).alias("requested")).agg(F.count("*").alias("n"))


def g2_prompts(spark, d):
    rows = _sized(spark, d)
    return rows.select("id", F.sha2(questions.prompt(F.col("text"), questions.requested_count(F.col("character_count"))), 256).alias("prompt_sha256"))


def g4_clean_questions(spark, d):
    """Model output made of a document's whole lines: arrays with repeats, objects, blanks and cut-off ends."""
    q = F.concat(F.translate("line", '"\\', ""), F.lit("?"))
    item = F.when(F.col("at") % 4 == 0, F.to_json(F.struct(q.alias("question")))).otherwise(F.concat(F.lit('"'), q, F.lit('"')))
    lists = _lines(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", item.alias("item")))).alias("l"))
    body = F.concat(F.lit("Sure: ["), F.array_join(F.concat(F.transform("l", lambda x: x["item"]), F.transform("l", lambda x: F.upper(x["item"]))), ", "), F.lit("]"))
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(body, F.lit(" done"))).when(F.col("doc_id") % 5 == 1, F.replace(body, F.lit("]"), F.lit(', "open]'))).when(F.col("doc_id") % 5 == 2, F.replace(F.replace(body, F.lit("["), F.lit("[[")), F.lit("]"), F.lit("]]"))).when(F.col("doc_id") % 5 == 3, F.replace(body, F.lit("["))).otherwise(body)
    out = questions.clean_questions(lists.select(F.col("doc_id").alias("unit_id"), F.lit(6).alias("expected_count"), raw.alias("raw_output")))
    return out.select("unit_id", F.array_join("questions", "|").alias("questions"), "error")


def g5_pending(spark, d):
    rows = _sized(spark, d)
    return questions.pending(rows, rows.where("at % 3 = 0").select(F.col("id").alias("unit_id"))).select("id")


def g6_first_pending(spark, d):
    return questions.first_pending(_sized(spark, d), 10, "id").select("id", "character_count")


def g7_planned_totals(spark, d):
    return questions.planned_totals(_sized(spark, d))


def g8_batches(spark, d):
    return questions.batched(_sized(spark, d), 4, "at", "doc_id").select("id", F.col("batch").cast("bigint").alias("batch"))


def g10_fenced(spark, d):
    line = F.translate("line", '"\\', "")
    raw = F.concat(F.lit('```json\n{"questions": ["'), line, F.lit('?"'), F.when(F.col("at") % 3 == 0, F.concat(F.lit(', "'), line, F.lit('!"'))).otherwise(""), F.lit("]}\n```"))
    return _lines(spark, d).select("doc_id", F.col("at").alias("line_no"), F.array_join(questions.parse_fenced(raw), "|").alias("questions"))


def d2_targets(spark, d):
    totals = _units(spark, d).groupBy("leaf_id").agg(F.sum("n_questions").alias("total"))
    return split.apportion(totals, keys=("leaf_id",)).select("leaf_id", "split", F.col("target").cast("bigint").alias("target"))


def d6_covered(spark, d):
    return split.cover(_units(spark, d)).select("unit_id", "leaf_id", "split")


def d7_interleaved(spark, d):
    return split.interleave(split.cover(_units(spark, d))).select("unit_id", F.col("depth").cast("int").alias("depth"), "leaf_key")


def d8_split(spark, d):
    return split.split_units(_units(spark, d)).select("unit_id", "leaf_id", "n_questions", "split")


def d9_questions(spark, d):
    rows = _units(spark, d)
    asked = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("n_questions")), lambda i: F.concat(F.lit("What is "), i.cast("string"), F.lit(" of "), F.col("unit_id"), F.lit("?")))
    return split.explode_questions(rows.withColumn("questions", asked), split.cover(rows))


def d10_split_counts(spark, d):
    return split.split_counts(split.cover(_units(spark, d)).where("split IS NOT NULL"))


def _label_table(spark, d):
    return outline.retrieval_labels(_nodes(spark, d)).select(F.concat_ws("/", F.element_at("path", 1), "leaf_id").alias("leaf_id"), "title", "canonical_path")


def _asked(spark, d):
    labels = _label_table(spark, d)
    return labels, labels.select(F.concat_ws("?", "leaf_id", F.lit("q")).alias("id"), F.concat(F.lit("Where is "), F.col("title"), F.lit("?")).alias("query"), F.col("leaf_id").alias("gold_leaf_id"), F.when(F.length("leaf_id") % 3 == 0, "elsewhere").otherwise(F.col("canonical_path")).alias("gold_path"))


def r1_label_violations(spark, d):
    labels, rows = _asked(spark, d)
    return retriever.label_violations(rows, labels.where("leaf_id NOT LIKE '%7'"))


def r2_method_rows(spark, d):
    labels, rows = _asked(spark, d)
    return retriever.method_rows(rows, labels).select("id", "query", "gold_leaf_id", "method", "target")


def r3_prompts(spark, d):
    labels, rows = _asked(spark, d)
    toc = outline.render_outline(_outline(spark, d), ["book"]).select(F.col("outline").alias("toc"), F.regexp_extract("outline", r"\A- ([^\n]*)", 1).alias("root"))
    made = retriever.method_rows(rows, labels).join(toc, F.split("gold_leaf_id", "/")[0] == F.col("root"))
    by_id = retriever.render_prompt(retriever.ID_PROMPT, query=F.col("query"))
    by_path = retriever.render_prompt(retriever.PATH_PROMPT, toc=F.col("toc"), query=F.col("query"))
    return made.select("id", "method", F.sha2(F.when(F.col("method") == "id", by_id).otherwise(by_path), 256).alias("prompt_sha256"))


def r4_catalog(spark, d):
    labels, rows = _asked(spark, d)
    return retriever.target_catalog(retriever.method_rows(rows, labels))


def _targets(spark, d):
    return _nodes(spark, d).where("is_leaf").select("book", F.split("canonical_path", " ").alias("tokens"))


def r5_trie(spark, d):
    return retriever.token_trie(_targets(spark, d), ["book"]).select("book", "prefix", F.array_join("next_tokens", "|").alias("next_tokens"))


def r6_allowed_next(spark, d):
    walks = _targets(spark, d).select("book", F.array_join(F.slice("tokens", 1, 2), " ").alias("prefix")).distinct()
    walks = walks.unionByName(walks.select("book", F.concat("prefix", F.lit(" nowhere")).alias("prefix")))
    return retriever.allowed_next(walks, retriever.token_trie(_targets(spark, d), ["book"]), ["book"]).select("book", "prefix", F.array_join("next_tokens", "|").alias("next_tokens"))


def _beams(spark, d):
    """Five beams a document with a score each, four for every ninth; three of 23 targets are unknown."""
    docs = _table(spark, d, "documents")
    last = F.when(F.col("doc_id") % 9 == 0, 3).otherwise(4)
    names = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(F.lit("t"), ((F.col("doc_id") * 7 + i * 5) % 23).cast("string")))
    scores = F.transform(F.sequence(F.lit(0), last), lambda i: F.lit(0.0) - i * F.lit(0.5).cast("double"))
    predictions = docs.select(F.col("doc_id").alias("id"), names.alias("beams"), scores.alias("scores"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("gold_leaf_id"))
    catalog = spark.range(20).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("target"), F.concat(F.lit("src"), F.col("id").cast("string")).alias("leaf_id"))
    return predictions, F.broadcast(catalog)


def r7_beams(spark, d):
    return retriever.rank_beams(*_beams(spark, d))


def r7_ranked_targets(spark, d):
    return retriever.ranked_targets(*_beams(spark, d))


def r7_beam_violations(spark, d):
    return retriever.beam_violations(*_beams(spark, d))


def _examples(spark, d):
    seq = lambda n, m: F.transform(F.sequence(F.lit(1), n), lambda i: i * m)
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), seq((F.col("o_orderkey") % 9 + 1).cast("int"), 3).alias("prompt_ids"), seq((F.col("o_custkey") % 5 + 1).cast("int"), 2).alias("target_ids"), F.lit(0).alias("end_id"))
    return retriever.training_examples(rows, 13)


def r8_examples(spark, d):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return _examples(spark, d).select("id", text("input_ids"), text("labels"), "too_long")


def r9_padded(spark, d):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    rows = _examples(spark, d).where("NOT too_long").withColumn("batch", F.floor(F.col("id") / 16))
    return retriever.pad_batches(rows, 1).select("id", text("input_ids"), text("labels"), text("attention_mask"))


def r10_schedule(spark, d):
    runs = _table(spark, d, "customer").select(F.col("c_custkey").alias("run"), (F.col("c_custkey") % 2000 + 20).alias("n_examples"), F.lit(8).alias("batch"), F.lit(2).alias("accumulation"), F.lit(5).alias("epochs"), F.lit(2e-4).alias("rate"))
    out = retriever.schedule(runs)
    return out.select("run", *(F.col(c).cast("bigint").alias(c) for c in ("epoch", "updates_per_epoch", "total_updates", "warmup", "updates_done")), F.round("learning_rate", 12).alias("learning_rate"))


def r11_early_stopping(spark, d):
    rows = _table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_quantity").cast("double")).alias("score"))
    return retriever.early_stopping(rows.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("int").alias("epoch"), "score")).select("run", "epoch", "improved", "best", F.col("since").cast("int").alias("since"), "stop")


def q1_tokens(spark, d):
    words = T.tokens(F.coalesce("text", F.lit("")))
    return _table(spark, d, "documents").select("doc_id", F.size(words).alias("n_tokens"), F.sha2(F.array_join(words, " "), 256).alias("tokens_sha256"))


def q2_postings(spark, d):
    posted = ranking.postings(_corpus(spark, d)[0])
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def q4_top_k(spark, d):
    docs, items = _corpus(spark, d)
    return ranking.top_k(settle(ranking.bm25_scores(docs, items)), items, docs).select("query_id", "leaf_id", rounded(F.col("score"), 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def _scored(spark, d):
    """(scores, golds, docs) of the items with a gold; the scores are settled by those who read them twice."""
    docs, items = _corpus(spark, d)
    corpus = ranking.index(docs)
    golds = settle(ranking.verbatim_golds(corpus, items))
    return ranking.bm25_scores(corpus, items.join(golds, "query_id", "left_semi")), golds, docs


def _searched(spark, d):
    scores, golds, docs = _scored(spark, d)
    return settle(scores), golds, docs


def q4_ranking(spark, d):
    """Every candidate for every item with a gold, as many rows as the product of both has."""
    return ranking.rank_all(*_scored(spark, d)).select("query_id", "leaf_id", rounded(F.col("score"), 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def q13_report(spark, d):
    rows = ranking.query_report(*_searched(spark, d))
    return rows.select("query_id", F.col("rank").cast("int").alias("rank"), "leaf_id", rounded(F.col("score"), 6).alias("score"), "is_gold", "gold_rank")


def q5_gold_ranks(spark, d):
    return _ranks(spark, d).select("query_id", "gold_leaf_id", "gold_rank")


def q10_dense(spark, d):
    """The vectors whose id is divisible by 20 ask all vectors."""
    rows = _table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    found = ranking.dense_search(rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "leaf_id"))
    return found.select("query_id", "leaf_id", "score", F.col("rank").cast("int").alias("rank"))


def q12_pairwise(spark, d):
    """Is a vector nearer to its own label's first vector than to the next label's."""
    rows = _table(spark, d, "embeddings")
    ids = rows.columns[0]
    firsts = rows.groupBy("label").agg(F.min(ids).alias("lead")).join(rows.select(F.col(ids).alias("lead"), F.col("embedding").alias("v")), "lead")
    n = firsts.count()
    asked = rows.select(F.col(ids).alias("query_id"), "label", ranking.l2_normalize(F.col("embedding")).alias("q"), ((F.col("label") + 1) % n).alias("other"))
    own = firsts.select("label", ranking.l2_normalize(F.col("v")).alias("g"))
    out = asked.join(own, "label").join(own.select(F.col("label").alias("other"), F.col("g").alias("o")), "other")
    return out.select("query_id", F.round(ranking.dot(F.col("q"), F.col("g")), 6).alias("gold_score"), F.round(ranking.dot(F.col("q"), F.col("o")), 6).alias("other_score"))


def q14_fingerprint(spark, d):
    return ranking.corpus_fingerprint(_corpus(spark, d)[0])


def _rounded(df, *keep):
    return df.select(*keep, *(F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) for c, t in df.dtypes if c not in keep))


def m1_micro(spark, d):
    return _rounded(metrics.micro_metrics(_ranks(spark, d)))


def m5_leaf(spark, d):
    return _rounded(metrics.leaf_metrics(_ranks(spark, d), "lang"), "lang")


def m6_macro(spark, d):
    return _rounded(metrics.macro_metrics(_ranks(spark, d), "lang"))


def m7_truncated(spark, d):
    """At five beams, as many as the published evaluations have."""
    return _rounded(metrics.micro_metrics(metrics.truncate(_ranks(spark, d), retriever.BEAMS)).drop("mean_rank", "median_rank"))


def m9_latency(spark, d):
    ms = metrics.milliseconds_per_query(F.col("c_acctbal").cast("double"), F.col("c_custkey") % 7)
    return _table(spark, d, "customer").select(F.col("c_custkey").alias("run"), F.round(ms, 6).alias("ms_per_query"))


def c1_pairing(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("query"), F.col("source").alias("gold_leaf_id"), "doc_id")
    changed = docs.where("doc_id % 10 <> 3").withColumn("query", F.when(F.col("doc_id") % 10 == 5, "xx").otherwise(F.col("query")))
    return metrics.pairing_violations(docs.where("doc_id % 10 <> 4"), changed)


def c3_outcomes(spark, d):
    return metrics.outcome_histogram(_paired(spark, d))


def _retrievers(spark, d):
    """Gold ranks of the same items by BM25 and by shared terms: two tables (id, gold_leaf_id, canonical_path, gold_rank)."""
    docs, items = _corpus(spark, d)
    corpus = ranking.index(docs)
    golds = settle(ranking.verbatim_golds(corpus, items))
    asked = items.join(golds, "query_id", "left_semi")
    facts = _table(spark, d, "documents").select(F.col("doc_id").alias("gold_leaf_id"), F.col("lang"), F.concat_ws(" > ", "lang", "source").alias("canonical_path"))
    for scores in (ranking.bm25_scores(corpus, asked), ranking.overlap_scores(corpus, asked)):
        ranks = ranking.gold_ranks(settle(scores), golds, docs).join(facts, "gold_leaf_id")
        yield ranks.select(F.col("query_id").cast("string").alias("id"), F.col("lang").alias("gold_leaf_id"), "canonical_path", "gold_rank")


def c2_retrievers(spark, d):
    """C2 on real rankings."""
    return metrics.pair(*_retrievers(spark, d)).select("id", "gold_leaf_id", "correct_a", "correct_b", "outcome", "depth")


def c6_retrievers(spark, d):
    """C6, C7 on real rankings, by language."""
    return _rounded(metrics.stratum_metrics(metrics.pair(*_retrievers(spark, d)), ["gold_leaf_id"]), "gold_leaf_id")


def k8_retrievers(spark, d):
    """K8 of the same two retrievers."""
    rows = [metrics.micro_metrics(ranks).select(F.lit(name).alias("method"), "recall_at_1", "recall_at_3", "recall_at_5", "mrr") for name, ranks in zip(("BM25", "Shared terms"), _retrievers(spark, d))]
    return metrics.leaderboard(rows[0].unionByName(rows[1]))


def c4_mcnemar(spark, d):
    rows = _table(spark, d, "customer").select((F.col("c_custkey") % 60).alias("b"), (F.col("c_custkey") % 47).alias("c")).distinct()
    return metrics.mcnemar(rows).select("b", "c", F.round("p_value", 9).alias("p_value"))


def c5_bootstrap(spark, d):
    return metrics.bootstrap(_paired(spark, d))


def c7_strata(spark, d):
    return _rounded(metrics.stratum_metrics(_paired(spark, d), ["depth", "gold_leaf_id"]), "depth", "gold_leaf_id")


def c8_features(spark, d):
    docs = _table(spark, d, "documents")
    splits = docs.select(F.col("source").alias("gold_leaf_id"), F.when(F.col("doc_id") % 10 < 7, "train").when((F.col("doc_id") % 10 == 7) & (F.length("source") > 4), "dev").otherwise("test").alias("split"))
    base = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("gold_leaf_id"), F.concat_ws(" > ", "lang", "source").alias("canonical_path"), (F.col("doc_id") % 3 + 1).alias("gold_rank"))
    return metrics.pair(base, base, splits).select("id", "gold_leaf_id", "depth", "leaf_in_dev", "train_count")


def c9_relative(spark, d):
    rows = metrics.stratum_metrics(_paired(spark, d), ["gold_leaf_id"])
    return rows.select("gold_leaf_id", F.round(metrics.relative_change(F.col("recall_a"), F.col("recall_b")), 6).alias("relative_change"))


def c10_extremes(spark, d):
    rows = metrics.stratum_metrics(_paired(spark, d), ["gold_leaf_id"]).withColumn("delta", F.round("delta", 9))
    return metrics.extremes(rows, "gold_leaf_id").select("gold_leaf_id", F.round("delta", 6).alias("delta"), "end")


def _results(spark, d):
    rows = metrics.stratum_metrics(_paired(spark, d), ["gold_leaf_id"])
    return rows.select(F.col("gold_leaf_id").alias("method"), F.when(F.length("gold_leaf_id") > 4, F.col("recall_a")).alias("recall_at_1_a"), F.col("recall_b").alias("recall_at_1_b"), "recall_either")


def c11_freeze(spark, d):
    return _results(spark, d).select("method", F.round(metrics.first_present("recall_at_1_a", "recall_at_1_b"), 6).alias("recall_at_1"))


def c12_tolerance(spark, d):
    rows = _results(spark, d).select(F.col("method").alias("metric"), F.col("recall_at_1_b").alias("actual"))
    expected = rows.select("metric", F.round("actual", 3).alias("expected"))
    return metrics.tolerance_violations(rows.where("metric <> 'src3'"), expected).select("metric", F.round("actual", 6).alias("actual"), "expected")


def k8_leaderboard(spark, d):
    rows = _results(spark, d)
    return metrics.leaderboard(rows.select("method", F.col("recall_at_1_b").alias("recall_at_1"), F.col("recall_either").alias("recall_at_3"), F.lit(1.0).alias("recall_at_5"), F.col("recall_either").alias("mrr")))


def v1_ids(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id")
    observed = docs.where("doc_id % 11 <> 2").unionByName(docs.where("doc_id % 13 = 1")).select(F.when(F.col("doc_id") % 17 == 0, F.concat("id", F.lit("x"))).when(F.col("doc_id") % 19 == 0, "").otherwise(F.col("id")).alias("id"))
    return checks.id_violations(docs, observed).select("id", "problem")


def v2_counts(spark, d):
    return checks.count_violations(_table(spark, d, "documents"), {"en": 620, "fr": 1, "xx": 3}, "lang")


def v3_consistency(spark, d):
    title, path = F.concat(F.lit("On "), F.col("source")), F.array(F.lit("root"), F.col("source"))
    docs = _table(spark, d, "documents").where("source IS NOT NULL")
    nodes = docs.select(F.col("source").alias("leaf_id"), title.alias("title"), path.alias("path")).distinct()
    rows = docs.select(F.col("doc_id").alias("id"), "text", (F.col("n_chars") + F.when(F.col("doc_id") % 50 == 0, 1).otherwise(0)).alias("character_count"), (F.col("doc_id") % 5).alias("page_start"), (F.col("doc_id") % 7).alias("page_end"),
        F.col("source").alias("leaf_id"), F.when(F.col("doc_id") % 13 == 0, "else").otherwise(title).alias("leaf_title"), F.when(F.col("doc_id") % 17 == 0, F.array(F.lit("root"))).otherwise(path).alias("path"))
    return checks.consistency_violations(rows, nodes=nodes)


def v4_numbering(spark, d):
    rows = _lines(spark, d).where("at % 9 <> 4").select(F.format_string("%d-%d", "doc_id", "at").alias("id"), "doc_id", F.col("at"))
    return checks.numbering_violations(rows, "doc_id", F.col("at") + 1).select("id", "leaf_id", F.col("number").cast("int").alias("number"), F.col("expected").cast("int").alias("expected"))


def v5_patterns(spark, d):
    rows = _lines(spark, d).select(F.format_string("%d-%d", "doc_id", "at").alias("id"), F.col("line").alias("text"))
    return checks.pattern_violations(rows, {"licence": "(?i)licen[cs]ed under", "mail": "@", "capitals": "[A-Z]{6}"})


def v6_questions(spark, d):
    q = F.concat("line", F.when(F.col("at") % 6 == 5, ".").otherwise("?"))
    rows = _lines(spark, d).groupBy(F.col("doc_id").alias("unit_id")).agg(F.collect_list(q).alias("questions"))
    return checks.question_violations(rows)


def v7_unresolved(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("unit_id"))
    return checks.unresolved_failures(docs.where("id % 3 = 0"), docs.where("id % 4 <> 1"), docs.where("id % 6 = 0").select("unit_id"))


def v9_leakage(spark, d):
    rows = _table(spark, d, "documents").select(F.col("doc_id").alias("source_unit_id"), F.lit("train").alias("split"))
    return checks.leakage_violations(rows.unionByName(rows.where("source_unit_id % 40 = 7").withColumn("split", F.lit("dev"))))


def v10_coverage(spark, d):
    split_ = F.when(F.endswith("leaf_id", F.lit("3")), "train").when(F.endswith("leaf_id", F.lit("5")) & (F.col("split") == "train"), "test").otherwise(F.coalesce("split", F.lit("train")))
    return checks.coverage_violations(split.cover(_units(spark, d)).withColumn("split", split_))


def v11_constraints(spark, d):
    rows = split.cover(_units(spark, d)).withColumn("split", F.when(F.length("unit_id") == 4, "dev").otherwise(F.col("split")))
    return checks.constraint_violations(rows)


def v12_difference(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("text_sha256"))
    return checks.difference_violations(docs, docs.where("doc_id % 21 <> 0").withColumn("lang", F.when(F.col("doc_id") % 25 == 1, "zz").otherwise(F.col("lang"))))


def v13_drift(spark, d):
    labels, rows = _asked(spark, d)
    made = retriever.method_rows(rows, labels)
    catalog = retriever.target_catalog(made).where("leaf_id NOT LIKE '%3'").select("target", "leaf_id").dropDuplicates(["target"])
    made = made.where("method = 'id'").withColumn("query", F.when(F.length("query") % 4 == 0, F.concat("query", F.lit(" "))).otherwise(F.col("query")))
    return checks.drift_violations(made, rows, catalog)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = "tkspugdrqmcv"
    return {n: f for n, f in globals().items() if callable(f) and n[0] in names and n[1:2].isdigit()}
