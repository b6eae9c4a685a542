"""Lexical and dense retrieval with a deterministic order of all candidates.

Scores are rounded to 9 digits before they are ranked. Sums and means don't depend on the order in which rows
arrive, so equal documents tie and a run repeats the last one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded, steady_sum
from ..functions.settled import settle
from ..functions.text import order_free_hash, tokens, with_term_counts, with_tokens

# The constants of Okapi BM25, and the share of the mean weight that replaces negative ones.
K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 9
TOP = 5
#: Rows of queries, their terms or golds up to this number are broadcast (about 60 bytes each, or a query's text).
BROADCAST_ROWS = 200_000
#: Vectors of one block of a dense search; a product of two blocks has 32 MB.
BLOCK_VECTORS = 2048


def postings(docs: DataFrame) -> DataFrame:
    """Q1, Q2: (leaf_id, term, tf, dl) of docs(leaf_id, text)."""
    terms = docs.select("leaf_id", tokens(F.col("text")).alias("t"))
    terms = terms.select("leaf_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return terms.groupBy("leaf_id", "dl", "term").agg(F.count("*").alias("tf"))


def _bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A settled table, broadcast if its rows are that few."""
    return F.broadcast(df) if df.count() <= rows else df


def _raw_weight(n: int) -> Column:
    return F.ln(n - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)


@dataclass(frozen=True)
class Index:
    """Q2: a corpus as BM25 sees it: (leaf_id, terms, tfs, dl) of its documents, (term, df) of its vocabulary, and their means."""

    docs: DataFrame
    counted: DataFrame
    vocabulary: DataFrame
    n: int
    avgdl: float
    mean: float

    def weights(self) -> DataFrame:
        """(term, idf)"""
        raw = _raw_weight(self.n)
        return self.vocabulary.select("term", F.when(raw < 0, EPSILON * self.mean).otherwise(raw).alias("idf"))


def index(docs: DataFrame) -> Index:
    """Q2: docs(leaf_id, text) tokenised once; what is shuffled is a count per term and task."""
    counted = settle(with_term_counts(docs.select("leaf_id", "text"), "text"))
    n, total = counted.agg(F.count("*"), F.sum("dl")).first()
    vocabulary = settle(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    mean = vocabulary.agg(F.coalesce(steady_sum(_raw_weight(n)) / F.count("*"), F.lit(0.0))).first()[0]
    return Index(docs, counted, vocabulary, n, total / n if n else 0.0, mean)


def bm25_scores(corpus: DataFrame | Index, queries: DataFrame) -> DataFrame:
    """Q3: (query_id, leaf_id, score) of the pairs that share a term; query terms count as often as they occur.

    A document's terms meet the queries' weights where the document is, so a pair's sum is complete before it is
    shuffled.
    """
    known = corpus if isinstance(corpus, Index) else index(corpus)
    asked = with_term_counts(queries.select("query_id", "query"), "query").select("query_id", F.explode(F.arrays_zip("terms", "tfs")).alias("e"))
    asked = asked.groupBy("query_id", "e.terms").agg(F.sum("e.tfs").alias("times")).withColumnRenamed("terms", "term")
    weighted = settle(asked.join(known.weights(), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")))
    posted = known.counted.select("leaf_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select("leaf_id", "dl", F.col("e.terms").alias("term"), F.col("e.tfs").alias("tf"))
    tf = F.col("tf")
    part = F.col("weight") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / known.avgdl))
    hits = posted.join(_bounded(weighted), "term").select("query_id", "leaf_id", part.alias("part"))
    # A sum of 0 ranks like no shared term at all.
    return hits.groupBy("query_id", "leaf_id").agg(rounded(steady_sum(F.col("part")), DIGITS).alias("score")).where("score <> 0")


def overlap_scores(corpus: Index, queries: DataFrame) -> DataFrame:
    """(query_id, leaf_id, score): the number of distinct terms that a query and a document share, a plain retriever to compare with."""
    asked = settle(with_term_counts(queries.select("query_id", "query"), "query").select("query_id", F.explode("terms").alias("term")))
    held = corpus.counted.select("leaf_id", F.explode("terms").alias("term"))
    return held.join(_bounded(asked), "term").groupBy("query_id", "leaf_id").agg(F.count("*").cast("double").alias("score"))


def verbatim_golds(corpus: Index, queries: DataFrame) -> DataFrame:
    """(query_id, gold_leaf_id): the smallest document that holds a query's text as it stands.

    All of a query's tokens but the first and the last are whole tokens of such a document, so it is looked up by
    the rarest of these, and only the documents found are searched. Queries of one or two tokens may begin and end
    inside words and are searched for in all documents.
    """
    rows = settle(with_tokens(queries.select("query_id", "query", F.col("query").alias("_text")), "_text"))
    inner = rows.where("size(t) > 2").select("query_id", F.explode(F.slice("t", F.lit(2), F.size("t") - 2)).alias("term"))
    known = inner.join(corpus.vocabulary, "term", "left")
    rarest = known.groupBy("query_id").agg(F.min(F.struct("df", "term")).alias("rarest"), F.count_if(F.col("df").isNull()).alias("absent"))
    rarest = settle(rarest.where("absent = 0").select("query_id", "rarest.term"))
    held = corpus.counted.select("leaf_id", F.explode("terms").alias("term"))
    pairs = settle(held.join(_bounded(rarest), "term").select("query_id", "leaf_id").join(queries, "query_id"))
    found = corpus.docs.join(_bounded(pairs), "leaf_id").where(F.contains("text", F.col("query"))).select("query_id", "leaf_id")
    short = rows.where("size(t) <= 2").select("query_id", "query")
    if not short.isEmpty():
        found = found.unionByName(corpus.docs.join(_bounded(short), F.contains("text", F.col("query"))).select("query_id", "leaf_id"))
    return found.groupBy("query_id").agg(F.min("leaf_id").alias("gold_leaf_id"))


def rank_all(scores: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Q4: (query_id, leaf_id, score, rank) over every candidate, by score and then id; candidates without a shared term score 0.

    This is the reference semantics for candidate sets of a book's size; top_k() and gold_ranks() avoid its cross
    product of queries and candidates.
    """
    pairs = queries.select("query_id").crossJoin(docs.select("leaf_id"))
    full = pairs.join(scores, ["query_id", "leaf_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return full.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "leaf_id")))


def top_k(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int = TOP) -> DataFrame:
    """Q6: the first k of rank_all() without the cross product.

    The k best of the scored pairs and, for queries with fewer than k positive scores, the first candidates
    without a score. `scores` is read twice, so it should be settled.
    """
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "leaf_id"))
    scored = scores.withColumn("r", best).where(F.col("r") <= k).drop("r")
    enough = scores.where("score > 0").groupBy("query_id").agg(F.count("*").alias("positive")).where(F.col("positive") >= k)
    short = settle(queries.select("query_id").join(enough, "query_id", "left_anti"))
    if short.isEmpty():
        return scored.withColumn("rank", best)
    both = scored.unionByName(_first_unscored(scores.join(_bounded(short), "query_id", "left_semi"), short, docs, k).withColumn("score", F.lit(0.0)))
    return both.withColumn("rank", best).where(F.col("rank") <= k)


def _first_unscored(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, leaf_id): for each query the k smallest ids without a score, from the gaps between those with one."""
    ids = settle(numbered_ids(docs))
    n = ids.count()
    ends = queries.select("query_id", F.lit(n).cast("bigint").alias("nth"))
    taken = scores.join(ids, "leaf_id").select("query_id", "nth").unionByName(ends)
    order = Window.partitionBy("query_id").orderBy("nth")
    gap = taken.select("query_id", "nth", F.coalesce(F.lag("nth").over(order), F.lit(-1)).alias("before"), (F.row_number().over(order) - 1).alias("r"))
    # So many free ids stand before the gap.
    gap = gap.withColumn("free", F.col("before") + 1 - F.col("r")).where((F.col("nth") - F.col("before") > 1) & (F.col("free") < k))
    gap = gap.select("query_id", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("nth") - 1, F.col("before") + k - F.col("free")))).alias("nth"))
    return ids.join(_bounded(settle(gap)), "nth").select("query_id", "leaf_id")


def query_report(scores: DataFrame, golds: DataFrame, docs: DataFrame, k: int = TOP) -> DataFrame:
    """Q13: the first k candidates of each query with a gold, whether one is the gold, and the gold's rank."""
    ranks = gold_ranks(scores, golds, docs)
    rows = top_k(scores, golds.select("query_id"), docs, k).join(ranks, "query_id")
    return rows.select("query_id", "rank", "leaf_id", "score", (F.col("leaf_id") == F.col("gold_leaf_id")).alias("is_gold"), "gold_rank")


def gold_ranks(scores: DataFrame, golds: DataFrame, docs: DataFrame) -> DataFrame:
    """Q5: (query_id, gold_leaf_id, gold_rank), the gold's place in rank_all() without the cross product.

    Candidates without a score stand between the positive and the negative scores, by id; only golds among these
    need the number of smaller ids. `scores` is read twice, so it should be settled.
    """
    golds = settle(golds.select("query_id", "gold_leaf_id"))
    mine = scores.join(_bounded(golds).withColumnRenamed("gold_leaf_id", "leaf_id"), ["query_id", "leaf_id"]).select("query_id", F.col("leaf_id").alias("gold_leaf_id"), F.col("score").alias("gold_score"))
    gold = settle(golds.join(mine, ["query_id", "gold_leaf_id"], "left"))
    before = (F.col("score") > F.col("gold_score")) | ((F.col("score") == F.col("gold_score")) & (F.col("leaf_id") < F.col("gold_leaf_id")))
    counts = scores.join(_bounded(gold), "query_id").groupBy("query_id", "gold_leaf_id").agg(
        F.count_if(before).alias("ahead"), F.count("score").alias("scored"), F.count_if(F.col("score") > 0).alias("positive"), F.count_if(F.col("leaf_id") < F.col("gold_leaf_id")).alias("scored_smaller")
    )
    out = gold.join(counts, ["query_id", "gold_leaf_id"], "left").fillna(0, ["ahead", "scored", "positive", "scored_smaller"])
    n = docs.count()
    behind = F.when(F.col("gold_score") < 0, n - F.col("scored")).otherwise(0)
    ranked = out.where("gold_score IS NOT NULL").select("query_id", "gold_leaf_id", (F.col("ahead") + 1 + behind).cast("int").alias("gold_rank"))
    bare = out.where("gold_score IS NULL")
    if gold.where("gold_score IS NULL").isEmpty():
        return ranked
    ids = settle(numbered_ids(docs)).withColumnRenamed("leaf_id", "gold_leaf_id")
    unscored = F.col("positive") + F.col("nth") - F.col("scored_smaller") + 1
    return ranked.unionByName(bare.join(ids, "gold_leaf_id").select("query_id", "gold_leaf_id", unscored.cast("int").alias("gold_rank")))


def numbered_ids(docs: DataFrame) -> DataFrame:
    """(leaf_id, nth): each candidate's number, from 0, in the order of ids; they are sorted in ranges, not in one task."""
    # Settled first: both uses must see the same ranges under the same numbers.
    ids = settle(docs.select("leaf_id").repartitionByRange("leaf_id")).withColumn("part", F.spark_partition_id())
    starts = ids.groupBy("part").agg(F.min("leaf_id").alias("low"), F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ids.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("leaf_id")) - 1)
    # One row a partition, whatever the corpus holds.
    return ranked.join(F.broadcast(starts.select("part", "before")), "part").select("leaf_id", (F.col("before") + F.col("at")).alias("nth"))


def l2_normalize(vector: Column) -> Column:
    """Q8: doubles of unit length; a zero vector stays."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def dot(a: Column, b: Column) -> Column:
    """Q9"""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dense_ranking(queries: DataFrame, candidates: DataFrame, k: int | None = TOP) -> DataFrame:
    """Q9, Q10: (query_id, leaf_id, score, rank) by dot product of normalised vectors, in percent, over all pairs.

    For candidate sets of a book's size, which may be asked for whole rankings; dense_search() is for many.
    """
    left = queries.select("query_id", l2_normalize(F.col("vector")).alias("q"))
    right = candidates.select("leaf_id", l2_normalize(F.col("vector")).alias("c"))
    scored = left.crossJoin(right).select("query_id", "leaf_id", F.round(100 * dot(F.col("q"), F.col("c")), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "leaf_id")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def _vector_blocks(rows: DataFrame, name: str) -> DataFrame:
    """One row (ids, vectors, n) for up to BLOCK_VECTORS vectors; bytes of numbers and of unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_VECTORS):
                part = batch.slice(at, BLOCK_VECTORS)
                vectors = np.array(part.column("vector").to_pylist(), np.float64)
                size = np.sqrt((vectors * vectors).sum(1, keepdims=True))
                unit = np.divide(vectors, size, out=vectors, where=size > 0)
                ids = part.column(name).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (ids, unit)] + [pa.array([len(ids)], pa.int32())], names=["ids", "vectors", "n"])

    return rows.select(F.col(name).cast("bigint").alias(name), "vector").mapInArrow(run, "ids binary, vectors binary, n int")


def dense_search(queries: DataFrame, candidates: DataFrame, k: int = TOP) -> DataFrame:
    """Q10: (query_id, leaf_id, score, rank): the k first candidates of dense_ranking() for bigint ids and many vectors.

    Blocks of queries meet blocks of candidates, one matrix product each; a pair of blocks gives k rows a query, so
    what is ranked in the end is k rows for each query and block of candidates.
    """
    left = _vector_blocks(queries, "query_id").select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q"), F.col("n").alias("q_n"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q, q_n, ids, c, n in zip(*(batch.column(x).to_pylist() for x in ("q_ids", "q", "q_n", "ids", "vectors", "n"))):
                q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                scores = np.round(100 * np.frombuffer(q).reshape(q_n, -1) @ np.frombuffer(c).reshape(n, -1).T, 6)
                # Ties with the k-th score stay until ids decide.
                least = np.partition(scores, max(0, n - k), 1)[:, max(0, n - k)]
                row, column = np.nonzero(scores >= least[:, None])
                order = np.lexsort((ids[column], -scores[row, column], row))
                row, column = row[order], column[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, column = row[keep], column[keep]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids[column]), pa.array(scores[row, column])], names=["query_id", "leaf_id", "score"])

    found = left.crossJoin(_vector_blocks(candidates, "leaf_id")).mapInArrow(best, "query_id bigint, leaf_id bigint, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "leaf_id")))
    return ranked.where(F.col("rank") <= k)


def corpus_fingerprint(docs: DataFrame) -> DataFrame:
    """Q14, V8: one row (n_rows, fingerprint), a hash of the bytes of all ids and texts that does not depend on their order."""
    rows = docs.select(F.sha2(F.concat(F.col("leaf_id").cast("string"), F.lit("\0"), F.coalesce("text", F.lit("")), F.lit("\0")), 256).alias("h"))
    return order_free_hash(rows).withColumnRenamed("h", "fingerprint")


def cache_is_valid(cached: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """Q14: one row: do the metadata rows agree in all columns (nulls agree with nulls)."""
    same = None
    for c in columns:
        one = F.col(f"c.{c}").eqNullSafe(F.col(f"w.{c}"))
        same = one if same is None else same & one
    return cached.alias("c").crossJoin(wanted.alias("w")).select(same.alias("valid"))
