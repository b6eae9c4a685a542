"""Benchmark decontamination: a prefix-filtered set join over DataFrame operations only.

An item's windows are its runs of `window` consecutive words (a shorter item is one window). The tokens of a
window are its shingles of up to five words. A document contains a window only if it contains all of its tokens,
so one token is a sufficient prefix for exact containment: the rarest in the corpus. One pass over the documents
finds every place where a shingle of the benchmark stands and carries the words around it; from these places come
the corpus frequencies that order the tokens by rarity. A place of a window's prefix token then fixes where the
window would have to start (positional bound) and end (length bound), and the words there are compared with the
window's words (verification on item-sized windows).

Cost: documents are tokenised once; only places that hold a shingle of the benchmark leave the scan. The
benchmark's shingles are broadcast up to `BROADCAST_SHINGLES`. Beyond that documents send (shingle, position) pairs
to them, dealt by shingle and one of SALTS salts, so a very common shingle is spread; the places found return to
the texts, which are shuffled once, and take the words around them from there.

Defined cases: null or empty text has no words; items without words have no windows; items with equal texts are
each reported; a null item_id or doc_id never matches a benchmark item by that id but keeps its row; rows that
repeat a doc_id are separate rows; empty tables give zeros or no rows; texts and items may have any length; of
shingles that are equally rare the first in the window is the prefix, which changes no result; no other columns are
read, so these may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import settle

WINDOW = 10
SHINGLE = 5
#: Shingles up to this number are broadcast (about 30 bytes each); more are joined by a shuffle.
BROADCAST_SHINGLES = 500_000
SALTS = 16

#: Keys of contaminated documents up to this number are broadcast by drop_contaminated().
BROADCAST_KEYS = 500_000

_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Token of the place that every document has; it carries the document's number of words.
_WHOLE = 0


def raw_words(text: Column) -> Column:
    """Words of the text, in the case they have."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _APART), "")


def _ascii_lower(words: Column) -> Column:
    return F.transform(words, lambda w: F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _folded(words: Column) -> Column:
    """Words lower-cased in full: much faster than translate(), and words equal after A-Z are equal after this too.

    It only finds candidates, which are compared exactly afterwards.
    """
    return F.transform(words, lambda w: F.lower(w))


def _shingles(words: Column, size: int) -> Column:
    """Hash of the `size` words from each position on; past the end, of those there are."""
    return F.transform(words, lambda w, i: F.xxhash64(F.lit(size), w, *(F.get(words, i + j) for j in range(1, size))))


def _with_key(docs: DataFrame, *more: str) -> DataFrame:
    """Rows are told apart by doc_id and a hash of the text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), *more)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window_id, words, item_id): a row for each item and distinct window of it; words have A-Z lower-cased."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), _ascii_lower(raw_words(F.col("text"))).alias("w")).where("item_id IS NOT NULL AND size(w) > 0")
    rows = rows.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("at"))
    rows = rows.select("item_id", F.slice("w", F.col("at"), F.lit(window)).alias("words"))
    return rows.select(F.sha2(F.array_join("words", " "), 256).alias("window_id"), "words", "item_id").distinct()


def _window_tokens(windows: DataFrame) -> tuple[DataFrame, list[int]]:
    """(window_id, words, token, offset) for each shingle of each window, and the sizes that shingles have."""
    windows = windows.withColumn("size", F.least(F.size("words"), F.lit(SHINGLE)))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect()) or [SHINGLE]  # 1 to SHINGLE at most
    out = None
    for size in sizes:
        lists = windows.where(F.col("size") == size).withColumn("folded", _folded(F.col("words")))
        lists = lists.withColumn("tokens", F.slice(_shingles(F.col("folded"), size), F.lit(1), F.size("words") - size + 1))
        one = lists.select("window_id", "words", F.posexplode_outer("tokens").alias("offset", "token"))
        out = one if out is None else out.unionByName(one)
    return settle(out), sizes


def _places(docs: DataFrame, tokens: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """(doc_id, text_hash, token, pos, from_pos, near, n_words): where a benchmark shingle stands, with the words around it, and one row of token _WHOLE for each document."""
    known = tokens.select("token").union(docs.sparkSession.range(1).select(F.lit(_WHOLE).cast("bigint").alias("token"))).distinct()
    texts = _with_key(docs, "text").select("doc_id", "text_hash", raw_words(F.col("text")).alias("raw"))
    rows = texts.withColumn("folded", _folded(F.col("raw")))
    rows = rows.select("doc_id", "text_hash", "raw", F.concat(F.array(F.lit(_WHOLE).cast("bigint")), *(_shingles(F.col("folded"), s) for s in sizes)).alias("tokens"))
    # The outer form drops no rows; for the inner one the optimizer would add a filter on the array's size and
    # push it below, where it computes all the nested expressions once more in each other.
    if tokens.count() <= BROADCAST_SHINGLES:
        rows = rows.select("doc_id", "text_hash", "raw", F.posexplode_outer("tokens").alias("nth", "token")).join(F.broadcast(known), "token")
    else:
        rows = _with_words(rows.select("doc_id", "text_hash", F.posexplode_outer("tokens").alias("nth", "token")), known, texts)
    n = F.size("raw")
    pos = F.when(F.col("nth") > 0, (F.col("nth") - 1) % n)
    first = F.greatest(pos - (window - 1), F.lit(0))
    near = F.when(F.col("nth") > 0, F.slice("raw", first + 1, F.lit(2 * window - 1)))
    return settle(rows.select("doc_id", "text_hash", "token", pos.alias("pos"), first.alias("from_pos"), near.alias("near"), n.cast("bigint").alias("n_words")))


def _with_words(rows: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows (doc_id, text_hash, nth, token) of known tokens, with the document's words; no broadcast."""
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int"))
    found = dealt.join(salted, ["token", "salt"]).groupBy(F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2")).agg(F.collect_set(F.struct("nth", "token")).alias("places"))
    # Rows that repeat doc_id and text share their set of places, and each takes it once.
    back = texts.join(found, texts["doc_id"].eqNullSafe(F.col("k1")) & (texts["text_hash"] == F.col("k2")))
    return back.select("doc_id", "text_hash", "raw", F.explode("places").alias("p")).select("doc_id", "text_hash", "raw", "p.nth", "p.token")


def _hits(places: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, length, window_id) of each verified window."""
    # Rarity: a window with a shingle that stands nowhere can't occur; of the others the rarest shingle is the prefix.
    frequency = places.where(F.col("pos").isNotNull()).groupBy("token").agg(F.count("*").alias("frequency"))
    ordered = tokens.join(frequency, "token", "left").groupBy("window_id", "words").agg(
        F.min(F.struct("frequency", "offset", "token")).alias("prefix"), F.count_if(F.col("frequency").isNull()).alias("absent")
    )
    prefix = settle(ordered.where("absent = 0").select("window_id", "words", "prefix.token", "prefix.offset"))
    if prefix.count() <= BROADCAST_SHINGLES // 5:
        prefix = F.broadcast(prefix)
    start, length = F.col("pos") - F.col("offset"), F.size("words")
    pairs = places.where(F.col("pos").isNotNull()).join(prefix, "token")
    pairs = pairs.where((start >= 0) & (start + length <= F.col("n_words")))
    there = _ascii_lower(F.slice("near", F.greatest(start - F.col("from_pos"), F.lit(0)) + 1, length))
    return pairs.where(there == F.col("words")).select("doc_id", "text_hash", start.alias("start"), length.alias("length"), "window_id").distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text_hash, n_words) and the contaminated ones (doc_id, text_hash, n_hit, items)."""
    members = settle(item_windows(benchmark, window))
    tokens, sizes = _window_tokens(members.dropDuplicates(["window_id"]).drop("item_id"))
    places = _places(docs, tokens, sizes, window)
    hits = settle(_hits(places, tokens))
    # Words under any window: the length of the union of intervals, one running maximum per document.
    key = ["doc_id", "text_hash"]
    before = Window.partitionBy(*key).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    spans = hits.select(*key, "start", "length").distinct().withColumn("reached", F.coalesce(F.max(end).over(before), F.lit(0)))
    n_hit = spans.groupBy(*key).agg(F.sum(F.greatest(end - F.greatest("start", "reached"), F.lit(0))).cast("bigint").alias("n_hit"))
    items = hits.select(*key, "window_id").distinct().join(members.select("window_id", "item_id"), "window_id").groupBy(*key).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    both = n_hit.join(items, n_hit["doc_id"].eqNullSafe(items["doc_id"]) & (n_hit["text_hash"] == items["text_hash"])).select(n_hit["doc_id"], n_hit["text_hash"], "n_hit", "items")
    return places.where(F.col("pos").isNull()).select(*key, "n_words"), both


def contamination_digests(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    all_docs, found = find_contamination(docs, benchmark, window)
    joined = all_docs.join(found, all_docs["doc_id"].eqNullSafe(found["doc_id"]) & (all_docs["text_hash"] == found["text_hash"]), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        all_docs["doc_id"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with the same columns."""
    _, found = find_contamination(docs, benchmark, window)
    bad = settle(found.select("doc_id", "text_hash"))
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("k1"), F.xxhash64("text").alias("k2"))
    if bad.count() <= BROADCAST_KEYS:
        bad = F.broadcast(bad)
    kept = held.join(bad, held["k1"].eqNullSafe(bad["doc_id"]) & (held["k2"] == bad["text_hash"]), "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
