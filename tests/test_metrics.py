import math

from pyspark.sql import functions as F

from treatise.operators import metrics, ranking, retriever, split


def test_mcnemar_goldens(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (5, 5), (284, 239)], "b bigint, c bigint")
    got = {(r.b, r.c): r.p_value for r in metrics.mcnemar(rows).collect()}
    assert got[0, 0] == 1 and got[0, 1] == 1 and got[5, 5] == 1
    assert abs(got[284, 239] - 0.054252450292862) < 1e-11


def test_apportionment_golden(spark):
    got = {t: {} for t in (0, 1, 2, 3, 3214)}
    for r in split.apportion(spark.createDataFrame([(t, t) for t in got], "k bigint, total bigint"), keys=("k",)).collect():
        got[r.k][r.split] = r.target
    assert got[3214] == {"train": 1064, "dev": 391, "test": 1759}
    assert all(sum(v.values()) == t for t, v in got.items())


def test_schedule_golden(spark):
    run = spark.createDataFrame([(1, 1064, 8, 2, 5, 2e-4)], "run int, n_examples int, batch int, accumulation int, epochs int, rate double")
    rows = {r.epoch: r for r in retriever.schedule(run).collect()}
    assert (rows[1].updates_per_epoch, rows[1].total_updates, rows[1].warmup) == (67, 335, 34)
    assert abs(rows[1].learning_rate - 2e-4 * 268 / 301) < 1e-15 and rows[5].learning_rate == 0


def test_early_stopping_ties(spark):
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate([0.3, 0.375, 0.375, 0.2], 1)], "run string, epoch int, score double")
    assert [(r.improved, r.stop) for r in retriever.early_stopping(rows).orderBy("epoch").collect()] == [(True, False), (True, False), (False, False), (False, True)]


def test_metrics_with_nulls(spark):
    ranks = spark.createDataFrame([("a", r) for r in (1, 2, 3, 4, 6, None)], "gold_leaf_id string, gold_rank int")
    m = metrics.micro_metrics(ranks).first()
    assert math.isclose(m.recall_at_3, 0.5) and math.isclose(m.mrr, (1 + 1 / 2 + 1 / 3 + 1 / 4 + 1 / 6) / 6) and m.median_rank == 3
    assert math.isclose(m.ndcg_at_3, (1 + 1 / math.log2(3) + 0.5) / 6)


def test_split_of_small_leaves(spark):
    rows = [(f"u{leaf}-{i}", f"l{leaf}", 1 + i % 3, "train_only" if (leaf, i) == (9, 0) else None) for leaf in (1, 2, 3, 4, 9) for i in range(leaf)]
    records = spark.createDataFrame(rows, "unit_id string, leaf_id string, n_questions bigint, split_constraint string")
    got = split.split_units(records).collect()
    assert len(got) == len(rows) and all(r.split in split.SPLITS for r in got)
    by = {}
    for r in got:
        by.setdefault(r.leaf_id, set()).add(r.split)
    assert by["l1"] == {"train"} and by["l2"] == {"train", "test"} and by["l3"] == by["l4"] == by["l9"] == set(split.SPLITS)
    assert next(r.split for r in got if r.split_constraint) == "train"


def test_ranking_without_cross_product_equals_full_ranking(spark):
    texts = ["red fox jumps", "red fox", "blue whale", "red red whale", "", "green tea", "red fox", "whale fox"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "leaf_id bigint, text string")
    queries = spark.createDataFrame([(1, "red fox red"), (2, "whale"), (3, "nothing here"), (4, "tea")], "query_id bigint, query string")
    scores = ranking.bm25_scores(docs, queries)
    full = {(r.query_id, r.leaf_id): r["rank"] for r in ranking.rank_all(scores, queries, docs).collect()}
    top = {(r.query_id, r.leaf_id): r["rank"] for r in ranking.top_k(scores, queries, docs, 5).collect()}
    assert top == {k: v for k, v in full.items() if v <= 5}
    for leaf in range(len(texts)):
        golds = queries.select("query_id", F.lit(leaf).cast("bigint").alias("gold_leaf_id"))
        assert {r.query_id: r.gold_rank for r in ranking.gold_ranks(scores, golds, docs).collect()} == {q: full[q, leaf] for q in (1, 2, 3, 4)}


def test_trie(spark):
    targets = spark.createDataFrame([("m", ["a", "b"]), ("m", ["a"]), ("m", ["c", "d"])], "method string, tokens array<string>")
    trie = retriever.token_trie(targets, ["method"])
    got = {r.prefix: r.next_tokens for r in trie.collect()}
    assert got == {"": ["a", "c"], "a": ["<eos>", "b"], "a b": ["<eos>"], "c": ["d"], "c d": ["<eos>"]}
    walks = spark.createDataFrame([("m", "a"), ("m", "c d x")], "method string, prefix string")
    assert {r.prefix: r.next_tokens for r in retriever.allowed_next(walks, trie, ["method"]).collect()} == {"a": ["<eos>", "b"], "c d x": ["<eos>"]}


def test_beams(spark):
    rows = [("full", ["a ", "b", "c", "d", "e"], [0.0, -1.0, -2.0, -3.0, -4.0], "lc"), ("short", ["a", "x"], [0.0, -1.0], "lb"), ("none", [], [], "la")]
    beams = spark.createDataFrame(rows, "id string, beams array<string>, scores array<double>, gold_leaf_id string")
    catalog = spark.createDataFrame([(t, "l" + t) for t in "abcde"], "target string, leaf_id string")
    assert {r.id: r.gold_rank_at_k for r in retriever.rank_beams(beams, catalog).collect()} == {"full": 3, "short": None}
    assert sorted(tuple(r) for r in retriever.ranked_targets(beams, catalog).where("id = 'full' AND rank < 3").collect()) == [("full", 1, "a", "la", 0.0), ("full", 2, "b", "lb", -1.0)]
    assert sorted((r.id, r.target, r.problem) for r in retriever.beam_violations(beams, catalog).collect() if r.target) == [("short", "x", "unknown target")]
    assert {r.id for r in retriever.beam_violations(beams, catalog).where("problem = 'beam count'").collect()} == {"short", "none"}


def test_upper_median(spark):
    for ranks in ([4, 1, 3, 2], [1, 2, 3], [5], [1, 1, 9, 9, None], [None]):
        known = sorted(r for r in ranks if r is not None)
        got = metrics.micro_metrics(spark.createDataFrame([(r,) for r in ranks], "gold_rank int")).first().median_rank
        assert got == (known[len(known) // 2] if known else None)


def test_bootstrap_interval(spark):
    """The published outcome counts: the interval of 10,000 resamples, up to the draws' own spread."""
    counts = {(True, True): 421, (True, False): 284, (False, True): 239, (False, False): 814}
    rows = [(a, b) for (a, b), n in counts.items() for _ in range(n)]
    paired = spark.createDataFrame(rows, "correct_a boolean, correct_b boolean")
    low, median, high = metrics.bootstrap(paired).first()
    assert abs(low + 0.050626) < 0.002 and abs(median + 0.026166) < 0.002 and abs(high) < 0.002
    assert metrics.bootstrap(paired).first() == (low, median, high)


def _filled(rows, targets):
    """The rule one unit at a time, over all units in one list."""
    import hashlib

    key = lambda x: hashlib.sha256(f"42:{x}".encode()).hexdigest()
    counts = {s: sum(n for _, _, n, a in rows if a == s) for s in split.SPLITS}
    there = {(leaf, a) for _, leaf, _, a in rows if a}
    left = {}
    for unit, leaf, n, a in sorted(rows, key=lambda r: key(r[0])):
        if a is None:
            left.setdefault(leaf, []).append((unit, n))
    out = {}
    for depth in range(max(map(len, left.values()), default=0)):
        for leaf in sorted(left, key=key):
            if depth < len(left[leaf]):
                unit, n = left[leaf][depth]
                score = lambda s: (round((targets[s] - counts[s]) / targets[s], 6) if targets[s] else float("-inf"), (leaf, s) not in there)
                best = max(split.SPLITS, key=score)
                counts[best] += n
                there.add((leaf, best))
                out[unit] = best
    return out


def test_fill_against_the_rule(spark):
    import random

    rng = random.Random(11)
    for seed, targets in enumerate(({"train": 60, "dev": 30, "test": 90}, {"train": 40, "dev": 40, "test": 40}, {"train": 0, "dev": 5, "test": 50})):
        rows = [(f"u{seed}-{i}", f"l{rng.randint(1, 12)}", rng.randint(1, 6), rng.choice([None, None, None, "train", "test", "dev"])) for i in range(80)]
        covered = spark.createDataFrame(rows, "unit_id string, leaf_id string, n_questions bigint, split string").withColumn("unit_key", F.sha2(F.concat(F.lit("42:"), "unit_id"), 256))
        assert {r.unit_id: r.split for r in split.fill(covered, targets).collect()} == _filled(rows, targets)


def test_golds_and_report(spark):
    docs = spark.createDataFrame([(1, "the red fox jumps over it"), (2, "xthe red foxy jumps"), (3, "one"), (4, ""), (5, "the red fox jumps over it all")], "leaf_id bigint, text string")
    asked = ["he red fox jumps over i", "red fox", "one", "e r", "fox red the", "the red fox jumps over it", "unseen word here now", "on"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    corpus = ranking.index(docs)
    want = {i: min((r.leaf_id for r in docs.collect() if q in r.text), default=None) for i, q in enumerate(asked)}
    golds = ranking.verbatim_golds(corpus, queries)
    assert {r.query_id: r.gold_leaf_id for r in golds.collect()} == {i: g for i, g in want.items() if g is not None}
    scores = ranking.bm25_scores(corpus, queries)
    rows = ranking.query_report(scores, golds, docs).collect()
    full = {(r.query_id, r.leaf_id): r["rank"] for r in ranking.rank_all(scores, queries, docs).collect()}
    assert all(full[r.query_id, r.leaf_id] == r["rank"] and r.is_gold == (r.leaf_id == want[r.query_id]) and r.gold_rank == full[r.query_id, want[r.query_id]] for r in rows)
    assert len(rows) == 5 * golds.count()


def test_dense_search_equals_the_whole_ranking(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ranking, "BLOCK_VECTORS", 7)
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (60, 4)).astype(float).tolist()  # with ties and, perhaps, zeros
    vectors[5] = [0.0] * 4
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id bigint, vector array<double>").repartition(3)
    queries, candidates = rows.where("id % 20 < 2").withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "leaf_id")
    for k in (1, 5, 100):
        found = {tuple(r) for r in ranking.dense_search(queries, candidates, k).select("query_id", "leaf_id", "rank", F.round("score", 5)).collect()}
        assert found == {tuple(r) for r in ranking.dense_ranking(queries, candidates, k).select("query_id", "leaf_id", "rank", F.round("score", 5)).collect()}
