"""One seeded violation, or more, for each check, and none in what is right."""

from pyspark.sql import functions as F

from treatise.operators import checks


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ids_and_counts(spark):
    ids = lambda x: spark.createDataFrame([(v,) for v in x], "id string")
    assert _rows(checks.id_violations(ids("abc"), ids("bccd"))) == [("a", "missing"), ("c", "duplicate"), ("d", "extra")]
    assert [r.problem for r in checks.id_violations(ids("a"), ids(["a", None, ""])).collect()].count("empty") == 2
    assert checks.id_violations(ids("abc"), ids("cab")).count() == 0
    assert {r.id for r in checks.count_violations(ids("aabc"), {"a": 2, "b": 2, "d": 1}, "id").collect()} == {"b", "c", "d"}


def test_consistency(spark):
    schema = "id string, leaf_id string, text string, character_count int, page_start int, page_end int, leaf_title string, path array<string>"
    rows = spark.createDataFrame([("ok", "l", "abc", 3, 1, 1, "T", ["r", "T"]), ("a", "l", " ", 2, 2, 1, "T", ["r", "T"]), ("b", "l", "x", 1, 1, 2, "U", ["T"]), ("c", "none", "x", 1, 1, 2, "U", ["T"])], schema)
    nodes = spark.createDataFrame([("l", "T", ["r", "T"])], "leaf_id string, title string, path array<string>")
    assert _rows(checks.consistency_violations(rows)) == [("a", "character_count"), ("a", "empty"), ("a", "page range")]
    assert _rows(checks.consistency_violations(rows, nodes=nodes)) == [("a", "character_count"), ("a", "empty"), ("a", "page range"), ("b", "leaf title"), ("b", "path")]


def test_numbering_patterns_questions(spark):
    rows = spark.createDataFrame([("a-1", "a", 1), ("a-3", "a", 3), ("b-1", "b", 1)], "id string, leaf string, number int")
    assert _rows(checks.numbering_violations(rows, "leaf", F.col("number"))) == [("a-3", "a", 3, 2)]
    texts = spark.createDataFrame([("a", "x@y"), ("b", "z")], "id string, text string")
    assert _rows(checks.pattern_violations(texts, {"mail": "@", "z": "z"})) == [("a", "mail"), ("b", "z")]
    records = spark.createDataFrame([("u", ["One?", "one ?", "ONE?"]), ("v", ["one?", "no mark", " lead?"])], "unit_id string, questions array<string>")
    assert _rows(checks.question_violations(records)) == [("u", "one?", "repeated across units"), ("u", "one?", "repeated in unit"), ("v", "lead?", "ill-formed"), ("v", "no mark", "ill-formed")]


def test_splits(spark):
    rows = spark.createDataFrame([("u", "train"), ("u", "dev"), ("v", "test")], "source_unit_id string, split string")
    assert _rows(checks.leakage_violations(rows)) == [("u", 2)]
    assigned = spark.createDataFrame([("a", "test"), ("b", "train"), ("b", "train"), ("c", "dev"), ("c", "dev"), ("c", "dev"), ("d", "train"), ("d", "dev"), ("e", "train"), ("e", "test"), ("e", "dev")], "leaf_id string, split string")
    assert _rows(checks.coverage_violations(assigned)) == [("a", 1, "test"), ("a", 1, "train"), ("b", 2, "test"), ("c", 3, "test"), ("c", 3, "train"), ("d", 2, "dev"), ("d", 2, "test")]
    units = spark.createDataFrame([("a", "train_only", "dev"), ("b", "train_only", "train"), ("c", None, "dev")], "unit_id string, split_constraint string, split string")
    assert _rows(checks.constraint_violations(units)) == [("a", "dev")]


def test_failures_differences_drift(spark):
    ids = lambda x, c: spark.createDataFrame([(v,) for v in x], f"{c} string")
    assert _rows(checks.unresolved_failures(ids("aabc", "unit_id"), ids("abd", "id"), ids("b", "unit_id"))) == [("a",)]
    assert _rows(checks.difference_violations(ids("aab", "x"), ids("abc", "x"))) == [("a", "first"), ("c", "second")]
    rows = spark.createDataFrame([("1", "q", "t", "l"), ("2", "other", "t", "l"), ("3", "q", "u", "l"), ("4", "q", "none", "l")], "id string, query string, target string, gold_leaf_id string")
    source = spark.createDataFrame([(i, "q") for i in "1234"], "id string, query string")
    catalog = spark.createDataFrame([("t", "l"), ("u", "m")], "target string, leaf_id string")
    assert _rows(checks.drift_violations(rows, source, catalog)) == [("2", "query"), ("3", "target"), ("4", "target")]
