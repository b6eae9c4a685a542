"""Validators: each returns the rows that violate a rule; an empty result passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_key
from .split import SPLITS


def id_violations(expected: DataFrame, observed: DataFrame, column: str = "id") -> DataFrame:
    """V1: missing, extra, duplicate and empty ids."""
    e, o = expected.select(F.col(column).alias("id")), observed.select(F.col(column).alias("id"))
    mark = lambda df, name: df.select("id", F.lit(name).alias("problem"))
    parts = [
        mark(e.where("id IS NOT NULL").distinct().join(o, "id", "left_anti"), "missing"),
        mark(o.where("id IS NOT NULL").distinct().join(e, "id", "left_anti"), "extra"),
        mark(o.where("id IS NOT NULL").groupBy("id").count().where("count > 1"), "duplicate"),
        mark(o.where("id IS NULL OR CAST(id AS STRING) = ''"), "empty"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def count_violations(rows: DataFrame, expected: dict[str, int], by: str) -> DataFrame:
    """V2: groups whose number of rows is not the expected one."""
    want = rows.sparkSession.createDataFrame(list(expected.items()), f"{by} string, expected bigint")
    got = rows.groupBy(F.col(by).cast("string").alias(by)).agg(F.count("*").alias("n"))
    return want.join(got, by, "full_outer").where("NOT (expected <=> n)")


def consistency_violations(rows: DataFrame, id_column: str = "id", nodes: DataFrame | None = None) -> DataFrame:
    """V3: empty texts, wrong character counts, reversed page ranges; with nodes(leaf_id, title, path) also titles and
    paths that are not those of the row's leaf. A row has a line for each of its problems."""
    tests = {"empty": F.trim("text") == "", "character_count": F.col("character_count") != F.length("text"), "page range": F.col("page_start") > F.col("page_end")}
    if nodes is not None:
        rows = rows.join(nodes.select("leaf_id", F.col("title").alias("_title"), F.col("path").alias("_path"), F.lit(True).alias("_known")), "leaf_id", "left")
        known = F.col("_known").isNotNull()
        tests |= {"leaf title": known & ~F.col("leaf_title").eqNullSafe(F.col("_title")), "path": known & ~F.col("path").eqNullSafe(F.col("_path"))}
    problems = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))
    return rows.select(F.col(id_column).alias("id"), F.explode(problems).alias("problem"))


def numbering_violations(rows: DataFrame, leaf: str, number: Column, id_column: str = "id") -> DataFrame:
    """V4: numbers in a leaf that do not run from 1 without gaps."""
    ranked = rows.select(F.col(id_column).alias("id"), F.col(leaf).alias("leaf_id"), number.alias("number"))
    return ranked.withColumn("expected", F.row_number().over(Window.partitionBy("leaf_id").orderBy("number"))).where("NOT (number <=> expected)")


def pattern_violations(rows: DataFrame, patterns: dict[str, str], id_column: str = "id") -> DataFrame:
    """V5: rows with a text that a pattern finds, one row per pattern."""
    hits = F.explode(F.array(*(F.struct(F.lit(n).alias("problem"), F.rlike("text", F.lit(p)).alias("hit")) for n, p in patterns.items())))
    return rows.select(F.col(id_column).alias("id"), hits.alias("h")).where("h.hit").select("id", "h.problem")


def question_violations(records: DataFrame) -> DataFrame:
    """V6: ill-formed questions, and those repeated in their unit or in another one, after normalisation."""
    each = records.select("unit_id", F.explode("questions").alias("question")).withColumn("key", normalized_key(F.col("question")))
    bad = each.where(~F.endswith("question", F.lit("?")) | (F.col("question") != F.trim("question"))).select("unit_id", "key", F.lit("ill-formed").alias("problem"))
    local = each.groupBy("unit_id", "key").count().where("count > 1").select("unit_id", "key", F.lit("repeated in unit").alias("problem"))
    shared = each.groupBy("key").agg(F.countDistinct("unit_id").alias("n"), F.min("unit_id").alias("unit_id")).where("n > 1").select("unit_id", "key", F.lit("repeated across units").alias("problem"))
    return bad.unionByName(local).unionByName(shared)


def unresolved_failures(failures: DataFrame, units: DataFrame, records: DataFrame) -> DataFrame:
    """V7: units that failed, are expected and have no valid record since."""
    return failures.select("unit_id").distinct().join(units.select(F.col("id").alias("unit_id")), "unit_id", "left_semi").join(records, "unit_id", "left_anti")


def leakage_violations(rows: DataFrame) -> DataFrame:
    """V9: units in more than one split."""
    return rows.groupBy("source_unit_id").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def coverage_violations(assigned: DataFrame) -> DataFrame:
    """Every leaf has train units, with two or more units test ones, with three or more dev ones; a row for each
    split that is missing, or that is there with fewer units than it may be had."""
    have = assigned.groupBy("leaf_id").agg(F.count("*").alias("n_units"), *(F.count_if(F.col("split") == s).alias(s) for s in SPLITS))
    least = {"train": 1, "test": 2, "dev": 3}
    problems = F.array_compact(F.array(*(F.when((F.col("n_units") >= n) != (F.col(s) > 0), F.lit(s)) for s, n in least.items())))
    return have.select("leaf_id", "n_units", F.explode(problems).alias("split"))


def constraint_violations(assigned: DataFrame) -> DataFrame:
    """Train-only units elsewhere."""
    return assigned.where("split_constraint = 'train_only' AND split <> 'train'").select("unit_id", "split")


def difference_violations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has and the other has not, as often as that."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def drift_violations(rows: DataFrame, source: DataFrame, catalog: DataFrame) -> DataFrame:
    """Queries that differ from their source, and targets that the catalog gives to another leaf."""
    joined = rows.join(source.select("id", F.col("query").alias("source_query")), "id", "left").join(catalog.select("target", F.col("leaf_id").alias("catalog_leaf")), "target", "left")
    problem = F.when(~F.col("query").eqNullSafe(F.col("source_query")), "query").when(~F.col("catalog_leaf").eqNullSafe(F.col("gold_leaf_id")), "target")
    return joined.select("id", problem.alias("problem")).where("problem IS NOT NULL")
