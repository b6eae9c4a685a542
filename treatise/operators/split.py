"""Leakage-safe splits: whole units go to train, dev or test, with every label covered where it can be."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_key

# The splits in their order and the proportions of the published split.
SPLITS = ("train", "dev", "test")
PROPORTIONS = {"train": 1056, "dev": 388, "test": 1746}


def apportion(totals: DataFrame, total: str = "total", keys: tuple[str, ...] = (), weights: dict[str, int] = PROPORTIONS) -> DataFrame:
    """(keys, split, target) by largest remainder, ties in the order of the splits."""
    whole = sum(weights.values())
    rows = totals.select(*keys, F.col(total).alias("_total"), F.explode(F.array(*(F.struct(F.lit(i).alias("index"), F.lit(s).alias("split"), F.lit(w).cast("bigint").alias("weight")) for i, (s, w) in enumerate(weights.items())))).alias("s"))
    product = F.col("_total") * F.col("s.weight")
    rows = rows.select(*keys, "_total", "s.index", "s.split", F.floor(product / whole).alias("base"), (product % whole).alias("rest"))
    group = Window.partitionBy(*keys, "_total")
    left = F.col("_total") - F.sum("base").over(group)
    nth = F.row_number().over(group.orderBy(F.desc("rest"), "index"))
    return rows.select(*keys, "split", (F.col("base") + (nth <= left).cast("int")).alias("target"))


def unknown_constraints(records: DataFrame) -> DataFrame:
    """D3: records whose constraint is none that is known."""
    return records.where("split_constraint IS NOT NULL AND split_constraint <> 'train_only'").select("unit_id", "split_constraint")


def cover(records: DataFrame) -> DataFrame:
    """records(unit_id, leaf_id, n_questions, split_constraint) with split, null for those left over.

    A leaf's units in key order: the first is train (unless a constrained unit already is), the next is test, and
    of the rest the one with the fewest questions is dev.
    """
    rows = records.withColumn("unit_key", stable_key(F.col("unit_id")))
    fixed = F.col("split_constraint") == "train_only"
    leaf = Window.partitionBy("leaf_id")
    rows = rows.withColumn("_fixed", F.coalesce(fixed, F.lit(False))).withColumn("_trained", F.max("_fixed").over(leaf).cast("int"))
    nth = F.row_number().over(Window.partitionBy("leaf_id", "_fixed").orderBy("unit_key", "unit_id")) + F.col("_trained")
    rows = rows.withColumn("_nth", F.when(~F.col("_fixed"), nth))
    early = F.when(F.col("_fixed") | (F.col("_nth") == 1), "train").when(F.col("_nth") == 2, "test")
    rows = rows.withColumn("_early", early)
    fewest = F.row_number().over(Window.partitionBy("leaf_id", F.col("_early").isNull()).orderBy("n_questions", "unit_key", "unit_id"))
    split = F.coalesce("_early", F.when(fewest == 1, "dev"))
    return rows.withColumn("split", split).drop("_fixed", "_trained", "_nth", "_early")


def interleave(covered: DataFrame) -> DataFrame:
    """The units left over with their depth in the leaf and the leaf's key: order by (depth, leaf_key)."""
    rest = covered.where("split IS NULL")
    depth = F.row_number().over(Window.partitionBy("leaf_id").orderBy("unit_key", "unit_id")) - 1
    return rest.withColumn("depth", depth).withColumn("leaf_key", stable_key(F.col("leaf_id")))


def fill(covered: DataFrame, targets: dict[str, int]) -> DataFrame:
    """(unit_id, split) of the units left over: each goes to the split that lacks most of its target.

    Every choice depends on all before it, so one task reads the units left over in order. What is assigned
    already reaches it as three counts and as the splits that each leaf has (a bit for each); it streams, and it
    remembers only leaves that still lacked a split.
    """
    bit = F.element_at(F.create_map(*(F.lit(x) for i, s in enumerate(SPLITS) for x in (s, 1 << i))), F.col("split"))
    has = F.coalesce(F.bit_or(bit).over(Window.partitionBy("leaf_id")), F.lit(0))
    rest = interleave(covered.withColumn("has", has)).select("unit_id", "leaf_id", "n_questions", "has", "depth", "leaf_key")
    done = {r["split"]: r["n"] for r in covered.where("split IS NOT NULL").groupBy("split").agg(F.sum("n_questions").alias("n")).collect()}  # three rows

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, grown, full = {s: int(done.get(s) or 0) for s in SPLITS}, {}, (1 << len(SPLITS)) - 1
        for units in batches:
            out = []
            for leaf, n, has in zip(units["leaf_id"], units["n_questions"], units["has"]):
                has |= grown.get(leaf, 0)
                lack = [round((targets[s] - counts[s]) / targets[s], 6) if targets[s] else float("-inf") for s in SPLITS]
                best = max(range(len(SPLITS)), key=lambda i: (lack[i], not has >> i & 1, -i))
                counts[SPLITS[best]] += int(n)
                if has != full:
                    grown[leaf] = has | 1 << best
                out.append(SPLITS[best])
            yield pd.DataFrame({"unit_id": units["unit_id"], "split": out})

    return rest.repartition(1).sortWithinPartitions("depth", "leaf_key", "leaf_id").mapInPandas(assign, "unit_id string, split string")


def split_units(records: DataFrame) -> DataFrame:
    """Records with their split."""
    total = records.agg(F.coalesce(F.sum("n_questions"), F.lit(0)).cast("bigint").alias("total"))
    targets = {r["split"]: r["target"] for r in apportion(total).collect()}  # three rows
    covered = cover(records)
    filled = fill(covered, targets).withColumnRenamed("split", "filled")
    return covered.join(filled, "unit_id", "left").withColumn("split", F.coalesce("split", "filled")).drop("filled", "unit_key")


def explode_questions(records: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row per question, ids unit-qNN; records has unit_id, leaf_id and questions."""
    rows = records.join(assigned.select("unit_id", "split"), "unit_id").select("unit_id", "leaf_id", "split", F.posexplode("questions").alias("at", "query"))
    return rows.select(F.format_string("%s-q%02d", "unit_id", F.col("at") + 1).alias("id"), "query", F.col("leaf_id").alias("gold_leaf_id"), "split", F.col("unit_id").alias("source_unit_id"))


def split_counts(rows: DataFrame) -> DataFrame:
    """Units, questions and covered leaves of each split."""
    return rows.groupBy("split").agg(F.count("*").alias("n_units"), F.sum("n_questions").alias("n_questions"), F.countDistinct("leaf_id").alias("n_leaves"))
