import functools
import itertools
import math
import operator
import random

import duckdb
from pyspark.sql import functions as F

from treatise.functions.numbers import rounded, steady_sum
from treatise.plans import oracle, queries


def test_rounding_as_in_the_sql(spark):
    values = [16.4690405, 1.0234495, -0.1294735, 0.5, -2.5, 0.0000005, 0.00000049999999, 65.234104, 0.0, None, math.inf]
    for digits in (6, 9):
        got = [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, v double").orderBy("i").select(rounded(F.col("v"), digits).alias("x")).collect()]
        assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), ?)", [x, digits]).fetchone()[0] for x in values]


def test_sums_in_any_order(spark):
    values = [0.1, 0.2, 0.3, 7.7, -1e5 / 3]
    orders = list(itertools.permutations(values))
    assert len({functools.reduce(operator.add, o) for o in orders}) > 1
    for order in orders[::7]:
        rows = spark.createDataFrame([(x,) for x in order], "x double").coalesce(1)
        assert rows.agg(steady_sum(F.col("x"))).first()[0] == math.fsum(values)


def test_ranking_equals_its_sql(spark, tmp_path):
    """Among the scores are -0.1294735, whose sixth digit depends on how halves are found."""
    rng = random.Random(6)
    docs = [" ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(docs)], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(docs[2 * i].split()[:8])) for i in range(30)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    wanted = db.execute(oracle.oracle_sql()["q4_ranking"]).fetchall()
    assert any(score == -0.129473 for _, _, score, _ in wanted)
    assert sorted(map(tuple, queries.q4_ranking(spark, str(tmp_path)).collect())) == sorted(wanted)
