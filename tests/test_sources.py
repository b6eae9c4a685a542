import json

import pytest
from pyspark.sql import functions as F

from treatise.functions.text import order_free_hash
from treatise.sources import io
from treatise.streaming import resume


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(2, "é“b”", None), (1, "a\nb", 0.5), (3, "", 1.0)], "id int, name string, share double")


def test_json_array(spark, rows, tmp_path):
    io.write_json_array(rows, f"{tmp_path}/a", "id")
    text = "".join(p.read_text() for p in (tmp_path / "a").glob("part-*"))
    assert json.loads(text) == [{"id": 1, "name": "a\nb", "share": 0.5}, {"id": 2, "name": "é“b”", "share": None}, {"id": 3, "name": "", "share": 1.0}]
    assert text.startswith("[\n{\n  ") and "é“b”" in text
    assert sorted(io.read_json_array(spark, f"{tmp_path}/a", rows.schema).collect()) == sorted(rows.collect())
    io.write_json_array(rows.where("false"), f"{tmp_path}/b", "id")
    assert io.read_json_array(spark, f"{tmp_path}/b", rows.schema).count() == 0


def test_jsonl(spark, rows, tmp_path):
    io.write_jsonl(rows, f"{tmp_path}/a")
    assert sorted(io.read_jsonl(spark, f"{tmp_path}/a", rows.schema).collect()) == sorted(rows.collect())
    (tmp_path / "b.jsonl").write_text('\n\n{"id": 7, "name": "x"}\n\n{"id": 8}\n')
    assert [r.id for r in io.read_jsonl(spark, f"{tmp_path}/b.jsonl", rows.schema).collect()] == [7, 8]
    assert io.first_record(spark, f"{tmp_path}/b.jsonl", rows.schema).collect() == [(7, "x", None)]
    assert io.read_jsonl(spark, f"{tmp_path}/none", rows.schema, missing_ok=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        io.read_jsonl(spark, f"{tmp_path}/none", rows.schema)


def test_batches_and_quarantine(spark, rows, tmp_path):
    for batch, keep in ((0, "id = 1"), (1, "id = 2"), (0, "id <> 2")):
        io.append_batch(rows.where(keep), f"{tmp_path}/a", batch)
    assert sorted((r.id, r.batch) for r in spark.read.json(f"{tmp_path}/a").collect()) == [(1, 0), (2, 1), (3, 0)]
    for _ in range(2):
        io.write_quarantine(rows.where("id < 3"), rows.where("id = 3"), f"{tmp_path}/kept", f"{tmp_path}/failed")
    assert spark.read.json(f"{tmp_path}/kept").count() == 4 and spark.read.json(f"{tmp_path}/failed").count() == 2


def test_manifest_ignores_order_and_sees_changes(spark, rows):
    one = lambda df: io.manifest({"t": df}).collect()[0]
    assert one(rows) == one(rows.orderBy(F.desc("id")).repartition(3)) and one(rows).n_rows == 3
    assert one(rows).sha256 != one(rows.withColumn("share", F.lit(0.1))).sha256 != one(rows.unionAll(rows)).sha256
    many = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    assert order_free_hash(many).first() == order_free_hash(many.repartition(7)).first()


def test_outline_and_vectors(spark, tmp_path):
    (tmp_path / "toc.txt").write_text("- A\n  - B\n")
    assert io.read_outline_text(spark, f"{tmp_path}/toc.txt").first().outline == "- A\n  - B\n"
    io.replace_table(spark.createDataFrame([("a", [1.0, 2.0])], io.VECTORS), f"{tmp_path}/v")
    io.replace_table(spark.createDataFrame([("b", [3.0])], io.VECTORS), f"{tmp_path}/v")
    assert [(r.id, r.embedding) for r in io.read_vectors(spark, f"{tmp_path}/v").collect()] == [("b", [3.0])]
    blocks = io.text_blocks(spark.createDataFrame([(1, "a\n\nb")], "page int, text string"), [])
    assert [tuple(r) for r in blocks.collect()] == [(1, 0, "a"), (1, 1, ""), (1, 2, "b")]


def test_small_tables_are_dealt(spark, rows, tmp_path, monkeypatch):
    rows.coalesce(1).write.parquet(f"{tmp_path}/t")
    assert io.read_table(spark, f"{tmp_path}/t").rdd.getNumPartitions() == 1
    monkeypatch.setattr(io, "DEAL_FROM", 1)
    assert io.read_table(spark, f"{tmp_path}/t").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(io.read_table(spark, f"{tmp_path}/t").collect()) == sorted(rows.collect())


def test_prompts_stream_resumes(spark, tmp_path):
    """Units that arrive later are read once, by a query that starts again from its checkpoint."""
    (tmp_path / "in").mkdir()

    def run():
        stream = resume.prompts_stream(spark, f"{tmp_path}/in").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        stream.awaitTermination(120)
        return {r.id: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}, spark.read.parquet(f"{tmp_path}/out").count()

    (tmp_path / "in/a.json").write_text('{"id": "u1", "text": "One passage.", "character_count": 12}\n')
    got, n = run()
    assert n == 1 and got["u1"].requested_count == 2 and "exactly 2 " in got["u1"].prompt and "One passage." in got["u1"].prompt
    (tmp_path / "in/b.json").write_text('{"id": "u2", "text": "Another.", "character_count": 300}\n')
    got, n = run()
    assert n == 2 and got["u2"].requested_count == 6
