import corpus_pipeline
from tests.llm import brute
from tests.llm.cases import documents, frame
from treatise.llm import packing, quality


def test_stages_against_plain_versions(spark, tmp_path):
    docs = documents()
    frame(spark, docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    junk = [(1000 + i, "LOUD!! WORDS!! " * 20) for i in range(40)]
    frame(spark, junk).select("doc_id", "text", "lang", "source", "n_chars").write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 1000), 0) for d, _ in docs + junk], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = " ".join(docs[25][1].split()[:15])
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    table, d = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    kept = corpus_pipeline.classify(spark, table, d)
    assert kept.columns == table.columns and not {r.doc_id for r in kept.collect()} & {i for i, _ in junk}
    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    lines = corpus_pipeline.dedup_lines(spark, kept, d)
    want = brute.line_dedup(rows)
    assert {r.doc_id: brute.sha(r.text or "") for r in lines.collect()} == {i: v[2] for i, v in want.items()}
    rows = sorted((r.doc_id, r.text) for r in lines.collect())
    near = corpus_pipeline.dedup_documents(spark, lines, d)
    assert {r.doc_id for r in near.collect()} == {i for i, v in brute.near_duplicates(rows, 5).items() if v[2]}
    rows = sorted((r.doc_id, r.text) for r in near.collect())
    clean = corpus_pipeline.decontaminate(spark, near, d)
    assert {r.doc_id for r in clean.collect()} == {i for i, v in brute.contamination(rows, [(0, item)]).items() if not v[4]}
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}
    assert len(corpus_pipeline.STAGES) == 5


def _written(spark, folder, docs, labels=((1, 1, 0), (2, 0, 0)), items=((0, "some words of an item that nobody else has in it"),)):
    frame(spark, docs).select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), str(folder)


def test_stages_on_empty_tables(spark, tmp_path):
    table, d = _written(spark, tmp_path, [], [], [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, d)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == table.columns
    assert corpus_pipeline.run(spark, d).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and texts, rows that repeat, two texts under one id: each stage keeps what is clean."""
    text = "one clean text of a few words more than the windows of the benchmark have, and it goes on"
    rows = [(1, text), (1, text), (None, text + " here"), (None, None), (2, None), (3, ""), (4, text + " there"), (4, "another text under the same number that shares no line and no shingle with it")]
    table, d = _written(spark, tmp_path, rows, labels=[])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = sorted(((r.doc_id, r.text) for r in stage(spark, table, d).collect()), key=repr)
        # Without labels every score is 0.5; repeated rows agree in all, so either both or none of them stay.
        gone = {(4, text + " there")} if name == "near dedup" else set()
        assert out == sorted((r for r in rows if r not in gone), key=repr), name
    packed = corpus_pipeline.run(spark, d)
    assert packed.count() == len(rows) - 1 and {r.doc_id for r in packed.collect()} == {None, 1, 2, 3, 4}


def test_stage_folders_are_removed(spark, tmp_path, monkeypatch):
    """Only the last stage's input stays, which the result reads."""
    _, d = _written(spark, tmp_path / "in", [(i, f"text number {i} with words of its own {i * 7}") for i in range(12)], labels=[])
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark: str(tmp_path / "shared"))
    assert corpus_pipeline.run(spark, d).count() == 12
    assert [p.name.rsplit("-", 1)[1] for p in (tmp_path / "shared").iterdir()] == ["3"]
