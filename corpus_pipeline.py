"""A corpus pipeline: documents that a quality classifier rejects go, then repeated lines, near copies and
benchmark passages, and what is left is packed into windows of tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each result as
Parquet into the folder that all executors share, reads it again for the next stage, and removes it when the stage
after that is written. The input of the last stage stays, since the result reads it.

Defined cases: a null text counts as empty and passes the first four stages; a row without doc_id is judged by
quality and benchmark like others, neither holds nor loses lines, and is nobody's copy; rows that repeat stay or go
together; texts may have any length; columns beside doc_id and text are carried along under any name, but n_chars,
which is counted anew where lines go; an empty table gives an empty result. Which copy of a group stays does not
depend on the order of rows: it is the smallest doc_id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from treatise.functions.settled import shared_folder
from treatise.llm import decontamination, line_dedup, minhash, packing, quality
from treatise.llm._store import table
from treatise.plans.ship import ship


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose quality score reaches the classifier's threshold."""
    ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop each line that a document with a smaller doc_id holds; n_chars is counted anew."""
    ship(spark)
    return line_dedup.drop_repeated_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) keep the smallest doc_id."""
    ship(spark)
    return minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    ship(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, one row a piece."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Tokens and a fitted classifier can't be expressed in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage makes of documents."""
    ship(spark)
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{base}-{number}")
            docs = spark.read.parquet(f"{base}-{number}")
            _remove(spark, f"{base}-{number - 1}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is; none is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
