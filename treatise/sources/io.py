"""Readers and writers. Paths may be of any file system that Spark knows; nothing opens files on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import order_free_hash

VECTORS = T.StructType([T.StructField("id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


#: Bytes of a table's files between which it is dealt to all cores if it comes in fewer files than there are cores.
DEAL_FROM, DEAL_TO = 2 << 20, 64 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table.

    One file of one row group is read by one task, whatever its size and the number of cores. A table of a few
    files and at most DEAL_TO bytes is therefore dealt anew, which costs one small shuffle; larger tables come in
    many files or row groups and are left as they lie.
    """
    rows = spark.read.parquet(path)
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if DEAL_FROM <= size <= DEAL_TO and len(rows.inputFiles()) < cores else rows


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file that is one JSON array of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, missing_ok: bool = False) -> DataFrame:
    """One object a line, blank lines skipped; with missing_ok an absent path is an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if missing_ok and "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def first_record(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The first line that is not blank, as a record."""
    line = spark.read.text(path).where(F.trim("value") != "").limit(1)
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    return line.select(F.from_json("value", ddl).alias("r")).select("r.*")


def read_outline_text(spark: SparkSession, path: str) -> DataFrame:
    """Outline text as one row per file, for operators.outline.parse_outline()."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("outline"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Id and embedding."""
    return spark.read.schema(VECTORS).parquet(path)


def text_blocks(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The lines of each page as blocks with a number, in place of a PDF's blocks."""
    return pages.select(*keys, "page", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """K2"""
    rows.write.mode("overwrite").json(path)


def write_json_array(rows: DataFrame, path: str, order: str) -> None:
    """K1: the rows in order as one indented JSON array, streamed by the one task that one file needs."""
    text = F.to_json(F.struct(*rows.columns), {"pretty": "true", "ignoreNullFields": "false"})
    ordered = rows.select(text.alias("value"), F.col(order).alias("o")).repartition(1).sortWithinPartitions("o").select("value")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda x: pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["value"])
        before = None
        for batch in batches:
            out = []
            for text in batch.column("value").to_pylist():
                out.append("[" if before is None else before + ",")
                before = text
            yield made(out)
        yield made(["[", "]"] if before is None else [before, "]"])

    ordered.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def append_batch(rows: DataFrame, path: str, batch: int) -> None:
    """K4: append a batch under its own partition; writing the same batch again replaces it."""
    rows.write.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch}")


def write_quarantine(accepted: DataFrame, failed: DataFrame, accepted_path: str, failed_path: str) -> None:
    """K5"""
    accepted.write.mode("append").json(accepted_path)
    failed.write.mode("append").json(failed_path)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """K6: name, rows and a content hash of each table, independent of row order."""
    out = None
    for name, df in tables.items():
        one = order_free_hash(df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"))).select(F.lit(name).alias("name"), "n_rows", F.col("h").alias("sha256"))
        out = one if out is None else out.unionByName(one)
    return out


def replace_table(rows: DataFrame, path: str) -> None:
    """K7: Spark's commit protocol makes the new files visible only when all of them are written."""
    rows.write.mode("overwrite").parquet(path)
