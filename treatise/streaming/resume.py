"""Incremental form of the resumable generation step: new units are picked up as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.questions import prompt, requested_count


def prompts_stream(spark: SparkSession, units_path: str, schema: str = "id string, text string, character_count int") -> DataFrame:
    """Units appended under units_path, each with its prompt once; the query's checkpoint remembers what was read."""
    units = spark.readStream.schema(schema).json(units_path)
    n = requested_count(F.col("character_count"))
    return units.select("id", n.alias("requested_count"), prompt(F.col("text"), n).alias("prompt"))
