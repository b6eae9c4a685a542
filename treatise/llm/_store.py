"""What the operators share on the Spark side."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.settled import settle  # noqa: F401  (the operators' one way to cut a plan)
from ..sources.io import read_table


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def _hash_partition(values: np.ndarray, n: int) -> np.ndarray:
    """The partition, of n, that Spark's hash partitioning gives to bigint values (Murmur3, 32 bits, seed 42)."""
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    h = np.full(len(values), 42, np.uint32)
    for word in (values & 0xFFFFFFFF, values >> 32):
        k = turn(word.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return h.view(np.int32).astype(np.int64) % n


def even_key(number: int, n: int) -> int:
    """A key of its own for each number below 2**20 that repartition(n, key) sends to partition number % n.

    Hashes of few small numbers fall on some partitions twice and on others never. With many partitions, or by a
    session that deals in another number of them, keys fall where their hash does, which changes no result.
    """
    if n > 4096:
        return number
    for begin in range(0, 1 << 20, 1 << 14):
        values = (np.arange(begin, begin + (1 << 14), dtype=np.int64) << 20) + number
        if len(fit := np.flatnonzero(_hash_partition(values, n) == number % n)):
            return int(values[fit[0]])
    return number
