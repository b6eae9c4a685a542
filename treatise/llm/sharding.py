"""Sharding: a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The count of rows of each input partition is known from one aggregate. From these counts and the wanted shard
sizes (at most one row apart) the driver draws the matrix "rows of partition p that go to shard s": its rows are
successive multivariate hypergeometric draws from what the shards still need, so every assignment that meets the
sizes is equally likely. Each task permutes its own row of the matrix over its rows (the local permutation), the
rows are exchanged, and a second permutation inside the shard gives the slots. The matrix has one row for a
partition and one column for a shard; nothing that grows with the rows is gathered.

A shard is permuted in buckets of a random key, so it needs no task that holds all of it. Whole rows travel: they
are checkpointed in compressed blocks, since their partitions must not change between count and draw, and exchanged
once. How many rows each bucket gets follows from the counts and the draws alone, so no second reading of the rows
is needed for it.

Defined cases: null text has size 1 and the checksum of no bytes; equal rows are separate rows; an empty table
gives an empty result; the length of a text changes nothing but its size; ties between equal draws are ordered by
a hash of the row; columns may have any name, and where one is called
like a new one, the new one gets an underscore behind its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import settle

#: Rows and bytes of one bucket of a shard's second permutation, on average: whichever makes more buckets.
BUCKET_ROWS, BUCKET_BYTES = 200_000, 8 << 20
#: Bytes of rows in one compressed block of the checkpoint.
BLOCK_BYTES = 4 << 20


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """counts[p] rows of partition p drawn into `shards` shards whose sizes are at most one apart."""
    rng, total = np.random.default_rng(seed), sum(counts)
    need = np.full(shards, total // shards, np.int64)
    need[: total % shards] += 1
    matrix = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        # The marginals method draws column by column, so its cost does not depend on the counts.
        left, rest = n, int(need.sum())
        for s in range(shards):
            rest -= int(need[s])
            matrix[p, s] = _hypergeometric(rng, int(need[s]), rest, left)
            left -= int(matrix[p, s])
        need -= matrix[p]
    return matrix


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    # numpy's sampler ends at 1e9 rows: split the good ones in two and draw for each half.
    if good > 1:
        first = _split_draw(rng, good + bad, draws, good // 2)
        return first + _hypergeometric(rng, good - good // 2, bad, draws - first)
    return int(rng.random() < draws / (good + bad))


def _split_draw(rng: np.random.Generator, total: int, draws: int, good: int) -> int:
    """Hypergeometric count for populations past numpy's limit, by inversion from the mode outwards."""
    from math import exp, lgamma

    log_comb = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    low, high = max(0, draws - (total - good)), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    mass = exp(log_comb(good, mode) + log_comb(total - good, draws - mode) - log_comb(total, draws))
    u, up, down, pu, pd = rng.random() - mass, mode, mode, mass, mass
    while u > 0 and (up < high or down > low):
        if up < high:
            pu *= (good - up) * (draws - up) / ((up + 1) * (total - good - draws + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > low:
            pd *= down * (total - good - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as compressed blocks, with their numbers of rows and of bytes."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        step = max(1, batch.num_rows * BLOCK_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            part, sink = batch.slice(at, step), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part.num_rows, part.nbytes, sink.getvalue().to_pybytes())], names=["n", "size", "block"])


def _draws(matrix: dict[int, list[int]], seed: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each row of a partition, and the random key of its place there."""
    rng = np.random.default_rng([seed, part])
    shard = rng.permutation(np.repeat(np.arange(len(matrix[part]), dtype=np.int32), matrix[part]))
    return shard, rng.random(len(shard))


def _buckets(draw: np.ndarray, buckets: int) -> np.ndarray:
    return (draw * buckets).astype(np.int32)


def _permute(matrix: dict[int, list[int]], seed: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        shard, draw = _draws(matrix, seed, part) if part in matrix else (None, None)
        for batch in batches:
            for block in batch.column("block"):
                for rows in pa.ipc.open_stream(block.as_buffer()):
                    here = slice(at, at + rows.num_rows)
                    yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, (shard[here], draw[here], _buckets(draw[here], buckets)))], names=[*rows.schema.names, "shard", "draw", "bucket"])
                    at += rows.num_rows

    return run


def _bucket_sizes(matrix: dict[int, list[int]], seed: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("part").to_pylist():
                shard, draw = _draws(matrix, seed, part)
                keys, n = np.unique(shard.astype(np.int64) * buckets + _buckets(draw, buckets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((keys // buckets).astype(np.int32)), pa.array((keys % buckets).astype(np.int32)), pa.array(n.astype(np.int64))], names=["shard", "bucket", "n"])

    return run


def shard_rows(rows: DataFrame, shards: int = 16, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows with shard int and slot bigint: a uniformly random arrangement with shard sizes at most one apart.

    Where rows has a column of one of these names (in any case), the new one gets underscores behind its name.
    """
    names = []
    for name in ("shard", "slot"):
        while name in {c.lower() for c in rows.columns}:
            name += "_"
        names.append(name)
    whole = rows.select(F.struct("*").alias("row"))
    held = settle(whole.mapInArrow(_packed, "n bigint, size bigint, block binary"))
    found = held.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()
    sizes = {r["part"]: r["n"] for r in found}
    parts = sorted(sizes)
    drawn = communication_matrix([sizes[p] for p in parts], shards, seed)
    matrix = {p: drawn[i].tolist() for i, p in enumerate(parts)}
    buckets = max(1, round(sum(sizes.values()) / shards / bucket_rows), round(sum(r["size"] for r in found) / shards / BUCKET_BYTES))
    added = [T.StructField("shard", T.IntegerType()), T.StructField("draw", T.DoubleType()), T.StructField("bucket", T.IntegerType())]
    dealt = held.mapInArrow(_permute(matrix, seed, buckets), T.StructType([*whole.schema.fields, *added]))
    counted = rows.sparkSession.createDataFrame([(p,) for p in parts], "part int").mapInArrow(_bucket_sizes(matrix, seed, buckets), "shard int, bucket int, n bigint")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy("shard", "bucket").agg(F.sum("n").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("draw", F.hash("row"))
    placed = dealt.withColumn("nth", F.row_number().over(within) - 1).join(F.broadcast(starts) if shards * buckets <= 100_000 else starts, ["shard", "bucket"])
    return placed.select(*(F.col("row").getField(c).alias(c) for c in rows.columns), F.col("shard").alias(names[0]), (F.col("start") + F.col("nth")).alias(names[1]))


def shard_digests(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of whole documents in their shards: digests of the texts that arrived there."""
    placed = shard_rows(docs, shards, seed)
    shard, slot = placed.columns[-2:]
    text = F.coalesce("text", F.lit("")).cast("binary")
    digests = (F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    return placed.select(*digests, F.lit("rows").alias("law"), F.col(shard).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
