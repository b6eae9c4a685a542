"""Line dedup: hashes in range partitions, sorted by document and position, answered by keep bitmaps.

Every line of at least `min_chars` code points is keyed by a 128-bit hash of its trimmed, ASCII-lower-cased
bytes. The keys are range-partitioned by (key, document, position) and sorted, so a key that holds a third of
all rows spans as many partitions as it needs. Each partition streams its rows once and marks those whose
document is not the first of the key; what a partition must know of the ones before it (the first document of
the key it starts with) follows from one row a partition. The answer is one zlib-compressed keep bitmap per
document that loses lines, never text. Bitmaps go to the texts: up to BROADCAST_BITMAPS of them and BROADCAST_BYTES
in all as a broadcast, so texts don't move; beyond that both meet in a shuffle.

Defined cases: null text is one empty line; a row without doc_id neither holds nor loses lines; rows that
repeat a doc_id are judged as parts of one document, and a line keeps all its places in the smallest doc_id that
holds it; texts and lines may have any length; an empty table gives an empty result; only the id and text columns
are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import settle, shuffle_width

MIN_CHARS = 10
BROADCAST_BITMAPS, BROADCAST_BYTES = 250_000, 32 << 20
_STRIP = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> Iterator[tuple[int, bytes]]:
    """Position and key of each line that is long enough to be judged."""
    for at, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        key = line.strip(_STRIP).lower()
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            yield at, key


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, high, low, at = [], [], [], [], []
            for doc, same, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))):
                for position, key in line_keys(text, min_chars):
                    digest = xxhash.xxh3_128_digest(key)
                    ids.append(doc)
                    hashes.append(same)
                    at.append(position)
                    high.append(digest[:8])
                    low.append(digest[8:])
            split = [np.frombuffer(b"".join(x), ">i8").astype(np.int64) for x in (high, low)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, split), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(at, pa.int32())], names=["k1", "k2", "doc_id", "text_hash", "line_no"])

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: its first and last key and the first document of the last key."""
    from pyspark import TaskContext

    first = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, doc = (batch.column(c).to_numpy() for c in ("k1", "k2", "doc_id"))
        first = first or (int(k1[0]), int(k2[0]))
        run = int(np.flatnonzero((k1 == k1[-1]) & (k2 == k2[-1]))[0])
        if last is None or last[:2] != (k1[-1], k2[-1]):
            last = (int(k1[-1]), int(k2[-1]), int(doc[run]))
    if first:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (TaskContext.get().partitionId(), *first, *last)], names=["part", "f1", "f2", "l1", "l2", "holder"])


def _stream(carried: dict[int, tuple[int, int, int]]):
    """Rows whose document is not the first of their key; `carried` has the key that reaches into a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = carried.get(TaskContext.get().partitionId())
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, doc = (batch.column(c).to_numpy() for c in ("k1", "k2", "doc_id"))
            new = np.ones(len(doc), bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            holder = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
            if key is not None and key[:2] == (k1[0], k2[0]):
                to = int(np.flatnonzero(new)[1]) if new.sum() > 1 else len(doc)
                holder[:to] = key[2]
            key = (int(k1[-1]), int(k2[-1]), int(holder[-1]))
            yield batch.filter(pa.array(holder < doc)).select(["doc_id", "text_hash", "line_no"])

    return run


def pack(dropped: list[int]) -> bytes:
    """A compressed bitmap with a 0 for each dropped line, filled up to whole bytes with 1s; lines beyond it are kept."""
    keep = np.ones(max(dropped) // 8 * 8 + 8, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def unpack(bitmap: bytes | None, n: int) -> np.ndarray:
    keep = np.ones(n, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n]
        keep[: len(bits)] = bits
    return keep


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [pack(x) for x in batch.column("lines").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(packed, pa.binary())], names=["doc_id", "text_hash", "bitmap"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, bitmap) for each document of docs(doc_id, text) that loses lines."""
    width = shuffle_width(docs.sparkSession)
    rows = _keyed(docs).where("doc_id IS NOT NULL").mapInArrow(_keys(min_chars), "k1 bigint, k2 bigint, doc_id bigint, text_hash bigint, line_no int")
    order = ("k1", "k2", "doc_id", "text_hash", "line_no")
    # The checkpoint fixes the partitions: both passes below must see the same ones.
    rows = settle(rows.repartitionByRange(width, *order).sortWithinPartitions(*order))
    carried, key = {}, None
    for end in sorted(rows.mapInArrow(_ends, "part bigint, f1 bigint, f2 bigint, l1 bigint, l2 bigint, holder bigint").collect()):
        if key is not None and key[:2] == (end.f1, end.f2):
            carried[end.part] = key
        if key is None or key[:2] != (end.l1, end.l2):
            key = (end.l1, end.l2, end.holder)
    dropped = rows.mapInArrow(_stream(carried), "doc_id bigint, text_hash bigint, line_no int")
    return dropped.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("lines")).mapInArrow(_bitmaps, "doc_id bigint, text_hash bigint, bitmap binary")


def _with_bitmaps(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs with the column bitmap; the columns are held in one struct, so no name of theirs can clash."""
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    bitmaps = settle(keep_bitmaps(docs, min_chars))
    n, size = bitmaps.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("bitmap")), F.lit(0))).first()
    return held.join(F.broadcast(bitmaps) if n <= BROADCAST_BITMAPS and size <= BROADCAST_BYTES else bitmaps, ["doc_id", "text_hash"], "left")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, bitmap in zip(batch.column("text").to_pylist(), batch.column("bitmap").to_pylist()):
            lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
            keep = unpack(bitmap, len(lines))
            kept = b"\n".join(x for x, k in zip(lines, keep) if k) if bitmap is not None else b"\n".join(lines)
            out.append((len(lines), int(len(lines) - keep.sum()), hashlib.sha256(kept).hexdigest()))
        n, dropped, sha = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def dedup_digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    joined = _with_bitmaps(docs.select("doc_id", "text"), min_chars)
    return joined.select("doc_id", F.col("row.text").alias("text"), "bitmap").mapInArrow(_digest, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, bitmap in zip(batch.column("text").to_pylist(), batch.column("bitmap").to_pylist()):
            lines = text.split("\n")
            out.append("\n".join(x for x, k in zip(lines, unpack(bitmap, len(lines))) if k))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], schema=pa.schema([batch.schema.field("row"), pa.field("kept", pa.string())]))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the repeated lines removed from text; all columns stay, n_chars (if there) is counted anew."""
    joined = _with_bitmaps(docs, min_chars)
    kept = joined.where("bitmap IS NOT NULL").select("row", F.col("row.text").alias("text"), "bitmap")
    kept = kept.mapInArrow(_apply, joined.select("row", F.lit("").alias("kept")).schema)
    whole = joined.where("bitmap IS NULL").select("row", F.col("row.text").alias("kept"))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return whole.unionByName(kept).select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
