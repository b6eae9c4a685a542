"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader.

Features of a text, each hashed into `2**bits` slots: its words and word pairs, lower-cased in ASCII; the shapes
of its words and pairs of shapes (runs of lower-case letters, capitals and digits count once, other characters
as they are); and for each word whether one of the two words before it was the same. The value of a feature is
its share of the text's words times `SCALE`, so a score is a sparse dot product: a mean of looked-up weights.

The fit is one task over a bounded sample of labelled rows: the `max_labelled` rows with the smallest hash of
doc_id among those that may be learned from. It runs `epochs` times over them in that order with FTRL-proximal
updates (per-coordinate rates, L1 and L2 terms). Scoring reads every whole text of the table.

Defined cases: null or empty text is scored by the bias alone; without labelled rows every score is 0.5; labels
with null quality are not learned from; a doc_id labelled more than once counts with its smallest label; only the
columns doc_id and text are read, so other columns may have any name; rows with one doc_id and text are learned
from once; texts may have any length, and the sample's reach the fitting task whole; an empty table gives an empty
result. A score of exactly the threshold counts as good.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import PrefixHash, bounds, give_back, lower_ascii, mix, pieces, utf8, words

SCALE = 8.0
THRESHOLD = 0.3
FOLDS = 5


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    max_labelled: int = 10_000
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 0.5
    l1: float = 0.02
    l2: float = 0.05


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")
_RUNS = np.zeros(256, bool)
_RUNS[[ord("a"), ord("A"), ord("0")]] = True


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot and row of every n-gram occurrence, and the number of words of each row."""
    start, end, row = words(data, offsets)
    mask = np.uint64((1 << bits) - 1)
    word = PrefixHash(lower_ascii(data)).span(start, end)
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | ~_RUNS[shape[1:]]
    keep[start] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    form = PrefixHash(shape[keep]).span(at[start], at[end])
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    again = pair[(word[pair] == word[pair + 1])] + 1
    triple = pair[pair + 2 < len(row)]
    triple = triple[row[triple + 2] == row[triple]]
    second = triple[word[triple] == word[triple + 2]] + 2
    salt = lambda i: np.uint64(0x5851F42D4C957F2D * (i + 1) & (1 << 64) - 1)
    both = lambda h, i: mix(h[pair] * np.uint64(3) + mix(h[pair + 1] + salt(i)))
    hashes = [mix(word ^ salt(0)), mix(form ^ salt(1)), both(word, 2), both(form, 3), np.full(len(again), mix(np.array([salt(4)]))[0]), np.full(len(second), mix(np.array([salt(5)]))[0])]
    rows = [row, row, row[pair], row[pair], row[again], row[second]]
    return (np.concatenate(hashes) & mask).astype(np.int64), np.concatenate(rows), np.diff(bounds(row, len(offsets) - 1))


def fit(texts: list[str], labels: list[int], settings: Settings) -> np.ndarray:
    """Weights of the slots, and the bias last."""
    size = (1 << settings.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    examples = []
    for text, label in zip(texts, labels):
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        slot, _, count = features(data, np.array([0, len(data)]), settings.bits)
        slots, often = np.unique(slot, return_counts=True)
        examples.append((np.append(slots, size - 1).astype(np.int32), often.astype(np.int32), SCALE / max(1, count[0]), label))
    weight = lambda i: np.where(np.abs(z[i]) <= settings.l1, 0.0, -(z[i] - np.sign(z[i]) * settings.l1) / ((settings.beta + np.sqrt(n[i])) / settings.alpha + settings.l2))
    for _ in range(settings.epochs):
        for i, often, scale, label in examples:
            w, x = weight(i), np.append(often * scale, 1.0)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            after = n[i] + g * g
            z[i] += g - (np.sqrt(after) - np.sqrt(n[i])) / settings.alpha * w
            n[i] = after
    return weight(np.arange(size))


def score(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bits: int) -> np.ndarray:
    slot, row, count = features(data, offsets, bits)
    total = np.bincount(row, weights[slot], len(offsets) - 1)
    margin = weights[-1] + total * SCALE / np.maximum(count, 1)
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _fit_all(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((o, d, t or "", q) for b in batches for o, d, t, q in zip(*(b.column(c).to_pylist() for c in ("ordinal", "doc_id", "text", "quality"))))
        if rows:
            weights = fit([r[2] for r in rows], [r[3] for r in rows], settings).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([base64.b64encode(zlib.compress(weights.tobytes())).decode()])], names=["weights"])
        del rows
        give_back()

    return run


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Weights learned from the bounded sample; what the driver receives has the size of the weights."""
    order = F.xxhash64("doc_id")
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    marked = marked.where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = marked.withColumn("ordinal", order).orderBy("ordinal", "doc_id").limit(settings.max_labelled)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # The sample has max_labelled rows of three numbers at most, so broadcasting it is bounded.
    rows = texts.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id", "text"]).select("ordinal", "doc_id", "text", "quality")
    found = rows.coalesce(1).mapInArrow(_fit_all(settings), "weights string").collect()
    size = (1 << settings.bits) + 1
    return np.frombuffer(zlib.decompress(base64.b64decode(found[0].weights)), np.float32).astype(float) if found else np.zeros(size)


def _score(weights: np.ndarray, bits: int):
    light = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = light.astype(float)
        for batch in pieces(batches):
            found = score(*utf8(batch.column("text")), full, bits)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found)], schema=pa.schema([batch.schema.field("row"), pa.field("score", pa.float64())]))

    return run


def score_documents(docs: DataFrame, weights: np.ndarray, settings: Settings = Settings(), carry: list[str] | None = None) -> DataFrame:
    """A struct `row` of the columns in `carry` (all by default) and the score of each document."""
    rows = docs.select(F.struct(*(F.col(c) for c in carry or docs.columns)).alias("row"), "text")
    schema = rows.select("row", F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(_score(weights, settings.bits), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score_documents(docs, train(docs, labels, settings), settings, ["doc_id"]).select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "score")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with the same columns."""
    scored = score_documents(docs, train(docs, labels, settings), settings)
    return scored.where(F.col("score") >= THRESHOLD).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
