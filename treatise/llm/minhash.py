"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures, confirmed on full shingle sets.

A document's set is its distinct word shingles. Equal sets are one class, whose representative is its smallest
doc_id; all that follows works on representatives. A signature has CHUNKS * PER_CHUNK values of 16 bits, each the
low bits of one min-wise hash. Two signatures that differ in at most LIMIT = 2 * CHUNKS - 1 values must, by
pigeonhole, have a chunk with at most one difference. Every chunk is therefore indexed once for each of its
values left out (all ways to make the one allowed error), so two documents under the limit share a key for sure.
At similarity 0.8 a signature of 40 values differs in 8 on average (deviation 2.5) and in more than 19 with a
probability of about 2e-5.

Links: first each document of a key is compared with the key's smallest one, which makes one pair per document and
key and suffices for the usual group of copies. Keys whose documents are then still in several components are open.
ROUNDS rounds compare the documents of open keys with another pivot in each key, drawn by a hash, if they are in
other components than it: a document meets as many pivots as it has keys. Of the keys that stay open, small ones
list their remaining pairs (at most SMALL - 1 a document). Large ones first lose the documents that can have no
link there: those of whose shingles more than a fifth stand in no other document of a large open key (their
similarity to any of these is below `percent`; counts per shingle, combined on the map side, tell). What is then
still open is compared as sets, a key in one bounded task, or, beyond BLOCK_ROWS documents or BLOCK_SHINGLES
shingles, in a task for each pair of blocks: the documents outside the key's largest component with each other and
with those in it. A task skips pairs that are connected or have an earlier key in common (their signatures tell),
so a pair is compared once, and returns the edges of a spanning forest. Every pair of a key is thus compared unless
it is connected or can't be linked, so no link between different texts is lost, and no row count grows with the
square of a group that is connected.

Components: union-find in one task up to SMALL_EDGES edges; beyond that, rounds of large-star and small-star over
the distributed edges until nothing changes, checkpointed each round.

Defined cases: null or empty text has no words, an empty set and no links; fewer words than a shingle make the
whole sequence one shingle; a null doc_id is linked with nothing and kept; rows that repeat a doc_id share their
component if their sets do, and are documents of their own if they differ; texts may have any length, sets are held
whole; of equals the smallest doc_id leads; an empty table gives an empty result; only doc_id and text are read, and
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import PrefixHash, bounds, give_back, lower_ascii, mix, pieces, utf8, words
from ._store import settle

CHUNKS, PER_CHUNK = 10, 4
VALUES = CHUNKS * PER_CHUNK
LIMIT = 2 * CHUNKS - 1
PERCENT = 80
#: Documents and shingles of one block of a large open key; a task holds two blocks, about 50 MB.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 300_000
#: Bytes of packed sets that are spread into rows at once.
SPREAD_BYTES = 2 << 20
#: Open keys up to this number are broadcast (about 40 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Rounds with drawn pivots, and the documents of an open key up to which its pairs are listed.
ROUNDS, SMALL = 1, 12
#: Edges (16 bytes each) up to which components are found in one task.
SMALL_EDGES = 500_000
#: Ids of documents to confirm, up to this number, are broadcast (about 16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 300_000
#: Bytes of a shingle's hash that are kept for the comparison of sets.
HASH_BYTES = 6

_random = np.random.default_rng(20_240_601)
_MULTIPLY = _random.integers(0, 1 << 64, VALUES, np.uint64) | np.uint64(1)
_ADD = _random.integers(0, 1 << 64, VALUES, np.uint64)
_PLACE = _random.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the rows end to end, and the rows' offsets in them."""
    n = len(offsets) - 1
    data = lower_ascii(data)
    start, end, row = words(data, offsets)
    word = PrefixHash(data).span(start, end) ^ mix((end - start).astype(np.uint64))
    edge = bounds(row, n)
    total = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for j in range(size):
        total += word[j : j + len(total)] * _PLACE[j]
    total = mix(total)
    out, counts = [], np.zeros(n, np.int64)
    for i in range(n):
        a, b = int(edge[i]), int(edge[i + 1])
        if b - a >= size:
            found = np.unique(total[a : b - size + 1])
        elif b > a:
            found = mix(np.array([(word[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            continue
        out.append(found)
        counts[i] = len(found)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(counts)))


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, VALUES) of 16 bits; rows with an empty set get zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, VALUES), np.uint16)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        for v in range(VALUES):
            least = np.minimum.reduceat(sets * _MULTIPLY[v] + _ADD[v], offsets[some])
            out[some, v] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """(rows, VALUES): for each chunk and each value left out, a hash of the chunk's other values over the number of both (6 bits)."""
    chunks = np.ascontiguousarray(signature).view("<u8").reshape(-1, CHUNKS)
    out = np.empty((len(chunks), VALUES), np.uint64)
    for c in range(CHUNKS):
        for j in range(PER_CHUNK):
            rest = chunks[:, c] & ~np.uint64(0xFFFF << 16 * j)
            number = c * PER_CHUNK + j
            out[:, number] = mix(rest + mix(np.array([number + 1], np.uint64))) << np.uint64(6) | np.uint64(number)
    return out


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets, edge = shingle_sets(*utf8(batch.column("text")), size)
            signature = signatures(sets, edge)
            some = np.diff(edge) > 0
            at = edge[:-1][some]
            f1, f2 = np.zeros(len(some), np.uint64), np.zeros(len(some), np.uint64)
            if len(at):
                f1[some], f2[some] = np.add.reduceat(mix(sets), at), np.bitwise_xor.reduceat(mix(sets * np.uint64(0x9E3779B97F4A7C15)), at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(np.diff(edge)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array([s.tobytes() for s in signature], pa.binary())], names=["doc_id", "text_hash", "n_shingles", "f1", "f2", "signature"])

    return run


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, fingerprint (f1, f2) of the set, signature."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(_sketch(size), "doc_id bigint, text_hash bigint, n_shingles bigint, f1 bigint, f2 bigint, signature binary")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(-1, VALUES)
            for at in range(0, len(signature), 5000):
                keys = chunk_keys(signature[at : at + 5000])
                rep = np.repeat(batch.column("rep").to_numpy()[at : at + 5000], VALUES)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(rep)], names=["key", "rep"])


def _pack_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets, edge = shingle_sets(*utf8(batch.column("text")), size)
            light = np.ascontiguousarray(sets.view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :])
            packed = [light[a:b].tobytes() for a, b in zip(edge, edge[1:])]
            signature = [s.tobytes() for s in signatures(sets, edge)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(packed, pa.binary()), pa.array(signature, pa.binary())], names=["rep", "shingles", "signature"])

    return run


def _full(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * |a and b| >= percent * |a or b|, for arrays of distinct values."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(-1)


def _near_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, VALUES) for c in ("ga", "gb"))
            yield batch.select(["a", "b"]).filter(pa.array(_differences(a, b) <= LIMIT))


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(_full(a), _full(b), percent) for a, b in zip(*(batch.column(c).to_pylist() for c in ("sa", "sb")))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _first_common(equal: np.ndarray) -> np.ndarray:
    """Number of the first key that two signatures share; equal is (pairs, VALUES)."""
    chunks = equal.reshape(-1, CHUNKS, PER_CHUNK)
    chunk = (chunks.sum(2) >= PER_CHUNK - 1).argmax(1)
    return chunk * PER_CHUNK + chunks[np.arange(len(chunks)), chunk].argmin(1)


def _compare_block(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Edges of a spanning forest among the group's components."""
        group = group.drop_duplicates("rep").sort_values("rep")
        root = {c: c for c in group["component"]}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        signature = np.frombuffer(b"".join(group["signature"]), "<u2").reshape(-1, VALUES)
        number, kind, crosses = int(group["key"].iloc[0]) & 63, int(group["kind"].iloc[0]), group["i"].iloc[0] != group["j"].iloc[0]
        # Pairs inside one block belong to that block's own group.
        side = (group["inside"] if kind else group["own"]).to_numpy() if kind or crosses else None
        reps, components, component = group["rep"].tolist(), group["component"].tolist(), group["component"].to_numpy()
        sets = [_full(packed) for packed in group["shingles"]]
        sizes = np.array([len(x) for x in sets])
        edge = np.concatenate(([0], np.cumsum(sizes)))
        distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
        mine = np.zeros(len(distinct), np.int32)
        edges = []
        for i in range(len(reps) - 1):
            equal = signature[i + 1 :] == signature[i]
            near = (VALUES - equal.sum(1) <= LIMIT) & (component[i + 1 :] != component[i])
            near &= 100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i])
            if side is not None:
                near &= side[i + 1 :] != side[i]
            at = np.flatnonzero(near)
            at = at[_first_common(equal[at]) == number] + i + 1 if len(at) else at
            at = at[[find(components[j]) != find(components[i]) for j in at.tolist()]] if len(at) else at
            if not len(at):
                continue
            # The shingles of i are marked, and the marks of each other document counted.
            own = ids[edge[i] : edge[i + 1]]
            mine[own] = 1
            spread = np.repeat(edge[at] - np.concatenate(([0], np.cumsum(sizes[at])[:-1])), sizes[at]) + np.arange(int(sizes[at].sum()))
            both = np.add.reduceat(mine[ids[spread]], np.concatenate(([0], np.cumsum(sizes[at])[:-1])))
            mine[own] = 0
            for j in at[100 * both >= percent * (sizes[i] + sizes[at] - both)].tolist():
                a, b = find(components[i]), find(components[j])
                if a != b:
                    root[b] = a
                    edges.append((reps[i], reps[j]))
        if len(reps) > BLOCK_ROWS // 2:
            del sets, ids, distinct
            give_back()
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run


def _spread_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, rep) of each shingle; those that a batch holds more than once come once, without rep."""
    for batch in batches:
        at = 0
        ends = np.cumsum(pc.binary_length(batch.column("shingles")).to_numpy())
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPREAD_BYTES, "right")))
            part, at = batch.slice(at, to - at), to
            sets = [_full(packed) for packed in part.column("shingles").to_pylist()]
            all_, owner = np.concatenate(sets), np.repeat(part.column("rep").to_numpy(), [len(x) for x in sets])
            distinct, first, counts = np.unique(all_, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(owner[first], mask=counts > 1)], names=["shingle", "rep"])


def _unlinkable(reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of reps(rep) that share too few shingles with all others together to be linked with one of them."""
    own = sets.join(reps, "rep")
    rows = own.select("rep", "shingles").mapInArrow(_spread_sets, "shingle bigint, rep bigint")
    alone = rows.groupBy("shingle").agg(F.min("rep").alias("rep"), F.count("*").alias("n"), F.count("rep").alias("known")).where("n = 1 AND known = 1")
    alone = alone.groupBy("rep").agg(F.count("*").alias("alone"))
    size = F.octet_length("shingles") / HASH_BYTES
    return own.join(alone, "rep").where(100 * (size - F.col("alone")) < percent * size).select("rep")


def _ids_of(reps: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, doc_id, text_hash) of reps(rep): where their texts are found."""
    return settle(reps.distinct().join(classes.select("rep", "doc_id", "text_hash"), "rep"))


def _sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """rep, shingles, signature of the representatives in ids(rep, doc_id, text_hash)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ["doc_id", "text_hash"])
    packed = rows.select("rep", "text").mapInArrow(_pack_sets(size), "rep bigint, shingles binary, signature binary")
    return packed.dropDuplicates(["rep"])  # rows that repeat


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges(a, b); component is the smallest node reachable."""
    if edges.count() <= SMALL_EDGES:
        return edges.coalesce(1).mapInArrow(_union_find, "node bigint, component bigint")
    return star_components(edges)


def star_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges(a, b); component is the smallest node reachable.

    Large-star hangs the larger neighbours of each node on its smallest one, small-star the smaller ones; both
    keep the components, and when neither changes an edge each node hangs on its component's smallest node.
    """
    pairs = lambda df: df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    state = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
    now = settle(pairs(edges))
    mark = state(now)
    while mark[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        star = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = settle(pairs(star))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        now = settle(pairs(joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))))
        after = state(now)
        if after == mark:
            break
        mark = after
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))


def _place(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))


def _with_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows joined with keys(key, ...), one row a key; a broadcast spares the hot keys the shuffle."""
    keys = settle(keys)
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key")


def _still_open(placed: DataFrame) -> DataFrame:
    """The rows of keys that span several components, with n, the rows of the key."""
    keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
    return _with_keys(placed, keys.where("low < high").select("key", "n"))


def _small(rows: DataFrame) -> DataFrame:
    """The rows of small open keys; of keys with the same documents one stays."""
    few = rows.where(F.col("n") <= SMALL)
    keys = few.groupBy("key", "n").agg(F.bit_xor(F.xxhash64("rep")).alias("who")).groupBy("n", "who").agg(F.min("key").alias("key"))
    return few.join(keys.select("key"), "key")


def _pairs_of(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a < b").distinct()


def _near_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose signatures are within the limit."""
    side = lambda r, g: classes.select(F.col("rep").alias(r), F.col("signature").alias(g))
    return settle(pairs.join(side("a", "ga"), "a").join(side("b", "gb"), "b").mapInArrow(_near_only, "a bigint, b bigint"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda r, s: sets.select(F.col("rep").alias(r), F.col("shingles").alias(s))
    return settle(pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b").mapInArrow(_confirm(percent), "a bigint, b bigint"))


def _in_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges between the components of large open keys; rows has key, rep, component."""
    sized = rows.join(sets.select("rep", (F.octet_length("shingles") / HASH_BYTES).alias("weight")), "rep")
    parts = sized.groupBy("key", "component").agg(F.count("*").alias("size"), F.sum("weight").alias("weight"))
    keys = parts.groupBy("key").agg(F.max(F.struct("size", "weight", "component")).alias("top"), F.sum("size").alias("n"), F.sum("weight").alias("weight"))
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK_ROWS, w / BLOCK_SHINGLES)).cast("int")
    inner, outer = blocks(F.col("top.size"), F.col("top.weight")), blocks(F.col("n") - F.col("top.size"), F.col("weight") - F.col("top.weight"))
    keys = keys.select("key", F.col("top.component").alias("largest"), inner.alias("inner"), outer.alias("outer"), (blocks(F.col("n"), F.col("weight")) <= 1).alias("whole"))
    placed = _with_keys(rows, keys).withColumn("inside", F.col("component") == F.col("largest"))
    own = F.pmod(F.xxhash64("rep", "key"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).cast("int")
    placed = placed.withColumn("own", F.when(F.col("whole"), 0).otherwise(own))
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    inner = F.transform(up_to(F.col("outer")), lambda i: cell(1, i, F.col("own")))
    outer = F.concat(F.transform(up_to(F.col("outer")), lambda j: cell(0, F.least("own", j), F.greatest("own", j))), F.transform(up_to(F.col("inner")), lambda j: cell(1, F.col("own"), j)))
    cells = F.when(F.col("whole"), F.array(cell(0, F.lit(0), F.lit(0)))).when(F.col("inside"), inner).otherwise(outer)
    spread = placed.select("key", "rep", "component", "inside", "own", F.explode_outer(cells).alias("cell"))
    return settle(spread.select("key", "rep", "component", "inside", "own", "cell.*").join(sets, "rep").groupBy("key", "kind", "i", "j").applyInPandas(_compare_block(percent), "a bigint, b bigint"))


def _more_edges(members: DataFrame, edges: DataFrame, labels: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame | None:
    """The labels after all that the first pivots left open has been compared; None if that was nothing."""
    rows = settle(_still_open(_place(members, labels)))
    if rows.isEmpty():
        return None
    sets = settle(_sets_of(docs, _ids_of(rows.select("rep"), classes), size))
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            pivots = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "key", F.lit(turn)).alias("h"), "rep", "component")).alias("p"))
            pairs = _pairs_of(_with_keys(rows, pivots).where(F.col("component") != F.col("p.component")).select("rep", F.col("p.rep").alias("pivot")), "rep", "pivot")
        else:
            few = _small(rows)
            other = few.select("key", F.col("rep").alias("other"), F.col("component").alias("other_component"))
            pairs = _pairs_of(few.join(other, "key").where("rep < other AND component <> other_component"), "rep", "other")
        edges = edges.unionByName(_confirmed(_near_pairs(pairs, classes), sets, percent))
        labels = settle(components(edges))
        rows = settle(_still_open(_place(rows.select("key", "rep"), labels)))
    large = rows.where(F.col("n") > SMALL).select("key", "rep", "component")
    if not large.isEmpty():
        alone = settle(_unlinkable(large.select("rep").distinct(), sets, percent))
        large = settle(_still_open(large.join(alone, "rep", "left_anti")).select("key", "rep", "component"))
    if not large.isEmpty():
        labels = settle(components(edges.unionByName(_in_blocks(large, sets, percent))))
    return labels


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of each document."""
    found = settle(sketch(docs, size))
    some = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    least = F.min(F.struct("doc_id", "text_hash", "signature")).alias("least")
    classes = settle(some.groupBy("f1", "f2").agg(least).select("f1", "f2", "least.*").withColumn("rep", F.col("doc_id")))
    # Where one doc_id stands for several sets, classes are told apart by a hash of their fingerprint instead.
    shared = not classes.groupBy("rep").count().where("count > 1").isEmpty()
    if shared:
        classes = classes.withColumn("rep", F.xxhash64("f1", "f2"))
    index = classes.select("rep", "signature").mapInArrow(_index, "key bigint, rep bigint")
    firsts = index.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select("key", "first")
    members = settle(index.join(firsts, "key"))
    pairs = _near_pairs(_pairs_of(members, "first", "rep"), classes)
    ids = _ids_of(pairs.select(F.explode(F.array("a", "b")).alias("rep")), classes)
    edges = _confirmed(pairs, _sets_of(docs, ids, size), percent)
    labels = settle(components(edges))
    labels = _more_edges(members.select("key", "rep"), edges, labels, docs, classes, size, percent) or labels
    labels = labels.withColumnRenamed("node", "rep")
    if shared:
        smallest = labels.join(classes.select("rep", "doc_id"), "rep").groupBy("component").agg(F.min("doc_id").alias("doc_id"))
        labels = labels.join(smallest, "component").select("rep", F.col("doc_id").alias("component"))
    placed = classes.select("f1", "f2", "rep", "doc_id").join(labels, "rep", "left").select("f1", "f2", F.coalesce("component", "doc_id").alias("component"))
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = found.join(placed, ["f1", "f2"], "left").withColumn("component_id", F.when(linkable, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicate_digests(docs: DataFrame, size: int = 4, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return near_duplicates(docs, size, percent).drop("text_hash")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of docs of which each group of near copies keeps the smallest doc_id, with the same columns."""
    gone = settle(near_duplicates(docs, size, percent).where("NOT kept").select("doc_id", "text_hash").distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    return held.join(gone, ["doc_id", "text_hash"], "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
