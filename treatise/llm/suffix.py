"""Suffix-array dedup: removes every byte under a string of LENGTH bytes that also starts earlier.

Sorting every suffix of a corpus would exchange many times its size, so suffixes are sorted from anchors on. The
anchor of a LENGTH-byte string is the start of the K-byte gram in it with the smallest hash (the leftmost of
equals); equal strings have equal anchors, and neighbouring strings mostly share theirs (one anchor for about 35
bytes). The passes:

1. Texts go into compressed blocks, which are checkpointed with the number of their task: the later passes meet
   the same blocks again. Each task sends the 47-bit hashes of its blocks' anchors, each once a block with a flag
   "more than once", to the partition of the hash, and gets back one bit for each: does it stand anywhere else?
   Most anchors of a corpus are unique and end here.
2. For the others a task makes runs: the suffix from the anchor on, sorted and front-coded (length of the prefix
   shared with the suffix before, then the rest), with the bytes before the anchor. Equal spans of a run are one
   entry, the earliest; the later ones are already known to be repeats.
3. A partition merges the runs of each of its keys with a loser tree. A contender keeps the length of the prefix it
   shares with the last output; the longer one wins without a comparison, and equal ones are compared beyond that
   length only. A LENGTH-byte string that begins l bytes before its anchor stands at two entries if these share
   LENGTH - l bytes from the anchor on and l bytes before it. The first follows from the shared lengths of the
   merged order: neighbours below LENGTH - l end a class. The second follows in the same way from the order of the
   reversed bytes before the anchors. Of the entries in one class of both, all but the earliest repeat the string.
4. The repeated strings return to their blocks as intervals; their union is cut out.

A group that holds a third of all documents reaches pass 3 as one entry per run, so no task sees all its members.
The number of partitions follows from the bytes of the texts (PART_BYTES each), and hashes and runs are dealt in
KEYS keys a partition, of which one is held at a time, so what a task holds does not grow with the corpus; what
shares one 32-byte gram in different surroundings is held together, at about 400 bytes an entry.

Defined cases: null text is empty; texts under LENGTH bytes keep all bytes; documents are ordered by doc_id, those
without one last; rows that repeat a doc_id are ordered by a 32-bit hash of the text; rows that repeat doc_id and text are
one document and stay alike; texts may have any length; an empty table gives an empty result; only doc_id and text
are read, so other columns may have any name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import PrefixHash, mix, pieces, utf8
from ._store import even_key, settle, shuffle_width

LENGTH, K = 100, 32
GRAMS = LENGTH - K + 1
#: Bytes of strings in one run, entries compared at once, bytes of text in one block.
RUN_BYTES, COMPARE_ENTRIES, BLOCK_BYTES = 4 << 20, 8192, 1 << 20
#: Bytes of text for each partition, and keys of a partition.
PART_BYTES, KEYS = 64 << 20, 4
_POSITION_BITS = np.uint64(27)
_NO_ID = np.int64(2**63 - 1)


def _shut(value) -> bytes:
    return zstandard.compress(pickle.dumps(value, protocol=5), 3)


def _open(blob: bytes):
    return pickle.loads(zstandard.decompress(blob))


def _blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = even_key(TaskContext.get().partitionId(), width)
        number = first = 0
        for batch in pieces(batches, limit=BLOCK_BYTES):
            data, offsets = utf8(batch.column("text"))
            order = batch.column("order_id").to_numpy(), batch.column("text_hash").to_numpy()
            blob = _shut((first, data.tobytes(), offsets, *order))
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([number], pa.int64()), pa.array([blob], pa.binary())], names=["task", "number", "blob"])
            number, first = number + 1, first + batch.num_rows

    return run


def _least(h: np.ndarray) -> np.ndarray:
    """For each run of GRAMS hashes the place of the one with the least upper bits, the first of equal ones."""
    low = h >> _POSITION_BITS << _POSITION_BITS | np.arange(len(h)).astype(np.uint64)
    width = 1
    while 2 * width <= GRAMS:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < GRAMS:
        low = np.minimum(low[: len(low) - (GRAMS - width)], low[GRAMS - width :])
    return (low & np.uint64((1 << int(_POSITION_BITS)) - 1)).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor: its position, its hash, the first and the last start of the strings that it is the anchor of."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none.astype(np.uint64), none, none
    at = np.arange(len(data) - K + 1)
    h = PrefixHash(data).span(at, at + K)
    # A text can be longer than positions have bits, so pieces that overlap by a string's grams count from their own start.
    step = (1 << int(_POSITION_BITS)) - GRAMS + 1
    anchor = np.concatenate([begin + _least(h[begin : begin + step + GRAMS - 1]) for begin in range(0, len(h) - GRAMS + 1, step)])
    # A start counts if its string ends inside its row.
    row_end = np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= row_end)
    anchor = anchor[start]
    if not len(start):
        return none, none.astype(np.uint64), none, none
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return anchor[first], h[anchor[first]], start[first], start[last]


def _short(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 47-bit hashes of a block's anchors, whether each is there more than once, and each anchor's place among them."""
    distinct, inverse, counts = np.unique(h >> np.uint64(17), return_inverse=True, return_counts=True)
    return distinct, counts > 1, inverse


def _part(short: np.ndarray, width: int) -> np.ndarray:
    return (mix(short) % np.uint64(width)).astype(np.int64)


def _probe(keys: np.ndarray):
    parts = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sent = None, [[] for _ in range(parts)]
        for batch in batches:
            for task, blob in zip(batch.column("task").to_pylist(), batch.column("blob").to_pylist()):
                _, raw, offsets, _, _ = _open(blob)
                distinct, more, _ = _short(anchors(np.frombuffer(raw, np.uint8), offsets)[1])
                part = _part(distinct, parts)
                order = np.argsort(part, kind="stable")
                edge = np.searchsorted(part[order], np.arange(parts + 1))
                told = (distinct << np.uint64(1) | more.astype(np.uint64))[order]
                light = np.ascontiguousarray(told.view(np.uint8).reshape(-1, 8)[:, :6])
                for p in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
                    sent[p].append(light[edge[p] : edge[p + 1]].tobytes())
        rows = [(p, int(keys[p]), task, b"".join(x)) for p, x in enumerate(sent) if x]
        for at in range(0, len(rows), 500):
            part, key, tasks, blobs = zip(*rows[at : at + 500])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(key, pa.int64()), pa.array(tasks, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "key", "task", "blob"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the hashes that each task sent, one bit each: there more than once. Rows come sorted by part."""

    def told(part: int, members: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        all_ = np.concatenate([m for _, m in members])
        _, inverse, counts = np.unique(all_ >> np.uint64(1), return_inverse=True, return_counts=True)
        often = counts > 1
        often |= np.bincount(inverse, all_ & np.uint64(1), len(counts)) > 0
        bits = often[inverse]
        edge = np.cumsum([0] + [len(m) for _, m in members])
        blobs = [np.packbits(bits[a:b]).tobytes() for a, b in zip(edge, edge[1:])]
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in members], pa.int64()), pa.array([0] * len(members), pa.int32()), pa.array([part] * len(members), pa.int64()), pa.array(blobs, pa.binary())], names=["task", "kind", "number", "blob"])

    part, held = None, []
    for batch in batches:
        for p, task, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "task", "blob"))):
            if held and p != part:
                yield told(part, held)
                held = []
            full = np.zeros((len(blob) // 6, 8), np.uint8)
            full[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
            part = p
            held.append((task, full.view("<u8").ravel()))
    if held:
        yield told(part, held)


def _union(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The intervals sorted, those that overlap or touch in a document as one."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order].astype(np.int64), begin[order], end[order]
    # Shifted by document, ends of one document never reach into the next.
    far = np.int64(1) << 40
    reach = np.maximum.accumulate(end + doc * far)
    new = np.ones(len(doc), bool)
    new[1:] = begin[1:] + doc[1:] * far > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first].astype(np.uint32), begin[first].astype(np.uint32), (reach[last] - doc[first] * far).astype(np.uint32)


def shared_length(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, looked for beyond the `known` bytes."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - (((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) >> 3)


class LoserTree:
    """Merge of sorted runs of (shared length with the one before in the run, bytes)."""

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.leaves = 1
        while self.leaves < len(runs):
            self.leaves *= 2
        self.now: list[bytes | None] = [r[1][0] if r[1] else None for r in runs] + [None] * (self.leaves - len(runs))
        self.shared = [0] * self.leaves
        self.tree = [0] * self.leaves
        self.tree[0] = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.leaves:
            return node - self.leaves
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The winner of a and b goes on, the loser stays at the node with what it shares with the winner."""
        x, y = self.now[a], self.now[b]
        if y is None or x is None:
            winner, loser = (a, b) if x is not None else (b, a)
        elif self.shared[a] != self.shared[b]:
            winner, loser = (a, b) if self.shared[a] > self.shared[b] else (b, a)
        else:
            n = shared_length(x, y, self.shared[a])
            winner, loser = (a, b) if x[n:] <= y[n:] else (b, a)
            self.shared[loser] = n
        self.tree[node] = loser
        return winner

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(shared length with the output before, run, number in the run)."""
        while self.now[self.tree[0]] is not None:
            run = self.tree[0]
            yield self.shared[run], run, self.at[run]
            self.at[run] += 1
            lengths, values = self.runs[run]
            if self.at[run] < len(values):
                self.now[run], self.shared[run] = values[self.at[run]], lengths[self.at[run]]
            else:
                self.now[run] = None
            node, winner = (run + self.leaves) // 2, run
            while node:
                winner = self._play(node, winner, self.tree[node])
                node //= 2
            self.tree[0] = winner


def front_code(values: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Shared lengths with the one before, and the rests, of sorted values."""
    lengths = [0] + [shared_length(a, b) for a, b in zip(values, values[1:])]
    return lengths, [v[n:] for n, v in zip(lengths, values)]


def front_decode(lengths: list[int], rests: list[bytes]) -> list[bytes]:
    out, before = [], b""
    for n, rest in zip(lengths, rests):
        before = before[:n] + rest
        out.append(before)
    return out


class _Runs:
    """Buffers the repeated anchors of a task and gives runs per key and intervals of known repeats."""

    def __init__(self, task: int, keys: np.ndarray) -> None:
        self.task, self.keys = task, keys
        self._clear()

    def _clear(self) -> None:
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.spans: list[bytes] = []
        self.size = 0

    def add(self, first: int, raw: bytes, offsets: np.ndarray, ids: np.ndarray, hashes: np.ndarray, found: tuple[np.ndarray, ...], short: np.ndarray) -> None:
        anchor, _, begin, last = found
        row = np.searchsorted(offsets, begin, "right") - 1
        self.columns.append((ids[row], hashes[row], begin - offsets[row], last - begin + 1, anchor - begin, row + first, short))
        self.spans += [raw[a:b] for a, b in zip(begin.tolist(), (last + LENGTH).tolist())]
        self.size += int((last - begin + LENGTH).sum())

    def flush(self) -> Iterator[tuple[int, int, bytes]]:
        """(kind, key, blob): kind 0 is a run for a merge key, kind 1 has intervals for a task."""
        if not self.columns:
            return
        ids, hashes, pos, n, left, doc, short = (np.concatenate(c) for c in zip(*self.columns))
        order = np.lexsort((pos, hashes, ids))
        earliest: dict[tuple[int, bytes], int] = {}
        lefts = left.tolist()
        lead = np.fromiter((earliest.setdefault((lefts[i], self.spans[i]), i) for i in order.tolist()), np.int64, len(order))
        # A row that repeats doc_id and text is no earlier one.
        same = (ids[lead] == ids[order]) & (hashes[lead] == hashes[order]) & (pos[lead] == pos[order])
        again = order[~same]
        if len(again):
            yield 1, self.task, _shut(_union(doc[again], pos[again], pos[again] + n[again] - 1 + LENGTH))
        keep = order[same]
        part = _part(short[keep], len(self.keys))
        for p in np.unique(part).tolist():
            mine = keep[part == p]
            spans = [self.spans[i] for i in mine.tolist()]
            lefts = left[mine].tolist()
            rights = [s[k:] for s, k in zip(spans, lefts)]
            rank = sorted(range(len(mine)), key=rights.__getitem__)
            lengths, rests = front_code([rights[i] for i in rank])
            before = [spans[i][: lefts[i]] for i in rank]
            sorted_ = mine[rank]
            meta = (ids[sorted_], hashes[sorted_].astype(np.uint32), pos[sorted_].astype(np.uint32), n[sorted_].astype(np.uint8), doc[sorted_].astype(np.uint32))
            sizes = [np.fromiter(map(len, x), np.uint8, len(x)) for x in (rests, before)]
            yield 0, int(self.keys[p]), _shut((self.task, np.array(lengths, np.uint8), sizes[0], b"".join(rests), sizes[1], b"".join(before), meta))
        self._clear()


def _make_runs(keys: np.ndarray):
    parts = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows):
            for kind, key, blob in rows:
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([key], pa.int64()), pa.array([blob], pa.binary())], names=["kind", "key", "blob"])

        task, masks, used, runs = None, {}, {}, None
        for batch in batches:
            for t, kind, number, blob in zip(*(batch.column(c).to_pylist() for c in ("task", "kind", "number", "blob"))):
                if t != task:
                    if runs:
                        yield from emit(runs.flush())
                    task, masks, used, runs = t, {}, {}, _Runs(t, keys)
                if kind == 0:
                    masks[number], used[number] = np.unpackbits(np.frombuffer(blob, np.uint8)).astype(bool), 0
                    continue
                first, raw, offsets, ids, hashes = _open(blob)
                data = np.frombuffer(raw, np.uint8)
                found = anchors(data, offsets)
                distinct, _, inverse = _short(found[1])
                part = _part(distinct, parts)
                again = np.zeros(len(distinct), bool)
                order = np.argsort(part, kind="stable")
                edge = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.unique(part).tolist():
                    size = int(edge[p + 1] - edge[p])
                    again[order[edge[p] : edge[p + 1]]] = masks[p][used[p] : used[p] + size]
                    used[p] += size
                mine = np.flatnonzero(again[inverse])
                if len(mine):
                    runs.add(first, raw, offsets, ids, hashes, tuple(x[mine] for x in found), distinct[inverse[mine]])
                    if runs.size > RUN_BYTES:
                        yield from emit(runs.flush())
        if runs:
            yield from emit(runs.flush())

    return run


def _cut(joined: bytes, sizes: np.ndarray) -> list[bytes]:
    edge = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).tolist()
    return [joined[a:b] for a, b in zip(edge, edge[1:])]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of each key and give the intervals of repeated strings to their tasks; known intervals pass through."""
    key, runs = None, []
    for batch in batches:
        for kind, k, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "key", "blob"))):
            if runs and (kind, k) != key:
                yield from _merged(runs)
                runs = []
            key = (kind, k)
            if kind:
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([k], pa.int64()), pa.array([blob], pa.binary())], names=["kind", "key", "blob"])
                continue
            task, lengths, sizes, rests, before_sizes, before, meta = _open(blob)
            lengths = lengths.tolist()
            runs.append((task, lengths, front_decode(lengths, _cut(rests, sizes)), _cut(before, before_sizes), np.stack([m.astype(np.int64) for m in meta])))
    if runs:
        yield from _merged(runs)


def _merged(runs: list[tuple]) -> Iterator[pa.RecordBatch]:
    order_run, order_at, lengths = [], [], []
    for shared, run, at in LoserTree([(r[1], r[2]) for r in runs]):
        lengths.append(shared)
        order_run.append(run)
        order_at.append(at)
    shared, run, at = np.array(lengths), np.array(order_run), np.array(order_at)
    group = np.cumsum(shared < K)  # a new gram begins
    some = np.flatnonzero(np.bincount(group)[group] > 1)
    shared, run, at, group = shared[some], run[some], at[some], group[some]
    members: dict[int, list[tuple[np.ndarray, ...]]] = {}
    begin = 0
    # Groups are compared some at a time, so the arrays stay small.
    while begin < len(run):
        end = int(np.searchsorted(group, group[min(begin + COMPARE_ENTRIES, len(run)) - 1], "right"))
        _compare(runs, run[begin:end], at[begin:end], shared[begin:end], members)
        begin = end
    for task, rows in members.items():
        blob = _shut(_union(*(np.concatenate(c) for c in zip(*rows))))
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([task], pa.int64()), pa.array([blob], pa.binary())], names=["kind", "key", "blob"])


def _reversed(before: list[bytes], size: np.ndarray) -> np.ndarray:
    """(entries, GRAMS - 1) bytes: what stands before the anchors, the nearest byte first, filled up with zeros."""
    out = np.zeros((len(before), GRAMS - 1), np.uint8)
    row = np.repeat(np.arange(len(before)), size)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[row, np.repeat(size, size) - 1 - within] = np.frombuffer(b"".join(before), np.uint8)
    return out


def _compare(runs: list[tuple], run: np.ndarray, at: np.ndarray, shared: np.ndarray, out: dict) -> None:
    """The repeated strings of entries in merged order, whose shared lengths with the one before are known."""
    places = list(zip(run.tolist(), at.tolist()))
    ids, hashes, pos, n, doc = np.stack([runs[r][4][:, i] for r, i in places], 1)
    before = [runs[r][3][i] for r, i in places]
    size = np.fromiter(map(len, before), np.int64, len(before))
    near = _reversed(before, size)
    by_left = np.argsort(near.view(f"S{GRAMS - 1}").ravel(), kind="stable")
    differs = near[by_left][1:] != near[by_left][:-1]
    left_shared = np.where(differs.any(1), differs.argmax(1), GRAMS - 1)
    # Entries from the earliest on; where an anchor stands decides for each string around it alike.
    anchor = pos + size
    rank = np.lexsort((anchor, hashes, ids))
    repeated = np.zeros((len(places), GRAMS), bool)
    left_class = np.zeros(len(places), np.int64)
    for l in range(GRAMS):
        mine = rank[(size[rank] >= l) & (size[rank] - n[rank] < l)]
        if len(mine) < 2:
            continue
        left_class[by_left] = np.concatenate(([0], np.cumsum(left_shared < l)))
        both = np.cumsum(shared < LENGTH - l)[mine] * len(places) + left_class[mine]
        _, index, inverse = np.unique(both, return_index=True, return_inverse=True)
        lead = mine[index[inverse]]
        # The same place of a row that repeats doc_id and text is no earlier one.
        later = (ids[mine] != ids[lead]) | (hashes[mine] != hashes[lead]) | (anchor[mine] != anchor[lead])
        repeated[mine[later], size[mine[later]] - l] = True
    entry, nth = np.nonzero(repeated)
    if not len(entry):
        return
    new = np.ones(len(entry), bool)
    new[1:] = (entry[1:] != entry[:-1]) | (nth[1:] != nth[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(entry)) - 1
    task = np.array([runs[r][0] for r in run.tolist()])[entry[first]]
    doc, begin, end = doc[entry[first]], pos[entry[first]] + nth[first], pos[entry[first]] + nth[last] + LENGTH
    for t in np.unique(task).tolist():
        mine = task == t
        out.setdefault(t, []).append((doc[mine], begin[mine], end[mine]))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, held = None, []
    for batch in batches:
        for t, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("task", "kind", "blob"))):
            if t != task:
                task, held, table = t, [], None
            if kind == 0:
                held.append(_open(blob))
                continue
            if table is None:
                doc, begin, end = (np.concatenate(c).astype(np.int64) for c in zip(*held)) if held else (np.zeros(0, np.int64),) * 3
                order = np.argsort(doc, kind="stable")
                table, held = (doc[order], begin[order], end[order]), []
            first, raw, offsets, ids, hashes = _open(blob)
            a, b = np.searchsorted(table[0], (first, first + len(ids)))
            base = offsets[table[0][a:b] - first]
            change = np.bincount(base + table[1][a:b], minlength=len(raw) + 1) - np.bincount(base + table[2][a:b], minlength=len(raw) + 1)
            gone = np.cumsum(change)[:-1] > 0
            sums = np.concatenate(([0], np.cumsum(gone)))
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edges = offsets[:-1][(offsets[:-1] < len(gone))]
            begins[edges] = gone[edges]
            spans = np.concatenate(([0], np.cumsum(begins)))
            data = np.frombuffer(raw, np.uint8)
            removed, runs = sums[offsets[1:]] - sums[offsets[:-1]], spans[offsets[1:]] - spans[offsets[:-1]]
            kept = [data[x:y][~gone[x:y]].tobytes() if r else raw[x:y] for x, y, r in zip(offsets, offsets[1:], removed)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)), pa.array(runs.astype(np.int64)), pa.array(kept, pa.binary())],
                names=["order_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, the bytes that remain, of each document."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    width = max(shuffle_width(docs.sparkSession), -(-size // PART_BYTES))
    keys = np.array([even_key(p, width) for p in range(KEYS * width)])
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(_NO_ID)))
    rows = docs.select(order.alias("order_id"), F.xxhash64("text").bitwiseAND(0xFFFFFFFF).alias("text_hash"), F.col("text").cast("string").alias("text"))
    blocks = settle(rows.mapInArrow(_blocks(width), "task bigint, number bigint, blob binary"))
    probes = blocks.mapInArrow(_probe(keys), "part bigint, key bigint, task bigint, blob binary")
    # One order for all that is sent keeps the answers in step with the blocks.
    answers = probes.repartition(width, "key").sortWithinPartitions("part").mapInArrow(_answer, "task bigint, kind int, number bigint, blob binary")
    texts = blocks.select("task", F.lit(1).alias("kind"), "number", "blob")
    together = answers.unionByName(texts).repartition(width, "task").sortWithinPartitions("task", "kind", "number")
    made = together.mapInArrow(_make_runs(keys), "kind int, key bigint, blob binary")
    # Intervals that a task knows already travel with the runs, so these are written once.
    merged = made.repartition(width, "key").sortWithinPartitions("kind", "key").mapInArrow(_merge, "kind int, key bigint, blob binary")
    repeats = merged.select(F.col("key").alias("task"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("number"), "blob")
    out = repeats.unionByName(texts).repartition(width, "task").sortWithinPartitions("task", "kind", "number")
    out = out.mapInArrow(_cut_out, "order_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.select(F.nullif("order_id", F.lit(int(_NO_ID))).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
