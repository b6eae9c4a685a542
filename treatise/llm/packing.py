"""Packing: bounded-space online best fit into windows of a fixed number of tokens.

Each task tokenises its documents and keeps at most `open_windows` windows open. A document gives whole windows
as often as it fills them; its rest goes where it fits best. When it fits nowhere, the fullest window is emitted
and a new one opened. The windows still open at the end of the partitions are merged by best fit decreasing, for
a bounded number of partitions at once and without a shuffle.

Tokens: a tokenizer that lower-cases, drops white space and ends words between a letter and a sign is fed with
distinct pieces: texts are cut at spaces, tabs and line ends and between an ASCII letter and an ASCII sign, where
its words end in any case, and a worker remembers the ids of the pieces it has met. Texts with a `<|`, which may
spell a special token, and all texts for other tokenizers, are encoded whole. Then id 1 ends the document.

Defined cases: null text is empty (the document is id 1 alone); repeated rows are packed each for itself; an empty
table gives an empty result; a null doc_id is carried as it is; a text of any length gives as many pieces as it
needs; of windows with equal room the one opened first is taken, and of equally full ones the one opened first is
emitted; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import PrefixHash, lower_ascii, pieces, utf8, words
from ._store import settle

WINDOW = 2048
OPEN_WINDOWS = 64
#: Partitions whose open windows are merged in one task.
MERGE_PARTITIONS = 16
END_ID = 1
#: Distinct pieces whose ids a worker remembers, at about 40 bytes each.
REMEMBER = 2_000_000

_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x09, 0x0A, 0x0D]] = True
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Known:
    """Ids of pieces by their hash: sorted arrays, with the newest in a smaller one that is merged now and then."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.old, self.new = empty, empty

    def __len__(self) -> int:
        return len(self.old[0]) + len(self.new[0])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size in the pool of each key; size -1 where it isn't known."""
        start, size = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        for have, begin, n in (self.old, self.new):
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[at] == keys
                start[hit], size[hit] = begin[at[hit]], n[at[hit]]
        return start, size

    def add(self, keys: np.ndarray, ids: list[np.ndarray]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(size.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(total, len(self.pool) // 2), np.uint32)))
        self.pool[self.used : self.used + total] = np.concatenate(ids)
        entry = (keys, self.used + np.cumsum(size) - size, size)
        self.used += total
        self.new = self._merged(self.new, entry)
        if len(self.new[0]) > max(1 << 15, len(self.old[0]) // 8):
            self.old, self.new = self._merged(self.old, self.new), tuple(x[:0] for x in self.new)

    @staticmethod
    def _merged(a, b):
        order = np.argsort(np.concatenate((a[0], b[0])), kind="stable")
        return tuple(np.concatenate((x, y))[order] for x, y in zip(a, b))


@cache
def _tokenizer(path: str):
    """The tokenizer, whether pieces may be encoded on their own, the ids of the pieces met, and which ids end a word."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    told = json.loads(tokenizer.to_str())
    first = ((told["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    apart = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and "|[\\p{L}]+|" in first["pattern"]["Regex"] and not told["post_processor"]
    lowers = any(x["type"] == "Lowercase" for x in (told["normalizer"] or {}).get("normalizers", []))
    suffix = told["model"].get("end_of_word_suffix")
    last = np.zeros(tokenizer.get_vocab_size(), bool)
    if suffix:
        last[[i for token, i in told["model"]["vocab"].items() if token.endswith(suffix)]] = True
    # For pieces of lower-case ASCII letters the normaliser and the byte map change nothing.
    light = Tokenizer.from_str(json.dumps(told | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
    return (tokenizer, light), bool(apart and lowers and suffix), _Known(), last


def token_ids(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the rows end to end, each row ended by END_ID, and the rows' offsets in them."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    tokenizer, piecewise, known, last = _tokenizer(path)
    n = len(offsets) - 1
    raw = data.tobytes()
    whole = set(range(n)) if not piecewise else set()
    at = raw.find(b"<|") if piecewise else -1
    while at >= 0:
        row = int(np.searchsorted(offsets, at, "right")) - 1
        whole.add(row)
        at = raw.find(b"<|", int(offsets[row + 1]))
    ids, size = _pieces_ids(data, offsets, tokenizer, known, last) if piecewise else (np.zeros(0, np.uint32), np.zeros(n, np.int64))
    edge = np.concatenate(([0], np.cumsum(size)))
    if whole:
        parts = [ids[edge[i] : edge[i + 1]] for i in range(n)]
        for i in whole:
            parts[i] = np.array(tokenizer[0].encode(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        ids, edge = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    # END_ID after each row.
    new_edge = edge + np.arange(n + 1)
    out = np.full(len(ids) + n, END_ID, np.uint32)
    keep = np.ones(len(out), bool)
    keep[new_edge[1:] - 1] = False
    out[keep] = ids
    return out, new_edge


def _pieces_ids(data: np.ndarray, offsets: np.ndarray, tokenizer, known: _Known, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lowered = lower_ascii(data)
    cuts = np.flatnonzero(_LETTER[data[:-1]] & _SIGN[data[1:]]) + 1
    start, end, row = words(data, offsets, _CUT, cuts)
    distinct, first, inverse = np.unique(PrefixHash(lowered).span(start, end), return_index=True, return_inverse=True)
    if len(known) > REMEMBER:
        known.clear()
    begin, size = known.find(distinct)
    new = np.flatnonzero(size < 0)
    if len(new):
        raw = lowered.tobytes()
        texts = [raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())]
        known.add(distinct[new], _encode_pieces(texts, tokenizer, last))
        begin, size = known.find(distinct)
    each = size[inverse]
    total = np.cumsum(each)
    at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin[inverse] - (total - each), each)
    return known.pool[at], np.bincount(row, each, len(offsets) - 1).astype(np.int64)


def _encode_pieces(texts: list[bytes], tokenizer, last: np.ndarray) -> list[np.ndarray]:
    """Ids of each piece. Pieces of letters are one word each, so many are encoded in one call and told apart by the tokens that end a word."""
    full, light = tokenizer
    out: list[np.ndarray | None] = [None] * len(texts)
    plain, letters, rest = [], [], []
    for i, t in enumerate(texts):
        if t.isalpha():  # of bytes: ASCII letters only
            plain.append(i)
        else:
            s = t.decode("utf-8", "replace")
            (letters if s.isalpha() and unicodedata.normalize("NFC", s).lower().isalpha() else rest).append(i)
    for which, members in ((light, plain), (full, letters)):
        for at in range(0, len(members), 500):
            group = members[at : at + 500]
            ids = np.array(which.encode_batch_fast([b" ".join(texts[i] for i in group).decode()], add_special_tokens=False)[0].ids, np.uint32)
            edge = np.concatenate(([0], np.flatnonzero(last[ids]) + 1)).tolist()
            for i, a, b in zip(group, edge, edge[1:]):
                out[i] = ids[a:b]
    for i, found in zip(rest, full.encode_batch_fast([texts[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False)):
        out[i] = np.array(found.ids, np.uint32)
    return out


class OpenWindows:
    """The windows of a task: a sorted list of (room left, window number)."""

    def __init__(self, window: int, most: int) -> None:
        self.window, self.most, self.open, self.next = window, most, [], 0

    def whole(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, length: int) -> tuple[int, int]:
        """Window number and offset for a piece shorter than a window."""
        at = bisect_left(self.open, (length, -1))
        if at < len(self.open):
            room, number = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                self.open.pop(0)  # the fullest is emitted as it is
            room, number = self.window, self.whole()
        if room > length:
            insort(self.open, (room - length, number))
        return number, self.window - room


_PIECES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
_PIECES_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _batch(rows: list[tuple], extra: list[bool] | None = None) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_PIECES)
    arrays = [pa.array(c, t) for c, (_, t) in zip(columns, _PIECES)]
    names = [n for n, _ in _PIECES]
    return pa.RecordBatch.from_arrays(arrays + ([pa.array(extra, pa.bool_())] if extra is not None else []), names=names + (["open"] if extra is not None else []))


def _pack(window: int, most: int, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, state, rows = TaskContext.get().partitionId() << 32, OpenWindows(window, most), []
        for batch in pieces(batches):
            ids, edge = token_ids(*utf8(batch.column("text")), path)
            edges = edge.tolist()
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), edges, edges[1:]):
                for at in range(a, b, window):
                    length = min(window, b - at)
                    number, offset = (state.whole(), 0) if length == window else state.place(length)
                    rows.append((doc, at - a, length, zlib.crc32(ids[at : at + length].astype("<u4").tobytes()), b - a, base | number, offset))
            if len(rows) > 20_000:
                # What still is open may yet grow; its rows wait. They are few: `most` windows of small pieces.
                waiting = {base | number for _, number in state.open}
                yield _batch(done := [r for r in rows if r[5] not in waiting], [False] * len(done))
                rows = [r for r in rows if r[5] in waiting]
        waiting = {base | number for _, number in state.open}
        if rows:
            yield _batch(rows, [r[5] in waiting for r in rows])

    return run


def _merge(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n, _ in _PIECES)):
                held.setdefault(row[5], []).append(row)
        used = {s: max(r[6] + r[2] for r in rows) for s, rows in held.items()}
        bins: list[tuple[int, int]] = []
        out = []
        for sequence in sorted(held, key=lambda s: (-used[s], s)):
            at = bisect_left(bins, (used[sequence], -1))
            room, target = bins.pop(at) if at < len(bins) else (window, sequence)
            out += [(*r[:5], target, r[6] + window - room) for r in held[sequence]]
            insort(bins, (room - used[sequence], target))
        if out:
            yield _batch(out)

    return run


def pack_documents(docs: DataFrame, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_pack(window, open_windows, path), _PIECES_DDL + ", open boolean")
    rows = settle(rows)
    names = [n for n, _ in _PIECES]
    tasks = max(1, rows.rdd.getNumPartitions() // MERGE_PARTITIONS)
    left = rows.where("open").select(names).coalesce(tasks).mapInArrow(_merge(window), _PIECES_DDL)
    return rows.where("NOT open").select(names).unionByName(left)
