"""Media columns: baseline JPEG written and read back in numpy, for whole batches of files at once.

A payload is stored losslessly in the unit of its format, the quantised coefficient: byte b is coefficient
b - 128 of an 8x8 block (64 bytes a block, three blocks of the components Y, Cb, Cr an MCU, so 192 bytes). All
quantiser steps are 1. A restart marker follows every MCU row of the encoder's choice (here every MCU), so the
entropy-coded segments are short and independent: they are decoded in lock step, one Huffman symbol of every
segment at a time. The decoder parses the markers of any baseline file (DQT, SOF0, DHT, DRI, SOS, COM), with any
sampling factors of an interleaved scan and with or without restarts.

Features: width, height, and a thumbnail from the DC coefficients of the luminance alone (one pixel a block),
its SHA-256 and a 64-bit difference hash of its 9x8 reduction.

Defined cases: null text is empty; an empty text is one MCU of spaces; a file that is not baseline JPEG raises
ValueError in parse() and yields null columns in the DataFrame operator; equal texts give equal files, whichever
rows they stand in; texts may have any length up to the 12 GB that a near-square file holds; an empty table gives an empty result; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import pieces, utf8

UNIT = 192

def huffman_codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a canonical table."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = (code, length)
            code += 1
        at, code = at + n, code << 1
    return out


@cache
def encoder_tables() -> tuple[tuple[list[int], list[int]], tuple[list[int], list[int]]]:
    """DC and AC tables (counts by length, symbols). Coefficients of text are seldom zero and have up to 8 bits."""
    dc = ([0, 1, 3, 4, 2, 1, 1] + [0] * 9, [5, 4, 7, 3, 6, 8, 2, 1, 0, 9, 10, 11])
    often = [5, 4, 7, 3, 6, 2, 8, 1]  # sizes of run 0
    rest = [r << 4 | s for r in range(1, 16) for s in range(1, 9)] + [0x00, 0xF0]
    counts = [0] * 16
    counts[0], counts[2], counts[3], counts[4], counts[5], counts[6], counts[7] = 1, 2, 1, 1, 1, 1, 1
    counts[12] = len(rest)
    return dc, (counts, often + rest)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def geometry(mcus: int) -> tuple[int, int]:
    """Columns and rows of MCUs, near square; both stay far under the format's 65,535 pixels."""
    across = max(1, int(np.ceil(np.sqrt(mcus))))
    return across, -(-mcus // across)


@cache
def _head(across: int, down: int, size: int) -> bytes:
    dc, ac = encoder_tables()
    table = lambda kind, t: bytes([kind, *t[0], *t[1]])
    out = b"\xff\xd8" + _segment(0xFE, b"payload %d" % size) + _segment(0xDB, bytes([0]) + b"\x01" * 64)
    out += _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
    out += _segment(0xC4, table(0x00, dc)) + _segment(0xC4, table(0x10, ac)) + _segment(0xDD, struct.pack(">H", 1))
    return out + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))


def payload(text: bytes) -> bytes:
    """text with spaces up to a positive multiple of the unit."""
    return text + b" " * (UNIT * max(1, -(-len(text) // UNIT)) - len(text))


@cache
def _codes() -> tuple[np.ndarray, ...]:
    dc, ac = (huffman_codes(*t) for t in encoder_tables())
    out = []
    for table in (dc, ac):
        code, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
        for symbol, (c, n) in table.items():
            code[symbol], length[symbol] = c, n
        out += [code, length]
    size = np.zeros(1 << 12, np.int64)
    for v in range(1, 1 << 12):
        size[v] = v.bit_length()
    return (*out, size)


def _scans(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes (unstuffed, padded with 1s) of MCUs of shape (n, 3, 64) in zigzag order, and their offsets."""
    dc_code, dc_len, ac_code, ac_len, size_of = _codes()
    n = len(values)
    flat = values.reshape(n, 192)
    sizes = size_of[np.abs(flat)]
    bits = np.where(flat < 0, flat + (1 << sizes) - 1, flat).astype(np.uint64)
    is_dc = np.zeros(192, bool)
    is_dc[::64] = True
    code, length = np.empty((n, 192), np.uint64), np.empty((n, 192), np.int64)
    code[:, is_dc], length[:, is_dc] = dc_code[sizes[:, is_dc]], dc_len[sizes[:, is_dc]]
    code[:, ~is_dc], length[:, ~is_dc] = ac_code[sizes[:, ~is_dc]], ac_len[sizes[:, ~is_dc]]
    code = code << sizes.astype(np.uint64) | bits
    length += sizes
    zero = (flat == 0) & ~is_dc
    for i in np.flatnonzero(zero.any(1)):  # few MCUs hold byte 128; theirs are the runs of zeros
        _with_runs(flat[i], zero[i], code[i], length[i], ac_code, ac_len, sizes[i], bits[i])
    total = length.sum(1)
    start_byte = np.concatenate(([0], np.cumsum(-(-total // 8))))
    ends = np.cumsum(length, 1)
    at = start_byte[:-1, None] * 8 + ends - length
    pad = -total % 8
    word = at >> 5
    # A symbol has at most 32 bits (16 of code, 16 of value), so it lies in two words of 32 bits at most.
    shift = 64 - (at & 31) - length
    wide = np.where(length > 0, code << shift.astype(np.uint64), np.uint64(0))
    words = int(start_byte[-1] // 4 + 3)
    out = np.bincount(word.ravel(), (wide >> np.uint64(32)).astype(np.float64).ravel(), words)
    out += np.bincount(word.ravel() + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64).ravel(), words)
    data = out.astype(np.uint64).astype(">u4").view(np.uint8)[: start_byte[-1]].copy()
    data[start_byte[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    return data, start_byte


def _with_runs(flat, zero, code, length, ac_code, ac_len, sizes, bits) -> None:
    """Fold the zeros of one MCU into the symbols after them, in place; three ZRL codes at most precede a symbol."""
    for block in range(0, 192, 64):
        run = 0
        for k in range(block + 1, block + 64):
            if zero[k]:
                code[k], length[k] = 0, 0
                run += 1
                if run % 16 == 0 and (flat[k + 1 : block + 64] != 0).any():
                    code[k], length[k] = ac_code[0xF0], ac_len[0xF0]
            else:
                symbol = (run % 16) << 4 | int(sizes[k])
                code[k] = ac_code[symbol] << np.uint64(sizes[k]) | bits[k]
                length[k] = ac_len[symbol] + sizes[k]
                run = 0
        if run:
            code[block + 63], length[block + 63] = ac_code[0], ac_len[0]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG file for each payload, whose length is a positive multiple of 192."""
    shapes = [geometry(len(p) // UNIT) for p in payloads]
    filled = [p + b" " * (a * d * UNIT - len(p)) for p, (a, d) in zip(payloads, shapes)]
    values = np.frombuffer(b"".join(filled), np.uint8).astype(np.int64) - 128
    data, start = _scans(values.reshape(-1, 3, 64))
    # Stuff a 0 after each 255, then put a restart marker between the segments of a file.
    full = np.flatnonzero(data == 255)
    shifted = start + np.searchsorted(full, start)
    stuffed = np.insert(data, full + 1, 0).tobytes()
    out, at = [], 0
    for p, (a, d) in zip(payloads, shapes):
        n = a * d
        edge = shifted[at : at + n + 1]
        body = bytearray(edge[-1] - edge[0] + 2 * (n - 1))
        view = np.frombuffer(body, np.uint8)
        where = np.arange(edge[-1] - edge[0]) + 2 * (np.repeat(np.arange(n), np.diff(edge)))
        view[where] = np.frombuffer(stuffed, np.uint8, edge[-1] - edge[0], edge[0])
        if n > 1:
            marks = edge[1:-1] - edge[0] + 2 * np.arange(n - 1)
            view[marks] = 0xFF
            view[marks + 1] = 0xD0 + np.arange(n - 1) % 8
        out.append(_head(a, d, len(p)) + bytes(body) + b"\xff\xd9")
        at += n
    return out


def parse(file: bytes) -> dict:
    """The markers of a baseline file: frame, tables, restart interval, comment and the scan's bytes."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    out = {"huffman": {}, "quant": {}, "restart": 0, "comment": b""}
    at = 2
    while True:
        while file[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(file) or file[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = file[at + 1], int.from_bytes(file[at + 2 : at + 4], "big")
        body = file[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC0:
            _, out["height"], out["width"], n = struct.unpack(">BHHB", body[:6])
            out["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a baseline frame")
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                out["huffman"][body[0]] = (tuple(counts), tuple(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            out["restart"] = int.from_bytes(body, "big")
        elif marker == 0xDA:
            out["scan"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            end = file.rfind(b"\xff\xd9")
            out["data"] = file[at : end if end >= at else len(file)]
            break
    if "parts" not in out or {p[0] for p in out["parts"]} != set(out["scan"]):
        raise ValueError("not one interleaved scan")
    return out


_DIRECT, _STOP = 1 << 26, 1 << 27


@cache
def _lookup(counts: tuple[int, ...], symbols: tuple[int, ...], is_dc: bool) -> np.ndarray:
    """What the next 16 bits say: bits to skip (6), coefficients to advance (7), value + 4096 (13), flags.

    Where code and value fit into 16 bits the value is in the table (_DIRECT); else the fields hold the length of
    the code (6), the advance (7) and the size of the value (13). 0 marks bits that start no code.
    """
    out = np.zeros(1 << 16, np.int64)
    for symbol, (code, length) in huffman_codes(list(counts), list(symbols)).items():
        run, size = (0, symbol & 15) if is_dc else (symbol >> 4, symbol & 15)
        low, high = code << (16 - length), (code + 1) << (16 - length)
        if not is_dc and size == 0 and run != 15:
            out[low:high] = length | 127 << 6 | 4096 << 13 | _DIRECT | _STOP
        elif length + size <= 16:
            bits = (np.arange(low, high) >> (16 - length - size)) & ((1 << size) - 1)
            value = np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits) if size else bits
            out[low:high] = (length + size) | (run + 1) << 6 | (value + 4096) << 13 | _DIRECT
        else:
            out[low:high] = length | (run + 1) << 6 | size << 13
    return out


def _plan(head: dict) -> tuple:
    """What files must share to be decoded in lock step."""
    if len(head["parts"]) == 1:  # a scan of one component is not interleaved: its MCU is one block
        layout = ((0, 1),)
    else:
        layout = tuple((i, h * v) for i, (_, h, v, _) in enumerate(head["parts"]))
    tables = tuple((head["huffman"][head["scan"][p[0]][0]], head["huffman"][0x10 | head["scan"][p[0]][1]]) for p in head["parts"])
    return layout, tables


def _mcus(head: dict) -> int:
    wide, high = (1, 1) if len(head["parts"]) == 1 else (max(p[1] for p in head["parts"]), max(p[2] for p in head["parts"]))
    return -(-head["width"] // (8 * wide)) * -(-head["height"] // (8 * high))


def decode(heads: list[dict]) -> list[np.ndarray]:
    """Quantised coefficients (MCUs, blocks of an MCU, 64; zigzag order, absolute DC) of each parsed file."""
    out: list[np.ndarray | None] = [None] * len(heads)
    plans: dict[tuple, list[int]] = {}
    for i, head in enumerate(heads):
        plans.setdefault(_plan(head), []).append(i)
    for (layout, tables), members in plans.items():
        counts = [_mcus(heads[i]) for i in members]
        values = _decode_alike([heads[i] for i in members], counts, layout, tables)
        edge = np.concatenate(([0], np.cumsum(counts)))
        for j, i in enumerate(members):
            out[i] = values[edge[j] : edge[j + 1]]
    return out


def _decode_alike(heads: list[dict], counts: list[int], layout, tables) -> np.ndarray:
    blocks = np.repeat([i for i, _ in layout], [n for _, n in layout])
    per = len(blocks)
    data = np.frombuffer(b"".join(h["data"] for h in heads), np.uint8)
    file_end = np.cumsum([len(h["data"]) for h in heads])
    file_start = file_end - [len(h["data"]) for h in heads]
    # A lane is a restart interval: where it starts in the data, and its MCUs.
    full = np.flatnonzero(data[:-1] == 255)
    mark = full[(data[full + 1] >= 0xD0) & (data[full + 1] <= 0xD7)]
    stuffed = full[data[full + 1] == 0] + 1
    keep = np.ones(len(data), bool)
    keep[stuffed] = keep[mark] = keep[mark + 1] = False
    position = np.concatenate(([0], np.cumsum(keep)))
    lanes, lane_mcus = [], []
    for h, n, a, b in zip(heads, counts, file_start, file_end):
        step = h["restart"] or n
        starts = np.concatenate(([a], mark[np.searchsorted(mark, a) : np.searchsorted(mark, b)] + 2)) if h["restart"] else np.array([a])
        if len(starts) != -(-n // step):
            raise ValueError("a restart interval is missing")
        lanes.append(position[starts])
        lane_mcus.append(np.minimum(step, n - step * np.arange(len(starts))))
    start, todo = np.concatenate(lanes), np.concatenate(lane_mcus)
    clean = np.concatenate((data[keep], np.full(8, 255, np.uint8))).astype(np.uint64)
    ahead = np.zeros(len(clean) - 4, np.uint64)  # 40 bits from each byte on
    for i in range(5):
        ahead |= clean[i : len(clean) - 4 + i] << np.uint64(32 - 8 * i)
    shared = all(t == tables[0] for t in tables)
    own = tables[:1] if shared else tables
    lut = np.concatenate([_lookup(*d, True) for d, _ in own] + [_lookup(*a, False) for _, a in own])
    values = np.zeros(int(todo.sum()) * per * 64, np.int16)
    # The state of the lanes that still have blocks: next bit, next coefficient, where the block starts, blocks left.
    bit, k, left = start.astype(np.int64) * 8, np.zeros(len(start), np.int64), todo * per
    base = (np.cumsum(todo) - todo) * per * 64
    limit = len(ahead) - 1
    while len(bit):
        window = ahead[np.minimum(bit >> 3, limit)] << (24 + (bit & 7)).astype(np.uint64)
        which = np.where(k == 0, 0, len(own) << 16)
        if not shared:
            which += blocks[(base >> 6) % per] << 16
        found = lut[(window >> np.uint64(48)).astype(np.int64) + which]
        skip, k_next, value = found & 63, k + (found >> 6 & 127), (found >> 13 & 8191) - 4096
        direct = found >= _DIRECT
        if not direct.all():
            if not found.all():
                raise ValueError("a code is in no table")
            for_these = np.flatnonzero(~direct)
            size = value[for_these] + 4096
            bits = ((window[for_these] << skip[for_these].astype(np.uint64)) >> (64 - size).astype(np.uint64)).astype(np.int64)
            value[for_these] = np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)
            skip[for_these] += size
        over = k_next >= 64
        if over.any():
            put = (found < _STOP) & (k_next <= 64)
            values[(base + k_next - 1)[put]] = value[put]
            k_next[over] = 0
            base = base + (over << 6)
            left = left - over
            bit = bit + skip
            k = k_next
            if not left.all():
                on = left > 0
                bit, k, base, left = bit[on], k[on], base[on], left[on]
        else:
            values[base + k_next - 1] = value
            bit, k = bit + skip, k_next
    return _undo_differences(values.reshape(-1, per, 64), todo, blocks)


def _undo_differences(values: np.ndarray, todo: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """DC is coded as the difference to the component's block before, from 0 in each restart interval."""
    if (todo == 1).all() and len(set(blocks)) == len(blocks):
        return values
    for part in set(blocks):
        which = np.flatnonzero(blocks == part)
        total = np.cumsum(values[:, which, 0].astype(np.int64).reshape(-1))
        firsts = np.concatenate(([0], np.cumsum(todo)))[:-1] * len(which)
        base = np.where(firsts > 0, total[firsts - 1], 0)
        values[:, which, 0] = (total - np.repeat(base, todo * len(which))).reshape(-1, len(which)).astype(np.int16)
    return values


def thumbnail(head: dict, values: np.ndarray) -> np.ndarray:
    """Luminance of each 8x8 block from its DC coefficient alone."""
    _, h, v, table = head["parts"][0]
    single = len(head["parts"]) == 1
    if single:
        h = v = 1
    wide, high = (1, 1) if single else (max(p[1] for p in head["parts"]), max(p[2] for p in head["parts"]))
    across, down = -(-head["width"] // (8 * wide)), -(-head["height"] // (8 * high))
    dc = values[:, : h * v, 0].astype(np.int64) * int(head["quant"][table][0])
    grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    return np.clip((grid + 4) // 8 + 128, 0, 255).astype(np.uint8)[: -(-head["height"] // 8), : -(-head["width"] // 8)]


def difference_hash(image: np.ndarray) -> int:
    """64 bits: is each cell of a 9x8 reduction (nearest pixel) brighter than its left neighbour."""
    rows = np.arange(8) * image.shape[0] // 8
    columns = np.arange(9) * image.shape[1] // 9
    small = image[rows][:, columns].astype(np.int64)
    return int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), "big")


def stored_payload(head: dict, values: np.ndarray) -> bytes:
    """The bytes that encode() stored; the comment has how many there are."""
    size = int(head["comment"].split()[1]) if head["comment"].startswith(b"payload ") else values.size
    return (values.reshape(-1)[:size] + 128).astype(np.uint8).tobytes()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, limit=1 << 17):
        data, offsets = utf8(batch.column("text"))
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        files = encode([payload(t) for t in texts])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the text of each document as a baseline JPEG file."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_store, "doc_id bigint, n_bytes bigint, media binary")


def _groups(files: list[bytes], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    group, size = [], 0
    for f in files:
        if group and size + len(f or b"") > limit:
            yield group
            group, size = [], 0
        group.append(f)
        size += len(f or b"")
    if group:
        yield group


def read_features(files: list[bytes | None]) -> list[tuple]:
    """payload bytes, width, height, thumbnail of each file; None where it is no baseline JPEG."""
    heads: list[dict | None] = []
    for f in files:
        try:
            heads.append(parse(f) if f is not None else None)
        except (ValueError, KeyError, IndexError, struct.error):
            heads.append(None)
    good = [h for h in heads if h is not None]
    try:
        decoded = iter(decode(good))
    except (ValueError, KeyError, IndexError):
        if len(files) > 1:
            return [x for f in files for x in read_features([f])]
        return [None]
    return [None if h is None else (stored_payload(h, v := next(decoded)), h["width"], h["height"], thumbnail(h, v)) for h in heads]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for group in _groups(batch.column("media").to_pylist()):
            for f, x in zip(group, read_features(group)):
                if x is None:
                    rows.append((None,) * 9)
                    continue
                body, width, height, small = x
                thumb, bits = hashlib.sha256(small.tobytes()).hexdigest(), f"{difference_hash(small):016x}"
                rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(f), hashlib.sha256(f).hexdigest(), width, height, thumb, bits))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 9, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "thumbnail_sha256", "thumbnail_dhash"])


def media_features(stored: DataFrame) -> DataFrame:
    """What reading the column media back gives: payload digests, dimensions, thumbnail hashes."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_read, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, width int, height int, thumbnail_sha256 string, thumbnail_dhash string")


def media_digests(docs: DataFrame) -> DataFrame:
    found = media_features(to_media(docs))
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_dhash", "thumbnail_sha256")
    return found.withColumn("feature", feature)
