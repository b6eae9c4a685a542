"""Plain versions of the operators, one document at a time, for tables of a few hundred documents."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def near_duplicates(docs, size=4, percent=80):
    """docs: (doc_id, text) -> {doc_id: (n_shingles, component_id, kept)}."""
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    by = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by[x].add(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        near = Counter(e for x in s for e in by[x] if e < d)
        for e, n in near.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    out = [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m)]
    n = Counter(k for k, _, _ in out)
    return tuple(n[k] for k in kinds), ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def line_dedup(docs):
    strip = " \t\n\x0b\x0c\r"
    holder = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            k = line.strip(strip).translate(LOWER)
            if len(k) >= 10:
                holder[k] = min(d, holder.get(k, d))
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if holder.get(x.strip(strip).translate(LOWER), d) == d]
        out[d] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def repeats(docs, length=100):
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def contamination(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        if w:
            n = min(window, len(w))
            for at in range(len(w) - n + 1):
                windows[tuple(w[at : at + n])].add(i)
    sizes = {len(k) for k in windows}
    out = {}
    for d, t in docs:
        w = word.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if (k := tuple(w[at : at + n])) in windows:
                    hit.update(range(at, at + n))
                    found |= windows[k]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def odd_rows(rows, order):
    """line_dedup and repeats for rows that may share an id and a text or have no id: one tuple for each row.

    order gives the place of a row among those of its id.
    """
    strip = " \t\n\x0b\x0c\r"
    holder = {}
    keys = lambda t: [x.strip(strip).translate(LOWER) for x in (t or "").split("\n")]
    for d, t in rows:
        for k in keys(t):
            if d is not None and len(k) >= 10:
                holder[k] = min(d, holder.get(k, d))
    lines = []
    for d, t in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t)) if d is None or holder.get(k, d) == d]
        lines.append((d, len(keys(t)), len(keys(t)) - len(kept), sha("\n".join(kept))))
    distinct = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, order(r[1])))
    found = repeats(list(enumerate(t for _, t in distinct)))
    return lines, [(d, *found[distinct.index((d, t))]) for d, t in rows]


def _shape(word):
    out = []
    for b in word.encode():
        c = "a" if b >= 128 or 97 <= b <= 122 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b)
        if not out or out[-1] != c or c not in "aA0":
            out.append(c)
    return "".join(out)


def quality_features(text):
    """n-gram features of a text by name, with their values."""
    found = WORD.findall(text or "")
    words, shapes = [w.translate(LOWER) for w in found], [_shape(w) for w in found]
    names = [("w", w) for w in words] + [("s", w) for w in shapes]
    names += [("ww", *p) for p in zip(words, words[1:])] + [("ss", *p) for p in zip(shapes, shapes[1:])]
    names += ["again" for a, b in zip(words, words[1:]) if a == b] + ["second" for a, b in zip(words, words[2:]) if a == b]
    return {n: k * 8.0 / max(1, len(words)) for n, k in Counter(names).items()} | {"bias": 1.0}


def quality_scores(docs, labels, place, most, epochs, alpha, beta, l1, l2):
    """Scores by follow-the-regularised-leader, one example and one coordinate after the other.

    place(doc_id) orders the examples, of which the first `most` are learned from.
    """
    from math import exp, sqrt

    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - (l1 if z[f] > 0 else -l1)) / ((beta + sqrt(n[f])) / alpha + l2)

    def score(x):
        return 1 / (1 + exp(-max(-30, min(30, sum(weight(f) * v for f, v in x.items())))))

    texts = dict(docs)
    chosen = sorted((d for d in labels if labels[d] is not None and zlib.crc32(str(d).encode()) % 5), key=place)[:most]
    for _ in range(epochs):
        for x, y in [(quality_features(texts[d]), labels[d]) for d in chosen if d in texts]:
            p = score(x)
            for f, v in x.items():
                g = (p - y) * v
                step = (sqrt(n[f] + g * g) - sqrt(n[f])) / alpha
                z[f] += g - step * weight(f)
                n[f] += g * g
    return {d: score(quality_features(t)) for d, t in docs}


def jpeg(file):
    """(width, height, blocks): a baseline file read bit by bit; a block is (component, 64 coefficients as they come)."""
    at, tables, interval, scan = 2, {}, 0, None
    while scan is None:
        marker, size = file[at + 1], int.from_bytes(file[at + 2 : at + 4], "big")
        body = file[at + 4 : at + 2 + size]
        if marker == 0xC0:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [(body[6 + 3 * i], body[7 + 3 * i]) for i in range(body[5])]
        elif marker == 0xC4:
            code, symbols, table = 0, iter(body[17:]), {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    table[length, code] = next(symbols)
                    code += 1
                code *= 2
            tables[body[0]] = table
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            scan = file[at + 2 + size : -2]
        at += 2 + size
    assert all(sampling == 0x11 for _, sampling in parts)
    segments = re.split(rb"\xff[\xd0-\xd7]", scan)
    blocks = []
    for segment in segments:
        bits = "".join(f"{b:08b}" for b in segment.replace(b"\xff\x00", b"\xff"))
        place, before = 0, dict.fromkeys(range(len(parts)), 0)

        def symbol(table):
            nonlocal place
            for length in range(1, 17):
                if (found := table.get((length, int(bits[place : place + length], 2)))) is not None:
                    place += length
                    return found
            raise ValueError("no code")

        def value(size):
            nonlocal place
            raw = bits[place : place + size]
            place += size
            return 0 if not size else int(raw, 2) if raw[0] == "1" else int(raw, 2) - (1 << size) + 1

        mcus = -(-width // 8) * -(-height // 8)
        for _ in range(min(interval or mcus, mcus - len(blocks) // len(parts))):
            for c in range(len(parts)):
                before[c] += value(symbol(tables[0x00]))
                out = [before[c]]
                while len(out) < 64:
                    s = symbol(tables[0x10])
                    if s == 0:
                        out += [0] * (64 - len(out))
                    else:
                        out += [0] * (s >> 4) + [value(s & 15)]
                blocks.append((c, out))
    return width, height, blocks
