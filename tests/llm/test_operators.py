import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.cases import by_id, documents, frame, texts
from treatise.llm import chat, decontamination, line_dedup, media, minhash, packing, pii, quality, sharding, suffix


@pytest.fixture(scope="module")
def docs():
    return documents()


@pytest.fixture(scope="module")
def table(spark, docs):
    return frame(spark, docs).cache()


def _odd(spark, docs):
    """A null id, a row twice, and two texts under one id."""
    return frame(spark, [*docs[:20], (None, docs[12][1]), docs[8], docs[8], (9, docs[13][1])])


def test_near_duplicates(spark, docs, table):
    for size in (4, 5):
        got = by_id(minhash.near_duplicate_digests(table, size), "n_shingles", "component_id", "kept")
        assert got == brute.near_duplicates(docs, size)


@pytest.mark.parametrize("block", [2, 4096])
def test_near_duplicates_in_blocks(spark, docs, table, monkeypatch, block):
    """Everything beyond the first pivots goes through blocks, and components through star rounds."""
    for name, value in {"ROUNDS": 0, "SMALL": 1, "BLOCK_ROWS": block, "SMALL_EDGES": 0, "BROADCAST_IDS": 0, "BROADCAST_KEYS": 0}.items():
        monkeypatch.setattr(minhash, name, value)
    assert by_id(minhash.near_duplicate_digests(table), "n_shingles", "component_id", "kept") == brute.near_duplicates(docs)


def test_chain_of_near_copies(spark):
    """Each text differs from its neighbour a little and from the first one a lot; all are one component."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(25):
        words = [*words[:]]
        words[i * 4] = f"v{i}"
        rows.append((100 - i, " ".join(words)))
    got = by_id(minhash.near_duplicate_digests(frame(spark, rows)), "n_shingles", "component_id", "kept")
    assert got == brute.near_duplicates(rows)
    kept = minhash.drop_near_duplicates(frame(spark, rows), 4)
    assert [r.doc_id for r in kept.collect()] == [d for d, v in brute.near_duplicates(rows).items() if v[2]]


@pytest.mark.parametrize("block", [7, 4096])
def test_large_group_with_unlinked_members(spark, monkeypatch, block):
    """Many copies of a text with more or fewer changes: one component and many documents near it that are in none."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    rng = np.random.default_rng(8)
    origin, other = [f"w{i}" for i in range(150)], [f"x{i}" for i in range(40)]
    rows = []
    for i in range(120):
        words = list(origin)
        for at in rng.choice(150, int(rng.integers(0, 14)), replace=False):
            words[at] = str(rng.choice(other)) if i % 2 else f"own{i}-{at}"
        rows.append((i, " ".join(words)))
    want = brute.near_duplicates(rows, 4)
    assert 5 < sum(v[2] for v in want.values()) < 100
    assert by_id(minhash.near_duplicate_digests(frame(spark, rows)), "n_shingles", "component_id", "kept") == want


def test_signature_index_guarantee():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (1, minhash.VALUES)).astype(np.uint16)
    for _ in range(200):
        b = a.copy()
        at = rng.permutation(minhash.VALUES)[: minhash.LIMIT]
        b[0, at] ^= rng.integers(1, 1 << 16, len(at)).astype(np.uint16)
        assert (minhash.chunk_keys(a) == minhash.chunk_keys(b)).any()


def test_components_agree(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 300)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    one = {tuple(r) for r in minhash.components(df).collect()}
    assert one == {tuple(r) for r in minhash.star_components(df).collect()}
    assert (300, 0) in one and (100, 90) in one and len(one) == 45


PERSONAL = ["mail a.b+c@x-y.co.uk, and d@e", "..x@y.zz.", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 and 010.0.0.255", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "49927398716 4111  1111 1111 1111", "+1 (802) 555-9869 que +12 +123456789012345678", "é😀 a@b.cd é +4930 123456.", "1 " * 3000, "9" * 4000, "a@" * 500, "x." * 2000 + "@y.z", "a.b." * 3000 + "c", "a@" + "b." * 3000 + "c", None, "", "@", "\n".join(["u@v.ww"] * 50), "0000000000004111111111111111"]


def test_personal_data(spark):
    rows = list(enumerate(PERSONAL))
    got = by_id(pii.personal_data_digests(frame(spark, rows)), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for i, t in rows:
        counts, spans = brute.personal(t)
        assert got[i][:4] == counts and got[i][4] == brute.sha(spans) and got[i][5] == spans, t


def test_disclosing_terms(spark):
    # A word that begins with a digit is no term, and no part of it is taken for another word.
    told = [f"Report {c} by Zanzibarov at zan@x.org said {c}{c}. 3zorb" for c in "abcdef"]
    rows = list(enumerate(told + ["Zanzibarov is here.", "nobody is here but zorb."] + [f"said report by at {i}" for i in range(40)]))
    found = {r.doc_id: r.spans for r in pii.find_personal_data(frame(spark, rows)).collect()}
    terms = lambda i: [s["value"] for s in found[i] if s["kind"] == "term"]
    assert terms(0) == ["Zanzibarov"] and terms(6) == ["Zanzibarov"] and terms(7) == []
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert clean[0] == "Report a by  at [EMAIL] said aa. 3zorb" and clean[7] == "nobody is here but zorb."


def _told(rng, count, shape):
    """Texts of random words around what shape(i) tells, and as many without it."""
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 8)))
    prose = lambda k: " ".join(word() for _ in range(k))
    return [prose(30) + shape(i, prose) + prose(30) for i in range(count)] + [prose(60) for _ in range(300)]


def test_disclosing_terms_in_the_whole_document(spark):
    """A name on another line, one far away, and one of an entity in two documents; copies are no evidence."""
    rng = np.random.default_rng(4)
    above = _told(rng, 4, lambda i, prose: "\nZanzibarov\nzan@x.org\n")
    far = _told(rng, 4, lambda i, prose: " Quillfeather " + prose(60) + " quill@x.org ")
    twice = _told(rng, 2, lambda i, prose: " Xylander +1 (802) 555-9869 ")
    copied = _told(rng, 1, lambda i, prose: " Overmantel over@x.org ")[0]
    near = [copied + f" end{i}" for i in range(5)]
    rows = list(enumerate(above + far + twice + [copied] * 5 + near))
    found = {s["value"] for r in pii.find_personal_data(frame(spark, rows)).collect() for s in r.spans if s["kind"] == "term"}
    assert found == {"Zanzibarov", "Quillfeather", "Xylander"}


def test_chance_bound(spark):
    """The bound is never below the hypergeometric tail, and is the tail where all of one side meet."""
    from math import comb, exp

    for n, s, h, k in ((47, 7, 6, 6), (50, 10, 8, 3), (30, 4, 4, 4), (400, 90, 80, 70)):
        tail = sum(comb(s, x) * comb(n - s, h - x) for x in range(k, min(s, h) + 1)) / comb(n, h)
        bound = spark.range(1).select(pii._chance(*(F.lit(x).cast("bigint") for x in (k, s, h, n)))).first()[0]
        assert exp(bound) >= tail * (1 - 1e-9)
        assert k < min(s, h) or abs(exp(bound) / tail - 1) < 1e-9


def test_line_dedup(spark, docs, table):
    want = brute.line_dedup(docs)
    assert by_id(line_dedup.dedup_digests(table), "n_lines", "n_dropped", "kept_sha256") == want
    kept = line_dedup.drop_repeated_lines(table)
    assert kept.columns == table.columns
    for r in kept.collect():
        assert brute.sha(r.text or "") == want[r.doc_id][2] and (r.text is None or r.n_chars == len(r.text))


def test_line_dedup_by_shuffle(spark, docs, table, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_BITMAPS", 0)
    assert by_id(line_dedup.dedup_digests(table), "n_lines", "n_dropped", "kept_sha256") == brute.line_dedup(docs)


def test_bitmaps():
    for dropped in ([0], [7], [8], [3, 4, 90], list(range(16))):
        keep = line_dedup.unpack(line_dedup.pack(dropped), 100)
        assert sorted(np.flatnonzero(~keep)) == dropped


def test_repeats(spark, docs, table):
    got = by_id(suffix.repeat_digests(table), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(docs)


@pytest.mark.parametrize("entries, run_bytes", [(1, 400), (8192, 4 << 20)])
def test_repeats_in_every_surrounding(spark, monkeypatch, entries, run_bytes):
    """Passages cut at all places, few letters, whole copies, rows that repeat; with tiny and with large runs."""
    monkeypatch.setattr(suffix, "COMPARE_ENTRIES", entries)
    monkeypatch.setattr(suffix, "RUN_BYTES", run_bytes)
    rng = np.random.default_rng(9)
    letters = lambda n, k: "".join(rng.choice(list("ab\u00e9zyxwv\n ")[:k], n))
    passage = letters(400, 10)
    texts = [letters(30, 10) + passage[i * 7 : i * 7 + 90 + 5 * i] + letters(int(rng.integers(0, 80)), 10) for i in range(40)]
    texts += [letters(500, 2), letters(500, 1) + "b" + letters(500, 1), texts[3], texts[3] + texts[5], passage, "a" * 99, "a" * 100]
    rows = list(enumerate(texts))
    want = brute.repeats(rows)
    got = by_id(suffix.repeat_digests(frame(spark, [*rows[::-1], rows[7]])), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == want and sum(v[1] for v in want.values()) > 3000


def test_keys_for_partitions(spark):
    for n in (7, 40, 211):
        keys = [suffix.even_key(i, n) for i in range(3 * n)]
        df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k bigint").repartition(n, "k").withColumn("p", F.spark_partition_id())
        assert len(set(keys)) == len(keys) and all(r.p == r.i % n for r in df.collect())


def test_anchors_of_a_text_longer_than_positions_have_bits(monkeypatch):
    """Each string's anchor is inside it, and equal strings have anchors at equal places."""
    monkeypatch.setattr(suffix, "_POSITION_BITS", np.uint64(10))
    rng = np.random.default_rng(6)
    passage, fill = rng.integers(97, 123, 300), lambda n: rng.integers(97, 123, n)
    data = np.concatenate([fill(700), passage, fill(4000), passage, fill(900)]).astype(np.uint8)
    anchor, _, first, last = suffix.anchors(data, np.array([0, len(data)]))
    assert ((first <= last) & (last <= anchor) & (anchor < first + suffix.GRAMS)).all()
    assert (last - first + 1).sum() == len(data) - suffix.LENGTH + 1
    of = np.repeat(anchor, last - first + 1)
    starts = np.arange(700, 700 + 300 - suffix.LENGTH + 1)
    assert (of[starts + 4300] == of[starts] + 4300).all()


def test_loser_tree():
    rng = np.random.default_rng(2)
    for k in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.integers(97, 99, rng.integers(0, 9)).tolist()) for _ in range(rng.integers(0, 30))) for _ in range(k)]
        coded = [suffix.front_code(r) for r in runs]
        assert [suffix.front_decode(*c) for c in coded] == runs
        tree = suffix.LoserTree([(c[0], r) for c, r in zip(coded, runs)])
        out = [(shared, runs[run][at]) for shared, run, at in tree]
        assert [v for _, v in out] == sorted(v for r in runs for v in r)
        assert all(n == suffix.shared_length(a, b) for (_, a), (n, b) in zip(out, out[1:]))


def test_decontamination(spark, docs, table):
    long = " ".join(docs[20][1].split()[2:30])
    items = [("a", long), ("b", long.upper()), ("c", "Two words"), ("d", "one"), ("e", ""), ("f", None), ("g", "words that stand nowhere"), (None, "Two"), ("é", "日本語 😀"), ("h", "the " * 30)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = by_id(decontamination.contamination_digests(table, bench), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute.contamination(docs, [i for i in items if i[0] is not None])
    assert got == want and any(v[4] for v in want.values())
    kept = decontamination.drop_contaminated(table, bench)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {d for d, v in want.items() if not v[4]}
    none = decontamination.contamination_digests(table, bench.where("false"))
    assert none.count() == len(docs) and none.where("contaminated").count() == 0


def test_decontamination_without_broadcasts(spark, docs, table, monkeypatch):
    """As many shingles as need a shuffle: the same rows, for rows that repeat and null ids too."""
    bench = spark.createDataFrame([("a", " ".join(docs[20][1].split()[2:30])), ("b", "Two words"), ("h", "the " * 30), ("x", "x" * 5000)], "item_id string, text string")
    columns = "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    want = {d: tuple(r[c] for c in columns) for d, r in ((r.doc_id, r) for r in decontamination.contamination_digests(table, bench).collect())}
    odd = sorted(map(repr, decontamination.contamination_digests(_odd(spark, docs), bench).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_KEYS", 0)
    assert by_id(decontamination.contamination_digests(table, bench), *columns) == want and any(v[4] for v in want.values())
    assert sorted(map(repr, decontamination.contamination_digests(_odd(spark, docs), bench).collect())) == odd
    assert {r.doc_id for r in decontamination.drop_contaminated(table, bench).collect()} == {d for d, v in want.items() if not v[4]}


def test_media_round_trip(spark, docs, table):
    got = by_id(media.media_digests(table), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature")
    for d, t in docs:
        raw = (t or "").encode()
        p = media.payload(raw)
        assert got[d][:4] == (len(raw), len(p), brute.sha(p), zlib.crc32(p[-16:])) and len(p) % 192 == 0 and p
        assert got[d][4] == len(media.encode([p])[0]) and got[d][5]


def test_media_bytes_of_every_kind():
    rng = np.random.default_rng(3)
    for body in (bytes(range(256)) * 3, b"\x80" * 960, bytes(rng.integers(0, 256, 19200).tolist()), b"\xff" * 576, (b"\x80" * 63 + b"a") * 9, (b"a" + b"\x80" * 40 + b"b" * 23) * 3):
        file = media.encode([body])[0]
        found, width, height, small = media.read_features([file])[0]
        assert found == body and small.shape == (height // 8, width // 8) and file[:2] == b"\xff\xd8" and file[-2:] == b"\xff\xd9"
    assert media.read_features([b"no image", None, media.encode([b" " * 192])[0]])[2] is not None


def test_media_against_a_plain_decoder(spark, docs, table):
    """Dimensions, thumbnail, stored form and payload of real texts, by a decoder that shares no code."""
    found = {r.doc_id: r for r in media.media_digests(table).collect()}
    for d, t in [x for x in docs if len(x[1] or "") < 1500][:25]:
        body = media.payload((t or "").encode())
        file = media.encode([body])[0]
        width, height, blocks = brute.jpeg(file)
        assert bytes(v + 128 for _, block in blocks for v in block)[: len(body)] == body
        small = bytes(max(0, min(255, (block[0] + 4) // 8 + 128)) for c, block in blocks if c == 0)
        r = found[d]
        assert (r.media_bytes, r.media_sha256, r.width, r.height, r.thumbnail_sha256) == (len(file), brute.sha(file), width, height, brute.sha(small))


def test_thumbnail_is_the_mean_luminance():
    """The DC coefficient alone gives the mean of a flat block."""
    values = np.zeros((4, 3, 64), np.int64)
    values[:, 0, 0] = [-100, -20, 30, 90]
    head = media.parse(media.encode([(values.reshape(-1) + 128).astype(np.uint8).tobytes()])[0])
    assert media.thumbnail(head, media.decode([head])[0]).ravel().tolist() == [(v + 4) // 8 + 128 for v in (-100, -20, 30, 90)]


def _ids(text):
    full = packing._tokenizer(packing.default_tokenizer())[0][0]
    return full.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def test_packing(spark, docs, table):
    rows = packing.pack_documents(table, open_windows=3).collect()
    sequences, parts = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        parts.setdefault(r.doc_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
    for d, t in docs:
        ids, at = _ids(t), 0
        for r in sorted(parts[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == brute.crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)


def test_tokens_of_odd_pieces():
    odd = ["don't <|endoftext|> x", "<|ENDOFTEXT|>", "á e ́x", "ΑΣ ΣΑ İ", "it's a.b c,d’,x é,y <|x don'T'll --- a-b_c 12.5 x1y", "　x a", "A!b?C" * 50, "ǅ ﬁ ß ẞ", ""]
    data = [t.encode() for t in odd]
    ids, edge = packing.token_ids(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data]), packing.default_tokenizer())
    assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:])] == [_ids(t) for t in odd]


def test_sharding(spark, docs, table):
    rows = sharding.shard_rows(table, 7, bucket_rows=4).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard_, []).append(r.slot_)
    # The table has columns shard and slot already, which stay.
    assert rows[0].__fields__ == [*table.columns, "shard_", "slot_"] and {(r.shard, r.slot) for r in rows} == {("shard", "slot")}
    assert sum(map(len, slots.values())) == len(docs) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    got = by_id(sharding.shard_digests(table), "size", "text_crc32", "law", "grown_shard")
    assert got == {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for d, t in docs}


def test_whole_rows_are_sharded(spark, docs, table, monkeypatch):
    """The digests come from the texts in the shards, where all columns of the documents arrive."""
    given, operator = [], sharding.shard_rows

    def marked(rows, *more):
        given.append(rows.columns)
        return operator(rows, *more).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("!")))

    monkeypatch.setattr(sharding, "BUCKET_BYTES", 300)
    placed = operator(table, 7).collect()
    assert sorted((r.shard_, r.slot_) for r in placed) == sorted((s, i) for s in range(7) for i in range(sum(r.shard_ == s for r in placed)))
    assert sorted((r[: len(table.columns)] for r in placed), key=repr) == sorted(map(tuple, table.collect()), key=repr)
    monkeypatch.setattr(sharding, "shard_rows", marked)
    got = by_id(sharding.shard_digests(table), "text_crc32")
    assert given == [table.columns] and got == {d: (zlib.crc32(((t or "") + "!").encode()),) for d, t in docs}


def test_blocks_of_rows():
    batch = pa.RecordBatch.from_pylist([{"row": {"a": i, "t": None if i % 7 == 0 else "é" * (i % 5 * 50_000)}} for i in range(60)])
    blocks = [r for b in sharding._packed(iter([batch])) for r in b.to_pylist()]
    assert len(blocks) > 1 and max(b["size"] for b in blocks) < 2 * sharding.BLOCK_BYTES and sum(b["n"] for b in blocks) == 60
    assert [r for b in blocks for x in pa.ipc.open_stream(b["block"]) for r in x.to_pylist()] == batch.to_pylist()


def test_communication_matrix():
    counts = [5, 0, 17, 100, 1]
    drawn = np.array([sharding.communication_matrix(counts, 4, seed) for seed in range(400)])
    assert (drawn.sum(2) == counts).all() and (np.sort(drawn.sum(1), 1) == np.sort([31, 31, 31, 30])).all()
    assert abs(drawn[:, 3, 0].mean() - 100 * 31 / 123) < 0.5
    rng = np.random.default_rng(0)
    many = [sharding._hypergeometric(rng, 600_000_000, 900_000_000, 1_000) for _ in range(300)]
    assert abs(np.mean(many) - 400) < 4


def test_quality(spark):
    rng = np.random.default_rng(0)
    good, bad = texts(1, 120), [("WORD!! " if i % 2 else "same same ") * int(rng.integers(5, 40)) for i in range(120)]
    rows = [(i, t) for i, t in enumerate(t for t in good if len(t) > 40 and len(t) < 2000)]
    n = len(rows)
    rows += [(n + i, t) for i, t in enumerate(bad)] + [(10_000, None), (10_001, "")]
    labels = spark.createDataFrame([(i, int(i < n) if i % 9 else None, 0) for i, _ in rows[:-2]], "doc_id bigint, quality int, toxic int")
    got = by_id(quality.quality_scores(frame(spark, rows), labels), "held_out", "score", "predicted")
    assert all(v[0] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= v[1] <= 1 and v[2] == int(v[1] >= 0.3) for d, v in got.items())
    held = [(v[2], int(d < n)) for d, v in got.items() if v[0] and d < 10_000]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert quality.keep_good(frame(spark, rows), labels).columns == frame(spark, rows).columns
    nothing = quality.quality_scores(frame(spark, rows), labels.where("false"))
    assert {r.score for r in nothing.collect()} == {0.5}


def test_chats(spark):
    talk = lambda c, n, last=None: [(c, i, "user" if i % 2 == 0 else "assistant", f"t{i}" if last is None or i < n - 1 else last) for i in range(n)]
    rows = talk(1, 2) + talk(2, 4) + talk(3, 4) + talk(4, 4, "other") + talk(5, 600) + talk(6, 1, "alone") + [(7, None, None, None), (None, 0, "user", "x")] + talk(2, 1)
    got = {}
    for r in chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect():
        got.setdefault(r.conv_id, {})[r.part] = r
    assert sorted(got) == [4, 5, 6, 7]
    assert got[4][0].rendered == "<|user|>\nt0\n<|assistant|>\nt1\n<|user|>\nt2\n<|assistant|>\nother"
    assert sorted(got[5]) == [0, 1, 2] and got[5][0].n_turns == 600 and got[7][0].rendered == "<||>\n"
    assert "\n".join(got[5][p].rendered for p in range(3)).count("<|user|>") == 300


def test_quality_against_the_plain_rule(spark):
    """Few features and many slots, so that no two share one; rows that repeat count once, labels too."""
    import struct

    import xxhash

    rng = np.random.default_rng(5)
    vocabulary = ["the", "The", "fox", "FOX!", "a1", "b-2", "über", "so", "so", "!!"]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 30))).tolist())) for i in range(90)] + [(90, None), (91, ""), (92, "unseen Words")]
    labels = {i: int(("FOX!" in t) != (i % 11 == 0)) if i % 13 else None for i, t in rows[:90]}
    settings = quality.Settings(bits=22, max_labelled=50, epochs=3)
    given = spark.createDataFrame([(i, q, 0) for i, q in labels.items()] + [(5, labels[5], 1), (200, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    place = lambda d: (struct.unpack("<q", xxhash.xxh64(struct.pack("<q", d), seed=42).intdigest().to_bytes(8, "little"))[0], d)
    want = brute.quality_scores(rows, labels | {200: 1}, place, 50, 3, settings.alpha, settings.beta, settings.l1, settings.l2)
    got = by_id(quality.quality_scores(frame(spark, [*rows, rows[3], rows[3]]), given, settings), "held_out", "score", "predicted")
    assert all(abs(got[d][1] - want[d]) < 1e-5 and got[d][2] == (want[d] >= 0.3) for d in want) and len(set(want.values())) > 50
    assert all(got[d][0] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in want)


def _benchmark(spark, docs):
    return spark.createDataFrame([("a", " ".join(docs[20][1].split()[2:30])), ("b", "Two words"), (None, "one"), ("c", None)], "item_id string, text string")


def _labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")


def _alike(spark, docs):
    """Operators whose rows follow from the text alone, and the columns that do."""
    return {
        "op2": (pii.personal_data_digests, "n_email", "n_ip", "n_card", "n_phone", "base_sha256"),
        "op4": (lambda t: quality.quality_scores(t, _labels(spark), quality.Settings(max_labelled=0)), "score", "predicted"),
        "op5": (lambda t: packing.pack_documents(t).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("whole"), F.sort_array(F.collect_list("ids_crc32")).cast("string").alias("ids")), "n", "whole", "ids"),
        "op6": (sharding.shard_digests, "size", "text_crc32"),
        "op7": (media.media_digests, "n_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"),
        "op10": (lambda t: decontamination.contamination_digests(t, _benchmark(spark, docs)), "n_words", "n_hit", "n_items", "items_sha256", "contaminated"),
    }


@pytest.mark.parametrize("name", ["op2", "op4", "op5", "op6", "op7", "op10"])
def test_odd_rows_of_operators_on_single_texts(spark, docs, table, name):
    """A null id, rows that repeat and one id with two texts have the values that their texts have elsewhere."""
    operator, *columns = _alike(spark, docs)[name]
    of = by_id(operator(table), *columns)
    odd = [*docs[:20], (None, docs[12][1]), docs[8], docs[8], (9, docs[13][1])]
    if name == "op5":  # pieces are told apart by document only
        odd = [*docs[:20], (None, docs[12][1])]
    number = {t: d for d, t in docs}
    got = sorted(((r.doc_id, *(r[c] for c in columns)) for r in operator(frame(spark, odd)).collect()), key=repr)
    assert got == sorted(((d, *of[number[t]]) for d, t in odd), key=repr)
    assert operator(frame(spark, odd).where("false")).count() == 0


def test_odd_rows_of_operators_on_pairs(spark, docs):
    odd = [*docs[:20], (None, docs[12][1]), docs[8], docs[8], (9, docs[13][1]), (None, docs[12][1]), (None, None)]
    table = frame(spark, odd)
    hashes = {r.text: r.h for r in table.select("text", F.xxhash64("text").bitwiseAND(0xFFFFFFFF).alias("h")).distinct().collect()}
    lines, repeated = brute.odd_rows(odd, hashes.__getitem__)
    rows = lambda df, *columns: sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=repr)
    assert rows(line_dedup.dedup_digests(table), "n_lines", "n_dropped", "kept_sha256") == sorted(lines, key=repr)
    assert rows(suffix.repeat_digests(table), "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(repeated, key=repr)
    near = minhash.near_duplicate_digests(table).collect()
    plain = brute.near_duplicates([*docs[:20], (13, docs[13][1])])
    assert len(near) == len(odd) and all(r.kept and r.component_id is None for r in near if r.doc_id is None)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in near if r.doc_id not in (None, 9)} >= {(d, plain[d][0], plain[d][1]) for d in range(9)}
    for operator in (line_dedup.dedup_digests, suffix.repeat_digests, minhash.near_duplicate_digests):
        assert operator(table.where("false")).count() == 0


def test_very_long_texts(spark):
    """20,000 words, a near copy of them, and one word of 200,000 letters, through all operators."""
    rng = np.random.default_rng(12)
    words = ["w" + str(x) for x in rng.integers(0, 4000, 20_000)]
    near = [*words[:7000], "changed", *words[7001:]]
    secret = " mail a.b@c.de and 4111 1111 1111 1111 "
    rows = [(0, " ".join(words) + secret), (1, " ".join(near)), (2, "x" * 200_000), (3, "\n".join(words)), (4, "y" * 99 + "\n" + "x" * 200_000)]
    table = frame(spark, rows)
    assert by_id(minhash.near_duplicate_digests(table), "n_shingles", "component_id", "kept") == brute.near_duplicates(rows)
    assert by_id(line_dedup.dedup_digests(table), "n_lines", "n_dropped", "kept_sha256") == brute.line_dedup(rows)
    assert by_id(suffix.repeat_digests(table), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(rows)
    items = [("a", " ".join(words[100:125])), ("b", "x" * 200_000), ("c", " ".join(words[-4:]) + " mail a")]
    found = by_id(decontamination.contamination_digests(table, spark.createDataFrame(items, "item_id string, text string")), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found == brute.contamination(rows, items) and found[0][2] == 2
    personal = by_id(pii.personal_data_digests(table), "n_email", "n_ip", "n_card", "n_phone", "spans")
    assert all(personal[d] == (*counts, spans) for d, t in rows for counts, spans in [brute.personal(t)])
    assert {r.doc_id for r in quality.quality_scores(table, _labels(spark)).collect()} == set(range(5))
    assert {r.doc_id: r.n for r in packing.pack_documents(table).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {d: len(_ids(t)) for d, t in rows}
    assert by_id(media.media_digests(table), "payload_sha256") == {d: (brute.sha(media.payload(t.encode())),) for d, t in rows}
    chat_rows = spark.createDataFrame([(1, 0, "user", rows[0][1]), (2, 0, "user", rows[0][1]), (2, 1, "bot", rows[2][1])], "conv_id bigint, turn bigint, role string, text string")
    assert [r.rendered for r in chat.format_chats(chat_rows).collect()] == [f"<|user|>\n{rows[0][1]}\n<|bot|>\n{rows[2][1]}"]


def test_odd_chats(spark):
    """Null turns come first, rows that repeat count once, ties go by role and text; other columns are not read."""
    rows = [(1, 5, "b", "x", "z"), (1, 5, "a", "y", "z"), (1, None, None, None, "z"), (1, 5, "a", "y", "z"), (None, 1, "a", "b", "z"), (2, -3, "u", "", "z")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, rank string")
    got = {(r.conv_id, r.part): r.rendered for r in chat.format_chats(table).collect()}
    assert "\n".join(got[k] for k in sorted(got) if k[0] == 1) == "<||>\n\n<|a|>\ny\n<|b|>\nx" and got[2, 0] == "<|u|>\n"
    assert chat.format_chats(table.where("false")).count() == 0
