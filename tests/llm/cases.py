"""Small tables with the awkward rows that every operator must take."""

import random

from pyspark.sql import types as T

#: Columns that a table may have besides; operators use some of these names inside.
MORE = ["key", "shard", "rep", "token", "row", "doc", "slot", "bitmap", "score", "spans", "text_hash", "component_id", "quality", "draw", "bucket", "kept", "words", "media", "task", "k1", "signature"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in MORE)])


def texts(seed=5, n=60):
    """Random prose with exact and near copies, shared lines and passages, empty, short and long texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    line = lambda k=12: " ".join(word() for _ in range(k)).capitalize() + "."
    shared, passage = line(), " ".join(line(20) for _ in range(4))
    out = ["", " \n\t", "one", "Two words", "é à ü naïve Straße 日本語 😀 " * 8, "x" * 5000, "ab " * 3000]
    base = "\n".join(line() for _ in range(6))
    for i in range(n):
        body = [line() for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            body.insert(rng.randint(0, len(body)), shared if i % 8 else "  " + shared.upper() + " ")
        if i % 7 == 0:
            body.append(passage)
        out.append("\n".join(body))
        if i % 6 == 0:
            out.append(out[-1])
        if i % 5 == 0:
            w = base.split(" ")
            w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    return out


def frame(spark, rows):
    """documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", None, len(t) if t is not None else None, *MORE) for i, t in rows], SCHEMA).repartition(3)


def documents(seed=5):
    rows = list(enumerate(texts(seed)))
    return rows + [(len(rows), None), (len(rows) + 1, None)]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}
