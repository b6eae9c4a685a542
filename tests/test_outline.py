import random

from pyspark.sql import functions as F

from treatise.operators import outline


def _stack(levels):
    out, stack = [], []
    for i, level in enumerate(levels, 1):
        while stack and stack[-1][1] >= level:
            stack.pop()
        out.append(stack[-1][0] if stack else None)
        stack.append((i, level))
    return out


def _frame(spark, books):
    return spark.createDataFrame([(b, i, n, f"{b} t{i}", 1) for b, levels in books.items() for i, n in enumerate(levels, 1)], "book string, position int, level int, title string, page int")


def test_parents_and_paths(spark):
    rng = random.Random(3)
    books = {"a": [1, 2, 3, 3, 2, 1, 3], "b": [1], "c": [1, 1]} | {f"r{n}": [rng.randint(1, 4) for _ in range(12)] for n in range(60)}
    nodes = outline.outline_nodes(_frame(spark, books), ["book"], chapter_prefix="a")
    got = {(r.book, r.position): r for r in nodes.collect()}
    for book, levels in books.items():
        parents = _stack(levels)
        for i, parent in enumerate(parents, 1):
            row, path, at = got[book, i], [], i
            while at:
                path.insert(0, f"{book} t{at}")
                at = parents[at - 1]
            assert row.parent_position == parent and row.path == path and row.depth == len(path)
            assert row.is_leaf == (i not in parents)
            assert row.is_retrieval_leaf == (row.is_leaf and book == "a")


def test_outlines_of_any_depth(spark):
    deep = list(range(1, 12))
    nodes = {r.position: r for r in outline.outline_nodes(_frame(spark, {"a": [*deep, 9]}), ["book"]).collect()}
    assert [nodes[i].parent_position for i in (1, 9, 10, 11, 12)] == [None, 8, 9, 10, 8]
    assert nodes[11].path == [f"a t{i}" for i in deep] and nodes[12].path == [*(f"a t{i}" for i in range(1, 9)), "a t12"]
    flat = outline.outline_nodes(_frame(spark, {"a": [1, 1]}), ["book"]).collect()
    assert [r.parent_position for r in flat] == [None, None]


def test_render_and_parse_are_inverse(spark):
    rows = _frame(spark, {"a": [1, 2, 3, 2], "b": [1, 1]}).select("book", "position", "level", "title")
    again = outline.parse_outline(outline.render_outline(rows, ["book"]), ["book"])
    assert sorted(again.select("book", "position", "level", "title").collect()) == sorted(rows.collect())


def test_excluded_title_and_coverage(spark):
    nodes = spark.createDataFrame([(1, "Alpha  Beta"), (2, "Gamma"), (3, "Delta")], "page int, title string")
    blocks = spark.createDataFrame([(1, "alpha beta"), (1, "x alpha beta"), (2, "the gamma ray")], "page int, text string")
    assert dict(outline.block_coverage(nodes, blocks).select("title", "coverage").collect()) == {"Alpha  Beta": "exact", "Gamma": "contained", "Delta": "missing"}
    one = spark.createDataFrame([("b", 1, 1, "Chapter 1", 1), ("b", 2, 2, " MEDIA Attributions ", 1)], "book string, position int, level int, title string, page int")
    assert not any(r.is_retrieval_leaf for r in outline.outline_nodes(one, ["book"]).collect())
