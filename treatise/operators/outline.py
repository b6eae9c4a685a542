"""Operators on outlines: rows (position, level, title, ...) in pre-order, per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, normalized_key, strip, casefold, lines

CHAPTER_PREFIX = "Chapter "
EXCLUDED_TITLES = ("media attributions",)
PATH_SEPARATOR = " > "


def deepest(outline: DataFrame) -> int:
    """The largest level of the rows, which bounds the length of a path."""
    return outline.agg(F.max("level")).first()[0] or 1


def with_parents(outline: DataFrame, keys: list[str]) -> DataFrame:
    """parent_position, the nearest earlier row of a smaller level.

    One running maximum per level in one window: a row's parent is the latest row among the levels above it.
    """
    earlier = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    latest = [F.when(F.col("level") > n, F.max(F.when(F.col("level") == n, F.col("position"))).over(earlier)) for n in range(1, deepest(outline))]
    # greatest() takes two columns at least.
    none = F.lit(None).cast(outline.schema["position"].dataType)
    return outline.withColumn("parent_position", F.greatest(none, none, *latest))


def with_paths(outline: DataFrame, keys: list[str]) -> DataFrame:
    """Path, the titles from the root to the node; one self-join on the parent for each level."""
    out = outline.withColumn("path", F.array("title")).withColumn("up", F.col("parent_position"))
    for _ in range(deepest(outline) - 1):
        parent = outline.select(*keys, F.col("position").alias("up"), F.col("title").alias("up_title"), F.col("parent_position").alias("next_up"))
        out = out.join(parent, [*keys, "up"], "left").withColumn("path", F.when(F.col("up_title").isNotNull(), F.concat(F.array("up_title"), F.col("path"))).otherwise(F.col("path"))).drop("up", "up_title").withColumnRenamed("next_up", "up")
    return out.drop("up")


def with_ids(outline: DataFrame, prefix: str = "node") -> DataFrame:
    """Stable ids by position."""
    name = lambda p: F.when(p.isNotNull(), F.format_string(f"{prefix}-%03d", p.cast("int")))
    return outline.withColumn("id", name(F.col("position"))).withColumn("parent_id", name(F.col("parent_position")))


def with_leaf_flags(outline: DataFrame, keys: list[str], prefix: str = CHAPTER_PREFIX, excluded: tuple[str, ...] = EXCLUDED_TITLES) -> DataFrame:
    """T4, T5: is_leaf (the next row is no deeper) and is_retrieval_leaf (in a chapter, title not excluded)."""
    following = F.lead("level").over(Window.partitionBy(*keys).orderBy("position"))
    leaf = F.coalesce(following <= F.col("level"), F.lit(True))
    out = outline.withColumn("is_leaf", leaf)
    wanted = F.startswith(F.element_at("path", 1), F.lit(prefix)) & ~casefold(strip(F.col("title"))).isin(*excluded)
    return out.withColumn("is_retrieval_leaf", F.col("is_leaf") & wanted)


def outline_nodes(outline: DataFrame, keys: list[str], id_prefix: str = "node", chapter_prefix: str = CHAPTER_PREFIX) -> DataFrame:
    """Nodes with parent, path, canonical path, depth and leaf flags."""
    nodes = with_ids(with_paths(with_parents(outline, keys), keys), id_prefix)
    nodes = with_leaf_flags(nodes, keys, chapter_prefix).withColumn("canonical_path", canonical_path(F.col("path")))
    return nodes.withColumn("depth", path_depth(F.col("canonical_path")))


def canonical_path(path: Column) -> Column:
    return F.array_join(path, PATH_SEPARATOR)


def path_depth(canonical: Column) -> Column:
    """T7; a title that holds the separator counts as more, as it does in the string."""
    return F.size(F.split(canonical, PATH_SEPARATOR))


def profile(outline: DataFrame) -> DataFrame:
    """Number of nodes and largest level."""
    return outline.agg(F.count("*").alias("n_nodes"), F.max("level").alias("max_level"))


def repeated_titles(leaves: DataFrame) -> DataFrame:
    """Titles that more than one leaf has."""
    return leaves.groupBy("title").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids")).where("n > 1")


def heading_coverage(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Is the title in its page's text, both normalised and case-folded; null text counts as empty."""
    joined = nodes.join(pages, "page", "left")
    found = F.contains(normalized_key(F.coalesce("text", F.lit(""))), normalized_key(F.col("title")))
    return joined.select("page", "title", found.alias("covered"))


def block_coverage(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Exact, contained or missing; an equi-join on the page, then the best class of a node."""
    text, title = normalized_key(F.col("text")), normalized_key(F.col("title"))
    kind = F.when(text == title, 2).when(F.contains(text, title), 1).otherwise(0)
    best = nodes.join(blocks.select("page", "text"), "page", "left").groupBy("page", "title").agg(F.max(kind).alias("best"))
    return best.select("page", "title", F.when(F.col("best") == 2, "exact").when(F.col("best") == 1, "contained").otherwise("missing").alias("coverage"))


def retrieval_labels(nodes: DataFrame) -> DataFrame:
    """leaf_id, title, path, canonical_path of the retrieval leaves."""
    return nodes.where("is_retrieval_leaf").select(F.col("id").alias("leaf_id"), "title", "path", "canonical_path")


def render_outline(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """K3: the outline as text, two spaces a level."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), F.col("title"))
    return nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("rows")).select(*keys, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("outline"))


def parse_outline(rendered: DataFrame, keys: list[str]) -> DataFrame:
    """(position, level, title) from outline text; blank lines are skipped."""
    rows = rendered.select(*keys, F.posexplode(lines(F.col("outline"))).alias("at", "line")).where(F.rlike("line", F.lit(r"\A *- ")))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("at"))
    spaces = F.length(F.regexp_extract("line", r"\A( *)- ", 1))
    return rows.select(*keys, number.alias("position"), (spaces / 2).cast("int").alias("level0"), F.regexp_replace("line", r"\A *- ", "").alias("title")).withColumn("level", F.col("level0") + 1).drop("level0")
