"""Noise removal and unit merging: paragraphs of a leaf, in order, become generation units.

Every step keeps one row per unit: (leaf keys, position, text, page_start, page_end, source_ids, reasons). Steps
whose effect on a row depends on its neighbours only are windows; those with a running length cap are folds over
lengths and marks of a leaf's units in order, which decide what is merged; texts are then put together once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The lengths and labels of the rules.
MAX_LIST, SHORT_FRAGMENT, SHORT_LABEL = 3000, 40, 60
FORWARD_LABELS = ("did you know…", "months milestones")


def classify_noise(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Reason (null for survivors)."""
    order = Window.partitionBy(*keys).orderBy("position")
    text = T.strip(F.col("text"))
    tail = F.max((T.casefold(text) == "media attributions").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    first = F.when(tail, "media_attribution_tail").when(F.rlike(text, F.lit(T.PLACEHOLDER)), "interactive_element_placeholder").when(F.rlike(text, F.lit(T.URL_ONLY)), "url_only")
    orphan = (F.length(text) <= SHORT_FRAGMENT) & F.contains(text, F.lit("/")) & F.rlike(text, F.lit(T.URL_TAIL))
    rows = paragraphs.withColumn("_first", first).withColumn("_orphan", F.col("_first").isNull() & orphan)
    # A chain of orphan candidates hangs on what the last other paragraph before it was.
    last = F.last(F.when(~F.col("_orphan"), F.coalesce("_first", F.lit("kept"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    reason = F.when(F.col("_orphan"), F.when(last == "url_only", "orphan_url_tail")).otherwise(F.col("_first"))
    return rows.withColumn("reason", reason).drop("_first", "_orphan")


def remove_noise(paragraphs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Units of the survivors, and the removed rows with their reason."""
    rows = classify_noise(paragraphs, keys)
    units = rows.where("reason IS NULL").select(*keys, "position", "text", "page_start", "page_end", F.array("id").alias("source_ids"), F.array().cast("array<string>").alias("reasons"))
    return units, rows.where("reason IS NOT NULL").select("id", *keys, "page_start", "page_end", "reason", "text")


def merge_text(left: Column, right: Column) -> Column:
    """A line end before a list item, else a space."""
    return F.concat(T.rstrip(left), F.when(T.starts_any_bullet(right), "\n").otherwise(" "), T.lstrip(right))


def merge(left: Column, right: Column, reason: Column) -> Column:
    """U12 on structs (position, text, page_start, page_end, source_ids, reasons)."""
    return F.struct(
        left["position"].alias("position"),
        merge_text(left["text"], right["text"]).alias("text"),
        F.least(left["page_start"], right["page_start"]).alias("page_start"),
        F.greatest(left["page_end"], right["page_end"]).alias("page_end"),
        F.concat(left["source_ids"], right["source_ids"]).alias("source_ids"),
        F.concat(left["reasons"], right["reasons"], F.array(reason)).alias("reasons"),
    )


_UNIT = ("position", "text", "page_start", "page_end", "source_ids", "reasons")


def _merge_islands(units: DataFrame, keys: list[str], joins_previous: Column, reason: Column) -> DataFrame:
    """Rows where `joins_previous` are merged with the row before for their `reason`, chains included."""
    order = Window.partitionBy(*keys).orderBy("position")
    rows = units.withColumn("_joins", F.coalesce(joins_previous, F.lit(False))).withColumn("_reason", reason)
    rows = rows.withColumn("_island", F.sum((~F.col("_joins")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = rows.groupBy(*keys, "_island").agg(F.array_sort(F.collect_list(F.struct(*_UNIT, "_reason"))).alias("parts"))
    first = F.struct(*(F.col("parts")[0][c].alias(c) for c in _UNIT))
    one = F.aggregate(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), first, lambda a, x: merge(a, x, x["_reason"]))
    return grouped.select(*keys, one.alias("unit")).select(*keys, "unit.*")


def merge_backward_fragments(units: DataFrame, keys: list[str]) -> DataFrame:
    """A short fragment joins the unit before, unless that ends a sentence (which its last paragraph decides)."""
    order = Window.partitionBy(*keys).orderBy("position")
    text = T.strip(F.col("text"))
    before = F.lag("text").over(order)
    joins = before.isNotNull() & (F.length(text) <= SHORT_FRAGMENT) & ~T.starts_any_bullet(text) & ~T.is_age_band(text) & ~T.ends_sentence(before)
    return _merge_islands(units, keys, joins, F.lit("short_continuation_backward"))


def _merge_pairs_forward(units: DataFrame, keys: list[str], opens: Column, reason: str) -> DataFrame:
    """A row that opens takes the next one; in a run of opening rows every other one does."""
    order = Window.partitionBy(*keys).orderBy("position")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = units.withColumn("_opens", opens.cast("int")).withColumn("_run", F.sum(1 - F.col("_opens")).over(running))
    nth = F.sum("_opens").over(Window.partitionBy(*keys, "_run").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_takes", (F.col("_opens") == 1) & (nth % 2 == 1))
    return _merge_islands(rows, keys, F.lag("_takes").over(order), F.lit(reason))


def merge_age_bands(units: DataFrame, keys: list[str]) -> DataFrame:
    """U7"""
    return _merge_pairs_forward(units, keys, T.is_age_band(F.col("text")), "age_band_forward")


def is_forward_label(text: Column) -> Column:
    text = T.strip(text)
    return T.casefold(text).isin(*FORWARD_LABELS) | ((F.length(text) <= SHORT_LABEL) & ~T.starts_any_bullet(text) & ~T.ends_sentence(text))


def merge_labels(units: DataFrame, keys: list[str]) -> DataFrame:
    """U8"""
    return _merge_pairs_forward(units, keys, is_forward_label(F.col("text")), "short_label_forward")


def _fold(units: DataFrame, keys: list[str], marks: dict[str, Column], joins: Callable[[Column, Column], Column], reason: Column, together: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """Merge a leaf's units from the left where joins(last, unit) and the length cap allow it.

    `marks` are columns of a unit; `last` has those of its first unit, but where together(last, unit) gives the
    marks of both merged. The fold itself carries lengths, marks and one character a unit, never texts.
    """
    text = F.col("text")
    sizes = {"_length": F.length(text), "_right": F.length(T.lstrip(text)), "_bare": F.length(T.rstrip(text)), "_inner": F.length(T.strip(text))}
    every = {**sizes, **marks}
    grouped = units.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*_UNIT, *(c.alias(n) for n, c in every.items())))).alias("units"))

    def state(flags: Column, values: dict[str, Column]) -> Column:
        return F.named_struct(F.lit("flags"), flags, *(x for n in ("_length", "_bare", *marks) for x in (F.lit(n), values[n])))

    def add(last: Column, unit: Column) -> Column:
        merged = {n: last[n] for n in marks} | together(last, unit)
        merged["_length"] = last["_bare"] + 1 + unit["_right"]
        merged["_bare"] = last["_bare"] + F.when(unit["_inner"] > 0, unit["_inner"] + 1).otherwise(0)
        fits = last["_length"] + 1 + unit["_length"] <= MAX_LIST
        return F.when(fits & joins(last, unit), state(F.concat(last["flags"], F.lit("1")), merged)).otherwise(state(F.concat(last["flags"], F.lit("0")), {n: unit[n] for n in every}))

    first = F.get("units", F.lit(0))
    flags = F.aggregate(F.slice("units", F.lit(2), F.greatest(F.size("units") - 1, F.lit(0))), state(F.lit("0"), {n: first[n] for n in every}), add, lambda s: s["flags"])
    rows = grouped.select(*keys, flags.alias("_flags"), F.posexplode("units").alias("_at", "unit")).select(*keys, "unit.*", (F.substring("_flags", F.col("_at") + 1, F.lit(1)) == "1").alias("_merged"))
    return _merge_islands(rows, keys, F.col("_merged"), reason)


def group_bullets(units: DataFrame, keys: list[str]) -> DataFrame:
    """U9"""
    marks = {"_nested": T.starts_nested_bullet(F.col("text")), "_parent": T.starts_parent_bullet(F.col("text"))}
    reason = F.when(F.col("_nested"), "nested_bullet_backward").otherwise("adjacent_bullets")
    return _fold(units, keys, marks, lambda last, unit: unit["_nested"] | (unit["_parent"] & last["_parent"]), reason, lambda last, unit: {})


def merge_continuations(units: DataFrame, keys: list[str]) -> DataFrame:
    """U10"""
    text = T.strip(F.col("text"))
    marks = {"_continues": F.rlike(text, F.lit(T.CITATION_ONLY)) | T.starts_lowercase_prose(text)}
    return _fold(units, keys, marks, lambda last, unit: unit["_continues"], F.lit("artifact_continuation_backward"), lambda last, unit: {})


def complete_labels(units: DataFrame, keys: list[str]) -> DataFrame:
    """A unit begun by a label takes what follows until a sentence ends, which its last part decides."""
    text = F.col("text")
    marks = {"_label": F.array_contains("reasons", "short_label_forward"), "_bullet": T.contains_any_bullet(text), "_ends": T.ends_sentence(text)}
    both = lambda last, unit: {"_label": last["_label"] | unit["_label"], "_bullet": last["_bullet"] | unit["_bullet"], "_ends": unit["_ends"]}
    return _fold(units, keys, marks, lambda last, unit: last["_label"] & ~last["_bullet"] & ~last["_ends"], F.lit("label_sentence_completion"), both)


def number_units(units: DataFrame, keys: list[str]) -> DataFrame:
    """Ids leaf-gNNN in order; the last key is the leaf."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("position"))
    return units.withColumn("unit_no", number).withColumn("id", F.format_string("%s-g%03d", F.col(keys[-1]).cast("string"), "unit_no")).withColumn("character_count", F.length("text"))


def generation_units(paragraphs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """All passes in their fixed order: (units, removals)."""
    units, removed = remove_noise(paragraphs, keys)
    for step in (merge_backward_fragments, merge_age_bands, merge_labels, group_bullets, merge_continuations, complete_labels):
        units = step(units, keys)
    return number_units(units, keys), removed


def unaccounted(paragraphs: DataFrame, units: DataFrame, removed: DataFrame) -> DataFrame:
    """Paragraphs that are neither in a unit nor removed, or both; empty when all is well."""
    kept = units.select(F.explode("source_ids").alias("id"))
    gone = removed.select("id")
    lost = paragraphs.select("id").exceptAll(kept.unionAll(gone)).withColumn("problem", F.lit("lost or duplicate"))
    return lost.unionByName(kept.intersect(gone).withColumn("problem", F.lit("kept and removed"))).unionByName(kept.unionAll(gone).exceptAll(paragraphs.select("id")).withColumn("problem", F.lit("unknown")))


def foreign_sources(units: DataFrame, paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Sources of a unit that belong to another leaf; merging never makes any."""
    each = units.select(*(F.col(k).alias(f"_{k}") for k in keys), F.explode("source_ids").alias("id"))
    same = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys]
    return each.join(paragraphs.select("id", *keys), "id").where(~F.forall(F.array(*same), lambda x: x)).select("id", *keys)


def reason_histogram(units: DataFrame, removed: DataFrame) -> DataFrame:
    """U15"""
    merged = units.select(F.lit("merge").alias("kind"), F.explode("reasons").alias("reason"))
    return merged.unionByName(removed.select(F.lit("removal").alias("kind"), "reason")).groupBy("kind", "reason").agg(F.count("*").alias("n"))
