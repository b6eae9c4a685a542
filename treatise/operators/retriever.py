"""Data for generative retrievers: targets, prompts, constrained decoding, beams, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What marks padding in labels, and the multiple that batches are padded to.
IGNORED, PAD_MULTIPLE = -100, 8
END = "<eos>"
# The prompts for targets that are ids and for those that are paths.
ID_PROMPT = "Retrieve the relevant document section for the query. Return only its identifier.\n\nQuery: {query}"
PATH_PROMPT = (
    "Select the single table-of-contents leaf that best answers the query. Return only its complete hierarchical path exactly as it appears in the table of contents."
    "\n\nTable of Contents:\n{toc}\n\nQuery: {query}"
)
BEAMS = 5


def label_violations(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Queries whose leaf is unknown or whose path is another one than the label's."""
    joined = rows.join(labels.select(F.col("leaf_id").alias("gold_leaf_id"), F.col("canonical_path").alias("label_path")), "gold_leaf_id", "left")
    problem = F.when(F.col("label_path").isNull(), "unknown leaf").when(F.col("label_path") != F.col("gold_path"), "other path")
    return joined.select("id", "gold_leaf_id", problem.alias("problem")).where("problem IS NOT NULL")


def method_rows(rows: DataFrame, labels: DataFrame, methods: dict[str, str] | None = None) -> DataFrame:
    """R2: one row per query and method; the target is the leaf's id or its canonical path."""
    methods = methods or {"id": "leaf_id", "path": "canonical_path"}
    joined = rows.join(labels.select("leaf_id", "canonical_path"), rows["gold_leaf_id"] == F.col("leaf_id"))
    targets = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(c).alias("target")) for m, c in methods.items())))
    return joined.select(*(rows[c] for c in rows.columns), targets.alias("t")).select(*rows.columns, "t.method", "t.target")


def render_prompt(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by a column."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def target_catalog(rows: DataFrame) -> DataFrame:
    """Target -> leaf, each once."""
    return rows.select("method", "target", F.col("gold_leaf_id").alias("leaf_id")).distinct()


def token_trie(targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, prefix, next_tokens) of the targets' tokens; a whole target is followed by the end mark."""
    ended = targets.select(*keys, F.concat("tokens", F.array(F.lit(END))).alias("t"))
    rows = ended.select(*keys, "t", F.explode(F.sequence(F.lit(0), F.size("t") - 1)).alias("n"))
    prefix = F.array_join(F.slice("t", F.lit(1), F.col("n")), " ")
    return rows.groupBy(*keys, prefix.alias("prefix")).agg(F.sort_array(F.collect_set(F.element_at("t", F.col("n") + 1))).alias("next_tokens"))


def allowed_next(walks: DataFrame, trie: DataFrame, keys: list[str]) -> DataFrame:
    """What may follow each walk; the end mark alone where it has left the trie."""
    return walks.join(trie, [*keys, "prefix"], "left").withColumn("next_tokens", F.coalesce("next_tokens", F.array(F.lit(END))))


def rank_beams(predictions: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, gold_leaf_id, gold_rank_at_k, n_unknown) from predictions(id, gold_leaf_id, beams)."""
    rows = predictions.select("id", "gold_leaf_id", F.posexplode("beams").alias("at", "target")).join(catalog.select("target", "leaf_id"), "target", "left")
    hit = F.when(F.col("leaf_id") == F.col("gold_leaf_id"), F.col("at") + 1)
    return rows.groupBy("id", "gold_leaf_id").agg(F.min(hit).alias("gold_rank_at_k"), F.count_if(F.col("leaf_id").isNull()).alias("n_unknown"))


def ranked_targets(predictions: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, rank, target, leaf_id, sequence_score) of predictions(id, beams, scores); blanks around targets go."""
    rows = predictions.select("id", F.posexplode(F.arrays_zip("beams", "scores")).alias("at", "b"))
    rows = rows.select("id", (F.col("at") + 1).alias("rank"), F.trim("b.beams").alias("target"), F.col("b.scores").alias("sequence_score"))
    return rows.join(catalog.select("target", "leaf_id"), "target", "left").select("id", "rank", "target", "leaf_id", "sequence_score")


def beam_violations(predictions: DataFrame, catalog: DataFrame, k: int = BEAMS) -> DataFrame:
    """Queries without k beams, and beams that the catalog does not know."""
    count = predictions.where(F.coalesce(F.size("beams"), F.lit(0)) != k).select("id", F.lit(None).cast("string").alias("target"), F.lit("beam count").alias("problem"))
    each = predictions.select("id", F.explode("beams").alias("target")).select("id", F.trim("target").alias("target"))
    return count.unionByName(each.join(catalog, "target", "left_anti").select("id", "target", F.lit("unknown target").alias("problem")))


def training_examples(rows: DataFrame, most: int) -> DataFrame:
    """Input and label ids of rows(id, prompt_ids, target_ids, end_id); over-long ones are flagged, not cut."""
    ids = F.concat("prompt_ids", "target_ids", F.array("end_id"))
    labels = F.concat(F.array_repeat(F.lit(IGNORED), F.size("prompt_ids")), F.col("target_ids"), F.array("end_id"))
    return rows.select("id", ids.alias("input_ids"), labels.alias("labels"), (F.size(ids) > most).alias("too_long"))


def pad_batches(examples: DataFrame, pad_id: int) -> DataFrame:
    """Each batch is padded to its longest example, rounded up to a multiple of 8."""
    width = (F.ceil(F.max(F.size("input_ids")).over(Window.partitionBy("batch")) / PAD_MULTIPLE) * PAD_MULTIPLE).cast("int")
    rows = examples.withColumn("width", width).withColumn("gap", F.col("width") - F.size("input_ids"))
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("gap")))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), F.col("gap")))
    return rows.select("id", "batch", fill("input_ids", pad_id).alias("input_ids"), fill("labels", IGNORED).alias("labels"), mask.alias("attention_mask"))


def schedule(runs: DataFrame) -> DataFrame:
    """Per epoch of runs(run, n_examples, batch, accumulation, epochs, rate): updates so far and learning rate."""
    updates = F.ceil(F.ceil(F.col("n_examples") / F.col("batch")) / F.col("accumulation"))
    rows = runs.withColumn("updates", updates).withColumn("total", F.col("updates") * F.col("epochs"))
    rows = rows.withColumn("warmup", F.greatest(F.lit(1), F.bround(F.col("total") * 0.1).cast("bigint")))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))))
    done = F.col("updates") * F.col("epoch")
    rate = F.when(done < F.col("warmup"), F.col("rate") * done / F.col("warmup")).otherwise(F.col("rate") * (F.col("total") - done) / (F.col("total") - F.col("warmup")))
    return rows.select("run", "epoch", F.col("updates").alias("updates_per_epoch"), F.col("total").alias("total_updates"), "warmup", done.alias("updates_done"), rate.alias("learning_rate"))


def early_stopping(history: DataFrame, patience: int = 2) -> DataFrame:
    """Improved (strictly better than all before), epochs since, and whether training stops here."""
    order = Window.partitionBy("run").orderBy("epoch")
    before = F.max("score").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = history.withColumn("improved", F.coalesce(F.col("score") > before, F.lit(True)))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("best", F.max("score").over(so_far)).withColumn("since", F.col("epoch") - F.max(F.when(F.col("improved"), F.col("epoch"))).over(so_far))
    return rows.withColumn("stop", F.col("since") >= patience)
