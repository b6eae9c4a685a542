"""The data plane of question generation: counts, prompts, parsing and cleaning of model output, resuming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, normalize

# The most characters of a unit and the questions asked for it.
COUNT_STEPS = ((100, 2), (250, 4), (500, 6), (1000, 8))
MOST_QUESTIONS, LEAST_VALID = 10, 2
# Fixed value: the prompt.
PROMPT = """[INST]
Generate exactly %d standalone information-seeking questions from the passage below.

Requirements:
- Every question must be answerable using only the passage.
- Cover distinct factual or conceptual claims.
- Do not mention "the passage", "the text", an author, a chapter, or a section.
- Do not include answers or explanations.
- Avoid duplicate or near-duplicate questions.
- Return only a valid JSON array of exactly %d strings.

Passage:
%s
[/INST]"""
# The groups are possessive: Java's matcher goes a call deeper for each turn of others, and literals can be long.
_LITERAL = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'


def requested_count(character_count: Column) -> Column:
    """G1"""
    out = None
    for most, n in COUNT_STEPS:
        out = F.when(character_count <= most, n) if out is None else out.when(character_count <= most, n)
    return out.otherwise(MOST_QUESTIONS)


def prompt(text: Column, count: Column) -> Column:
    """G2"""
    return F.format_string(PROMPT, count.cast("int"), count.cast("int"), text)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _unwrapped(value: Column) -> Column:
    """A variant without the arrays that hold nothing but one array; it has no more of them than brackets at its start."""
    depth = F.length(F.regexp_extract(F.to_json(value), r"^\[+", 0))

    def step(v: Column, _: Column) -> Column:
        inner = F.try_variant_get(v, "$[0]", "variant")
        only = F.try_variant_get(v, "$[1]", "variant").isNull() & F.startswith(F.to_json(inner), F.lit("["))
        return F.when(only, inner).otherwise(v)

    return F.aggregate(F.slice(F.sequence(F.lit(0), depth), F.lit(2), F.greatest(depth - 1, F.lit(0))), value, step)


def _as_text(item: Column) -> Column:
    """A string, or the string that an object has as its question; else null."""
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.when(F.startswith(F.schema_of_variant(item), F.lit("OBJECT")), text(F.try_variant_get(item, "$.question", "variant"))).otherwise(text(item))


def parse_array(raw: Column) -> Column:
    """Strings of the first '[' to the last ']', bullets deleted; null without such a span.

    Whole JSON arrays of strings, of objects with a question, or nested alone in arrays are read as JSON, which is
    parsed once; whatever else has its decodable string literals taken in order.
    """
    start = F.instr(raw, "[")
    end = F.length(raw) - F.instr(F.reverse(raw), "]") + 1
    has = (start > 0) & (F.instr(F.reverse(raw), "]") > 0) & (end >= start)
    literal = lambda s: F.try_variant_get(F.try_parse_json(s), "$", "string")

    def read(body: Column) -> Column:
        literals = F.transform(F.regexp_extract_all(body, F.lit(_LITERAL), F.lit(0)), literal)
        parsed = lambda v: F.filter(F.transform(F.try_variant_get(_unwrapped(v), "$", "array<variant>"), _as_text), lambda s: s.isNotNull())
        return _let(F.try_parse_json(body), lambda v: F.when(v.isNotNull(), parsed(v)).otherwise(literals))

    return F.when(has, _let(F.replace(F.substring(raw, start, end - start + 1), F.lit("•")), read))


def first_of_each(texts: Column, key: Callable[[Column], Column]) -> Column:
    """An array without the strings whose key an earlier one has, by two sorts."""
    keyed = F.array_sort(F.transform(texts, lambda t, i: F.struct(key(t).alias("key"), i.alias("at"), t.alias("text"))))
    new = lambda s: F.filter(s, lambda x, j: (j == 0) | (F.get(s, j - 1)["key"] != x["key"]))
    first = _let(keyed, new)
    return F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["at"].alias("at"), x["text"].alias("text")))), lambda x: x["text"])


def clean_questions(outputs: DataFrame) -> DataFrame:
    """(unit_id, questions, error) from (unit_id, expected_count, raw_output).

    Blanks are normalised; questions end in '?', differ after case folding and are at most expected_count. All of
    it happens inside a unit's row.
    """
    tidy = F.filter(F.transform(parse_array(F.col("raw_output")), normalize), lambda q: F.endswith(q, F.lit("?")))
    rows = outputs.select("unit_id", F.slice(first_of_each(tidy, casefold), F.lit(1), F.col("expected_count")).alias("questions"))
    error = F.when(F.col("questions").isNull(), "no array").when(F.size("questions") < LEAST_VALID, "too few valid questions")
    return rows.select("unit_id", error.alias("error"), "questions").select("unit_id", F.when(F.col("error").isNull(), F.col("questions")).alias("questions"), "error")


def route(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K5: accepted records and failures for the quarantine."""
    return cleaned.where("error IS NULL").drop("error"), cleaned.where("error IS NOT NULL").drop("questions")


def pending(units: DataFrame, completed: DataFrame) -> DataFrame:
    """Units without a record."""
    return units.join(completed.select("unit_id").distinct(), units["id"] == F.col("unit_id"), "left_anti")


def resume_conflicts(completed: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Records of another model, prompt or seed, and units recorded twice."""
    other = completed.where(" OR ".join(f"{c} IS DISTINCT FROM '{v}'" for c, v in expected.items())).select("unit_id", F.lit("other metadata").alias("problem"))
    twice = completed.groupBy("unit_id").count().where("count > 1").select("unit_id", F.lit("duplicate").alias("problem"))
    return other.unionByName(twice)


def first_pending(rows: DataFrame, n: int, order: str = "id") -> DataFrame:
    """G6"""
    return rows.orderBy(order).limit(n)


def planned_totals(units: DataFrame) -> DataFrame:
    """G7"""
    return units.agg(F.count("*").alias("n_units"), F.sum(requested_count(F.col("character_count"))).alias("n_questions"))


def batched(rows: DataFrame, size: int, order: str = "id", group: str | None = None) -> DataFrame:
    """Batch numbers of `size` rows each, counted inside each group if there is one."""
    window = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy(order)
    return rows.withColumn("batch", F.floor((F.row_number().over(window) - 1) / size))


def parse_fenced(raw: Column, least: int = 1, most: int = 3) -> Column:
    """Questions of a JSON object in an optional code fence; null unless their number is in the bounds."""
    body = F.regexp_replace(F.regexp_replace(F.trim(raw), r"\A```(?:json)?\s*", ""), r"\s*```\z", "")
    questions = F.try_variant_get(F.try_parse_json(body), "$.questions", "array<string>")
    return F.when(F.size(questions).between(least, most), questions)
