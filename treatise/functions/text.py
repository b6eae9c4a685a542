"""Text primitives with the semantics of Python's str methods, as native column expressions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_TOKEN = re.compile(r"\w+")

# White space as Python's str.split() and str.strip() know it.
SPACE = r"(?U:[\s\x1c-\x1f])"

# Characters and patterns of the cleaning rules.
PARENT_BULLET = r"\A[•●*-]\s+"
NESTED_BULLET = r"\A[◦▪]"
LIST_ITEM = r"\A(?:[•●▪◦*-]|\d+[.)]|[A-Za-z][.)])\s+"
SENTENCE_END = r"[.!?…][”\"'’)\]]*\z"
LINE_SENTENCE_END = r"[.!?][”\"'’)\]]*\z"
PLACEHOLDER = r"(?i)\A(?:an|one or more)\s+interactive(?:\s+H5P)?\s+elements?\s+has\s+been\s+excluded\s+from\s+this\s+version\s+of\s+the\s+text\."
URL_ONLY = r"(?i)\A\s*(?:[•◦*-]\s*)?(?:(?:online\s+here|url)\s*:\s*)?\(?https?://\S+\)?\s*\z"
URL_TAIL = r"\A[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+\z"
AGE_BAND = r"(?i)\A\d+\s*[–—-]\s*\d+(?:\s+months?)?\z"
CITATION_ONLY = r"(?d)\A\(.*\)\.?\z"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def casefold(text: Column) -> Column:
    """str.casefold() for Latin, Greek and Cyrillic letters: lower case, with sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def strip(text: Column) -> Column:
    return rstrip(lstrip(text))


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+\z", "")


def normalize(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def normalized_key(text: Column) -> Column:
    return casefold(normalize(text))


def tokens(text: Column) -> Column:
    """Case-folded runs of letters, digits and underscores."""
    return F.regexp_extract_all(casefold(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _with_arrays(rows: DataFrame, text: str, made: Callable[[list[str]], list], fields: list[T.StructField]) -> DataFrame:
    """rows without `text`, with the columns that `made` gives for its texts; null counts as empty."""
    others = [c for c in rows.columns if c != text]
    schema = T.StructType([*(rows.schema[c] for c in others), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                folded = [(x or "").casefold() for x in part.column(text).to_pylist()]
                arrays = [pa.array(values, to_arrow_type(f.dataType)) for values, f in zip(made(folded), fields)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *arrays], names=schema.names)

    return rows.mapInArrow(run, schema)


def with_tokens(rows: DataFrame, text: str) -> DataFrame:
    """rows with t, the tokens of `text` in order, in its place.

    Python's own str.casefold() and word characters, in Arrow batches; about as fast as tokens(), which differs from
    them in rare letters.
    """
    return _with_arrays(rows, text, lambda folded: [[_TOKEN.findall(x) for x in folded]], [T.StructField("t", T.ArrayType(T.StringType()))])


def with_term_counts(rows: DataFrame, text: str) -> DataFrame:
    """rows with terms and tfs, the distinct tokens of `text` and how often each occurs, and dl, all of them, in its place.

    Counting inside a row has no built-in form but exploding and grouping, which shuffles every token.
    """

    def made(folded: list[str]) -> list:
        counts = [Counter(_TOKEN.findall(x)) for x in folded]
        return [[list(c) for c in counts], [list(c.values()) for c in counts], [c.total() for c in counts]]

    return _with_arrays(rows, text, made, [T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.IntegerType())), T.StructField("dl", T.IntegerType())])


def lines(text: Column) -> Column:
    """str.splitlines(), but for a last empty line."""
    return F.split(text, LINE_BREAK)


def ends_sentence(text: Column) -> Column:
    """Of a unit: the text, stripped, ends with a stop, closing quotes allowed."""
    return F.rlike(strip(text), F.lit(SENTENCE_END))


def line_ends_sentence(text: Column) -> Column:
    """Of a line of a page: without an ellipsis and without stripping."""
    return F.rlike(text, F.lit(LINE_SENTENCE_END))


def starts_parent_bullet(text: Column) -> Column:
    return F.rlike(strip(text), F.lit(PARENT_BULLET))


def starts_nested_bullet(text: Column) -> Column:
    return F.rlike(strip(text), F.lit(NESTED_BULLET))


def starts_any_bullet(text: Column) -> Column:
    return starts_parent_bullet(text) | starts_nested_bullet(text)


def contains_any_bullet(text: Column) -> Column:
    return F.rlike(text, F.lit("[•●◦▪]"))


def starts_lowercase_prose(text: Column) -> Column:
    """The first letter is lower case, and the text is no list item."""
    return ~starts_any_bullet(text) & F.rlike(F.regexp_extract(text, r"\p{L}", 0), F.lit(r"\p{Ll}"))


def is_age_band(text: Column) -> Column:
    return F.rlike(strip(text), F.lit(AGE_BAND))


def upper_median(column: str) -> Column:
    """The upper of the two middle values of a column, as an aggregate over counts per value: the lower one from above."""
    return F.expr(f"-percentile_disc(0.5) WITHIN GROUP (ORDER BY -`{column}`)")


def content_hash(rows: Column) -> Column:
    """SHA-256 of strings in sorted order, each ended by a zero character."""
    return F.sha2(F.concat(F.array_join(F.sort_array(rows), "\0"), F.lit("\0")), 256)


def order_free_hash(rows: DataFrame) -> DataFrame:
    """One row (n_rows, h): a hash of the hexadecimal hashes h of rows, whatever their order.

    They are combined by their first four digits, then by two, then all, so no task holds a value for every row.
    """
    now = rows.select("h", F.lit(1).cast("bigint").alias("n"))
    for digits in (4, 2, 0):
        now = now.groupBy(F.substring("h" if digits == 4 else "b", 1, digits).alias("b")).agg(F.sum("n").alias("n"), content_hash(F.collect_list("h")).alias("h"))
    return now.select(F.col("n").alias("n_rows"), "h")


def stable_key(value: Column, seed: int = 42) -> Column:
    """A fixed pseudo-random order of ids."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), value), 256)
