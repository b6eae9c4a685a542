"""PII: information-theoretic sanitisation over DataFrame operations only.

Personal data of four fixed kinds (email, ip, card, phone) is found in every whole text. These values are the
protected entities. How strongly another term reveals an entity is estimated from the whole corpus, by documents:
of the documents that hold the term outside of base spans (`spread`), how many hold the entity (`both`). A term
discloses an entity if the pointwise mutual information PMI = log2(p(entity | term) / p(entity)) reaches
`disclosure` times the entity's information -log2 p(entity), and chance does not explain it (below). Its
occurrences in all documents become spans of kind `term`, which are removed by sanitise(), while entities are
generalised to the name of their kind.

Chance: rare words reach any PMI with the entity they happen to meet. If term and entity were independent, the
chance of k or more common documents is at most the product over i < j of (s-i)(h-i) / ((n-i)(k-i)), for any
j <= k (Markov's inequality on the number of j-subsets; s and h are the documents of the term and of the entity,
n all). This times the number of pairs of the corpus must not exceed `level`. Copies are no further evidence:
among the common documents k counts groups of documents that agree in a part of their min-hash sketch.

Cost: no pair is left out for its distance. PMI can reach the threshold only if spread <= held^d * n^(1-d) for
disclosure d and an entity in `held` documents, as both <= held; words beyond this are dropped before words and
entities of a document are paired.

Position arithmetic: a pattern's matches are regexp_extract_all(text, p) and the gaps between them are
split(text, p); both run the same left-to-right search, so running sums of lengths give code-point positions.
Patterns have no repeated groups (Java's matcher recurses on these): a separator between two characters of a
match is first replaced by a private-use character of the same length, so that a match is one character run.

Defined cases: null text is empty; rows without doc_id are judged like others; rows that repeat a doc_id are
separate rows; an empty table gives an empty result; texts and runs of signs may have any length; a base span beats
a term that overlaps it, and base kinds are found each for itself; columns other than doc_id and text are not read,
so these may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import settle

KINDS = ("email", "ip", "card", "phone")
DISCLOSURE = 0.9
LEVEL = 0.05
#: Words in a shingle of the sketch, and hashes in each of its parts: near copies of similarity 0.8 agree in a
#: part with a chance of 98 %, texts that share a fifth of their shingles with 15 %.
SHINGLE, PARTS, HASHES = 4, 4, 2
#: Factors of the bound on chance that are multiplied at most; fewer factors make it larger, never smaller.
FACTORS = 64
#: Terms and entities up to this number are broadcast (about 50 bytes each); more are joined by a shuffle.
BROADCAST_TERMS = 100_000

_MARK = ""
_LOCAL = r"A-Za-z0-9._%+\-"
# A run starts where no character of its kind precedes, or where the match before ended.
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9\-]++[A-Za-z0-9\-]++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
_CARD = r"[0-9][0-9]++"
_PHONE = r"\+[0-9][\x20().0-9\-]+[0-9]"
_TERM = r"^\p{L}[\p{L}\p{Nd}]"
_GAP = r"[^\p{L}\p{Nd}]+"


_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPANS})")


def _found(original: Column, searched: Column, pattern: Column, kind: str) -> Column:
    """Array of (kind, start, end, value), the value from the original text."""
    sizes = F.transform(F.regexp_extract_all(searched, pattern, F.lit(0)), F.length)
    gaps = F.transform(F.split(searched, pattern, -1), F.length)

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        end = begin + pair["size"]
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), F.substring(original, begin + 1, pair["size"]).alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(sizes, F.slice(gaps, F.lit(1), F.size(sizes)), lambda size, gap: F.struct(size.alias("size"), gap.alias("gap")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), _none().alias("spans")), step, lambda s: s["spans"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits from the right, every second one doubled and its own digits summed, is a multiple of 10."""
    each = F.split(F.reverse(digits), "")
    doubled = lambda x: F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
    values = F.transform(F.filter(each, lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _masked(text: Column, separator: str) -> Column:
    """text with each separator replaced by the private-use mark; a mark that was there becomes a space-like sign."""
    return F.regexp_replace(F.translate(text, _MARK, "\x01"), separator, _MARK)


def _byte(part: Column) -> Column:
    """A number of at most 255, with any zeros before it."""
    digits = F.regexp_replace(part, "^0+", "")
    return (F.length(digits) <= 3) & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 255)


def _may_hold(text: Column) -> Column:
    """A cheap test that every text with a base span passes."""
    return F.rlike(text, F.lit("[@0-9]"))


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) of the base kinds, by kind as listed and then by start."""
    among = lambda low, high: lambda s: F.length(_digits(s["value"])).between(low, high)
    email = _found(text, _masked(text, r"(?<=[A-Za-z0-9\-])\.(?=[A-Za-z0-9\-])"), F.lit(_EMAIL), "email")
    ip = F.filter(_found(text, text, F.lit(_IP), "ip"), lambda s: F.forall(F.split(s["value"], r"\."), _byte))
    card = F.filter(_found(text, _masked(text, r"(?<=[0-9])[\x20\-](?=[0-9])"), F.lit(_CARD), "card"), among(13, 19))
    card = F.filter(card, lambda s: _luhn(_digits(s["value"])))
    phone = F.filter(_found(text, text, F.lit(_PHONE), "phone"), among(9, 15))
    # Each search runs only where its rarest sign is; most texts have none of them.
    where = lambda test, found: F.when(test, found).otherwise(_none())
    kinds = [
        where(F.contains(text, F.lit("@")), email),
        where(F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), ip),
        where(F.rlike(text, F.lit(r"[0-9](?:[\x20\-]?[0-9]){12}")), card),
        where(F.rlike(text, F.lit(r"\+[0-9]")), phone),
    ]
    return where(_may_hold(text), F.concat(*kinds))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _outside(text: Column, spans: Column) -> Column:
    """text with a blank for each span."""

    def step(state: Column, s: Column) -> Column:
        keep = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["text"], keep, F.lit(" ")).alias("text"))

    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("text")), step, lambda s: F.concat(s["text"], F.substring(text, s["at"] + 1, F.length(text))))


def _sketch(words: Column) -> list[Column]:
    """Parts of a min-hash sketch of the shingles of an array of words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1)))
    shingles = F.transform(starts, lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
    least = lambda seed: F.array_min(F.transform(shingles, lambda x: F.xxhash64(F.lit(seed), x)))
    return [F.xxhash64(*(least(HASHES * p + h) for h in range(HASHES))).alias(f"part{p}") for p in range(PARTS)]


def _chance(k: Column, s: Column, h: Column, n: Column) -> Column:
    """Natural logarithm of the bound on the chance that s and h of n documents have k or more in common."""
    factor = lambda i: F.ln((s - i) / (n - i)) + F.ln((h - i) / (k - i))
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.least(k, F.lit(FACTORS)) - 1), F.lit(0.0), lambda a, i: a + factor(i))


def disclosing_terms(docs: DataFrame, disclosure: float = DISCLOSURE, level: float = LEVEL) -> DataFrame:
    """(term, entity, pmi) of the terms that disclose an entity; docs has doc, text and spans."""
    entities = F.array_distinct(F.transform("spans", lambda s: F.xxhash64(F.lower(s["value"]))))
    words = F.split(F.lower(_outside(F.col("text"), F.col("spans"))), _GAP)
    holders = docs.where(_may_hold(F.col("text"))).where(F.size("spans") > 0).select(entities.alias("entities"), words.alias("words"))
    holders = holders.select("entities", F.array_distinct("words").alias("words"), *_sketch(F.col("words")))
    holders = settle(holders.withColumn("row", F.monotonically_increasing_id()))
    terms = F.filter("words", lambda w: F.rlike(w, F.lit(_TERM)))
    held = settle(holders.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("held")))
    n = max(docs.count(), 2)
    kinds, most = held.agg(F.count("*"), F.max("held")).first()
    # At least the number of pairs: a pair counts in each of its documents.
    tested = holders.agg(F.sum(F.size("entities").cast("double") * F.size(terms))).first()[0] or 1.0
    # The widest spread of a term whose PMI can reach the threshold, with room for rounding.
    widest = lambda held: F.pow(held.cast("double"), F.lit(disclosure)) * F.pow(F.lit(float(n)), F.lit(1.0 - disclosure)) * (1 + 1e-9)

    free = docs.where(F.size("spans") == 0).select(F.explode(F.array_distinct(F.split(F.lower("text"), _GAP))).alias("term"))
    every = free.unionByName(holders.select(F.explode("words").alias("term"))).select(F.xxhash64("term").alias("key"))
    spread = every.groupBy("key").agg(F.count("*").alias("spread")).where(F.col("spread") <= widest(F.lit(most or 1)))
    used = holders.select("row", F.explode(terms).alias("term")).withColumn("key", F.xxhash64("term"))
    rare = used.join(spread, "key").drop("key")
    parts = [f"part{p}" for p in range(PARTS)]
    met = rare.join(holders.select("row", F.explode("entities").alias("entity"), *parts), "row")
    met = met.join(F.broadcast(held) if kinds <= BROADCAST_TERMS else held, "entity").where(F.col("spread") <= widest(F.col("held")))
    pairs = met.groupBy("entity", "term", "spread", "held").agg(F.count("*").alias("both"), *(F.count_distinct(p).alias(p) for p in parts))
    information = F.log2(F.lit(n) / F.col("held"))
    pmi = F.log2(F.col("both") * F.lit(float(n)) / (F.col("spread") * F.col("held")))
    strong = pairs.where((information > 0) & (pmi >= F.lit(disclosure) * information))
    k = F.least(*parts)
    copies = F.col("both") - k
    chance = _chance(k, F.col("spread") - copies, F.col("held") - copies, F.lit(n) - copies)
    return strong.where(chance + F.ln(F.lit(tested)) <= F.ln(F.lit(level))).select("term", "entity", pmi.alias("pmi"))


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, level: float = LEVEL) -> DataFrame:
    """doc_id, text, base (array of base spans) and spans (base and disclosing terms) of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).select(F.xxhash64("doc_id", "text").alias("doc"), "doc_id", "text", base_spans(F.col("text")).alias("spans"))
    found = settle(disclosing_terms(rows, disclosure, level).groupBy("term").agg(F.max("pmi").alias("pmi")))
    n = found.count()
    words = rows.select("doc", F.explode_outer(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{Nd}]+"))).alias("term"))
    if n == 0:
        return rows.select("doc_id", "text", F.col("spans").alias("base"), "spans")
    mine = words.join(F.broadcast(found) if n <= BROADCAST_TERMS else found, "term").groupBy("doc").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{Nd}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{Nd}])"))
    with_terms = rows.join(mine, "doc", "left")
    covered = lambda s: ~F.exists(F.col("spans"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    extra = F.when(F.col("terms").isNotNull(), F.filter(_found(F.col("text"), F.col("text"), pattern, "term"), covered))
    return with_terms.select("doc_id", "text", F.col("spans").alias("base"), F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.concat("spans", extra)).alias("spans"))


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """doc_id and text, in which entities are generalised to [KIND] and disclosing terms are removed."""
    rows = find_personal_data(docs, **settings)
    ordered = F.sort_array(F.transform(F.col("spans"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        keep = F.substring(F.col("text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        label = F.when((s["kind"] == "term") | (s["start"] < state["at"]), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["text"], keep, label).alias("text"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    clean = F.aggregate(ordered, start, step, lambda s: F.concat(s["text"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return rows.select("doc_id", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")).alias("text"))


def personal_data_digests(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    rows = find_personal_data(docs, **settings)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return rows.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), count("term").alias("n_term"))
