import random

from pyspark.sql import functions as F

from treatise.operators import questions, sections

RAW = {
    "array": ('["A one?", "B two?"]', ["A one?", "B two?"]),
    "prose": ('Sure: ["A  one?", "a one?", "B\\ttwo?"] done', ["A one?", "B two?"]),
    "cut": ('["A one?", "B two?", "C thr]', ["A one?", "B two?"]),
    "deep": ('[[[[[[["A one?", "B two?"]]]]]]]', ["A one?", "B two?"]),
    "deep objects": ('x [[[{"question": "A one?"}, {"question": "B two?"}]]]', ["A one?", "B two?"]),
    "two lists": ('[[["A one?"], ["B two?"]]]', None),
    "list and null": ('[["A one?", "B two?"], null]', None),
    "nested": ('[["A one?", "B two?"]]', ["A one?", "B two?"]),
    "objects": ('[{"question": "A one?"}, {"q": 1}, 5, "B two?"]', ["A one?", "B two?"]),
    "bullet": ('[• "A one?", • "B two?"]', ["A one?", "B two?"]),
    "many": ('["1?","2?","3?","4?","5?"]', ["1?", "2?", "3?", "4?"]),
    "single": ('["A one?", "no mark"]', None),
    "none": ("nothing", None),
    "null": (None, None),
}


def test_parse_and_clean(spark):
    rows = spark.createDataFrame([(k, 4, raw) for k, (raw, _) in RAW.items()], "unit_id string, expected_count int, raw_output string")
    got = {r.unit_id: r.questions for r in questions.clean_questions(rows).collect()}
    assert got == {k: want for k, (_, want) in RAW.items()}
    kept, failed = questions.route(questions.clean_questions(rows))
    assert kept.count() + failed.count() == len(RAW)


def test_requested_counts(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 100, 101, 250, 251, 500, 501, 1000, 1001)], "n int")
    assert [r[0] for r in rows.orderBy("n").select(questions.requested_count(F.col("n"))).collect()] == [2, 2, 4, 4, 6, 6, 8, 8, 10]


def test_fenced(spark):
    rows = spark.createDataFrame([('```json\n{"questions": ["a?"]}\n```',), ('{"questions": []}',), ("x",)], "raw string")
    assert [r[0] for r in rows.select(questions.parse_fenced(F.col("raw"))).collect()] == [["a?"], None, None]


def _block(n, text, x0=57.0, x1=555.0, y0=None, page=1, heading=None):
    top = 100.0 + 20 * n if y0 is None else y0
    return ("d", page, n, x0, top, x1, top + 15, text, 612.0, 792.0, heading)


def _paragraphs(spark, *blocks):
    schema = "doc string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, page_width double, page_height double, heading struct<leaf_id:string,leaf_title:string>"
    rows = spark.createDataFrame(list(blocks), schema)
    return [r.text for r in sections.paragraphs(rows, ["doc"]).orderBy("id").collect()]


def test_paragraph_breaks(spark):
    head = _block(0, "Head", heading=("leaf", "Head"))
    assert _paragraphs(spark, head, _block(1, "self-"), _block(2, "aware a - b")) == ["self-aware a - b"]
    assert _paragraphs(spark, head, _block(1, "one"), _block(2, "two", x0=56.7 + 5.1)) == ["one", "two"]
    assert _paragraphs(spark, head, _block(1, "one"), _block(2, "two", x0=56.7 + 4.9)) == ["one two"]
    assert _paragraphs(spark, head, _block(1, "one.", x1=300.0), _block(2, "two")) == ["one.", "two"]
    assert _paragraphs(spark, head, _block(1, "one", x1=300.0), _block(2, "two")) == ["one two"]
    assert _paragraphs(spark, head, _block(1, "one"), _block(2, "1) two")) == ["one", "1) two"]
    assert _paragraphs(spark, head, _block(1, "one", y0=100.0), _block(2, "two", y0=121.1)) == ["one", "two"]
    assert _paragraphs(spark, head, _block(1, "one", y0=100.0), _block(2, "two", y0=121.0)) == ["one two"]
    assert _paragraphs(spark, head, _block(1, "low", y0=747.0), _block(2, "high", y0=25.0), _block(3, "in")) == ["in"]
    assert _paragraphs(spark, head, _block(1, "a"), _block(2, "No leaf", heading=(None, "No leaf")), _block(3, "gone")) == ["a"]


def test_heading_priority_and_greedy_choice(spark):
    cases = [("Intro", "Intro", 0), ("x\nINTRO\ny", "Intro", 1), ("7 THE LONG\nTITLE", "The Long Title", 2), ("Intro | 3", "Intro", 3), ("else", "Intro", None)]
    rows = spark.createDataFrame(cases, "block string, title string, want int")
    assert all(r[0] == r[1] for r in rows.select(sections.heading_priority(F.col("block"), F.col("title")), "want").collect())
    nodes = spark.createDataFrame([("d", 1, 1, "Same"), ("d", 2, 1, "Same")], "doc string, position int, page int, title string")
    blocks = spark.createDataFrame([("d", 1, 0, 300.0, "Same", 612.0), ("d", 1, 1, 57.0, "same", 612.0)], "doc string, page int, block_no int, x0 double, text string, page_width double")
    assert {r.position: r.block_no for r in sections.assign_headings(nodes, blocks, ["doc"]).collect()} == {1: 1, 2: 0}


def _line_starts(text, title):
    """The rule as one pattern: a title's blanks are any white space, and its lines hold nothing else."""
    import re

    found = re.search(r"(?m)^[ \t\n\x0b\f\r]*" + r"[ \t\n\x0b\f\r]+".join(map(re.escape, re.split(" +", title.strip(" ")))) + r"[ \t\n\x0b\f\r]*$", text)
    return found.start() if found else text.find(title) if title in text else None


def test_headings_of_any_length(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "Ab", "c"])
    gap = lambda: rng.choice([" ", " ", "  ", "\n", " \n ", "\t", "\n\n"])
    pages, nodes, want = [], [], {}
    for i in range(400):
        title = " ".join(word() for _ in range(rng.randint(1, 3)))
        text = rng.choice(["", "\n", " ", "\n \n"]) + "".join(word() + gap() for _ in range(rng.randint(1, 12))) + rng.choice(["", word()])
        pages.append(("d", i, text))
        nodes.append(("d", i, i, title))
        want[i] = _line_starts(text, title)
    long = [f"w{k}" for k in range(1500)]
    pages += [("d", 1000, "x\n  " + "\n ".join(long) + " \ny"), ("d", 1001, "x " + " ".join(long) + "\ny")]
    nodes += [("d", 1000, 1000, " ".join(long)), ("d", 1001, 1001, "  ".join(long))]
    want |= {1000: 2, 1001: None}
    got = sections.locate_headings(spark.createDataFrame(nodes, "doc string, position int, page int, title string"), spark.createDataFrame(pages, "doc string, page int, text string"), ["doc"])
    assert {r.position: r.start for r in got.collect()} == want
