import pytest

from treatise.operators import questions
from treatise.plans import queries

LONG = "the same forty characters and more begin each of these lines, which end in "
#: Each fifth line of a text is short, so that its title is the whole of it; the others are longer than any prefix.
TEXTS = {i: "\n".join("Short one" if n % 5 == 4 and n < 10 else LONG + f"{i} {n} | No{n}" for n in range(15)) for i in range(5)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def _priority(block, title):
    text = " ".join(block.split())
    key, wanted = text.casefold(), title.casefold()
    footer = key.startswith(wanted) and "|" in text
    if key == wanted:
        return 0
    if any(" ".join(x.split()).casefold() == wanted for x in block.splitlines()):
        return 1
    return 2 if title.upper() in text and not footer else 3 if footer else None


def test_heading_priority_of_whole_lines(spark, tables):
    want = {}
    for i, text in TEXTS.items():
        for n, line in enumerate(text.split("\n")):
            title = " ".join((line[:24] if n % 5 == 4 else line).split())
            block = [line, f"x\n{line}\ny", "7 " + title.upper(), title + " | 12", line][n % 5]
            want[i, n] = _priority(block, title)
    assert {(r.doc_id, r.block_no): r.priority for r in queries.p3_heading_priority(spark, tables).collect()} == want
    assert set(want.values()) == {0, 1, 2, 3}


def test_questions_of_whole_lines(spark, tables):
    got = {r.unit_id: r.questions for r in queries.g4_clean_questions(spark, tables).collect()}
    for i in (0, 1, 2, 4):
        distinct = list(dict.fromkeys(line + "?" for line in TEXTS[i].split("\n")))
        assert got[i] == "|".join(distinct[:6])
    assert got[3] is None


def test_long_literals_of_a_cut_array(spark):
    long = ["a\\n" * 40_000 + "?", "b" * 100_000 + "?"]
    rows = spark.createDataFrame([(1, 4, f'["{long[0]}", "{long[1]}", "open]')], "unit_id int, expected_count int, raw_output string")
    assert questions.clean_questions(rows).first().questions == ["a " * 40_000 + "?", long[1]]
