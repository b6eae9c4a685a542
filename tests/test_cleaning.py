import random

from pyspark.sql import functions as F

from tests import machines
from treatise.operators import cleaning

PARTS = ["12-18 months", "Label here", "A sentence ends here.", "• item one", "◦ nested", "lower case goes on", "(Smith, 2001).", "Did you know…", 'He said "so."', "x" * 1499, "Ends not", "- dash item", "510/", "ab/cd", "URL: http://x.y", "(https://x.y)", "Media Attributions", "An interactive H5P element has been excluded from this version of the text.", "▪ o square", "2 – 3 Months", "...", "Éa b/c"]


def _frame(spark, texts_by_leaf):
    rows = [(leaf, i, t, i + 1, i + 1, f"{leaf}-{i}") for leaf, texts in texts_by_leaf.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "leaf_id string, position int, text string, page_start int, page_end int, id string")


def test_all_passes_match_sequential_machines(spark):
    rng = random.Random(7)
    leaves = {f"leaf{n:03d}": [rng.choice(PARTS) for _ in range(rng.randint(1, 14))] for n in range(150)}
    units, removed = cleaning.generation_units(_frame(spark, leaves), ["leaf_id"])
    got, gone = {}, {}
    for r in units.orderBy("leaf_id", "unit_no").collect():
        got.setdefault(r.leaf_id, []).append((r.text, r.source_ids, r.reasons))
        assert r.id == f"{r.leaf_id}-g{r.unit_no:03d}" and r.character_count == len(r.text)
    for r in removed.collect():
        gone[r.id] = r.reason
    for leaf, texts in leaves.items():
        why = machines.noise(texts)
        assert {f"{leaf}-{i}": w for i, w in enumerate(why) if w} == {k: v for k, v in gone.items() if k.startswith(leaf)}
        kept = [i for i, w in enumerate(why) if not w]
        want = [(t, [f"{leaf}-{kept[i]}" for i in ids], reasons) for t, ids, reasons in machines.passes([texts[i] for i in kept])]
        assert got.get(leaf, []) == want, leaf


def test_provenance_and_seeded_loss(spark):
    rows = _frame(spark, {"a": ["One sentence is here.", "URL: http://x.y", "Another one is here."]})
    units, removed = cleaning.generation_units(rows, ["leaf_id"])
    assert cleaning.unaccounted(rows, units, removed).count() == 0
    assert cleaning.unaccounted(rows, units.where("unit_no = 1"), removed).collect()[0].problem == "lost or duplicate"


def test_length_bounds(spark):
    for n, merged in ((40, 1), (41, 2)):
        rows = _frame(spark, {"a": ["This has no end and is long enough to be no label of sixty letters", "x" * n]})
        units, _ = cleaning.remove_noise(rows, ["leaf_id"])
        assert cleaning.merge_backward_fragments(units, ["leaf_id"]).count() == merged
    for n, merged in ((2999 - 7, 1), (3000 - 7, 2)):
        rows = _frame(spark, {"a": ["• " + "x" * (n - 2), "◦ three"]})
        units, _ = cleaning.remove_noise(rows, ["leaf_id"])
        assert cleaning.group_bullets(units, ["leaf_id"]).count() == merged


def test_empty_table(spark):
    units, removed = cleaning.generation_units(_frame(spark, {"a": ["x"]}).where("false"), ["leaf_id"])
    assert units.count() == 0 and removed.count() == 0 and cleaning.reason_histogram(units, removed).count() == 0
