import pytest

from raritas.llm import decontaminate

FILL = "und so weiter geht die lange rede ohne rast durch alle tage hin " * 3
ITEM = "A train leaves Paris at 9 and travels 120 km toward Lyon before it stops for 9 minutes near the old bridge."
SHORT = "What colour is the sky"
NUMBERS = "1 2 3 4 5 6 7 8 9 10"
ITEMS = [(1, ITEM), (2, SHORT), (3, NUMBERS), (4, None), (5, ""), (6, "Tom gave Ann 5 apples and then Tom took 5 apples back from her basket")]


def leaks(spark, texts, items=ITEMS, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_leaks(docs, given, **options).collect()
    return {(r.doc_id, r.item_id): r for r in out}


CASES = [
    (FILL + ITEM + FILL, {1}),
    (FILL + ITEM.replace("120", "350").replace("9", "7").replace("Paris", "Berlin").replace("Lyon", "Hamburg") + FILL, {1}),
    (FILL + ITEM.lower().replace("paris", "Paris").replace("lyon", "Lyon") + FILL, {1}),
    (FILL + " " + ITEM.replace(", ", " ").replace(" ", "  \n") + FILL, {1}),
    (FILL + ITEM[: len(ITEM) // 3] + FILL, set()),
    (FILL + "so he asked what colour is the sky today" + FILL, {2}),
    (FILL + NUMBERS + FILL, set()),
    (FILL, set()),
    (None, set()),
    ("", set()),
    (FILL + "Max gave Eva 8 apples and then Max took 8 apples back from her basket", {6}),
    (FILL + "Max gave Eva 8 apples and then Kim took 3 apples back from her basket", set()),
    (FILL + ITEM + FILL + ITEM.replace("9", "7") + SHORT, {1, 2}),
]


def wanted():
    return {(i, item) for i, (_, items) in enumerate(CASES) for item in items}


def test_planted_cases(spark):
    found = leaks(spark, [t for t, _ in CASES], agreement=0.9)
    assert set(found) == wanted()
    assert found[0, 1].verbatim and not found[1, 1].verbatim and found[0, 1].share == 1.0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 7)
    assert set(leaks(spark, [t for t, _ in CASES], agreement=0.9)) == wanted()


@pytest.mark.parametrize("items", [[], [(4, None)], [(3, NUMBERS)]])
def test_nothing_to_look_for(spark, items):
    assert leaks(spark, [ITEM], items) == {}


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, ITEM, 1), (None, ITEM, 1), (8, ITEM + "wort " * 300_000, 2)], "doc_id long, text string, item int")
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, ITEM)], "item_id long, text string")
    out = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    assert {(None, 1), (8, 1)} <= out
    assert decontaminate.find_leaks(docs.limit(0), items).isEmpty()


def test_finds_the_passages_of_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    holding = {(d.doc_id, i.item_id) for i in items for d in docs if " ".join(i.text.lower().split()) in " ".join(d.text.lower().split())}
    found = {(r.doc_id, r.item_id) for r in decontaminate.query(spark, folder).collect()}
    assert holding <= found and len(found) <= len(holding) + 3


LONG_ITEM = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(200))


def test_long_verbatim_runs_are_leaks_however_long_the_item(spark):
    words = LONG_ITEM.split()
    texts = [FILL + " ".join(words[50:63]) + " " + FILL, FILL + " ".join(words[50:62]) + " " + FILL, FILL.join([" ".join(words[i : i + 10]) + " " for i in (0, 60, 120)])]
    assert set(leaks(spark, texts, [(1, LONG_ITEM)])) == {(0, 1)}


def test_alignments_are_judged_one_by_one(spark):
    item = "the farmer sold 5 eggs and 7 hens on monday and 5 eggs and 9 hens on the following friday morning"
    changed = " ".join(item.replace("5", str(n), 1).replace("5", str(n + 1)) + " " + FILL for n in range(20, 40))
    words = [w for w in LONG_ITEM.split()][:60]
    # verbatim beside twenty copies of inconsistent values; windows of an item far apart from each other, in wrong order
    scattered = " ".join(" ".join(words[i : i + 8]) + " " + FILL for i in range(50, -1, -3))
    found = leaks(spark, [FILL + item + " " + changed, FILL + scattered], [(1, item), (2, " ".join(words))])
    assert set(found) == {(0, 1)} and found[0, 1].verbatim


GERMAN = "Der Bauer verkauft dem Nachbarn zwei Kisten Birnen und der Nachbar bringt dem Bauern einen Sack Mehl vom Markt in die Scheune"
NAMES = "Anna Berg, Carl Dorn, Emma Falk, Georg Hahn, Ida Jung and Karl Lang met Maria Nagel"
SUMS = "Add 17 and 25, 31, 48, 52, 66, 73, 89, 94, 105"


def test_copies_in_other_case_and_copies_rich_in_slots_are_leaks(spark):
    texts = [FILL + t + " " + FILL for t in (ITEM.lower(), ITEM.upper(), GERMAN.lower(), NAMES, NAMES.lower(), SUMS, SUMS.replace("5", "4"))]
    texts.append(FILL + ITEM.lower().replace("120", "350").replace("9", "7") + FILL)
    found = leaks(spark, texts, [(1, ITEM), (2, GERMAN), (3, NAMES), (4, SUMS)])
    assert set(found) == {(0, 1), (1, 1), (2, 2), (3, 3), (4, 3), (5, 4), (7, 1)}
    assert found[0, 1].share == 1.0 and found[0, 1].verbatim and not found[7, 1].verbatim


def test_long_stretches_of_repeated_words(spark):
    import time

    started = time.time()
    texts = ["la " * 16_000, "la le lu " * 6_000, "so ".join([FILL, "la " * 5_000, ITEM, " le" * 5_000]), "word " * 100]
    items = [(1, "la " * 800), (2, "la le lu " * 30), (3, ITEM)]
    found = leaks(spark, texts, items)
    assert set(found) == {(0, 1), (1, 2), (2, 1), (2, 3)}
    assert found[0, 1].share == 1 and found[0, 1].verbatim and found[1, 2].share == 1 and found[2, 3].share == 1
    assert found[0, 1].last_word - found[0, 1].first_word + 1 == 800
    assert time.time() - started < 120


def test_shortened_stretches_find_the_same_leaks(spark):
    import random

    draw = random.Random(12)

    def stretch():
        words = [draw.choice(["la", "le", "Lu", "12", "kg", "Ann", "so", "ist"]) for _ in range(draw.randrange(1, 6))]
        return " ".join(words * draw.randrange(1, 60))

    texts = [" ".join(stretch() for _ in range(draw.randrange(1, 5))) for _ in range(40)]
    items = [(i, " ".join(t.split()[draw.randrange(10) :][: draw.randrange(4, 30)])) for i, t in enumerate(texts[:12])]
    short, whole = leaks(spark, texts, items), leaks(spark, texts, items, shorten=False)
    assert len(whole) > 12 and set(short) == set(whole)
    for pair, row in whole.items():
        assert (short[pair].share, short[pair].verbatim) == (row.share, row.verbatim), pair


def test_windows_deep_inside_a_stretch():
    import numpy as np

    values, kind, rows = np.array([5] * 100 + [1, 2] * 50 + [7]), np.zeros(201, dtype=int), np.array([0, 60, 201])
    regions = decontaminate.periodic_regions(kind, values, rows, 5)
    place = np.arange(0, 190)
    inside = decontaminate.deep_inside(regions, place, 8)
    # the first row's 60 words, the second's 40 of one kind, then 100 in pairs: each but for its margins
    assert inside[7:45].all() and not inside[:7].any() and not inside[46:67].any()
    assert inside[67:85].all() and not inside[86:107].any() and inside[108:184].all() and not inside[185:].any()
