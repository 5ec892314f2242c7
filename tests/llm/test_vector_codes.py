import math
import random

import numpy as np
import pytest
from oracle import difference

from raritas.llm import vector_codes
from raritas.llm.vector_codes import encode_vectors, migrate, nearest_entries, number_rows, settle, with_label_error


def brute(rows, parts, entries, rounds, scale):
    """(key, label, code, error) of each kept row and the codebooks, by plain loops."""
    fine = [(k, l, v) for k, v, l in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((k is None, k or 0, len(v)) for k, _, v in fine if len(v) % parts == 0)
    kept = [(k, l, [math.floor(scale * float(x)) for x in v]) for k, l, v in fine if order and len(v) == order[0][2]]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    width = order[0][2] // parts if order else 0
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, _, v in kept]
    books = [[tuple(v[p * width : (p + 1) * width]) for _, _, v in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(c[p], books[p])[1] for c in cut]
            for e in range(len(first)):
                members = [c[p] for c, o in zip(cut, own) if o == e]
                if members:
                    books[p][e] = tuple(sum(x) // len(members) for x in zip(*members))
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    return [(k, l, "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for (k, l, _), f in zip(kept, found)], books


def odd_rows():
    draw = random.Random(3)
    rows = [(i, [draw.choice([-1.5, -0.5, 0.0, 0.25, 2.0]) for _ in range(6)], draw.choice([None, 0, 1])) for i in range(300)]
    rows += [(7, rows[7][1], 1)] * 40 + [(None, [0.25] * 6, 2), (None, [0.25] * 6, None), (900, None, 1), (901, [], 1)]
    return rows + [(902, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (903, [float("nan")] * 6, 0), (904, [math.inf] * 6, 0), (905, [1.0] * 4, 0), (906, [1.0] * 9, 1)]


@pytest.mark.parametrize("parts, entries, rounds", [(3, 5, 2), (2, 256, 1), (1, 1, 3), (6, 7, 0)])
def test_odd_rows_and_clashing_columns(spark, parts, entries, rounds):
    rows = odd_rows()
    given = [(k, v, m, 1, b"x", "c") for k, v, m in rows]
    table = spark.createDataFrame(given, "vec_id long, embedding array<float>, label int, rid int, part binary, code string").repartition(5)
    coded, books = encode_vectors(table, "vec_id", "embedding", "label", parts, entries, rounds, scale=4)
    wanted, ends = brute(rows, parts, entries, rounds, 4)
    assert sorted(map(tuple, coded.collect()), key=repr) == sorted(wanted, key=repr)
    assert [[tuple(e) for e in b] for b in books.tolist()] == ends
    sums = {m: sum(e for _, l, _, e in wanted if l == m) for m in (None, 0, 1, 2)}
    assert {(r.label, r.label_error) for r in with_label_error(coded).collect()} == {(m, s) for m, s in sums.items() if any(l == m for _, l, _, _ in wanted)}


def test_twelve_parts_fill_two_words(spark):
    rows = [(i, [float((i * j) % 7) for j in range(12)], None) for i in range(50)]
    coded, _ = encode_vectors(spark.createDataFrame(rows, "k long, x array<double>, l int"), "k", "x", None, 12, 9, 1, 2)
    assert sorted(map(tuple, coded.collect())) == sorted(brute(rows, 12, 9, 1, 2)[0])


def test_empty_table_and_no_usable_rows(spark):
    for rows in ([], [(1, None, 0), (2, [1.0], 0)]):
        table = spark.createDataFrame(rows, "k long, x array<double>, l int")
        coded, books = encode_vectors(table, "k", "x", "l", parts=2)
        assert with_label_error(coded).collect() == [] and books.size == 0


def test_large_components(spark):
    rows = [(i, [float((-1) ** i * (1 << 26) + i), float(i)], 0) for i in range(20)]
    coded, _ = encode_vectors(spark.createDataFrame(rows, "k long, x array<double>, l int"), "k", "x", "l", 1, 4, 2, 1)
    assert sorted(map(tuple, coded.collect())) == sorted(brute(rows, 1, 4, 2, 1)[0])
    with pytest.raises(Exception, match="exceeds"):
        encode_vectors(spark.createDataFrame([(1, [1e30], 0)], "k long, x array<double>, l int"), "k", "x", "l", 1)


def test_ties_go_to_the_lower_index():
    index, error = nearest_entries(np.array([[0, 0], [5, 5]]), np.array([[1, 0], [0, 1], [0, -1], [5, 5], [5, 5]]))
    assert index.tolist() == [0, 3] and error.tolist() == [1, 0]


def test_only_parts_that_change_their_entry_are_shuffled(spark):
    rows = [(i, [float(i), 0.0], 0) for i in range(100)]
    table = spark.createDataFrame(rows, "k long, x array<double>, l int")
    vectors = spark.read.parquet(number_rows(table, "k", "x", "l", 1, 2))
    books = np.array([[[0], [50]], [[0], [9]]], dtype=np.int64)
    after = migrate(settle(vectors, books, 4), np.array([[[0], [40]], [[0], [9]]], dtype=np.int64))
    judged, moved = (spark.read.parquet(f) for f in after.folders)
    # 21 to 25 were closer to 0 than to 50, and are closer to 40 now
    assert judged.count() == 200 and sorted(r.rid for r in moved.collect()) and moved.count() == 5
    assert moved.where("position = 0 and entry = 1").count() == 5 and after.read().count() == 200


def test_query_matches_sql(spark):
    assert difference(spark, vector_codes.query, vector_codes.SQL, "/root/testdata/sf0.001") is None
