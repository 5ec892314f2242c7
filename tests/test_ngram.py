import random
import time
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from raritas.functions import runtime
from raritas.functions.text import gram_array
from raritas.operators import ngram
from raritas.plans import joins


def grams(text, n):
    return [text[i : i + n] for i in range(len(text) - n + 1)]


def unusual(texts, n, th):
    counts = Counter(g for t in texts for g in grams(t, n))
    if not counts:
        return set()
    average = sum(counts.values()) / len(counts)
    return {t for t, f in counts.items() if f < average - average * th or f > average + average * th}


def brute_rows(rows, n, th):
    d = len(rows[0])
    result = [[0, 0, 0] for _ in rows]
    for arity in (1, 2, 3):
        for s in combinations(range(d), arity):
            for token in unusual(["".join(r[a] for a in s) for r in rows], n, th):
                for line, r in zip(result, rows):
                    line[arity - 1] += any(token in r[a] for a in s)
    return [tuple(r) for r in result]


def brute_attributes(rows, n, th):
    d = len(rows[0])
    score = [0] * d
    for arity in (1, 2, 3):
        for s in combinations(range(d), arity):
            whole = ["".join(r[a] for a in s) for r in rows]
            hits = sum(token in t for token in unusual(whole, n, th) for t in whole)
            for a in s:
                score[a] += hits
    return score


def table(spark, rows):
    names = [f"a{i}" for i in range(len(rows[0]))]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, " + ", ".join(f"{c} string" for c in names)), names


def random_rows(seed, d, count=30):
    rng = random.Random(seed)
    return [tuple("".join(rng.choice("abé😀\n") for _ in range(rng.randrange(0, 7))) for _ in range(d)) for _ in range(count)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_gram_array_counts_code_points(spark, n):
    texts = ["", "a", "ab", "a😀b\ncé", "aaaa"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", gram_array(F.col("t"), n).alias("g")).collect()
    for row in found:
        assert sorted(row["g"]) == sorted(grams(row["t"], n))


@pytest.mark.parametrize("n_att", [1, 2, 3])
def test_ngrams_of_concatenated_attributes(spark, n_att):
    rows = random_rows(5, 3, 10)
    df, names = table(spark, rows)
    found = Counter((r["set_id"], r["id"], r["token"]) for r in ngram.ngrams(df, "id", names, 2, n_att).collect())
    wanted = Counter()
    for set_id, s in enumerate(combinations(range(3), n_att)):
        for i, r in enumerate(rows):
            wanted.update((set_id, i, g) for g in grams("".join(r[a] for a in s), 2))
    assert found == wanted


def test_ngrams_rejects_other_widths(spark):
    df, names = table(spark, [("a", "b")])
    with pytest.raises(ValueError):
        ngram.ngrams(df, "id", names, 3, 4)
    assert ngram.ngrams(df, "id", names, 3, 3).count() == 0


@pytest.mark.parametrize("seed,d,n", [(1, 3, 2), (2, 2, 3), (3, 1, 2), (4, 4, 1), (6, 4, 2)])
def test_row_and_attribute_scores_against_brute_force(spark, seed, d, n):
    rows = random_rows(seed, d)
    df, names = table(spark, rows)
    found = {r["id"]: tuple(r)[1:] for r in ngram.ngram_detect(df, "id", names, n, 0.3).collect()}
    assert [found[i] for i in range(len(rows))] == brute_rows(rows, n, 0.3)
    scores = {r["attr"]: r["score"] for r in ngram.attribute_hits(df, names, n, 0.3).collect()}
    assert [scores[a] for a in range(d)] == brute_attributes(rows, n, 0.3)


def test_seam_token_scores_attributes_but_not_rows(spark):
    # "ab" arises only across the seam, and only there is it rare.
    rows = [("xa", "bx")] + [("xx", "xx")] * 6
    df, names = table(spark, rows)
    found = {r["id"]: r["pairs_ngram"] for r in ngram.ngram_detect(df, "id", names, 2, 0.3).collect()}
    assert [found[i] for i in range(7)] == [r[1] for r in brute_rows(rows, 2, 0.3)]
    scores = {r["attr"]: r["score"] for r in ngram.attribute_hits(df, names, 2, 0.3).collect()}
    assert [scores[a] for a in range(2)] == brute_attributes(rows, 2, 0.3)
    assert "ab" in unusual([a + b for a, b in rows], 2, 0.3)


def test_shuffled_join_gives_the_same_scores(spark, monkeypatch):
    rows = random_rows(7, 3, 60)
    df, names = table(spark, rows)
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    for parts in (4, 20_000):
        monkeypatch.setattr(joins, "HOT_PARTS", parts)
        monkeypatch.setattr(ngram, "HOT_PARTS", parts)
        found = {r["id"]: tuple(r)[1:] for r in ngram.ngram_detect(df, "id", names, 2, 0.3).collect()}
        assert [found[i] for i in range(len(rows))] == brute_rows(rows, 2, 0.3)


def test_compat_third_attribute_and_fixed_length(spark):
    rows = random_rows(8, 4, 40)
    df, names = table(spark, rows)
    found = {r["id"]: tuple(r)[1:] for r in ngram.ngram_detect(df, "id", names, 2, 0.3, compat=True).collect()}
    triplets = [0] * len(rows)
    for i, j, k in combinations(range(4), 3):
        for token in unusual([r[i] + r[j] + r[k] for r in rows], 3, 0.3):
            for x, r in enumerate(rows):
                triplets[x] += any(token in r[a] for a in (i, j, k - i))
    plain = brute_rows(rows, 2, 0.3)
    assert [found[x] for x in range(len(rows))] == [(*plain[x][:2], triplets[x]) for x in range(len(rows))]


def test_maximum_may_be_negative_and_matches_loops(spark):
    rows = random_rows(9, 3, 12)
    df, names = table(spark, rows)
    for n in (1, 3, 9):
        wanted = [0] * 3
        for r in rows:
            for size in (1, 2, 3):
                for s in combinations(range(3), size):
                    times = {1: 1, 2: 2, 3: 6}[size]
                    for a in s:
                        wanted[a] += times * (sum(len(r[b]) for b in s) - n + 1)
        found = {r["attr"]: r["maximum"] for r in ngram.attribute_maximum(df, names, n).collect()}
        assert [found[a] for a in range(3)] == wanted
    assert min(wanted) < 0


def test_sixteen_attributes(spark):
    rows = random_rows(5, 16, 50)
    df, names = table(spark, rows)
    started = time.time()
    found = {r["id"]: tuple(r)[1:] for r in ngram.ngram_detect(df, "id", names, 2, 0.3).collect()}
    detected = time.time()
    scores = {r["attr"]: r["score"] for r in ngram.attribute_hits(df, names, 2, 0.3).collect()}
    scored = time.time()
    maximum = {r["attr"]: r["maximum"] for r in ngram.attribute_maximum(df, names, 2).collect()}
    print(f"detect {detected - started:.1f} s, hits {scored - detected:.1f} s, maximum {time.time() - scored:.1f} s")
    assert found == dict(enumerate(brute_rows(rows, 2, 0.3)))
    assert scores == dict(enumerate(brute_attributes(rows, 2, 0.3)))
    sizes = [sum(len(r[a]) for r in rows) - len(rows) for a in range(16)]
    lengths = [sum(len(r[a]) for r in rows) for a in range(16)]
    for a in range(16):
        pairs = sum(sizes[a] + lengths[b] for b in range(16) if b != a)
        triplets = sum(sizes[a] + lengths[b] + lengths[c] for b, c in combinations([x for x in range(16) if x != a], 2))
        assert maximum[a] == sizes[a] + 2 * pairs + 6 * triplets


def test_more_attributes_than_a_word_has_bits(spark):
    rows = [tuple("ab" if (i * a) % 7 else "b" for a in range(70)) for i in range(4)]
    df, names = table(spark, rows)
    found = {r["id"]: r["single_ngram"] for r in ngram.ngram_detect(df, "id", names, 2, 0.0).collect()}
    alone = [sum(t in r[a] for a in range(70) for t in unusual([x[a] for x in rows], 2, 0.0)) for r in rows]
    assert found == dict(enumerate(alone))


def test_shuffled_token_join_leaves_rows_without_tokens_out(spark, monkeypatch):
    rows = [*random_rows(6, 3), ("", "", ""), ("a", "", "b")]
    df, names = table(spark, rows)
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_PARTS", 50)
    found = {r["id"]: tuple(r)[1:] for r in ngram.ngram_detect(df, "id", names, 2, 0.3).collect()}
    assert found == dict(enumerate(brute_rows(rows, 2, 0.3)))


@pytest.mark.parametrize("d, th", [(40, 0.3), (40, 0.9)])
def test_forty_attributes_against_brute_force(spark, d, th):
    rows = random_rows(11, d, 6)
    df, names = table(spark, rows)
    found = {r["id"]: (r["single_ngram"], r["pairs_ngram"], r["triplets_ngram"]) for r in ngram.ngram_detect(df, "id", names, 2, th).collect()}
    assert [found[i] for i in range(len(rows))] == brute_rows(rows, 2, th)


def test_sets_of_a_token_are_bits():
    sets = ngram.feature_sets(40)
    bits = ngram.SetBits(40, sets)
    words = 1 + max(bits.words)
    assert len(sets) == 10_700 and 8 * words <= 1.1 * 40**3 / 48
    assert len(set(zip(bits.words, bits.places))) == len(sets)
    assert all(bits.masks[a][w] >> p & 1 == (a in s.features) for s, w, p in zip(sets, bits.words, bits.places) for a in range(40))
