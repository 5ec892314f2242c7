import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from raritas.llm import near_join as nj
from raritas.llm.components import components
from raritas.llm.shingles import shingle_sets


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def by_force(rows, rule):
    """key -> (n_shingles, component_id, n_links), for distinct keys."""
    sets, lists = {i: shingles(t, rule.words) for i, t in rows}, defaultdict(list)
    for i, s in sets.items():
        for g in s:
            lists[g].append(i)
    root, links = {i: i for i in sets}, defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        common = defaultdict(int)
        for g in s:
            for j in lists[g]:
                if j > i:
                    common[j] += 1
        for j, c in common.items():
            if 100 * c >= rule.percent * (len(s) + len(sets[j]) - c):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), links[i]) for i in sets}


def corpus(n, seed):
    draw = random.Random(seed)
    letters = "a b c d e f g h".split()
    base = [[draw.choice([*(f"x{draw.randrange(200)}" for _ in range(3)), *letters]) for _ in range(draw.choice([1, 2, 3, 4, 5, 8, 12, 17, 20, 25, 30, 40, 60, 100]))] for _ in range(60)]
    rows = []
    for i in range(n):
        words = list(draw.choice(base))
        for _ in range(draw.choice([0, 1, 1, 2])):
            words.insert(draw.randrange(len(words) + 1), draw.choice(letters))
        rows.append((i, " ".join(words) if draw.random() < 0.9 else " \t".join(words).upper()))
    return [*rows, (5000, ""), (5001, None), (5002, " \n"), (5003, "é É ſ K"), (5004, "é É ſ k")]


@pytest.mark.parametrize("rule", [nj.Rule(), nj.Rule(5, 80), nj.Rule(1, 50)])
def test_against_brute_force(spark, rule):
    rows = corpus(700, rule.words)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).repartition(6)
    out = nj.near_join(docs, rule=rule).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in out} == by_force(rows, rule)


def test_many_near_copies_in_small_blocks(spark, monkeypatch):
    draw = random.Random(9)
    base, rows = [f"w{i}" for i in range(70)], []
    for i in range(300):
        words = list(base)
        for _ in range(draw.randrange(5)):
            words[draw.randrange(70)] = f"v{draw.randrange(40)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(nj, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(nj.compare_bundles, "__defaults__", (2_000,))
    out = nj.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in out} == by_force(rows, nj.Rule())


def test_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    out = nj.query(spark, folder).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in out} == by_force(rows, nj.Rule())


def test_repeated_rows_null_keys_and_long_texts(spark):
    long_text = " ".join(f"w{i}" for i in range(60_000))
    rows = [(4, "a b c d e"), (4, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (None, "only here at all"), (9, long_text), (8, long_text + " end")]
    out = sorted(((r.doc_id, r.component_id, r.n_links) for r in nj.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert out == sorted([(4, 4, 3), (4, 4, 3), (None, 4, 3), (7, 4, 3), (None, None, 0), (9, 8, 1), (8, 8, 1)], key=repr)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a"), (2, "b")]])
def test_nothing_to_join(spark, rows):
    out = nj.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in out) == [(i, i, 0) for i, _ in rows]


def test_boundary_is_chosen_by_cost():
    rule = nj.Rule()
    assert nj.choose_boundary({5: 1000}, rule) > 5
    assert nj.choose_boundary({40: 1000}, rule) <= 40
    assert nj.choose_boundary({}, rule) == 1


@pytest.mark.parametrize("boundary", [1, 6, 14, 20])
def test_every_boundary_gives_the_same(spark, monkeypatch, boundary):
    rows = corpus(250, 21)
    monkeypatch.setattr(nj, "choose_boundary", lambda sizes, rule: boundary)
    out = nj.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in out} == by_force(rows, nj.Rule())


def test_components(spark):
    draw = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(draw.randrange(80), draw.randrange(80)) for _ in range(50)] + [(7, 7), (300, 200)]
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    out = {r.a: r.m for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    alone = {x for x in root if all(x not in (a, b) or a == b for a, b in pairs)}
    assert out == {x: m for x, m in root.items() if x not in alone}


def test_shingle_hashes_tell_sets_apart():
    texts = ["a b c d", "a  b\tc\nd", "A B C D", "a b c e", "ab c d e", "a b", "b a", ""]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    found, rows = shingle_sets(data, bounds, 4)
    own = [tuple(found[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
    assert own[0] == own[1] == own[2] and len(set(own)) == 6 and own[7] == ()
