import hashlib

import pytest
import regex
from pyspark.sql import functions as F

from raritas.llm import spot_signatures as spot


def signatures(text):
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    anchors, found = set(spot.ANCHORS), set()
    for i, word in enumerate(words):
        chain = [w for w in words[i + 1 : i + 1 + spot.REACH] if w not in anchors][: spot.CHAIN]
        if word in anchors and chain:
            found.add(":".join([word, *chain]))
    return found or ({" ".join(words)} if words else set())


def jaccard(a, b):
    if not a and not b:
        return 1.0
    return 0.0 if min(len(a), len(b)) < max(len(a), len(b)) * spot.PRUNE else len(a & b) / len(a | b)


def partition(size):
    return next(k for k in range(99) if size < 10 ** (k + 1)) if size else -2


def digest(found):
    return hashlib.md5(",".join(sorted(found, key=lambda s: s.encode())).encode()).hexdigest()


def by_force(rows):
    """Rows with distinct keys; the null key is smallest."""
    ordered = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    out = {}
    for place, (key, text) in enumerate(ordered):
        text, after = text or "", ordered[(place + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, other, following = signatures(text), signatures(edited), signatures(after)
        out[key] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(own), digest(other), jaccard(own, other), jaccard(own, following), len(own), partition(len(own)))
    return out


def rows_of(n):
    words = "the cat of a dog und der hund läuft in die stadt la maison de pierre el perro con 7 casas 中文 😀 x".split()
    rows = [(i * 11 % 1009, " ".join(words[(i * 5 + k * (1 + i % 7)) % len(words)] for k in range(i % 40))) for i in range(n)]
    return rows + [(5000, None), (5001, ""), (5002, "..."), (5003, "ab"), (None, "the only one without a key"), (5004, "of the cat " * 30_000)]


@pytest.mark.parametrize("n", [0, 300])
def test_against_brute_force(spark, n):
    rows = rows_of(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1))
    out = spot.compare_edited(docs.repartition(7)).collect()
    assert {r[0]: tuple(r)[1:] for r in out} == by_force(rows) and len(out) == len(rows)


def test_one_row_and_none(spark):
    one = [(3, "the old house in the town")]
    assert {r[0]: tuple(r)[1:] for r in spot.compare_edited(spark.createDataFrame(one, "doc_id long, text string")).collect()} == by_force(one)
    assert spot.compare_edited(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (1, "the cat sat"), (1, "the dog ran"), (2, "")], "doc_id long, text string")
    out = spot.compare_edited(docs).collect()
    assert len(out) == 4 and len({r.fingerprint for r in out if r.n_chars and r.n_signatures}) == 2


def test_pruning_loses_nothing(spark):
    sets = [[f"s{i}" for i in range(a, b)] for a in (0, 3) for b in (0, 4, 10, 12, 13, 40)]
    pairs = [(a, b) for a in sets for b in sets]
    whole = [1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b)) for a, b in pairs]
    table = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for threshold in (0.1, 0.5, 0.8):
        found = [r[0] for r in table.select(spot.likeness(F.col("a"), F.col("b"), threshold)).collect()]
        assert all(f == w if w >= threshold else f in (0.0, w) for f, w in zip(found, whole, strict=True))


def test_runs_without_python(spark):
    plan = spot.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
