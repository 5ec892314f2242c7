import pytest
from pyspark.sql import functions as F

from raritas.llm import langid

FOLDER = "/root/testdata/sf0.01"
WORDS = {
    "en": "the of and that with this from have not are",
    "de": "der die und nicht mit auch sich werden ist ein",
    "nl": "de het een niet van zijn voor met aan ook",
    "fr": "le la les des est dans pour une que avec",
    "xx": "kwa mna tiki wolo baku zuri hapa kule sana pia",
}


def made(spark, n=40):
    rows = []
    for place, (lang, words) in enumerate(WORDS.items()):
        words = words.split()
        for i in range(n):
            rows.append((place * 1000 + i, " ".join(words[(i * 7 + k * (1 + i % 5)) % len(words)] for k in range(12)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = langid.query(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert rows.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] >= 0.97


def test_languages_of_several_families(spark):
    docs = made(spark)
    model = langid.fit_languages(docs)
    assert model.families == {"germanic": ["de", "en", "nl"], "romance": ["fr"], "xx": ["xx"]}
    named = langid.identify_languages(docs, model)
    assert named.where("lang_pred = lang").count() >= 0.98 * docs.count()
    assert named.where("score < 0 OR score > 1").count() == 0


def test_only_the_text_counts(spark):
    docs = made(spark)
    model = langid.fit_languages(docs)
    one = langid.identify_languages(docs, model).select("text", "lang_pred", "score")
    other = langid.identify_languages(docs.withColumns({"doc_id": -F.col("doc_id"), "lang": F.lit("zz")}), model).select("text", "lang_pred", "score")
    assert one.exceptAll(other).isEmpty()


def test_odd_rows(spark):
    model = langid.fit_languages(made(spark))
    long_text = "the of and that with " * 200_000
    rows = [(1, None, "a", 1.0), (2, "", "b", 1.0), (3, "123 !?", "c", 1.0), (4, long_text, "d", 1.0), (5, "the and", None, None), (5, "the and", None, None), (None, "le la les", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double")
    out = langid.identify_languages(docs, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    found = [(r.doc_id, r.lang_pred, r.score) for r in out.drop("text").collect()]
    assert [f for f in found if f[0] in (1, 2, 3)] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert len({f for f in found if f[0] == 5}) == 1 and [f for f in found if f[0] == 5][0][1] == "en"
    assert [f[1] for f in found if f[0] == 4] == ["en"] and [f[1] for f in found if f[0] is None] == ["fr"]


@pytest.mark.parametrize("rows", [[], [(1, None, "en")], [(1, "abc", None)]])
def test_nothing_to_learn(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit_languages(docs) is None
    assert [r.lang_pred for r in langid.identify_languages(docs, None).collect()] == ["und"] * len(rows)


def test_one_language(spark):
    docs = made(spark).where("lang = 'en'")
    out = langid.identify_languages(docs, langid.fit_languages(docs))
    assert {r.lang_pred for r in out.collect()} == {"en"}


def plain_prediction(model, text):
    """Language and score by plain loops over the n-grams of one text."""
    import math

    def letter(b):
        return b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20

    raw = [letter(b) for b in text.lower().encode()]
    grams = []
    for n in langid.GRAMS:
        for at in range(len(raw) - n + 1):
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for b in raw[at : at + n]:
                h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
            grams.append((h ^ h >> 15) & langid.DIMENSIONS - 1)

    def margin(task):
        w = model.weights[task]
        return sum(w[g] for g in grams) * langid.SCALE / max(1, len(grams)) + w[-1]

    def logistic(x):
        return 1 / (1 + math.exp(-langid.SLOPE * x))

    score, family = 1.0, next(iter(model.families))
    if len(model.families) > 1:
        margins = {f: margin(("family", f)) for f in model.families}
        family = max(margins, key=margins.get)
        score *= logistic(margins[family])
    langs = model.families[family]
    wins, sums, sure = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0), dict.fromkeys(langs, 0.0)
    for i, a in enumerate(langs):
        for b in langs[i + 1 :]:
            m = margin(("pair", a, b))
            wins[a if m >= 0 else b] += 1
            for lang, x in ((a, m), (b, -m)):
                sums[lang] += x
                sure[lang] += logistic(x)
    best = max(langs, key=lambda x: (wins[x], sums[x]))
    return best, score * (sure[best] / (len(langs) - 1) if len(langs) > 1 else 1.0)


def test_predictions_equal_plain_loops():
    import random

    import numpy as np
    import pyarrow as pa

    rng, draw = np.random.default_rng(3), random.Random(3)
    for families in ({"a": ["de", "en", "nl"], "b": ["fr"], "c": ["xx", "yy"]}, {"a": ["de", "en", "nl", "sv"]}, {"a": ["de"]}):
        model = langid.LanguageModel(families)
        model.weights = {task: rng.normal(size=langid.DIMENSIONS + 1) for task in model.tasks()}
        texts = ["", "a", "é", "The WORDS, 12 of them.", "Ünïcödé ßtraße"] + ["".join(draw.choice("abcdeÉé ,.1ß中") for _ in range(draw.randrange(80))) for _ in range(60)]
        lang, score = model.predict(*langid.text_bytes(langid.lowered(pa.array(texts))))
        for text, found, sure in zip(texts, lang, score):
            wanted, likely = plain_prediction(model, text)
            assert found == wanted and abs(sure - likely) < 2e-6, text
