import pytest
import test_near_join as near
from pyspark.sql import functions as F

import corpus_pipeline
from raritas.llm.near_join import Rule

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def test_stages_are_the_dealt_ones():
    assert list(STAGES) == ["language_id", "near_duplicates", "benchmark_decontamination", "source_mixing", "token_output"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def odd(spark, documents):
    """The documents with odd rows and with extra columns whose names clash with those the operators use."""
    more = [(90001, None), (90002, ""), (90003, "12 34 !"), (90004, "the and of to in is that it for on"), (90004, "the and of to in is that it for on"), (None, "the house of the old man in the town")]
    rows = spark.createDataFrame(more, "doc_id long, text string")
    all_rows = documents.unionByName(rows, allowMissingColumns=True)
    return all_rows.withColumns({c: F.lit(i) for i, c in enumerate(("score", "lang_pred", "node", "n", "key", "rate", "copy", "item", "gone", "row"))})


def test_language_id_rejects_only_texts_without_letters(spark, documents):
    docs = odd(spark, documents)
    out = STAGES["language_id"](spark, docs, FOLDER)
    assert out.columns == docs.columns
    assert docs.exceptAll(out).select("doc_id").collect() == [(90001,), (90002,), (90003,)] or {r[0] for r in docs.exceptAll(out).select("doc_id").collect()} == {90001, 90002, 90003}


def test_one_document_of_each_group_stays(spark, documents):
    docs = odd(spark, documents)
    out = STAGES["near_duplicates"](spark, docs, FOLDER)
    plain = [(r.doc_id, r.text) for r in documents.collect()]
    stay = {i for i, (_, component, _) in near.by_force(plain, Rule(5, 80)).items() if i == component}
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.where("doc_id < 90000").collect()) == sorted(stay)
    assert sorted((r.doc_id for r in out.where("doc_id >= 90000 OR doc_id IS NULL").collect()), key=str) == [90001, 90002, 90003, 90004, None]


def test_rows_that_share_a_doc_id_are_one_document(spark):
    one, two, three = ("the old man of the sea went out to fish", "a b c d e f g h i j", "k l m n o p q r s t")
    rows = [(2, one), (4, one), (4, two), (5, two), (6, two), (7, three), (7, two + " other"), (8, three), (9, "alone here"), (9, "and here too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = STAGES["near_duplicates"](spark, docs, FOLDER)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(2, one), (9, "alone here"), (9, "and here too")]


def test_leaks_go_and_clean_documents_stay(spark, documents):
    docs = odd(spark, documents)
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    out = STAGES["benchmark_decontamination"](spark, docs, FOLDER)
    holding = {r.doc_id for r in documents.collect() if any(" ".join(i.split()) in " ".join(r.text.split()) for i in items)}
    gone = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in out.select("doc_id").collect()}
    assert out.columns == docs.columns and holding <= gone and len(gone) <= len(holding) + 1


def test_mixing_and_output(spark, documents):
    docs = odd(spark, documents)
    mixed = STAGES["source_mixing"](spark, docs, FOLDER)
    assert mixed.columns == docs.columns and mixed.join(docs.select("doc_id"), "doc_id", "left_anti").where("doc_id IS NOT NULL").isEmpty()
    out = STAGES["token_output"](spark, mixed, FOLDER)
    assert out.count() == mixed.count()


def test_run_is_repeatable(spark):
    one, two = (corpus_pipeline.run(spark, FOLDER) for _ in range(2))
    assert one.count() > 100 and one.exceptAll(two).isEmpty()


def test_empty_documents(spark, documents):
    docs = documents.limit(0)
    for stage in STAGES.values():
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


def test_rows_without_a_doc_id_are_documents_of_their_own(spark):
    one, two, three = ("the old man of the sea went out to fish", "a b c d e f g h i j", "k l m n o p q r s t")
    rows = [(4, one), (None, one), (None, two), (None, two), (None, three), (None, "clean and linked with nothing at all"), (None, None), (6, three + " u v w x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = STAGES["near_duplicates"](spark, docs, FOLDER)
    wanted = [(4, one), (None, two), (None, three), (None, "clean and linked with nothing at all"), (None, None), rows[-1]]
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == sorted(wanted, key=str)
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    more = docs.unionByName(spark.createDataFrame([(None, item), (None, "so it goes " + item), (9, item)], "doc_id long, text string"))
    clean = STAGES["benchmark_decontamination"](spark, more, FOLDER)
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect()), key=str) == sorted(rows, key=str)
