"""Registered queries: each takes (spark, folder of the given tables) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raritas.catalog import sql
from raritas.catalog.tables import DOC3, NUM2, NUM3, TEXT2, TEXT3, TEXT4, TEXT_LONG, TEXT_SHORT, View
from raritas.catalog.workbook_bytes import as_workbooks
from raritas.functions.runtime import cut_lineage, ensure_checkpoint_dir
from raritas.operators import attributes, graph, ngram, rowrank
from raritas.operators.autoencoder import NetSpec, fit_autoencoder, input_statistics, product_features
from raritas.operators.evaluate import evaluate, stratified_folds
from raritas.operators.featuresets import feature_sets
from raritas.operators.flags import collate_long, long_flags, members
from raritas.operators.iforest import fit_iforest
from raritas.operators.loda import LodaModel, fit_loda
from raritas.operators.random_cuts import fit_random_cuts, random_cuts
from raritas.operators.sampling import train_sample
from raritas.operators.tune import FOREST_GRID, best, search_autoencoder, search_iforest
from raritas.plans.detect import detect
from raritas.plans.rank import rank_attributes, rank_rows
from raritas.plans.settings import PROFILES
from raritas.sources.tables import numeric_projection, read_table, spread, string_projection, with_row_id
from raritas.sources.workbooks import parse_workbooks

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BAND = 0.3
TOP = 0.1
SPLIT = 0.5
FIXED_ROUNDS = 10
MOST_ROUNDS = 40


def register(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def rounded(column: str, digits: int = 9) -> Column:
    return F.round(F.col(column), digits).alias(column)


# ---------------------------------------------------------------- n-grams


def _tokens(view: View, n_att: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return ngram.token_frequency(ngram.ngrams(view.read(spark, folder), view.key, list(view.attrs), 3, n_att))

    return query


def _outlier_tokens(view: View, n: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        tokens = ngram.outlier_tokens(view.read(spark, folder), list(view.attrs), n, BAND)
        return tokens.select("set_id", "token", "frequency", rounded("average", 6))

    return query


def _detect(view: View, n: int, compat: bool = False) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return ngram.ngram_detect(view.read_spread(spark, folder), view.key, list(view.attrs), n, BAND, compat)

    return query


def _rank(view: View, n: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        scores = ngram.ngram_detect(view.read_spread(spark, folder), view.key, list(view.attrs), n, BAND)
        return rowrank.cutoff(ngram.with_final_score(scores).select(view.key, "final_score"), "final_score", TOP)

    return query


def _attr_score(view: View, n: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return ngram.attribute_hits(view.read_spread(spark, folder), list(view.attrs), n, TOP)

    return query


def _attr_max(view: View, n: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return ngram.attribute_maximum(view.read(spark, folder), list(view.attrs), n)

    return query


def _attr_normalized(view: View, n: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        scores = ngram.attribute_normalized(view.read_spread(spark, folder), list(view.attrs), n, TOP)
        return scores.select("attr", "name", "score", "maximum", rounded("normalized_score"))

    return query


def _attr_summary(view: View, n: int, function: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        scores = ngram.attribute_normalized(view.read_spread(spark, folder), list(view.attrs), n, TOP)
        summary = attributes.table_score(scores, function, "normalized_score")
        return summary.select("function", rounded("table_score"))

    return query


for _n_att, _name in ((1, "single"), (2, "pair"), (3, "triplet")):
    register(f"ngram_tokens_{_name}", _tokens(TEXT3, _n_att), sql.ngram_tokens(TEXT3, 3, _n_att))
register("ngram_outlier_tokens", _outlier_tokens(TEXT3, 3), sql.ngram_outlier_tokens(TEXT3, 3, BAND))
register("ngram_detect", _detect(TEXT3, 3), sql.ngram_scores(TEXT3, 3, BAND))
register("ngram_detect_bigram", _detect(TEXT3, 2), sql.ngram_scores(TEXT3, 2, BAND))
register("ngram_detect_compat", _detect(TEXT4, 2, True), sql.ngram_scores(TEXT4, 2, BAND, True))
register("ngram_detect_two_attributes", _detect(TEXT2, 3), sql.ngram_scores(TEXT2, 3, BAND))
register("ngram_detect_short_text", _detect(TEXT_SHORT, 3), sql.ngram_scores(TEXT_SHORT, 3, BAND))
register("ngram_detect_long_text", _detect(TEXT_LONG, 3), sql.ngram_scores(TEXT_LONG, 3, BAND))
register("ngram_rank_rows", _rank(TEXT3, 3), sql.ngram_ranked(TEXT3, 3, BAND, TOP))
register("ngram_attr_score", _attr_score(TEXT3, 3), sql.ngram_attr_score(TEXT3, 3, TOP))
register("ngram_attr_score_long_text", _attr_score(TEXT_LONG, 3), sql.ngram_attr_score(TEXT_LONG, 3, TOP))
register("ngram_attr_max", _attr_max(TEXT_SHORT, 3), sql.ngram_attr_max(TEXT_SHORT, 3))
register("ngram_attr_max_three", _attr_max(TEXT3, 3), sql.ngram_attr_max(TEXT3, 3))
register("ngram_attr_normalized", _attr_normalized(TEXT3, 3), sql.ngram_attr_normalized(TEXT3, 3, TOP))
for _function in ("mean", "median"):
    _average = "avg" if _function == "mean" else "median"
    register(
        f"ngram_attr_{_function}",
        _attr_summary(TEXT3, 3, _function),
        f"SELECT '{_function}' AS function, round({_average}(normalized_score), 9) AS table_score "
        f"FROM ({sql.ngram_attr_normalized(TEXT3, 3, TOP)})",
    )


# ---------------------------------------------------------------- LODA


def fitted_loda(spark: SparkSession, folder: str, view: View) -> tuple[DataFrame, LodaModel]:
    table = view.read(spark, folder)
    return table, fit_loda(train_sample(table, view.key, SPLIT), list(view.attrs))


def flagged_loda(spark: SparkSession, folder: str, view: View) -> DataFrame:
    table, model = fitted_loda(spark, folder, view)
    return model.flag(table)


def _loda_scores(view: View) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        table, model = fitted_loda(spark, folder, view)
        return model.scores(table, view.key).select(view.key, "attrs", rounded("score", 6), "is_outlier")

    return query


def _loda_flags(view: View, arity: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        flags = long_flags(flagged_loda(spark, folder, view), view.key, "loda")
        return flags.where(F.col("arity") == arity).select(view.key, F.array_join("attrs", "-").alias("attrs"))

    return query


def as_text(flagged: DataFrame, key: str, method: str = "loda") -> DataFrame:
    nested = [F.array_join(F.transform(c, lambda a: F.array_join(a, "-")), ",").alias(c) for c in (f"pairs_{method}", f"triplets_{method}")]
    return flagged.select(key, F.array_join(f"single_{method}", ",").alias(f"single_{method}"), *nested)


def _loda_wide(view: View) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return as_text(flagged_loda(spark, folder, view), view.key)

    return query


def _loda_collated(view: View) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        flagged = flagged_loda(spark, folder, view)
        wide = collate_long(flagged.select(view.key), long_flags(flagged, view.key, "loda"), view.key, "loda")
        return as_text(wide, view.key)

    return query


def _train_sample(view: View) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return train_sample(view.read(spark, folder), view.key, SPLIT).select(view.key)

    return query


register(
    "train_sample",
    _train_sample(NUM3),
    f"WITH base AS ({NUM3.base}), {sql.sample_cte(SPLIT)} SELECT id AS event_id FROM smp",
)
for _label, _view in (("", NUM3), ("_equal_bins", NUM2), ("_long_tail", DOC3)):
    register(f"loda_scores{_label}", _loda_scores(_view), sql.loda_scores(_view))
for _arity, _name in ((1, "single"), (2, "pair"), (3, "triplet")):
    register(f"loda_flags_{_name}", _loda_flags(NUM3, _arity), sql.loda_flags(NUM3, _arity))
register("loda_flags_wide", _loda_wide(NUM3), sql.loda_wide(NUM3))
register("loda_flags_collated", _loda_collated(NUM3), sql.loda_wide(NUM3))


# ---------------------------------------------------------------- ranking rows and attributes


def _count(view: View, compat: bool = False) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rowrank.count_anomalies(flagged_loda(spark, folder, view), view.key, list(view.attrs), "loda", compat)

    return query


def _participation(view: View) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        cells = rowrank.flagged_cells(flagged_loda(spark, folder, view), view.key, list(view.attrs), "loda")
        return rowrank.value_participation(cells)

    return query


def _cutoff(view: View) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rowrank.cutoff(_count(view)(spark, folder), "Ranking_count", TOP)

    return query


def _share(view: View) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        counted = rowrank.cutoff_share(_count(view)(spark, folder), "Ranking_count", TOP)
        return counted.select("selected", "rows", rounded("share"))

    return query


def _attribute_scores(view: View) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        scores = attributes.attribute_score(flagged_loda(spark, folder, view), list(view.attrs), "loda")
        return scores.select("attr", "name", rounded("score"))

    return query


def _attribute_summary(view: View, function: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        scores = attributes.attribute_score(flagged_loda(spark, folder, view), list(view.attrs), "loda")
        return attributes.table_score(scores, function).select("function", rounded("table_score"))

    return query


register("rank_value_participation", _participation(NUM3), sql.value_participation(NUM3))
register("rank_count", _count(NUM3), sql.rank_count(NUM3))
register("rank_count_compat", _count(NUM3, True), sql.rank_count(NUM3, True))
register("rank_count_long_tail", _count(DOC3), sql.rank_count(DOC3))
register("rank_cutoff", _cutoff(NUM3), sql.rank_cutoff(NUM3, TOP))
register("rank_cutoff_share", _share(NUM3), sql.rank_share(NUM3, TOP))
register("attribute_score", _attribute_scores(NUM3), sql.attribute_scores(NUM3))
for _function in ("mean", "median"):
    register(f"attribute_score_{_function}", _attribute_summary(NUM3, _function), sql.attribute_summary(NUM3, _function))


# ---------------------------------------------------------------- graph


def _graph(spark: SparkSession, folder: str, view: View) -> tuple[DataFrame, DataFrame, DataFrame]:
    flagged = flagged_loda(spark, folder, view)
    attrs = list(view.attrs)
    return flagged, graph.graph_nodes(flagged, view.key, attrs, "loda"), graph.graph_edges(flagged, attrs, "loda")


def _nodes(view: View) -> Query:
    return lambda spark, folder: _graph(spark, folder, view)[1]


def _edges(view: View) -> Query:
    return lambda spark, folder: _graph(spark, folder, view)[2]


def _pagerank(view: View, rounds: int | None, positions: bool = False) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        _, nodes, edges = _graph(spark, folder, view)
        ranks = graph.pagerank(nodes, edges, rounds=rounds).select("node", rounded("rank"))
        return graph.rank_positions(ranks) if positions else ranks

    return query


def _pagerank_options(view: View, directed: bool, weighted: bool, given: tuple[str, ...]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        _, nodes, edges = _graph(spark, folder, view)
        nodes = cut_lineage(nodes)
        vectors = {name: nodes.select("node", F.expr(sql.NODE_WEIGHTS[name]).alias("weight")) for name in given}
        edges = edges.withColumn("w", F.expr(sql.EDGE_WEIGHT))
        ranks = graph.pagerank(nodes, edges, rounds=FIXED_ROUNDS, directed=directed, weight="w" if weighted else None, **vectors)
        return ranks.select("node", rounded("rank"))

    return query


def _row_score(view: View) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        flagged, nodes, _ = _graph(spark, folder, view)
        return graph.pagerank_score(flagged, view.key, list(view.attrs), nodes)

    return query


register("graph_nodes", _nodes(NUM3), sql.graph_nodes(NUM3))
register("graph_edges", _edges(NUM3), sql.graph_edges(NUM3))
register("pagerank_10_rounds", _pagerank(NUM3, FIXED_ROUNDS), sql.pagerank_fixed(NUM3, FIXED_ROUNDS))
register("pagerank_converged", _pagerank(NUM3, None), sql.pagerank_converged(NUM3, MOST_ROUNDS))
register("pagerank_top", _pagerank(NUM3, None, True), sql.pagerank_positions(NUM3, MOST_ROUNDS))
for _name, _options in {
    "personalized": (False, False, ("personalization",)),
    "started": (False, False, ("nstart",)),
    "weighted": (False, True, ()),
    "directed": (True, True, ("personalization", "dangling", "nstart")),
}.items():
    register(f"pagerank_{_name}", _pagerank_options(NUM3, *_options), sql.pagerank_options(NUM3, FIXED_ROUNDS, *_options))
register("pagerank_row_score", _row_score(NUM3), sql.pagerank_row_score(NUM3))


# ---------------------------------------------------------------- sources and projections


def _numeric(table: str, key: str) -> Query:
    return lambda spark, folder: numeric_projection(spark.read.parquet(f"{folder}/{table}.parquet"), key)


def _strings(table: str, key: str) -> Query:
    return lambda spark, folder: string_projection(spark.read.parquet(f"{folder}/{table}.parquet"), key)


def _csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Write the customers as CSV to the shared folder, then read them back with inferred types."""
    path = f"{ensure_checkpoint_dir(spark)}/scan-{uuid.uuid4().hex}.csv"
    spark.read.parquet(f"{folder}/customer.parquet").write.option("header", True).csv(path)
    return read_table(spark, path)


def _workbook_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Pack the customers into XLSX workbooks and read the rows back out of them."""
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    return parse_workbooks(as_workbooks(customers), customers.schema)


def _row_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Line items have no key of one column: number them in the order of the file."""
    return with_row_id(spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_linenumber"))


register(
    "numeric_projection",
    _numeric("customer", "c_custkey"),
    "SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer",
)
register("string_projection", _strings("customer", "c_custkey"), "SELECT c_custkey, c_name, c_mktsegment FROM customer")
register("csv_scan", _csv_scan, "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
register("workbook_scan", _workbook_scan, "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
register(
    "row_numbers",
    _row_numbers,
    "SELECT row_number() OVER () - 1 AS row_id, l_orderkey, l_linenumber FROM lineitem",
)


# ---------------------------------------------------------------- random cuts and product features

ITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ITEM_KEYS = ["l_orderkey", "l_linenumber"]


def _random_cuts(spark: SparkSession, folder: str) -> DataFrame:
    # Spread and written once; fitting and scoring pass over it several times.
    items = cut_lineage(spread(spark.read.parquet(f"{folder}/lineitem.parquet").select(*ITEM_KEYS, *ITEM), "l_orderkey"))
    model = fit_random_cuts(items, ITEM)
    return model.scores(items).select(*ITEM_KEYS, rounded("score", 6), "is_outlier")


def _products(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    pairs = product_features(items, ITEM_KEYS + ITEM, ITEM, 2)
    names = [c for c in pairs.columns if c.startswith("x_")]
    triplets = product_features(pairs, ITEM_KEYS + names, ITEM, 3)
    return triplets.select(*ITEM_KEYS, *[F.round(c, 6).alias(c) for c in triplets.columns if c.startswith("x_")])


register("loda_random_cuts", _random_cuts, sql.random_cuts("lineitem", ITEM_KEYS, ITEM, random_cuts(len(ITEM))))
register("product_features", _products, sql.product_features("lineitem", ITEM_KEYS, ITEM))


# ---------------------------------------------------------------- labels


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled documents with ``truth`` 1 for those of low quality."""
    marks = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("truth"))
    return DOC3.read(spark, folder).join(marks, "doc_id")


def _evaluate(spark: SparkSession, folder: str) -> DataFrame:
    flagged = flagged_loda(spark, folder, DOC3)
    judged = flagged.select("doc_id", (F.size(members("loda")) > 0).cast("int").alias("prediction"))
    metrics = evaluate(judged.join(labelled(spark, folder).select("doc_id", "truth"), "doc_id"), "truth", "prediction")
    return metrics.select("tp", "tn", "fp", "fn", rounded("accuracy"), rounded("precision"), rounded("recall"))


def _folds(spark: SparkSession, folder: str) -> DataFrame:
    return stratified_folds(labelled(spark, folder).select("doc_id", "truth"), "doc_id", "truth", 10, 3)


register("evaluate_flags", _evaluate, sql.evaluate_flags(DOC3))
register("stratified_folds", _folds, sql.stratified_folds(10, 3))


# ---------------------------------------------------------------- trained detectors

# Least number of parts that the sample is trained on side by side, the rows of one at most (about: dealt by hash), and the labelled rows that the search of networks fits weights on.
SHARDS = 8
SHARD_ROWS = 50_000
FIT_ROWS = 400
FEW_TREES = 10
# A smaller search of forests, and the labelled rows in SQL.
FEW_TREE_GRID, FEW_SPLITS, FEW_REPEATS = (5, 10, 20), 5, 2
LABELLED_SQL = "SELECT doc_id AS id, 1 - quality AS truth FROM labels"
# Share of outliers, and digits to which scores are compared with their cut where SQL does the same.
SHARE = 0.1
COMPARED_DIGITS = 9
# Exact steps, each over one of so many parts of the sample, of networks small enough for SQL.
FEW_STEPS, FEW_BATCHES = 4, 2
SMALL_NET = NetSpec((4, 2, 4), activation="tanh", learning_rate=0.05)


def shards_of(rows: int) -> int:
    """Parts for the sample of a table of so many rows."""
    return max(SHARDS, -(-int(SPLIT * rows) // SHARD_ROWS))


def _shards(spark: SparkSession, folder: str, method: str) -> int:
    return shards_of(NUM3.read(spark, folder).count()) if method == "AE" else SHARDS


def _detected(method: str, profile: str = "small", compat: bool = False) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        view = NUM3.read_spread(spark, folder)
        flagged = detect(view, NUM3.key, method, SPLIT, profile=profile, shards=_shards(spark, folder, method), compat=compat)
        return as_text(flagged, NUM3.key, method)

    return query


def _ranked(method: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        shards = _shards(spark, folder, method)
        flagged = cut_lineage(detect(NUM3.read_spread(spark, folder), NUM3.key, method, SPLIT, profile="small", shards=shards))
        return rank_rows(flagged, NUM3.key, method, 0, TOP)[0]

    return query


def _inputs(spark: SparkSession, folder: str) -> DataFrame:
    """What the networks of each feature set are standardised by, from the training sample."""
    sets = feature_sets(len(NUM3.attrs))
    sample = train_sample(NUM3.read(spark, folder), NUM3.key, SPLIT)
    mean, scale = input_statistics(sample, list(NUM3.attrs), sets)
    lines = [(s.label, round(m, 6), round(d, 6)) for s, m, d in zip(sets, mean, scale)]
    return spark.createDataFrame(lines, "attrs string, mean double, deviation double")


def _forest_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A forest of few trees over the whole table, few enough to be grown and walked in SQL as well."""
    table = NUM3.read_spread(spark, folder)
    sample = train_sample(table, NUM3.key, SPLIT)
    model = fit_iforest(sample, NUM3.key, list(NUM3.attrs), feature_sets(len(NUM3.attrs)), FEW_TREES)
    return model.scores(table, NUM3.key).select(NUM3.key, "attrs", rounded("score", 6), "is_outlier")


def _forest_share(spark: SparkSession, folder: str) -> DataFrame:
    """The same few trees, with a share of the sample as outliers instead of a fixed score."""
    table = NUM3.read_spread(spark, folder)
    sample = train_sample(table, NUM3.key, SPLIT)
    sets = feature_sets(len(NUM3.attrs))
    model = fit_iforest(sample, NUM3.key, list(NUM3.attrs), sets, FEW_TREES, contamination=SHARE, digits=COMPARED_DIGITS)
    return model.scores(table, NUM3.key).select(NUM3.key, "attrs", rounded("score", 6), "is_outlier")


def _net_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Networks after a few exact steps over the whole sample, few enough to be taken in SQL as well."""
    table = NUM3.read_spread(spark, folder)
    sample = train_sample(table, NUM3.key, SPLIT)
    model = fit_autoencoder(
        sample, NUM3.key, list(NUM3.attrs), SMALL_NET, SHARE, steps=FEW_STEPS, batches=FEW_BATCHES, digits=COMPARED_DIGITS
    )
    return model.scores(table, NUM3.key).select(NUM3.key, "attrs", rounded("score", 6), "is_outlier")


def _search_forest(spark: SparkSession, folder: str) -> DataFrame:
    return best(search_iforest(labelled(spark, folder), "doc_id", list(DOC3.attrs), "truth"))


def _search_few_trees(spark: SparkSession, folder: str) -> DataFrame:
    """All candidates of a smaller search over the same rows."""
    return search_iforest(labelled(spark, folder), "doc_id", list(DOC3.attrs), "truth", FEW_TREE_GRID, FEW_SPLITS, FEW_REPEATS)


def _search_net(spark: SparkSession, folder: str) -> DataFrame:
    return best(search_autoencoder(labelled(spark, folder), "doc_id", list(DOC3.attrs), "truth", fit_rows=FIT_ROWS))


register("iforest_scores_few_trees", _forest_scores, sql.iforest_scores(NUM3, FEW_TREES))
register("iforest_scores_share", _forest_share, sql.iforest_scores(NUM3, FEW_TREES, share=SHARE))
register("iforest_flags", _detected("IF"), sql.iforest_wide(NUM3, PROFILES["small"].estimators))
register("iforest_flags_big", _detected("IF", "big"), sql.iforest_wide(NUM3, PROFILES["big"].estimators))
register("iforest_flags_compat", _detected("IF", compat=True), sql.iforest_wide_compat(NUM3, PROFILES["small"].estimators))
register("iforest_rank_rows", _ranked("IF"), sql.iforest_rank_cutoff(NUM3, PROFILES["small"].estimators, TOP))
register("autoencoder_flags", _detected("AE"))
register("autoencoder_flags_big", _detected("AE", "big"))
register("autoencoder_scores_few_steps", _net_steps, sql.autoencoder_steps(NUM3, SMALL_NET, FEW_STEPS, FEW_BATCHES, SHARE))
register("autoencoder_inputs", _inputs, sql.autoencoder_inputs(NUM3))
register("autoencoder_rank_rows", _ranked("AE"))
register(
    "grid_search_iforest_few_trees",
    _search_few_trees,
    sql.forest_search(DOC3, LABELLED_SQL, FEW_TREE_GRID, FEW_SPLITS, FEW_REPEATS),
)
register("grid_search_iforest", _search_forest, sql.forest_search(DOC3, LABELLED_SQL, FOREST_GRID, 10, 10, winner=True))
register("grid_search_autoencoder", _search_net)


# ---------------------------------------------------------------- the public functions, end to end

# Attributes above 1 - 0.95 of the score are reported: a share that the flags and n-grams of these tables reach.
WIDE_TOP = 0.95


def _found(view: View, method: str) -> Callable[[SparkSession, str], DataFrame]:
    def found(spark: SparkSession, folder: str) -> DataFrame:
        return cut_lineage(detect(view.read_spread(spark, folder), view.key, method, SPLIT, th=BAND))

    return found


def _public_rows(view: View, method: str, ind: int = 0) -> Query:
    return lambda spark, folder: rank_rows(_found(view, method)(spark, folder), view.key, method, ind, TOP)[0]


def _public_share(view: View, method: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        summary = rank_rows(_found(view, method)(spark, folder), view.key, method, 0, TOP)[1]
        return summary.select("selected", "rows", rounded("share"))

    return query


def _public_attributes(view: View, method: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        data = view.read_spread(spark, folder) if method == "ngram" else _found(view, method)(spark, folder)
        above, _ = rank_attributes(data, view.key, method, WIDE_TOP)
        score = "normalized_score" if method == "ngram" else "score"
        return above.withColumn(score, F.round(score, 9))

    return query


def _public_table_score(view: View, method: str, function: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        _, score = rank_attributes(_found(view, method)(spark, folder), view.key, method, WIDE_TOP, function)
        return score.select("function", rounded("table_score"))

    return query


register("detect_loda", lambda spark, folder: as_text(_found(NUM3, "loda")(spark, folder), NUM3.key), sql.loda_wide(NUM3))
register(
    "detect_ngram",
    lambda spark, folder: _found(TEXT3, "ngram")(spark, folder).drop(*TEXT3.attrs),
    sql.ngram_scores(TEXT3, 3, BAND),
)
register("rank_rows_loda", _public_rows(NUM3, "loda"), sql.rank_cutoff(NUM3, TOP))
register("rank_rows_loda_share", _public_share(NUM3, "loda"), sql.rank_share(NUM3, TOP))
register("rank_rows_loda_graph", _public_rows(NUM3, "loda", 1), sql.graph_ranked(NUM3, TOP))
register("rank_rows_ngram", _public_rows(TEXT3, "ngram"), sql.ngram_ranked(TEXT3, 3, BAND, TOP))
register("rank_attributes_loda", _public_attributes(NUM3, "loda"), sql.attributes_above(NUM3, WIDE_TOP))
register(
    "rank_attributes_ngram", _public_attributes(TEXT3, "ngram"), sql.ngram_attributes_above(TEXT3, 3, WIDE_TOP, WIDE_TOP)
)
for _function in ("mean", "median"):
    register(f"rank_attributes_{_function}", _public_table_score(NUM3, "loda", _function), sql.attribute_summary(NUM3, _function))
