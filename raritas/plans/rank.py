"""From flags or n-gram scores to ranked rows or scored attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from raritas.functions.runtime import cut_lineage
from raritas.operators.attributes import attribute_score, attributes_above, check_function, table_score
from raritas.operators.graph import graph_nodes, pagerank_score
from raritas.operators.ngram import ROW_COLUMNS, attribute_normalized, with_final_score
from raritas.operators.rowrank import count_anomalies, cutoff, cutoff_share
from raritas.plans.settings import check_method
from raritas.sources.tables import string_attributes


def rank_rows(
    detected: DataFrame, key: str, method: str = "loda", ind: int = 0, th: float = 0.1, compat: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Most anomalous rows of a detector's output: (rows above the cutoff with their score, one-row summary).

    ``ind`` 0 counts anomalies, 1 uses the graph of co-anomalous values; n-gram scores are simply added up.
    The summary has the number of selected rows, of all rows, and the share.
    """
    check_method(method)
    if method == "ngram":
        scores = with_final_score(detected.select(key, *ROW_COLUMNS.values())).select(key, "final_score")
        name = "final_score"
    else:
        attrs = attributes_of(detected, key, method)
        if ind == 0:
            scores, name = count_anomalies(detected, key, attrs, method, compat), "Ranking_count"
        elif ind == 1:
            nodes = graph_nodes(detected, key, attrs, method)
            scores, name = pagerank_score(detected, key, attrs, nodes), "pagerank_score"
        else:
            raise ValueError("ind is 0 (count of anomalies) or 1 (PageRank)")
    scores = cut_lineage(scores)
    return cutoff(scores, name, th), cutoff_share(scores, name, th)


def rank_attributes(
    data: DataFrame, key: str, method: str = "loda", th: float = 0.1, func: str = "mean", n: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Attributes scoring above ``1 - th``, and the score of the table.

    For numeric detectors ``data`` is the detector's output, for 'ngram' the table itself, whose string attributes
    are scored with n-grams of length ``n`` and the band ``th``.
    """
    check_method(method)
    check_function(func)
    if method == "ngram":
        scores, name = attribute_normalized(data, string_attributes(data, key), n, th), "normalized_score"
    else:
        scores, name = attribute_score(data, attributes_of(data, key, method), method), "score"
    scores = cut_lineage(scores)
    return attributes_above(scores, th, name), table_score(scores, func, name)


def attributes_of(detected: DataFrame, key: str, method: str) -> list[str]:
    """The attributes a detector worked on: everything but the key and the flag columns."""
    flags = {f"single_{method}", f"pairs_{method}", f"triplets_{method}"}
    return [c for c in detected.columns if c != key and c not in flags]
