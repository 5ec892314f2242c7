import numpy as np
import pytest

from raritas.functions import runtime
from raritas.operators import graph

NODES = [0.0, 1.0, 2.0, 3.0, 4.0, 9.0]
EDGES = [(0.0, 1.0), (0.0, 2.0), (0.0, 3.0), (1.0, 2.0), (3.0, 3.0), (0.0, 4.0), (0.0, 1.0)]


def dense(nodes, arcs, rounds, alpha=0.85, p=None, start=None, hang=None):
    """Power iteration on a dense matrix."""
    n = len(nodes)
    at = {v: i for i, v in enumerate(nodes)}
    w = np.zeros((n, n))
    for s, d, x in arcs:
        w[at[s], at[d]] = x
    out = w.sum(axis=1)
    p = np.full(n, 1 / n) if p is None else np.array(p) / sum(p)
    hang = p if hang is None else np.array(hang) / sum(hang)
    x = np.full(n, 1 / n) if start is None else np.array(start) / sum(start)
    walk = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    for _ in range(rounds):
        x = alpha * (x @ walk) + alpha * x[out == 0].sum() * hang + (1 - alpha) * p
    return dict(zip(nodes, x))


def mirrored(edges):
    return {(a, b, 1.0) for a, b in edges} | {(b, a, 1.0) for a, b in edges}


def frames(spark, edges=EDGES):
    return (
        spark.createDataFrame([(v,) for v in NODES], "node double"),
        spark.createDataFrame(edges, "src double, dst double"),
    )


def vector(spark, values):
    return spark.createDataFrame(list(zip(NODES, map(float, values))), "node double, weight double")


def ranks(table):
    return {r["node"]: r["rank"] for r in table.collect()}


def test_isolated_node_self_loop_and_duplicates(spark):
    nodes, edges = frames(spark)
    found = ranks(graph.pagerank(nodes, edges, rounds=9))
    assert found == pytest.approx(dense(NODES, mirrored(EDGES), 9))
    assert sum(found.values()) == pytest.approx(1.0)


def test_split_nodes_and_shuffled_vectors(spark, monkeypatch):
    monkeypatch.setattr(graph, "ARCS_PER_PIECE", 1)
    nodes, edges = frames(spark)
    wanted = dense(NODES, mirrored(EDGES), 5)
    assert ranks(graph.pagerank(nodes, edges, rounds=5)) == pytest.approx(wanted)
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 3)
    assert ranks(graph.pagerank(nodes, edges, rounds=5)) == pytest.approx(wanted)


def test_directed_weighted_with_vectors(spark):
    arcs = [(0.0, 1.0, 2.0), (0.0, 2.0, 1.0), (1.0, 0.0, 1.0), (2.0, 3.0, 0.5)]
    p, start, hang = [1, 2, 3, 4, 5, 6], [6, 5, 4, 3, 2, 1], [1, 1, 1, 1, 1, 5]
    nodes = frames(spark)[0]
    edges = spark.createDataFrame(arcs, "src double, dst double, w double")
    found = graph.pagerank(
        nodes, edges, directed=True, weight="w", rounds=6,
        personalization=vector(spark, p), nstart=vector(spark, start), dangling=vector(spark, hang),
    )
    assert ranks(found) == pytest.approx(dense(NODES, arcs, 6, p=p, start=start, hang=hang))
    own = graph.pagerank(nodes, edges, directed=True, weight="w", rounds=3, personalization=vector(spark, p))
    assert ranks(own) == pytest.approx(dense(NODES, arcs, 3, p=p))


def test_convergence_and_its_failure(spark):
    nodes, edges = frames(spark)
    found = ranks(graph.pagerank(nodes, edges, tol=1e-4))
    assert found == pytest.approx(dense(NODES, mirrored(EDGES), 200), abs=1e-3)
    with pytest.raises(graph.NotConverged):
        graph.pagerank(nodes, edges, max_iter=2, tol=1e-12)


def test_vectors_must_cover_all_nodes(spark):
    nodes, edges = frames(spark)
    short = spark.createDataFrame([(0.0, 1.0)], "node double, weight double")
    for name in ("personalization", "dangling", "nstart"):
        with pytest.raises(ValueError):
            graph.pagerank(nodes, edges, **{name: short})


def test_regular_graph_and_order(spark):
    ring = [(float(i), float((i + 1) % 5)) for i in range(5)]
    nodes = spark.createDataFrame([(float(i),) for i in range(5)], "node double")
    table = graph.pagerank(nodes, spark.createDataFrame(ring, "src double, dst double"))
    assert ranks(table) == pytest.approx({float(i): 0.2 for i in range(5)})
    top = graph.rank_order(spark.createDataFrame([(2.0, 0.1), (1.0, 0.1), (3.0, 0.5)], "node double, rank double"))
    assert [r["node"] for r in top.collect()] == [3.0, 1.0, 2.0]
