"""Graph of co-anomalous values, PageRank over it, and the row score derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raritas.functions import runtime
from raritas.functions.runtime import cut_lineage
from raritas.operators.flags import flagged_cells, flagged_links
from raritas.sources.tables import with_row_id

# A node with more out-going arcs than this is split, so that no task holds all arcs of a hot value.
ARCS_PER_PIECE = 100_000
# The node vector is written to the checkpoint folder every few rounds and cached in between.
_CUT_EVERY = 4


class NotConverged(RuntimeError):
    """The power iteration did not meet its tolerance within the allowed rounds."""


def graph_nodes(flagged: DataFrame, key: str, attrs: list[str], method: str) -> DataFrame:
    """(node): distinct values occurring in any flag, equal values of different attributes being one node."""
    return flagged_cells(flagged, key, attrs, method).select(F.col("value").alias("node")).distinct()


def graph_edges(flagged: DataFrame, attrs: list[str], method: str) -> DataFrame:
    """(src, dst) with src <= dst: each pair of values that are anomalous in one row, once.

    All cases of linking singles, pairs and triplets of a row come down to linking any two attributes of the
    row's flagged attributes. Equal values on two attributes give a self-loop.
    """
    return flagged_links(flagged, attrs, method).distinct()


def _arcs(edges: DataFrame, directed: bool, weight: str | None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    arcs = edges.select("src", "dst", w.alias("w"))
    if not directed:
        arcs = arcs.unionByName(arcs.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return arcs.groupBy("src", "dst").agg(F.max("w").alias("w"))


def _vector(nodes: DataFrame, given: DataFrame | None, name: str, what: str) -> DataFrame:
    """Attach a normalised (node, weight) vector, which must cover all nodes."""
    total = given.agg(F.sum("weight")).first()[0]
    joined = nodes.join(given.select("node", (F.col("weight") / F.lit(float(total))).alias(name)), "node", "left")
    missing = joined.where(F.col(name).isNull()).limit(5).collect()
    if missing:
        raise ValueError(f"the {what} vector must have a value for every node; missing: {[r['node'] for r in missing]}")
    return joined


def pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    alpha: float = 0.85,
    personalization: DataFrame | None = None,
    max_iter: int = 100,
    tol: float = 1.0e-6,
    nstart: DataFrame | None = None,
    weight: str | None = None,
    dangling: DataFrame | None = None,
    directed: bool = False,
    rounds: int | None = None,
) -> DataFrame:
    """(node, rank) by power iteration; the optional vectors are (node, weight) tables covering all nodes.

    Stops when the summed change falls below ``nodes * tol`` and raises :class:`NotConverged` after ``max_iter``
    rounds. ``rounds`` runs a fixed number of rounds instead. Duplicate edges count once, with the largest weight.

    The arcs are laid out once by (source, piece) and stay there; per round only the node vector and partial sums
    per target move. A source with very many arcs is split into pieces and its share is sent to each of them.
    """
    spark = nodes.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arcs = cut_lineage(_arcs(edges, directed, weight))
    # The second bound keeps the table of split nodes, which is broadcast, within BROADCAST_ROWS.
    per_piece = max(ARCS_PER_PIECE, arcs.count() // runtime.BROADCAST_ROWS)
    out = arcs.groupBy("src").agg(F.sum("w").alias("out"), F.ceil(F.count(F.lit(1)) / per_piece).cast("int").alias("pieces"))
    ends = arcs.select(F.col("src").alias("node")).union(arcs.select(F.col("dst").alias("node")))
    known = nodes.select("node").union(ends).distinct()
    known = known.join(out.withColumnRenamed("src", "node"), "node", "left")
    known = cut_lineage(known.select("node", F.coalesce("out", F.lit(0.0)).alias("out"), F.coalesce("pieces", F.lit(1)).alias("pieces")))
    count = known.count()
    if count == 0:
        return known.select("node", F.lit(0.0).alias("rank"))
    uniform = F.lit(1.0 / count)

    start = known
    for given, name, what in ((nstart, "x", "start"), (personalization, "p", "personalization"), (dangling, "hang", "dangling")):
        if given is not None:
            start = _vector(start, given, name, what)
        elif name == "hang" and personalization is not None:
            start = start.withColumn("hang", F.col("p"))
        else:
            start = start.withColumn(name, uniform)
    state = cut_lineage(start.withColumn("change", F.lit(0.0)))

    hot = known.where("pieces > 1").select(F.col("node").alias("src"), "pieces")
    split = arcs.join(F.broadcast(hot), "src", "left")
    piece = F.pmod(F.xxhash64("dst"), F.coalesce("pieces", F.lit(1))).cast("int")
    laid = split.select("src", piece.alias("piece"), "dst", "w").repartition(partitions, "src", "piece").persist()

    hanging = F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("x"))), F.lit(0.0)).alias("hanging")
    loose = state.agg(hanging).first()["hanging"]
    # Both tables broadcast below have at most one row per node, or per piece of a node.
    few = F.broadcast if count <= runtime.BROADCAST_ROWS else lambda table: table
    held = []
    try:
        for number in range(1, (rounds if rounds is not None else max_iter) + 1):
            sent = state.where("out > 0").select(
                F.col("node").alias("src"),
                (F.lit(alpha) * F.col("x") / F.col("out")).alias("share"),
                F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
            )
            received = (
                laid.join(few(sent), ["src", "piece"])
                .groupBy(F.col("dst").alias("node"))
                .agg(F.sum(F.col("share") * F.col("w")).alias("got"))
            )
            # An array is handed to the generated code by reference: it need not be compiled anew for each number.
            given_back = F.get(F.array(F.lit(alpha * loose)), F.least(F.col("pieces"), F.lit(0)))
            fresh = F.coalesce("got", F.lit(0.0)) + given_back * F.col("hang") + F.lit(1.0 - alpha) * F.col("p")
            moved = state.join(few(received), "node", "left").select(
                "node", "out", "pieces", fresh.alias("x"), "p", "hang", F.abs(fresh - F.col("x")).alias("change")
            )
            if number % _CUT_EVERY:
                state = moved.persist()
                held.append(state)
            else:
                state = cut_lineage(moved)
                while held:
                    held.pop().unpersist()
            seen = state.agg(F.sum("change").alias("change"), hanging).first()
            loose = seen["hanging"]
            if rounds is None and seen["change"] < count * tol:
                break
        else:
            if rounds is None:
                raise NotConverged(f"no convergence within {max_iter} rounds")
        return cut_lineage(state.select("node", F.col("x").alias("rank")))
    finally:
        for table in [laid, *held]:
            table.unpersist()


def rank_order(ranks: DataFrame) -> DataFrame:
    """Nodes by falling rank, equal ranks by node."""
    return ranks.orderBy(F.desc("rank"), "node")


def rank_positions(ranks: DataFrame) -> DataFrame:
    """All nodes with ``position`` 0, 1, 2, ... by falling rank; numbered range by range, without a common task."""
    return with_row_id(rank_order(ranks), "position")


def pagerank_score(table: DataFrame, key: str, attrs: list[str], nodes: DataFrame) -> DataFrame:
    """(key, pagerank_score): nodes first seen in the row, times the number of nodes less one.

    Every node is credited to the first row, in key order, that holds its value in any attribute, flagged or not.
    The rank itself does not enter, so none is computed here; on an undirected graph the power iteration with its
    default settings always converges.
    """
    nodes = cut_lineage(nodes.select(F.col("node").alias("value")).distinct())
    count = nodes.count()
    values = table.select(key, F.explode(F.array_distinct(F.array(*[F.col(a).cast("double") for a in attrs]))).alias("value"))
    if count <= runtime.BROADCAST_ROWS:
        first = values.join(F.broadcast(nodes), "value", "left_semi").groupBy("value").agg(F.min(key).alias(key))
    else:
        # A value held by very many rows is one row once the map side has taken minima.
        first = values.groupBy("value").agg(F.min(key).alias(key)).join(nodes, "value", "left_semi")
    credited = first.groupBy(key).agg((F.count(F.lit(1)) * F.lit(count - 1)).alias("pagerank_score"))
    return table.select(key).join(credited, key, "left").select(key, F.coalesce("pagerank_score", F.lit(0)).alias("pagerank_score"))
