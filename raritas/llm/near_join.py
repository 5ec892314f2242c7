"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles, whole and exact.

Documents with equal sets are one node. Nodes with fewer than ``boundary`` shingles are light: they enumerate all their
subsets of the fixed sizes that a partner of each size must share, and meet in equal subsets. Pairs with a node of at
least ``boundary`` shingles are heavy: the nodes scan inverted lists. The boundary is the one of least cost, subsets
against list entries, for the sizes found in the data.

Inverted lists are kept short without losing a pair. Two sets that share enough shingles share ``need`` of them among
the first ones of each in any common order:
1. in order of hash: a node of whose first shingles fewer than ``need`` occur in another node's first ones has no
   partner. This is one count of a fifth of the shingles and leaves little but near copies.
2. among those left, in order of frequency, rarest first: shingles that no other node left has come first and need no
   list; often none of a node's first shingles is left to be looked up.
Nodes that meet in a subset or a list are bundled (components). Bundles are compared in blocks of bounded size, every
pair of blocks once, with exact intersection counts; a block pair returns a forest of its links and the number of links
of each node, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raritas.functions.runtime import cut_lineage, ship_package
from raritas.llm.common import BROADCAST_ROWS, keyed_text, release, slices, text_bytes, tidied
from raritas.llm.components import components
from raritas.llm.shingles import mixed, shingle_sets

SLICE_BYTES = 1 << 20
MOST_BOUNDARY = 64
# Shingles in a block of a bundle, and in a task's pack of small bundles; a longer set is a block of its own.
BLOCK_SHINGLES = 250_000


@dataclass(frozen=True)
class Rule:
    """Sets of sizes n and m are linked if 100 * intersection >= percent * union; shingles have ``words`` words."""

    words: int = 4
    percent: int = 85

    def common(self, n: int, m: int) -> int:
        """Least intersection of linked sets of these sizes."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def smallest(self, n):
        """Least size of a partner, which is also the least intersection with any."""
        return -(-self.percent * n // 100)

    def largest(self, n: int) -> int:
        return 100 * n // self.percent

    def first(self, n):
        """How many shingles of a set, in any common order, hold one of every partner's first ones."""
        return n - self.smallest(n) + 1

    @staticmethod
    def extra(n):
        return np.maximum(1, n // 20)

    def probe(self, n):
        """First shingles by hash that are counted; linked sets share at least ``need`` of them."""
        return n - self.smallest(n) + self.extra(n)

    def need(self, n):
        return self.extra(self.smallest(n))

    def subsets(self, n: int, boundary: int) -> list[tuple[int, int, int]]:
        """(n, m, size) of subsets that a light set of size n enumerates, as the smaller or the larger of a pair."""
        above = [(n, m, self.common(n, m)) for m in range(n, min(self.largest(n), boundary - 1) + 1)]
        below = [(m, n, self.common(m, n)) for m in range(self.smallest(n), n)]
        return [s for s in above + below if s[0] > 0 and s[2] <= s[0]]


def choose_boundary(sizes: dict[int, int], rule: Rule) -> int:
    """Boundary of least cost for ``sizes`` (nodes by number of shingles)."""
    best = (float("inf"), 1)
    for boundary in range(1, MOST_BOUNDARY + 1):
        light = sum(c * sum(comb(n, s) for _, _, s in rule.subsets(n, boundary)) for n, c in sizes.items() if 0 < n < boundary)
        heavy = sum(c * (int(rule.probe(n)) + 4) for n, c in sizes.items() if rule.smallest(boundary) <= n <= MOST_BOUNDARY)
        best = min(best, (light + heavy, boundary))
    return best[1]


def subset_keys(tokens: np.ndarray, rule: Rule, boundary: int) -> np.ndarray:
    """64-bit keys of the subsets of a light set; equal subsets for equal pairs of sizes have equal keys."""
    n, keys = len(tokens), []
    for small, large, size in rule.subsets(n, boundary):
        chosen = np.array(list(combinations(range(n), n - size)), dtype=np.int64).reshape(comb(n, size), n - size)
        total = mixed(tokens).sum(dtype=np.uint64)  # a subset by what is left out
        kept = total - mixed(tokens)[chosen].sum(axis=1, dtype=np.uint64)
        keys.append(mixed(kept ^ mixed(np.uint64(small * 1_000_003 + large) + np.zeros(1, dtype=np.uint64))))
    return np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)


def _sets(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[bytes]]]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            tokens, rows = shingle_sets(*text_bytes(part.column("text")), rule.words)
            nodes = [hashlib.blake2b(tokens[a:b], digest_size=16).digest() for a, b in zip(rows[:-1], rows[1:], strict=True)]
            yield part.column("key"), tokens, rows, nodes


def _nids(nodes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(nodes), dtype=np.int64)[::2]


def _lists(pieces: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int32)
    flat = np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def document_sets(given: DataFrame, rule: Rule) -> DataFrame:
    """key, n_shingles, node (128-bit digest of the set), nid (64 bits of it) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, rows, nodes in _sets(batches, rule):
            columns = [keys, pa.array(np.diff(rows)), pa.array(nodes, pa.binary()), pa.array(_nids(nodes))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_shingles", "node", "nid"])

    return given.mapInArrow(tidied(run), f"key {_key_type(given)}, n_shingles bigint, node binary, nid bigint")


def probe_entries(given: DataFrame, rule: Rule, boundary: int) -> DataFrame:
    """Entries of the first count: nid (64 bits of the node), token, light (a subset's key, or else a shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = rule.smallest(boundary)
        for _, tokens, rows, nodes in _sets(batches, rule):
            nids = _nids(nodes)
            n = np.diff(rows)
            size = np.where(n >= max(least, 1), rule.probe(n), 0)
            ends = np.concatenate(([0], np.cumsum(size)))
            take = np.arange(ends[-1]) - np.repeat(ends[:-1] - rows[:-1], size)
            yield _entries(np.repeat(nids, size), tokens[take], False)
            small = np.flatnonzero((n > 0) & (n < boundary))
            keys = [subset_keys(tokens[rows[i] : rows[i + 1]], rule, boundary) for i in small]
            if keys:
                yield _entries(np.repeat(nids[small], [len(k) for k in keys]), np.concatenate(keys), True)

    return given.mapInArrow(tidied(run), "nid bigint, token bigint, light boolean")


def _entries(nids: np.ndarray, tokens: np.ndarray, light: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nids), pa.array(tokens.view(np.int64)), pa.array(np.full(len(nids), light))], names=["nid", "token", "light"])


def full_sets(given: DataFrame, rule: Rule, boundary: int) -> DataFrame:
    """node, n, tokens, keys (of subsets, for light nodes) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, rows, nodes in _sets(batches, rule):
            own = [tokens[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]
            keys = [subset_keys(t, rule, boundary) if 0 < len(t) < boundary else t[:0] for t in own]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(np.diff(rows)), _lists(own), _lists(keys)], names=["node", "n", "tokens", "keys"])

    return given.mapInArrow(tidied(run), "node binary, n bigint, tokens array<bigint>, keys array<bigint>")


def _key_type(df: DataFrame) -> str:
    return df.schema["key"].dataType.simpleString()


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def candidates(given: DataFrame, nodes: DataFrame, rule: Rule, boundary: int) -> DataFrame:
    """Nodes that can have a partner: node, n, tokens, keys, copies, sid (a number). Checkpointed."""
    entries = probe_entries(given, rule, boundary)
    shared = entries.groupBy("token", "light").agg(F.min("nid").alias("a"), F.max("nid").alias("z")).where("a <> z").select("token", "light")
    met = entries.join(shared, ["token", "light"], "left_semi").groupBy("nid").agg(F.sum(F.col("light").cast("int")).alias("keys_met"), F.sum((~F.col("light")).cast("int")).alias("met"))
    met = cut_lineage(met.withColumnRenamed("nid", "met_nid"))
    del entries, shared
    release(given.sparkSession)
    need = F.greatest(F.lit(1), F.expr(f"((n * {rule.percent} + 99) div 100) div 20"))
    # 64 bits of two nodes may agree; their counts are then added, which keeps both and loses none
    left = nodes.join(_small(met, met.count()), F.col("nid") == F.col("met_nid")).where((F.col("keys_met") > 0) | (F.col("met") >= need * F.col("copies")))
    left = cut_lineage(left.select("node", "copies", "key"))
    few = left.count()
    texts = given.join(_small(left.select(F.col("key").alias("k")), few), F.col("key").eqNullSafe(F.col("k")), "left_semi")
    sets = full_sets(texts, rule, boundary).join(_small(left.select("node", "copies"), few), "node").dropDuplicates(["node"])
    sets = cut_lineage(sets)
    release(given.sparkSession)
    return sets.withColumn("sid", F.monotonically_increasing_id())  # the same at each reading of the checkpoint


def meetings(sets: DataFrame, rule: Rule, boundary: int) -> DataFrame:
    """Rows (bucket, sid): the subsets of light nodes, and the lists that the others must be looked up in."""
    heavy = sets.where(F.col("n") >= max(1, rule.smallest(boundary)))
    tokens = heavy.select("sid", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = tokens.join(counts, "token").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    first = F.expr(f"cast(n - (n * {rule.percent} + 99) div 100 + 1 as int)")
    lone = (F.col("n") - F.size("shared")).cast("int")
    looked_up = heavy.select("sid", "n").join(ordered, "sid").where(first > lone).select("sid", F.explode(F.slice("shared", F.lit(1), first - lone)).alias("e"))
    light = sets.where((F.col("n") < boundary) & (F.col("n") > 0)).select("sid", F.explode("keys").alias("bucket"))
    return looked_up.select("sid", F.col("e.token").alias("bucket"), F.lit(False).alias("light")).union(light.select("sid", "bucket", F.lit(True)))


def bundle(met: DataFrame) -> DataFrame:
    """Rows (sid, bundle) of nodes that meet another, directly or not."""
    met = cut_lineage(met)
    release(met.sparkSession)
    least = met.groupBy("bucket", "light").agg(F.min("sid").alias("m"), F.max("sid").alias("z")).where("m < z").drop("z")
    edges = met.join(least, ["bucket", "light"]).select(F.col("sid").alias("a"), F.col("m").alias("b"))
    return components(edges).select(F.col("a").alias("sid"), F.col("m").alias("bundle"))


def linked_pairs(sets: list[np.ndarray], side: np.ndarray, rule: Rule) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, the later sets linked to it. ``side``: pairs of equal sides 0 and 1 are passed over, -1 takes all."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    posting, bounds = owner[order], np.searchsorted(token[order], np.arange(token.max() + 2))
    rows = np.concatenate(([0], np.cumsum(sizes)))
    for i in range(len(sets) - 1):
        mine = token[rows[i] : rows[i + 1]]
        long = bounds[mine + 1] - bounds[mine]
        mine, long = mine[long > 1], long[long > 1]
        if not len(mine):
            continue
        ends = np.cumsum(long)
        common = np.bincount(posting[np.arange(ends[-1]) - np.repeat(ends - long - bounds[mine], long)], minlength=len(sets))[i + 1 :]
        linked = 100 * common >= rule.percent * (sizes[i] + sizes[i + 1 :] - common)
        if side[i] >= 0:
            linked &= side[i + 1 :] != side[i]
        if linked.any():
            yield i, i + 1 + np.flatnonzero(linked)


def compare(rows: pd.DataFrame, rule: Rule) -> pd.DataFrame:
    """Links within a task's rows (bundle, left, right, block, sid, copies, tokens): sid, root, links."""
    out = []
    for (_, left, right), group in rows.groupby(["bundle", "left", "right"], sort=False):
        group = group.sort_values("sid", kind="stable")
        sids, copies = group["sid"].to_numpy(), group["copies"].to_numpy()
        side = np.full(len(group), -1) if left == right else (group["block"].to_numpy() == left).astype(int)
        root, links = np.arange(len(group)), np.zeros(len(group), dtype=np.int64)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, others in linked_pairs([np.asarray(t) for t in group["tokens"]], side, rule):
            links[i] += copies[others].sum()
            links[others] += copies[i]
            for j in others:
                a, b = find(i), find(int(j))
                root[max(a, b)] = min(a, b)
        least = np.array([find(x) for x in range(len(group))], dtype=np.int64)
        hit = links > 0
        out.append(pd.DataFrame({"sid": sids[hit], "root": sids[least[hit]], "links": links[hit]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"sid": [], "root": [], "links": []}).astype("int64")


def compare_bundles(sets: DataFrame, bundles: DataFrame, rule: Rule, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Rows (sid, root, links) of each block pair, in which links are those found there."""
    members = sets.select("sid", "n", "copies", "tokens").join(bundles, "sid")
    sizes = cut_lineage(sets.select("sid", "n").join(bundles, "sid").groupBy("bundle").agg(F.sum("n").alias("all")).withColumn("blocks", F.ceil(F.col("all") / block_shingles).cast("int")))
    small = sizes.where("blocks = 1").agg(F.sum("all").alias("s")).first()["s"] or 0
    packs = max(-(-int(small) // block_shingles), int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = members.join(sizes.select("bundle", "blocks"), "bundle").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bundle"), F.lit(packs))).otherwise(-1 - F.col("bundle"))
    dealt = dealt.select("bundle", "left", "right", "block", "sid", "copies", "tokens", pack.alias("pack"))
    return dealt.groupBy("pack", "left", "right").applyInPandas(lambda rows: compare(rows, rule), "sid bigint, root bigint, links bigint")


def near_join(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule | None = None) -> DataFrame:
    """One row per document: key, n_shingles, component_id (least key reachable by links, itself included), n_links.

    ``n_links`` counts the other documents linked to it, equal ones included. Null and empty texts and texts without a
    word have an empty set and no links. Rows with equal sets are linked whatever their keys; a null key takes part, but
    is never a component's id unless all its keys are null. Very long texts are read whole.
    """
    rule = rule or Rule()
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    given = keyed_text(docs, key, text)
    listed = cut_lineage(document_sets(given, rule))
    full = listed.where("n_shingles > 0")
    nodes = full.groupBy("node").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("nid").alias("nid"))
    nodes = cut_lineage(nodes)
    sizes = {r["n"]: r["c"] for r in nodes.where(F.col("n") <= MOST_BOUNDARY).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    boundary = choose_boundary(sizes, rule)
    sets = candidates(given, nodes, rule, boundary)
    bundles = cut_lineage(bundle(meetings(sets, rule, boundary)))
    found = cut_lineage(compare_bundles(sets, bundles, rule))
    release(spark)
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    named = sets.select("sid", "node").join(nodes.select("node", "key"), "node").join(links, "sid").join(joined.withColumnRenamed("a", "sid"), "sid", "left")
    named = cut_lineage(named.select("node", "key", "links", F.coalesce("m", "sid").alias("m")))
    least = named.groupBy("m").agg(F.min("key").alias("least"))
    linked = cut_lineage(named.join(least, "m").select("node", "least", "links"))
    alone = nodes.select("node", F.col("key").alias("own"), "copies").join(linked, "node", "left")
    classes = alone.select("node", F.coalesce("least", "own").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    some = cut_lineage(classes.where(F.col("links") > 0))
    out = listed.join(_small(some, some.count()), "node", "left")
    return out.select(
        F.col("key").alias(key),
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("least", "key")).otherwise(F.col("key")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_join(spark.read.parquet(f"{folder}/documents.parquet"))
