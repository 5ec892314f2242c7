"""URL filters: a trie over reversed host labels and path segments, with the longest matching rule deciding.

A rule is (verdict, host, path). It fits a URL whose host is the rule's host or one below it, if the URL's path starts
with the rule's path. Of the rules that fit, the one with more host labels decides, among these the one with the longer
path, among equal rules ``block``. Without a fitting rule the verdict is ``default``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raritas.functions.runtime import ship_package

# Rules are held in memory by every task; more of them are joined by key instead.
TRIE_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as they stand in the URL; both empty for null and for URLs without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, parts, 1), F.lit(""))
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


class Trie:
    """Nodes are dicts by host label, last label first; the host's paths hang below by segment.

    A path's segments are the pieces after each ``/``. All but the last must equal those of the URL, and the last must
    begin the URL's piece at that place, which together is "starts with".
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {"below": {}, "paths": None}
        for rule in sorted(rules, key=lambda r: r.verdict != "allow"):  # of equal rules, block is written last
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node["below"].setdefault(label, {"below": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"below": {}, "ends": {}, "sizes": []}
            *full, last = rule.path.split("/")
            at = node["paths"]
            for segment in full:
                at = at["below"].setdefault(segment, {"below": {}, "ends": {}, "sizes": []})
            at["ends"][last] = rule
            at["sizes"] = sorted({*at["sizes"], len(last)}, reverse=True)

    @staticmethod
    def _longest(paths: dict, path: str) -> Rule | None:
        best, at, segments = None, paths, path.split("/")
        for place, segment in enumerate(segments):
            for size in at["sizes"]:  # the lengths that endings have here, not every length of the segment
                if size <= len(segment) and (found := at["ends"].get(segment[:size])) is not None:
                    best = found
                    break
            # a further segment begins with a slash, which only the pieces before the last one have
            if place == len(segments) - 1 or (at := at["below"].get(segment)) is None:
                break
        return best

    def find(self, host: str, path: str) -> Rule | None:
        best, node = None, self.root
        for label in reversed(host.split(".")):
            if (node := node["below"].get(label)) is None:
                break
            if node["paths"] is not None and (found := self._longest(node["paths"], path)) is not None:
                best = found
        return best


def judge_urls(
    pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = "allow", trie_rules: int = TRIE_RULES
) -> DataFrame:
    """Return key, host, path, rule (name or null) and verdict for every row.

    Null and malformed URLs have an empty host and path and get the default. Repeated rows are judged each, an empty table
    gives an empty result, and other columns are not read. A very long URL costs as many look-ups as rules differ in length.
    Up to ``trie_rules`` rules the trie goes to every task; more are joined by (host suffix, path prefix).
    """
    host, path = host_and_path(F.col(url).cast("string"))
    parsed = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    judged = _by_trie(parsed, rules, default) if len(rules) <= trie_rules else _by_join(parsed, rules, default)
    return judged.withColumnRenamed("key", key)


def _by_trie(parsed: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    spark = parsed.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(Trie(rules))
    schema = parsed.select("*").schema.add("rule", "string").add("verdict", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            found = [trie.find(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            names = pa.array([r.name if r else None for r in found], pa.string())
            verdicts = pa.array([r.verdict if r else default for r in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, names, verdicts], names=[*batch.schema.names, "rule", "verdict"])

    return parsed.mapInArrow(run, schema)


def _by_join(parsed: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same verdicts by equality joins: distinct (host, path) meet the rules of each host suffix and path prefix."""
    spark = parsed.sparkSession
    best = {}
    for rule in sorted(rules, key=lambda r: r.verdict != "allow"):
        best[rule.host, rule.path] = rule.verdict
    table = spark.createDataFrame([(h, p, v) for (h, p), v in best.items()], "r_host string, r_path string, r_verdict string")
    urls = parsed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    lengths = table.select(F.length("r_path").alias("n")).distinct().agg(F.collect_set("n")).first()[0]
    prefixes = F.array_distinct(F.transform(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: F.substring("path", F.lit(1), n)))
    tried = urls.select("host", "path", F.explode(suffixes).alias("r_host"), prefixes.alias("p")).select("host", "path", "r_host", F.explode("p").alias("r_path"))
    order = F.struct(F.size(F.split("r_host", r"\.")).alias("a"), F.length("r_path").alias("b"))
    chosen = (
        tried.join(table, ["r_host", "r_path"])
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), order).alias("hit"))
    )
    joined = parsed.join(chosen, ["host", "path"], "left")
    return joined.select("key", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


RULES = [Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def query(spark, folder: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{folder}/pages.parquet"), RULES)


SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw_host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
named AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM split),
ruled AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/'
              WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule
  FROM named)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
