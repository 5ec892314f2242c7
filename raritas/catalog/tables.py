"""The views of the given tables that the registered queries work on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raritas.sources.tables import spread


@dataclass(frozen=True)
class View:
    """A keyed table of attributes, described once for Spark and once for SQL."""

    table: str
    key: str
    attrs: tuple[str, ...]
    spark: tuple[str, ...]
    sql: tuple[str, ...]

    def read(self, session: SparkSession, folder: str) -> DataFrame:
        table = session.read.parquet(f"{folder}/{self.table}.parquet")
        return table.select(self.key, *[F.expr(e).alias(a) for e, a in zip(self.spark, self.attrs)])

    def read_spread(self, session: SparkSession, folder: str) -> DataFrame:
        """For queries with much work per row."""
        return spread(self.read(session, folder), self.key)

    @property
    def base(self) -> str:
        columns = ", ".join(f"{e} AS a{i}" for i, e in enumerate(self.sql))
        return f"SELECT {self.key} AS id, {columns} FROM {self.table}"


def _plain(table: str, key: str, *attrs: str) -> View:
    return View(table, key, attrs, attrs, attrs)


def _numbers(table: str, key: str, **attrs: str) -> View:
    casts = tuple(f"CAST({e} AS DOUBLE)" for e in attrs.values())
    return View(table, key, tuple(attrs), casts, casts)


TEXT3 = _plain("part", "p_partkey", "p_name", "p_brand", "p_type")
TEXT2 = _plain("customer", "c_custkey", "c_name", "c_mktsegment")
TEXT_LONG = _plain("documents", "doc_id", "text", "source")
TEXT_SHORT = _plain("orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
TEXT4 = View(
    "documents",
    "doc_id",
    ("lang", "source", "both", "turned"),
    ("lang", "source", "concat(lang, source)", "concat(source, lang)"),
    ("lang", "source", "concat(lang, source)", "concat(source, lang)"),
)
NUM3 = _numbers("events", "event_id", value="value", user_id="user_id", hour="hour(ts)")
NUM2 = _numbers("part", "p_partkey", p_size="p_size", p_retailprice="p_retailprice")
DOC3 = _numbers(
    "documents",
    "doc_id",
    n_chars="n_chars",
    spaces="length(text) - length(replace(text, ' ', ''))",
    newlines="length(text) - length(replace(text, chr(10), ''))",
)
