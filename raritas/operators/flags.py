"""Flags: which feature sets are anomalous in which row.

The wide form adds three array columns to the table: ``single_<m>`` holds attribute numbers, ``pairs_<m>`` and
``triplets_<m>`` hold arrays of attribute numbers; all are empty rather than null where nothing was found. The
long form has one row (key, arity, attrs) per flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raritas.functions.text import bound
from raritas.operators.featuresets import FeatureSet

METHODS = ("loda", "IF", "AE")
_NESTED = "array<array<int>>"


def flag_columns(method: str) -> list[str]:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; choose one of {', '.join(METHODS)}")
    return [f"single_{method}", f"pairs_{method}", f"triplets_{method}"]


def collate(df: DataFrame, flags: list[tuple[FeatureSet, Column]], method: str) -> DataFrame:
    """Turn one boolean per feature set into the three array columns, within the row."""
    names = flag_columns(method)
    columns = []
    for arity, name in enumerate(names, start=1):
        kind = "array<int>" if arity == 1 else _NESTED
        none = F.array().cast(kind)
        found = [
            F.when(hit, F.array(F.lit(s.attrs[0]) if arity == 1 else F.array(*map(F.lit, s.attrs)))).otherwise(none)
            for s, hit in flags
            if s.arity == arity
        ]
        columns.append((F.concat(*found) if found else none).cast(kind).alias(name))
    return df.select("*", *columns)


def collate_scores(df: DataFrame, scores: str, sets: list[FeatureSet], cuts: list[float], method: str) -> DataFrame:
    """Like :func:`collate`, from an array column with one score per set and the cuts to be exceeded.

    The sets are a literal array walked by one expression, so the plan stays small however many sets there are.
    """
    names = flag_columns(method)
    table = F.array(
        *[F.struct(F.array(*map(F.lit, s.attrs)).alias("attrs"), F.lit(float(t)).alias("cut")) for s, t in zip(sets, cuts)]
    )
    # The scores enter as an argument: a column named inside a lambda may be computed again for every element.
    hits = F.zip_with(F.col(scores), table, lambda score, s: F.when(score > s["cut"], s["attrs"]))
    found = df.withColumn("_hits", F.filter(hits, lambda a: a.isNotNull()))

    def of_size(arity: int) -> Column:
        return F.filter("_hits", lambda a: F.size(a) == arity)

    columns = [F.transform(of_size(1), lambda a: a[0]), of_size(2), of_size(3)]
    return found.select(*df.columns, *[c.alias(n) for c, n in zip(columns, names)])


def long_flags(flagged: DataFrame, key: str, method: str) -> DataFrame:
    """(key, arity, attrs), one row per flag."""
    single, pairs, triplets = flag_columns(method)
    every = F.concat(F.transform(F.col(single), lambda a: F.array(a)), F.col(pairs), F.col(triplets))
    exploded = flagged.select(key, F.explode_outer(every).alias("attrs")).where("attrs is not null")
    return exploded.select(key, F.size("attrs").alias("arity"), "attrs")


def collate_long(df: DataFrame, flags: DataFrame, key: str, method: str) -> DataFrame:
    """Attach flags in long form to their rows; rows without flags get empty arrays."""
    single, pairs, triplets = flag_columns(method)
    lists = [
        F.transform(F.sort_array(F.collect_list(F.when(F.size("attrs") == 1, F.col("attrs")))), lambda a: a[0]).alias(single),
        F.sort_array(F.collect_list(F.when(F.size("attrs") == 2, F.col("attrs")))).alias(pairs),
        F.sort_array(F.collect_list(F.when(F.size("attrs") == 3, F.col("attrs")))).alias(triplets),
    ]
    gathered = flags.groupBy(key).agg(*lists)
    joined = df.join(gathered, key, "left")
    empty = {single: "array<int>", pairs: _NESTED, triplets: _NESTED}
    return joined.select(*df.columns, *[F.coalesce(F.col(c), F.array().cast(t)).alias(c) for c, t in empty.items()])


def members(method: str, counted: int = 3) -> Column:
    """Attribute numbers of all flags of a row, once per flag; of triplets only the first ``counted`` members."""
    single, pairs, triplets = (F.col(c) for c in flag_columns(method))
    if counted < 3:
        triplets = F.transform(triplets, lambda t: F.slice(t, 1, counted))
    return F.concat(single, F.flatten(pairs), F.flatten(triplets))


def participation(members_column: Column, attr: int | Column) -> Column:
    """In how many flags of the row the attribute takes part."""
    return F.size(members_column) - F.size(F.array_remove(members_column, attr))


def flagged_cells(flagged: DataFrame, key: str, attrs: list[str], method: str, compat: bool = False) -> DataFrame:
    """(key, attr, value, part, weight) for the anomalous attributes of flagged rows.

    ``part`` is the attribute's number of flags in the row. ``weight`` equals it, but under ``compat`` leaves out
    triplets in which the attribute comes last, as the original count does.
    """
    values = F.array(*[F.col(name).cast("double") for name in attrs])
    weighed = members(method, 2 if compat else 3)
    given = F.struct(values.alias("v"), members(method).alias("m"), weighed.alias("w"))

    def cells(row: Column) -> Column:
        def cell(attr: Column) -> Column:
            return F.struct(
                attr.alias("attr"),
                F.get(row["v"], attr).alias("value"),
                participation(row["m"], attr).alias("part"),
                participation(row["w"], attr).alias("weight"),
            )

        return F.transform(F.array_distinct(row["m"]), cell)

    # Outer generators, here and below, and filters behind them: otherwise the optimizer copies the whole
    # computation of the flags into a filter below.
    return flagged.select(key, F.inline_outer(bound(given, cells))).where("part > 0")


def calm_rows(flagged: DataFrame, key: str, method: str) -> DataFrame:
    """Keys of the rows without any flag."""
    counted = flagged.select(key, F.explode_outer(F.array(F.size(members(method)))).alias("_n"))
    return counted.where("_n = 0").select(key)


def flagged_links(flagged: DataFrame, attrs: list[str], method: str) -> DataFrame:
    """(src, dst) for every two anomalous attributes of a row; at most d * (d - 1) / 2 per row, d the attributes."""
    values = F.array(*[F.col(name).cast("double") for name in attrs])
    given = F.struct(values.alias("v"), F.array_sort(F.array_distinct(members(method))).alias("m"))

    def links(row: Column) -> Column:
        def from_one(i: Column, place: Column) -> Column:
            def link(j: Column) -> Column:
                a, b = F.get(row["v"], i), F.get(row["v"], j)
                return F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))

            return F.transform(F.slice(row["m"], place + 2, len(attrs)), link)

        return F.flatten(F.transform(row["m"], from_one))

    found = flagged.select(F.explode_outer(bound(given, links)).alias("_l"))
    return found.where("_l is not null").select("_l.src", "_l.dst")
