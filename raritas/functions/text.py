"""Expressions and steps over character n-grams. All of them are linear in the length of the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TO_END = 2**30  # more than any array or text holds


def explode_grams(df: DataFrame, text: str, n: int) -> DataFrame:
    """One row per character n-gram of the column ``text``, which gives way to a column ``token``.

    The characters are split once and zipped with themselves shifted by 1..n-1 places; ``substring`` per position
    would rescan the text from its start each time. The outer form of explode keeps the optimizer from copying the
    whole expression into a ``size() > 0`` filter below.
    """
    kept = [c for c in df.columns if c != text]
    chars = F.split(text, "")
    shifted = [F.slice(chars, k + 1, _TO_END).alias(f"c{k}") for k in range(n)]
    zipped = df.select(*kept, F.explode_outer(F.arrays_zip(*shifted)).alias("_z"))
    # Past the end of the text the last character is null; an empty text gives a single empty character.
    whole = F.col(f"_z.c{n - 1}").isNotNull() & (F.col(f"_z.c{n - 1}") != "")
    return zipped.where(whole).select(*kept, F.concat(*[f"_z.c{k}" for k in range(n)]).alias("token"))


def gram_array(text: Column, n: int) -> Column:
    """All character n-grams of ``text``, repeats kept, in no particular order; empty when the text is too short.

    They are the non-overlapping pieces of length n counted from each of the first n places.
    """
    piece = F.lit(f"(?s).{{{n}}}")
    starts = [text] + [F.substring(text, k, _TO_END) for k in range(2, n + 1)]
    return F.concat(*[F.regexp_extract_all(start, piece, F.lit(0)) for start in starts])


def tail(text: Column, size: int) -> Column:
    return F.right(text, F.lit(size))


def head(text: Column, size: int) -> Column:
    return F.left(text, F.lit(size))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often and in whatever loop the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal(values: list) -> Column:
    """A nested list of integers as one folded literal, built by a single call however long it is."""

    def text(v) -> str:
        return f"array({','.join(map(text, v))})" if isinstance(v, (list, tuple)) else str(v)

    return F.expr(text(values))


def tokens_with_attributes(texts: list[Column], n: int) -> Column:
    """Map of each distinct n-gram in a row to the ascending numbers of the attributes that contain it."""
    none = F.array().cast("array<int>")

    def marked(text: Column, attr: Column) -> Column:
        return bound(F.array_distinct(gram_array(text, n)), lambda g: F.map_from_arrays(g, F.array_repeat(F.array(attr), F.size(g))))

    def merge(left: Column, right: Column) -> Column:
        return F.map_zip_with(left, right, lambda _, x, y: F.concat(F.coalesce(x, none), F.coalesce(y, none)))

    return F.aggregate(F.transform(F.array(*texts), marked), F.create_map().cast("map<string,array<int>>"), merge)
