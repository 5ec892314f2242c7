"""Training sample of an exact size, drawn by hashing the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DIGITS = 3
_FEW = 10_000


def key_hash(key: str, seed: int) -> Column:
    """MD5 of ``key:seed`` as 32 hexadecimal digits, which order like the number they write."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def train_sample(df: DataFrame, key: str, split: float = 0.5, seed: int = 0) -> DataFrame:
    """The ``int(split * N)`` rows with the smallest key hash."""
    if not 0 <= split <= 1:
        raise ValueError("the training split must lie between 0 and 1")
    return sample_rows(df, key, lambda n: int(split * n), seed)[0]


def sample_rows(df: DataFrame, key: str, size, seed: int = 0) -> tuple[DataFrame, int, int]:
    """Keep exactly ``size(N)`` rows; returns the sample, N and the number of rows kept.

    The sample is a plain filter ``hash <= cut``: nothing is sorted or shuffled, and every run keeps the same
    rows. The cut is found by counting rows per leading hash digits (4096 counters, combined before the
    shuffle) and looking closer at the one counter the cut falls into, until few hashes are left there.
    Equal keys cannot be told apart: a cut that would fall between them is an error.
    """
    hashed = key_hash(key, seed)
    keys = df.select(hashed.alias("h"))
    prefix, below, total, wanted = "", 0, None, 0
    while True:
        start = len(prefix)
        digits = F.substring("h", start + 1, _DIGITS)
        counts = sorted(
            (r["d"], r["n"])
            for r in keys.where(F.col("h").startswith(prefix)).groupBy(digits.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
        )
        if total is None:
            total = sum(n for _, n in counts)
            wanted = min(total, max(0, size(total)))
            if wanted == total:
                return df, total, wanted
            if wanted == 0:
                return df.where(F.lit(False)), total, 0
        for part, n in counts:
            if below + n >= wanted:
                break
            below += n
        prefix += part
        if below + n == wanted:
            # 'g' follows every hexadecimal digit, so this takes in all hashes with the prefix.
            return df.where(hashed < F.lit(prefix + "g")), total, wanted
        if n <= _FEW or len(prefix) == 32:
            left = wanted - below
            if n > _FEW:
                raise ValueError(f"{n} rows have one key; keys must be unique")
            last = [r["h"] for r in keys.where(F.col("h").startswith(prefix)).orderBy("h").limit(left + 1).collect()]
            if last[left - 1] == last[left]:
                raise ValueError("the sample would part rows with one key; keys must be unique")
            return df.where(hashed <= F.lit(last[left - 1])), total, wanted
