"""From a table to flags: choose attributes, sample, fit, score."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from raritas.operators.autoencoder import NetSpec, fit_autoencoder
from raritas.operators.featuresets import feature_sets
from raritas.operators.flags import collate
from raritas.operators.iforest import fit_iforest
from raritas.operators.loda import fit_loda
from raritas.operators.ngram import ngram_detect
from raritas.operators.sampling import sample_rows
from raritas.plans.settings import Settings, check_method, check_split, choose_settings
from raritas.sources.tables import numeric_projection, string_projection


def detect(
    df: DataFrame,
    key: str,
    method: str = "loda",
    train_split: float = 0.5,
    con: float = 0.1,
    n: int = 3,
    th: float = 0.3,
    seed: int = 0,
    settings: Settings | None = None,
    profile: str = "by_rows",
    shards: int = 1,
    compat: bool = False,
    on_null: str = "error",
) -> DataFrame:
    """Run one detector over all attributes of its type, their pairs and their triplets.

    Numeric detectors return the key, the numeric attributes and three flag columns; 'ngram' returns the key, the
    string attributes and three score columns. ``con`` is the autoencoder's share of outliers, ``n`` and ``th``
    are the n-gram length and frequency band. ``profile`` names the tuned settings of the trained detectors: 'small',
    'big', or 'by_rows' (the original rule: big above 10000 rows); ``settings`` replaces them. ``shards`` is the number of
    parts of the sample that an autoencoder is trained on side by side; a part is held by one task.
    """
    check_method(method)
    if method == "ngram":
        texts = string_projection(df, key, on_null)
        scores = ngram_detect(texts, key, texts.columns[1:], int(n), float(th), compat)
        return texts.join(scores, key)
    check_split(train_split)
    numbers = numeric_projection(df, key, on_null)
    attrs = numbers.columns[1:]
    sample, rows, _ = sample_rows(numbers, key, lambda size: int(train_split * size), seed)
    chosen = settings or choose_settings(profile, rows)
    if method == "loda":
        return fit_loda(sample, attrs).flag(numbers)
    if method == "AE":
        spec = NetSpec(chosen.layers, chosen.epochs, chosen.activation, chosen.batch_size)
        return fit_autoencoder(sample, key, attrs, spec, con, seed, shards).flag(numbers)
    if compat:
        return _compat_forest(numbers, sample, key, attrs, chosen.estimators, seed)
    return fit_iforest(sample, key, attrs, feature_sets(len(attrs)), chosen.estimators).flag(numbers)


def _compat_forest(
    numbers: DataFrame, sample: DataFrame, key: str, attrs: list[str], trees: int, seed: int
) -> DataFrame:
    """The original forest's odd habits.

    Attribute i alone is judged by a forest over attributes i and d - 2, the last two attributes are never judged
    alone, inliers are reported for single attributes, and pairs use 100 trees on a 20 % sample of their own.
    """
    d = len(attrs)
    sets = feature_sets(d)
    beside = [replace(s, features=(s.attrs[0], d - 2)) for s in sets if s.arity == 1 and s.attrs[0] < d - 2]
    pairs = [s for s in sets if s.arity == 2]
    models = []
    own = beside + [s for s in sets if s.arity == 3]
    if own:
        models.append(("_own", fit_iforest(sample, key, attrs, own, trees)))
    if pairs:
        second, _, _ = sample_rows(numbers, key, lambda size: int(0.2 * size), seed + 7)
        models.append(("_pairs", fit_iforest(second, key, attrs, pairs, 100)))
    scored, hits = numbers, []
    for name, model in models:
        scored = scored.withColumn(name, model.scores_column(numbers.sparkSession))
        hits += model.hits(name, invert_singles=True)
    return collate(scored, hits, "IF").drop(*[name for name, _ in models])


