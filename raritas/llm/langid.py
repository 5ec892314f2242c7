"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features are hashed byte n-grams of the lower-cased text, everything but letters mapped to a blank, as shares of all its
n-grams. A family is chosen by one-versus-rest linear SVMs, a language within the family by votes of linear SVMs for each
pair, ties by the sum of margins. Classifiers are fitted on at most about ``per_language`` labelled rows of each language
(drawn by a hash of the key); each is trained by one task, whose input that bound limits. Prediction is row-wise, over
whole texts, from the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raritas.functions.runtime import ship_package
from raritas.llm.common import slices, text_bytes, tidied, unit_interval

# Families by ISO 639-1 code. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt ug",
    "semitic": "ar he mt am",
    "indic": "hi bn mr gu pa ne si ur as or",
    "dravidian": "ta te kn ml",
    "celtic": "ga gd cy br",
}
UNKNOWN = "und"
PER_LANGUAGE = 800
MOST_LANGUAGES = 500
DIMENSIONS = 1 << 15
GRAMS = (2, 3, 4)
SCALE = 20.0
SLOPE = 4.0
SLICE_BYTES = 1 << 20


def family_of(lang: str) -> str:
    code = lang.replace("_", "-").split("-")[0].lower()
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), code)


def _letters_only() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 0x20
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


LETTERS = _letters_only()


def gram_hashes(data: np.ndarray) -> list[np.ndarray]:
    """For each length in ``GRAMS`` the hash of the n-gram at each byte, whether or not it ends within its row."""
    text = LETTERS[data]
    out = []
    for n in GRAMS:
        size = max(0, len(text) - n + 1)
        hashed = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            hashed = (hashed ^ text[k : k + size]) * np.uint32(0x01000193)
        hashed ^= hashed >> np.uint32(15)
        out.append((hashed & np.uint32(DIMENSIONS - 1)).astype(np.int32))
    return out


def gram_counts(bounds: np.ndarray) -> np.ndarray:
    """How many n-grams each row has, all lengths together."""
    return sum(np.maximum(0, np.diff(bounds) - n + 1) for n in GRAMS)


def lowered(column: pa.Array) -> pa.Array:
    return pa.compute.utf8_lower(column)


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], sides: np.ndarray, cost: float = 4.0, rounds: int = 12) -> np.ndarray:
    """Weights of a linear SVM (squared hinge loss, dual coordinate descent); the last weight is the bias."""
    weights, alpha = np.zeros(DIMENSIONS + 1), np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for _, v in rows]) + 1.0 / (2.0 * cost)
    for turn in range(rounds):
        for i in np.random.default_rng(turn).permutation(len(rows)):
            index, value = rows[i]
            side = sides[i]
            slope = side * (weights[index] @ value + weights[-1]) - 1.0 + alpha[i] / (2.0 * cost)
            moved = max(alpha[i] - slope / norms[i], 0.0)
            if (step := moved - alpha[i]) != 0.0:
                weights[index] += step * side * value
                weights[-1] += step * side
                alpha[i] = moved
    return weights


@dataclass
class LanguageModel:
    """Families with their languages; weights by ``("family", name)`` and ``("pair", a, b)`` (positive: a)."""

    families: dict[str, list[str]]
    weights: dict[tuple[str, ...], np.ndarray] = field(default_factory=dict)

    def tasks(self) -> list[tuple[str, ...]]:
        rest = [("family", f) for f in self.families] if len(self.families) > 1 else []
        return rest + [("pair", a, b) for langs in self.families.values() for a, b in combinations(langs, 2)]

    def predict(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row: the product of the logistic of the family's margin and the mean logistic of
        the margins of the language's pairs."""
        hashes, sizes = gram_hashes(data), np.maximum(1, gram_counts(bounds))

        def margin(task: tuple[str, ...]) -> np.ndarray:
            out, w = np.zeros(len(sizes)), self.weights[task]
            for n, hashed in zip(GRAMS, hashes, strict=True):
                full = np.flatnonzero(np.diff(bounds) >= n)
                if len(full):
                    # sums from the first n-gram of a row to its last, and between, which are passed over
                    edges = np.column_stack((bounds[full], bounds[full + 1] - n + 1)).ravel()
                    known = np.append(w[hashed], 0.0)
                    out[full] += np.add.reduceat(known, edges)[::2]
            return out * SCALE / sizes + w[-1]

        def logistic(x: np.ndarray) -> np.ndarray:
            return 1.0 / (1.0 + np.exp(-np.clip(SLOPE * x, -60, 60)))

        names = list(self.families)
        lang, score = np.empty(len(sizes), dtype=object), np.ones(len(sizes))
        if len(names) > 1:
            margins = np.stack([margin(("family", f)) for f in names])
            chosen = margins.argmax(axis=0)
            score *= logistic(margins.max(axis=0))
        else:
            chosen = np.zeros(len(sizes), dtype=np.int64)
        for place, name in enumerate(names):
            langs, mine = self.families[name], chosen == place
            votes, sums, sure = (np.zeros((len(langs), len(sizes))) for _ in range(3))
            for i, j in combinations(range(len(langs)), 2):
                m = margin(("pair", langs[i], langs[j]))
                votes[i] += m >= 0
                votes[j] += m < 0
                sums[i] += m
                sums[j] -= m
                sure[i] += logistic(m)
                sure[j] += logistic(-m)
            best = np.lexsort((sums, votes), axis=0)[-1]
            lang[mine] = np.array(langs, dtype=object)[best[mine]]
            if len(langs) > 1:
                score[mine] *= (sure[best, np.arange(len(sizes))] / (len(langs) - 1))[mine]
        return lang, np.round(score, 6)


def _prepared(docs: DataFrame, key: str, text: str, *more) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("key"), whole.alias("text"), whole.rlike(r"\p{L}").alias("lettered"), *more)


def fit_languages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, seed: str = "langid"
) -> LanguageModel | None:
    """Fit on the rows given; rows with a null ``lang`` or without a letter are passed over. None without such rows."""
    spark = docs.sparkSession
    ship_package(spark)
    labelled = _prepared(docs, key, text, F.col(lang).cast("string").alias("label")).where("label IS NOT NULL AND lettered")
    counts = labelled.groupBy("label").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return None
    families: dict[str, list[str]] = {}
    for label in sorted(r["label"] for r in counts):
        families.setdefault(family_of(label), []).append(label)
    model = LanguageModel(dict(sorted(families.items())))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["label"], min(1.0, per_language / r["count"]))])
    sample = labelled.where(unit_interval(F.lit(seed), F.col("key")) < share[F.col("label")])
    tasks = model.tasks()
    if not tasks:
        return model
    uses = {label: [] for langs in model.families.values() for label in langs}
    for number, task in enumerate(tasks):
        for label in uses:
            if task[0] == "family":
                uses[label].append((number, 1 if family_of(label) == task[1] else -1))
            elif label in task[1:]:
                uses[label].append((number, 1 if label == task[1] else -1))
    table = spark.createDataFrame([(label, n, side) for label, pairs in uses.items() for n, side in pairs], "label string, task int, side int")
    vectors = sample.select("key", "text", "label").mapInArrow(tidied(_vectors), "key string, label string, idx array<int>, val array<float>")

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "label"], kind="stable")
        data = [(np.asarray(i), np.asarray(v, dtype=np.float64)) for i, v in zip(rows["idx"], rows["val"], strict=True)]
        weights = fit_svm(data, rows["side"].to_numpy(dtype=np.float64))
        return pd.DataFrame({"task": [int(rows["task"].iloc[0])], "weights": [weights.astype(np.float32).tolist()]})

    fitted = vectors.join(F.broadcast(table), "label").groupBy("task").applyInPandas(train, "task int, weights array<float>")
    for row in fitted.collect():  # as many rows as classifiers, whatever the data
        model.weights[tasks[row["task"]]] = np.array(row["weights"], dtype=np.float64)
    return model


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            data, bounds = text_bytes(lowered(part.column("text")))
            hashes, sizes = gram_hashes(data), np.maximum(1, gram_counts(bounds))
            idx, val = [], []
            for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                own = np.concatenate([h[a : max(a, b - n + 1)] for n, h in zip(GRAMS, hashes, strict=True)])
                i, n = np.unique(own, return_counts=True)
                idx.append(i)
                val.append((n * (SCALE / sizes[row])).astype(np.float32))
            keys = pa.array([None if k is None else str(k) for k in part.column("key").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [keys, part.column("label"), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))],
                names=["key", "label", "idx", "val"],
            )


def identify_languages(
    docs: DataFrame, model: LanguageModel | None, text: str = "text", marks: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """All columns of ``docs`` with the language and its score under the names ``marks`` (older columns by these give way).

    Null texts and texts without a letter get ``und`` and 0; so does everything if there is no model. Repeated rows get
    equal predictions; very long texts are read whole.
    """
    spark = docs.sparkSession
    ship_package(spark)
    plain = docs.drop(*marks)
    rest = plain.columns
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    given = plain.withColumn("__lettered", whole.rlike(r"\p{L}"))
    shared = spark.sparkContext.broadcast(model)
    schema = plain.select(*rest).schema.add(marks[0], "string").add(marks[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                known = part.column("__lettered").to_numpy(zero_copy_only=False).astype(bool)
                if fitted is None:
                    lang, score = np.full(part.num_rows, UNKNOWN, dtype=object), np.zeros(part.num_rows)
                else:
                    lang, score = fitted.predict(*text_bytes(lowered(part.column(text).fill_null(""))))
                    lang[~known], score[~known] = UNKNOWN, 0.0
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in rest), pa.array(lang, pa.string()), pa.array(score)], names=schema.names
                )

    return given.mapInArrow(tidied(run), schema)


def held_out(key: str = "doc_id"):
    """Rows kept from training by the contract of the query."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    out = F.coalesce(held_out(), F.lit(False))
    model = fit_languages(docs.where(~out))
    named = identify_languages(docs.select("doc_id", "text", out.alias("held_out")), model)
    return named.select("doc_id", "held_out", "lang_pred", "score")
