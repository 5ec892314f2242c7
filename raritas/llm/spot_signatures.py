"""Document fingerprints by spot signatures, in DataFrame functions alone.

An anchor is a common word. Its signature is the anchor and the next ``chain`` content words (words that are no anchors)
among the ``reach`` words behind it. A text's signatures are a set; its fingerprint is a digest of the sorted set. A text
with words but without a signature has its whole word sequence as its only one; a text without a word has none.

Sets are compared by Jaccard likeness with pruning: sets are partitioned by their length so that a pair that can reach
``PRUNE`` lies in one partition or in two neighbours. Pairs farther apart, or whose lengths alone bound the likeness
below it, get 0.0 without a look at their members; all other likenesses are exact.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raritas.llm.common import keyed_text

# Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from had has have he her his in is it of on or she that the they this to was were which with"
    " au aux avec ce dans des du elle est et il je la le les ne ou par pas pour que qui se son sur un une"
    " als auch auf das dem den der die ein eine er es für ich ihr im ist mit nach nicht sich sie und von wie zu"
    " al como con del el en las lo los más me no para pero por su una y"
).split()
CHAIN = 3
REACH = 16
PRUNE = 0.1
WORD_GAP = r"[^\p{L}\p{N}]+"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN, reach: int = REACH) -> Column:
    """The set of signatures of a text as an array of distinct strings; empty for a text without a word."""
    anchors = sorted(set(anchors))
    words = F.filter(F.split(F.lower(text), WORD_GAP), lambda w: w != "")

    def behind(all_words: Column, place: Column) -> Column:
        return F.slice(F.filter(F.slice(all_words, place + 2, reach), lambda w: ~w.isin(anchors)), 1, chain)

    def spots(ws: Column) -> Column:
        chains = F.transform(ws, lambda w, i: F.when(w.isin(anchors), F.concat_ws(":", F.array(w), behind(ws, i))))
        return F.array_distinct(F.filter(chains, lambda s: s.contains(":")))

    def or_whole(ws: Column, found: Column) -> Column:
        return F.when(F.size(found) > 0, found).otherwise(F.filter(F.array(F.array_join(ws, " ")), lambda s: s != ""))

    return bound(words, lambda ws: bound(spots(ws), lambda found: or_whole(ws, found)))


def fingerprint(spots: Column) -> Column:
    return F.md5(F.array_join(F.sort_array(spots), ","))


def length_partition(size: Column, threshold: float = PRUNE) -> Column:
    """Number of the length partition: sets whose likeness reaches ``threshold`` are in one or in two neighbours; empty
    sets are in one of their own, which is no neighbour."""
    place = F.log(size.cast("double")) / F.lit(-log(threshold)) + F.lit(1e-9)  # whole powers stand at their own place
    return F.when(size > 0, F.floor(place)).otherwise(F.lit(-2)).cast("int")


def likeness(a: Column, b: Column, threshold: float = PRUNE) -> Column:
    """Jaccard likeness of two sets, 0.0 where their lengths keep it below ``threshold``. Two empty sets are equal (1.0)."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    apart = F.abs(length_partition(F.size(a), threshold) - length_partition(F.size(b), threshold)) > 1
    value = bound(F.size(F.array_intersect(a, b)), lambda common: common / (small + large - common))
    return F.when(large == 0, F.lit(1.0)).when(apart | (small < large * threshold), F.lit(0.0)).otherwise(value)


def _bucket(key: Column, splits: list[int]) -> Column:
    """How many of the ascending ``splits`` are below the key, found in two steps of about the square root of them."""
    if not splits:
        return F.lit(0)
    step = max(1, int(len(splits) ** 0.5))
    groups = [splits[i : i + step] for i in range(0, len(splits), step)]
    ends = F.array(*[F.lit(g[-1]).cast("long") for g in groups])
    rows = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in [*groups, [splits[-1]]]])
    group = F.size(F.filter(ends, lambda e: e < key))
    inside = F.size(F.filter(F.element_at(rows, group + 1), lambda e: e < key))
    return F.when(group == len(groups), F.lit(len(splits))).otherwise(group * step + inside)


def beside_next(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, Window]:
    """Rows key, text, next_text and a window in which the next row stands behind each; ``copied`` rows only serve as next.

    The next row is the one of the next smaller key, and of the largest key for the last one (null keys are smallest,
    equal keys ordered by a hash of the text). Keys are cut into ranges at values that occur, so the first row of a range
    is known beforehand and is copied to the end of the range above; the first row of all is copied to the end of the
    last range. One shuffle, whatever the ranges.
    """
    spark = docs.sparkSession
    given = keyed_text(docs, key, text).withColumn("k", F.coalesce(F.col("key").cast("long"), F.lit(-(1 << 63)).cast("long")))
    parts = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    shares = [i / parts for i in range(1, parts)]
    ends = given.agg(F.percentile_approx("k", shares, 20 * parts).alias("s"), F.max("k").alias("top")).first()
    splits, top = sorted(set(ends["s"] or [])), ends["top"]
    own = _bucket(F.col("k"), splits)
    at_split = F.col("k").isin(splits) if splits else F.lit(False)
    places = F.array(
        F.struct(own.alias("bucket"), F.lit(False).alias("copied"), F.lit(0).alias("turn")),
        F.when(at_split, F.struct((own + 1).alias("bucket"), F.lit(True).alias("copied"), F.lit(0).alias("turn"))),
        F.when(F.col("k") == F.lit(top).cast("long"), F.struct(F.lit(0).alias("bucket"), F.lit(True).alias("copied"), F.lit(1).alias("turn"))),
    )
    dealt = given.withColumn("p", F.explode(F.filter(places, lambda p: p.isNotNull()))).select("key", "text", "k", "p.*")
    order = Window.partitionBy("bucket").orderBy("turn", F.desc("k"), "tie")
    return dealt.withColumn("tie", F.xxhash64("text")).withColumn("next_text", F.lead("text").over(order)), order


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next text's.

    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures and the
    set's length_partition. Null texts
    are empty. Repeated rows are rows of their own. The edited text replaces the last third of the code points by as many
    first ones of the next text, or all it has. An empty table gives no rows.
    """
    placed, order = beside_next(docs, key, text)
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), size - third), F.coalesce(F.col("next_text").substr(F.lit(1), third), F.lit("")))
    spotted = placed.withColumn("edited", edited).withColumn("spots", signatures(F.col("text")))
    # the copied rows stand behind the row whose next they are, with signatures of their own
    paired = spotted.withColumn("next_spots", F.lead("spots").over(order)).where("not copied")
    paired = paired.withColumn("edited_spots", signatures(F.col("edited")))
    return paired.select(
        F.col("key").alias(key),
        size.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
        F.size("spots").cast("long").alias("n_signatures"),
        length_partition(F.size("spots")).alias("length_partition"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{folder}/documents.parquet"))


_LIST = ", ".join(f"'{a}'" for a in sorted(set(ANCHORS)))


def _spots_sql(words: str) -> str:
    chains = (
        f"list_distinct(list_filter(list_transform({words}, lambda w, i: CASE WHEN list_contains(anchors, w) AND"
        f" len(list_filter({words}[i+1:i+{REACH}], lambda y: NOT list_contains(anchors, y))) > 0 THEN w || ':' ||"
        f" array_to_string(list_filter({words}[i+1:i+{REACH}], lambda y: NOT list_contains(anchors, y))[1:{CHAIN}], ':') END),"
        f" lambda s: s IS NOT NULL))"
    )
    return f"CASE WHEN len({chains}) > 0 THEN {chains} WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE []::VARCHAR[] END"


SQL = f"""
WITH given AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ordered AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text
  FROM given),
edits AS (
  SELECT doc_id, text, next_text, length(text) AS n_chars,
         substr(text, 1, length(text) - length(text) // 3) || substr(next_text, 1, length(text) // 3) AS edited FROM ordered),
words AS (
  SELECT *, [{_LIST}] AS anchors,
         list_filter(string_split_regex(lower(text), '{WORD_GAP}'), lambda x: x <> '') AS w1,
         list_filter(string_split_regex(lower(edited), '{WORD_GAP}'), lambda x: x <> '') AS w2
  FROM edits),
spots AS (SELECT doc_id, n_chars, edited, {_spots_sql("w1")} AS s1, {_spots_sql("w2")} AS s2 FROM words),
paired AS (
  SELECT *, coalesce(lead(s1) OVER (ORDER BY doc_id DESC), first_value(s1) OVER (ORDER BY doc_id DESC)) AS s3 FROM spots),
counted AS (SELECT *, len(list_intersect(s1, s2)) AS c2, len(list_intersect(s1, s3)) AS c3 FROM paired)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256,
       md5(array_to_string(list_sort(s1), ',')) AS fingerprint,
       md5(array_to_string(list_sort(s2), ',')) AS edited_fingerprint,
       CASE WHEN len(s1) + len(s2) = 0 THEN 1.0 WHEN least(len(s1), len(s2)) < greatest(len(s1), len(s2)) * {PRUNE}::DOUBLE THEN 0.0
            ELSE c2 / (len(s1) + len(s2) - c2) END AS near_edited,
       CASE WHEN len(s1) + len(s3) = 0 THEN 1.0 WHEN least(len(s1), len(s3)) < greatest(len(s1), len(s3)) * {PRUNE}::DOUBLE THEN 0.0
            ELSE c3 / (len(s1) + len(s3) - c3) END AS near_next,
       len(s1) AS n_signatures,
       CASE WHEN len(s1) > 0 THEN floor(ln(len(s1)) / -ln({PRUNE}::DOUBLE) + 1e-9)::INTEGER ELSE -2 END AS length_partition
FROM counted
"""
