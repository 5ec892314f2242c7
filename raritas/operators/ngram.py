"""Character n-gram detector for string attributes.

A token is unusual for a feature set when its frequency leaves a band around the average frequency of the
distinct tokens, on either side. Rows are scored by the unusual tokens they contain, attributes by how often
unusual tokens of their sets are hit.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raritas.functions.runtime import cut_lineage
from raritas.functions.text import bound, explode_grams, gram_array, head, literal, tail, tokens_with_attributes
from raritas.operators.featuresets import FeatureSet, feature_sets
from raritas.plans.joins import HOT_PARTS, join_by_counted_key

ROW_COLUMNS = {1: "single_ngram", 2: "pairs_ngram", 3: "triplets_ngram"}


def ngrams(df: DataFrame, key: str, attrs: list[str], n: int = 3, n_att: int = 1) -> DataFrame:
    """All n-grams of every set of ``n_att`` attributes, concatenated without separator: (key, set_id, token)."""
    if n_att not in (1, 2, 3):
        raise ValueError("n_att must be 1, 2 or 3")
    sets = feature_sets(len(attrs), n_att, n_att)
    if not sets:
        return df.select(key, F.lit(0).alias("set_id"), F.lit("").alias("token")).where(F.lit(False))
    values = F.array(*[F.col(a) for a in attrs])
    table = literal([[s.set_id, *s.attrs] for s in sets])

    def whole(row: Column) -> Column:
        def joined(s: Column) -> Column:
            text = F.aggregate(F.slice(s, 2, n_att), F.lit(""), lambda left, a: F.concat(left, F.get(row, a)))
            return F.struct(s[0].alias("set_id"), text.alias("text"))

        return F.transform(table, joined)

    # The outer generator keeps the optimizer from copying the whole expression into a filter below.
    return explode_grams(df.select(key, F.inline_outer(bound(values, whole))), "text", n)


def token_frequency(grams: DataFrame) -> DataFrame:
    """Occurrences of every distinct token of every set."""
    return grams.groupBy("set_id", "token").agg(F.count(F.lit(1)).alias("frequency"))


def _row_parts(attrs: list[str], n: int) -> Column:
    """The row's values with their first and last n - 1 characters and their lengths, each taken once."""
    values = F.array(*[F.col(a) for a in attrs])
    return bound(
        values,
        lambda v: F.struct(
            v.alias("text"),
            F.transform(v, lambda t: head(t, n - 1)).alias("head"),
            F.transform(v, lambda t: tail(t, n - 1)).alias("tail"),
            F.transform(v, F.length).alias("size"),
        ),
    )


def _pair_seam(row: Column, i: Column, j: Column) -> Column:
    return F.concat(F.get(row["tail"], i), F.get(row["head"], j))


def _triplet_seam(row: Column, i: Column, j: Column, k: Column, n: int) -> Column:
    return F.concat(tail(F.concat(F.get(row["tail"], i), F.get(row["tail"], j)), n - 1), F.get(row["head"], k))


def set_frequencies(df: DataFrame, attrs: list[str], n: int, sets: list[FeatureSet]) -> DataFrame:
    """Token frequency for all ``sets`` at once: (set_id, token, frequency, tested).

    The n-grams of a concatenation are those of its parts plus those across the seams, and a seam touches only
    n-1 characters on each side. So every text is tokenised once, however many sets it belongs to, and counts are
    combined before they are handed to the sets. The second seam of a triplet is that of its last two values unless
    the middle value has fewer than n - 1 characters; only such rows have a text of their own for it. The pieces are
    literal lists walked by one expression, so the plan has one size whatever the number of sets. ``features`` of a set
    name the attributes whose values are searched for its tokens; ``tested`` marks tokens occurring in one of those.
    """
    singles = sorted({a for s in sets for a in (*s.attrs, *s.features)})
    pairs = sorted({p for s in sets if s.arity > 1 for p in (s.attrs[:2], s.attrs[-2:])}) if n > 1 else []
    triplets = [s for s in sets if s.arity == 3] if n > 1 else []
    one = {a: place for place, a in enumerate(singles)}
    two = {p: len(one) + 2 * place for place, p in enumerate(pairs)}  # the next number: first value shorter than n - 1
    three = {s.set_id: len(one) + 2 * len(two) + place for place, s in enumerate(triplets)}

    def texts(row: Column) -> Column:
        def piece(number: Column, text: Column) -> Column:
            return F.struct(number.alias("piece"), text.alias("text"))

        def short(i: Column) -> Column:
            return F.get(row["size"], i) < n - 1

        parts = [F.transform(literal(list(one.items())), lambda s: piece(s[1], F.get(row["text"], s[0])))]
        if pairs:
            table = literal([(number, *p) for p, number in two.items()])
            parts.append(F.transform(table, lambda s: piece(s[0] + short(s[1]).cast("int"), _pair_seam(row, s[1], s[2]))))
        if triplets:
            table = literal([(three[s.set_id], *s.attrs) for s in triplets])
            own = F.filter(table, lambda s: short(s[2]))
            parts.append(F.transform(own, lambda s: piece(s[0], _triplet_seam(row, s[1], s[2], s[3], n))))
        return F.concat(*parts)

    roles: list[tuple[int, int, int, int]] = []
    for s in sets:
        roles += [(one[a], s.set_id, int(a in s.attrs), int(a in s.features)) for a in sorted({*s.attrs, *s.features})]
        if pairs and s.arity > 1:
            roles += [(two[s.attrs[:2]] + shorter, s.set_id, 1, 0) for shorter in (0, 1)]
        if pairs and s.arity == 3:
            roles += [(two[s.attrs[1:]], s.set_id, 1, 0), (three[s.set_id], s.set_id, 1, 0)]
    counted = (
        explode_grams(df.select(F.inline_outer(bound(_row_parts(attrs, n), texts))), "text", n)
        .groupBy("piece", "token")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )
    # The roles follow from the schema alone, not from the data.
    table = df.sparkSession.createDataFrame(roles, "piece int, set_id int, member int, tested int")
    return (
        counted.join(F.broadcast(table), "piece")
        .groupBy("set_id", "token")
        .agg(F.sum(F.col("occurrences") * F.col("member")).alias("frequency"), F.max("tested").alias("tested"))
    )


def with_band(freq: DataFrame, th: float) -> DataFrame:
    """Add ``average`` (over the distinct tokens of the set) and ``unusual`` to a frequency table."""
    average = freq.where("frequency > 0").groupBy("set_id").agg(F.avg("frequency").alias("average"))
    low = F.col("average") - F.col("average") * F.lit(th)
    high = F.col("average") + F.col("average") * F.lit(th)
    unusual = (F.col("frequency") > 0) & ((F.col("frequency") < low) | (F.col("frequency") > high))
    # One row per feature set: the size of this side follows from the schema.
    return freq.join(F.broadcast(average), "set_id", "left").withColumn("unusual", unusual)


def outlier_tokens(df: DataFrame, attrs: list[str], n: int, th: float, max_arity: int = 3) -> DataFrame:
    """Tokens outside the frequency band: (set_id, token, frequency, average)."""
    freq = cut_lineage(set_frequencies(df, attrs, n, feature_sets(len(attrs), max_arity)))
    return with_band(freq, th).where("unusual").select("set_id", "token", "frequency", "average")


def _search_sets(d: int, compat: bool) -> list[FeatureSet]:
    sets = feature_sets(d)
    if not compat:
        return sets
    found = []
    for s in sets:
        if s.arity == 3:
            i, j, k = s.attrs
            s = FeatureSet(s.set_id, s.attrs, (i, j, k - i))
        found.append(s)
    return found


def _row_scores(df: DataFrame, key: str, attrs: list[str], n: int, th: float, sets: list[FeatureSet]) -> DataFrame:
    """Count, per row and set size, the distinct unusual tokens found in the searched attributes.

    Counting is turned round: from all distinct tokens of a row, subtract those inside the band. A token inside
    the band has about the average frequency, so either the vocabulary is small enough to broadcast or no such
    token is frequent enough to crowd a task.
    """
    arities = sorted({s.arity for s in sets})
    freq = cut_lineage(set_frequencies(df, attrs, n, sets))
    banded = with_band(freq, th).where("tested = 1")
    share = (freq.agg(F.sum("frequency")).first()[0] or 0) / len(sets)
    usual = ~F.col("unusual")
    bits = SetBits(len(attrs), sets)
    number = F.col("set_id") - min(s.set_id for s in sets)
    words = (
        # Very frequent tokens stay in the table even when unusual, so that the join can treat them apart.
        banded.where(usual | (F.col("frequency") > share / HOT_PARTS))
        .groupBy("token", F.get(literal(bits.words), number).alias("word"))
        .agg(
            F.bit_or(F.when(usual, F.get(literal([f"{1 << p}L" for p in bits.places]), number))).alias("bits"),
            F.max("frequency").alias("rows"),
        )
    )
    inside = words.groupBy("token").agg(
        F.collect_list(F.when(F.col("bits").isNotNull(), F.struct("word", "bits"))).alias("inside"), F.max("rows").alias("rows")
    )
    found = tokens_with_attributes([F.col(a) for a in attrs], n)
    tokens = df.select(key, F.explode_outer(found).alias("token", "holders"))
    weight = F.octet_length("token") + F.size("inside") * 12 + 64
    joined = join_by_counted_key(tokens, inside, ["token"], "rows", weight)

    def hits(arity: int) -> Column:
        touched = _sets_touched(len(attrs), arity, sets)
        none = F.when(F.col("inside").isNull(), 0).otherwise(bits.count_touched("inside", "holders", arity))
        return F.coalesce(touched, F.lit(0)) - none

    return joined.groupBy(key).agg(
        *[F.sum(hits(arity)).cast("bigint").alias(ROW_COLUMNS[arity]) for arity in arities]
    )


class SetBits:
    """Sets as bits of 63-bit words, those of one size in words of their own; a token's sets are some words.

    A word of a token and the same word of an attribute's sets meet in one operation, so a token with all sets of d
    attributes takes about d ** 3 / 48 bytes and is compared with the holders of a row in as many steps of 63 sets.
    """

    WIDTH = 63  # the sign stays out

    def __init__(self, d: int, sets: list[FeatureSet]):
        self.words, self.places, self.first = [], [], {}
        word = 0
        for arity in sorted({s.arity for s in sets}):
            alike = [s for s in sets if s.arity == arity]  # neighbouring numbers
            self.first[arity] = word
            self.words += [word + i // self.WIDTH for i in range(len(alike))]
            self.places += [i % self.WIDTH for i in range(len(alike))]
            word += -(-len(alike) // self.WIDTH)
        self.first[max(self.first, default=0) + 1] = word
        masks = [[0] * word for _ in range(d)]
        for s, at, place in zip(sets, self.words, self.places):
            for a in s.features:
                masks[a][at] |= 1 << place
        self.masks = masks

    def count_touched(self, inside: str, holders: str, arity: int) -> Column:
        """How many sets of a size are in the words ``inside`` and search one of the attributes ``holders``."""
        masks = literal([[f"{m}L" for m in line] for line in self.masks])
        low, high = self.first[arity], min(w for a, w in self.first.items() if a > arity)

        def touched(entry: Column) -> Column:
            own = F.aggregate(F.col(holders), F.lit(0).cast("bigint"), lambda left, a: left.bitwiseOR(F.get(F.get(masks, a), entry["word"])))
            return F.bit_count(entry["bits"].bitwiseAND(own))

        of_size = F.filter(inside, lambda e: (e["word"] >= low) & (e["word"] < high))
        return F.aggregate(of_size, F.lit(0), lambda left, e: left + touched(e))


def _sets_touched(d: int, arity: int, sets: list[FeatureSet]) -> Column:
    """How many sets of a size search at least one attribute of ``holders``."""
    chosen = [s for s in sets if s.arity == arity]
    if all(s.features == s.attrs for s in chosen):
        # All sets of that size: those touched are all but the ones drawn from the other attributes.
        by_count = [comb(d, arity) - comb(d - count, arity) for count in range(d + 1)]
        return F.get(literal(by_count), F.size("holders"))
    return F.size(F.filter(literal([s.features for s in chosen]), lambda f: F.arrays_overlap(f, F.col("holders"))))


def ngram_detect(
    df: DataFrame, key: str, attrs: list[str], n: int = 3, th: float = 0.3, compat: bool = False
) -> DataFrame:
    """Row scores (key, single_ngram, pairs_ngram, triplets_ngram).

    A pair or triplet scores a row when one of its values contains the token by itself; tokens found only across
    the seam of two values do not count here. ``compat`` repeats two oddities of the original rule: triplets
    always use 3-grams, and the third attribute searched for a triplet (i, j, k) is number k - i.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if not attrs:
        raise ValueError("no string attribute to work on")
    sets = _search_sets(len(attrs), compat)
    if compat and n != 3 and len(attrs) >= 3:
        small = _row_scores(df, key, attrs, n, th, [s for s in sets if s.arity < 3])
        large = _row_scores(df, key, attrs, 3, th, [s for s in sets if s.arity == 3])
        scored = small.join(large, key)
    else:
        scored = _row_scores(df, key, attrs, n, th, sets)
    absent = [c for c in ROW_COLUMNS.values() if c not in scored.columns]
    return scored.select(key, *[F.lit(0).cast("bigint").alias(c) if c in absent else c for c in ROW_COLUMNS.values()])


def with_final_score(scores: DataFrame) -> DataFrame:
    return scores.withColumn("final_score", reduce(lambda a, b: a + b, [F.col(c) for c in ROW_COLUMNS.values()]))


def attribute_hits(df: DataFrame, attrs: list[str], n: int = 3, th: float = 0.1) -> DataFrame:
    """Score of every attribute: (attr, score).

    For each set, every unusual token counts once per row whose concatenated text contains it, and each such hit
    is credited to all attributes of the set. Row numbers per token are additive over (a) rows holding the token
    inside a value and (b) rows holding it across a seam only, so no table at row level is ever shuffled.
    """
    if not attrs:
        raise ValueError("no string attribute to work on")
    d = len(attrs)
    sets = feature_sets(d)
    zero = F.lit(0).cast("bigint")
    inside = (
        df.select(F.explode_outer(tokens_with_attributes([F.col(a) for a in attrs], n)).alias("token", "holders"))
        .where("token is not null")
        .groupBy("token", "holders")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    members = literal([s.attrs for s in sets])
    # The numbers of the sets that hold one of the attributes; a set's place in the list is its number.
    touched = F.filter(
        F.transform(members, lambda m, i: F.when(F.arrays_overlap(m, F.col("holders")), i)), lambda i: i.isNotNull()
    )
    holding = inside.select("token", "rows", F.explode_outer(touched).alias("set_id")).select(
        "set_id", "token", zero.alias("frequency"), "rows"
    )
    parts = [holding]
    if n > 1 and d > 1:
        parts.append(
            df.select(F.inline_outer(_crossing_tokens(attrs, sets, n)))
            .select("set_id", F.explode_outer("tokens").alias("token"))
            .where("token is not null")
            .groupBy("set_id", "token")
            .agg(F.count(F.lit(1)).alias("rows"))
            .select("set_id", "token", zero.alias("frequency"), "rows")
        )
    freq = set_frequencies(df, attrs, n, sets)
    parts.append(freq.select("set_id", "token", "frequency", zero.alias("rows")))
    merged = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("set_id", "token")
        .agg(F.sum("frequency").alias("frequency"), F.sum("rows").alias("rows"))
    )
    per_set = with_band(cut_lineage(merged), th).where("unusual").groupBy("set_id").agg(F.sum("rows").alias("rows"))
    credited = per_set.select(F.explode(F.get(members, F.col("set_id"))).alias("attr"), "rows")
    # One zero row per attribute keeps attributes without any hit in the result.
    every = df.sparkSession.range(d).select(F.col("id").cast("int").alias("attr"), zero.alias("rows"))
    return credited.unionByName(every).groupBy("attr").agg(F.sum("rows").alias("score"))


def _crossing_tokens(attrs: list[str], sets: list[FeatureSet], n: int) -> Column:
    """For each pair and triplet the distinct tokens across its seams that none of its values contains."""

    def only(row: Column, grams: Column, members: list[Column]) -> Column:
        def beyond(t: Column) -> Column:
            return ~reduce(lambda a, b: a | b, [F.contains(F.get(row["text"], a), t) for a in members])

        return F.filter(F.array_distinct(grams), beyond)

    def crossing(row: Column) -> Column:
        def pair(s: Column) -> Column:
            grams = gram_array(_pair_seam(row, s[1], s[2]), n)
            return F.struct(s[0].alias("set_id"), only(row, grams, [s[1], s[2]]).alias("tokens"))

        def triplet(s: Column) -> Column:
            grams = F.concat(gram_array(_pair_seam(row, s[1], s[2]), n), gram_array(_triplet_seam(row, s[1], s[2], s[3], n), n))
            return F.struct(s[0].alias("set_id"), only(row, grams, [s[1], s[2], s[3]]).alias("tokens"))

        found = [
            F.transform(literal([(s.set_id, *s.attrs) for s in sets if s.arity == arity]), body)
            for arity, body in ((2, pair), (3, triplet))
            if any(s.arity == arity for s in sets)
        ]
        return F.concat(*found)

    return bound(_row_parts(attrs, n), crossing)


def attribute_maximum(df: DataFrame, attrs: list[str], n: int = 3) -> DataFrame:
    """Normaliser of the attribute score: (attr, name, maximum).

    The possible token positions of an attribute alone, of its ordered pairs (twice per pair) and of its ordered
    triplets (six times per triplet), summed over rows. With the total length L of each attribute, T of all, and
    K = rows * (n - 1), the sums over the others close to terms in L, T and K. Texts shorter than n - 1 contribute
    negative terms, which are kept.
    """
    d = len(attrs)
    totals = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(*[F.coalesce(F.sum(F.length(a).cast("bigint")), F.lit(0).cast("bigint")) for a in attrs]).alias("sizes"),
    )
    whole = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda left, size: left + size)
    lines = totals.select("rows", whole.alias("whole"), F.posexplode_outer("sizes").alias("attr", "size"))
    own = F.col("size") - F.col("rows") * (n - 1)
    others = F.col("whole") - F.col("size")
    pairs = own * (d - 1) + others
    triplets = own * comb(d - 1, 2) + others * (d - 2)
    names = F.get(F.array(*map(F.lit, attrs)), F.col("attr"))
    return lines.select("attr", names.alias("name"), (own + pairs * 2 + triplets * 6).alias("maximum"))


def attribute_normalized(df: DataFrame, attrs: list[str], n: int = 3, th: float = 0.1) -> DataFrame:
    """(attr, name, score, maximum, normalized_score); the ratio is null where the maximum is zero."""
    return (
        attribute_maximum(df, attrs, n)
        .join(attribute_hits(df, attrs, n, th), "attr")
        .select("attr", "name", "score", "maximum", F.try_divide("score", "maximum").alias("normalized_score"))
    )
