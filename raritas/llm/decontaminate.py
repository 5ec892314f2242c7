"""Benchmark decontamination by templates: numbers, names and units become typed slots, windows of templates are joined
by hash, and slots are checked for consistency, which also catches questions asked again with other values.

Canonical form. Words are runs of letters and digits. A word with a digit is a ``number`` slot (5kg is one); a unit right after
a number is a ``unit`` slot; a capitalised word that does not begin a sentence is a ``name``
slot; every other word is itself, in lower case. Windows are ``window`` consecutive canonical words of which at least
``least_words`` are no slots (an item with fewer words has one window, the whole of it, if it has that many).

Readings. Windows are read three times: NAMED as above; CASELESS, where a name is a word like others, so that a copy in
other case or without its full stops has the same windows; VERBATIM, where every word is itself, numbers too, and no
least number of plain words is asked for (windows of numbers alone count in verbatim runs only). A share is taken per
reading, of the item's windows that the reading has, and the greatest counts.

Join. The windows of the items are hashed; each text's windows are looked up among them, and those found are joined by
hash. For each pair of document and item, the item's windows found are lined up by the offset between both texts. An
alignment is one offset, or a run of offsets of which neighbours differ by at most DRIFT words (words put in or left out).
A pair is a leak if one alignment by itself holds at least ``share`` of the item's windows and its slots are consistent:
each of the item's slot values stands for one value of the document throughout (of most of its places, ``agreement``),
which holds for a verbatim copy and for a copy with values replaced, but not for a template that merely occurs in both.
A pair is a leak as well, however long the item, if ``run_words`` of its running words occur with equal values.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raritas.functions.runtime import cut_lineage, ship_package
from raritas.llm.common import keyed_text, slices, text_bytes, tidied
from raritas.llm.shingles import hash_spans, run_hashes

WINDOW = 8
LEAST_WORDS = 4
SHARE = 0.3
AGREEMENT = 0.8
RUN_WORDS = 13
DRIFT = 8
# Item windows that are looked up in memory at once; more of them are looked up in further blocks of as many.
BLOCK_WINDOWS = 2_000_000
SLICE_BYTES = 1 << 20
# Stretches of words that repeat after up to so many words are shortened.
MOST_PERIOD = 8

# Units of measure and money.
UNITS = frozenset(
    "mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg lb lbs oz ton tons tonne tonnes ml l liter"
    " liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month"
    " months year years hz khz mhz ghz w kw mw v volt volts a amp amps j kj cal kcal k c f degree degrees percent dollar"
    " dollars cent cents euro euros pound pounds usd eur gbp kmh mph kb mb gb tb".split()
)
WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
NAMED, CASELESS, VERBATIM = 0, 1, 2
SLOTS = ("", "<number>", "<unit>", "<name>")
_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False
_SEPARATOR[128:] = False
_SENTENCE_END = np.zeros(256, dtype=bool)
_SENTENCE_END[list(b".!?:")] = True  # not the line end: texts are wrapped anew


def _changed(data: np.ndarray) -> np.ndarray:
    """Places of the bytes that tell a capital letter (A-Z, and Latin-1 letters in UTF-8) from its small one by 0x20."""
    upper = (data >= 0x41) & (data <= 0x5A)
    if len(data) > 1:
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return upper


def _hashes_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return hash_spans(data, ends - np.diff(ends, prepend=0), ends)


def words_of(data: np.ndarray, bounds: np.ndarray, head_opens: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of all words of all rows, the bounds of each row among them, and whether each begins a sentence.

    ``head_opens``: whether the first word of a row counts as one that does.
    """
    inside = ~_SEPARATOR[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data) > 1:
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
    heads, tails = bounds[:-1][bounds[:-1] < len(data)], bounds[1:][bounds[1:] > 0] - 1
    starts[heads] |= inside[heads]
    ends[tails] |= inside[tails]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    rows = np.searchsorted(begin, bounds)
    stops = np.concatenate(([0], np.flatnonzero(_SENTENCE_END[data]) + 1))
    last_stop = stops[np.searchsorted(stops, begin, side="right") - 1] if len(begin) else begin
    opening = last_stop > np.concatenate(([-1], begin[:-1]))
    opening[rows[:-1][rows[:-1] < len(begin)]] = head_opens
    return begin, end, rows, opening


def canonical(column: pa.Array, head_opens: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of a column: canonical hash, kind of slot, hash of the value; and the bounds of each row.

    A number with a unit stuck to it is one ``number`` slot, as is the number alone, so that 5kg and 7kg agree.
    """
    data, bounds = text_bytes(column)
    begin, end, rows, opening = words_of(data, bounds, head_opens)
    upper = _changed(data)
    hashes = hash_spans(data + (upper.view(np.uint8) << 5), begin, end)

    def within(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
        return total[end] - total[begin]

    digit = within((data >= 0x30) & (data <= 0x39)) > 0
    first = begin + (data[begin] == 0xC3) if len(begin) else begin  # the byte that shows the case of the first letter
    capital = upper[first] & (within(upper) == 1) & (end - first > 1) if len(begin) else digit
    after_number = np.concatenate(([False], digit[:-1])) if len(begin) else digit
    after_number[rows[:-1][rows[:-1] < len(begin)]] = False
    kind = np.select([digit, after_number & np.isin(hashes, _hashes_of(sorted(UNITS))), capital & ~opening], [NUMBER, UNIT, NAME], WORD)
    slot_hash = np.concatenate((np.zeros(1, dtype=np.uint64), _hashes_of(list(SLOTS[1:]))))
    return np.where(kind == WORD, hashes, slot_hash[kind]), kind, hashes, rows


def hash_windows(tokens: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each run of ``length`` words within a row."""
    hashed = run_hashes(tokens, length)
    n = len(hashed)
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    place = np.flatnonzero(owner[:n] == owner[length - 1 :]) if n else np.zeros(0, dtype=np.int64)
    return place, hashed[place].view(np.int64)


def readings(tokens: np.ndarray, kind: np.ndarray, values: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Each reading with its words and, as running totals, those that the reading before holds as slots."""
    totals = [np.concatenate(([0], np.cumsum(mask))) for mask in (kind == NAME, (kind == NUMBER) | (kind == UNIT))]
    return [(NAMED, tokens, np.zeros(0, dtype=np.int64)), (CASELESS, np.where(kind == NAME, values, tokens), totals[0]), (VERBATIM, values, totals[1])]


def periodic_regions(kind: np.ndarray, values: np.ndarray, rows: np.ndarray, reach: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Long stretches of words that repeat with a period of up to MOST_PERIOD words: margin, first words, ends.

    The margin is that within which an alignment of an item of ``reach`` words, moved by one period, stays in the stretch.
    """
    found = []
    for period in range(1, min(MOST_PERIOD, len(values) - 1) + 1):
        same = (values[:-period] == values[period:]) & (kind[:-period] == kind[period:])
        for back in range(1, period + 1):  # a stretch ends with its row
            across = rows[1:-1] - back
            same[across[(across >= 0) & (across < len(same))]] = False
        margin = reach + period + 1
        edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
        first, end = edges[::2], edges[1::2] + period
        long = end - first > 2 * margin
        if long.any():
            found.append((margin, first[long], end[long]))
    return found


def deep_inside(regions: list[tuple[int, np.ndarray, np.ndarray]], place: np.ndarray, length: int) -> np.ndarray:
    """Windows farther than the margin from both ends of a periodic stretch."""
    inside = np.zeros(len(place), dtype=bool)
    for margin, first, end in regions:
        at = np.searchsorted(first, place - margin, side="right") - 1
        inside |= (at >= 0) & (place + length + margin <= end[np.maximum(at, 0)])
    return inside


def _lists(values: np.ndarray, place: np.ndarray, length: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists ``values[place[i] : place[i] + length[i]]``."""
    ends = np.concatenate(([0], np.cumsum(length)))
    take = np.arange(ends[-1]) - np.repeat(ends[:-1] - place, length) if len(place) else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[take].astype(kind.to_pandas_dtype())))


def _rows(keys: pa.Array, rows: np.ndarray, place: np.ndarray, length: np.ndarray, hashed: np.ndarray, kind: np.ndarray, values: np.ndarray) -> list[pa.Array]:
    owner = np.searchsorted(rows, place, side="right") - 1
    return [
        keys.take(pa.array(owner)),
        pa.array((place - rows[owner]).astype(np.int32)),
        pa.array(hashed.astype(np.int64)),
        _lists(kind, place, length, pa.int32()),
        _lists(values.view(np.int64), place, length, pa.int64()),
    ]


def _key_type(df: DataFrame) -> str:
    return df.schema["key"].dataType.simpleString()


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per window and reading of each item: item, item_pos, hash, kinds and item_values of its words, length,
    reading (the strictest with this hash), in_named, in_caseless, in_verbatim (readings whose share counts the window),
    and all_named, all_caseless, all_verbatim, the item's numbers of these.

    An item's first word may stand within a sentence of a text, so windows that begin with it are there in both ways.
    An item with fewer words than ``window`` has one window, of all its words. Items of fewer than ``least_words`` words,
    null and empty ones among them, have no row. Rows that share a key are read as one item each and joined.
    """
    ship_package(items.sparkSession)
    given = keyed_text(items, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                for head_opens in (True, False):
                    tokens, kind, values, rows = canonical(part.column("text"), head_opens)
                    count = np.diff(rows)
                    totals = [np.concatenate(([0], np.cumsum(mask))) for mask in (kind == WORD, (kind == WORD) | (kind == NAME), kind != NUMBER, kind == NAME, kind != WORD)]
                    out = []
                    # names at the head differ in the first reading alone
                    for reading, words, _ in readings(tokens, kind, values)[: 3 if head_opens else 1]:
                        for length in range(least_words, window + 1):
                            place, hashed = hash_windows(words, rows, length)
                            owner = np.searchsorted(rows, place, side="right") - 1
                            whole = ((count[owner] == length) | (length == window)) & (head_opens | (place == rows[owner]))
                            plain, worded, lettered, names_in, slots_in = (t[place + length] - t[place] for t in totals)
                            counted = [plain >= least_words, worded >= least_words, lettered > 0]
                            fit = whole & (counted[reading] if reading < VERBATIM else True)
                            strictest = [np.where(slots_in == 0, VERBATIM, np.where(names_in == 0, CASELESS, NAMED)), np.where(slots_in == names_in, VERBATIM, CASELESS), np.full(len(place), VERBATIM)]
                            out.append([x[fit] for x in (place, np.full(len(place), length), hashed, strictest[reading], *counted)])
                    place, length, hashed, strict, *counted = (np.concatenate(x) for x in zip(*out))
                    columns = _rows(part.column("key"), rows, place, length, hashed, kind, values)
                    extra = [pa.array(length.astype(np.int32)), pa.array(strict.astype(np.int32)), *map(pa.array, counted)]
                    yield pa.RecordBatch.from_arrays([*columns, *extra], names=names)

    counts = ["named", "caseless", "verbatim"]
    names = ["item", "item_pos", "hash", "kinds", "item_values", "length", "reading", *[f"in_{c}" for c in counts]]
    schema = f"item {_key_type(given)}, item_pos int, hash bigint, kinds array<int>, item_values array<bigint>, length int, reading int, in_named boolean, in_caseless boolean, in_verbatim boolean"
    found = given.mapInArrow(tidied(run), schema).dropDuplicates(["item", "item_pos", "hash"])
    totals = found.groupBy(F.col("item").alias("t_item")).agg(*[F.countDistinct(F.when(F.col(f"in_{c}"), F.col("item_pos"))).cast("int").alias(f"all_{c}") for c in counts])
    return found.join(totals, F.col("item").eqNullSafe(F.col("t_item"))).drop("t_item")


def text_hits(docs: DataFrame, hashes: np.ndarray, lengths: list[int], key: str, text: str, reach: int | None = None) -> DataFrame:
    """Windows of the texts whose hash is among ``hashes``: key, pos, hash, doc_values of its words.

    With a ``reach``, the most words of an item, windows deep inside a stretch of repeated words are left out: each
    alignment that they take part in has its like, some periods before and behind, at the ends of the stretch. So a text
    of repeated words has as many windows as an item has words, and not as many as the text.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(np.sort(hashes))
    given = keyed_text(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        # one bit per value of 24 bits of the hash; most windows end here
        sieve = np.zeros(1 << 24, dtype=bool)
        sieve[known & 0xFFFFFF] = True
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                tokens, kind, values, rows = canonical(part.column("text"))
                places, sizes, found = [], [], []
                regions = [] if reach is None else periodic_regions(kind, values, rows, reach)
                for (_, words, slots), length in product(readings(tokens, kind, values), lengths):
                    place, hashed = hash_windows(words, rows, length)
                    maybe = np.flatnonzero(sieve[hashed & 0xFFFFFF])
                    if len(slots):  # without slots the window is that of the reading before
                        maybe = maybe[slots[place[maybe] + length] > slots[place[maybe]]]
                    maybe = maybe[known[np.minimum(np.searchsorted(known, hashed[maybe]), len(known) - 1)] == hashed[maybe]]
                    if regions:
                        maybe = maybe[~deep_inside(regions, place[maybe], length)]
                    places.append(place[maybe])
                    found.append(hashed[maybe])
                    sizes.append(np.full(len(maybe), length))
                place, size, hashed = np.concatenate(places), np.concatenate(sizes), np.concatenate(found)
                columns = _rows(part.column("key"), rows, place, size, hashed, kind, values)
                del columns[3]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "pos", "hash", "doc_values"])

    return given.mapInArrow(tidied(run), f"key {_key_type(given)}, pos int, hash bigint, doc_values array<bigint>")


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    least_words: int = LEAST_WORDS,
    share: float = SHARE,
    agreement: float = AGREEMENT,
    run_words: int = RUN_WORDS,
    shorten: bool = True,
) -> DataFrame:
    """Leaks: key, item key, n_found, share of the item's windows (the greatest of the readings'), agreement, verbatim, first_word, last_word.

    One row per pair of document and item, with the figures of its best alignment or verbatim run. Rows of either table that share a key are judged together. Null and empty
    texts have no windows. Items are a query set: their windows are held in blocks of BLOCK_WINDOWS hashes, each against
    all texts. Hits are rows of matching windows only, so a passage in very many texts gives rows in proportion. Long
    stretches of repeated words are read at their ends only (``shorten``), where every alignment has its like.
    """
    spark = docs.sparkSession
    windows = cut_lineage(item_windows(items, item_key, item_text, window, least_words))
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most window values
    extent = windows.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("item_pos") + F.col("length")).alias("reach")).first()
    blocks = max(1, -(-extent["n"] // BLOCK_WINDOWS))
    parts = []
    for block in range(blocks):
        mine = windows.where(F.pmod("hash", F.lit(blocks)) == block).select("hash").distinct().toPandas()["hash"].to_numpy(dtype=np.int64)
        if len(mine):
            parts.append(text_hits(docs, mine, lengths, key, text, extent["reach"] if shorten else None))
    kind, item_kind = (d.select(F.col(k).alias("key")).schema["key"].dataType.simpleString() for d, k in ((docs, key), (items, item_key)))
    if not parts:
        return spark.createDataFrame([], f"{key} {kind}, {item_key} {item_kind}, n_found long, share double, agreement double, verbatim boolean, first_word int, last_word int")
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    few = blocks == 1  # at most BLOCK_WINDOWS short rows
    lined = hits.join(F.broadcast(windows) if few else windows, "hash").withColumn("shift", F.col("pos") - F.col("item_pos"))
    lined = lined.withColumn("equal", F.col("item_values") == F.col("doc_values"))
    # alignments: each offset alone, and runs of offsets whose neighbours differ by at most DRIFT words
    pair = Window.partitionBy("key", "item").orderBy("shift")
    apart = (F.col("shift") - F.lag("shift").over(pair) > DRIFT).cast("int")
    lined = cut_lineage(lined.withColumn("apart", F.coalesce(apart, F.lit(0))).withColumn("drift", F.sum("apart").over(pair)).drop("apart"))
    found = [_aligned(lined, "shift"), _aligned(lined, "drift")]
    fit = reduce(DataFrame.unionByName, found).where((F.col("share") >= share) & (F.col("agreement") >= agreement))
    order = ["share", "verbatim", "agreement", "n_found", "first_word", "last_word"]
    # one row per pair, that of its best alignment
    best = fit.unionByName(_verbatim_runs(lined, run_words)).groupBy("key", "item").agg(F.max(F.struct(*order)).alias("b"))
    return best.select(
        F.col("key").alias(key),
        F.col("item").alias(item_key),
        "b.n_found",
        "b.share",
        "b.agreement",
        "b.verbatim",
        "b.first_word",
        "b.last_word",
    )


def _aligned(lined: DataFrame, by: str) -> DataFrame:
    """Share and agreement of each alignment, the hits of a pair with one value of ``by``."""
    alignment = ["key", "item", by]
    pairs = lined.groupBy(*alignment).agg(
        F.countDistinct("item_pos").alias("n_found"),
        F.countDistinct(F.when(F.col("in_named"), F.col("item_pos"))).alias("named"),
        F.countDistinct(F.when(F.col("in_caseless") & (F.col("equal") | (F.col("reading") >= CASELESS)), F.col("item_pos"))).alias("caseless"),
        F.countDistinct(F.when(F.col("in_verbatim") & F.col("equal"), F.col("item_pos"))).alias("verbatim_found"),
        *[F.first(c).alias(c) for c in ("all_named", "all_caseless", "all_verbatim")],
        F.min("pos").alias("first_word"),
        F.max(F.col("pos") + F.col("length") - 1).alias("last_word"),
    )
    shares = [F.coalesce(F.try_divide(F.col(n), F.col(f"all_{r}")), F.lit(0.0)) for n, r in (("named", "named"), ("caseless", "caseless"), ("verbatim_found", "verbatim"))]
    pairs = pairs.withColumn("share", F.greatest(*shares))
    offsets = list(dict.fromkeys([*alignment, "shift"]))
    slots = lined.select(*offsets, "item_pos", F.explode(F.arrays_zip("kinds", "item_values", "doc_values", F.sequence(F.lit(0), F.col("length") - 1).alias("k"))).alias("s"))
    # each place once, however many windows cover it
    places = slots.where("s.kinds <> 0").select(*offsets, (F.col("item_pos") + F.col("s.k")).alias("at"), "s.kinds", "s.item_values", "s.doc_values").distinct()
    values = places.groupBy(*offsets, "kinds", "item_values", "doc_values").agg(F.count(F.lit(1)).alias("n"))
    mapped = values.groupBy(*offsets, "kinds", "item_values").agg(
        F.max("n").alias("most"), F.sum("n").alias("all"), F.min((F.col("item_values") == F.col("doc_values")).cast("int")).alias("same")
    )
    agreed = mapped.groupBy(*alignment).agg((F.sum("most") / F.sum("all")).alias("agreement"), (F.min("same") == 1).alias("verbatim"))
    agreed = agreed.withColumnsRenamed({c: f"a_{c}" for c in alignment})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"a_{c}")) for c in alignment])
    joined = pairs.join(agreed, same, "left").withColumns({"agreement": F.coalesce("agreement", F.lit(1.0)), "verbatim": F.coalesce("verbatim", F.lit(True))})
    return joined.select("key", "item", "n_found", "share", "agreement", "verbatim", "first_word", "last_word")


def _verbatim_runs(lined: DataFrame, run_words: int) -> DataFrame:
    """Runs of neighbouring item windows on one offset, all values equal, that cover at least ``run_words`` words."""
    equal = lined.where("equal").select("key", "item", "shift", "item_pos", "length", "in_verbatim", "all_verbatim").distinct()
    place = F.dense_rank().over(Window.partitionBy("key", "item", "shift").orderBy("item_pos"))
    runs = equal.withColumn("run", F.col("item_pos") - place).groupBy("key", "item", "shift", "run").agg(
        F.countDistinct("item_pos").alias("n_found"),
        F.countDistinct(F.when(F.col("in_verbatim"), F.col("item_pos"))).alias("counted"),
        F.first("all_verbatim").alias("all_verbatim"),
        (F.min("item_pos") + F.col("shift")).alias("first_word"),
        (F.max(F.col("item_pos") + F.col("length")) + F.col("shift") - 1).alias("last_word"),
    )
    long = runs.where(F.col("last_word") - F.col("first_word") + 1 >= run_words)
    return long.select("key", "item", "n_found", F.coalesce(F.try_divide(F.col("counted"), F.col("all_verbatim")), F.lit(0.0)).alias("share"), F.lit(1.0).alias("agreement"), F.lit(True).alias("verbatim"), "first_word", "last_word")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
