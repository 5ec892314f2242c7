"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Texts are cut into parts whose ids do not depend on what stands around them (at ASCII white space, and before closing
ASCII punctuation that follows a Latin or Cyrillic letter). The parts of all documents are counted; the frequent ones, with
the ids that the merges give them, are compiled into an automaton whose states are shared by all words with equal endings.
Each transition carries an output; the outputs along a word add up to its place in a table of ids. The automaton is a file
of plain arrays, shipped to the executors, where tasks map it into memory.

Distinct parts of a slice walk the automaton together, a byte a step. Parts it does not know are normalised and cut by
the tokenizer's own rules, and merged exactly: the merge of lowest rank first, the leftmost of equals, until none applies.
Words of about one length are merged together as lines of a matrix.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raritas.functions.runtime import cut_lineage, ship_package
from raritas.llm.common import SPACES, gather, keyed_text, shared_folder, slices, text_bytes, tidied
from raritas.llm.token_files import word_parts

SLICE_BYTES = 4 << 20
# Bounds of the lexicon: words, bytes of a word, and how often a word occurs at least.
MOST_WORDS = 100_000
WORD_BYTES = 48
LEAST_COUNT = 2
# Counts are told apart by so many steps per doubling when the least count of a lexicon's word is set.
_STEPS = 16
# Words of up to so many symbols are merged as lines of one matrix; longer ones one by one.
_WIDTHS = (4, 8, 16, 32, 64)
_BLOCK_LINES = 1 << 15
_NO_RANK = np.iinfo(np.int32).max
_PAIR = 1 << 16
_DIGEST_IDS = 1 << 20


# ---------------------------------------------------------------- merges


class Merges:
    """Vocabulary and merges of a BPE tokenizer file, with exact merging of many words at once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        own = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        with open(own, encoding="utf-8") as file:
            settings = json.load(file)
        model = settings["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or settings.get("decoder") or settings.get("post_processor"):
            raise ValueError(f"only plain byte-level BPE with word ends is known, not {odd or 'this kind'}")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in settings["added_tokens"]):
            raise ValueError("added tokens must be matched as they are")
        library = Tokenizer.from_file(own)
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        vocabulary = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in settings["added_tokens"]}
        names = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        suffix = model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self.inner, self.last = np.full(512, -1, dtype=np.int32), np.full(512, -1, dtype=np.int32)
        for letter in letters:
            self.inner[ord(letter)], self.last[ord(letter)] = vocabulary[letter], vocabulary[letter + suffix]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocabulary[a] * _PAIR + vocabulary[b] for a, b in pairs], dtype=np.int64)
        self.result = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int32)
        if len(vocabulary) >= _PAIR - 1:
            raise ValueError("ids must fit 16 bits")
        # A pair that is listed twice has its last rank.
        order = np.lexsort((np.arange(len(keys)), keys))
        final = np.append(keys[order][1:] != keys[order][:-1], True) if len(keys) else np.zeros(0, dtype=bool)
        self.pairs, self.ranks = keys[order][final], order[final].astype(np.int32)
        tokens = {i: t for t, i in (vocabulary | self.specials).items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens, default=-1) + 1)]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * _PAIR + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.ranks[at], _NO_RANK)

    def merge(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of byte letters in one array, and the bounds of each word in it."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        symbols = self.inner[letters]
        ends = bounds[1:][sizes > 0] - 1
        symbols[ends] = self.last[letters[ends]]
        lists: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(words)
        below = 0
        for width in _WIDTHS:
            chosen = np.flatnonzero((sizes > below) & (sizes <= width))
            for start in range(0, len(chosen), _BLOCK_LINES):
                some = chosen[start : start + _BLOCK_LINES]
                places = np.arange(width)
                inside = places < sizes[some, None]
                table = np.where(inside, symbols[np.minimum(bounds[some, None] + places, len(symbols) - 1)], -1)
                self._merge_lines(table, some, lists)
            below = width
        for i in np.flatnonzero(sizes > below):
            lists[i] = self._merge_one(symbols[bounds[i] : bounds[i + 1]])
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return np.concatenate([np.zeros(0, dtype=np.int32), *lists]), np.concatenate(([0], np.cumsum(counts)))

    def _merge_lines(self, table: np.ndarray, which: np.ndarray, lists: list[np.ndarray]) -> None:
        """One merge a line and step; lines without another merge leave."""
        places = np.arange(table.shape[1])
        ranks = self._rank(table[:, :-1], table[:, 1:])
        while len(table):
            at = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(table)), at]
            done = rank == _NO_RANK
            for i, line in zip(which[done], table[done]):
                lists[i] = line[line >= 0]
            which, table, ranks, at, rank = (x[~done] for x in (which, table, ranks, at, rank))
            if not len(table):
                return
            lines = np.arange(len(table))
            moved = np.minimum(places + (places > at[:, None]), len(places) - 1)
            table = np.take_along_axis(table, moved, axis=1)
            table[:, -1] = -1
            table[lines, at] = self.result[rank]
            ranks = np.take_along_axis(ranks, np.minimum(moved[:, :-1], len(places) - 2), axis=1)
            ranks[:, -1] = _NO_RANK
            after = np.minimum(at + 1, len(places) - 1)
            ranks[lines, np.minimum(at, len(places) - 2)] = np.where(after > at, self._rank(table[lines, at], table[lines, after]), _NO_RANK)
            inner = at > 0
            ranks[lines[inner], at[inner] - 1] = self._rank(table[lines[inner], at[inner] - 1], table[lines[inner], at[inner]])

    def _merge_one(self, symbols: np.ndarray) -> np.ndarray:
        """A long word: neighbours are linked, and the merges that apply wait in a heap."""
        import heapq

        n = len(symbols)
        ids, after, before = symbols.tolist(), list(range(1, n)) + [-1], list(range(-1, n - 1))
        first = self._rank(symbols[:-1], symbols[1:])
        heap = [(int(first[i]), int(i), ids[i], ids[i + 1]) for i in np.flatnonzero(first != _NO_RANK)]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j] = int(self.result[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0:
                    rank = int(self._rank(np.array([ids[a]]), np.array([ids[b]]))[0])
                    if rank != _NO_RANK:
                        heapq.heappush(heap, (rank, a, ids[a], ids[b]))
            after[j] = -1
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def encode_parts(self, parts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts of texts in one array, and the bounds of each part in it."""
        places: dict[str, int] = {}  # each word once; a special string stands for itself
        rows, sizes = [], np.empty(len(parts), dtype=np.int64)
        for number, part in enumerate(parts):
            words = [part.lower()] if part.isascii() and part.isalpha() else self._words(part)
            sizes[number] = len(words)
            rows += [places.setdefault(w, len(places)) for w in words]
        words = list(places)
        given = [i for i, w in enumerate(words) if w in self.specials]
        ids, bounds = self.merge(["" if w in self.specials else w for w in words])
        counts = np.diff(bounds)
        first = bounds[:-1].copy()
        first[given], counts[given] = len(ids) + np.arange(len(given)), 1
        ids = np.append(ids, np.array([self.specials[words[i]] for i in given], dtype=np.int32))
        flat, ends = gather(ids, first[rows] if rows else first[:0], counts[rows] if rows else counts[:0])
        return flat, ends[np.concatenate(([0], np.cumsum(sizes)))]

    def _words(self, part: str) -> list[str]:
        pieces = self.special.split(part) if self.special else [part]
        words = []
        for i, piece in enumerate(pieces):
            if i % 2:
                words.append(piece)
            elif piece:
                words += [w for w, _ in self.pre_tokenize(self.normalize(piece))]
        return words


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: visible Latin-1 characters for themselves, others from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


# ---------------------------------------------------------------- the automaton


@dataclass(frozen=True)
class Lexicon:
    """A minimal acyclic automaton over bytes as arrays; a state is a number, the root the last one.

    ``arcs`` holds state * 256 + byte in ascending order, with the state it leads to and its output. ``final`` marks the
    states where a word ends. The outputs of a word's arcs add up to its number in byte order; ``bounds`` and ``ids`` hold
    the ids of each number.
    """

    arcs: np.ndarray
    target: np.ndarray
    output: np.ndarray
    final: np.ndarray
    bounds: np.ndarray
    ids: np.ndarray

    FIELDS = (("arcs", "<i8"), ("target", "<i4"), ("output", "<i4"), ("final", "u1"), ("bounds", "<i8"), ("ids", "<i4"))

    def find(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The number of each word ``data[bounds[i]:bounds[i + 1]]``, or -1."""
        words = len(bounds) - 1
        number = np.full(words, -1, dtype=np.int64)
        if not len(self.bounds) > 1:
            return number
        sizes = np.diff(bounds)
        live = np.flatnonzero(sizes <= WORD_BYTES)
        state, sums = np.full(len(live), len(self.final) - 1, dtype=np.int64), np.zeros(len(live), dtype=np.int64)
        step = 0
        while len(live):
            ended = sizes[live] == step
            accepted = ended & (self.final[state] == 1)
            number[live[accepted]] = sums[accepted]
            live, state, sums = live[~ended], state[~ended], sums[~ended]
            arc = state * 256 + data[bounds[:-1][live] + step]
            at = np.minimum(np.searchsorted(self.arcs, arc), max(0, len(self.arcs) - 1))
            known = self.arcs[at] == arc if len(self.arcs) else np.zeros(len(live), dtype=bool)
            live, at = live[known], at[known]
            state, sums = self.target[at].astype(np.int64), sums[known] + self.output[at]
            step += 1
        return number

    def to_bytes(self) -> bytes:
        """Sizes of the arrays, then the arrays, each at a multiple of 8 bytes."""
        arrays = [np.ascontiguousarray(getattr(self, name).astype(kind)).tobytes() for name, kind in self.FIELDS]
        head = np.array([len(getattr(self, name)) for name, _ in self.FIELDS], dtype="<i8").tobytes()
        return head + b"".join(a + bytes(-len(a) % 8) for a in arrays)

    @staticmethod
    def mapped(path: str) -> Lexicon:
        """The arrays as views of the file, mapped into memory."""
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        at, fields = 8 * len(Lexicon.FIELDS), {}
        for size, (name, kind) in zip(raw[:at].view("<i8"), Lexicon.FIELDS, strict=True):
            length = int(size) * np.dtype(kind).itemsize
            fields[name] = raw[at : at + length].view(kind)
            at += length + -length % 8
        return Lexicon(**fields)


def compile_lexicon(words: Sequence[bytes], ids: Sequence[np.ndarray]) -> Lexicon:
    """The minimal automaton of distinct words in byte order, built word by word (Daciuk et al., 2000).

    A state is looked up by its end mark and arcs when no further word can pass through it, so equal endings are stored
    once. States are numbered as they are found; arcs lead to smaller numbers.
    """
    known: dict[tuple, int] = {}
    accepts: list[int] = []  # words that end at or behind a state
    open_: list[list] = [[False, []]]

    def close(node: list) -> int:
        mark = (node[0], tuple(node[1]))
        if mark not in known:
            known[mark] = len(known)
            accepts.append(node[0] + sum(accepts[to] for _, to in node[1]))
        return known[mark]

    def close_below(depth: int, word: bytes) -> None:
        while len(open_) - 1 > depth:
            to = close(open_.pop())
            open_[-1][1].append((word[len(open_) - 1], to))

    before = b""
    for word in words:
        shared = len(os.path.commonprefix([before, word]))
        close_below(shared, before)
        open_.extend([False, []] for _ in word[shared:])
        open_[-1][0] = True
        before = word
    close_below(0, before)
    # The root is a state of its own and the last: no arc leads to it.
    states = [*known, (open_[0][0], tuple(open_[0][1]))]
    arcs, target, output = [], [], []
    for number, (final, leaving) in enumerate(states):
        passed = int(final)
        for byte, to in leaving:
            arcs.append(number * 256 + byte)
            target.append(to)
            output.append(passed)
            passed += accepts[to]
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    return Lexicon(
        np.array(arcs, dtype=np.int64),
        np.array(target, dtype=np.int32),
        np.array(output, dtype=np.int32),
        np.array([final for final, _ in states], dtype=np.uint8),
        np.concatenate(([0], np.cumsum(sizes))),
        np.concatenate([np.zeros(0, dtype=np.int32), *ids]),
    )


# ---------------------------------------------------------------- Spark


def count_parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(part, n): how often each part occurs in all texts; counted per slice before the rows are shuffled."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in whole_slices(batch.column("text"), SLICE_BYTES):
                coded = word_parts(*text_bytes(piece))[0].dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(n.astype(np.int64))], names=["part", "n"])

    given = docs.select(F.col(text).cast("string").alias("text")).where("text is not null")
    return given.mapInArrow(tidied(run), "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def whole_slices(column: pa.Array, most: int) -> Iterator[pa.Array]:
    """The texts of a column in runs of about ``most`` bytes; a longer text is cut at ASCII white space."""
    batch = pa.RecordBatch.from_arrays([column.fill_null("")], names=["text"])
    for part in slices(batch, "text", most):
        texts = part.column("text")
        if len(texts) == 1 and (size := len(texts[0].as_buffer())) > 2 * most:
            yield from _cut_text(np.frombuffer(texts[0].as_buffer(), dtype=np.uint8), size, most)
        else:
            yield texts


def _cut_text(data: np.ndarray, size: int, most: int) -> Iterator[pa.Array]:
    start = 0
    while start < size:
        end = start + most
        while end < size:
            blanks = np.flatnonzero(SPACES[data[end : end + most]])
            if len(blanks):
                end += int(blanks[0])
                break
            end += most
        end = min(end, size)
        yield pa.array([data[start:end].tobytes()], pa.binary()).cast(pa.string())
        start = end


def frequent_parts(counts: DataFrame, most_words: int) -> list[str]:
    """The parts that occur most often: those at or above a least count which ``most_words`` parts at most reach."""
    fit = counts.where((F.octet_length("part") <= WORD_BYTES) & (F.col("n") >= LEAST_COUNT))
    stored = cut_lineage(fit)
    level = F.floor(F.log2("n") * _STEPS).cast("int")
    # at most 64 * _STEPS levels
    levels = sorted(((r["level"], r["words"]) for r in stored.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    total, least = 0, math.inf
    for number, words in levels:
        if total + words > most_words:
            break
        total, least = total + words, number
    if least == math.inf:
        return []
    return [r["part"] for r in stored.where(level >= least).select("part").collect()]


def build_lexicon(docs: DataFrame, tokenizer_path: str, text: str = "text", most_words: int = MOST_WORDS) -> str:
    """Compile the frequent parts of all texts, ship the automaton to the executors and return its name.

    The driver holds at most ``most_words`` words of WORD_BYTES bytes. The file is written to the shared folder.
    """
    spark = docs.sparkSession
    words = sorted(p.encode() for p in frequent_parts(count_parts(docs, text), most_words))
    ids, bounds = Merges(tokenizer_path).encode_parts([w.decode() for w in words])
    lexicon = compile_lexicon(words, [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    target = f"{shared_folder(spark, 'lexicon')}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        stream.write(bytearray(lexicon.to_bytes()))
    finally:
        stream.close()
    spark.sparkContext.addFile(target)
    return os.path.basename(target)


class Coder:
    """Encodes and decodes texts by a lexicon and the merges of a tokenizer file."""

    def __init__(self, tokenizer_path: str, lexicon: Lexicon):
        self.merges, self.lexicon = Merges(tokenizer_path), lexicon
        # Each token with the blank that follows it in a joined text.
        self.token_texts = pa.array([t + " " for t in self.merges.tokens], pa.large_string())
        self.id_texts = pa.array([f"{i} " for i in range(len(self.merges.tokens))], pa.large_string())

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the bounds of each text in it."""
        parts, rows = word_parts(*text_bytes(column))
        coded = parts.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        number = self.lexicon.find(*text_bytes(coded.dictionary))
        unseen = np.flatnonzero(number < 0)
        fresh, bounds = self.merges.encode_parts(coded.dictionary.take(pa.array(unseen)).to_pylist())
        first, sizes = self.lexicon.bounds[number], np.diff(self.lexicon.bounds, append=0)[number]
        first[unseen], sizes[unseen] = len(self.lexicon.ids) + bounds[:-1], np.diff(bounds)
        ids, ends = gather(np.concatenate((self.lexicon.ids, fresh)), first[which], sizes[which])
        return ids, ends[rows]

    def joined(self, texts: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """For each row the texts of its ids, joined by one blank."""
        known = ids if not len(ids) or ids.max() < len(texts) else None
        if known is None:
            raise ValueError("an id is not in the vocabulary")
        taken = texts.take(pa.array(ids.astype(np.int64)))
        data, ends = text_bytes(taken)
        raw = memoryview(np.ascontiguousarray(data))
        return [raw[ends[a] : max(ends[a], ends[b] - 1)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def digest(self, texts: pa.Array, ids: np.ndarray) -> str:
        """SHA-256 of the joined texts of one long row, a block at a time."""
        total = hashlib.sha256()
        for start in range(0, len(ids), _DIGEST_IDS):
            some = ids[start : start + _DIGEST_IDS]
            total.update(b" " if start else b"")
            total.update(self.joined(texts, some, np.array([0, len(some)]))[0])
        return total.hexdigest()


_coders: dict[tuple[str, str], Coder] = {}


def coder(tokenizer_path: str, lexicon: str) -> Coder:
    """One coder a worker, with the lexicon's file mapped into its memory."""
    if (tokenizer_path, lexicon) not in _coders:
        _coders.clear()
        _coders[tokenizer_path, lexicon] = Coder(tokenizer_path, Lexicon.mapped(SparkFiles.get(lexicon)))
    return _coders[tokenizer_path, lexicon]


def encoded_slices(batch: pa.RecordBatch, code: Coder) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with their ids and bounds; a long text is encoded piece by piece and is a run of its own."""
    for part in slices(batch, "text", SLICE_BYTES):
        if part.num_rows == 1:
            pieces = [code.encode(piece)[0] for piece in whole_slices(part.column("text"), SLICE_BYTES)]
            ids = np.concatenate([np.zeros(0, dtype=np.int32), *pieces])
            yield part, ids, np.array([0, len(ids)])
        else:
            yield part, *code.encode(part.column("text"))


def encode_texts(docs: DataFrame, tokenizer_path: str, lexicon: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of each whole text, without begin or end.

    A null text is empty and has no ids; every row counts for itself; special strings inside texts become their ids, as
    the library has them; other columns are not read.
    """
    ship_package(docs.sparkSession)
    given = keyed_text(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer_path, lexicon)
        for batch in batches:
            for part, ids, bounds in encoded_slices(batch, code):
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("key"), lists], names=["key", "ids"])

    return given.mapInArrow(tidied(run), f"key {given.schema['key'].dataType.simpleString()}, ids array<int>")


def decode_ids(rows: DataFrame, tokenizer_path: str, lexicon: str, key: str = "key", ids: str = "ids") -> DataFrame:
    """(key, text): the tokens of each list of ids, joined by a blank. A null list is empty; null ids stand for nothing.

    An id outside the vocabulary is an error.
    """
    ship_package(rows.sparkSession)
    given = rows.select(F.col(key).alias("key"), F.coalesce(F.array_compact(ids), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer_path, lexicon)
        for batch in batches:
            lists = batch.column("ids")
            sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            texts = code.joined(code.token_texts, flat, np.concatenate(([0], np.cumsum(sizes))))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([bytes(t) for t in texts], pa.binary()).cast(pa.string())], names=["key", "text"])

    return given.mapInArrow(tidied(run), f"key {given.schema['key'].dataType.simpleString()}, text string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str, lexicon: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): texts encoded, and decoded from their ids, in one pass."""
    ship_package(docs.sparkSession)
    given = keyed_text(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer_path, lexicon)
        for batch in batches:
            for part, ids, bounds in encoded_slices(batch, code):
                digests = []
                for texts in (code.id_texts, code.token_texts):
                    if part.num_rows == 1:
                        digests.append([code.digest(texts, ids)])
                    else:
                        digests.append([hashlib.sha256(t).hexdigest() for t in code.joined(texts, ids, bounds)])
                columns = [part.column("key"), pa.array(np.diff(bounds)), *map(pa.array, digests)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"key {given.schema['key'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return given.mapInArrow(tidied(run), schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    digests = round_trip_digests(docs, tokenizer, build_lexicon(docs, tokenizer))
    return digests.withColumnRenamed("key", "doc_id")
