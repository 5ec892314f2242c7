import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from raritas.llm import bpe_lexicon
from raritas.llm.bpe_lexicon import Coder, Lexicon, Merges, build_lexicon, compile_lexicon, decode_ids, encode_texts, query, round_trip_digests
from raritas.llm.common import text_bytes
from raritas.llm.token_files import word_parts

WORD = public_tokenizers.path("word_bpe_49k.json")
ATOMS = list("aabcdeE  \t\n.,;:!?#'’sStdlrevmé́̌JÉñ ▁　中①ﬁ0123İΣς|<>") + ["<|startoftext|>", "<|endoftext|>", "<|STARTOFTEXT|>", "  ", "the", "</s>", "don't", "\r\n", "😀", "abcdefghij" * 9]


def texts(n, seed=7):
    draw = random.Random(seed)
    return ["", "a", " ", "<|endoftext|>", *("".join(draw.choice(ATOMS) for _ in range(draw.randrange(60))) for _ in range(n))]


def lexicon_of(some, folder):
    """A lexicon of all short parts of some texts, written and mapped."""
    words = sorted({w.encode() for t in some for w in word_parts(*text_bytes(pa.array([t])))[0].to_pylist()})
    words = [w for w in words if len(w) <= bpe_lexicon.WORD_BYTES]
    ids, bounds = Merges(WORD).encode_parts([w.decode() for w in words])
    (folder / "lexicon.bin").write_bytes(compile_lexicon(words, [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]).to_bytes())
    return Lexicon.mapped(str(folder / "lexicon.bin"))


@pytest.mark.parametrize("known", [0, 60])
def test_ids_and_texts_equal_the_library(tmp_path, known):
    plain, given = Tokenizer.from_file(WORD), texts(2000)
    code = Coder(WORD, lexicon_of(given[:known], tmp_path))
    for start in range(0, len(given), 41):
        some = given[start : start + 41]
        ids, bounds = code.encode(pa.array(some))
        decoded = code.joined(code.token_texts, ids, bounds)
        for i, text in enumerate(some):
            wanted = plain.encode(text, add_special_tokens=False).ids
            assert ids[bounds[i] : bounds[i + 1]].tolist() == wanted, text
            assert bytes(decoded[i]).decode() == plain.decode(wanted, skip_special_tokens=False)


@pytest.mark.parametrize("letters", ["etaoinshr", "ab", "a"])
def test_merges_of_words_of_all_lengths(letters):
    draw, plain = random.Random(letters), Tokenizer.from_file(WORD)
    words = ["".join(draw.choice(letters) for _ in range(n)) for n in [*range(1, 140), 2000]]
    ids, bounds = Merges(WORD).merge(words)
    for i, word in enumerate(words):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(word, add_special_tokens=False).ids


def test_automaton_is_minimal_and_numbers_words():
    draw = random.Random(2)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randrange(1, 7))).encode() for _ in range(300)})
    lexicon = compile_lexicon(words, [np.array([i, i + 1], dtype=np.int32) for i in range(len(words))])
    endings = {frozenset(w[i:] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)} for i in [len(p)]}
    assert len(lexicon.final) == len(endings)
    others = [b"", b"abcabcabc", b"zz", b"cccccc", b"a" * 60]
    asked = [*words, *others]
    bounds = np.concatenate(([0], np.cumsum([len(w) for w in asked])))
    found = lexicon.find(np.frombuffer(b"".join(asked), dtype=np.uint8), bounds)
    assert found.tolist() == [*range(len(words)), *[words.index(w) if w in words else -1 for w in others]]
    empty = compile_lexicon([], [])
    assert empty.find(np.frombuffer(b"ab", dtype=np.uint8), np.array([0, 1, 2])).tolist() == [-1, -1]


def wanted_row(plain, key, text):
    ids = plain.encode(text or "", add_special_tokens=False).ids
    digests = [" ".join(map(str, ids)), plain.decode(ids, skip_special_tokens=False)]
    return (key, len(ids), *(hashlib.sha256(d.encode()).hexdigest() for d in digests))


def test_odd_rows(spark):
    plain = Tokenizer.from_file(WORD)
    long_text = "The quick,  brown fôx 12's " * 450_000  # 12 MB: in three slices
    rows = [(1, None, 0), (2, "", 0), (None, "a b", 1), (3, "so  it is", 2), (3, "so  it is", 2), (4, long_text, 3), (5, "x" * 300_000, 1)]
    rows += [(10 + i, t, 0) for i, t in enumerate(texts(300, seed=3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    lexicon = build_lexicon(docs, WORD, most_words=50)
    out = round_trip_digests(docs, WORD, lexicon).collect()
    assert sorted(map(tuple, out), key=repr) == sorted((wanted_row(plain, k, t) for k, t, _ in rows), key=repr)
    encoded = encode_texts(docs.where("doc_id <> 4"), WORD, lexicon)
    decoded = {r.key: r.text for r in decode_ids(encoded, WORD, lexicon).collect()}
    assert decoded[1] == "" and decoded[3] == plain.decode(plain.encode("so  it is", add_special_tokens=False).ids, skip_special_tokens=False)


def test_counts_are_those_of_all_parts(spark):
    given = texts(200, seed=9)
    docs = spark.createDataFrame([(t,) for t in [*given, *given, None]], "text string").repartition(4)
    parts = [p for t in given for p in word_parts(*text_bytes(pa.array([t])))[0].to_pylist()]
    counted = {r.part: r.n for r in bpe_lexicon.count_parts(docs).collect()}
    # The case of a part depends on its slice; all else is counted alike.
    assert sum(counted.values()) == 2 * len(parts) and {p.lower() for p in counted} == {p.lower() for p in parts}


def test_frequent_parts_stay_in_bounds(spark):
    counts = spark.createDataFrame([(f"w{i}", 1000 // (i + 1)) for i in range(600)] + [("y" * 60, 10**6)], "part string, n long")
    for most in (0, 1, 10, 200, 10_000):
        kept = bpe_lexicon.frequent_parts(counts, most)
        assert len(kept) <= most and set(kept) == {f"w{i}" for i in range(len(kept))}
    assert len(kept) == 500  # all that occur twice


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    lexicon = build_lexicon(docs, WORD)
    assert round_trip_digests(docs, WORD, lexicon).isEmpty() and decode_ids(encode_texts(docs, WORD, lexicon), WORD, lexicon).isEmpty()


def test_query_equals_the_library(spark):
    plain = Tokenizer.from_file(WORD)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    out = query(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(wanted_row(plain, r.doc_id, r.text) for r in docs)
