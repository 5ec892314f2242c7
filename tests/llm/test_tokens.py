import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from raritas.llm import token_counts, token_files

PIECE, WORD = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ATOMS = list("aabcdeE  \t\n.,;:!?#'’sStdlrevmé́̌JÉñ ▁　中①ﬁ0123İΣς|<>") + ["<|startoftext|>", "<|endoftext|>", "<|STARTOFTEXT|>", "  ", "the", "</s>", "don't", "\r\n", "😀"]


def texts(n):
    draw = random.Random(7)
    return ["", "a", " ", " a", "a ", "\n", "▁", *("".join(draw.choice(ATOMS) for _ in range(draw.randrange(60))) for _ in range(n))]


def test_split_counts_equal_whole_ones():
    model, splittable = token_counts.piece_model(PIECE)
    given = texts(3000)
    assert splittable
    assert token_counts.lengths(model, True, pa.array(given)).tolist() == [len(model.encode(t)) for t in given]


def test_split_ids_equal_whole_ones():
    plain = Tokenizer.from_file(WORD)
    given = texts(2000)
    for start in range(0, len(given), 25):
        some = given[start : start + 25]
        ids, bounds = token_files.token_ids(token_files.coder(WORD), pa.array(some))
        for i, text in enumerate(some):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("limit, most", [("MEMORY_PARTS", 50), ("MEMORY_BYTES", 400)])
def test_memory_is_halved_and_loses_nothing(monkeypatch, limit, most):
    monkeypatch.setattr(token_files, limit, most)
    code, plain = token_files.PartCoder(WORD), Tokenizer.from_file(WORD)
    for text in texts(200):
        ids, _ = token_files.token_ids(code, pa.array([text]))
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_parts_end_before_punctuation_behind_two_byte_letters():
    given = "tacoó, día. ДОМ! i̇İ. ×; ÷, é́: a…,"
    parts, _ = token_files.word_parts(*token_files.text_bytes(pa.array([given])))
    assert parts.to_pylist() == ["tacoó", ",", "día", ".", "ДОМ", "!", "i̇İ.", "×;", "÷,", "é́:", "a…,"]


def test_ids_of_every_letter_and_of_punctuation_behind_every_sign():
    plain = Tokenizer.from_file(WORD)
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    random.Random(5).shuffle(letters)
    signs = [chr(c) for c in range(0xA0, 0x530)]
    given = letters + [f"{c}{end}" for c in signs for end in (".", "!?x", ",\u0301", ";'s")] + [f"a{c}: {c}a) I{c}*" for c in signs]
    ids, bounds = token_files.token_ids(token_files.PartCoder(WORD), pa.array(given))
    wanted = [x.ids for x in plain.encode_batch(given, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == wanted


def test_words_of_other_than_ascii_letters_are_encoded_together(monkeypatch):
    code, singly = token_files.PartCoder(WORD), []
    one_by_one = code._singly
    monkeypatch.setattr(code, "_singly", lambda parts, *into: singly.extend(parts) or one_by_one(parts, *into))
    token_files.token_ids(code, pa.array(["la acción, était über дом. naïve 東京"]))
    assert singly == [",", "."]


def test_memory_keeps_the_parts_met_in_more_batches(monkeypatch):
    monkeypatch.setattr(token_files, "MEMORY_PARTS", 40)
    code, plain = token_files.PartCoder(WORD), Tokenizer.from_file(WORD)
    asked = []
    encode_new = code._encode_new
    monkeypatch.setattr(code, "_encode_new", lambda parts: asked.append(parts) or encode_new(parts))
    for i in range(30):
        text = " ".join(["the", "of", "día", *(f"w{'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}{c}" for c in "uvwxyz")])
        ids, _ = token_files.token_ids(code, pa.array([text]))
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert [p for parts in asked[1:] for p in parts if p in ("the", "of", "día")] == []
    assert all(len(parts) == 6 for parts in asked[1:])


@pytest.mark.parametrize("slice_bytes", [1, 100, 1 << 20])
def test_counts_of_odd_rows(spark, slice_bytes):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    long_text = "Nicht aulich für sch " * 60_000
    rows = [(1, None, 0), (2, "", 0), (None, "a b", 1), (3, "so  it is", 2), (3, "so  it is", 2), (4, long_text, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = sorted(token_counts.count_tokens(docs, PIECE, slice_bytes=slice_bytes).collect(), key=repr)
    wanted = sorted([(k, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for k, t, _ in rows], key=repr)
    assert sorted(map(tuple, out), key=repr) == wanted


def test_files_round_trip(spark, tmp_path):
    plain = Tokenizer.from_file(WORD)
    rows = [(i * 37 % 301, f"Text {i} of der {'la ' * (i % 50)}.", i) for i in range(300)] + [(None, "no key", 0), (5, None, 0), (5, "", 0), (7, "again", 1), (7, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    folder = token_files.write_token_files(docs, str(tmp_path / "ids"), WORD)
    out = sorted(token_files.token_digests(spark, folder).collect(), key=lambda r: r.start)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for row, (key, text, _) in zip(out, ordered, strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (key, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_files_stand_in_the_order_of_their_numbers(spark, tmp_path):
    given = {"part-99999-a.parquet": [1, 2], "part-100000-a.parquet": [3], "part-09999-a.parquet": [0]}
    for name, keys in given.items():
        lists = pa.array([[k, 1] for k in keys], pa.list_(pa.int32()))
        pq.write_table(pa.table({"key": pa.array(keys, pa.int64()), "n_tokens": pa.array([2] * len(keys), pa.int64()), "ids": lists}), tmp_path / name)
    out = token_files.token_digests(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.start for r in out} == {0: 0, 1: 2, 2: 4, 3: 6}


def test_files_are_laid_out_for_selective_reads(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the word {i} " * 20) for i in range(4000)], "doc_id long, text string")
    folder = token_files.write_token_files(docs.coalesce(1), str(tmp_path / "ids"), WORD)
    file = next(p for p in (tmp_path / "ids").glob("part-*.parquet") if pq.ParquetFile(p).metadata.num_rows)
    group = pq.ParquetFile(file).metadata.row_group(0)
    by_name = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "RLE_DICTIONARY" in by_name["ids.list.element"].encodings and "DELTA_BINARY_PACKED" in by_name["key"].encodings
    assert all(c.has_offset_index for c in by_name.values())
    plan = token_files.read_token_files(spark, folder).where("key = 7").select("key", "n_tokens")._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema:")[-1] and "EqualTo(key,7)" in plan


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = token_files.write_token_files(docs, str(tmp_path / "ids"), WORD)
    assert token_files.token_digests(spark, folder).isEmpty()
    assert token_counts.count_tokens(docs, PIECE).isEmpty()
