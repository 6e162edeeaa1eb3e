import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from levelstream.llm import token_files as T


@pytest.mark.parametrize("ids", [[], [0], [1] * 2000, [255, 256, 65535, 65536, 2**32 - 1, 0], list(range(0, 200_000, 7))])
def test_random_access(ids):
    codes = T.Codes(T.encode(np.array(ids, np.uint32)))
    assert len(codes) == len(ids) and codes.read(0, len(ids)).tolist() == ids
    for i in range(0, len(ids), max(1, len(ids) // 50)):
        assert codes[i] == ids[i]
        assert codes.read(i, min(len(ids), i + 1300)).tolist() == ids[i : i + 1300]


def brute(rows, path):
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(path), 0, {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        out[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_against_the_library(docs, rows, monkeypatch):
    monkeypatch.setattr(T, "SHARD_IDS", 500)
    got = T.read_documents(T.write_tokens(docs, T.word_bpe)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows, T.word_bpe())


def test_words_are_the_text():
    from tokenizers import Tokenizer

    tokenizer, table = Tokenizer.from_file(T.word_bpe()), T.WordTable(T.word_bpe())
    for text in ["", " ", "a.b. c,, d.. É. 3. 3.5, İI ΣΑΣ. Σ, it's. 'S 'll. x́. ́. a b. c \x1c\x1d a\x1cb ͅ, ½. ß. ﬁ, ẞ. Ⅷ.", "é. e ́.", "<|endoftext|> x", "a\tb\r\nc\x0bd\x85e"]:
        assert table.texts(pa.array([text, None, text]))[2].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.word_bpe()), T.WordTable(T.word_bpe())


def test_added_tokens_and_marks_are_as_in_whole_texts(library):
    tokenizer, table = library
    assert table.by_word
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    marks = [chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c))]
    texts = [f"{a}{m}. {a.lower()}{m}x, Z{a}{m}" for a in letters for m in marks[::5]]
    texts += ["<|ENDOFTEXT|>", "<|STARTOFTEXT|>", "<|EndOfText|>. <|endoftext|>", "A<|endoftext|>B.", "<|", "<| endoftext|>", "<|endoftext|>, x<|startoftext|>.", "İ. İ, Iİ.", "J\u030c H\u0331 T\u0308 W\u030a Y\u030a"]
    got = [ids.tolist() for ids in table.texts(pa.array(texts))]
    assert got == [found.ids for found in tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="aZ.,'<|>\u0301\u0338 \t\n\x0b\x85\u2000\u2028sS<endoftext|>İΣ=\u1100\u1161", max_size=40)), min_size=1, max_size=5))
def test_any_text(library, texts):
    tokenizer, table = library
    assert [ids.tolist() for ids in table.texts(pa.array(texts))] == [found.ids for found in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    path, texts = public_tokenizers.path("byte_bpe_50k.json"), ["Two  words.\n", "", "<|endoftext|> x"]
    table = T.WordTable(path)
    assert not table.by_word
    assert [ids.tolist() for ids in table.texts(pa.array(texts))] == [found.ids for found in table.tokenizer.encode_batch(texts, add_special_tokens=False)]
    known = json.load(open(T.word_bpe(), encoding="utf-8"))
    assert T.cuts_at_white_space(known)
    changes = [("truncation", {"max_length": 5}), ("post_processor", {"type": "ByteLevel"}), ("normalizer", None), ("pre_tokenizer", {"type": "ByteLevel"}), ("added_tokens", [known["added_tokens"][0] | {"lstrip": True}])]
    for key, value in changes:
        assert not T.cuts_at_white_space(known | {key: value}), key


def test_edges(spark, no_docs):
    assert T.read_documents(T.write_tokens(no_docs, T.word_bpe)).count() == 0
    rows = spark.createDataFrame([(2, "b", 0), (2, "a", 0), (None, None, 0), (2, "b", 0)], "doc_id long, text string, start long")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in T.read_documents(T.write_tokens(rows, T.word_bpe)).collect())
    assert got == [(0, None, 1), (1, 2, 2), (3, 2, 2), (5, 2, 2)]
