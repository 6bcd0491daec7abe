import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import token_pack as t
from tidemill.session import Scratch


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3) | st.integers(0, 70000) | st.sampled_from([2**60 - 1, 2**60, 2**30, 2**30 - 1]), max_size=700))
def test_pack_round_trip(values):
    array = np.array(values, np.uint64)
    assert (t.unpack(t.pack(array)) == array).all()


def test_pack_is_small_and_chunks_decode_alone():
    zeros = np.zeros(t.CHUNK * 2 + 5, np.uint64)
    assert len(t.pack(zeros)) < 8 * (len(zeros) / 120 + 20)
    ids = np.random.default_rng(1).integers(0, 1 << 15, 3 * t.CHUNK).astype(np.uint64)
    assert len(t.pack(ids)) < 8 * len(ids) / 3.9
    with pytest.raises(ValueError):
        t.unpack(b"none" + bytes(12))


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(t.default_path())


def test_words_equal_whole_texts(theirs, odd_rows):
    use = t.word_encoder(t.default_path())
    texts = [text or "" for _, text, *_ in odd_rows] + [f"Don't a{chr(c)}b {chr(c)}C 1{chr(c)}. I'Ll {chr(c)}" for c in (*range(0x400), *range(0x2000, 0x2100), 0x3000, 0x1F600)]
    ids, sizes = use.encode(pa.array(texts))
    for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert own.tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    global _their
    if "_their" not in globals():
        _their = Tokenizer.from_file(t.default_path())
    assert t.word_encoder(t.default_path()).encode(pa.array([text]))[0].tolist() == _their.encode(text, add_special_tokens=False).ids


def test_files_equal_brute_force(spark, odd, odd_rows, theirs):
    got = t.write_and_check(spark, odd, block=3).collect()
    want, start = [], 0
    for doc, text, *_ in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*theirs.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_long_words_are_not_kept(theirs, monkeypatch):
    use = t.WordEncoder(t.default_path())
    texts = ["x" * 20_000 + " " + "qv" * 300 + "! short", "é" * 500 + "1", "short again"]
    for most in (t.CACHE, 2):
        monkeypatch.setattr(t, "CACHE", most)
        ids, sizes = use.encode(pa.array(texts))
        for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert own.tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert max(map(len, [*use.words, *use.pieces])) <= t.LONGEST_KEPT


def test_clashing_columns(spark, clashing):
    docs = clashing.where("doc_id < 6")
    got = {r.doc_id: r.n_tokens for r in t.write_and_check(spark, docs).collect()}
    assert got == {r.doc_id: r.n_tokens for r in t.write_and_check(spark, docs.select("doc_id", "text")).collect()} and len(got) == 5


def test_ids_come_back(spark, odd, theirs, no_docs):
    path = Scratch(spark, "test").path
    t.write(odd, path)
    rows = {r.doc: r.value for r in t.read_ids(spark, path).collect()}
    assert rows[1] == [*theirs.encode("The quick brown fox jumps over the lazy dog", add_special_tokens=False).ids, 1]
    assert t.write_and_check(spark, no_docs).count() == 0
