import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import bpe_codec


@pytest.fixture(scope="module")
def ours():
    return bpe_codec.codec(bpe_codec.default_path(), bpe_codec.default_pattern())


@pytest.fixture(scope="module")
def theirs():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=bpe_codec.default_pattern(), mergeable_ranks=bpe_codec.read_ranks(bpe_codec.default_path()), special_tokens={})


def test_vocabulary_pieces_are_themselves(ours):
    for piece, rank in list(ours.ranks.items())[::37]:
        try:
            text = piece.decode()
        except UnicodeDecodeError:
            continue
        if ours.split(text) == [text]:
            assert ours.encode(text) == [rank]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_equals_tiktoken(text):
    codec = bpe_codec.codec(bpe_codec.default_path(), bpe_codec.default_pattern())
    import tiktoken

    global _their
    if "_their" not in globals():
        _their = tiktoken.Encoding("t", pat_str=bpe_codec.default_pattern(), mergeable_ranks=bpe_codec.read_ranks(bpe_codec.default_path()), special_tokens={})
    ids = codec.encode(text)
    assert ids == _their.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_white_space_kinds(ours, theirs):
    for c in (*range(0x3100), *range(0xFE00, 0xFF00), *range(0x1F600, 0x1F650)):
        text = f"a {chr(c)}b {chr(c)} 1{chr(c)}"
        assert ours.encode(text) == theirs.encode_ordinary(text), hex(c)


def test_cache_overflow(ours, theirs, monkeypatch):
    monkeypatch.setattr(bpe_codec, "CACHE", 5)
    text = " ".join(f"w{i}x" for i in range(50))
    assert ours.encode(text) == theirs.encode_ordinary(text)


def test_long_pre_tokens_are_not_kept(ours, theirs):
    text = "x" * 20_000 + " " + "qv" * 300 + " short"
    assert ours.encode(text) == theirs.encode_ordinary(text)
    assert max(map(len, ours.known)) <= bpe_codec.LONGEST_KEPT and " short" in ours.known


def test_query_rows(odd, odd_rows, theirs):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.round_trip(odd).collect()}
    want = set()
    for doc, text, *_ in odd_rows:
        ids = theirs.encode_ordinary(text or "")
        want.add((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == want


def test_columns(clashing, no_docs):
    out = bpe_codec.decode(bpe_codec.encode(clashing), bytes_col="decoded")
    assert out.columns == clashing.columns + ["decoded"]
    for r in out.select("text", "decoded").collect():
        assert bytes(r.decoded).decode() == (r.text or "")
    assert bpe_codec.round_trip(no_docs, with_ids=True).count() == 0
    assert bpe_codec.encode(no_docs).count() == 0
