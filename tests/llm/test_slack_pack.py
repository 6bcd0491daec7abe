import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import slack_pack as s
from tidemill.llm.queries import QUERIES


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(s.default_path())


def test_spans_equal_whole_texts(theirs, odd_rows):
    use = s.span_encoder(s.default_path())
    texts = [text or "" for _, text, *_ in odd_rows] + [f"Don't a{chr(c)}b {chr(c)}C 1{chr(c)} . {chr(c)}  I'll{chr(c)} é {chr(c)} x" for c in (*range(0x400), *range(0x1680, 0x1690), *range(0x2000, 0x2100), 0x3000, 0x1F600)]
    texts += ["a <|endoftext|> b", " ", "  ", "   a   b \n c \n\n d\t e  ", "x" * 5000 + " y"]
    array = pa.array(["first", *texts]).slice(1)
    ids, sizes = use.encode(array)
    for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert own.tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t 　\x1c\x85aZé1.'’<|>sß中") | st.characters(codec="utf-8"), max_size=40), max_size=5))
def test_any_texts(texts):
    from tokenizers import Tokenizer

    global _their
    if "_their" not in globals():
        _their = Tokenizer.from_file(s.default_path())
    ids, sizes = s.span_encoder(s.default_path()).encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for t in texts for i in _their.encode(t, add_special_tokens=False).ids] and len(sizes) == len(texts)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=7), st.integers(0, 40))
def test_fullest_equals_all_combinations(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {x + n * k for x in sums for k in range(c + 1) if x + n * k <= room}
    found = dict(s.fullest(sorted(counts.items(), reverse=True), room))
    assert all(k <= counts[n] for n, k in found.items()) and sum(n * k for n, k in found.items()) == max(sums)


def one_by_one(counts, size):
    """The same removal, a sequence at a time."""
    left, out = dict(counts), []
    while left:
        first = max(left)
        left[first] -= 1
        found = s.fullest(sorted(((n, c) for n, c in left.items() if c), reverse=True), size - first)
        for n, k in found:
            left[n] -= k
        out.append(sorted([first, *(n for n, k in found for _ in range(k))], reverse=True))
        left = {n: c for n, c in left.items() if c}
    return out


def first_fit(counts, size):
    room = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        at = next((i for i, r in enumerate(room) if r >= n), None)
        if at is None:
            room.append(size - n)
        else:
            room[at] -= n
    return len(room)


def test_plan_equals_one_by_one_and_is_near_first_fit():
    draw = random.Random(3)
    for size in (10, 37, 100):
        for _ in range(60):
            counts = {draw.randrange(1, size + 1): draw.choice([1, 2, 3, 40]) for _ in range(draw.randrange(12))}
            uses = s._reserving(counts, size, 0)
            flat = [[n for n, k in combination for _ in range(k)] for combination, times in uses for _ in range(times)]
            assert sorted(flat) == sorted(one_by_one(counts, size))
            for uses in (s._reserving(counts, size, size // 3), s.plan(counts, size)):
                assert all(sum(n * k for n, k in c) <= size and t > 0 for c, t in uses)
                placed = Counter()
                for c, t in uses:
                    placed.update({n: k * t for n, k in c})
                assert placed == counts
            assert sum(t for _, t in uses) <= 1.05 * first_fit(counts, size) + 1  # few lengths, so neither is always best
    assert s.plan({}) == [] and s.plan({1: 5}, 2) == [([(1, 2)], 2), ([(1, 1)], 1)]
    with pytest.raises(ValueError):
        s.plan({5: 1}, 4)


def test_plans_stay_short_and_full():
    draw = np.random.default_rng(5)
    lengths = np.clip(draw.lognormal(5.5, 1, 400_000).astype(int), 1, 1024)
    counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    uses = s.plan(counts)
    assert len(uses) < 6000 and sum(t for _, t in uses) <= -(-int(lengths.sum()) // 1024) + 1


def whole(rows, docs, theirs, size, end):
    """Pieces cover their documents and sequences have no gap; returns the number of sequences and of ids."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for some in by_sequence.values():
        upto = 0
        for offset, length in sorted(some):
            assert offset == upto
            upto += length
        assert upto <= size
    total = 0
    for doc, text in docs:
        ids = [*theirs.encode(text or "", add_special_tokens=False).ids, end]
        total += len(ids)
        found = sorted(by_doc.pop(doc), key=lambda r: r.piece)
        cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
        assert [(r.piece, r.start, r.length) for r in found] == [(i, a, b - a) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert [r.ids_crc32 for r in found] == [zlib.crc32(np.array(ids[a:b], "<u4").tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert not by_doc
    return len(by_sequence), total


def test_query_packs_all_documents(spark, sf_dir, theirs):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op12_slack_pack"](spark, sf_dir).collect()
    n, total = whole(rows, docs, theirs, 1024, 2)
    assert n <= -(-total // 1024) + 1


def test_sequences_hold_the_ids(spark, sf_dir, theirs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    text = {r.doc_id: [*theirs.encode(r.text, add_special_tokens=False).ids, 2] for r in docs.collect()}
    seen = defaultdict(dict)
    for r in s.sequences(spark, docs, size=300).collect():
        at = 0
        for p in r.pieces:
            seen[p.doc][p.piece] = r.ids[at : at + p.length]
            at += p.length
        assert at == len(r.ids) <= 300
    assert {doc: [i for k in sorted(some) for i in some[k]] for doc, some in seen.items()} == text


def test_odd_rows(spark, odd, odd_rows, clashing, no_docs, theirs):
    rows = s.pack(spark, clashing, size=100).collect()
    assert sorted(r.length for r in rows if r.doc_id in (3, 4)) == [1, 1] and len([r for r in rows if r.doc_id == 7]) == 2
    places = defaultdict(int)
    for r in rows:
        places[r.sequence_id] += r.length
    total = sum(len(theirs.encode(text or "", add_special_tokens=False).ids) + 1 for _, text, *_ in odd_rows)
    assert sum(places.values()) == total and max(places.values()) <= 100 and len(places) <= -(-total // 100) + 1
    assert s.pack(spark, no_docs).count() == 0 and s.sequences(spark, no_docs).count() == 0
    with pytest.raises(ValueError):
        s.pack(spark, odd, size=0)


def test_numbers_of_pieces_are_one_file_whatever_the_shuffle(spark, sf_dir, monkeypatch, theirs):
    saved = []

    class Seen(s.Scratch):
        def save(self, df, codec=None):
            saved.append(super().save(df, codec))
            return saved[-1]

    monkeypatch.setattr(s, "Scratch", Seen)
    conf = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "64k"}
    was = {k: spark.conf.get(k) for k in conf}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(4)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = s.pack(spark, docs)
        assert [len(table.inputFiles()) for table in saved[1:]] == [1]
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        n, total = whole(out.collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], theirs, 1024, 2)
        assert n <= -(-total // 1024) + 1
        monkeypatch.setattr(s, "NUMBERED", 300)  # and more files with more rows, with the same numbers
        more = s.pack(spark, docs)
        assert len(saved[-1].inputFiles()) > 1
        assert sorted(map(tuple, more.collect())) == sorted(map(tuple, out.collect()))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_few_spans_are_encoded_at_once(theirs):
    sizes = []

    class Seen:
        def encode_batch_fast(self, texts, **options):
            sizes.append((len(texts), sum(map(len, texts))))
            return theirs.encode_batch_fast(texts, **options)

    use = s.SpanEncoder(s.default_path())
    use.tokenizer = Seen()
    text = " ".join(f"{chr(0x430 + i % 32)}{chr(0x4E00 + i)}z" for i in range(5000))
    ids, _ = use.encode(pa.array([text]))
    assert ids.tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert sum(n for n, _ in sizes) >= 5000 and max(n for n, _ in sizes) <= 1000
    sizes.clear()
    texts = ["".join(chr(0x4E00 + (i * 7 + k) % 5000) for k in range(3000)) for i in range(100)]
    ids, _ = use.encode(pa.array(texts))
    assert ids.tolist() == [i for text in texts for i in theirs.encode(text, add_special_tokens=False).ids]
    assert sum(c for _, c in sizes) == 300_000 and max(c for _, c in sizes) <= 1 << 17
