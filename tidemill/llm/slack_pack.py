"""Best-fit packing of tokenised documents by minimum bin slack.

A document is the ids of its text and an end id. One longer than a sequence is cut into pieces of whole sequences, of which
the first may be shorter. Pieces are told apart by their length alone, of which there are `size` at most, so the plan is made from
a count of pieces by length: a row for each length, whatever the corpus. For each sequence the longest piece left starts it, and a
dynamic program over subset sums finds the fullest combination of lengths left that goes with it: sums are bits of a whole number,
copies of a length double, lengths go from long to short, and the walk back takes as few short ones as it can. The
combination is removed. As long as all its lengths last, the next sequence would come out the same, so it is
removed as often at once as they last; then some length has run out, which happens some thousands of times at most. Fullest combinations alone use
up the short pieces, without which the last sequences can't be filled. So some plans keep pieces below a length back until the others are placed, fill
what those leave free by the same program, and the plan with the fewest sequences counts.

Pieces of a length are numbered from 0: tasks number their own, and a table of a row for each task and length has how many come before. A
number says which use of its length in the plan is its, and so which sequence and place. Texts are encoded once, where they are, and neither they nor
their ids shuffle.

Ids equal those of the tokenizers library. Texts are cut before a space behind a letter, a digit or a sign of ASCII or Latin-1, and before a sign behind
such a letter, where the pattern of byte-level BPE always cuts; of the parts of some texts the distinct ones are encoded, and a worker keeps the ids of `CACHE` of them, none longer than
`LONGEST_KEPT` characters. Texts that may hold a special token are encoded whole.

Defined results: a null or empty text is its end id alone; texts of any length are cut and packed whole; null ids take part, and rows that repeat
an id or a text are documents of their own; which of equal lengths goes to which sequence is in no certain order; an empty table gives no pieces; other
columns stay out.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.bpe_codec import byte_letters
from tidemill.llm.common import slices
from tidemill.llm.token_pack import WordEncoder, _gather
from tidemill.session import Scratch

SIZE, END_ID = 1024, 2
#: Spans and about the characters that are encoded at once, as what the library holds of them is far larger than their ids; rows of a task that numbers pieces, about.
AT_ONCE, CHARACTERS, NUMBERED = 1000, 1 << 17, 1 << 18
#: A combination of lengths, longest first, each with how many; and how many sequences have it.
Use = tuple[list[tuple[int, int]], int]


def fullest(lengths: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The lengths, and how many of each, whose sum comes closest to `room` from below. lengths: pairs of length and count, from long to short."""
    reach, mask, steps = 1, (2 << room) - 1, []
    for length, count in lengths:
        if length > room:
            continue
        steps.append((length, reach))
        left, copies = min(count, room // length), 1
        while left:
            copies = min(copies, left)
            reach |= (reach << copies * length) & mask
            left, copies = left - copies, 2 * copies
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        copies = 0
        while not before >> total & 1:
            total, copies = total - length, copies + 1
        if copies:
            out.append((length, copies))
    return out[::-1]


def _removed(left: dict[int, int], size: int, uses: list[Use]) -> None:
    """Fill sequences until no piece is left, and add them to the plan."""
    while left:
        first = max(left)
        rest = sorted(((n, c - (n == first)) for n, c in left.items() if c > (n == first)), reverse=True)
        found = dict(fullest(rest, size - first))
        found[first] = found.get(first, 0) + 1
        uses.append((sorted(found.items(), reverse=True), _take(left, found, None)))


def _take(left: dict[int, int], found: dict[int, int], most: int | None) -> int:
    """Remove a combination as often as its lengths last, and `most` times at most."""
    times = min([left[n] // k for n, k in found.items()] + ([] if most is None else [most]))
    for n, k in found.items():
        left[n] -= k * times
        if not left[n]:
            del left[n]
    return times


def _reserving(counts: dict[int, int], size: int, below: int) -> list[Use]:
    """A plan that keeps pieces shorter than `below` back, to fill with them what the others leave free."""
    long, short = ({n: c for n, c in counts.items() if c and (n < below) == side} for side in (False, True))
    made: list[Use] = []
    _removed(long, size, made)
    free = lambda combination: size - sum(n * k for n, k in combination)
    uses = []
    for combination, times in sorted(made, key=lambda use: (free(use[0]), use)):
        while times:
            found = dict(fullest(sorted(short.items(), reverse=True), free(combination)))
            done = _take(short, found, times) if found else times
            uses.append((sorted([*combination, *found.items()], reverse=True), done))
            times -= done
    _removed(short, size, uses)
    return uses


def plan(counts: dict[int, int], size: int = SIZE) -> list[Use]:
    """Combinations that hold all pieces: of some plans that keep short pieces back, or none, the one with the fewest sequences."""
    wrong = [n for n, c in counts.items() if c and not 0 < n <= size]
    if wrong:
        raise ValueError(f"pieces of {wrong[0]} ids don't fit sequences of {size}")
    least = -(-sum(n * c for n, c in counts.items()) // size)
    best: list[Use] | None = None
    for below in (0, *(size >> k for k in range(2, 8))):
        uses = _reserving(counts, size, below)
        if best is None or sum(t for _, t in uses) < sum(t for _, t in best):
            best = uses
        if sum(t for _, t in best) == least:
            break
    return best


class Places:
    """Where the pieces of each length go, by their number."""

    def __init__(self, uses: list[Use]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        upto: dict[int, int] = {}
        sequence = 0
        for combination, times in uses:
            offset = 0
            for length, copies in combination:
                start = upto.get(length, 0)
                rows.setdefault(length, []).append((start, copies, sequence, offset))
                upto[length] = start + copies * times
                offset += copies * length
            sequence += times
        self.by_length = {length: np.array(some, np.int64).T for length, some in rows.items()}

    def find(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and offsets of pieces."""
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            starts, copies, first, at = self.by_length[int(length)]
            use = np.searchsorted(starts, numbers[own], "right") - 1
            turn, slot = np.divmod(numbers[own] - starts[use], copies[use])
            sequence[own], offset[own] = first[use] + turn, at[use] + slot * length
        return sequence, offset


def few(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts, of `AT_ONCE` at most and about `CHARACTERS` in all, or one text."""
    start = total = 0
    for i, text in enumerate(texts):
        if i > start and (i - start == AT_ONCE or total + len(text) > CHARACTERS):
            yield texts[start:i]
            start, total = i, 0
        total += len(text)
    if texts:
        yield texts[start:]


class SpanEncoder:
    """A byte-level BPE tokenizer used on the distinct spans of some texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        cut = rules["pre_tokenizer"] or {}
        self.cuts = rules["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        self.special = [t["content"] for t in rules["added_tokens"]]
        self.known: dict[str, bytes] = {}

        if self.cuts:
            letters = byte_letters()
            self.letters, size = dict(enumerate(letters)), {letter: 1 for letter in letters}
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.sizes[list(vocabulary.values())] = [sum(size.get(letter, 0) for letter in piece) for piece in vocabulary]
            rules |= {"added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None}
            self.bare = Tokenizer.from_str(json.dumps(rules))

    #: Texts that are one pre-token each; Latin letters from U+00C0 to U+00FF.
    PLAIN = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-/:-@\[-`{-~]+)").fullmatch

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        """The ids of these spans. Those that are one pre-token go through the model alone, many at once; the bytes of ids tell them apart."""
        plain = [t for t in fresh if self.cuts and self.PLAIN(t)]
        others = list(set(fresh).difference(plain))
        found = {}
        for some in few(others):
            encoded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            found |= {text: np.array(e.ids, "<u4").tobytes() for text, e in zip(some, encoded, strict=True)}
        for some in few(plain):
            spelt = [t.replace(" ", self.letters[32]) if t.isascii() else t.encode().decode("latin-1").translate(self.letters) for t in some]
            ids = np.array(self.bare.encode_batch_fast([" ".join(spelt)], add_special_tokens=False)[0].ids, "<u4")
            upto, ends = np.cumsum(self.sizes[ids]), np.cumsum([len(t) for t in spelt])
            stops, raw = (4 * (np.searchsorted(upto, ends) + 1)).tolist(), ids.tobytes()
            found |= {text: raw[a:b] for text, a, b in zip(some, [0, *stops[:-1]], stops, strict=True)}
        return found

    def spans(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The parts of texts without nulls, and where each text's parts stop."""
        whole = pa.concat_arrays([texts])  # without an offset of its own
        base = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
        raw = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[base[0] : base[-1]]
        base = base - base[0]
        cut = np.zeros(len(raw) + 1, bool)
        if self.cuts and len(raw) > 2:
            before, after, pair = raw[1:-1], raw[2:], (raw[:-2] == 0xC3) & (raw[1:-1] >= 0x80)  # U+00C0 to U+00FF
            visible, lower, signs = (before > 0x20) & (before < 0x7F) | pair, before | 0x20, after | 0x20
            letter = (lower >= 0x61) & (lower <= 0x7A) & (before < 0x80) | pair & (before != 0x97) & (before != 0xB7)
            sign = (after > 0x20) & (after < 0x7F) & ~((signs >= 0x61) & (signs <= 0x7A)) & ~((after >= 0x30) & (after <= 0x39))
            cut[2:-1] = visible & (after == 0x20) | letter & sign
            if self.special:
                held = pc.match_substring(whole, self.special[0])
                for token in self.special[1:]:
                    held = pc.or_(held, pc.match_substring(whole, token))
                for k in np.flatnonzero(held.to_numpy(zero_copy_only=False)).tolist():
                    cut[base[k] : base[k + 1]] = False
        cut[base] = True
        edges = np.flatnonzero(cut).astype(np.int32)
        parts = pa.Array.from_buffers(pa.string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(raw)])
        return parts, np.searchsorted(edges, base[1:])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        parts, stops = self.spans(texts)
        coded = parts.dictionary_encode()
        pool, first, size = WordEncoder._look_up(coded.dictionary, self.known, self._learn)
        which = coded.indices.to_numpy()
        upto = np.concatenate([[0], np.cumsum(size[which])])[stops]
        return _gather(pool, first[which], size[which]), np.diff(upto, prepend=0)


@functools.lru_cache(maxsize=2)
def span_encoder(path: str) -> SpanEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return SpanEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32, _part (the task), _own (its number among the task's pieces of that length), and ids if they are asked for."""
    vocabulary, end = vocabulary or default_path(), np.array([end_id], "<u4")
    names = ["_id", "piece", "start", "length", "ids_crc32", "_part", "_own"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, part = span_encoder(vocabulary), TaskContext.get().partitionId()
        upto = np.zeros(size + 1, np.int64)
        for batch in slices(batches, "_text"):
            found, counts = use.encode(pc.fill_null(batch.column("_text"), ""))
            ends = np.cumsum(counts)
            ids = np.insert(found, ends, end)
            total = counts + 1
            many = -(-total // size)
            doc = np.repeat(np.arange(len(total)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            head = (total - (many - 1) * size)[doc]
            start, length = np.where(piece > 0, head + (piece - 1) * size, 0), np.where(piece > 0, size, head)
            at = np.repeat(np.cumsum(total) - total, many) + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            own = np.empty(len(length), np.int64)
            own[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered) + upto[ordered]
            upto += np.bincount(length, minlength=size + 1)
            columns = [batch.column("_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(own)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"_id {kind}, piece int, start long, length long, ids_crc32 long, _part int, _own long" + ", ids array<int>" * with_ids)


def pack(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_ids: bool = False, **options) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ids if they are asked for."""
    if size < 1:
        raise ValueError("a sequence holds one id at least")
    scratch = Scratch(spark, "packed")
    cut = scratch.save(pieces(docs, id_col, text_col, size=size, with_ids=with_ids, **options))
    totals = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.max("_part").alias("last")).collect()  # `size` rows at most
    places = Places(plan({r.length: r.n for r in totals}, size))
    counts = cut.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    # in files by its rows and not by partitions of a shuffle: many small ones look too large to be broadcast, and all pieces would shuffle
    base = scratch.save(base.coalesce(1 + sum(r["last"] + 1 for r in totals) // NUMBERED))
    names = ["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("_own").to_numpy() + batch.column("_base").to_numpy()
            sequence, offset = places.find(batch.column("length").to_numpy(), numbers)
            columns = [batch.column(c) for c in names[:5]] + [pa.array(sequence), pa.array(offset)] + [batch.column(c) for c in names[7:]]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = cut.schema["_id"].dataType.simpleString()
    out = cut.join(base, ["_part", "length"]).mapInArrow(placed, f"_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("_id", id_col)


def sequences(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, **options) -> DataFrame:
    """The packed sequences: sequence_id, ids (`size` at most), and pieces: id, piece and length of each in order."""
    placed = pack(spark, docs, id_col, text_col, size, True, **options)
    held = F.struct("offset", F.col(f"`{id_col}`").alias("doc"), "piece", "length", "ids")
    whole = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(held)).alias("p"))  # of bounded size
    return whole.select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: F.struct(x["doc"].alias("doc"), x["piece"].alias("piece"), x["length"].alias("length"))).alias("pieces"))
