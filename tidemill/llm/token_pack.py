"""Token-id output in Simple-8b blocks.

Ids are packed in 64-bit words: the top four bits select a layout, the other sixty hold as many
ids of equal width as that layout has. A value of over sixty bits is an escape: its place in the
words holds zero, and its index and value follow the words. Words restart every `CHUNK` ids,
and the block's header has the word offset of each chunk, so that chunks decode alone and all
words of one layout decode in one vectorised step.

A file is a Parquet part whose rows are blocks in order: part, block, ids before it in its part, ids of
the documents in it, ids (tokens) of each, and the packed bytes. Documents are sorted by id across parts, and a block ends
with a document, so reading needs no neighbour. Spark's commit protocol makes parts whole or
absent, also when executors are lost. Texts shuffle once, by ranges of the document id. A worker keeps the ids of `CACHE`
words and pieces each, none longer than `LONGEST_KEPT` characters.

Defined results: a null text counts as empty, and an empty text has the end id only; texts of
any length are one document of one block; null document ids come first; repeated rows are
documents of their own, in no certain order among themselves; an empty table gives
an empty result; other columns aren't written.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.bpe_codec import byte_letters
from tidemill.llm.common import LONGEST_KEPT, slices
from tidemill.session import Scratch

#: Ids and bits of each by selector.
LAYOUTS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
#: Ids between restarts of the words, ids from which a block is full, words kept with their ids by a worker.
CHUNK, BLOCK, CACHE = 1 << 14, 1 << 16, 400_000
HEADER = struct.Struct("<4sIII")
MAGIC = b"S8B1"


def _words(values: np.ndarray) -> np.ndarray:
    """The words of one chunk, each taking the most values that fit; the last one is padded by zeros."""
    n, longest = len(values), LAYOUTS[0][0]
    padded = np.concatenate([values, np.zeros(longest, np.uint64)])
    bits = np.frexp((padded >> np.uint64(30)).astype(np.float64))[1] + 30  # exact up to 53 bits, so in two halves
    low = bits == 30
    bits[low] = np.frexp(padded[low].astype(np.float64))[1]
    choice = np.full(n, len(LAYOUTS) - 1, np.uint8)
    for selector in range(len(LAYOUTS) - 2, -1, -1):
        count, width = LAYOUTS[selector]
        fit = bits <= width
        if fit[:n:count].any():  # any run of so many holds a multiple of it
            wide = np.concatenate([[0], np.cumsum(~fit, dtype=np.int32)])
            choice[(wide[count : n + count] == wide[:n])] = selector
    step = np.array([count for count, _ in LAYOUTS])[choice].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts, np.int64)
    selectors = choice[starts]
    out = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors):
        count, width = LAYOUTS[selector]
        if width:
            rows = np.flatnonzero(selectors == selector)
            cells = padded[starts[rows][:, None] + np.arange(count)]
            out[rows] |= np.bitwise_or.reduce(cells << (np.arange(count, dtype=np.uint64) * np.uint64(width)), axis=1)
    return out


def _values(words: np.ndarray) -> np.ndarray:
    """All values of some words, padding included."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([count for count, _ in LAYOUTS])[selectors]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector in np.unique(selectors):
        count, width = LAYOUTS[selector]
        if width:
            rows = np.flatnonzero(selectors == selector)
            cells = words[rows][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(width))
            out[starts[rows][:, None] + np.arange(count)] = cells & np.uint64((1 << width) - 1)
    return out


def pack(values: np.ndarray) -> bytes:
    """A block: header, word offset of each chunk, words, escapes."""
    values = values.astype(np.uint64)
    escapes = np.flatnonzero(values >> np.uint64(60))
    low = values.copy()
    low[escapes] = 0
    chunks = [_words(low[i : i + CHUNK]) for i in range(0, len(low), CHUNK)]
    ends = np.cumsum([len(c) for c in chunks], dtype=np.uint32)
    head = HEADER.pack(MAGIC, len(values), len(chunks), len(escapes))
    return b"".join([head, ends.tobytes(), *(c.tobytes() for c in chunks), escapes.astype(np.uint32).tobytes(), values[escapes].tobytes()])


def unpack(block: bytes) -> np.ndarray:
    """The values of a block."""
    magic, n, n_chunks, n_escapes = HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of packed ids")
    at = HEADER.size
    ends = np.frombuffer(block, np.uint32, n_chunks, at)
    at += 4 * n_chunks
    n_words = int(ends[-1]) if n_chunks else 0
    words = np.frombuffer(block, np.uint64, n_words, at)
    at += 8 * n_words
    parts = [_values(words[a:b])[:CHUNK] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]
    out = np.concatenate(parts)[:n] if parts else np.empty(0, np.uint64)
    out[np.frombuffer(block, np.uint32, n_escapes, at)] = np.frombuffer(block[at + 4 * n_escapes :], np.uint64, n_escapes)
    return out


def _gather(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of a pool that start at `first`, one after the other."""
    ends = np.cumsum(size)
    return pool[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class WordEncoder:
    """A tokenizer whose rules never look across white space, used on the distinct words of some texts.

    Arrow parts texts at ASCII white space and finds the distinct words. Most are Latin letters with
    signs behind or without: pieces that the tokenizer's rules cut there and put in lower case. Distinct pieces
    are encoded together, parted by spaces, by the same model without those rules; the ids that end a
    piece tell them apart. Other words are encoded whole, parted by a control character of which the
    tokenizer makes one id that no other text gives; words that hold it, or may hold a special token, go alone.
    """

    MARK = "\x01"
    #: Latin letters to U+017F but for U+0130, which have one lower case each and no combining forms; ASCII signs.
    LETTERS, SIGNS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    PLAIN = f"^[{LETTERS}]+[!-/:-@\\[-`{{-~]*$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        found = self._ids(self.MARK)
        self.mark = found[0] if len(found) == 1 else None
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {"": b""}
        rules = json.loads(self.tokenizer.to_str())
        suffix, cut = rules["model"].get("end_of_word_suffix"), rules["pre_tokenizer"]
        self.ends = None
        if suffix and cut["type"] == "Sequence" and [c["type"] for c in cut["pretokenizers"]] == ["Split", "ByteLevel"]:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
            rules |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}
            self.bare = Tokenizer.from_str(json.dumps(rules))
            self.letters = dict(enumerate(byte_letters()))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn_pieces(self, fresh: list[str]) -> dict[str, bytes]:
        spelt = (p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in fresh)
        ids = np.array(self.bare.encode_batch_fast([" ".join(spelt)], add_special_tokens=False)[0].ids, "<u4")
        stops, raw = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), ids.tobytes()
        return {piece: raw[a:b] for piece, a, b in zip(fresh, [0, *stops[:-1]], stops, strict=True)}

    def _learn_words(self, fresh: list[str]) -> dict[str, bytes]:
        plain = [w for w in fresh if self.mark is not None and self.MARK not in w and "<|" not in w]
        found = {w: self._ids(w).tobytes() for w in set(fresh).difference(plain)}
        if plain:
            ids = self._ids(f" {self.MARK} ".join(plain))
            raw, cuts = ids.tobytes(), [0, *(4 * np.flatnonzero(ids == self.mark) + 4).tolist(), 4 * len(ids) + 4]
            found |= {w: raw[a : b - 4] for w, a, b in zip(plain, cuts[:-1], cuts[1:], strict=True)}
        return found

    @staticmethod
    def _look_up(texts: pa.Array, known: dict[str, bytes], learn: Callable[[list[str]], dict[str, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct texts one after the other, where each starts, and how many it has."""
        listed = texts.to_numpy(zero_copy_only=False).tolist()
        fresh = [t for t in listed if t not in known]
        if fresh:
            learned = learn(fresh)
            found = [learned[t] if t in learned else known[t] for t in listed]
            kept = {t: learned[t] for t in islice((t for t in fresh if len(t) <= LONGEST_KEPT), CACHE)}
            if len(known) + len(kept) > CACHE:
                known.clear()
                known[""] = b""
            known |= kept
        else:
            found = [known[t] for t in listed]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size, size

    def _encode_distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _look_up, for distinct words."""
        if self.ends is None:
            return self._look_up(words, self.words, self._learn_words)
        plain = pc.match_substring_regex(words, self.PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(words.filter(plain))
        letters = pc.ascii_rtrim(low, characters=self.SIGNS)
        signs = pc.replace_substring_regex(low, pattern=f"^[{self.LETTERS}]+", replacement="").dictionary_encode()
        letters = letters.dictionary_encode()
        # letters and signs have no text in common but the empty one, of words without signs
        pool, first, size = self._look_up(pa.concat_arrays([letters.dictionary, signs.dictionary]), self.pieces, self._learn_pieces)
        both = np.column_stack([letters.indices.to_numpy(), len(letters.dictionary) + signs.indices.to_numpy()]).ravel()
        others = self._look_up(words.filter(pc.invert(plain)), self.words, self._learn_words)
        out_size = np.empty(len(words), np.int64)
        out_size[is_plain] = size[both].reshape(-1, 2).sum(axis=1)
        out_size[~is_plain] = others[2]
        out_first = np.empty(len(words), np.int64)
        flat = _gather(pool, first[both], size[both])
        out_first[is_plain] = np.cumsum(out_size[is_plain]) - out_size[is_plain]
        out_first[~is_plain] = len(flat) + others[1]
        return np.concatenate([flat, others[0]]), out_first, out_size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.values.dictionary_encode()
        pool, first, size = self._encode_distinct(coded.dictionary)
        word = coded.indices.to_numpy()
        stops = np.concatenate([[0], np.cumsum(size[word])])[parts.offsets.to_numpy()]
        return _gather(pool, first[word], size[word]), np.diff(stops)


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return WordEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1, block: int = BLOCK) -> None:
    """Encode texts and write their ids, each document's followed by end_id, in ascending id order."""
    vocabulary, end = vocabulary or default_path(), np.array([end_id], "<u4")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, part, number, first = word_encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        ids, size, counts, docs_in = [], 0, [], []

        def full() -> pa.RecordBatch:
            payload = pack(np.concatenate(ids))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([docs_in], pa.list_(kind)), pa.array([counts], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                ["part", "block", "first", "docs", "counts", "payload"],
            )

        for batch in slices(batches, "_text"):
            kind = batch.schema.field("_id").type
            found, sizes = use.encode(pc.fill_null(batch.column("_text"), ""))
            stops = np.cumsum(sizes)
            for doc, a, b in zip(batch.column("_id").to_pylist(), (stops - sizes).tolist(), stops.tolist(), strict=True):
                ids += found[a:b], end
                counts.append(b - a + 1)
                size += counts[-1]
                docs_in.append(doc)
                if size >= block:
                    yield full()
                    ids, size, counts, docs_in, number, first = [], 0, [], [], number + 1, first + size
        if counts:
            yield full()

    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    dealt = rows.repartitionByRange(F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first())
    kind_name = rows.schema["_id"].dataType.simpleString()
    dealt.mapInArrow(blocks, f"part int, block int, first long, docs array<{kind_name}>, counts array<long>, payload binary").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str, each: Callable[[np.ndarray], object], kind: str, arrow: pa.DataType) -> DataFrame:
    """Read files back: doc, start, n_tokens and `value`, what `each` makes of a document's ids.

    start counts the ids of all documents before. Blocks have the count within their part; what parts
    before hold is a row for each part, of a few numbers, and is broadcast.
    """
    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.max(F.struct("first", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))).alias("last"))
    held = F.col("last.first") + F.col("last.n")
    before = parts.select("part", (F.sum(held).over(Window.orderBy("part")) - held).alias("base"))
    doc_kind = blocks.schema["docs"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload", 1 << 20):
            for i in range(batch.num_rows):
                ids = unpack(batch.column("payload")[i].as_py())
                counts = batch.column("counts")[i].values.to_numpy()
                ends = np.cumsum(counts)
                values = [each(ids[end - n : end]) for n, end in zip(counts.tolist(), ends.tolist(), strict=True)]
                starts_of = ends - counts + (batch.column("first")[i].as_py() + batch.column("base")[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column("docs")[i].values, pa.array(starts_of, pa.int64()), pa.array(counts, pa.int64()), pa.array(values, arrow)], ["doc", "start", "n_tokens", "value"])

    return blocks.join(F.broadcast(before), "part").mapInArrow(documents, f"doc {doc_kind}, start long, n_tokens long, value {kind}")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Read files back: doc, start, n_tokens and value, the array of ids."""
    return read(spark, path, lambda ids: ids.astype(np.int64), "array<long>", pa.list_(pa.int64()))


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_and_check(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write files in the shared folder and read them back: id, start, n_tokens and ids_crc32."""
    path = f"{Scratch(spark, 'tokens').path}/ids"
    write(docs, path, id_col, text_col, **options)
    return read(spark, path, ids_crc32, "long", pa.int64()).withColumnsRenamed({"doc": id_col, "value": "ids_crc32"})
