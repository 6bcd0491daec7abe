"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

A rank file lists byte strings with ranks. Each byte gets a printable character, each byte
string becomes a piece of such characters scored by its negative rank, and the normaliser is
the identity, so that sentencepiece's merges (best score first, leftmost on ties) are those of
the rank file (lowest rank first, leftmost on ties). The model is serialised straight from
the vocabulary; nothing is trained. Texts are cut into pre-tokens by a pattern, each pre-token
is encoded alone, and a pre-token that is itself in the vocabulary is that one id. Decoding maps
ids back to byte strings.

Texts stay in their partitions: nothing shuffles, and memory is bounded by a batch of texts
and a cache of `CACHE` pre-tokens for each worker, none longer than `LONGEST_KEPT` characters: 170 MB at the very
most. One very long pre-token is encoded whole and not kept.

Defined results: a null text counts as empty and gives no ids; texts of any length are encoded
whole; repeated rows are encoded alike; an empty table gives an empty result; extra columns
stay, and a column named as the result is replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from tidemill.llm.common import LONGEST_KEPT, slices

#: Pre-tokens kept with their ids by each Python worker.
CACHE = 200_000

#: White space as Unicode has it; stated since regex engines differ on U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0  -     　"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks, in a file of base64 and rank by line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is one, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def model_bytes(ranks: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """A serialised sentencepiece BPE model, and the rank of each of its ids (the last is unknown: -1)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    letters = byte_letters()
    model = pb.ModelProto()
    order = sorted(ranks.items(), key=lambda item: item[1])
    for piece, rank in order:
        model.pieces.add(piece="".join(letters[b] for b in piece), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="⁇", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type = pb.TrainerSpec.BPE
    spec.vocab_size = len(model.pieces)
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(order), -1, -1, -1
    spec.unk_piece = "⁇"
    rules = model.normalizer_spec
    rules.name = "identity"
    rules.add_dummy_prefix = rules.remove_extra_whitespaces = rules.escape_whitespaces = False
    return model.SerializeToString(), [rank for _, rank in order] + [-1]


class Codec:
    """Encodes and decodes texts; one for each worker process and vocabulary."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        model, self.rank_of = model_bytes(self.ranks)
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.letters = dict(enumerate(byte_letters()))
        stated = pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.split = regex.compile(stated).findall
        self.bytes_of = {rank: piece for piece, rank in self.ranks.items()}
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, tokens: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of these pre-tokens."""
        found, hard = {}, []
        for token in tokens:
            raw = token.encode()
            whole = self.ranks.get(raw)
            if whole is None:
                hard.append((token, raw.decode("latin-1").translate(self.letters)))
            else:
                found[token] = (whole,)
        rank_of = self.rank_of
        for (token, _), ids in zip(hard, self.merges.encode([x for _, x in hard], num_threads=1) if hard else (), strict=True):
            found[token] = tuple([rank_of[i] for i in ids])
        return found

    def encode(self, text: str) -> list[int]:
        tokens = self.split(text)
        known = self.known
        fresh = set(tokens).difference(known)
        if not fresh:
            return list(chain.from_iterable(map(known.__getitem__, tokens)))
        learned = self._learn(list(fresh))
        ids = list(chain.from_iterable([learned[t] if t in learned else known[t] for t in tokens]))
        kept = {t: learned[t] for t in islice((t for t in learned if len(t) <= LONGEST_KEPT), CACHE)}
        if len(known) + len(kept) > CACHE:
            known.clear()
        known.update(kept)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add the ids of each text as an array column."""
    path, pattern = path or default_path(), pattern or default_pattern()

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids_of(texts: pa.Array) -> pa.Array:
        use = codec(path, pattern)
        return pa.array([use.encode(text or "") for text in texts.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(ids_col, ids_of(F.col(f"`{text_col}`")))


def decode(docs: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add the bytes of each array of ids; null arrays give no bytes."""
    path, pattern = path or default_path(), pattern or default_pattern()

    @F.arrow_udf(BinaryType())
    def bytes_of(arrays: pa.Array) -> pa.Array:
        use = codec(path, pattern)
        return pa.array([use.decode(ids or []) for ids in arrays.to_pylist()], pa.binary())

    return docs.withColumn(bytes_col, bytes_of(F.col(f"`{ids_col}`")))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode each text in its task: id, n_tokens, ids_sha256 and decoded_sha256.

    ids_sha256 is over the decimal ids joined by commas; bytes stay in the task, and so do ids
    unless they are asked for, as a column ids.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        decimal = {rank: str(rank) for rank in use.bytes_of}.__getitem__
        for batch in slices(batches, "_text"):
            counts, of_ids, of_bytes, all_ids = [], [], [], []
            for text in batch.column("_text").to_pylist():
                ids = use.encode(text or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(use.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(np.array(ids, np.int32))
            columns = [batch.column("_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids, names)

    names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(digests, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("_id", id_col)
