"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint has 64 bits: bit i is 1 if it is set in over half of the hashes of a text's
shingles. To find all pairs within a radius of r bits, each bit position gets a vector of
r + 1 bits, none zero, dealt evenly and by a seed. Each of the 2^(r+1) - 1 nonzero vectors v is a table: its mask
keeps the positions whose vector has an odd product with v. At most r differing positions span
less than the whole space, so that some v is orthogonal to all their vectors: that table's mask
hides every difference, and the pair collides there. No pair within the radius is missed.

Equal fingerprints collapse first, so exact copies and much-copied texts are one node. Buckets of
each table are read in sorted runs by tasks, and a task emits only a spanning forest of a bucket's
links, never its pairs. A bucket of over `block` fingerprints is split into blocks, and each pair
of blocks is a unit of its own, so that the work spreads; all of its pairs are still compared.
Components of the forests are those of all links.

Defined results: a null or empty text, or one of white space only, has no shingle and
fingerprint zero, linked like any other; fewer words than a shingle are one shingle; texts of any
length are hashed whole; a null id takes part, and a component's id is its smallest id that isn't
null; repeated rows share a result; an empty table gives an empty result; rows of `near_dedup`
keep all their columns, whatever their names.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import components, keep_one, slices
from tidemill.session import Scratch

BITS = 64
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text: str | None, width: int) -> list[str]:
    """Word shingles, repeats included; fewer words are one shingle, none are none."""
    words = WORDS.findall((text or "").translate(LOWER))
    if len(words) <= width:
        return [" ".join(words)] if words else []
    return [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of a text."""
    import xxhash

    parts = shingles(text, width)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(parts), 1 << 14):
        digest = b"".join([xxhash.xxh64_digest(part, seed) for part in parts[at : at + (1 << 14)]])
        counts += np.unpackbits(np.frombuffer(digest, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(parts)).tobytes(), "big")


def masks(radius: int, seed: int = 7, bits: int = BITS) -> list[int]:
    """One mask for each table of the covering family."""
    dim = radius + 1
    deal = [1 + i % (2**dim - 1) for i in range(bits)]
    random.Random(seed).shuffle(deal)
    return [sum(1 << i for i in range(bits) if (deal[i] & v).bit_count() & 1) for v in range(1, 2**dim)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """_id, _raw (a hash of the text) and fp (the fingerprint as a signed long) of each row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = np.array([fingerprint(text, width, seed) for text in batch.column("_text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_raw"), pa.array(found.view(np.int64))], ["_id", "_raw", "fp"])

    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_raw"), text.alias("_text"))
    return rows.mapInArrow(hashed, f"_id {rows.schema['_id'].dataType.simpleString()}, _raw long, fp long")


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, by a search that compares
    each one reached with those not reached yet."""
    edges, left = [], fps.view(np.uint64)
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                found = left[near]
                edges += [(int(at), int(x)) for x in found]
                front += list(found)
                left = left[~near]
    return edges


def _runs(radius: int):
    """Links of buckets, from batches sorted by bucket; a bucket may cross batches."""

    def links(key: pa.RecordBatch | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.empty((0, 4), np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("t", "k", "i", "j")], axis=1)
            keys, fps = np.concatenate([held_keys, keys]), np.concatenate([held, batch.column("fp").to_numpy()])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            done = cuts[-1] if len(cuts) else 0
            yield from emit(fps[:done], cuts[:-1])
            held_keys, held = keys[done:], fps[done:]
        yield from emit(held, np.empty(0, np.int64))

    def emit(fps: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(fps):
            return
        starts, ends = np.concatenate([[0], cuts]).astype(np.int64), np.concatenate([cuts, [len(fps)]]).astype(np.int64)
        pairs = starts[ends - starts == 2]
        near = pairs[np.bitwise_count(fps[pairs].view(np.uint64) ^ fps[pairs + 1].view(np.uint64)) <= radius]
        a, b = [fps[near]], [fps[near + 1]]
        for start, end in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
            if edges := forest(fps[start:end], radius):
                found = np.array(edges, np.uint64).view(np.int64)
                a.append(found[:, 0])
                b.append(found[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return lambda batches: links(None, batches)


def links(nodes: DataFrame, scratch: Scratch, radius: int = 3, block: int = 4096) -> DataFrame:
    """Links a and b that connect what all pairs of nodes.fp within the radius connect.

    nodes: distinct fingerprints, with their bucket keys computed from the masks. Buckets of
    one fingerprint are dropped before the sort; larger than `block` ones are split. The sizes
    are a table of their own, so that the join with them can split a hot bucket.
    """
    tables = F.array(*(F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks(radius))))
    keyed = nodes.select("fp", F.explode(tables).alias("b")).select("b.t", "b.k", "fp")
    sizes = scratch.save(keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64("fp"), parts)
    # block x of a bucket belongs to the units (x, y) and (y, x) for each other block y
    units = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda y: F.struct(F.least(own, y).alias("i"), F.greatest(own, y).alias("j")))
    dealt = keyed.join(sizes, ["t", "k"]).select("t", "k", "fp", F.explode(units).alias("u")).select("t", "k", "u.i", "u.j", "fp")
    spread = dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "fp")
    return spread.mapInArrow(_runs(radius), "a long, b long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _found(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, radius: int, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, distinct fingerprints with their smallest id, and the component of those that are linked."""
    rows = scratch.save(fingerprints(docs, id_col, text_col, width))
    nodes = scratch.save(rows.groupBy("fp").agg(F.min("_id").alias("least")))
    found = components(spark, links(nodes, scratch, radius), scratch).select(F.col("node").alias("fp"), "component")
    return rows, nodes, scratch.save(found)


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits) and component_id."""
    scratch = Scratch(spark, "simhash")
    rows, nodes, found = _found(spark, docs, id_col, text_col, radius, width, scratch)
    whole = nodes.join(found, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    moved = found.join(whole, "component").select("fp", "component_id")
    named = scratch.save(nodes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(named, "fp", "left").select(F.col("_id").alias(id_col), text.alias("fingerprint"), "component_id")


def near_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """The rows that stay, with all their columns: of each component that with the smallest id.

    Rows that only share an id are documents of their own; those alike in id and text share a decision. `simhash_similar`
    has the same for a similarity of texts in place of a radius.
    """
    scratch = Scratch(spark, "simhash")
    rows, _, found = _found(spark, docs, id_col, text_col, radius, width, scratch)
    named = rows.join(found, "fp", "left").select("_id", "_raw", F.coalesce("component", "fp").alias("component"))
    return keep_one(docs, named, id_col, F.xxhash64(F.col(f"`{text_col}`")), scratch)
