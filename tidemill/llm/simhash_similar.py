"""SimHash near-dedup by the similarity of texts: covering locality-sensitive hashing of long fingerprints.

A text is the set of its shingles of `WIDTH` words, and texts are linked at a Jaccard similarity of `SIMILARITY` or more.
Sets that are equal are one node. Its fingerprint has `PARTS` x `PART_BITS` bits: bit i is 1 if it is set in over half
of the hashes of its shingles. Two sets of similarity s differ in about acos(2s / (1 + s)) / pi of the bits: 15 % at
0.8. Each part has a covering family of masks (`simhash_dedup.masks`) for `PART_RADIUS` bits, so that of two
fingerprints within PARTS x (PART_RADIUS + 1) - 1 bits some part is within its radius, and they collide in one of
its tables: no pair within that distance is missed. That is 9 % of the bits, as of sets of similarity 0.92. Farther pairs collide in some
of 300 tables, if not by guarantee: of 3,917 pairs of near copies of 0.1 GB of documents 99.6 % at similarities of
0.80 to 0.82, 99.8 % at 0.82 to 0.85, and all above.

A key holds a class of the set's size too, a power of 4: similar sets share the class of the larger one, and texts of other sizes don't meet by chance.
In each bucket a task finds the minimum spanning trees of the fingerprints that are within `REACH` of the bits, never the pairs. A bucket of
over `block` nodes is split into blocks, and each pair of blocks is a unit of its own. Trees' edges are then
decided by the true similarity of their sets. Where a connected group of edges isn't one component of links yet, all
its nodes of different components that are within reach are compared by their sets, again in pairs of blocks, which leave a forest of
links. Components are those of all links. The keys of all tables shuffle as one long each beside the node.

Comparisons grow with the square of the distinct texts of a class by 2^23, the bits that a mask keeps; `part_bits` trades them for
the guarantee.

Defined results: texts without words are one node; fewer words than a shingle are one
shingle; texts of any length are compared whole; a component's id is its smallest id that isn't null, and its row that stays is the
one of that id, then of the smallest hash of its text; rows that repeat both id and text share a decision; rows that
only share an id are documents of their own; an empty table gives an empty result; all columns stay, whatever their names.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import components, keep_one, slices
from tidemill.llm.exact_dedup import filter_of, flag
from tidemill.llm.simhash_dedup import masks, shingles
from tidemill.session import Scratch

WIDTH, SIMILARITY = 5, 0.8
PARTS, PART_BITS, PART_RADIUS = 20, 44, 3
#: Share of the bits in which linked sets may differ: over three standard deviations beyond what similarity 0.8 has.
REACH = 0.2


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    import xxhash

    return np.unique(np.array([xxhash.xxh64_intdigest(part, 42) for part in shingles(text, width)], np.uint64))


def fingerprint(hashes: np.ndarray, bits: int, seed: int = 11) -> np.ndarray:
    """Bits of a set of hashes, each of which is stretched to so many bits."""
    draw, words = random.Random(seed), -(-bits // 64)
    odd = np.array([[draw.getrandbits(64) | 1 for _ in range(words)] for _ in range(2)], np.uint64)
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):  # sums of 255 bits fit a byte
        mixed = hashes[at : at + 255, None] * odd[0]
        mixed ^= mixed >> np.uint64(32)
        mixed *= odd[1]
        counts += np.unpackbits(mixed.view(np.uint8).reshape(len(mixed), -1), axis=1).sum(axis=0, dtype=np.uint8)
    return (2 * counts > len(hashes))[:bits]


def size_classes(n: int, similarity: float) -> list[int]:
    """Powers of 4 that hold the sizes of sets that can be similar to a larger one of its own: those of n, and of the largest of these sizes.

    Sets of that similarity share the class of the larger one.
    """
    return sorted({max(0, x.bit_length() - 1) // 2 for x in (n, int(n / similarity) + 1)}) if n else [0]


def _node(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def nodes_of(docs: DataFrame, id_col: str, text_col: str, width: int, part_bits: int, similarity: float = SIMILARITY) -> DataFrame:
    """_id, _raw (a hash of the text), node, sizes (classes of its set's size), parts (numbers) and bits (packed) of each row."""
    power = 1 << np.arange(part_bits, dtype=np.int64)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            sets = [shingle_set(text, width) for text in batch.column("_text").to_pylist()]
            prints = [fingerprint(s, PARTS * part_bits) for s in sets]
            parts = [p.reshape(PARTS, part_bits) @ power for p in prints]
            sizes = pa.array([size_classes(len(s), similarity) for s in sets], pa.list_(pa.int32()))
            columns = [pa.array([_node(s) for s in sets], pa.int64()), sizes, pa.array(parts, pa.list_(pa.int64())), pa.array([np.packbits(p).tobytes() for p in prints], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_raw"), *columns], ["_id", "_raw", "node", "sizes", "parts", "bits"])

    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_raw"), text.alias("_text"))
    return rows.mapInArrow(hashed, f"_id {rows.schema['_id'].dataType.simpleString()}, _raw long, node long, sizes array<int>, parts array<long>, bits binary")


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """node and hashes (its set) of each text in the column _text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            sets = [shingle_set(text, width) for text in batch.column("_text").to_pylist()]
            columns = [pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "hashes"])

    return texts.mapInArrow(cut, "node long, hashes array<long>")


def unpacked(column: pa.Array) -> np.ndarray:
    """Rows of 64-bit words of packed fingerprints of one length."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(np.uint64)


def apart(bits: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many bits rows differ from one."""
    return np.bitwise_count(bits ^ one).sum(axis=-1, dtype=np.int64)


def spanning_trees(bits: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Edges of the minimum spanning trees of rows, without those that are longer than `reach`."""
    edges, left, rows = [], np.arange(1, len(bits)), bits[1:].copy()
    best, near = apart(rows, bits[0]), np.zeros(len(left), np.int64)
    while len(left):
        k = int(best.argmin())
        at, row = left[k], rows[k].copy()
        if best[k] <= reach:
            edges.append((int(near[k]), int(at)))
        for column in (left, best, near, rows):
            column[k] = column[-1]
        left, best, near, rows = left[:-1], best[:-1], near[:-1], rows[:-1]
        new = apart(rows, row)
        closer = new < best
        best[closer], near[closer] = new[closer], at
    return edges


def _trees(reach: int):
    """Edges of buckets' trees, from batches sorted by unit; a unit may cross batches."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = held = bits = None
        for batch in batches:
            if not batch.num_rows:
                continue
            more = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1), batch.column("node").to_numpy(), unpacked(batch.column("bits"))
            keys, held, bits = more if keys is None else (np.concatenate(both) for both in zip((keys, held, bits), more, strict=True))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            done = int(cuts[-1]) if len(cuts) else 0
            yield found(held[:done], bits[:done], cuts[:-1])
            keys, held, bits = keys[done:], held[done:], bits[done:]
        if keys is not None:
            yield found(held, bits, np.empty(0, np.int64))

    def found(nodes: np.ndarray, bits: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        starts, ends = np.concatenate([[0], cuts]).astype(np.int64), np.concatenate([cuts, [len(nodes)]]).astype(np.int64)
        pairs = starts[ends - starts == 2]
        pairs = pairs[apart(bits[pairs], bits[pairs + 1]) <= reach]
        a, b = [nodes[pairs]], [nodes[pairs + 1]]
        for start, end in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
            tree = np.array(spanning_trees(bits[start:end], reach), np.int64).reshape(-1, 2) + start
            a.append(nodes[tree[:, 0]])
            b.append(nodes[tree[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return edges


def _units(parts, own):
    """Units (i, j) of pairs of blocks that block `own` of so many belongs to."""
    return F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda y: F.struct(F.least(own, y).alias("i"), F.greatest(own, y).alias("j")))


def tree_edges(nodes: DataFrame, scratch: Scratch, part_bits: int, block: int) -> DataFrame:
    """Edges a < b of the trees of all tables' buckets. nodes: node, sizes, parts and bits.

    A bucket is of one table, one value under its mask and one class of sizes, as sets of very different sizes aren't similar.
    """
    family = masks(PART_RADIUS, bits=part_bits)
    first = (F.col("size").cast("long") * PARTS + F.col("p")) * len(family)
    keys = F.array(*(F.shiftleft(first + t, part_bits).bitwiseOR(F.col("v").bitwiseAND(F.lit(mask))) for t, mask in enumerate(family)))
    # dealt out first, as each node gives a key for each table; without nulls, which joins would else filter on one side only
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt_nodes = nodes.where("node IS NOT NULL").select("node", "sizes", "parts").repartition(n, "node").select("node", F.explode("sizes").alias("size"), "parts")
    keyed = dealt_nodes.select("node", "size", F.posexplode("parts").alias("p", "v")).select("node", F.explode(keys).alias("key")).repartition(n, "key")
    # both sides of the join are dealt alike, so keys shuffle once; the nodes' least and largest keep the column in either
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("x"), F.max("node").alias("y")).where("x != y").drop("x", "y")
    parts = F.ceil(F.col("n") / block)
    dealt = keyed.join(sizes, "key").select("key", "node", F.explode(_units(parts, F.pmod(F.xxhash64("node"), parts))).alias("u"))
    spread = dealt.select("key", "u.i", "u.j", "node").join(nodes.select("node", "bits"), "node")
    sorted_units = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return scratch.save(sorted_units.mapInArrow(_trees(int(REACH * PARTS * part_bits)), "a long, b long").distinct())


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def verified(edges: DataFrame, sets: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """The edges whose sets are similar."""
    one = edges.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("own")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), "hashes"), "b")
    shared = both.select("a", "b", (F.size("own") + F.size("hashes")).alias("total"), F.size(F.array_intersect("own", "hashes")).alias("both"))
    return scratch.save(shared.where(F.col("both") >= F.lit(similarity) * (F.col("total") - F.col("both"))).select("a", "b"))


def forest(nodes: list[int], labels: list[int], bits: np.ndarray, sets: list[np.ndarray], reach: int, similarity: float) -> list[tuple[int, int]]:
    """Links that connect what all links between nodes of different labels connect; labels are components known before."""
    edges, label = [], np.unique(np.array(labels), return_inverse=True)[1]
    for i in range(len(nodes) - 1):
        far = apart(bits[i + 1 :], bits[i])
        for k in np.flatnonzero((far <= reach) & (label[i + 1 :] != label[i])) + i + 1:
            if label[k] != label[i] and alike(sets[i], sets[k], similarity):
                edges.append((nodes[i], nodes[k]))
                label[label == label[k]] = label[i]
    return edges


def _open_units(reach: int, similarity: float):
    """Links of units of nodes with their sets, from batches sorted by unit; a unit may cross batches."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("c", "i", "j")), strict=True)):
                if key != now:
                    yield emit(held)
                    now, held = key, []
                held.append((batch.column("node")[row].as_py(), batch.column("v")[row].as_py(), batch.column("bits")[row].as_py(), batch.column("hashes")[row].values.to_numpy()))
        yield emit(held)

    def emit(held: list[tuple]) -> pa.RecordBatch:
        edges = []
        if len(held) > 1:
            nodes, labels, packed, sets = zip(*held, strict=True)
            edges = forest(list(nodes), list(labels), unpacked(pa.array(packed, pa.binary())), list(sets), reach, similarity)
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return links


def open_links(groups: DataFrame, known: DataFrame, nodes: DataFrame, sets: DataFrame, scratch: Scratch, similarity: float, part_bits: int, block: int) -> DataFrame:
    """Links between components known so far, within groups of nodes that edges connect.

    groups and known: node and component. Groups of one component need nothing more.
    """
    v = F.coalesce("v", "node")
    named = scratch.save(groups.select("node", F.col("component").alias("c")).join(known.select("node", F.col("component").alias("v")), "node", "left").select("node", "c", v.alias("v")))
    state = named.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("x"), F.max("v").alias("y"))
    left = scratch.save(state.where("x != y").select("c", F.ceil(F.col("n") / block).alias("parts")))
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    dealt = named.join(left, "c").select("c", "node", "v", F.explode(_units(F.col("parts"), own)).alias("u")).select("c", "u.i", "u.j", "node", "v")
    full = dealt.join(nodes.select("node", "bits"), "node").join(sets, "node")
    spread = full.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "node")
    return scratch.save(spread.select("c", "i", "j", "node", "v", "bits", "hashes").mapInArrow(_open_units(int(REACH * PARTS * part_bits), similarity), "a long, b long"))


def _components(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, similarity: float, width: int, part_bits: int, block: int, open_block: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _raw, node), and node and component of the nodes that are linked."""
    rows = scratch.save(nodes_of(docs, id_col, text_col, width, part_bits, similarity))
    nodes = scratch.save(rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("sizes", "parts", "bits"))))
    edges = tree_edges(nodes, scratch, part_bits, block)
    wanted = scratch.save(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    # texts that a filter of bounded size knows are hashed once more, so that only sets of nodes with edges shuffle and are written
    known = scratch.save(filter_of(rows.join(wanted, "node").select(F.col("_raw").alias("_h"))))
    text = F.col(f"`{text_col}`")
    again = flag(docs.select(text.alias("_text"), F.xxhash64(text).alias("_h")), known).where("_again").select("_text")
    sets = scratch.save(sets_of(again, width).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")))
    links = verified(edges, sets, scratch, similarity)
    linked = scratch.save(components(spark, links, scratch))
    groups = scratch.save(_joined_up(spark, linked, edges.join(links, ["a", "b"], "left_anti"), scratch))
    more = open_links(groups, linked, nodes, sets, scratch, similarity, part_bits, open_block)
    scratch.drop(sets)
    return rows.select("_id", "_raw", "node"), scratch.save(_joined_up(spark, linked, more, scratch))


def _joined_up(spark: SparkSession, linked: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """Components (node and component) with further links: those of the components that the links join, of which there are few."""
    ends = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
    single = ends.join(linked, "node", "left_anti").select("node", F.col("node").alias("component"))
    known = scratch.save(linked.select("node", "component").union(single))
    up = more
    for side in ("a", "b"):
        up = up.join(known.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side)
    top = components(spark, up.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch)
    moved = scratch.save(top.select(F.col("node").alias("component"), F.col("component").alias("top")))
    return known.join(moved, "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = WIDTH, part_bits: int = PART_BITS, block: int = 2048, open_block: int = 256) -> DataFrame:
    """One row per input row: id and component_id, the smallest id of its near copies."""
    scratch = Scratch(spark, "similar")
    rows, found = _components(spark, docs, id_col, text_col, similarity, width, part_bits, block, open_block, scratch)
    named = rows.join(found, "node", "left").select("_id", F.coalesce("component", "node").alias("component"))
    least = scratch.save(named.groupBy("component").agg(F.min("_id").alias("component_id")))
    return named.join(least, "component").select(F.col("_id").alias(id_col), "component_id")


def near_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = WIDTH, part_bits: int = PART_BITS, block: int = 2048, open_block: int = 256) -> DataFrame:
    """The rows that stay, one of each component, with all their columns."""
    scratch = Scratch(spark, "similar")
    rows, found = _components(spark, docs, id_col, text_col, similarity, width, part_bits, block, open_block, scratch)
    named = rows.join(found, "node", "left").select("_id", "_raw", F.coalesce("component", "node").alias("component"))
    return keep_one(docs, named, id_col, F.xxhash64(F.col(f"`{text_col}`")), scratch)
