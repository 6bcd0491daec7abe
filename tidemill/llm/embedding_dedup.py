"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are turned to their principal axes. Two of cosine c are sqrt(2 - 2c) apart, and no
farther on any axes or in the length of what the leading axes leave over. Vectors are sorted by
the grid cells (of that width) of their leading coordinates, and cut into blocks of `BLOCK` in that order. Sequence
intervals of blocks form a tree of fan-out `FAN`, each with a box around its leading coordinates. The join starts
with the root against itself and descends level by level, as DataFrame joins, dropping pairs of
intervals whose boxes are farther apart than the radius. Pairs of blocks that remain are dealt in tiles of `TILE` by `TILE` blocks at most, so that a block is
sent once for a group of partners. For each pair, intervals are halved in the same way
down to `LEAF` vectors, all pairs of a level at once, and those not skipped are compared by matrix products in double precision.

Equal vectors are one node, with a count, so that copies cost nothing. A pair of blocks gives each of its
nodes a count of links and a spanning forest of the links, not the pairs. The principal axes come from sums over all
vectors, of fixed size. Where vectors have no leading axes to speak of, few pairs of blocks can
be told apart, and the comparisons grow with the square of the distinct vectors; they are spread
over tiles, of which a task holds one at a time.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing and are their own components; vectors of different lengths never link; a null id counts as a
vector and a component's id is its smallest id that isn't null; repeated rows are vectors of
their own that link; an empty table gives an empty result; other columns aren't returned by `links`, and
stay with `near_dedup`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidemill.llm.common import components, keep_one
from tidemill.session import Scratch

#: Vectors of a block, intervals below one, leading axes.
BLOCK, FAN, AXES = 2048, 8, 10
#: Vectors of the shortest intervals within a block.
LEAF = 128
#: Blocks of a side of a tile at most; tables of few blocks have smaller tiles, so that there is one for each core.
TILE = 8


def _digests(wide: bool):
    """A digest of each usable vector, with its bytes and length."""
    kind = np.float64 if wide else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws, sizes = [], [], []
            for values in batch.column("_vec"):
                raw = _usable(values, kind)
                keys.append(hashlib.blake2b(raw, digest_size=16).digest() if raw else None)
                raws.append(raw)
                sizes.append(len(raw) // np.dtype(kind).itemsize if raw else None)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_raw"), pa.array(keys, pa.binary()), pa.array(raws, pa.binary()), pa.array(sizes, pa.int32())], ["_id", "_raw", "gid", "raw", "dim"])

    return run


def _usable(values: pa.ListScalar, kind: type) -> bytes | None:
    if not values.is_valid or values.values.null_count or not len(values.values):
        return None
    x = values.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # no negative zeros
    return x.tobytes() if np.isfinite(x).all() and x.any() else None


def _units(raws: pa.Array, wide: bool) -> np.ndarray:
    return _unit_rows(b"".join(raws.to_pylist()), len(raws), wide)


def _unit_rows(raw: bytes, n: int, wide: bool) -> np.ndarray:
    x = np.frombuffer(raw, np.float64 if wide else np.float32).reshape(n, -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(groups: DataFrame, dim: int, wide: bool) -> np.ndarray:
    """Columns are the axes, by falling variance; from sums of dim * (dim + 1) numbers for each task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim))
        for batch in batches:
            if batch.num_rows:
                u = _units(batch.column("raw"), wide)
                total += np.vstack([u.T @ u, u.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])

    n = groups.count()
    found = groups.select("raw").mapInArrow(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").toArrow()
    total = found.column("value").to_numpy().reshape(dim + 1, dim) / max(n, 1)
    spread = total[:-1] - np.outer(total[-1], total[-1])
    return np.linalg.eigh(spread)[1][:, ::-1].copy()


def _grid_sorted(groups: DataFrame, axes: np.ndarray, lead: int, radius: float, wide: bool) -> DataFrame:
    """Adds leading coordinates and left-over length (place), sorted by grid cells across partitions."""
    turn = axes[:, :lead]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = _units(batch.column("raw"), wide) @ turn
                rest = np.sqrt(np.clip(1 - (y * y).sum(axis=1), 0, None))
                cells = np.floor(y / radius).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("gid", "raw", "n")), pa.array(list(np.column_stack([y, rest])), pa.list_(pa.float64())), pa.array(list(cells), pa.list_(pa.int32()))],
                    ["gid", "raw", "n", "place", "cell"],
                )

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("gid", "raw", "n", "place")), pa.array([part] * n, pa.int32()), pa.array(np.arange(seq, seq + n))], ["gid", "raw", "n", "place", "part", "seq"])
            seq += n

    rows = groups.select("gid", "raw", "n").mapInArrow(placed, "gid binary, raw binary, n long, place array<double>, cell array<int>")
    dealt = rows.repartitionByRange("cell", "gid").sortWithinPartitions("cell", "gid")
    return dealt.mapInArrow(numbered, "gid binary, raw binary, n long, place array<double>, part int, seq long")


def _blocks(rows: DataFrame, lead: int) -> DataFrame:
    """Rows of a block together: its nodes, counts, vectors and box."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "pos", "n", "place", "raw")), strict=True):
                if held and held[0][0] != row[0]:
                    yield whole(held)
                    held = []
                held.append(row)
        if held:
            yield whole(held)

    def whole(held: list[tuple]) -> pa.RecordBatch:
        block, nodes, counts, places, raws = zip(*held, strict=True)
        places = np.array(places)
        bounds = [pa.array([x]) for side in (places.min(axis=0), places.max(axis=0)) for x in side.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([block[0]]), pa.array([list(nodes)]), pa.array([list(counts)]), pa.array([b"".join(raws)], pa.binary()), *bounds], names)

    bounds = [f"{side}{i}" for side in ("lo", "hi") for i in range(lead + 1)]
    names = ["block", "nodes", "counts", "raws", *bounds]
    schema = "block long, nodes array<long>, counts array<long>, raws binary, " + ", ".join(f"{b} double" for b in bounds)
    return rows.repartition("block").sortWithinPartitions("block", "pos").mapInArrow(packed, schema)


def _near(lead: int, radius: float):
    """Whether the boxes of a and b are within the radius."""
    zero = F.lit(0.0)
    gaps = [F.greatest(F.col(f"a.lo{i}") - F.col(f"b.hi{i}"), F.col(f"b.lo{i}") - F.col(f"a.hi{i}"), zero) for i in range(lead + 1)]
    return sum((g * g for g in gaps), zero) <= radius * radius + 1e-9


def _close_blocks(blocks: DataFrame, n_blocks: int, lead: int, radius: float, scratch: Scratch) -> DataFrame:
    """Pairs a <= b of blocks not provably distant, by descending the tree of intervals."""
    bounds = [F.min(f"lo{i}").alias(f"lo{i}") for i in range(lead + 1)] + [F.max(f"hi{i}").alias(f"hi{i}") for i in range(lead + 1)]
    boxes = scratch.save(blocks.drop("nodes", "counts", "raws"))
    levels = [boxes.withColumnRenamed("block", "node")]
    while FAN ** (len(levels) - 1) < n_blocks:
        up = levels[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(*bounds)
        levels.append(scratch.save(up))
    pairs = None
    for level in reversed(levels):
        below = level.withColumn("up", F.floor(F.col("node") / FAN))
        if pairs is None:
            pairs = level.alias("a").join(level.alias("b"), F.col("a.node") == F.col("b.node")).select(F.col("a.node").alias("x"), F.col("b.node").alias("y"))
            continue
        joined = pairs.join(below.alias("a"), F.col("x") == F.col("a.up")).join(below.alias("b"), F.col("y") == F.col("b.up"))
        pairs = scratch.save(joined.where((F.col("a.node") <= F.col("b.node")) & _near(lead, radius)).select(F.col("a.node").alias("x"), F.col("b.node").alias("y")))
    return pairs


def _boxes(u: np.ndarray, turn: np.ndarray, leaf: int, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lower and upper bounds of the intervals of `leaf` vectors, then of twice as many, and so on."""
    y = u @ turn
    places = np.column_stack([y, np.sqrt(np.clip(1 - (y * y).sum(axis=1), 0, None))])
    levels = [tuple(f.reduceat(places, np.arange(0, len(u), leaf), axis=0) for f in (np.minimum, np.maximum))]
    for _ in range(depth):
        levels.append(tuple(f.reduceat(side, np.arange(0, len(side), 2), axis=0) for f, side in zip((np.minimum, np.maximum), levels[-1], strict=True)))
    return levels


def linked_pairs(a: np.ndarray, b: np.ndarray, turn: np.ndarray, least: float, leaf: int = LEAF) -> tuple[np.ndarray, int]:
    """Which unit vectors of a and b have a cosine of at least `least`, and how many pairs were compared for it.

    Intervals of the two are halved, a level at a time, until they are provably distant by their boxes or have `leaf` vectors at most.
    """
    radius = max(0.0, 2 - 2 * least) + 1e-9
    depth = (-(-max(len(a), len(b)) // leaf) - 1).bit_length()
    sides = [_boxes(u, turn, leaf, depth) for u in (a, b)]
    x = y = np.zeros(1, np.int64)
    for level in range(depth, -1, -1):
        (a_lo, a_hi), (b_lo, b_hi) = sides[0][level], sides[1][level]
        gap = np.maximum(np.maximum(a_lo[x] - b_hi[y], b_lo[y] - a_hi[x]), 0)
        near = (gap * gap).sum(axis=1) <= radius
        x, y = x[near], y[near]
        if level:
            x, y = (np.repeat(x, 4) * 2 + np.tile([0, 0, 1, 1], len(x))), (np.repeat(y, 4) * 2 + np.tile([0, 1, 0, 1], len(y)))
            there = (x < len(sides[0][level - 1][0])) & (y < len(sides[1][level - 1][0]))
            x, y = x[there], y[there]
    linked, compared = np.zeros((len(a), len(b)), bool), 0
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    # neighbouring intervals of b that an interval of a is compared with go in one product
    cuts = np.flatnonzero((np.diff(x) != 0) | (np.diff(y) != 1)) + 1
    for first, last in zip([0, *cuts], [*cuts, len(x)], strict=True):
        if first < last:
            a0, b0, b1 = x[first] * leaf, y[first] * leaf, (y[last - 1] + 1) * leaf
            found = a[a0 : a0 + leaf] @ b[b0:b1].T >= least
            linked[a0 : a0 + leaf, b0:b1] = found
            compared += found.size
    return linked, compared


def _compared(pairs: DataFrame, blocks: DataFrame, turn: np.ndarray, least: float, wide: bool, tile: int) -> DataFrame:
    """Counts of links by node (b is null), and edges a, b that span the links (n is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        now = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("s", "t", "block", "others")), strict=True))
            for i, (s, t, block, others) in enumerate(keys):
                if (s, t) != now:
                    yield from whole(held)
                    held, now = {}, (s, t)
                held[block] = (others, *(batch.column(c)[i].values.to_numpy() for c in ("nodes", "counts")), batch.column("raws")[i].as_py())
        yield from whole(held)

    def whole(held: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        """The pairs of a tile."""
        for block, (others, nodes, counts, raw) in held.items():
            u = _unit_rows(raw, len(nodes), wide) if others else None
            for other in others:
                _, other_nodes, other_counts, other_raw = held[other]
                same = other == block
                linked, _ = linked_pairs(u, u if same else _unit_rows(other_raw, len(other_nodes), wide), turn, least)
                if same:
                    np.fill_diagonal(linked, False)
                yield counted((nodes, counts), (other_nodes, other_counts), linked, same)

    def counted(one: tuple, two: tuple, linked: np.ndarray, same: bool) -> pa.RecordBatch:
        (a, na), (b, nb) = one, two
        rows, columns = linked.any(axis=1), linked.any(axis=0)
        some = linked[rows][:, columns]
        nodes, links = [a[rows]], [some @ nb[columns]]
        if not same:
            nodes.append(b[columns])
            links.append(na[rows] @ some)
        nodes, links = np.concatenate(nodes), np.concatenate(links)
        x, y = _forest(a[rows], b[columns], some)
        n = len(nodes)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([nodes, x])), pa.array([None] * n + y.tolist(), pa.int64()), pa.array(links.tolist() + [None] * len(x), pa.int64())], ["a", "b", "n"])

    tiled = pairs.select(F.floor(F.col("x") / tile).alias("s"), F.floor(F.col("y") / tile).alias("t"), "x", "y")
    sides = tiled.select("s", "t", F.col("x").alias("block"), F.col("y").alias("other")).unionByName(tiled.select("s", "t", F.col("y").alias("block"), F.lit(None).cast("long").alias("other")))
    wanted = sides.groupBy("s", "t", "block").agg(F.collect_list("other").alias("others"))  # a tile's side at most
    dealt = wanted.join(blocks.select("block", "nodes", "counts", "raws"), "block").repartition("s", "t").sortWithinPartitions("s", "t", "block")
    return dealt.mapInArrow(run, "a long, b long, n long")


def _forest(a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the links between rows a and columns b."""
    x, y, rows_left, columns_left = [], [], linked.any(axis=1), linked.any(axis=0)
    while rows_left.any():
        front = [int(rows_left.argmax())]
        rows_left[front[0]] = False
        while front:
            row = front.pop()
            columns = np.flatnonzero(linked[row] & columns_left)
            columns_left[columns] = False
            x += [a[row]] * len(columns)
            y += b[columns].tolist()
            for column in columns:
                rows = np.flatnonzero(linked[:, column] & rows_left)
                rows_left[rows] = False
                x += a[rows].tolist()
                y += [b[column]] * len(rows)
                front += rows.tolist()
    return np.array(x, np.int64), np.array(y, np.int64)


def _nodes_of(spark: SparkSession, groups: DataFrame, dim: int, least: float, wide: bool, scratch: Scratch) -> DataFrame:
    """gid, links and component (of nodes) of the vectors of one length."""
    own = groups.where(F.col("dim") == dim)
    lead, radius = min(AXES, dim), float(np.sqrt(max(0.0, 2 - 2 * least)))
    axes = principal_axes(own, dim, wide)
    rows = scratch.save(_grid_sorted(own, axes, lead, max(radius, 1e-6), wide))
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    base = parts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("base"))
    numbered = rows.join(F.broadcast(base), "part").withColumn("pos", F.col("base") + F.col("seq"))  # a row for each part
    blocks = scratch.save(_blocks(numbered.select("pos", F.floor(F.col("pos") / BLOCK).alias("block"), "n", "place", "raw"), lead))
    n_blocks = blocks.count()
    pairs = _close_blocks(blocks, n_blocks, lead, radius, scratch)
    found = scratch.save(_compared(pairs, blocks, axes[:, :lead], least, wide, max(1, min(TILE, n_blocks // 8))))
    stars = components(spark, found.where("b is not null").select("a", "b"), scratch)
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    named = numbered.select("gid", "n", F.col("pos").alias("node"))
    named = named.join(links.withColumnRenamed("a", "node"), "node", "left").join(stars, "node", "left")
    total = F.coalesce("links", F.lit(0)) + F.col("n") - 1
    return scratch.save(named.select("gid", total.cast("long").alias("links"), F.coalesce("component", "node").alias("component")))


def _linked(spark: SparkSession, vectors: DataFrame, id_col: str, vec_col: str, least: float, scratch: Scratch) -> DataFrame:
    """Rows: _id, _raw (a hash of the vector), and for usable vectors gid, links, component_id and component (a name)."""
    kind = vectors.schema[vec_col].dataType
    wide = not (isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType))
    vec = F.col(f"`{vec_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(vec).alias("_raw"), vec.alias("_vec"))
    id_kind = rows.schema["_id"].dataType.simpleString()
    rows = scratch.save(rows.mapInArrow(_digests(wide), f"_id {id_kind}, _raw long, gid binary, raw binary, dim int"))
    groups = scratch.save(rows.where("gid is not null").groupBy("gid", "dim").agg(F.first("raw").alias("raw"), F.count(F.lit(1)).alias("n"), F.min("_id").alias("first_id")))
    dims = [row.dim for row in groups.select("dim").distinct().orderBy("dim").collect()]
    out = groups.where("false").select("gid", F.col("n").alias("links"), F.col("first_id").alias("component_id"), F.lit("").alias("component"))
    for dim in dims:
        nodes = _nodes_of(spark, groups, dim, least, wide, scratch).join(groups.select("gid", "first_id"), "gid")
        whole = nodes.groupBy("component").agg(F.min("first_id").alias("component_id"))
        out = out.union(scratch.save(nodes.join(whole, "component").select("gid", "links", "component_id", F.concat_ws(":", F.lit(str(dim)), "component").alias("component"))))
    return rows.select("_id", "_raw", "gid").join(out, "gid", "left")


def links(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per input row: id, n_links, component_id and kept."""
    joined = _linked(spark, vectors, id_col, vec_col, least, Scratch(spark, "embedding"))
    component = F.when(F.col("gid").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return joined.select(F.col("_id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def near_dedup(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """The rows that stay, with all their columns: of each component that with the smallest id that isn't null, then of the smallest hash.

    Rows that only share an id are decided each by itself; those alike in id and vector share a decision. Unusable vectors stay.
    """
    scratch = Scratch(spark, "embedding")
    rows = _linked(spark, vectors, id_col, vec_col, least, scratch).where("gid is not null").select("_id", "_raw", "component")
    return keep_one(vectors, rows, id_col, F.xxhash64(F.col(f"`{vec_col}`")), scratch)
