"""Conversation structure repair with block tables of four Russians.

A conversation's turns go by turn number. The first fault of a turn counts: blank (no visible character), duplicate (role and text came before), truncated
(no end mark is last). Edits lead to role initials `(s?(ua)+)?`: keep costs 0, another role for user or assistant 3, delete 4 (which blank
turns and duplicates need), insert an empty user or assistant turn 3; an undeleted truncated turn adds 3.

What has been made so far is in one of four states: nothing, a system turn, a user turn last, an assistant turn last. Costs to finish
from each, less the least, are one of few vectors (`VECTORS`). A turn is one of nine symbols, by initial and fault. A table has, for each vector behind
a block of `BLOCK` symbols, the vector before the block and what the least cost grows by; it is composed of tables of half the length.
So conversations go from their end to their start a lookup a block. Then edits are traced from the start: of the cheapest ones the least
in ASCII, where the costs within a block come from expanding it backward from the vector behind it. As costs to finish are exact at each turn and
a letter fixes the next state, the least letter at each step gives the least string. Expansions are kept by vector, block and state.

Turns are sorted by ranges of conversation and turn, so that a long conversation spreads over tasks, which cut it in stretches of `STRETCH` turns or `BYTES` of text. A
conversation that a task has whole and in one stretch is done there. Of the others, tasks make each stretch a table of its own, from the vector behind it to that
before it; the tables are read from the end, a row of some bytes for each stretch; and stretches are traced in order, one at a time in memory.

Defined results: a null role or text counts as one space; null turn numbers come first; turns of one number go by role, then by a digest of the text, then as
they were read; texts of any length are kept whole; rows with a null id are one conversation; repeated rows are duplicates; conversations without rows, or an empty table, have
nothing to repair; other columns stay out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import WHITE
from tidemill.session import Scratch

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing, system, user, assistant; where an initial leads from each (none: not allowed), and where user or assistant turns lead.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
LEADS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = (USER, USER, ASSISTANT, USER)
#: Symbols: 0 for no turn, 1 to 8 by initial (others, s, u, a) and whether truncated, 9 for turns that have to go.
INITIALS, LOST, SYMBOLS = "?sua", 9, 10
BLOCK, STRETCH, BYTES = 4, 4096, 1 << 22
END = (0, 2 * INSERT, INSERT, 0)


def before(costs: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs to finish from each state before a turn, from those behind it."""
    if not symbol:
        return costs
    initial, more = INITIALS[(symbol - 1) // 2 % 4], TRUNCATED * ((symbol - 1) % 2)
    out = []
    for state in range(4):
        ways = [DELETE + costs[state]]
        if symbol != LOST:
            ways.append(REROLE + more + costs[NEXT[state]])
            if (after := LEADS.get(initial, {}).get(state)) is not None:
                ways.append(KEEP + more + costs[after])
        out.append(min(ways))
    for _ in range(2):  # inserts before the turn
        out = [min(own, INSERT + out[NEXT[state]]) for state, own in enumerate(out)]
    return tuple(out)


def letters(symbol: int, state: int, now: tuple[int, ...], behind: tuple[int, ...]) -> tuple[str, int]:
    """The edits at a turn, inserts before it included, and the state behind it. now and behind: costs to finish before and behind the turn."""
    out = ""
    while symbol:
        initial, more = INITIALS[(symbol - 1) // 2 % 4], TRUNCATED * ((symbol - 1) % 2)
        if now[state] == DELETE + behind[state]:
            return out + "D", state
        if now[state] == INSERT + now[NEXT[state]]:
            out, state = out + "I", NEXT[state]
            continue
        kept = LEADS.get(initial, {}).get(state)
        if kept is not None and now[state] == KEEP + more + behind[kept]:
            return out + "K", kept
        return out + "R", NEXT[state]
    return out, state


class Tables:
    """Vectors that costs can be, and tables of one symbol and of a block; symbols of a block are the digits of its number."""

    def __init__(self, block: int = BLOCK):
        self.vectors, self.number = [END], {END: 0}
        step, grown = [], []
        for costs in self.vectors:  # grows as it is read
            rows = [before(costs, s) for s in range(SYMBOLS)]
            least = [min(r) for r in rows]
            for row, low in zip(rows, least, strict=True):
                vector = tuple(c - low for c in row)
                if vector not in self.number:
                    self.number[vector] = len(self.vectors)
                    self.vectors.append(vector)
            step.append([self.number[tuple(c - low for c in row)] for row, low in zip(rows, least, strict=True)])
            grown.append(least)
        self.one, self.one_grown = np.array(step), np.array(grown)
        self.block, self.table, self.grown = 1, self.one, self.one_grown
        while self.block < block:  # the right half first
            middle = self.table
            table, grown = self.table[middle], self.grown[middle] + self.grown[:, :, None]
            n = len(self.vectors)
            self.table, self.grown, self.block = table.transpose(0, 2, 1).reshape(n, -1), grown.transpose(0, 2, 1).reshape(n, -1), 2 * self.block
        self.expanded: dict[tuple[int, int, int], tuple[str, int]] = {}

    def blocks(self, symbols: list[int]) -> list[int]:
        """The numbers of the blocks of some symbols; the last one is filled with no turns."""
        full = np.zeros((-(-len(symbols) // self.block), self.block), np.int64)
        full.ravel()[: len(symbols)] = symbols
        return (full @ SYMBOLS ** np.arange(self.block - 1, -1, -1)).tolist()

    def back(self, blocks: list[int], vector: int) -> tuple[list[int], int, int]:
        """The vector behind each block, that before all, and by how much the least cost grows."""
        behind, total = [], 0
        for code in reversed(blocks):
            behind.append(vector)
            total += int(self.grown[vector, code])
            vector = int(self.table[vector, code])
        return behind[::-1], vector, total

    def map(self, blocks: list[int]) -> np.ndarray:
        """The vector before all blocks for each vector behind them."""
        own = np.arange(len(self.vectors))
        for code in reversed(blocks):
            own = self.table[own, code]
        return own

    def trace(self, code: int, vector: int, state: int) -> tuple[str, int]:
        """The edits of a block and the state behind it."""
        key = (vector, code, state)
        if key not in self.expanded:
            symbols = [code // SYMBOLS**k % SYMBOLS for k in range(self.block)]  # the last one first
            costs = [self.vectors[vector]]
            for symbol in symbols:
                costs.append(before(costs[-1], symbol))
            parts = []
            for k in range(self.block - 1, -1, -1):
                if symbols[k]:
                    part, state = letters(symbols[k], state, costs[k + 1], costs[k])
                    parts.append(part)
            self.expanded[key] = ("".join(parts), state)
        return self.expanded[key]


@functools.lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def fault(role: str, text: str, seen: bool) -> tuple[str, int]:
    """The first fault of a turn (empty: none) and its symbol."""
    visible = text.strip(WHITE)
    kind = "blank" if not visible else "duplicate" if seen else "" if visible[-1] in ".!?" else "truncated"
    if kind in ("blank", "duplicate"):
        return kind, LOST
    return kind, 1 + 2 * max(0, INITIALS.find(role[:1] or "?")) + (kind == "truncated")


#: Columns of stretches, and of the result by conversation.
STRETCHES = "part int, seq int, open boolean, symbols binary, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string, first_turn long, last_turn long, distinct long"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "position long, role string, text string, edit string"
COUNTS = ("blank", "duplicate", "truncated", "illegal")
LEGAL = ("su", "ua", "au")


def _cut_in_stretches(schema: pa.Schema):
    """Stretches of conversations, from turns sorted by conversation and place."""

    def stretch(rows: list[tuple[int | None, str, str, bool]]) -> dict:
        found = [fault(role, text, seen) for _, role, text, seen in rows]
        initials, turns = [role[:1] for _, role, _, _ in rows], [t for t, *_ in rows if t is not None]
        kinds = [kind for kind, _ in found]
        return {
            "symbols": bytes(symbol for _, symbol in found), "roles": [r for _, r, _, _ in rows], "texts": ["" if symbol == LOST else text for (_, _, text, _), (_, symbol) in zip(rows, found, strict=True)],
            **{kind: kinds.count(kind) for kind in COUNTS[:3]}, "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), "first": initials[0], "last": initials[-1],
            "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "distinct": len(set(turns)),
        }

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out = TaskContext.get().partitionId(), 0, []
        doc, rows, size, inner, nothing = None, [], 0, False, True

        def add(open_: bool) -> None:
            nonlocal seq, rows, size
            out.append({"_id": doc, "part": part, "seq": seq, "open": open_} | stretch(rows))
            seq, rows, size = seq + 1, [], 0

        for batch in batches:
            for own, turn, role, text, seen in zip(*(batch.column(c).to_pylist() for c in ("_id", "_turn", "_role", "_text", "_seen")), strict=True):
                if nothing or own != doc:
                    if rows:
                        add(not inner)
                    inner, doc, nothing = not nothing, own, False  # the first conversation may have begun in another task
                elif rows and (len(rows) >= STRETCH or size + len(text) > BYTES):
                    inner = False
                    add(True)
                rows.append((turn, role, text, seen))
                size += len(text)
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
        if rows:
            add(True)  # the last one may go on in another task
        yield pa.RecordBatch.from_pylist(out, schema)

    return cut


def _maps(schema: pa.Schema):
    """For each stretch the vector before it by the vector behind it."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = tables()
        for batch in batches:
            some = [use.map(use.blocks(list(s))).astype(np.uint8).tobytes() for s in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "part", "seq")), pa.array(some, pa.binary())], schema=schema)

    return made


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector behind each stretch, from maps sorted by conversation and from its end."""
    doc, nothing, vector = None, True, 0
    for batch in batches:
        out = []
        for own, table in zip(batch.column("_id").to_pylist(), batch.column("map").to_pylist(), strict=True):
            if nothing or own != doc:
                doc, nothing, vector = own, False, 0
            out.append(vector)
            vector = table[vector]
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("seq"), pa.array(out, pa.int32())], ["part", "seq", "vector"])


class Conversation:
    """A conversation whose stretches are traced in order."""

    def __init__(self, doc: object):
        self.doc, self.state, self.at, self.cost, self.audit, self.hash = doc, NOTHING, 0, 0, [], hashlib.sha256()
        self.counts, self.gaps, self.last, self.last_turn = dict.fromkeys(COUNTS, 0), 0, None, None

    def trace(self, stretch: dict) -> Iterator[tuple[int, str, str, str]]:
        """Repaired turns of the next stretch: place, role, text and edit."""
        use, row = tables(), 0
        symbols = list(stretch["symbols"])
        blocks = use.blocks(symbols)
        for code, vector in zip(blocks, use.back(blocks, stretch["vector"])[0], strict=True):
            for letter in use.trace(code, vector, self.state)[0]:
                if letter == "D":
                    self._edit(letter, DELETE)
                else:
                    role, text, more = stretch["roles"][row] if letter == "K" else None, "", 0
                    if letter != "I":
                        text, more = stretch["texts"][row], TRUNCATED * (symbols[row] % 2 == 0)
                    yield self._turn(letter, role, text, more)
                row += letter != "I"
        for name in COUNTS:
            self.counts[name] += stretch[name]
        self.counts["illegal"] += self.last is not None and self.last + stretch["first"] not in LEGAL
        self.last = stretch["last"]
        if stretch["last_turn"] is not None:
            self.gaps += stretch["last_turn"] - stretch["first_turn"] + 1 - stretch["distinct"]
            if self.last_turn is not None:
                self.gaps += max(0, stretch["first_turn"] - self.last_turn - 1)
            self.last_turn = stretch["last_turn"]

    def finish(self) -> Iterator[tuple[int, str, str, str]]:
        """Turns that are inserted behind the last one."""
        while END[self.state]:
            yield self._turn("I", None, "", 0)

    def _turn(self, letter: str, role: str | None, text: str, more: int) -> tuple[int, str, str, str]:
        self.state = NEXT[self.state] if role is None else LEADS[role[:1]][self.state]
        role = role or ("user" if self.state == USER else "assistant")
        self._edit(letter, {"K": KEEP, "R": REROLE, "I": INSERT}[letter] + more)
        self.hash.update((("\n" if self.at else "") + f"{role}:{text}").encode())
        self.at += 1
        return self.at - 1, role, text, letter

    def _edit(self, letter: str, cost: int) -> None:
        self.audit.append(letter)
        self.cost += cost

    def row(self) -> tuple:
        return (self.doc, self.gaps, *self.counts.values(), self.cost, "".join(self.audit), self.hash.hexdigest())


def _traced(schema: pa.Schema, turns: bool):
    """Repaired turns, or a row for each conversation, from stretches sorted by conversation and place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now = None
        for batch in batches:
            for k in range(batch.num_rows):
                stretch = batch.slice(k, 1).to_pylist()[0]
                if now is None or now.doc != stretch["_id"]:
                    if now:
                        yield from ended(now)
                    now = Conversation(stretch["_id"])
                for turn in now.trace(stretch):
                    if turns:
                        yield now.doc, *turn
        if now:
            yield from ended(now)

    def ended(now: Conversation) -> Iterator[tuple]:
        for turn in now.finish():
            if turns:
                yield now.doc, *turn
        if not turns:
            yield now.row()

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows(batches):
            held.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, str))
            if size > BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return traced


def _results(spark: SparkSession, rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, turns: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    scratch = Scratch(spark, "turns")
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in (role_col, text_col))
    held = rows.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{turn_col}`").cast("long").alias("_turn"), role.alias("_role"), text.alias("_text"))
    held = scratch.save(held.select("*", F.unhex(F.md5("_text")).alias("_h"), F.monotonically_increasing_id().alias("_key")))  # numbers may change when rows are read again
    place = F.min(F.struct(F.col("_turn").isNotNull().alias("t"), F.col("_turn").alias("n"), F.col("_key").alias("k")))
    first = held.groupBy("_id", "_role", "_h").agg(place.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = scratch.save(first.select(F.col("_id").alias("i"), F.col("_role").alias("r"), F.col("_h").alias("h"), F.col("first.k").alias("k")))
    same = F.col("_id").eqNullSafe(F.col("i")) & (F.col("_role") == F.col("r")) & (F.col("_h") == F.col("h"))
    seen = held.join(first, same, "left").select("_id", "_turn", "_role", "_text", "_h", "_key", F.coalesce(F.col("k") != F.col("_key"), F.lit(False)).alias("_seen"))
    order = ["_id", "_turn", "_role", "_h", "_key"]
    dealt = seen.repartitionByRange(*order).sortWithinPartitions(*order).drop("_h", "_key")
    kind = held.schema["_id"].dataType.simpleString()

    def with_id(columns: str):
        made = spark.createDataFrame([], f"_id {kind}, {columns}").schema
        return made, to_arrow_schema(made)

    one, arrow = with_id(STRETCHES)
    stretches = scratch.save(dealt.mapInArrow(_cut_in_stretches(arrow), one))
    closed, open_ = stretches.where("NOT open").withColumn("vector", F.lit(0)), stretches.where("open")
    one, arrow = with_id("part int, seq int, map binary")
    maps = open_.mapInArrow(_maps(arrow), one).repartition("_id").sortWithinPartitions("_id", F.desc("part"), F.desc("seq"))
    behind = scratch.save(maps.mapInArrow(_behind, "part int, seq int, vector int"))
    joined = open_.join(behind, ["part", "seq"]).select(closed.columns).repartition("_id").sortWithinPartitions("_id", "part", "seq")
    one, arrow = with_id(TURNS if turns else REPORT)
    traced = _traced(arrow, turns)
    return closed.mapInArrow(traced, one).union(joined.mapInArrow(traced, one)).withColumnRenamed("_id", id_col)


def repair(spark: SparkSession, rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns of repaired conversations: id, position (from 0), role, text, and edit (K kept, R given another role, I inserted)."""
    return _results(spark, rows, id_col, turn_col, role_col, text_col, True)


def report(spark: SparkSession, rows: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    ids: conversations that get a row even if they have no turns, by the column id_col.
    """
    found = _results(spark, rows, id_col, turn_col, role_col, text_col, False)
    if ids is None:
        return found
    wanted = ids.select(F.col(f"`{id_col}`").alias("_want")).distinct()
    met = wanted.join(found, F.col("_want").eqNullSafe(F.col(f"`{id_col}`")), "left")
    none = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return met.select(F.col("_want").alias(id_col), *(F.coalesce(F.col(c), F.lit(none.get(c, 0))).alias(c) for c in found.columns if c != id_col))
