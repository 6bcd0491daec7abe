"""Periodic run detection by the branching-tandem test on an enhanced suffix array.

A run is a stretch of words with smallest period q (words q apart are equal), of at least `least` words and `times` periods,
that no neighbouring word extends. A text's words become numbers, of which the suffix array, its inverse and the array of
longest common prefixes (LCP) are made. Each entry of the LCP array splits an LCP interval of depth d in two, in the order of a stack: no tree is
built. For the suffixes i of the smaller side, the inverse array tells whether i + d or i - d is on the other side; if so, the two
suffixes share d words and no more, so that a square of period d is there that can't go on to the right. Smaller sides sum to n log n.
A square rotates left as long as the word before it equals the one a period later, which gives its run; squares of multiples of a
period lie in a run found before, by rising d, and merge into it.

A text of which no 16 words (`shared`) occur twice holds no run of 24 words and three periods, since a run shares that many words with itself a
period later. Hashes of all stretches of that length rule out such texts before their suffixes are sorted; a collision
only costs time.

Each text is one row of one task; nothing shuffles, and memory follows the longest text.

Defined results: a null text stays null and has no runs; an empty text, or one of white space, has no words and becomes empty; texts
of any length are searched whole; rows are independent, so repeated rows, repeated ids and null ids change nothing; an empty table gives an empty
result; other columns stay, whatever their names, but for one named as the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tidemill.llm.common import slices

LEAST, TIMES = 24, 3
#: Suffixes tested at once.
AT_ONCE = 1 << 20
Run = tuple[int, int, int]


def shared(least: int = LEAST, times: int = TIMES) -> int:
    """Words that any run shares with itself one period later, at least."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the place of each, by doubling the length that is sorted by."""
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    n, h = len(ids), 1
    while True:
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        h *= 2
        if rank[order[-1]] == n - 1 or h >= n:
            return order, rank


def lcp_array(ids: list[int], order: list[int], place: list[int]) -> list[int]:
    """Words that each suffix in order shares with the one before it, in linear time."""
    n, h, out = len(ids), 0, [0] * len(ids)
    for i in range(n):
        at = place[i]
        if at:
            j = order[at - 1]
            most = n - max(i, j)
            while h < most and ids[i + h] == ids[j + h]:
                h += 1
            out[at] = h
            h -= h > 0
        else:
            h = 0
    return out


def splits(lcp: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each k the first and last place of the LCP interval that it splits before k, of ties the last one outermost."""
    n = len(lcp)
    first, last, open_ = [0] * n, [n - 1] * n, [0]
    for k in range(1, n):
        depth, held = lcp[k], k - 1
        while len(open_) > 1 and lcp[open_[-1]] >= depth:
            top = open_.pop()
            last[top], held = k - 1, first[top]
        first[k] = held
        open_.append(k)
    return np.array(first), np.array(last)


def branching_squares(order: np.ndarray, place: np.ndarray, lcp: np.ndarray, first: np.ndarray, last: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of squares whose next word isn't the one a period before, of periods that `times` fit."""
    n = len(order)
    nodes = np.flatnonzero((lcp > 0) & (lcp * times <= n))
    left = nodes - first[nodes] <= last[nodes] - nodes + 1
    low, high = np.where(left, first[nodes], nodes), np.where(left, nodes - 1, last[nodes])
    other_low, other_high = np.where(left, nodes, first[nodes]), np.where(left, last[nodes], nodes - 1)
    size, starts, periods = high - low + 1, [], []
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // AT_ONCE)) + 1
    for some in np.split(np.arange(len(nodes)), cuts):
        count = size[some]
        ends = np.cumsum(count)
        at = np.repeat(low[some] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        i, d = order[at], np.repeat(lcp[nodes[some]], count)
        a, b = np.repeat(other_low[some], count), np.repeat(other_high[some], count)
        for j in (i + d, i - d):
            there = place[np.clip(j, 0, n - 1)]
            found = (j >= 0) & (j < n) & (there >= a) & (there <= b)
            starts.append(np.minimum(i, j)[found])
            periods.append(d[found])
    return np.concatenate(starts), np.concatenate(periods)


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """Start, length and period of each run, by start and then period. `times` is 2 at least."""
    if len(ids) < least:
        return []
    order, place = suffix_array(ids)
    words = ids.tolist()
    lcp = lcp_array(words, order.tolist(), place.tolist())
    starts, periods = branching_squares(order, place, np.array(lcp), *splits(lcp), times)
    by_end: dict[int, list[tuple[int, int]]] = {}
    for d, start in sorted(zip(periods.tolist(), starts.tolist(), strict=True)):
        end = start + 2 * d
        known = by_end.setdefault(end, [])
        if any(d % q == 0 and since <= start for since, q in known):
            continue
        while start and words[start - 1] == words[start - 1 + d]:
            start -= 1
        known.append((start, d))
    return sorted((s, e - s, q) for e, known in by_end.items() for s, q in known if e - s >= max(least, times * q))


def may_hold_runs(ids: np.ndarray, stops: np.ndarray, length: int) -> np.ndarray:
    """For texts of words that end at `stops`: whether any stretch of `length` words seems to occur twice."""
    if len(ids) < length:
        return np.zeros(len(stops), bool)
    sizes = np.diff(stops, prepend=0)
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    total, at, factor = np.zeros(len(ids), np.uint64), 0, 0xD6E8FEB86659FD93
    block, width = mixed, 1  # hashes of the stretches of `width` words that start at each place
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            scale = np.uint64(pow(factor, at, 1 << 64))
            total[: len(ids) - at] += block[at:] * scale
            at += width
        if at < length:
            longer = block.copy()
            longer[: len(ids) - width] += block[width:] * np.uint64(pow(factor, width, 1 << 64))
            block, width = longer, 2 * width
    doc = np.repeat(np.arange(len(stops)), sizes)
    whole = np.arange(len(ids)) + length <= np.repeat(stops, sizes)
    key = (total + doc.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))[whole]
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = np.zeros(len(stops), bool)
    out[doc[whole][np.isin(key, twice)]] = True
    return out


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, taken: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """All columns, with texts of words joined by one space that keep one period of each run, and `runs`: start, length and period of each.

    A word goes if some run holds it behind its first period. `taken` gives, for an id and a number of words, which word each place is to take
    (None: its own), for texts that are to be changed first.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    needed = shared(least, times)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = batch.column("_text")
            parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
            some = pc.not_equal(parts.values, "").to_numpy(zero_copy_only=False)
            words = parts.values.filter(pa.array(some))
            stops = np.concatenate([[0], np.cumsum(some)])[parts.offsets.to_numpy()]
            starts, stops = stops[:-1], stops[1:]
            coded = words.dictionary_encode().indices.to_numpy()
            own = np.arange(len(words))
            if taken:
                for doc, a, b in zip(batch.column("_id").to_pylist(), starts.tolist(), stops.tolist(), strict=True):
                    places = taken(doc, b - a)
                    if places is not None:
                        own[a:b] = a + places
            coded, kept = coded[own], np.ones(len(own), bool)
            all_runs: list[list[Run]] = [[]] * len(starts)
            for k in np.flatnonzero(may_hold_runs(coded, stops, needed)).tolist():
                all_runs[k] = runs_of(coded[starts[k] : stops[k]], least, times)
                for start, length, period in all_runs[k]:
                    kept[starts[k] + start + period : starts[k] + start + length] = False
            offsets = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([starts, stops[-1:]])]
            cut = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(own[kept]))), " ")
            cut = pc.if_else(pc.is_valid(texts), cut, None)
            out = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in all_runs], kind)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), cut, out], ["_row", "_text", "_runs"])

    columns = [c for c in docs.columns if c != "runs"]
    others = [F.col(f"`{c}`") for c in columns if c != text_col]
    row = F.struct(*others) if others else F.lit(None).cast("int")
    rows = docs.select(row.alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    one = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
    out = rows.mapInArrow(found, StructType([rows.schema["_row"], rows.schema["_text"], StructField("_runs", ArrayType(one))]))
    return out.select(*(F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in columns), F.col("_runs").alias("runs"))


def best(runs: str = "runs"):
    """The run of the greatest length by period, of equal ones the first; null without runs. Compared as whole numbers."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda held, run: held.isNull() | (run["length"] * held["period"] > held["length"] * run["period"])
    return F.aggregate(runs, none, lambda held, run: F.when(more(held, run), run).otherwise(held))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, taken: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row per text: id, n_runs, the best run, and digests of all runs and of the text without repeats."""
    cut = collapse(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text", least, times, taken)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    top = F.col("best")
    return cut.withColumn("best", best()).select(
        F.col("id").alias(id_col), F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("collapsed_sha256"),
    )
