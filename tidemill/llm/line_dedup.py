"""Line dedup by winnowing over line hashes.

A run of lines that came before goes if it has `run` lines or `run_words` words. A text's lines that aren't blank are hashed. Windows of `run`
lines, and shorter ones of `run_words` words, start at each line, so that each line of a run that goes lies in a window that came before. Of each window the
smallest line hash (the last of equal ones) is selected as a fingerprint, with its position; neighbouring windows mostly select the
same one. Equal runs select the same fingerprints at the same places of theirs, so those that occur once are done with. The others are joined by fingerprint and the lines around
its position, as a hash of the window, with their first position by id and place. Matches extend both ways by those of the neighbouring windows at
the same distance from what they match, and their lines are deleted at the later position.

A filter of bounded size (`exact_dedup.repeated_filter`) knows the fingerprints that may be repeated: texts are read once for the fingerprints, of which only counts of
bits shuffle, and once more for the windows of those that the filter knows. Windows are rows, so a common line, run or source spreads over tasks; first positions
are minima with map-side combining, never pairs. Another filter lets texts without deleted lines pass, and the others shuffle once.

Only whole lines are compared: a passage that begins or ends within a line leaves those lines.

Defined results: a null text stays null and has no lines; blank lines stay and part no run; white space at the ends of
lines doesn't count in comparisons; a run that overlaps its own earlier copy shrinks to its start; null ids come
last, and each row is a document of its own: those that share an id go by a digest of the text, then by the order in
which they were read; an empty table gives an empty result;
other columns stay in `dedup_lines`, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemill.llm.common import WHITE, slices
from tidemill.llm.exact_dedup import filter_of, flag, repeated_filter
from tidemill.session import Scratch

RUN, RUN_WORDS = 3, 50
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def windows_at(words: list[int], start: int, run: int = RUN, run_words: int = RUN_WORDS) -> list[int]:
    """Lines of the windows that start at a line: those with enough words, and the one with enough lines."""
    total, sizes = 0, []
    for size, n in enumerate(words[start : start + run], 1):
        total += n
        if size == run or total >= run_words:
            sizes.append(size)
    return sizes


def lines_of(text: str | None) -> list[str]:
    return [line for line in (raw.strip(WHITE) for raw in (text or "").split("\n")) if line]


def fingerprints(lines: list[str], run: int = RUN, run_words: int = RUN_WORDS) -> dict[int, tuple[int, list[tuple[int, int]]]]:
    """Selected fingerprints of a text: by place the line hash and the windows that selected it (start and lines)."""
    import xxhash

    hashes = [xxhash.xxh64_intdigest(line) - (1 << 63) for line in lines]
    words, selected = [len(WORDS.findall(line)) for line in lines], {}
    for start in range(len(lines)):
        for size in windows_at(words, start, run, run_words):
            at = min(range(start, start + size), key=lambda i: (hashes[i], -i))
            selected.setdefault(at, (hashes[at], []))[1].append((start, size))
    return selected


def numbered(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, others: list[str]) -> DataFrame:
    """_row (the other columns), _id, _text, and a key for each row: a digest of its text and a number. A table, as numbers may change when rows are read again."""
    row = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("int")
    text = F.col(f"`{text_col}`")
    return scratch.save(docs.select(row.alias("_row"), F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_digest"), F.monotonically_increasing_id().alias("_key")), "zstd")


def marks(rows: DataFrame, run: int, run_words: int) -> DataFrame:
    """mark of each selected fingerprint."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = [mark for text in batch.column("_text").to_pylist() for mark, _ in fingerprints(lines_of(text), run, run_words).values()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["mark"])

    return rows.select("_text").mapInArrow(cut, "mark long")


def selected(rows: DataFrame, run: int, run_words: int) -> DataFrame:
    """_id, _digest, _key, mark and windows (start, n, and whole: a hash) of each selected fingerprint.

    Windows are equal if both their fingerprint and their hash are: 128 bits in all.
    """
    window = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("whole", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, "_text"):
            doc, all_marks, all_windows = [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                lines = lines_of(text)
                for mark, some in fingerprints(lines, run, run_words).values():
                    doc.append(i)
                    all_marks.append(mark)
                    all_windows.append([{"start": a, "n": n, "whole": xxhash.xxh3_64_intdigest("\n".join(lines[a : a + n])) - (1 << 63)} for a, n in some])
            own = [batch.column(c).take(pa.array(doc, pa.int64())) for c in ("_id", "_digest", "_key")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(all_marks, pa.int64()), pa.array(all_windows, window)], ["_id", "_digest", "_key", "mark", "windows"])

    some = rows.select("_id", "_digest", "_key", "_text")
    return some.mapInArrow(cut, f"_id {some.schema['_id'].dataType.simpleString()}, _digest long, _key long, mark long, windows array<struct<start:int,n:int,whole:long>>")


def repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, run_words: int = RUN_WORDS) -> DataFrame:
    """Later runs as far as they extend, each with an earlier occurrence: _id, _key, start, stop, from_id, from_key, from_start."""
    scratch = Scratch(spark, "lines")
    found = _repeats(scratch, numbered(scratch, docs, id_col, text_col, []), run, run_words)
    # windows of one distance follow one another, so a run is where the next one starts within or beside those before; a text's lines bound the rows
    by = ["_key", "from_key", F.col("start") - F.col("from_start")]
    order = Window.partitionBy(*by).orderBy("start", "stop")
    apart = F.col("start") > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    number = F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order)
    whole = found.withColumn("number", number).groupBy("_key", "from_key", (F.col("start") - F.col("from_start")).alias("far"), "number")
    ends = whole.agg(F.first("_id").alias("_id"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("from_id").alias("from_id"), F.min("from_start").alias("from_start"))
    return scratch.save(ends.select("_id", "_key", "start", "stop", "from_id", "from_key", "from_start"))


def _repeats(scratch: Scratch, rows: DataFrame, run: int, run_words: int) -> DataFrame:
    """Later windows with their first occurrence, not a table yet."""
    known = scratch.save(repeated_filter(marks(rows, run, run_words).select(F.xxhash64("mark").alias("_h"))))
    again = flag(selected(rows, run, run_words).withColumn("_h", F.xxhash64("mark")), known).where("_again")
    windows = scratch.save(again.select("_id", "_digest", "_key", "mark", F.explode("windows").alias("w")).select("_id", "_digest", "_key", "mark", "w.start", "w.n", "w.whole"))
    order = [F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_digest").alias("d"), F.col("_key").alias("k"), F.col("start").alias("s")]
    first = windows.groupBy("mark", "whole").agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("times"))
    first = scratch.save(first.where("times > 1").select("mark", "whole", F.col("first.i").alias("from_id"), F.col("first.k").alias("from_key"), F.col("first.s").alias("from_start")))
    later = windows.join(first, ["mark", "whole"]).where((F.col("_key") != F.col("from_key")) | (F.col("start") != F.col("from_start")))
    return later.select("_id", "_key", "start", (F.col("start") + F.col("n")).alias("stop"), "from_id", "from_key", "from_start")


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, run_words: int = RUN_WORDS) -> DataFrame:
    """The input rows with cleaned texts, and lines_removed (which replaces a column of that name)."""
    others = [c for c in docs.columns if c not in (text_col, "lines_removed")]
    scratch = Scratch(spark, "lines")
    rows = numbered(scratch, docs, id_col, text_col, others)
    found = _repeats(scratch, rows, run, run_words).select("_key", "start", "stop")
    gone = scratch.save(found.groupBy("_key").agg(F.collect_set(F.struct("start", "stop")).alias("_gone")))  # at most `run` for each line of a text
    known = scratch.save(filter_of(gone.select(F.xxhash64("_key").alias("_h"))))
    flagged = flag(rows.withColumn("_h", F.xxhash64("_key")), known)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, some in zip(batch.column("_text").to_pylist(), batch.column("_gone").to_pylist(), strict=True):
                drop = {line for match in some or () for line in range(match["start"], match["stop"])}
                texts.append(_without(text, drop))
                removed.append(len(drop))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], ["_row", "_text", "_removed"])

    met = flagged.where("_again").join(gone, "_key", "left").select("_row", "_text", "_gone")
    out = met.mapInArrow(cleaned, StructType([rows.schema["_row"], rows.schema["_text"], StructField("_removed", LongType())]))
    out = out.union(flagged.where(~F.col("_again")).select("_row", "_text", F.lit(0).cast("long").alias("_removed")))
    columns = [F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns if c != "lines_removed"]
    return out.select(*columns, F.col("_removed").alias("lines_removed"))


def _without(text: str | None, drop: set[int]) -> str | None:
    """A text without some of its lines that aren't blank."""
    if not drop:
        return text
    kept, at = [], -1
    for line in text.split("\n"):
        at += bool(line.strip(WHITE))
        if not line.strip(WHITE) or at not in drop:
            kept.append(line)
    return "\n".join(kept)
