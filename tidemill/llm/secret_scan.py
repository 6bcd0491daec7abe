"""Secret scans: credential patterns, and a token-efficiency test for random strings.

Base patterns find assignments, access keys and long hex runs. The method adds runs of key-like
characters of which a byte-pair vocabulary makes few characters a token: natural words and
identifiers are made of frequent pieces, random strings are not. Left out before the test are
digests of the usual lengths in hex, UUIDs, plain numbers, words and identifiers of words with a
number at most, runs of a few characters over and over, and what overlaps a base span. Runs of under `LEAST_RUN`
characters aren't tested, as too few tokens tell them from words. Shape alone makes no word: the vocabulary must also make
enough characters a token of a run's letters, split where case changes and lower-cased.

Texts stay in their partitions; nothing shuffles.

Defined results: a null text counts as empty and has no spans; texts of any length are searched
whole; repeated rows are searched alike; an empty table gives an empty result; `scan` keeps all columns and
replaces one named as its result. Spans are code points, end exclusive, by start, then by kind
in the order of KINDS.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from tidemill.llm.bpe_codec import default_path, default_pattern, read_ranks

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Characters of the shortest runs that are tested, and different ones that a run must have.
LEAST_RUN, LEAST_DISTINCT = 20, 6
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.IGNORECASE)
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
#: A part of an identifier: words, in camel case or not, with a short number behind; or a short number. Possessive, so linear.
PART = re.compile(r"(?:[A-Z]?[a-z]++|[A-Z]++(?:[a-z]{2,}+)?+)(?:[A-Z]++[a-z]{2,}+)*+(?:[A-Z]{2,}+)?+[0-9]{0,6}|[0-9]{1,8}")
#: Words of an identifier, which are lower-cased before their tokens are counted.
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Of fewer letters, an identifier is taken for a number or date.
LEAST_LETTERS = 8
#: Characters a token below which a run is taken for random.
MAX_RATIO = 2.2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three base kinds: start, end, kind.

    Runs that are too short are dropped; as the patterns take whole runs, a shorter run hides
    no longer one.
    """
    found = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def known_run(run: str, path: str, pattern: str) -> bool:
    """Whether a run is a digest, an identifier, a number or a word."""
    body = run.strip("+/_=-")
    if len(body) < LEAST_RUN or body.isdigit() or len(set(body)) < LEAST_DISTINCT:
        return True
    if UUID.fullmatch(body) or len(body) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body):
        return True
    shaped = all(PART.fullmatch(part) for part in re.split("[+/_=-]+", body)) or not any(c.isdigit() for c in body) and not _mixed(body)
    return shaped and _natural(body, path, pattern)


def _natural(run: str, path: str, pattern: str) -> bool:
    """Whether a run's words are token-efficient. Of random letters, the shorter ones vary more: the bound is 2 + 2 / letters."""
    words = [w.lower() for w in WORD.findall(run)]
    letters = sum(map(len, words))
    return letters < LEAST_LETTERS or letters >= (2 + 2 / letters) * sum(len(encoding(path, pattern).encode_ordinary(w)) for w in words)


def _mixed(run: str) -> bool:
    """Whether letters change case often, as in base64."""
    return sum(a.islower() and b.isupper() or a.isupper() and b.islower() for a, b in zip(run, run[1:])) * 4 >= len(run)


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def spans(text: str | None, path: str, pattern: str, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, str]]:
    """All spans of a text."""
    text = text or ""
    found = base_spans(text)
    starts = sorted(a for a, _, _ in found)
    upto = list(accumulate((b for _, b, _ in sorted(found)), max))  # the last end of the spans that start by then
    for m in RUN.finditer(text):
        run, before = m[0], bisect_left(starts, m.end())
        if before and upto[before - 1] > m.start() or known_run(run, path, pattern):
            continue
        if len(run) / len(encoding(path, pattern).encode_ordinary(run)) < max_ratio:
            found.append((m.start(), m.end(), "random"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", path: str | None = None, pattern: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Add an array of spans: start, end, kind."""
    path, pattern = path or default_path(), pattern or default_pattern()
    span = StructType().add("start", LongType()).add("end", LongType()).add("kind", StringType())
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    @F.arrow_udf(ArrayType(span))
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in spans(t.as_py(), path, pattern, max_ratio)] for t in texts], pa.list_(kind))

    return docs.withColumn(spans_col, found(F.col(f"`{text_col}`")))


def joined(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def _is(kind: str):
    return lambda span: span.kind == kind


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256 and spans."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    found = F.col("_spans")
    counts = [F.size(F.filter(found, _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    base = joined(F.filter(found, lambda s: s.kind != KINDS[3]))
    out = scan(rows, "_text", "_spans", **options).select("_id", "_spans")
    return out.select(F.col("_id").alias(id_col), *counts, F.sha2(base, 256).alias("base_sha256"), joined(found).alias("spans"))
