"""Toxicity by weak supervision.

Voters read a text's words: lexicons of insults, and patterns (words and word beginnings) mined
from labelled rows by how much likelier they are in toxic texts; some voters count how many
others fire, and some how often insults come, repeats of one word included. A generative label model with one latent class learns each voter's firing rate in either class
by expectation maximisation, the rows' labels being one more voter that errs. It estimates the correlation of each
pair of voters within the classes, and voters that say the same as others weigh less. A further step of it takes in all
other rows outside the held-out fold by their votes alone: tasks send sums of as many numbers as there are voters. A
logistic regression on the voters' outputs is trained on the posterior labels and scores all texts.

Mining and fitting use `max_labelled` labelled rows at most, those with the smallest hashes of
their ids, outside the held-out fold (crc32 of the id modulo 3 is 1). Their ids, so of bounded size, are
broadcast to find their texts. All else covers all rows: each text is scored whole where it lies.

Defined results: null texts count as empty; empty texts get the score of no vote; a null id is
not held out, and no label is its; labels that are null are ignored, repeated ones count as
toxic if any is; of rows that repeat a labelled id the text that sorts first is learned from; repeated rows score alike; with no usable labels, or of one class only, only the
lexicons vote, with fixed weights; an empty table gives an empty result; other columns stay, and
one named as the score is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemill.llm.common import LONGEST_KEPT, slices
from tidemill.session import Scratch

#: Labelled rows and mined patterns used at most.
MAX_LABELLED, MAX_PATTERNS = 20_000, 160
#: Lengths of the word beginnings that are mined.
LENGTHS = (4, 5, 6, 8)
#: Ends a mined pattern that is a whole word; a pattern without it is a word's beginning.
END = "$"
WORD = re.compile(r"[^\W\d_]+")

#: Common insults by language and kind.
LEXICONS = {
    "en persons": "idiot moron loser clown scum bastard jerk imbecile fool creep scumbag dumbass asshole bitch cretin degenerate vermin parasite coward freak",
    "en qualities": "stupid worthless pathetic disgusting dumb ugly useless hateful filthy retarded despicable repulsive brainless revolting",
    "en curses": "trash garbage shit fuck fucking bullshit suck sucks",
    "de": "idiot trottel depp arschloch dummkopf abschaum versager blödmann schwachkopf hurensohn miststück dreckskerl widerlich wertlos erbärmlich scheiße",
    "fr": "idiot imbécile crétin connard salaud abruti ordure débile minable pathétique connasse enfoiré dégoûtant merde",
    "es": "idiota imbécil estúpido estúpida cabrón basura escoria patético payaso inútil asqueroso gilipollas pendejo mierda",
}


@dataclass
class Voters:
    """Fire on a text's words; columns are lexicons, patterns, and counts of those that fire."""

    patterns: list[str]
    known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    #: What counting voters ask of different lexicon words, of mined patterns' different words, and of lexicon words with their repeats.
    COUNTS = (("lexicon", 1), ("lexicon", 2), ("lexicon", 3), ("pattern", 1), ("pattern", 2), ("pattern", 4), ("insults", 2), ("insults", 3), ("insults", 5))
    CACHE = 100_000

    def __post_init__(self):
        self.words: dict[str, list[int]] = {}
        for i, words in enumerate(LEXICONS.values()):
            for word in words.split():
                self.words.setdefault(word, []).append(i)
        self.begin = {p: len(LEXICONS) + i for i, p in enumerate(self.patterns)}
        self.lengths = sorted({len(p) for p in self.patterns if p[-1] != END})
        self.counting = len(LEXICONS) + len(self.patterns)

    def __len__(self) -> int:
        return self.counting + len(self.COUNTS)

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def _of(self, word: str) -> tuple[int, ...]:
        forms = [word + END, *(word[:n] for n in self.lengths if len(word) >= n)]
        found = tuple(self.words.get(word, ())) + tuple(sorted(self.begin[f] for f in forms if f in self.begin))
        if len(word) <= LONGEST_KEPT:
            if len(self.known) >= self.CACHE:
                self.known.clear()
            self.known[word] = found
        return found

    def fire(self, text: str | None) -> list[int]:
        """The voters that fire, in order."""
        words = Counter(WORD.findall((text or "").lower()))
        known, found, n_lexicon, n_pattern, n_insults = self.known, set(), 0, 0, 0
        for word, times in words.items():
            hit = known.get(word)
            if hit is None:
                hit = self._of(word)
            if hit:
                found.update(hit)
                if hit[0] < len(LEXICONS):
                    n_lexicon += 1
                    n_insults += times
                n_pattern += hit[-1] >= len(LEXICONS)
        counts = {"lexicon": n_lexicon, "pattern": n_pattern, "insults": n_insults}
        found.update(self.counting + i for i, (kind, n) in enumerate(self.COUNTS) if counts[kind] >= n)
        return sorted(found)


@dataclass
class Model:
    """Voters and the linear classifier's weights; what a task needs to score texts."""

    voters: Voters
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        x = self.bias + float(self.weights[self.voters.fire(text)].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class LabelModel:
    """Firing rates of voters by class, their weights, and the share of class 1; the last voter is the label."""

    rates: np.ndarray
    weight: np.ndarray
    share: float
    correlation: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Of class 1 for each row of votes, labels included."""
        log = self.weight * (np.log(self.rates[1]) - np.log(self.rates[0]))
        off = self.weight * (np.log1p(-self.rates[1]) - np.log1p(-self.rates[0]))
        odds = v @ log + (1 - v) @ off + math.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def by_votes(self) -> tuple[np.ndarray, float]:
        """What each voter that fires adds to the log odds of a row without a label, and the odds without votes."""
        on, off = (self.weight * (f(self.rates[1]) - f(self.rates[0])) for f in (np.log, lambda r: np.log1p(-r)))
        return (on - off)[:-1], float(off[:-1].sum() + math.log(self.share / (1 - self.share)))

    def expected(self, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What `expected_votes` gives for rows of these votes, labels left out."""
        adds, base = self.by_votes()
        post = 1 / (1 + np.exp(-np.clip(base + votes @ adds, -30, 30)))
        return np.stack([(1 - post) @ votes, post @ votes]), np.array([(1 - post).sum(), post.sum()])

    def with_rows(self, votes: np.ndarray, post: np.ndarray, fired: np.ndarray, totals: np.ndarray) -> LabelModel:
        """Rates of labelled rows (votes, labels and posteriors) and of others together, of which `fired` are expected to have fired by class, of `totals` rows."""
        own = np.stack([(1 - post) @ votes, post @ votes])
        rates = (own + np.column_stack([fired, np.zeros(2)]) + 0.2) / (np.array([(1 - post).sum(), post.sum()])[:, None] + np.append(np.tile(totals[:, None], len(self.weight) - 1), np.zeros((2, 1)), axis=1) + 1)
        rates[:, -1] = self.rates[:, -1]  # other rows have no label
        return LabelModel(np.round(rates, 9), self.weight, self.share, self.correlation)


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, LabelModel]:
    """Posterior of class 1 for each row, and the model.

    votes: rows by voters, 0 or 1. labels: of the rows; they are a voter of its own.
    """
    v = np.column_stack([votes, labels]).astype(float)
    n, m = v.shape
    weight, post = np.ones(m), np.clip(labels.astype(float), 0.05, 0.95)
    correlation = np.eye(m)
    for step in range(rounds):
        share = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        rates = np.stack([((1 - post) @ v + 0.2) / ((1 - post).sum() + 1), (post @ v + 0.2) / (post.sum() + 1)])
        rates[:, -1] = np.clip(rates[:, -1], [0.005, 0.6], [0.2, 0.995])  # labels err, but not mostly
        if step in (rounds // 4, rounds // 2):
            expected = (1 - post)[:, None] * rates[0] + post[:, None] * rates[1]
            rest = v - expected
            scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            correlation = (rest.T @ rest) / n / np.outer(scale, scale)
            alike = np.clip(correlation - np.eye(m), 0, 1)
            weight = 1 / (1 + alike.sum(axis=0))
            weight[-1] = 1
        model = LabelModel(rates, weight, float(share), correlation)
        post = model.posterior(v)
    return post, model


def expected_votes(texts: DataFrame, voters: Voters, model: LabelModel) -> tuple[np.ndarray, np.ndarray]:
    """By class: how often each voter is expected to have fired on the texts (_text), and how many texts there are."""
    adds, base = model.by_votes()
    size = len(voters)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size + 1))
        for batch in slices(batches, "_text"):
            for text in batch.column("_text").to_pylist():
                fired = voters.fire(text)
                post = 1 / (1 + math.exp(-max(-30.0, min(30.0, base + float(adds[fired].sum())))))
                at = [*fired, size]
                total[0, at] += 1 - post
                total[1, at] += post
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])

    found = texts.mapInArrow(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").toArrow()
    total = found.column("value").to_numpy().reshape(2, size + 1) if found.num_rows else np.zeros((2, size + 1))
    return total[:, :-1], total[:, -1]


def fit_linear(votes: np.ndarray, target: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge-penalised logistic regression on soft labels, by Newton steps."""
    x = np.column_stack([votes, np.ones(len(votes))]).astype(float)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (target - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other texts of a batch have a word with each beginning."""
    for batch in slices(batches, "_text", 1 << 23):
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column("_text").to_pylist(), batch.column("_toxic").to_pylist(), strict=True):
            words = set(WORD.findall((text or "").lower()))
            counts[toxic].update({w[:n] for w in words for n in LENGTHS if len(w) >= n} | {w + END for w in words})
        keys = list(counts[1])  # beginnings of no toxic text of the sample aren't candidates, but may be here
        keys += [k for k in counts[0] if k not in counts[1]]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], ["begin", "toxic", "other"])


def mine_patterns(sample: DataFrame, n_toxic: int, n_other: int, most: int = MAX_PATTERNS) -> list[str]:
    """The words and word beginnings that speak most for toxic texts: log odds times the root of the support."""
    counts = sample.mapInArrow(_beginnings, "begin string, toxic long, other long").groupBy("begin").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
    useful = counts.where(F.col("toxic") >= max(3, n_toxic // 50)).withColumn("odds", odds).where("odds > 2.5")
    best = useful.orderBy(F.desc(F.round(F.col("odds") * F.sqrt("toxic"), 6)), "begin").limit(most)
    return [row.begin for row in best.select("begin").collect()]


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, max_patterns: int = MAX_PATTERNS) -> Model:
    """Mine patterns, fit the label model, and train the classifier on its posterior labels."""
    ids = labels.select(F.col(f"`{id_col}`").alias("_id"), (F.col(f"`{label_col}`") > 0).cast("int").alias("_toxic"))
    usable = ids.where(F.col("_id").isNotNull() & F.col("_toxic").isNotNull() & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    # rows beyond half as many again as are needed don't reach the sort, so it stays small at any size
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    share = min(1.0, (1.5 * max_labelled + 100) / max(1, usable.count()))
    chosen = usable.where(place < int(share * (1 << 30))).orderBy(place, "_id").limit(max_labelled)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    # one text of each id, so that repeated ids don't grow the sample
    once = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text"))
    sample = Scratch(spark, "toxicity").save(once.select("_text", "_toxic"))
    sizes = {row["_toxic"]: row["count"] for row in sample.groupBy("_toxic").count().collect()}
    if len(sizes) < 2:
        voters = Voters([])
        weights = np.zeros(len(voters))
        weights[: len(LEXICONS)] = 2.0
        return Model(voters, weights, -3.0)
    voters = Voters(mine_patterns(sample, sizes[1], sizes[0], max_patterns))

    def fired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = [voters.fire(text) for text in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column("_toxic")], ["votes", "toxic"])

    rows = sample.mapInArrow(fired, "votes array<int>, toxic int").toArrow()  # max_labelled rows of a few small numbers
    votes, toxic = np.zeros((rows.num_rows, len(voters)), np.int8), rows.column("toxic").to_numpy()
    for i, found in enumerate(rows.column("votes").to_pylist()):
        votes[i, found] = 1
    post, model = label_model(votes, toxic)
    labelled = np.column_stack([votes, toxic]).astype(float)
    # the sample's rows are among all rows of the fold; what they add by votes alone is taken off, so that each row counts once
    everything = expected_votes(texts.where(~held_out(F.col("_id"))).select("_text"), voters, model)
    others = [np.maximum(a - b, 0.0) for a, b in zip(everything, model.expected(labelled[:, :-1]), strict=True)]
    post = model.with_rows(labelled, post, *others).posterior(labelled)
    weights, bias = fit_linear(votes, post)
    return Model(voters, weights, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add each text's score, 0 to 1."""

    @F.arrow_udf(DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(text.as_py()) for text in texts], pa.float64())

    return docs.withColumn(score_col, scored(F.col(f"`{text_col}`")))


def report(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """One row per document: id, held_out, score and predicted."""
    model = fit(spark, docs, labels, id_col, text_col, **options)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    out = score(rows, model, "_text", "_score").select("_id", "_score")
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns."""
    model = fit(spark, docs, labels, id_col, text_col, **options)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    return score(packed, model, "_text", "_score").where(F.col("_score") < threshold).select("_row.*")
