import zlib

import numpy as np
import pytest

from tidemill.llm import toxicity as t
from tidemill.llm.queries import QUERIES
from tidemill.sources import table


def test_held_out_accuracy(spark):
    """Voters fire on nearly all texts labelled toxic and on few others, in the fold that fitting never sees."""
    sf_dir = "/root/testdata/sf0.1"
    rows = QUERIES["op7_toxicity"](spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").toPandas()
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1) for row in rows.itertuples())
    held = rows[rows.held_out]
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert toxic.predicted.mean() > 0.85
    assert clean.predicted.mean() < 0.01
    assert held.score.between(0, 1).all()
    assert ((held.score >= 0.7) == (held.predicted == 1)).all()


def test_label_model_finds_accuracies_and_correlation():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.3
    rate = lambda hit, other: (rng.random(4000) < np.where(truth, hit, other)).astype(int)
    good, fair, noise = rate(0.9, 0.02), rate(0.5, 0.05), rate(0.2, 0.2)
    copy = np.where(rng.random(4000) < 0.95, fair, 1 - fair)
    labels = np.where(rng.random(4000) < 0.9, truth, ~truth).astype(int)
    post, model = t.label_model(np.column_stack([good, fair, copy, noise]), labels)
    rates, correlation = model.rates, model.correlation
    assert ((post > 0.5) == truth).mean() > 0.95
    assert abs(rates[1, 0] - 0.9) < 0.06 and abs(rates[0, 0] - 0.02) < 0.04
    assert correlation[1, 2] > 0.5 > abs(correlation[0, 3]) + 0.3
    weights, bias = t.fit_linear(np.column_stack([good, fair, copy, noise]), post)
    assert weights[0] > weights[1] > abs(weights[3]) and bias < 0


def test_patterns_are_mined(spark):
    docs = spark.createDataFrame([(i, f"plain words {'zorgling zorgs' if i % 4 == 0 else 'here'} {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = t.fit(spark, docs, labels)
    assert model.score("a zorgling") > 0.7 > 0.3 > model.score("some plain words")
    assert model.score(None) == model.score("")


def test_odd_rows(spark, odd, clashing, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    rows = t.report(spark, odd, labels).collect()
    assert len(rows) == odd.count() and not [r for r in rows if r.doc_id is None and r.held_out]
    assert t.keep_clean(spark, clashing, labels).columns == clashing.columns
    none = labels.where("false")
    assert t.report(spark, odd, none).where("predicted = 0").count() == odd.count()
    assert t.report(spark, no_docs, labels).count() == 0
    insult = spark.createDataFrame([(1, "you worthless idiot, what trash")], "doc_id long, text string")
    assert t.report(spark, insult, none).first().predicted == 1


@pytest.mark.parametrize("most", [1, 3])
def test_sample_is_bounded(spark, most):
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    assert t.report(spark, docs, labels, max_labelled=most).count() == 30


def test_repeated_ids_do_not_grow_the_sample(spark, monkeypatch):
    seen = []
    model = t.label_model
    monkeypatch.setattr(t, "label_model", lambda votes, labels, *rest: seen.append(len(votes)) or model(votes, labels, *rest))
    docs = spark.createDataFrame([(i % 12, f"zorg w{i} {'vile' if i % 2 else 'fine'}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    assert t.report(spark, docs, labels, max_labelled=10).count() == 3000
    assert seen and max(seen) <= 10


def plain_votes(voters, text):
    """Voters that fire, by their meaning."""
    every = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    words = set(every)
    lexicons = [set(words_of.split()) for words_of in t.LEXICONS.values()]
    found = [i for i, lexicon in enumerate(lexicons) if words & lexicon]
    hits = [[w for w in words if (w == p[:-1] if p.endswith(t.END) else w.startswith(p))] for p in voters.patterns]
    found += [len(lexicons) + i for i, hit in enumerate(hits) if hit]
    n = {"lexicon": len(words & set().union(*lexicons)), "pattern": len({w for hit in hits for w in hit}), "insults": sum(w in set().union(*lexicons) for w in every)}
    return found + [len(lexicons) + len(hits) + i for i, (kind, least) in enumerate(t.Voters.COUNTS) if n[kind] >= least]


def test_scores_and_sums_equal_plain_ones(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = []
    real = t.expected_votes
    t.expected_votes = lambda texts, voters, model: seen.append((voters, model, real(texts, voters, model))) or seen[0][2]
    try:
        model = t.fit(spark, docs, labels)
    finally:
        t.expected_votes = real
    rows = docs.collect()
    fired = {r.doc_id: plain_votes(model.voters, r.text) for r in rows}
    for r in t.score(docs.select("doc_id", "text"), model).collect():
        x = model.bias + sum(model.weights[i] for i in fired[r.doc_id])
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(x, -30, 30)))) < 1e-9
    voters, label, (expected, totals) = seen[0]
    rest = [fired[r.doc_id] for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    votes = np.zeros((len(rest), len(voters)))
    for i, some in enumerate(rest):
        votes[i, some] = 1
    r0, r1, w = label.rates[0, :-1], label.rates[1, :-1], label.weight[:-1]
    odds = (w * (votes * np.log(r1 / r0) + (1 - votes) * np.log((1 - r1) / (1 - r0)))).sum(axis=1) + np.log(label.share / (1 - label.share))
    post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    assert np.allclose(totals, [(1 - post).sum(), post.sum()]) and np.allclose(expected, [(1 - post) @ votes, post @ votes])


def test_repeated_insults_count():
    voters = t.Voters([])
    at = [voters.counting + i for i, (kind, _) in enumerate(t.Voters.COUNTS) if kind == "insults"]
    for text, n in [("scum", 0), ("Scum, scum", 1), ("scum idiot scum", 2), ("scum " * 5, 3), ("plain " * 9, 0)]:
        assert sum(i in at for i in voters.fire(text)) == n
        assert voters.fire(text) == sorted(plain_votes(voters, text))


def test_labelled_rows_count_once(spark, monkeypatch):
    """What the label model adds for other rows is what it expects of them alone, repeats of a labelled id included."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"plain words {'zorgling scum' if i % 4 == 0 else 'here'} {i % 7}") for i in range(400)] + [(ids[0], "zz other text, scum")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sampled = ids[:150]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in sampled], "doc_id long, toxic int")
    seen, real, sums = [], t.LabelModel.with_rows, t.expected_votes
    monkeypatch.setattr(t.LabelModel, "with_rows", lambda self, votes, post, fired, totals: seen.append((self, fired, totals)) or real(self, votes, post, fired, totals))
    monkeypatch.setattr(t, "expected_votes", lambda texts, voters, model: seen.append(voters) or sums(texts, voters, model))
    t.fit(spark, docs, labels)
    voters, (label, fired, totals) = seen
    rest = [text for i, text in rows if i in set(ids) - set(sampled)] + ["zz other text, scum"]
    votes = np.zeros((len(rest), len(voters)))
    for i, text in enumerate(rest):
        votes[i, plain_votes(voters, text)] = 1
    expected, n = label.expected(votes)
    assert np.allclose(fired, expected) and np.allclose(totals, n) and abs(totals.sum() - len(rest)) < 1e-6
