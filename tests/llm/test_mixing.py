import hashlib
from dataclasses import replace

from pyspark.sql import functions as F

from tidemill.llm import mixing as m


def fill(budget, children):
    """Budgets of (weight, cap) by name: shares in proportion, what can't be used goes to the others."""
    out, left, budget = {}, {n: c for n, c in children.items() if c[0] > 0}, budget
    while left:
        weight = sum(w for w, _ in left.values())
        full = {n: cap for n, (w, cap) in left.items() if cap * weight <= budget * w}
        if not full:
            return out | {n: int(w * budget / weight) for n, (w, _) in left.items()}
        low = min(full, key=lambda n: (left[n][1] / left[n][0], n))
        out[low] = full[low]
        budget -= full[low]
        del left[low]
    return out


def brute(rows, plan):
    leaves = {}
    for doc, leaf, tokens in rows:
        leaves.setdefault(leaf, []).append((doc, tokens))
    cap = {leaf: plan.epochs * sum(t for _, t in some) for leaf, some in leaves.items()}
    weight = lambda level, name: {0: plan.domains, 1: plan.languages, 2: plan.sources}[level].get(name, plan.default)
    budgets = {(): int(sum(t for _, _, t in rows) * plan.share)}
    for level in range(3):
        for parent in [p for p in budgets if len(p) == level]:
            names = {leaf[level] for leaf in leaves if leaf[:level] == parent}
            children = {n: (weight(level, n), sum(c for leaf, c in cap.items() if leaf[: level + 1] == (*parent, n))) for n in names}
            budgets |= {(*parent, n): b for n, b in fill(budgets[parent], children).items()}
    copies = {}
    for leaf, some in leaves.items():
        tokens, b = sum(t for _, t in some), budgets.get(leaf, 0)
        passes = b // tokens if tokens else 0
        rest, run = b - passes * tokens, 0
        key = lambda d: hashlib.md5(f"{plan.seed}:{passes}:{'' if d is None else d}".encode()).hexdigest()  # noqa: E731, B023
        for k in sorted({key(d) for d, _ in some}):
            peers = [(d, t) for d, t in some if key(d) == k]
            run += sum(t for _, t in peers)
            for d, _ in peers:
                copies[leaf, d] = passes + (rest > 0 and run <= rest)
    return copies, {leaf: budgets.get(leaf, 0) for leaf in leaves}


PLAN = m.Plan(domains={"d0": 4, "d1": 1, "d9": 0}, languages={"en": 3}, sources={"s1": 5}, share=0.6, epochs=2, seed=3)


def test_equals_brute_force(spark):
    rows = [(i, (f"d{i % 3 if i % 50 else 9}", ("en", "de", "")[i % 7 % 3], f"s{i * i % 5}"), 1 + i * 37 % 60 if i % 11 else 0) for i in range(700)]
    rows += [(5000 + i, ("d0", "en", "hot"), 3) for i in range(400)]
    docs = spark.createDataFrame([(d, *leaf, t) for d, leaf, t in rows], "doc_id long, a string, b string, c string, n long")
    for plan in (PLAN, replace(PLAN, share=1.9), replace(PLAN, share=5.0), replace(PLAN, share=0.0)):
        want, budgets = brute(rows, plan)
        got = m.decide(spark, docs, plan, F.col("a"), F.col("b"), F.col("c"), text_col="a", tokens=F.col("n")).collect()
        assert {((r.domain, r.language, r.source), r.doc_id): r.copies for r in got} == want
        for leaf, budget in budgets.items():
            assert sum(r.copies * r.n_tokens for r in got if (r.domain, r.language, r.source) == leaf) <= budget


def test_shortage_goes_to_siblings_first(spark):
    docs = spark.createDataFrame([(1, "a", "x", "small", 10), (2, "a", "x", "big", 1000), (3, "b", "y", "other", 1000)], "doc_id long, a string, b string, c string, n long")
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("a").alias("domain"), F.col("b").alias("language"), F.col("c").alias("source"), F.col("n").alias("_tokens"), F.lit(0).cast("long").alias("_raw"))
    budgets = {r.source: r.b for r in m.leaf_cuts(spark, rows, m.Plan(share=800 / 2010, epochs=1)).collect()}
    assert budgets == {"small": 10, "big": 390, "other": 400}


def test_rows_without_ids_or_with_equal_ones_go_by_their_text(spark):
    for doc in (None, 7):
        docs = spark.createDataFrame([(doc, f"text number {i}", "d", "l", "s") for i in range(4000)] + [(doc, "alike", "d", "l", "s")] * 50, "doc_id long, text string, a string, b string, c string").repartition(4)
        leaf = [F.col(c) for c in "abc"]
        rows = m.decide(spark, docs, m.Plan(share=0.5, epochs=1), *leaf).collect()
        taken, total = sum(r.copies * r.n_tokens for r in rows), sum(r.n_tokens for r in rows)
        assert 0.5 * total - 60 <= taken <= 0.5 * total
        out = m.mix(spark, docs, m.Plan(share=0.5, epochs=1), *leaf)
        assert out.count() == sum(r.copies for r in rows) and out.where("text = 'alike'").count() in (0, 50)


def test_odd_rows(spark, odd, clashing, no_docs):
    leaf = (F.lit("d"), F.col("lang"), F.col("source"))
    got = m.decide(spark, odd, m.Plan(share=5.0, epochs=2), *leaf).collect()
    assert len(got) == odd.count() and {r.copies for r in got if r.n_tokens} == {2}
    out = m.mix(spark, clashing, m.Plan(share=5.0, epochs=2), *leaf)
    assert out.columns == clashing.columns
    assert out.where("doc_id = 7").count() == 4
    assert m.decide(spark, no_docs, PLAN, *leaf).count() == 0
    assert m.mix(spark, no_docs, PLAN, *leaf).count() == 0
