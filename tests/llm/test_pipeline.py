"""The pipeline's stages against plain versions of what each should keep."""

import hashlib

import corpus_pipeline as pipeline
from tidemill.llm import mixing, toxicity
from tidemill.llm.simhash_similar import shingle_set
from tidemill.session import Scratch
from tidemill.sources import table

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(spark, docs, table(spark, SF, "labels"))
    toxic = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe_codec":
            assert out.columns == docs.columns
        rows = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            assert set(rows) == {d for d, r in kept.items() if model.score(r.text) < 0.7}
            assert len(set(rows) & toxic) < 0.3 * len(toxic) and len(set(kept) - set(rows) - toxic) < 0.1 * len(kept)
        elif name == "exact_dedup":
            best = {}
            for d, r in kept.items():
                key = "".join(c for c in r.text if c not in WHITE)
                best[key] = min(best.get(key, (1, 0)), (-len(r.text), d))
            assert set(rows) == {d for _, d in best.values()}
        elif name == "simhash_dedup":
            sets = sorted((d, set(shingle_set(r.text).tolist())) for d, r in kept.items())
            label = {d: d for d, _ in sets}
            for i, (d, x) in enumerate(sets):
                for e, y in sets[i + 1 :]:
                    if label[d] != label[e] and len(x & y) >= 0.8 * len(x | y):
                        old, new = max(label[d], label[e]), min(label[d], label[e])
                        label = {k: new if v == old else v for k, v in label.items()}
            assert set(rows) == set(label.values())
        elif name == "mixing":
            want = mixing.decide(spark, docs, pipeline.PLAN, *_leaf()).where("copies > 0").collect()
            assert set(rows) == {r.doc_id for r in want} and 0 < len(rows) < len(kept)
        else:
            assert set(rows) == set(kept)
            for d, r in rows.items():
                assert r.decoded_sha256 == hashlib.sha256(kept[d].text.encode()).hexdigest()
                assert len(r.ids) == r.n_tokens
        kept, docs = rows, out
    assert {r.doc_id for r in pipeline.run(spark, SF).collect()} == set(kept)


def _leaf():
    from pyspark.sql import functions as F

    from tidemill.llm.queries import DOMAIN

    return F.expr(DOMAIN), F.col("lang"), F.col("source")


def run_stages(spark, docs):
    """Each stage's rows, all columns but the last one's checked."""
    scratch, counts = Scratch(spark, "test"), []
    for name, stage in pipeline.STAGES:
        out = scratch.save(stage(spark, docs, SMALL))
        if name != "bpe_codec":
            assert out.columns == docs.columns
        counts.append((name, out.collect()))
        docs = out
    return dict(counts)


def test_odd_rows_through_all_stages(spark, clashing, odd_rows):
    got = run_stages(spark, clashing)
    texts = {(r[0], r[1]) for r in odd_rows}
    assert all((r.doc_id, r.text) in texts for name in ("toxicity", "exact_dedup", "simhash_dedup", "mixing") for r in got[name])
    assert len(got["toxicity"]) == len(odd_rows)
    # the fox once, as written with most characters; empty texts once; a null id like any other
    assert sorted((r.doc_id or 0) for r in got["exact_dedup"]) == [0, 2, 5, 6, 9]
    assert sorted((r.doc_id or 0) for r in got["simhash_dedup"]) == [0, 2, 5, 6, 9]
    assert {r.doc_id for r in got["bpe_codec"]} == {r.doc_id for r in got["mixing"]}


def test_empty_table_through_all_stages(spark, no_docs):
    assert all(not rows for rows in run_stages(spark, no_docs).values())
