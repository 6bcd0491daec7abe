"""Matching along sequences, and variants, on odd rows and against brute force."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.functions.variants import leaves, typed, url_parameters
from tidemill.operators.sequences import matched_once
from tidemill.plans.measured import clicks_of_purchases


def brute(rows, within):
    """rows: (key, at, id, kind). A plain search of the oldest free giver for each taker in order."""
    by_key, pairs = defaultdict(list), []
    for r in rows:
        if None not in r[:3] and r[3] in ("give", "take"):
            by_key[r[0]].append(r)
    for own in by_key.values():
        own.sort(key=lambda r: (r[1], r[2]))
        used = set()
        for i, (_, at, taker, kind) in enumerate(own):
            if kind == "take":
                free = [j for j in range(i) if own[j][3] == "give" and j not in used and own[j][1] >= at - within]
                if free:
                    used.add(free[0])
                    pairs.append((own[free[0]][2], taker))
    return Counter(pairs)


@pytest.mark.parametrize("within,cell", [(3, 1), (5, 20), (40, 7), (0, 5)])
def test_matches_equal_brute_force(spark, within, cell):
    draw = random.Random(within)
    rows = [(draw.choice(["hot"] * 5 + ["a", "b", None]), draw.choice([None, *range(150)]), draw.choice([None] + [i] * 20), draw.choice(["give", "take", "other", None])) for i in range(400)]
    rows += rows[:10]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "k string, t int, id int, kind string, at int, `a.b` string").repartition(3)
    out = matched_once(df, "k", F.col("t"), "id", F.col("kind") == "give", F.col("kind") == "take", within, cell)
    got, want = Counter((r.giver, r.taker) for r in out.collect()), brute(rows, within)
    assert got == want and (within == 0 or sum(want.values()) > 10)
    assert matched_once(df.limit(0), "k", F.col("t"), "id", F.lit(True), F.lit(False), within, cell).count() == 0


def test_clicks_of_purchases_equal_brute_force(spark, sf_dir):
    kinds = {"click": "give", "purchase": "take"}
    rows = [(u, at, i, kinds.get(k)) for u, at, i, k in duckdb.sql(f"SELECT user_id, epoch_us(ts), event_id, event_type FROM '{sf_dir}/events.parquet'").fetchall()]
    want = brute(rows, 21_600_000_000)
    assert Counter((r.click_id, r.purchase_id) for r in clicks_of_purchases(spark, sf_dir).collect()) == want and len(want) > 10


def test_variants_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "12"), (2, "a b"), (3, ""), (4, None), (5, '{"x": [1, "y"]}'), (6, "[3, 4]"), (7, "1.50")], "id int, t string").withColumn("v", typed(F.col("t")))
    kinds = {r.id: r.kind for r in df.select("id", F.schema_of_variant("v").alias("kind")).collect()}
    assert kinds == {1: "BIGINT", 2: "STRING", 3: "STRING", 4: None, 5: "OBJECT<x: ARRAY<VARIANT>>", 6: "ARRAY<BIGINT>", 7: "DECIMAL(2,1)"}
    found = sorted((r.id, r.pos, r.key, r.value.toJson()) for r in leaves(df, "v", "id").collect())
    assert [f for f in found if f[0] == 6] == [(6, 0, None, "3"), (6, 1, None, "4")]
    assert [f for f in found if f[0] == 5] == [(5, 0, "x", '[1,"y"]')] and leaves(df.limit(0), "v", "id").count() == 0


def test_url_parameters_of_odd_urls(spark):
    urls = [None, "", "http://a/b", "http://a/b?", "http://a?x=1&x=2&y", "http://a?q=a%20b&&z=%zz#f?n=1", "http://a#f?n=1", "http://a?k=v=w"]
    df = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    got = {r.id: r.p and [(p.name, p.v) for p in r.p] for r in df.select("id", F.transform(url_parameters(F.col("url")), lambda p: F.struct(p["name"].alias("name"), F.to_json(p["value"]).alias("v"))).alias("p")).collect()}
    assert got == {0: None, 1: [], 2: [], 3: [], 4: [("x", "1"), ("x", "2"), ("y", '""')], 5: [("q", '"a b"'), ("z", '"%zz"')], 6: [], 7: [("k", '"v=w"')]}
