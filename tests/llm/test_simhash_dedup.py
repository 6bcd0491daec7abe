import itertools
import random

import numpy as np
import xxhash

from tidemill.llm import simhash_dedup as s
from tidemill.llm.common import components
from tidemill.session import Scratch


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    parts = [" ".join(words)] if 0 < len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps, radius=3):
    label = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    return label


def test_fingerprints(odd_rows):
    for _, text, *_ in odd_rows:
        text = (text or "")[:2000]
        assert s.fingerprint(text) == plain_fingerprint(text)


def test_masks_cover_the_radius():
    rng, family = random.Random(3), s.masks(3)
    assert len(family) == 15
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
        assert any(not m & flips for m in family)
    for flips in itertools.combinations(range(0, 64, 3), 3):
        assert any(not m & sum(1 << b for b in flips) for m in family)


def links_of(spark, fps, block):
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in sorted(set(fps))], "fp long")
    scratch = Scratch(spark, "test")
    return {r.node: r.component for r in components(spark, s.links(nodes, scratch, 3, block), scratch).collect()}


def test_links_equal_brute_force_with_and_without_blocks(spark):
    rng = random.Random(5)
    fps = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        fps += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(40)]
    fps = sorted(set(fps))
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    label = plain_classes(fps)
    want = {}
    for i, x in enumerate(label):
        want.setdefault(x, set()).add(signed[i])
    want = {frozenset(g) for g in want.values() if len(g) > 1}
    for block in (7, 4096):
        got = {}
        for node, component in links_of(spark, fps, block).items():
            got.setdefault(component, set()).add(node)
        assert {frozenset(g) for g in got.values()} == want


def test_components_of_a_star_and_a_chain(spark):
    """A star of 100,000 nodes around its largest one, and a chain beside it."""
    from pyspark.sql import functions as F

    star = spark.range(100_000).select(F.col("id").alias("a"), F.lit(100_000).cast("long").alias("b"))
    chain = spark.range(200_000, 200_200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    odd = spark.createDataFrame([(7, 7), (None, 3), (3, None)], "a long, b long")
    found = components(spark, star.union(chain).union(odd), Scratch(spark, "test"))
    assert {(r.component, r["count"]) for r in found.groupBy("component").count().collect()} == {(0, 100_001), (200_000, 201)}
    assert found.count() == found.select("node").distinct().count()


def test_classes_of_odd_rows(odd, odd_rows, spark):
    rows = s.classes(spark, odd).collect()
    assert len(rows) == len(odd_rows)
    fps = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    for doc in (3, 4, 5):
        assert fps[doc] == ("0" * 16, 3)
    assert fps[7][1] == fps[2][1] == 1


def test_near_dedup(clashing, spark, no_docs):
    out = s.near_dedup(spark, clashing)
    assert out.columns == clashing.columns
    assert {r.doc_id for r in out.select("doc_id").collect()} == {1, 3, 6, None, 9}
    assert s.classes(spark, no_docs).count() == 0
    assert s.near_dedup(spark, no_docs).count() == 0
