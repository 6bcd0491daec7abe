"""The pipeline's near dedup against all pairs by their true similarity."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline as pipeline
from tidemill.llm import simhash_similar as n


def words(text):
    have = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(have[i : i + 5]) for i in range(max(1, len(have) - 4))} if have else set()


def brute(rows):
    label = {d: d for d, _ in rows}
    sets = [(d, words(text)) for d, text in rows]
    for i, (d, a) in enumerate(sets):
        for e, b in sets[i + 1 :]:
            if a == b or len(a & b) >= 0.8 * len(a | b):
                old, new = max(label[d], label[e]), min(label[d], label[e])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def copies(seed=3, families=12, each=6):
    """Families of texts: a base, and copies in which a few single words are replaced."""
    draw, rows = random.Random(seed), []
    for _ in range(families):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(150, 400))]
        for k in range(each):
            text = list(base)
            for at in draw.sample(range(len(base)), len(base) * k // 200 + bool(k)):
                text[at] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  two"), (905, "three")]


def test_equals_all_pairs(spark):
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in n.classes(spark, docs).collect()} == want
    assert len(set(want.values())) < 40
    assert {r.doc_id for r in pipeline.distinct(spark, docs, "").collect()} == set(want.values())
    assert {r.doc_id: r.component_id for r in n.classes(spark, docs, block=2, open_block=2).collect()} == want


def test_fingerprints_equal_a_plain_count():
    draw = random.Random(2)
    for size in (0, 1, 2, 255, 256, 700):
        hashes = np.array(sorted({draw.getrandbits(64) for _ in range(size)}), np.uint64)
        seeds = random.Random(11)
        first, then = ([seeds.getrandbits(64) | 1 for _ in range(10)] for _ in range(2))
        counts = [0] * 640
        for h in hashes.tolist():
            for w in range(10):
                x = h * first[w] % (1 << 64)
                x = (x ^ x >> 32) * then[w] % (1 << 64)
                for at, byte in enumerate(x.to_bytes(8, "little")):
                    for bit in range(8):
                        counts[64 * w + 8 * at + bit] += byte >> (7 - bit) & 1
        assert n.fingerprint(hashes, 640).tolist() == [2 * c > size for c in counts]


def test_trees_connect_what_pairs_within_reach_connect():
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2, (6, 640), dtype=np.uint8)[rng.integers(0, 6, 60)]
    bits ^= (rng.random(bits.shape) < rng.random((60, 1)) * 0.12).astype(np.uint8)
    rows = n.unpacked(pa.array([np.packbits(b).tobytes() for b in bits], pa.binary()))
    label, tree = list(range(60)), list(range(60))
    pairs = [(i, j) for i in range(60) for j in range(i) if (bits[i] != bits[j]).sum() <= 100]
    for groups, edges in ((label, pairs), (tree, n.spanning_trees(rows, 100))):
        for i, j in edges:
            old, new = max(groups[i], groups[j]), min(groups[i], groups[j])
            groups[:] = [new if g == old else g for g in groups]
    assert label == tree and 1 < len(set(label)) < 60


def test_units_that_cross_batches():
    sets = [n.shingle_set(text) for _, text in copies(families=2)[:12]]
    packed = [np.packbits(n.fingerprint(s, 640)).tobytes() for s in sets]
    batch = pa.RecordBatch.from_pydict({**{c: [0] * 12 for c in "cij"}, "key": [0] * 9 + [1] * 3, "node": list(range(12)), "v": list(range(12)), "bits": packed, "hashes": [s.view("int64") for s in sets]})

    def pairs(run, batches):
        return [pair for out in run(batches) for pair in zip(*(c.to_pylist() for c in out.columns), strict=True)]

    for run in (n._open_units(128, 0.8), n._trees(128)):
        got = pairs(run, [batch])
        assert got and all(pairs(run, [batch.slice(0, at), batch.slice(at, 2), batch.slice(at + 2)]) == got for at in (1, 5, 8))


def test_pairs_within_the_radius_collide():
    """All fingerprints within 79 of 880 bits share a key; of copies of similarity 0.8 and more nearly all do."""
    family, draw = n.masks(n.PART_RADIUS, bits=n.PART_BITS), random.Random(5)
    assert len(family) == 15

    def collide(bits):
        return any(not m & part for part in bits for m in family)

    for _ in range(500):
        flips = set(draw.sample(range(880), 79))
        assert collide([sum(1 << (i - 44 * p) for i in flips if i // 44 == p) for p in range(20)])
    missed = seen = 0
    for _ in range(300):
        base = [f"w{draw.randrange(5000)}" for _ in range(200)]
        text = list(base)
        for at in draw.sample(range(200), draw.randrange(1, 5)):
            text[at] = "x"
        a, b = n.shingle_set(" ".join(base)), n.shingle_set(" ".join(text))
        if n.alike(a, b, 0.8):
            seen += 1
            flips = (n.fingerprint(a, 880) != n.fingerprint(b, 880)).reshape(20, 44)
            missed += not collide([sum(1 << int(i) for i in np.flatnonzero(part)) for part in flips])
            assert flips.sum() <= n.REACH * 880
    assert seen > 100 and missed <= 5


def test_similar_sizes_share_a_class():
    for a in [*range(1, 400), 1023, 1024, 4095, 4096, 65_535, 10**6]:
        for b in range(a, int(a / 0.8 + 1e-9) + 1) if a < 400 else (a, a + 1, int(a / 0.8)):
            assert set(n.size_classes(a, 0.8)) & set(n.size_classes(b, 0.8)), (a, b)
    assert n.size_classes(0, 0.8) == [0] and n.size_classes(15, 0.8) == [1, 2] and n.size_classes(300, 0.8) == [4]


def test_further_links_join_components(spark):
    from tidemill.session import Scratch

    linked = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)], "node long, component long")
    more = spark.createDataFrame([(2, 4), (4, 9), (9, 8), (11, 12)], "a long, b long")
    got = {r.node: r.component for r in n._joined_up(spark, linked, more, Scratch(spark, "test")).collect()}
    assert {k: got[k] for k in (5, 6)} == {5: 5, 6: 5} and len({got[k] for k in (1, 2, 3, 4, 8, 9)}) == 1 and got[11] == got[12]
    assert len(set(got.values())) == 3 and len(got) == 10
    none = n._joined_up(spark, linked, more.limit(0), Scratch(spark, "test"))
    assert {(r.node, r.component) for r in none.collect()} == {tuple(r) for r in linked.collect()}


def test_rows_that_share_an_id(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(4, base), (None, base), (7, "some text of its own that nothing repeats"), (7, base + " end"), (None, "another one of its own here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, n.near_dedup(spark, docs).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[4]], key=str)


def test_odd_rows(spark, odd, clashing, no_docs):
    assert n.near_dedup(spark, clashing).columns == clashing.columns
    again = odd.union(odd.selectExpr("doc_id + 100", "text", "lang", "source", "n_chars"))
    got = {r.doc_id for r in n.near_dedup(spark, again).collect()}
    assert got <= {r.doc_id for r in odd.collect()}
    assert n.near_dedup(spark, no_docs).count() == 0
