import numpy as np
import pytest

from tidemill.llm import embedding_dedup as e


def brute(vectors, least=0.95):
    usable = {i for i, v in enumerate(vectors) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: [] for i in range(len(vectors))}
    for i in usable:
        for j in usable:
            if i < j and len(vectors[i]) == len(vectors[j]):
                a, b = (np.array(vectors[k], np.float32).astype(float) for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links[i].append(j)
                    links[j].append(i)
    component = {}
    for i in links:
        if i not in component:
            stack = [i]
            while stack:
                k = stack.pop()
                if k not in component:
                    component[k] = i
                    stack += links[k]
    return {i: (len(links[i]), component[i]) for i in links}


@pytest.mark.parametrize("block", [3, 16, 2048])  # with 3, tiles hold several blocks a side
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(e, "BLOCK", block)
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(25):
        centre = rng.normal(size=12)
        vectors += [(centre + rng.normal(size=12) * s).tolist() for s in (0.0, 0.0, 0.1, 0.2, 0.25, 0.3)]
    vectors += [None, [], [0.0] * 12, [1.0, None] + [0.0] * 10, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0], [1e-30, 0.0], [1e30, 0.0], [5.0], [-5.0], [3.0]]
    vectors += [vectors[0]] * 40
    docs = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(5)
    rows = e.links(spark, docs).collect()
    want = brute(vectors)
    assert len(rows) == len(vectors)
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_chain_is_one_component(spark):
    angles = np.arange(80) * 0.2
    docs = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles) if a < 3], "vec_id long, embedding array<double>")
    assert {r.component_id for r in e.links(spark, docs).collect()} == {0}


def test_intervals_are_skipped_and_lose_no_pair():
    rng = np.random.default_rng(5)
    u = np.sort(rng.normal(size=(900, 2)) * [3, 1], axis=0) @ np.eye(2, 8) + rng.normal(size=(900, 8)) * 0.2
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    turn = np.linalg.svd(u - u.mean(axis=0))[2][:3].T
    u = u[np.argsort(u @ turn[:, 0])]
    linked, compared = e.linked_pairs(u[:500], u[400:], turn, 0.95, 32)
    assert (linked == (u[:500] @ u[400:].T >= 0.95)).all()
    assert 0 < compared < 0.7 * linked.size


@pytest.mark.parametrize(("n", "m", "leaf"), [(1, 1, 4), (1, 65, 4), (33, 7, 4), (64, 64, 64), (100, 37, 8), (37, 129, 16)])
def test_intervals_of_any_number(n, m, leaf):
    """Blocks of different lengths, the last interval of each a short one."""
    rng = np.random.default_rng(n * m)
    u = np.repeat(rng.normal(size=(12, 5)), 20, axis=0)[: n + m] + rng.normal(size=(n + m, 5)) * 0.1
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    turn = np.linalg.qr(rng.normal(size=(5, 5)))[0][:, :3]
    a, b = u[:n], u[n:]
    linked, compared = e.linked_pairs(a, b, turn, 0.95, leaf)
    assert linked.shape == (n, m) and (linked == (a @ b.T >= 0.95)).all() and compared <= linked.size
    assert not e.linked_pairs(a, -b, turn, 1.1, leaf)[0].any()


@pytest.mark.parametrize("kind", ["int", "bigint", "decimal(20,6)", "double"])
def test_numbers_of_other_kinds_are_doubles(spark, kind):
    big = 2**24 + 1
    docs = spark.createDataFrame([(1, [big, 3]), (2, [big, 3]), (3, [-3, big]), (4, None)], "vec_id long, embedding array<bigint>").selectExpr("vec_id", f"cast(embedding as array<{kind}>) as embedding")
    assert {(r.vec_id, r.n_links, r.component_id) for r in e.links(spark, docs).collect()} == {(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)}


def test_rows_that_share_an_id_stay_apart(spark):
    rows = [(4, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [1.0, 0.0]), (None, None), (None, [-1.0, 0.0]), (None, [-1.0, 0.001])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.embedding) for r in e.near_dedup(spark, docs).collect()]
    assert sorted(got[:], key=str) in (sorted([rows[0], rows[2], rows[4], rows[5]], key=str), sorted([rows[0], rows[2], rows[4], rows[6]], key=str))


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, _id int, raw string")
    assert e.links(spark, empty).count() == 0
    assert e.near_dedup(spark, empty).columns == empty.columns
    some = spark.createDataFrame([(None, [1.0, 0.0], 1, "x"), (4, [1.0, 0.0], 1, "x"), (4, [1.0, 0.01], 2, "y"), (2, None, 3, "z")], "vec_id long, embedding array<float>, _id int, raw string")
    rows = sorted(map(tuple, e.links(spark, some).collect()), key=str)
    assert [r[:3] for r in rows if r[0] == 4] == [(4, 2, 4)] * 2
    assert [r[:3] for r in rows if r[0] is None] == [(None, 2, 4)]
    assert e.near_dedup(spark, some).where("vec_id = 2").count() == 1
