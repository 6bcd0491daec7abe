import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemill.llm import turn_repair as t
from tidemill.llm.queries import QUERIES, damaged

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(turns):
    """Cost and least audit of (role, text, fault) by a search over all edits, turn by turn: state to the best (cost, audit, repaired)."""
    best = {"": (0, "", ())}  # by the shape of what is made: nothing, s, u or a last

    def put(into, shape, entry):
        if shape not in into or entry[:2] < into[shape][:2]:
            into[shape] = entry

    def grown(shape, initial):
        if initial == "s":
            return "s" if shape == "" else None
        if initial == "u":
            return "u" if shape in ("", "s", "a") else None
        return "a" if initial == "a" and shape == "u" else None

    def inserts(states):
        # any number of inserts; two more of them lead back to the same shape
        out = dict(states)
        for _ in range(3):
            for shape, (cost, audit, made) in list(out.items()):
                for role in ("user", "assistant"):
                    if (after := grown(shape, role[0])) is not None:
                        put(out, after, (cost + 3, audit + "I", (*made, (role, ""))))
        return out

    for role, text, fault in turns:
        into = {}
        for shape, (cost, audit, made) in inserts(best).items():
            put(into, shape, (cost + 4, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if (after := grown(shape, role[:1])) is not None:
                put(into, after, (cost + more, audit + "K", (*made, (role, text))))
            for other in ("user", "assistant"):
                if (after := grown(shape, other[0])) is not None:
                    put(into, after, (cost + 3 + more, audit + "R", (*made, (other, text))))
        best = into
    done = inserts(best)
    return min(done[s] for s in ("", "a") if s in done)


def brute(rows):
    """Expected row of one conversation's turns in order: (turn, role, text)."""
    seen, kinds = set(), []
    for _, role, text in rows:
        visible = text.strip(WHITE)
        kinds.append("blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))
    cost, audit, made = cheapest([(r, x, k) for (_, r, x), k in zip(rows, kinds, strict=True)])
    initials = [r[:1] for _, r, _ in rows]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in made))
    turns = [n for n, *_ in rows if n is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, digest), made


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))


def test_tables_equal_single_steps():
    use = t.tables()
    assert len(use.vectors) < 200 and use.block == 4
    draw = random.Random(1)
    for _ in range(300):
        symbols, v = [draw.randrange(1, 10) for _ in range(draw.randrange(14))], draw.randrange(len(use.vectors))
        costs = use.vectors[v]
        for s in reversed(symbols):
            costs = t.before(costs, s)
        behind, first, total = use.back(use.blocks(symbols), v)
        assert costs == tuple(c + total for c in use.vectors[first]) and use.map(use.blocks(symbols))[v] == first and len(behind) == -(-len(symbols) // 4)


def random_turns(draw, n):
    role = lambda: draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u"])
    text = lambda: draw.choice(["", " \n", "one", "two.", "three! ", "four", "five?", f"t{draw.randrange(99)}.", f"x{draw.randrange(99)}"])
    return in_order([(draw.choice([None, *range(12)]), role(), text()) for _ in range(n)])


@pytest.mark.parametrize("stretch", [1, 3, 4096])
def test_equals_brute_force(spark, monkeypatch, stretch):
    draw = random.Random(stretch)
    convs = {i: random_turns(draw, draw.choice([1, 2, 3, 5, 8, 13, 40])) for i in [None, *range(120)]}
    docs = spark.createDataFrame([(i, *r) for i, rows in convs.items() for r in rows], SCHEMA).repartition(5)
    monkeypatch.setattr(t, "STRETCH", stretch)  # a nested function takes it along to the workers
    saved, save = [], t.Scratch.save
    monkeypatch.setattr(t.Scratch, "save", lambda self, df: saved.append(save(self, df)) or saved[-1])
    got = {r.conv_id: tuple(r)[1:] for r in t.report(spark, docs).collect()}
    want = {i: brute(rows) for i, rows in convs.items()}
    assert got == {i: row for i, (row, _) in want.items()}
    cut = next(df for df in saved if "symbols" in df.columns)
    assert cut.agg(F.max(F.length("symbols"))).first()[0] == min(stretch, 40)
    turns = {}
    for r in t.repair(spark, docs).orderBy("position").collect():
        turns.setdefault(r.conv_id, []).append((r.position, r.role, r.text))
    assert turns == {i: [(k, *x) for k, x in enumerate(made)] for i, (_, made) in want.items() if made}


def test_ties_go_to_the_least_audit():
    for n in range(1, 6):
        for roles in itertools.product(["user", "assistant", "system", "tool"], repeat=n):
            rows = [(i, r, f"{i}{'.' if (i + len(r)) % 3 else ''}") for i, r in enumerate(roles)]
            want, made = brute(rows)
            now = t.Conversation(1)
            symbols = [t.fault(r, x, False)[1] for _, r, x in rows]
            stretch = {"symbols": bytes(symbols), "roles": list(roles), "texts": [x for *_, x in rows], "vector": 0, **dict.fromkeys(t.COUNTS, 0), "first": "", "last": "", "last_turn": None}
            out = [*now.trace(stretch), *now.finish()]
            assert (now.cost, "".join(now.audit), now.hash.hexdigest()) == want[5:] and tuple((r, x) for _, r, x, _ in out) == made


def test_query_equals_brute_force(spark, sf_dir):
    rows = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        rows.setdefault(r.conv_id, [])
        k, text, role = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20, r.text, r.role
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        rows[r.conv_id] += [(r.turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_turn_repair"](spark, sf_dir).collect()}
    assert got == {i: brute(in_order(some))[0] for i, some in rows.items()} and len({row[6] for row in got.values()}) > 5


def test_odd_rows(spark):
    empty = hashlib.sha256(b"").hexdigest()
    long = "word " * 50_000 + "end."
    rows = [(1, 0, "user", long), (1, 1, "assistant", "yes."), (2, None, None, None), (3, 5, "user", "a."), (3, 5, "user", "a."), (3, 9, "assistant", "b"), (None, None, "system", "s."), (None, 1, "user", "q?")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("_id", "_turn", "_role", "_text", "_h", "_key", "part", "seq", "open", "a.b")}).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in t.report(spark, docs, spark.createDataFrame([(1,), (7,), (7,), (None,), (2,), (3,)], "conv_id long")).collect()}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert got == {
        1: (0, 0, 0, 0, 0, 0, "KK", digest(f"user:{long}\nassistant:yes.")), 7: (0, 0, 0, 0, 0, 0, "", empty), 2: (0, 1, 0, 0, 0, 4, "D", empty),
        3: (3, 0, 1, 1, 1, 7, "KDK", digest("user:a.\nassistant:b")), None: (0, 0, 0, 0, 0, 3, "KKI", digest("system:s.\nuser:q?\nassistant:")),
    }
    none = docs.limit(0)
    assert t.report(spark, none).count() == 0 and t.repair(spark, none).count() == 0
    assert tuple(t.report(spark, none, docs.where("conv_id = 2").select("conv_id")).first()) == (2, 0, 0, 0, 0, 0, 0, "", empty)


def test_damage_of_nulls(spark):
    docs = spark.createDataFrame([(None, None, None, None), (5, None, "user", None)], SCHEMA)
    rows = damaged(docs).collect()
    k = [zlib.crc32(x.encode()) % 20 for x in (" : ", "5: ")]
    assert len(rows) == sum({0: 0, 3: 2}.get(x, 1) for x in k)
