import random

import xxhash

from tidemill.llm import line_dedup as d

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, run=3, run_words=50):
    """Look at all runs of lines of any length: each that has enough lines or words and came earlier, as a whole, goes."""
    texts = sorted(((doc is None, doc), (text or "").split("\n")) for doc, text in rows)
    seen, out = set(), {}
    for (_, doc), lines in texts:
        at = [i for i, line in enumerate(lines) if line.strip(WHITE)]
        body, gone = [lines[i].strip(WHITE) for i in at], set()
        for k in range(len(body)):
            for stop in range(k + 1, len(body) + 1):
                if tuple(body[k:stop]) in seen and (stop - k >= run or sum(len(x.split()) for x in body[k:stop]) >= run_words):
                    gone |= set(range(k, stop))
            seen |= {tuple(body[k:stop]) for stop in range(k + 1, len(body) + 1)}
        out[doc] = (len(gone), "\n".join(line for i, line in enumerate(lines) if i not in at or at.index(i) not in gone))
    return out


ROWS = [
    (1, "a\nb\nc\nd\ne"), (2, "x\nb\n c\t\n\nd\ny"), (3, "a\nb\nz"), (4, "q\nq\nq\nq\nq"), (5, " ".join(f"w{i}" for i in range(60)) + "\nlast"),
    (6, "first\n" + " ".join(f"w{i}" for i in range(60))), (7, ""), (8, "\n\n \n"), (9, "m\nb\nc\nd\ne\nn\na\nb\nc"),
]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.lines_removed, r.text) for r in d.dedup_lines(spark, docs).collect()}
    assert got == brute(ROWS)
    assert got[2] == (3, "x\n\ny") and got[6] == (1, "first")


def test_random_lines_equal_brute_force(spark):
    draw = random.Random(8)
    line = lambda: " ".join([draw.choice("abc")] + ["w"] * draw.choice([0, 0, 20, 26, 49, 50]))
    rows = [(i, "\n".join(line() for _ in range(draw.randrange(12)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.lines_removed, r.text) for r in d.dedup_lines(spark, docs).collect()}
    assert got == brute(rows) and sum(n for n, _ in got.values()) > 200


def test_matches_extend_beyond_their_windows(spark):
    """The first two lines have 50 words, so they are a window; the third one is too short for a window of its own."""
    run = [" ".join(["x"] * 40), " ".join(["y"] * 15), "tail"]
    rows = [(1, "\n".join(["a", *run, "b"])), (2, "\n".join(["c", *run, "d"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["_id"], r.start, r.stop, r.from_id, r.from_start) for r in d.repeats(spark, docs).collect()}
    assert found == {(2, 1, 4, 1, 1)}
    assert {r.doc_id: r.text for r in d.dedup_lines(spark, docs).collect()} == {1: rows[0][1], 2: "c\nd"}


def test_runs_go_whole_whichever_text_has_them(spark):
    """A line of 50 words comes first alone, then with two short lines, then with both once more."""
    long = " ".join(["w"] * 50)
    rows = [(1, long), (2, f"{long}\ns one\ns two"), (3, f"head\n{long}\ns one\ns two"), (4, f"{long}\ns one\nother"), (5, f"s one\n{long}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.lines_removed, r.text) for r in d.dedup_lines(spark, docs).collect()}
    assert got == brute(rows) == {1: (0, long), 2: (1, "s one\ns two"), 3: (3, "head"), 4: (2, "other"), 5: (1, "s one")}
    assert {(r["_id"], r.start, r.stop, r.from_id) for r in d.repeats(spark, docs).collect()} >= {(3, 1, 4, 2), (4, 0, 2, 2), (2, 0, 1, 1)}


def test_passages_of_two_lines_are_found(spark):
    for sizes in ((4, 47), (43, 49), (34, 33), (25, 26)):
        run = "\n".join(" ".join(f"{side}{i}" for i in range(n)) for side, n in zip("pq", sizes, strict=True))
        docs = spark.createDataFrame([(1, f"a\n{run}\nb"), (2, f"c\n{run}\nd")], "doc_id long, text string")
        assert {r.doc_id: r.text for r in d.dedup_lines(spark, docs).collect()}[2] == "c\nd", sizes


def test_fingerprints_are_minima_of_all_windows():
    draw = random.Random(9)
    text = "\n".join(str(draw.randrange(40)) for _ in range(3000))
    lines = d.lines_of(text)
    found, hashes = d.fingerprints(lines), [xxhash.xxh64_intdigest(line) - (1 << 63) for line in lines]
    starts = sorted(start for _, some in found.values() for start, _ in some)
    assert starts == list(range(2998)) and 0.4 < len(found) / 3000 < 0.65
    for at, (mark, some) in found.items():
        assert hashes[at] == mark and all(mark == min(hashes[s : s + n]) and s <= at < s + n for s, n in some)


def test_odd_rows(spark, odd, clashing, no_docs):
    out = d.dedup_lines(spark, clashing)
    assert sorted(out.columns) == sorted(clashing.columns)
    assert {r.doc_id: r.text for r in out.collect()} == {r.doc_id: r.text for r in odd.collect()}
    again = odd.union(odd.selectExpr("doc_id + 100", "text", "lang", "source", "n_chars"))
    rows = {r.doc_id: r for r in d.dedup_lines(spark, again).collect()}
    assert rows[106].text == "" and rows[106].lines_removed == 1 and rows[3].text is None
    assert d.dedup_lines(spark, no_docs).count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    for doc in (None, 7):
        texts = ["p\nq\nr\nu1\nu2\nu3", "s1\ns2\ns3\np\nq\nr", "p\nq\nr\nend"]
        docs = spark.createDataFrame([(doc, text, i) for i, text in enumerate(texts)], "doc_id long, text string, n int").repartition(3)
        out = {r.n: (r.lines_removed, r.text) for r in d.dedup_lines(spark, docs).collect()}
        cut = ["u1\nu2\nu3", "s1\ns2\ns3", "end"]
        assert sorted(removed for removed, _ in out.values()) == [0, 3, 3]
        for i, (removed, text) in out.items():
            assert text == (cut[i] if removed else texts[i])
        twice = spark.createDataFrame([(doc, "a\nb\nc")] * 3, "doc_id long, text string").repartition(3)
        assert sorted((r.lines_removed, r.text) for r in d.dedup_lines(spark, twice).collect()) == [(0, "a\nb\nc"), (3, ""), (3, "")]
