import itertools
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import license_scan as s

SCANNER = s.scanner(tuple(s.TEMPLATES.items()), s.MIN_COVERAGE)


def names(text):
    return [h[0] for h in SCANNER.hits(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=9))
def test_rising_is_longest(values):
    pairs = list(enumerate(values))
    got = s.rising(pairs)
    assert all(a < c and b < d for (a, b), (c, d) in itertools.pairwise(got))
    longest = max((len(c) for n in range(len(pairs) + 1) for c in itertools.combinations(pairs, n) if all(x[1] < y[1] for x, y in itertools.pairwise(c))), default=0)
    assert len(got) == longest


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=12), st.lists(st.sampled_from("abcdef"), max_size=12))
def test_alignment_is_a_common_subsequence(a, b):
    got = s.align(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(i < k and j < m for (i, j), (k, m) in itertools.pairwise(got))
    if a == b:
        assert len(got) == len(a)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def test_coverage_is_near_that_of_the_longest_common_subsequence():
    rng = random.Random(1)
    for name, text in s.TEMPLATES.items():
        own = s.words(text)
        for _ in range(3):
            noisy = [w if rng.random() > 0.06 else f"x{rng.randint(0, 9)}" for w in own]
            best, got = lcs(own, noisy), len(s.align(own, noisy))
            assert got <= best and got >= 0.9 * best, name


def test_each_license_is_found_wherever_it_is():
    filler = "some words that are of no license at all and go on for a while " * 40
    for name, text in s.TEMPLATES.items():
        assert names(filler + text + " " + filler + text.upper()) == [name, name]
        start, end = SCANNER.hits(filler + text)[0][1:3]
        assert s.words((filler + text)[start:end]) == s.words(text)
        assert names(filler) == []


def test_all_license_lines_of_the_documents(spark, sf_dir):
    """Against a plain search for the lines that the documents' maker adds."""
    from tidemill.sources import table

    docs = table(spark, sf_dir, "documents")
    got = {r.doc_id for r in s.report(docs).where("n_hits > 0").collect()}
    want = {r.doc_id for r in docs.where("text rlike 'Released under the MIT License|Licensed under|is licensed under the GNU'").collect()}
    assert got == want


def test_odd_rows(odd, clashing, no_docs):
    rows = s.report(odd).collect()
    assert len(rows) == odd.count() and all(r.n_hits == 0 and r.hits == "" and r.license is None for r in rows)
    out = s.scan(clashing)
    assert out.columns == clashing.columns
    assert s.report(no_docs).count() == 0


@pytest.mark.parametrize("name", sorted(s.TEMPLATES))
def test_each_template_has_its_own_name(name):
    assert [h[0] for h in s.Scanner(tuple(s.TEMPLATES.items()), 0.8).hits(f"Before it. {s.TEMPLATES[name]} After it.")] == [name]


@pytest.mark.parametrize(
    "text, name",
    [
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0-short"),
        ("This work is licensed under the GNU General Public License, version 1.", "GPL-family"),
        ("This work is licensed under the GNU Library General Public License, version 3.", "GPL-family"),
        ("This work is licensed under the GNU Lesser General Public License, version 4.", "GPL-family"),
        ("This work is licensed under a Creative Commons Attribution 3.0 International License.", "CC-family"),
        (s.TEMPLATES["GPL-3.0"].replace("General", "Affero General"), "AGPL-3.0"),
        (s.TEMPLATES["BSD-2-Clause"] + " 3. Neither the name of X may be used.", "BSD-family"),
    ],
)
def test_relatives_are_told_apart(text, name):
    assert [h[0] for h in s.Scanner(tuple(s.TEMPLATES.items()), 0.8).hits(text)] == [name]


def brute(text):
    """Hits of exact copies: all places of all templates, of which those of most words stay."""
    have = [(m.group().lower(), m.start(), m.end()) for m in s.WORD.finditer(text)]
    plain, places = [w for w, _, _ in have], []
    for name, template in s.TEMPLATES.items():
        own = s.words(template)
        places += [(-len(own), at, at + len(own), name) for at in range(len(plain) - len(own) + 1) if plain[at : at + len(own)] == own]
    kept = []
    for _, a, b, name in sorted(places):
        if not any(x < b and a < y for x, y, _ in kept):
            kept.append((a, b, name))
    return [(name, have[a][1], have[b - 1][2], 1.0) for a, b, name in sorted(kept)]


@pytest.mark.parametrize("before", [0, 1, 2, 3, 50])
@pytest.mark.parametrize("copies", [2, 3, 4])
def test_copies_side_by_side(before, copies):
    for name, template in s.TEMPLATES.items():
        text = " ".join([*(f"word{i}" for i in range(before)), *[template] * copies, "end"])
        assert SCANNER.hits(text) == brute(text) and names(text) == [name] * copies, name


def test_random_layouts_equal_brute_force():
    draw = random.Random(6)
    for _ in range(150):
        parts = [draw.choice(list(s.TEMPLATES.values())) if draw.random() < 0.6 else " ".join(f"w{draw.randrange(99)}" for _ in range(draw.randrange(60))) for _ in range(8)]
        text = " ".join(parts)
        assert SCANNER.hits(text) == brute(text)


def test_noisy_copies_side_by_side():
    draw, found, seen = random.Random(7), 0, 0
    for name, template in s.TEMPLATES.items():
        own = s.words(template)
        if len(own) < 15:
            continue
        for _ in range(5):
            noisy = " ".join(w if draw.random() > 0.04 else f"x{draw.randrange(9)}" for _ in range(3) for w in own)
            found += len(SCANNER.hits(f"one two {noisy}"))
            seen += 3
    assert found >= 0.95 * seen, (found, seen)


def test_many_hits_take_near_linear_time():
    text = f"{s.TEMPLATES['MIT-short']} and so on. " * 6000
    started = time.perf_counter()
    assert len(SCANNER.hits(text)) == 6000
    assert time.perf_counter() - started < 10
