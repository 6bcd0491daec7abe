import hashlib

import pytest

from tidemill.llm import exact_dedup

WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    groups = {}
    for doc, text, *_ in rows:
        text = text or ""
        key = hashlib.sha256("".join(c for c in text if c not in WHITE).encode()).hexdigest()
        groups.setdefault(key, []).append((-len(text), doc is None, doc or 0, doc))
    return {key: (min(some)[3], len(some)) for key, some in groups.items()}


@pytest.mark.parametrize("words", [1, 2, 1 << 20])
def test_groups_equal_brute_force(odd, odd_rows, spark, words):
    """With a filter of one word nearly every row is a false hit; the result is the same."""
    want = brute(odd_rows)
    got = exact_dedup.exact_groups(spark, odd, filter_words=words).collect()
    assert len(got) == len(odd_rows)
    for row in got:
        assert (row.keep_id, row.group_size) == want[row.text_sha256]
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {2, 3, 5, 6, None, 9} - {3}
    assert {r.doc_id for r in got if not r.kept} == {1, 3, 4, 7}


def test_dedup_keeps_columns_and_one_row_a_group(clashing, spark):
    out = exact_dedup.exact_dedup(spark, clashing)
    assert out.columns == clashing.columns
    assert sorted(r.doc_id or 0 for r in out.select("doc_id").collect()) == [0, 2, 5, 6, 9]


def test_repeated_rows_leave_one(spark, odd):
    twice = odd.where("doc_id = 7")
    assert exact_dedup.exact_dedup(spark, twice).count() == 1


def test_empty(no_docs, spark):
    assert exact_dedup.exact_groups(spark, no_docs).count() == 0
    assert exact_dedup.exact_dedup(spark, no_docs).count() == 0


def test_filter_size_is_checked(odd, spark):
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(spark, odd, filter_words=3)


def test_hot_group(spark):
    from pyspark.sql import functions as F

    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup.exact_groups(spark, docs)
    assert out.where("kept").count() == 5000 - 1667 + 1
    assert out.where("group_size = 1667 and keep_id = 0").count() == 1667
