"""Queries of the operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe_codec, embedding_dedup, exact_dedup, license_scan, line_dedup, mixing, periodic_runs, secret_scan, simhash_dedup, slack_pack, token_pack, toxicity, turn_repair
from tidemill.sources import table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(spark, table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a),
c AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.classes(spark, table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP5_SQL = r"""
WITH raw AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
),
l AS (
    SELECT *, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM raw
),
b AS (SELECT doc_id, i, t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words FROM l WHERE t <> ''),
k AS (
    SELECT doc_id, i, t, words, row_number() OVER o - 1 AS k, lead(t, 1) OVER o AS t1, lead(t, 2) OVER o AS t2, words + lead(words, 1) OVER o AS two FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
w AS (
    SELECT doc_id, k, 1 AS n, t AS lines FROM k WHERE words >= 50
    UNION ALL SELECT doc_id, k, 2, t || chr(10) || t1 FROM k WHERE two >= 50
    UNION ALL SELECT doc_id, k, 3, t || chr(10) || t1 || chr(10) || t2 FROM k WHERE t2 IS NOT NULL
),
f AS (SELECT *, first_value(doc_id) OVER p AS fd, first_value(k) OVER p AS fk FROM w WINDOW p AS (PARTITION BY lines ORDER BY doc_id NULLS LAST, k)),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS k FROM f WHERE doc_id <> fd OR k > fk),
r AS (SELECT l.doc_id, l.i, l.line, g.k IS NOT NULL AS gone FROM l LEFT JOIN k USING (doc_id, i) LEFT JOIN g ON g.doc_id = k.doc_id AND g.k = k.k)
SELECT doc_id, count(*) FILTER (WHERE gone) AS lines_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS text_sha256 FROM r GROUP BY doc_id
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(spark, table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op9_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_pack.write_and_check(spark, table(spark, sf_dir, "documents"))


#: Production weights of the test tables, whose sources end in a number that tells their domain.
MIX = mixing.Plan(domains={"d0": 4, "d1": 3, "d2": 2, "d3": 1}, languages={"en": 5, "de": 2, "fr": 2, "es": 1}, share=0.5, epochs=3, seed=11)
DOMAIN = "concat('d', coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint), 0) % 4)"


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(spark, table(spark, sf_dir, "documents"), MIX, F.expr(DOMAIN), F.col("lang"), F.col("source"))


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage: turns that are dropped, emptied, cut, repeated or given to the user, by their number."""
    number = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    held = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(number) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1)
    return held.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("k")).drop("k")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turn_repair.report(spark, damaged(turns), turns.select("conv_id"))


def op12_slack_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack_pack.pack(spark, table(spark, sf_dir, "documents"))


def _repeating(doc: object, n: int) -> np.ndarray | None:
    """The contract's change: in a tenth of the texts, words from some place on repeat with a period."""
    mark = 0 if doc is None else zlib.crc32(str(doc).encode())
    if doc is None or mark % 10 or not n:
        return None
    drawn = mark // 10
    since = drawn % n
    places, period = np.arange(n), 1 + (n - since) // (3 + drawn % 8)
    places[since:] = since + (places[since:] - since) % period
    return places


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"), taken=_repeating)


OP6_SQL = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
), r AS (
    SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(n) OVER w AS most, count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND n = most AS kept, text_sha256 FROM r
"""

def _share_out(name: str, table: str, parents: str, parent_table: str, level: str, weight: str) -> str:
    """CTEs that share out the budgets of `parent_table` among the rows of `table`."""
    part = f"PARTITION BY {parents}" if parents else ""
    up = f"JOIN {parent_table} USING ({parents})" if parents else f"CROSS JOIN {parent_table}"
    return f"""
{name}_w AS (SELECT {table}.*, {parent_table}.b, ({weight})::DOUBLE AS w FROM {table} {up}),
{name}_s AS (
    SELECT *, cap::DOUBLE * sum(w) OVER ({part} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        <= (b - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE * w AS whole
    FROM {name}_w WHERE w > 0
),
{name} AS (
    SELECT * EXCLUDE (b), CASE WHEN whole THEN cap ELSE greatest(floor(w * (b - coalesce(sum(CASE WHEN whole THEN cap END) OVER ({part}), 0))::DOUBLE
        / sum(CASE WHEN NOT whole THEN w END) OVER ({part})), 0)::BIGINT END AS b FROM {name}_s
)"""


OP10_SQL = rf"""
WITH d AS (
    SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 4)::VARCHAR AS domain, coalesce(lang, '') AS language,
        coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents
),
leaf AS (SELECT domain, language, source, sum(n_tokens)::BIGINT AS tokens, (3 * sum(n_tokens))::BIGINT AS cap FROM d GROUP BY ALL),
pair AS (SELECT domain, language, sum(cap)::BIGINT AS cap FROM leaf GROUP BY ALL),
top AS (SELECT domain, sum(cap)::BIGINT AS cap FROM leaf GROUP BY ALL),
root AS (SELECT floor(sum(tokens) * 0.5)::BIGINT AS b FROM leaf),
{_share_out("tops", "top", "", "root", "domain", "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 WHEN 'd3' THEN 1 ELSE 1 END")},
{_share_out("pairs", "pair", "domain", "tops", "language", "CASE language WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 1 ELSE 1 END")},
{_share_out("leaves", "leaf", "domain, language", "pairs", "source", "1")},
l AS (SELECT domain, language, source, b, tokens, CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END AS passes FROM leaves),
o AS (
    SELECT d.*, l.passes, l.b - l.passes * l.tokens AS rest,
        sum(n_tokens) OVER (PARTITION BY d.domain, d.language, d.source ORDER BY md5('11:' || l.passes::VARCHAR || ':' || coalesce(doc_id::VARCHAR, ''))) AS upto
    FROM d LEFT JOIN l USING (domain, language, source)
)
SELECT doc_id, domain, language, source, n_tokens, coalesce(passes + (rest > 0 AND upto <= rest)::BIGINT, 0)::BIGINT AS copies FROM o
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scan": op8_secret_scan,
    "op9_token_pack": op9_token_pack,
    "op10_mixing": op10_mixing,
    "op11_turn_repair": op11_turn_repair,
    "op12_slack_pack": op12_slack_pack,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": OP1_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op10_mixing": OP10_SQL,
}
