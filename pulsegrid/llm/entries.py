"""Queries of the training-data operators, one per operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_cnn, decontam, edit_tokens, html_mss, lattice_lm, mixing, rule_ledger, signature_tree, toxicity, url_gbt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), mod=5, remainder=0)


def demo_edits(doc_id: str = "doc_id", text: str = "text"):
    """Three edits of a document that follow from its id and length: a replacement somewhere, an insertion in front, an addition at the end."""
    n = F.coalesce(F.length(text), F.lit(0))
    start = F.pmod(F.xxhash64(F.col(doc_id), F.lit(1)), n + 1).cast("int")
    stop = start + F.pmod(F.xxhash64(F.col(doc_id), F.lit(2)), F.lit(40)).cast("int")
    edit = lambda a, b, new: F.struct(a.alias("start"), b.alias("stop"), F.lit(new).alias("new"))
    end = F.lit(2**31 - 1)
    return F.array(edit(start, stop, " an edited passage, 2024 "), edit(F.lit(0), F.lit(0), "Revised. "), edit(end, end, "\nEnd of text."))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", demo_edits())
    return edit_tokens.edited_counts(docs, "edits")


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lattice_scores(table(spark, sf_dir, "documents"), mod=5, remainder=1)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_gbt.url_filter(table(spark, sf_dir, "pages"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.jaccard_components(table(spark, sf_dir, "documents"), shingle=4, num=85, den=100)


def op8_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), mod=3, remainder=1)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = rule_ledger.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = ~rule_ledger.passes("base-1")
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & rule_ledger.passes("web-1")).alias("kept"), "n_lines", "n_upper_words", "failed_bits"
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mss.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP7_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.m)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.m) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""

OP9_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w)
          WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines,
      CAST(len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z].*[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS BIGINT) AS n_upper_words
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, CAST({" + ".join(f"CASE WHEN {fails} THEN {1 << k} ELSE 0 END" for k, (_, fails) in enumerate(rule_ledger.RULES))} AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & {rule_ledger.POLICIES["base-1"]}) <> 0 AS base_failed,
       (failed_bits & {rule_ledger.POLICIES["web-1"]}) = 0 AS kept, n_lines, n_upper_words, failed_bits FROM f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_lattice_lm, op4_source_mix, op5_url_filter, op6_decontam, op7_ngram_jaccard, op8_quality_cnn, op9_quality_rules, op10_html_text)}


def oracle_sql() -> dict[str, str]:
    return {"op7_ngram_jaccard": OP7_SQL, "op9_quality_rules": OP9_SQL}
