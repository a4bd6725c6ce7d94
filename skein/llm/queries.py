"""The training-data queries by name, with SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import latest, table
from .bpe import encode_corpus
from .langid import document_languages, language_segments, missing_languages
from .leaks import leaked_items
from .mojibake import find_garbled
from .pairs import pairs_above_chance
from .provenance import label_files
from .syntax.faults import check_files, fault_rates
from .topn import top_n_per_group


TOKENIZERS = os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not valid in the language of their extension."""
    return check_files(table(spark, sf_dir, "file_analyses")).filter("valid = false").select("file_id")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of invalid files per repo and language."""
    return fault_rates(check_files(table(spark, sf_dir, "file_analyses")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five constraints of highest confidence per scope_dir and category."""
    rows = table(spark, sf_dir, "scope_constraints").select("constraint_id", "scope_dir", "category", "confidence", "recorded_at")
    rows = latest(rows, ["constraint_id"]).filter("scope_dir is not null and category is not null and confidence between 0 and 1")
    rows = rows.withColumn("category", F.translate(F.lower(F.trim("category")), "-", "_"))
    return top_n_per_group(rows, ["scope_dir", "category"], "confidence", "constraint_id", 5).select("constraint_id")


P3_SQL = """
WITH r AS (
  SELECT constraint_id, scope_dir, category, confidence,
         row_number() OVER (PARTITION BY constraint_id ORDER BY recorded_at DESC) AS late
  FROM scope_constraints WHERE constraint_id IS NOT NULL
), c AS (
  SELECT constraint_id, scope_dir, replace(lower(trim(category)), '-', '_') AS category, confidence
  FROM r WHERE late = 1 AND scope_dir IS NOT NULL AND category IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1
), k AS (
  SELECT constraint_id, row_number() OVER (PARTITION BY scope_dir, category ORDER BY confidence DESC, constraint_id) AS rank FROM c
)
SELECT constraint_id FROM k WHERE rank <= 5
"""

def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that were not written by hand for their repository."""
    return label_files(table(spark, sf_dir, "file_analyses")).filter("label <> 'handwritten'").select("file_id")


def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of every file."""
    return label_files(table(spark, sf_dir, "file_analyses"))


def _mended(spark: SparkSession, sf_dir: str, restore: bool) -> DataFrame:
    return find_garbled(table(spark, sf_dir, "decoded_texts"), "text_id", "text", table(spark, sf_dir, "lang_samples"), "text", restore=restore)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that show characters from a wrong decoding."""
    return _mended(spark, sf_dir, False).filter("garbled").select("text_id")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected texts with what could be restored."""
    return _mended(spark, sf_dir, True).filter("garbled").select("text_id", "restored", "complete")


def _clean_paths(column: str):
    """Slashes for backslashes, no doubled slash, no leading ``./``; null elements go."""
    path = lambda x: F.regexp_replace(F.regexp_replace(F.translate(x, "\\", "/"), "/+", "/"), r"^\./", "")
    return F.array_distinct(F.transform(F.array_compact(column), path))


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = latest(table(spark, sf_dir, "observation_logs").select("commit_hash", "repo", "actual_files_modified", "recorded_at"), ["commit_hash"])
    predicted = latest(table(spark, sf_dir, "session_logs").select("session_id", "repo", "predicted_files", "recorded_at"), ["session_id"])
    return actual.select(F.lit("actual").alias("log_kind"), "repo", F.col("commit_hash").alias("record"), _clean_paths("actual_files_modified").alias("files")).unionByName(
        predicted.select(F.lit("predicted").alias("log_kind"), "repo", F.col("session_id").alias("record"), _clean_paths("predicted_files").alias("files"))
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files that occur together often and much more often than chance, per log and repo."""
    out = pairs_above_chance(_baskets(spark, sf_dir), ["log_kind", "repo"], "record", "files", 5, 3)
    return out.select("log_kind", "repo", F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"))


P6_SQL = """
WITH o AS (
  SELECT 'actual' AS log_kind, repo, commit_hash AS rec, actual_files_modified AS files, recorded_at FROM observation_logs
  UNION ALL SELECT 'predicted', repo, session_id, predicted_files, recorded_at FROM session_logs
), l AS (
  SELECT * FROM o WHERE rec IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY log_kind, rec ORDER BY recorded_at DESC) = 1
), f AS (
  SELECT DISTINCT log_kind, repo, rec, regexp_replace(regexp_replace(replace(f, chr(92), '/'), '/+', '/', 'g'), '^[.]/', '') AS file
  FROM (SELECT log_kind, repo, rec, unnest(files) AS f FROM l WHERE repo IS NOT NULL) WHERE f IS NOT NULL
), n AS (SELECT log_kind, repo, count(DISTINCT rec) AS n FROM f GROUP BY ALL),
c AS (SELECT log_kind, repo, file, count(*) AS n_f FROM f GROUP BY ALL),
p AS (
  SELECT a.log_kind, a.repo, a.file AS file_a, b.file AS file_b, count(*) AS n_ab
  FROM f a JOIN f b ON a.log_kind = b.log_kind AND a.repo = b.repo AND a.rec = b.rec AND a.file < b.file GROUP BY ALL
)
SELECT p.log_kind, p.repo, p.file_a, p.file_b FROM p JOIN n USING (log_kind, repo)
JOIN c a ON a.log_kind = p.log_kind AND a.repo = p.repo AND a.file = file_a
JOIN c b ON b.log_kind = p.log_kind AND b.repo = p.repo AND b.file = file_b
WHERE n_ab >= 5 AND n_ab * n.n >= 3 * a.n_f * b.n_f
"""

def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte_bpe_50k ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share ten or more consecutive words with an evaluation item."""
    items = table(spark, sf_dir, "eval_items")
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", items, "item_id", "text", run=10).select("doc_id", "item_id")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_segments(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "lang_samples"), label="lang")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages with a full sentence in a document that its label does not name."""
    return missing_languages(_segments(spark, sf_dir))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, with a confidence and a verdict on its label."""
    return document_languages(table(spark, sf_dir, "documents"), _segments(spark, sf_dir), "doc_id", "lang")


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each stretch of prose."""
    return _segments(spark, sf_dir).drop("label")


P8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d WHERE len(w) >= 10)),
ig AS (SELECT item_id, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i WHERE len(w) >= 10))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

_ALL = {
    "p2_found": (p2_found, None),
    "p2_rates": (p2_rates, None),
    "p3_found": (p3_found, P3_SQL),
    "p4_found": (p4_found, None),
    "p4_labels": (p4_labels, None),
    "p5_found": (p5_found, None),
    "p5_restored": (p5_restored, None),
    "p6_found": (p6_found, P6_SQL),
    "p7_ids": (p7_ids, None),
    "p8_found": (p8_found, P8_SQL),
    "p9_found": (p9_found, None),
    "p9_documents": (p9_documents, None),
    "p9_segments": (p9_segments, None),
}


def queries() -> dict:
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
