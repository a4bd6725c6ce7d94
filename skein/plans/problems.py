"""Core problem queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..operators.intervals import merge_intervals


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods in which each agent held some lock, and the gaps between them."""
    locks = table(spark, sf_dir, "swarm_locks").filter("expires_at > created_at and not isnan(expires_at)")
    spread = F.xxhash64("lock_id", "recorded_at")
    ms = lambda c: F.round(F.col(c) * 1000)
    out = merge_intervals(locks, F.lower(F.trim("agent_id")), ms("created_at"), ms("expires_at"), spread)
    return out.select(F.col("entity").alias("agent_id"), "kind", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


P1_SQL = """
WITH l AS (
  SELECT lower(trim(agent_id)) AS agent_id, CAST(round(created_at * 1000) AS BIGINT) AS s, CAST(round(expires_at * 1000) AS BIGINT) AS e
  FROM swarm_locks WHERE agent_id IS NOT NULL AND created_at IS NOT NULL AND expires_at IS NOT NULL AND expires_at > created_at
), m AS (
  SELECT *, max(e) OVER (PARTITION BY agent_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l
), i AS (
  SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY agent_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m
), p AS (
  SELECT agent_id, island, min(s) AS start_ms, max(e) AS end_ms FROM i GROUP BY agent_id, island
), g AS (
  SELECT agent_id, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY agent_id ORDER BY start_ms) AS end_ms FROM p
)
SELECT agent_id, 'period' AS kind, start_ms, end_ms FROM p
UNION ALL
SELECT agent_id, 'gap' AS kind, start_ms, end_ms FROM g WHERE end_ms IS NOT NULL
"""

QUERIES = {"p1_found": (p1_found, P1_SQL)}
