"""Queries of the two general data problems: time intervals (p4) and timestamps (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clock import clock_seconds, day_number
from tidemark.operators.instants import resolve_instants
from tidemark.operators.intervals import merge_intervals
from tidemark.registry import Registry
from tidemark.runtime import table

registry = Registry()

_CLOCK_SQL = """
raw AS (SELECT subject, granularity, CASE WHEN regexp_full_match(date, '(?i)day[0-9]+') THEN TRY_CAST(substr(date, 4) AS INTEGER) END AS day,
  CASE WHEN regexp_full_match(start_time, '[0-9]{1,8}') THEN lpad(start_time, 8, '0') END AS s, CASE WHEN regexp_full_match(end_time, '[0-9]{1,8}') THEN lpad(end_time, 8, '0') END AS e FROM captions_a),
parts AS (SELECT subject, granularity, day, CAST(s[1:2] AS INTEGER) AS sh, CAST(s[3:4] AS INTEGER) AS sm, CAST(s[5:6] AS INTEGER) AS ss, CAST(e[1:2] AS INTEGER) AS eh, CAST(e[3:4] AS INTEGER) AS em, CAST(e[5:6] AS INTEGER) AS es FROM raw),
usable AS (SELECT DISTINCT subject, day, sh * 3600 + sm * 60 + ss AS a, eh * 3600 + em * 60 + es AS b FROM parts
  WHERE subject IS NOT NULL AND day IS NOT NULL AND sh < 24 AND sm < 60 AND ss < 60 AND eh < 24 AND em < 60 AND es < 60 AND sh * 3600 + sm * 60 + ss < eh * 3600 + em * 60 + es)
"""
_PERIODS_SQL = f"""WITH {_CLOCK_SQL},
seen AS (SELECT *, max(b) OVER (PARTITION BY subject, day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM usable),
numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY subject, day ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM seen),
periods AS (SELECT subject, day, k, min(a) AS a, max(b) AS b FROM numbered GROUP BY subject, day, k),
gaps AS (SELECT subject, day, b AS g, lead(a) OVER (PARTITION BY subject, day ORDER BY a) AS h FROM periods),
found AS (SELECT subject, day, 'period' AS kind, a AS start_s, b AS end_s FROM periods UNION ALL SELECT subject, day, 'gap', g, h FROM gaps WHERE h IS NOT NULL)
"""


def caption_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "captions_a")
    return c.where(F.col("subject").isNotNull()).select("subject", day_number(F.col("date")).alias("day"), clock_seconds(F.col("start_time")).alias("a"), clock_seconds(F.col("end_time")).alias("b")).where(F.col("day").isNotNull())


def caption_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge_intervals(caption_spans(spark, sf_dir), ["subject", "day"], "a", "b")
    return found.select("subject", "day", "kind", F.col("start").cast("int").alias("start_s"), F.col("end").cast("int").alias("end_s"))


@registry.add("p4_found", f"{_PERIODS_SQL} SELECT subject, day, kind, CAST(start_s AS INTEGER) AS start_s, CAST(end_s AS INTEGER) AS end_s FROM found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caption_periods(spark, sf_dir)


@registry.add(
    "p4_coverage",
    f"{_PERIODS_SQL} SELECT subject, CAST(count(DISTINCT day) AS BIGINT) AS days, CAST(sum(CASE WHEN kind = 'period' THEN 1 ELSE 0 END) AS BIGINT) AS periods, CAST(sum(CASE WHEN kind = 'gap' THEN 1 ELSE 0 END) AS BIGINT) AS gaps, "
    "CAST(sum(CASE WHEN kind = 'period' THEN end_s - start_s ELSE 0 END) AS BIGINT) AS covered_s, CAST(sum(CASE WHEN kind = 'gap' THEN end_s - start_s ELSE 0 END) AS BIGINT) AS gap_s FROM found GROUP BY subject",
)
def p4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per subject: days, periods, gaps and the seconds in each."""
    found, is_period = caption_periods(spark, sf_dir), F.col("kind") == "period"
    length = F.col("end_s") - F.col("start_s")
    return found.groupBy("subject").agg(
        F.countDistinct("day").alias("days"), F.sum(is_period.cast("long")).alias("periods"), F.sum((~is_period).cast("long")).alias("gaps"),
        F.sum(F.when(is_period, length).otherwise(0)).cast("long").alias("covered_s"), F.sum(F.when(is_period, 0).otherwise(length)).cast("long").alias("gap_s"),
    )


def log_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_instants(table(spark, sf_dir, "query_log"), table(spark, sf_dir, "devices"), row_id="log_id", source="device_id", date=F.col("query_time.date"), time=F.col("query_time.time"))


@registry.add("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an id whose stamps disagree does not fix one instant; utc_s is NULL unless the status is fixed
    found = log_instants(spark, sf_dir).groupBy("log_id").agg(F.min("utc_s").alias("utc_s"), F.max("utc_s").alias("last"))
    return found.where(F.col("utc_s") == F.col("last")).select("log_id", "utc_s")


@registry.add("p6_report")
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stamps came out how, by spelling."""
    return log_instants(spark, sf_dir).groupBy("status", "spelling").agg(F.count("*").alias("n"))
