"""Shares and short counts on ties, which binary fractions miss."""

from pyspark.sql import functions as F

from threadloom.functions import scalars as S
from threadloom.operators import reports


def test_percent_on_ties(spark):
    rows = spark.range(1, 5001).select("id", S.percent(F.col("id"), F.lit(5000)).alias("p")).collect()
    assert all(r.p == max(1, (r.id + 25) // 50) for r in rows)
    assert all(reports.percent(n, 5000) == max(1, (n + 25) // 50) for n in range(1, 5001))


def test_usage_on_ties(spark):
    from threadloom.queries import CONFIG

    rows = spark.range(55_500, 100_000, 1000).select(F.col("id").alias("token_count"), *[F.lit(n).cast("long").alias(c) for c, n in (("t1", 9000), ("t2", 0), ("t3", 0), ("baseline", 100), ("last_shown", 0), ("shown2", 0), ("shown3", 0))])
    found = reports.explain_nudge(rows, CONFIG).select("token_count", "reason").collect()
    assert len(found) == 45 and all(r.reason == f"tier 1: usage {(r.token_count + 500) // 1000}%" for r in found)


def test_short_counts_of_both_renderers(spark):
    from threadloom.operators.coverage import short_count

    rows = spark.range(12_000).select("id", short_count(F.col("id")).alias("short")).collect()
    assert all(reports.format_short(r.id) == r.short for r in rows)
    assert reports.format_short(1150) == "1.2K"
