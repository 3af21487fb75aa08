"""Data quality of a corpus: findings from one row of counters, and the grade they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILURE_RATE, VALIDATION_RATE, FEW_TABLES = 0.05, 0.7, 5


def validation_rate(checked: Column, untrusted: Column) -> Column:
    """Share of the checked tables that weren't found untrustworthy; 1 where none was checked."""
    return F.when(checked > 0, (checked - untrusted) / checked).otherwise(F.lit(1.0))


def findings(counters: DataFrame) -> DataFrame:
    """(finding, level) of a row with files, failed, untranscribed_pages, tables, checked, untrusted; level is error, warn or info."""
    rate = validation_rate(F.col("checked"), F.col("untrusted"))
    failed = F.try_divide("failed", "files")
    whole = (F.col("checked") >= FEW_TABLES) | (F.col("checked") == F.col("tables"))
    checks = {
        "untranscribed_pages": F.when(F.col("untranscribed_pages") > 0, "error"),
        "parse_failures": F.when(failed > FAILURE_RATE, "error").when(F.col("failed") > 0, "warn"),
        "validation_rate": F.when((F.col("checked") > 0) & (rate < VALIDATION_RATE), F.when(whole, "error").otherwise("info")),
        "untrusted_tables": F.when((F.col("untrusted") > 0) & (rate >= VALIDATION_RATE), "warn"),
        "unchecked_tables": F.when(F.col("tables") > F.col("checked"), "info"),
    }
    every = F.array(*[F.struct(F.lit(n).alias("finding"), c.alias("level")) for n, c in checks.items()])
    return counters.select(F.explode(every).alias("f")).select("f.*").where("level is not null")


def grade(found: DataFrame) -> DataFrame:
    """``grade``: blocked with any error, degraded with any warning, else ok."""
    g = found.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"))
    return g.withColumn("grade", F.when(F.col("errors") > 0, "blocked").when(F.col("warnings") > 0, "degraded").otherwise("ok"))
