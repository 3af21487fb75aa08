"""Effective-dated lookups, windows over time and numbering within keys.

A key may hold a third of all rows, so nothing here sorts a whole key in one task: rows are cut into slots of time (or
of an ordering number), each slot is a partition of its own, and what has to pass from slot to slot (the last value, the
last time, a count) is pre-aggregated to one row a slot and carried over those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def ticks(df: DataFrame, column: str) -> Column:
    """A time as microseconds, a number as it is."""
    kind = dict(df.dtypes)[column]
    return F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith("timestamp") or kind == "date" else F.col(column).cast("bigint")


def _before(slots: DataFrame, key: str, value: Column) -> Column:
    return value.over(Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))


def numbered(df: DataFrame, key: str, order: str, out: str = "n", width: int = 1 << 16) -> DataFrame:
    """Row numbers from 1 within each key by a whole-number order that is unique within the key."""
    d = df.withColumn("_slot", F.floor(F.col(order) / width))
    s = d.groupBy(key, "_slot").agg(F.count(F.lit(1)).alias("_c"))
    s = s.select(F.col(key).alias("_k"), F.col("_slot").alias("_s"), F.coalesce(F.sum("_c").over(Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    rn = F.row_number().over(Window.partitionBy(key, "_slot").orderBy(order))
    j = d.withColumn("_rn", rn).join(s, F.col(key).eqNullSafe(F.col("_k")) & F.col("_slot").eqNullSafe(F.col("_s")))
    return j.withColumn(out, F.col("_rn") + F.col("_b")).drop("_slot", "_rn", "_k", "_s", "_b")


def effective(facts: DataFrame, rates: DataFrame, key: str, at: str, since: str, value: str, width: int = 30 * DAY) -> DataFrame:
    """Each fact with the value in force at its time (``in_force``): the last one of its key that began at or before it.

    Facts and rates lie in one stream; within a slot the last rate seen carries on, and each slot starts with the last
    rate of the slots before it. Null before the first rate. A rate that begins at a fact's very time holds for it; of
    two that begin together the greater value holds. Facts without key or time get null.
    """
    kind = dict(rates.dtypes)[value]
    f = facts.select("*", F.col(key).alias("_key"), ticks(facts, at).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast(kind).alias("_v"))
    r = rates.where(F.col(key).isNotNull() & F.col(since).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("_key"), ticks(rates, since).alias("_t"), F.lit(0).alias("_o"), F.col(value).alias("_v"))
    u = f.unionByName(r, allowMissingColumns=True).withColumn("_slot", F.floor(F.col("_t") / width))
    s = u.groupBy("_key", "_slot").agg(F.max_by("_v", F.when(F.col("_o") == 0, F.struct("_t", "_v"))).alias("_last"))
    s = s.withColumn("_carry", _before(s, "_key", F.last("_last", ignorenulls=True))).select("_key", "_slot", "_carry")
    w = Window.partitionBy("_key", "_slot").orderBy("_t", "_o", F.asc_nulls_last("_v")).rowsBetween(Window.unboundedPreceding, 0)
    seen = u.withColumn("_seen", F.last("_v", ignorenulls=True).over(w)).where("_o = 1")
    j = seen.join(s, ["_key", "_slot"], "left").withColumn("in_force", F.coalesce("_seen", "_carry"))
    return j.select(*facts.columns, "in_force")


def sliding_count(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Events of the key within the ``seconds`` up to each event, itself and those of its second included (``in_window``).

    A slot is as long as the window, so an event is needed in its own slot and, as context, in the next.
    """
    e = events.withColumn("_s", F.unix_timestamp(F.col(at).cast("timestamp")))
    slot = F.floor(F.col("_s") / seconds)
    e = e.select("*", F.explode(F.array(F.struct(slot.alias("p"), F.lit(True).alias("own")), F.struct((slot + 1).alias("p"), F.lit(False).alias("own")))).alias("_z"))
    w = Window.partitionBy(key, "_z.p").orderBy("_s").rangeBetween(-seconds, 0)
    return e.withColumn("in_window", F.count(F.lit(1)).over(w)).where("_z.own").drop("_s", "_z")


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int, width: int = 7 * DAY) -> DataFrame:
    """Sessions per key, numbered in order: a silence longer than the gap begins another. Events without time are left out.

    Within a slot the silence before an event is seen directly; for a slot's first event it is the time since the last
    event of the slots before. Sessions are counted the same way, by slot and then within it.
    """
    e = events.where(F.col(at).isNotNull()).select(F.col(key), F.col(at), ticks(events, at).alias("_t")).withColumn("_slot", F.floor(F.col("_t") / width))
    s = e.groupBy(key, "_slot").agg(F.max("_t").alias("_top"))
    s = s.select(F.col(key).alias("_k"), F.col("_slot").alias("_sl"), _before(s, key, F.max("_top")).alias("_prev"))
    j = e.join(s, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slot") == F.col("_sl"))).drop("_k", "_sl")
    w = Window.partitionBy(key, "_slot").orderBy("_t")
    silence = F.floor(F.col("_t") / 1_000_000) - F.floor(F.coalesce(F.lag("_t").over(w), F.col("_prev")) / 1_000_000)
    j = j.withColumn("_n", F.when(F.coalesce(silence <= gap_seconds, F.lit(False)), 0).otherwise(1))
    c = j.groupBy(key, "_slot").agg(F.sum("_n").alias("_c"))
    c = c.select(F.col(key).alias("_k"), F.col("_slot").alias("_sl"), F.coalesce(_before(c, key, F.sum("_c")), F.lit(0)).alias("_b"))
    j = j.withColumn("_run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    j = j.join(c, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slot") == F.col("_sl"))).withColumn("session", F.col("_run") + F.col("_b"))
    return j.groupBy(key, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("events"))
