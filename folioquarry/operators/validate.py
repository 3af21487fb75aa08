"""Checks of extracted tables: totals against their items, structure, and the status that follows."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REL_TOL, ABS_TOL = 0.005, 1.0
WEIGHTS = {"arithmetic": 0.5, "structural": 0.3, "prose": 0.2}


def within(found, expected):
    """Whether a total agrees with its items: within half a percent of what is expected, or 1."""
    return F.abs(found - expected) <= F.greatest(F.abs(expected) * REL_TOL, F.lit(ABS_TOL))


def flat_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, row_kind, num_value) of tables with one total each: ``items``, ``item_sum``, ``total``, ``passed`` (null below two items)."""
    g = rows.groupBy(*keys).agg(
        F.count_if((F.col("row_kind") == "data") & F.col("num_value").isNotNull()).alias("items"),
        F.round(F.sum(F.when(F.col("row_kind") == "data", F.col("num_value").cast("decimal(38,6)"))).cast("double"), 6).alias("item_sum"),
        F.max(F.when(F.col("row_kind") == "total", F.col("num_value"))).alias("total"),
    )
    return g.withColumn("passed", F.when((F.col("items") >= 2) & F.col("total").isNotNull(), within(F.col("total"), F.col("item_sum"))))


def section_checks(rows: Iterable[tuple[str, str, float | None]]) -> list[tuple[int, str, float, float, bool]]:
    """Checks of (row_kind, label, value) rows in order: (row, kind, found, expected, passed).

    A stack of open scopes: headings open one, a subtotal closes the innermost with its items, a total closes all that is
    open. A closed scope counts as one item of the scope about it. ``Grand total`` closes the table: it may stand for
    the closed totals. Scopes with fewer than two values are recorded as not applicable and not checked.
    """
    out: list[tuple[int, str, float, float, bool]] = []
    stack: list[list[float]] = [[]]
    closed: list[float] = []
    for k, (kind, label, value) in enumerate(rows):
        if kind == "section":
            if stack[-1]:  # items before a heading belong to the scope about it
                stack.append([])
            elif len(stack) == 1:
                stack.append([])
        elif kind == "data":
            if value is not None:
                stack[-1].append(value)
        elif kind in ("subtotal", "total") and value is not None:
            grand = "grand" in (label or "").lower()
            if grand and closed:
                items = closed + [x for s in stack for x in s]
                closed, stack = [], [[]]
            elif kind == "subtotal":
                items = stack.pop() if len(stack) > 1 else stack[0]
                if not stack:
                    stack = [[]]
                if items is stack[0]:
                    stack[0] = []
                stack[0].append(value)
            else:
                items = [x for s in stack for x in s]
                stack = [[]]
                closed.append(value)
            if len(items) >= 2:
                expected = float(sum(items))
                out.append((k, kind, value, expected, abs(value - expected) <= max(REL_TOL * abs(expected), ABS_TOL)))
    return out


def nested_totals(rows: DataFrame, key: str = "table_name", order: str = "row_idx") -> DataFrame:
    """``section_checks`` of every table; a table's rows are one bounded group."""
    kind = dict(rows.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        got = section_checks(zip(pdf["row_kind"], pdf["label"], [None if pd.isna(v) else float(v) for v in pdf["num_value"]]))
        idx = pdf[order].to_numpy()
        return pd.DataFrame([(pdf[key].iloc[0], idx[k], kd, f, e, p) for k, kd, f, e, p in got], columns=[key, "row_idx", "kind", "found", "expected", "passed"])

    return rows.select(key, order, "row_kind", "label", "num_value").groupBy(key).applyInPandas(run, f"{key} {kind}, row_idx bigint, kind string, found double, expected double, passed boolean")


def structural(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Structural checks by table: no row wider than the header, no named leading column without values, no header row in the body.

    ``tables``: table_name, header (array); ``cells``: table_name, row_idx, col_idx, raw (null: no value).
    """
    names = tables.select("table_name", F.posexplode("header").alias("col_idx", "name"))
    size = tables.select("table_name", F.size("header").alias("n_cols"))
    width = cells.groupBy("table_name").agg((F.max("col_idx") + 1).alias("widest"))
    filled = cells.where("raw is not null").groupBy("table_name").agg(F.min("col_idx").alias("first_filled"))
    same = cells.join(names, ["table_name", "col_idx"]).groupBy("table_name", "row_idx").agg(F.count_if(F.lower(F.trim("raw")) == F.lower(F.trim("name"))).alias("same")).join(size, "table_name")
    repeats = same.where("same = n_cols").groupBy("table_name").agg(F.count(F.lit(1)).alias("header_repeats"))
    t = size.join(width, "table_name", "left").join(filled, "table_name", "left").join(repeats, "table_name", "left")
    return t.select(
        "table_name", (F.coalesce("widest", F.lit(0)) <= F.col("n_cols")).alias("grid_width"), (F.coalesce("first_filled", F.lit(0)) == 0).alias("no_empty_leading_columns"), F.coalesce("header_repeats", F.lit(0)).alias("header_repeats")
    ).withColumn("blocked", ~(F.col("grid_width") & F.col("no_empty_leading_columns") & (F.col("header_repeats") == 0)))


def monotonic(rows: DataFrame, key: str, order: str, value: str, width: int = 1 << 16) -> DataFrame:
    """Whether the values of each key stand in ascending or descending order of a whole number.

    Slots of the order are judged apart; between slots the last value of one meets the first of the next, so a key with
    a third of all rows isn't sorted in one task. Null values are passed over.
    """
    d = rows.where(F.col(value).isNotNull()).withColumn("_s", F.floor(F.col(order) / width))
    before = F.lag(value).over(Window.partitionBy(key, "_s").orderBy(order))
    d = d.select(key, "_s", F.col(order).alias("_o"), F.col(value).alias("_v"), before.alias("_p"))
    up, down = F.coalesce(F.col("_p") <= F.col("_v"), F.lit(True)), F.coalesce(F.col("_p") >= F.col("_v"), F.lit(True))
    s = d.groupBy(key, "_s").agg(F.bool_and(up).alias("_up"), F.bool_and(down).alias("_down"), F.min_by("_v", "_o").alias("_first"), F.max_by("_v", "_o").alias("_last"), F.count(F.lit(1)).alias("_c"))
    s = s.withColumn("_p", F.lag("_last").over(Window.partitionBy(key).orderBy("_s")))
    rise, fall = F.col("_up") & F.coalesce(F.col("_p") <= F.col("_first"), F.lit(True)), F.col("_down") & F.coalesce(F.col("_p") >= F.col("_first"), F.lit(True))
    return s.groupBy(key).agg((F.bool_and(rise) | F.bool_and(fall)).alias("monotonic"), F.sum("_c").alias("n"))


def confidence(arithmetic, structural, prose=None):
    """Weighted mean of the passed shares (null: not applicable); 1 where none applies."""
    parts = [(arithmetic, WEIGHTS["arithmetic"]), (structural, WEIGHTS["structural"])] + ([(prose, WEIGHTS["prose"])] if prose is not None else [])
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    low = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return F.when(low > 0, top / low).otherwise(F.lit(1.0))


def table_status(blocked, evidence, conf, fallback=None):
    """untrusted, unchecked, trusted or reextracted."""
    good = F.when(fallback, "reextracted").otherwise("trusted") if fallback is not None else F.lit("trusted")
    return F.when(blocked, "untrusted").when(~evidence, "unchecked").when(conf < 0.7, "untrusted").otherwise(good)


def prose_checks(cells: DataFrame, prose: DataFrame, says, sample: int = 3) -> DataFrame:
    """``sample`` numeric cells of each table (chosen by hash) held against text near it by an injected function (raw value, text) -> True, False or None."""
    rn = F.row_number().over(Window.partitionBy("table_name").orderBy(F.xxhash64("table_name", "row_idx", "col_idx"), "row_idx", "col_idx"))
    few = cells.where("num_value is not null").withColumn("rn", rn).where(F.col("rn") <= sample)
    j = few.join(prose, "table_name").select("table_name", "row_idx", "col_idx", "raw", "text")
    kinds = dict(j.dtypes)

    def run(batches):
        for pdf in batches:
            out = pdf[["table_name", "row_idx", "col_idx"]].copy()
            out["agrees"] = pd.Series([says(r, t) for r, t in zip(pdf["raw"], pdf["text"])], dtype="boolean", index=pdf.index)
            yield out

    return j.mapInPandas(run, f"table_name string, row_idx {kinds['row_idx']}, col_idx {kinds['col_idx']}, agrees boolean")


def choose_extraction(candidates: DataFrame) -> DataFrame:
    """Of each table's extractions (table_name, attempt, blocked, confidence) the one without structural faults, then of most confidence, then the earliest."""
    rank = F.struct((~F.col("blocked")).cast("int").alias("a"), F.col("confidence").alias("b"), (-F.col("attempt")).alias("c"))
    return candidates.groupBy("table_name").agg(F.max_by("attempt", rank).alias("attempt"), F.max_by("confidence", rank).alias("confidence"))


def style_rollback(cells: DataFrame, *keys: str) -> DataFrame:
    """Both readings of each column's total check (keys, row_kind, raw): the opposite style is kept only where it mends a failing column."""
    from folioquarry.functions import numeric as N

    us, eu = N.style_votes(F.col("raw"))
    style = cells.groupBy(*keys).agg(N.pick_style(us, eu).alias("style"))
    out = []
    for s in ("us", "eu"):
        t = flat_totals(cells.withColumn("num_value", N.coerce_cell(F.col("raw"), s)), *keys)
        out.append(t.select(*keys, F.col("passed").alias(f"passed_{s}")))
    j = style.join(out[0], list(keys)).join(out[1], list(keys))
    first, second = F.when(F.col("style") == "us", F.col("passed_us")).otherwise(F.col("passed_eu")), F.when(F.col("style") == "us", F.col("passed_eu")).otherwise(F.col("passed_us"))
    swap = F.coalesce(~first & second, F.lit(False))
    return j.select(*keys, "style", F.when(swap, F.when(F.col("style") == "us", "eu").otherwise("us")).otherwise(F.col("style")).alias("kept_style"), F.when(swap, second).otherwise(first).alias("passed"))
