"""From grids of text to typed tables: header, names, types, row kinds, cells and the manifest, for any number of tables at once.

A grid is in long form: (doc_id, table_name, row_idx from 0, col_idx, raw, flagged). All steps are aggregations by table
and column and joins on them, so a table of any length spreads over tasks. The number of a cell stands beside its raw
text (a shadow: nothing of the text is lost), with the row's kind and the place it came from.

Defined cases: null tokens are cells without number; a grid without rows is no table; columns without a header text are
named by their place; columns without values are TEXT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.functions import numeric as N
from folioquarry.operators import pipeline, tables


def grid_rows(parsed: DataFrame, doc_id, path: str = "path") -> DataFrame:
    """Long form of the grids of parsed files (``grids``): tables are named by their document and their number in it."""
    g = parsed.select(doc_id.alias("doc_id"), F.posexplode("grids").alias("n", "g"))
    name = F.concat(F.lit("t_"), F.col("doc_id").cast("string"), F.lit("_"), (F.col("n") + 1).cast("string"))
    rows = g.select("doc_id", name.alias("table_name"), F.col("g.caption").alias("caption"), F.posexplode("g.rows").alias("row_idx", "r"))
    return rows.select("doc_id", "table_name", "caption", "row_idx", F.posexplode("r").alias("col_idx", "raw")).withColumn("flagged", F.lit(False))


def built(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns, cells): one row per column with its name, style, type and what may be summed, and one per cell with its number, row kind and place."""
    heads = pipeline.infer_headers(grid).select("table_name", "n_header")
    g = grid.join(heads, "table_name")
    head = g.groupBy("table_name", "col_idx", "n_header").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("row_idx") < F.col("n_header")) & (F.trim(F.coalesce("raw", F.lit(""))) != ""), F.struct("row_idx", F.trim("raw").alias("t"))))), lambda x: x["t"]), " ").alias("header"))  # a column's header rows
    head = tables.column_names(head.withColumn("raw", F.when(F.col("header") != "", F.col("header")).otherwise(F.concat(F.lit("col "), (F.col("col_idx") + 1).cast("string")))))
    data = g.where("row_idx >= n_header")
    types = tables.column_types(data, "table_name", "col_idx")
    columns = head.join(types, ["table_name", "col_idx"], "left").select("table_name", "col_idx", "name", "header", F.coalesce("sql_type", F.lit("TEXT")).alias("sql_type"), "style", F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
    columns = columns.withColumn("additive", (F.col("sql_type") != "TEXT") & ~tables.non_additive(F.col("header")))
    typed = data.join(columns.select("table_name", "col_idx", "name", "style", "sql_type"), ["table_name", "col_idx"])
    value = ~N.is_null_cell(F.col("raw"))
    kinds = data.groupBy("table_name", "row_idx").agg(F.max(F.when(F.col("col_idx") == 0, F.col("raw"))).alias("label"), F.count_if((F.col("col_idx") > 0) & value).alias("others"))
    kinds = kinds.select("table_name", "row_idx", tables.row_kind(F.col("label"), F.col("others")).alias("row_kind"))
    number = F.when(F.col("sql_type") != "TEXT", N.coerce_cell(F.col("raw"), F.col("style")))
    keep = [c for c in ("doc_id", "page") if c in grid.columns]
    cells = typed.join(kinds, ["table_name", "row_idx"]).where(value).select(*keep, "table_name", "row_idx", "col_idx", F.col("name").alias("col_name"), "raw", F.lower(F.trim("raw")).alias("text_value"), number.alias("num_value"), "row_kind")
    return columns, cells


def manifest(grid: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per table: document, caption, rows, columns with their types."""
    per = grid.groupBy("table_name").agg(F.min("doc_id").alias("doc_id"), F.min("caption").alias("caption"), F.count_distinct("row_idx").alias("grid_rows"))
    cols = columns.groupBy("table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "name", "sql_type"))), lambda x: F.struct(x["name"].alias("name"), x["sql_type"].alias("sql_type"))).alias("columns"))  # a table's columns
    return per.join(cols, "table_name")
