"""Typed tables and the cell index over them.

Tables stay in long form: one row per cell (``table_name``, ``row_idx``, ``col_idx``, ``raw``), so that any number of
tables of any shape is one DataFrame; a typed view of one table is a projection. Addressing is (table_name, row_idx,
col name) throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.functions import numeric as N
from folioquarry.functions.text import identifier

# Labels of total rows, footnote marks.
TOTAL = r"(?i)^(?:grand\s+)?(?:total|subtotal|sub-total|sum)\b|\b(?:total|subtotal)\s*$"
SUBTOTAL = r"(?i)\bsubtotal\b|^sub-total"
# A label is prose where it has a finite verb: a total row names what it totals.
VERBS = frozenset("am are be been being can could did do does had has have includes include is may might must shall should was were will would exceed exceeds exceeded falls remains".split())
FOOTNOTE = r"^\s*(\*|†|‡|§|\(\d+\)|\[\d+\]|[¹²³⁴⁵⁶⁷⁸⁹⁰])"
# A header's values don't add up where one of its words says that they are quotients or levels, or where "per" stands in it;
# a balance is a level if the header says of which moment. A header is an identifier where every word of it is one of these.
QUOTIENTS = frozenset("average avg mean median weighted ratio rate rates margin growth yield percent percentage pct eps remaining share% change% index".split())
MOMENTS = frozenset("opening closing beginning ending end start".split())
NAMING = frozenset("id ids no nr num number code zip postal line row record account invoice exhibit reference ref serial year date".split())
COVERAGE = 0.95


def column_names(headers: DataFrame, table: str = "table_name", idx: str = "col_idx", raw: str = "raw") -> DataFrame:
    """Column names from header texts: identifiers, the second of a name gets ``_2`` and so on."""
    h = headers.withColumn("_b", identifier(F.col(raw)))
    n = F.row_number().over(Window.partitionBy(table, "_b").orderBy(idx))
    return h.withColumn("name", F.when(n == 1, F.col("_b")).otherwise(F.concat("_b", F.lit("_"), n.cast("string")))).drop("_b")


def to_cells(df: DataFrame, table_name: str, key: str, doc_id=None) -> DataFrame:
    """The cell index of a relational table: one row per cell that isn't null, text lower-cased, numbers apart.

    ``row_idx`` is the key itself where it is a whole number of the caller's; nothing is numbered by a global sort.
    """
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    cols = [c for c in df.columns]
    kinds = dict(df.dtypes)
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("col_name"),
                F.lower(F.col(c).cast("string")).alias("text_value"),
                (F.col(c).cast("double") if kinds[c] in numeric or kinds[c].startswith("decimal") else F.lit(None).cast("double")).alias("num_value"),
            )
            for c in cols
        ]
    )
    return df.select(F.lit(table_name).alias("table_name"), F.col(key).cast("bigint").alias("row_idx"), F.explode(pairs).alias("c")).where("c.text_value is not null").select("table_name", "row_idx", "c.col_name", "c.text_value", "c.num_value")


def zone_maps(cells: DataFrame, *keys: str) -> DataFrame:
    """Per table and column: rows, nulls, numeric bounds, distinct texts and the least and greatest of them (of 40 characters)."""
    keys = keys or ("table_name", "col_name")
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("text_value").isNull()).alias("n_null"), F.min("num_value").alias("min_value"), F.max("num_value").alias("max_value"),
        F.count_distinct("text_value").alias("n_distinct"), F.min(F.substring("text_value", 1, 40)).alias("least_text"), F.max(F.substring("text_value", 1, 40)).alias("greatest_text"),
    )


def column_types(cells: DataFrame, *keys: str, value: str = "raw") -> DataFrame:
    """Style, coverage and SQL type of each column of raw cells, in one aggregation over both readings.

    A column is numeric where at least 95% of its cells that aren't null tokens are numbers by its style; INTEGER where
    all of those are whole, else REAL; TEXT otherwise and for columns without values.
    """
    c, null = F.col(value), N.is_null_cell(F.col(value))
    us, eu = N.style_votes(c)
    vu, ve = N.coerce_cell(c, "us"), N.coerce_cell(c, "eu")
    g = cells.groupBy(*keys).agg(
        us.alias("_us"), eu.alias("_eu"), F.count_if(~null).alias("n_values"),
        F.count_if(vu.isNotNull()).alias("_nu"), F.count_if(ve.isNotNull()).alias("_ne"),
        F.count_if(vu != F.floor(vu)).alias("_fu"), F.count_if(ve != F.floor(ve)).alias("_fe"),
    )
    style = N.pick_style(F.col("_us"), F.col("_eu"))
    n, frac = F.when(style == "eu", F.col("_ne")).otherwise(F.col("_nu")), F.when(style == "eu", F.col("_fe")).otherwise(F.col("_fu"))
    coverage = F.when(F.col("n_values") > 0, n / F.col("n_values")).otherwise(F.lit(0.0))
    return g.select(*keys, "n_values", style.alias("style"), coverage.alias("coverage"), F.when((F.col("n_values") == 0) | (coverage < COVERAGE), "TEXT").when(frac == 0, "INTEGER").otherwise("REAL").alias("sql_type"))


def typed_cells(cells: DataFrame, types: DataFrame, *keys: str, value: str = "raw") -> DataFrame:
    """Raw cells with the number their column's style gives; the raw text stays beside it."""
    t = types.select(*keys, "style", "sql_type")
    return cells.join(t, list(keys)).withColumn("num_value", F.when(F.col("sql_type") != "TEXT", N.coerce_cell(F.col(value), F.col("style")))).drop("style")


def row_kind(label, others):
    """total, subtotal, footnote, section or data of a row by its label and how many of its other cells have a value."""
    t = F.trim(F.coalesce(label, F.lit("")))
    bare = F.regexp_replace(t, r"^[:() ]+|[:() ]+$", "")
    total = (F.size(F.split(bare, r"\s+")) <= 8) & ~F.arrays_overlap(_words(bare), F.array(*[F.lit(v) for v in sorted(VERBS)])) & bare.rlike(TOTAL)
    return F.when(total & bare.rlike(SUBTOTAL), "subtotal").when(total, "total").when((t != "") & t.rlike(FOOTNOTE) & (others == 0), "footnote").when((t != "") & (others == 0), "section").otherwise("data")


def _words(c):
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}%]+"), F.lit(0))


def non_additive(header):
    """Whether a column's header says that its values don't add up."""
    w = _words(header)
    has = lambda words: F.arrays_overlap(w, F.array(*[F.lit(x) for x in sorted(words)]))
    level = has({"balance", "balances"}) & has(MOMENTS)
    naming = (F.size(w) > 0) & F.forall(w, lambda x: x.isin(*sorted(NAMING)))
    unit_price = has({"price"}) & has({"unit"})
    return has(QUOTIENTS) | has({"per"}) | level | naming | unit_price | (has({"yet", "still"}) & has({"purchased"}))


def merge_multipage(parts: DataFrame) -> DataFrame:
    """Parts of tables (doc_id, part, page, n_cols, header, caption) numbered by the table they continue.

    A part continues the one before it in its document if header, width and a caption that isn't empty are equal
    (a trailing ``continued`` doesn't matter) and it stands on the next page.
    """
    caption = F.trim(F.regexp_replace(F.lower(F.coalesce("caption", F.lit(""))), r"[\s(,:-]*\bcont(?:inued|'d|\.)?[\s).]*$", ""))
    w = Window.partitionBy("doc_id").orderBy("page", "part")
    p = parts.withColumn("_c", caption)
    same = (F.col("_c") != "") & (F.lag("_c").over(w) == F.col("_c")) & (F.lag("header").over(w) == F.col("header")) & (F.lag("n_cols").over(w) == F.col("n_cols")) & (F.lag("page").over(w) + 1 == F.col("page"))
    p = p.withColumn("_n", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    return p.withColumn("table_no", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c", "_n")


def multiset_overlap(a: DataFrame, b: DataFrame, key: str = "table_name", value: str = "raw") -> DataFrame:
    """Share of a table's cells that the other extraction of it has too, with multiplicity, of the larger one."""
    x = a.groupBy(key, value).agg(F.count(F.lit(1)).alias("n1"))
    y = b.groupBy(key, value).agg(F.count(F.lit(1)).alias("n2"))
    j = x.join(y, [key, value], "full").groupBy(key).agg(F.sum(F.least(F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0)))).alias("shared"), F.sum(F.coalesce("n1", F.lit(0))).alias("a"), F.sum(F.coalesce("n2", F.lit(0))).alias("b"))
    return j.select(key, "shared", (F.col("shared") / F.greatest("a", "b")).alias("overlap"))
