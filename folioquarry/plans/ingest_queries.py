"""Queries over delivered rows: p4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.plans.runtime import table
from folioquarry.sources import delimited


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.rejects(table(spark, sf_dir, "raw_rows"), table(spark, sf_dir, "raw_tables"), table(spark, sf_dir, "ingest_outcomes"))


def p4_valid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed cells of the valid rows, one row per cell."""
    rows = delimited.load_rows(table(spark, sf_dir, "raw_rows"), table(spark, sf_dir, "raw_tables"), keep=("table_name",))
    cell = rows.where("reason is null").select("row_key", "table_name", F.posexplode("cells").alias("col_idx", "c"))
    return cell.select("row_key", "table_name", "col_idx", "c.name", "c.type", "c.text", F.col("c.number").cast("double").alias("number"), F.date_format("c.day", "yyyy-MM-dd").alias("day"))


_FIELDS = r"""
r as (select row_key, table_name, coalesce(raw_line, '') as line, delimiter as d, header, col_types, date_format, decimal_mark
      from raw_rows join raw_tables using (table_name)),
q as (select *, regexp_full_match(line, '(?s)("([^"]|"")*"|[^"' || d || ']*)([' || d || ']("([^"]|"")*"|[^"' || d || ']*))*') as quoted_well,
             regexp_extract_all(d || line, '(?s)[' || d || ']("([^"]|"")*"|[^"' || d || ']*)', 1) as fields from r),
v as (select row_key, table_name, header, col_types, date_format, decimal_mark, i,
             trim(case when fields[i] like '"%' then replace(fields[i][2:-2], '""', '"') else fields[i] end, E' \t\r\n ') as value
      from (select *, unnest(range(1, len(header) + 1)) as i from q where quoted_well and len(fields) = len(header))),
t as (select *, col_types[i] as kind, lower(value) in ('', '-', 'n/a', 'nil') as empty,
             case date_format when 'yyyy-MM-dd' then try_strptime(value, '%Y-%m-%d') when 'dd/MM/yyyy' then try_strptime(value, '%d/%m/%Y')
                  when 'MM/dd/yyyy' then try_strptime(value, '%m/%d/%Y') else try_strptime(value, '%-d %b %Y') end as day_value,
             case date_format when 'yyyy-MM-dd' then '[0-9]{4}-[0-9]{2}-[0-9]{2}' when 'd MMM yyyy' then '[1-9][0-9]? (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [0-9]{4}' else '[0-9]{2}/[0-9]{2}/[0-9]{4}' end as day_re,
             '[$€£]?([0-9]{1,3}([' || case decimal_mark when '.' then ',' else '.' end || '][0-9]{3})+|[0-9]+)([' || decimal_mark || '][0-9]+)?' as money from v),
j as (select *, empty or case kind when 'text' then true when 'integer' then regexp_full_match(value, '-?[0-9]+')
             when 'amount' then regexp_full_match(value, '-?' || money) or regexp_full_match(value, '\(' || money || '\)')
             else regexp_full_match(value, day_re) and day_value is not null end as ok from t)
"""

ORACLE = {
    "p4_found": f"""
with {_FIELDS}
select 'raw_rows' as origin, cast(row_key as varchar) as record_key,
       case when not quoted_well then 'quoting' when len(fields) <> len(header) then 'column_count' else 'value' end as reason
from q where not quoted_well or len(fields) <> len(header) or row_key in (select row_key from j where not ok)
union all
select distinct 'ingest_outcomes', outcome_id, 'value' from ingest_outcomes
where not coalesce(((status = 'parsed' and doc_id is not null and error is null) or (status = 'parse_failed' and doc_id is null and error is not null))
  and scanned_pages_untranscribed >= 0 and scanned_pages_untranscribed <= scanned_pages_total, false)
""",
    "p4_valid_cells": f"""
with {_FIELDS}, bad as (select distinct row_key from j where not ok)
select row_key, table_name, cast(i - 1 as integer) as col_idx, header[i] as name, kind as type, case when not empty then value end as text,
       case when not empty and kind = 'integer' then cast(value as double)
            when not empty and kind = 'amount' then cast((case when value[1] in ('-', '(') then '-' else '' end) || replace(regexp_replace(value, '[^0-9' || decimal_mark || ']', '', 'g'), decimal_mark, '.') as double) end as number,
       case when not empty and kind = 'date' then strftime(day_value, '%Y-%m-%d') end as day
from j where row_key not in (select row_key from bad)
""",
}

QUERIES = {"p4_found": p4_found, "p4_valid_cells": p4_valid_cells}
