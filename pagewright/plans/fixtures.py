"""Spans, table boxes and Markdown lines derived from the driver's documents, as SQL for Spark and for DuckDB.

The driver's texts have no layout, so the structuring operators get theirs from these. Whole tables and whole texts are used: every word of
every line is in a span, and in a Markdown line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What differs between the two engines.
DIALECTS = {
    "spark": {
        "lines": "select doc_id, cast(pos as bigint) as ln, col as line from (select doc_id, posexplode(split(text, '\\n', -1)) from documents)",
        "words": "array_join(slice({w}, {a}, {n}), ' ')",
        "split": "split({x}, ' ')",
        "size": "size(w)",
        "int": "int",
    },
    "duckdb": {
        "lines": "select doc_id, i as ln, string_split(text, chr(10))[i + 1] as line from (select doc_id, text, unnest(range(len(string_split(text, chr(10))))) as i from documents)",
        "words": "array_to_string(list_slice({w}, {a}, {a} + {n} - 1), ' ')",
        "split": "string_split({x}, ' ')",
        "size": "len(w)",
        "int": "int",
    },
}


def spans_sql(engine: str) -> str:
    """Spans of a layout of five lines a page: headers, body, code, captions, numbered text and running headers, up to three spans a line.

    The third span of a line goes to the line's end; a header has three words, and the others of its line stand below it.
    """
    d = DIALECTS[engine]
    words = lambda a, n=3: d["words"].format(w="w", a=a, n=n)
    return f"""
with l0 as ({d["lines"]}),
l1 as (select doc_id, ln, {d["split"].format(x="line")} as w from l0 where length(line) > 0),
l2 as (select doc_id, ln, cast(floor(ln / 5) as int) as page, ln % 5 as r, {words(4, d["size"])} as rest, {words(1)} as a, {words(4)} as b, {words(7, d["size"])} as c,
  90 + 30 * (ln % 5) - (case when ln % 3 = 2 then 14 else 0 end) as y,
  case when ln = 0 then 'H' else case (doc_id * 7 + ln) % 12 when 0 then 'H' when 1 then 'M' when 2 then 'C' when 5 then 'N' when 7 then 'I' when 9 then 'J' else 'B' end end as kind from l1),
t as (select doc_id, a as title from l2 where ln = 0),
rp as (select distinct l2.doc_id, page, title from l2 join t on l2.doc_id = t.doc_id where page > 0 and l2.doc_id % 5 > 0),
sp as (
  select doc_id, page, ln * 3 + 2 as seq, case kind when 'C' then concat('Table ', cast(ln as varchar(20)), '. ', a) when 'N' then concat(cast(ln as varchar(20)), ' ', a) else a end as text, kind, 72 as x0, y as y0 from l2
  union all select doc_id, page, ln * 3 + 1, case when r = 4 and doc_id % 4 = 0 and length(c) = 0 then concat(b, '-') else b end, kind, 250, y + (doc_id + ln) % 5 from l2 where kind in ('B', 'M', 'C', 'N') and length(b) > 0
  union all select doc_id, page, ln * 3 + 3, case when r = 4 and doc_id % 4 = 0 then concat(c, '-') else c end, kind, 420, y + (doc_id + ln) % 5 + ln % 4 from l2 where kind in ('B', 'M', 'C', 'N') and length(c) > 0
  union all select doc_id, page, ln * 3 + 3, rest, 'B', 72, y + 22 from l2 where kind in ('H', 'I', 'J') and length(rest) > 0
  union all select doc_id, page, 0, case when page % 3 = 2 then concat(title, ' | ', cast(page + 1 as varchar(20))) when page % 3 = 1 then concat(cast(page + 1 as varchar(20)), ' | ', title) else concat(cast(page + 1 as varchar(20)), ' | ', title, ' Trailing body') end, 'R', 72, 30 from rp
  union all select doc_id, page, 1, 'Side note', 'R', 250, 30 from rp where page % 3 = 0 and doc_id % 2 = 0),
f as (select doc_id, page, seq, text, case kind when 'M' then 'CourierNew' when 'B' then 'Times' when 'C' then 'Times' when 'N' then 'Times' when 'R' then 'Times' else 'Helvetica-Bold' end as font,
  cast(case kind when 'H' then 18.0 when 'J' then 13.0 when 'I' then 12.0 when 'R' then 9.0 when 'M' then 10.0 else 11.0 end as double) as font_size, cast(x0 as double) as x0, cast(y0 as double) as y0 from sp)
select doc_id, page, cast(seq as int) as seq, text, font, font_size, x0, y0, x0 + 5 * length(text) as x1, y0 + font_size as y1, cast(800 as double) as page_height,
  cast(case when font like '%Bold' then 16 else 0 end as int) as flags from f"""


TABLES_SQL = "select distinct doc_id, 0 as page, cast(240 as double) as x0, cast(145 as double) as y0, cast(900 as double) as x1, cast(215 as double) as y1 from documents where doc_id % 6 = 0"


def lines_sql(engine: str) -> str:
    """Markdown lines with headers of three levels, fences, blank lines, numbered lines and pipes; line_no has gaps.

    A header line takes three words, the others follow it; running headers stand before lines.
    """
    d = DIALECTS[engine]
    part = lambda a, n: d["words"].format(w="w", a=a, n=n)
    return f"""
with l0 as ({d["lines"]}),
l1 as (select doc_id, ln, line, {part(1, 3)} as head, {part(4, d["size"])} as tail from (select doc_id, ln, line, {d["split"].format(x="line")} as w from l0) s where length(line) > 0),
t as (select doc_id, head as title from l1 where ln = 0),
k as (select 0 as k union all select 1 union all select 2 union all select 3),
x as (select l1.doc_id, ln * 4 + k as line_no, case
  when ln % 9 = 5 then case k when 0 then '```' when 1 then line when 2 then '```' else '' end
  when ln % 4 = 0 and k = 0 then concat(case cast(floor(ln / 4) as bigint) % 3 when 0 then '# ' when 1 then '## ' else '### ' end, head)
  when ln % 4 = 0 and k = 2 and length(tail) > 0 then tail
  when ln % 4 = 0 and k = 3 and length(tail) > 0 then ''
  when ln % 4 > 0 and ln % 9 <> 6 and ln % 10 = 7 then case k when 0 then concat(title, ' | ', cast(ln as varchar(20))) when 2 then line else '' end
  when k > 1 then null
  when k = 1 then ''
  when ln % 9 = 6 then concat('7 ', line)
  when ln % 10 = 3 then concat(cast(ln as varchar(20)), ' | ', title, ' ', line)
  else line end as line from l1 join t on l1.doc_id = t.doc_id cross join k)
select doc_id, cast(line_no as bigint) as line_no, line from x where line is not null"""


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("from documents", "from {documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, spans_sql("spark"))


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, TABLES_SQL)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, lines_sql("spark"))
