"""Inputs derived from the driver's tables, as SQL that both Spark and the oracle run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the tables by their names."""
    for name in TABLES:
        sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 parquet.`{sf_dir}/{name}.parquet`", sql)
    return spark.sql(sql)


#: Dates as text, in six forms, with what they normalize to.
DATES = """
SELECT o_orderkey AS k,
  CASE o_orderkey % 6 WHEN 0 THEN y WHEN 1 THEN y || '-' || mm WHEN 2 THEN y || '年' || m || '月' || d || '日'
    WHEN 3 THEN y || '/' || m || '/' || d WHEN 4 THEN y || '-13' ELSE 'printed ' || y || '.' || m || '.' || '40' END AS raw,
  CASE o_orderkey % 6 WHEN 0 THEN y WHEN 1 THEN y || '-' || mm WHEN 2 THEN y || '-' || mm || '-' || dd
    WHEN 3 THEN y || '-' || mm || '-' || dd ELSE '' END AS expected
FROM (SELECT o_orderkey, y, mm, dd, cast(cast(mm AS int) AS string) AS m, cast(cast(dd AS int) AS string) AS d FROM
  (SELECT o_orderkey, substr(t, 1, 4) AS y, substr(t, 6, 2) AS mm, substr(t, 9, 2) AS dd FROM
    (SELECT o_orderkey, cast(o_orderdate AS string) AS t FROM orders) a) b) c
"""

#: Ten-digit numbers with the check digit that their thirteen-digit form has.
_DIGIT = "cast(substr(s, {i}, 1) AS int)"
ISBNS = f"""
SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN s || '0' WHEN 1 THEN substr(s, 1, 1) || '-' || substr(s, 2, 8) || '-X'
    WHEN 2 THEN '978' || s || '1' ELSE substr(s, 1, 8) END AS raw,
  CASE p_partkey % 4 WHEN 2 THEN '978' || s || '1' WHEN 3 THEN NULL ELSE '978' || s || cast((10 - c % 10) % 10 AS string) END AS expected
FROM (SELECT p_partkey, s, 9 + 3 * 7 + 8 + {' + '.join(f"{3 if i % 2 else 1} * " + _DIGIT.format(i=i) for i in range(1, 10))} AS c
  FROM (SELECT p_partkey, lpad(cast(p_partkey AS string), 9, '0') AS s FROM part) a) b
"""

#: Incoming books (even keys) and library items (odd keys).
_ISBN = "lpad(cast(floor(p_partkey / 2) AS string), 9, '0')"
BOOKS = f"""
SELECT p_partkey AS book_key, p_name || CASE WHEN p_partkey % 5 = 0 THEN ': ' || p_type ELSE '' END AS title,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS publisher, cast(1950 + p_size AS string) AS publish_date,
  CASE WHEN p_partkey % 6 = 0 THEN {_ISBN} || '0' END AS isbn, cast(NULL AS string) AS isbn13,
  CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 2 THEN 'xx' WHEN 4 THEN ' EN ' ELSE 'zh' END AS language, p_partkey % 11 <> 0 AS has_author
FROM part WHERE p_partkey % 2 = 0
"""
LIBRARY = f"""
SELECT p_partkey AS item_id, p_name AS title, p_brand AS publisher,
  CASE WHEN p_partkey % 6 = 1 THEN substr({_ISBN}, 1, 1) || '-' || substr({_ISBN}, 2, 8) || '-0' END AS isbn, cast(1950 + p_size AS string) AS date
FROM part WHERE p_partkey % 2 = 1
"""

#: Fields of synthetic detail pages.
PAGE_FIELDS = """
SELECT p_partkey AS k, 'https://book.example.org/subject/' || cast(1000000 + p_partkey AS string) || '/' AS url, p_name AS main_title,
  CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE '' END AS subtitle,
  CASE WHEN p_partkey % 13 = 0 THEN '' ELSE s_name END AS publisher,
  CASE WHEN p_partkey % 8 = 0 THEN '' ELSE cast(1950 + p_size AS string) || '-' || cast(1 + p_partkey % 12 AS string) END AS date_raw,
  CASE WHEN p_partkey % 3 = 0 THEN '978' || lpad(cast(p_partkey AS string), 10, '0') ELSE '' END AS isbn,
  CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 9 = 1 THEN 'xx' ELSE 'en' END AS language,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'Ann ' || n_name END AS author, CASE WHEN p_partkey % 4 = 0 THEN 'Bob Smith' ELSE '' END AS translator,
  CASE WHEN p_partkey % 6 = 0 THEN 'Series ' || p_type ELSE '' END AS series, cast(p_size * 10 AS string) AS pages, p_partkey % 17 = 0 AS broken,
  CASE WHEN p_partkey % 2 = 0 THEN 'old' ELSE 'new' END AS cohort
FROM part JOIN supplier ON s_suppkey = p_partkey % 10 JOIN nation ON n_nationkey = s_nationkey
"""


def line(label: str, value: str) -> str:
    return f"CASE WHEN {value} = '' THEN '' ELSE '<span class=\"pl\">{label}:</span> ' || {value} || '<br/>' END"


PAGES = f"""
SELECT k, url, cohort, '<html><head><title>' || main_title || ' (Catalog)</title></head><body><h1><span>' || main_title || '</span></h1>' ||
  CASE WHEN broken THEN '' ELSE '<div id="info">' || {' || '.join(line(a, b) for a, b in (('作者', 'author'), ('出版社', 'publisher'), ('副标题', 'subtitle'), ('译者', 'translator'), ('出版年', 'date_raw'), ('页数', 'pages'), ('丛书', 'series'), ('ISBN', 'isbn'), ('语言', 'language')))} || '</div>' END ||
  '<div id="link-report"><div class="intro">About ' || main_title || '.</div></div></body></html>' AS html
FROM ({PAGE_FIELDS}) f
"""


def dealt(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt to all cores: the table that they are made of may be one split, however many rows it has."""
    return rows.repartition(2 * spark.sparkContext.defaultParallelism, key)


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detail pages, dealt to all cores: the table they are made of may be one split."""
    return run_sql(spark, sf_dir, PAGES).repartition(2 * spark.sparkContext.defaultParallelism, "k")


#: Series: an order's lines in order, two a page; subjects repeat. The declared count is none, 2, 4 or 9.
VOLUMES = """
SELECT l_orderkey AS series, 1 + l_partkey % 4 AS subject, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos,
  count(*) OVER (PARTITION BY l_orderkey) AS n, CASE l_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 9 END AS declared FROM lineitem
"""


def series_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series as captured pages: series, page, url, html."""
    v = run_sql(spark, sf_dir, VOLUMES).withColumn("page", F.floor(F.col("pos") / 2).cast("int"))
    text = lambda c: F.col(c).cast("string")
    anchor = F.concat(F.lit('<a href="https://book.example.org/subject/'), text("subject"), F.lit('/">Part '), text("subject"), F.lit("</a>"))
    p = v.groupBy("series", "page", "n", "declared").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", anchor.alias("a")))), lambda s: s["a"]), "").alias("items"))
    count = F.when(F.col("declared") > 0, F.concat(F.lit("册数: "), text("declared"))).otherwise(F.lit(""))
    more = F.when((F.col("page") + 1) * 2 < F.col("n"), F.lit('<span class="next"><a href="?">next</a></span>')).otherwise(F.lit(""))
    html = F.concat(F.lit("<h1>Order "), text("series"), F.lit('</h1><div class="subject-list">'), "items", F.lit('</div> <div class="paginator">'), count, more, F.lit("</div>"))
    return p.select("series", "page", F.concat(F.lit("https://book.example.org/series/"), text("series"), F.lit("?start="), text("page")).alias("url"), html.alias("html"))


#: User lists: a user's events in order, fifteen a page; subjects repeat.
ENTRIES = """
SELECT user_id AS uid, event_id, 1 + event_id % 997 AS subject, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
  count(*) OVER (PARTITION BY user_id) AS n FROM events
"""


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists as captured pages: uid, page, url, html."""
    e = run_sql(spark, sf_dir, ENTRIES).withColumn("page", F.floor(F.col("pos") / 15).cast("int"))
    address = F.concat(F.lit("https://book.example.org/subject/"), F.col("subject").cast("string"), F.lit("/"))
    anchor = F.concat(F.lit('<li><a href="'), address, F.lit('" title="Book '), F.col("subject").cast("string"), F.lit('">x</a></li>'))
    p = e.groupBy("uid", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", anchor.alias("a")))), lambda s: s["a"]), "").alias("items"), F.max("n").alias("n"), F.count("*").alias("c"))
    text = lambda c: c.cast("string")
    url = lambda page: F.concat(F.lit("https://book.example.org/people/"), text(F.col("uid")), F.lit("/wish?start="), text(page * 15))
    more = (F.col("page") + 1) * 15 < F.col("n")
    span = F.concat(F.lit('<span class="subject-num">'), text(F.col("page") * 15 + 1), F.lit("&nbsp;-&nbsp;"), text(F.col("page") * 15 + F.col("c")), F.lit("&nbsp;/&nbsp;"), text(F.col("n")), F.lit("</span>"))
    nxt = F.when(more, F.concat(F.lit('<span class="next"><a href="'), url(F.col("page") + 1), F.lit('">next</a></span>'))).otherwise(F.lit('<span class="next">next</span>'))
    return p.select("uid", "page", "n", url(F.col("page")).alias("url"), F.concat(F.lit("<html><body>"), span, F.lit("<ul>"), "items", F.lit("</ul>"), nxt, F.lit("</body></html>")).alias("html"))
