"""Registered queries that return the operators' rows where earlier ones return counts, and inputs that grow with their tables; each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exports, lists
from .queries import _STATUS, ORACLE, QUERIES, cleaned_records, query
from .synth import table

__all__ = ["QUERIES"]


@query(
    f"""WITH s AS ({_STATUS}), e AS (SELECT 'bibtex' AS format, * FROM ({ORACLE['y2_bibtex']}) b UNION ALL SELECT 'biblatex', * FROM ({ORACLE['y3_biblatex']}) c)
SELECT 'export-' || format || '-' || k AS export_record_id, format, sha256(entry) AS payload_sha256, CASE WHEN gate <> '' THEN 'invalid' WHEN isbn IS NULL THEN 'warning' ELSE 'valid' END AS validation_status FROM e JOIN s USING (k)"""
)
def s5_export_payloads(spark, sf):
    """Each text export's payload, as a hash."""
    rows = exports.export_records(cleaned_records(spark, sf)).where("payload_text is not null")
    return rows.select("export_record_id", "format", F.sha2("payload_text", 256).alias("payload_sha256"), "validation_status")


@query(
    f"""WITH s AS ({_STATUS}), f AS (SELECT k, unnest([['title', title], ['abstractNote', abstract_note], ['series', series], ['date', publish_date], ['publisher', publisher], ['numPages', pages], ['ISBN', isbn], ['url', url], ['language', language], ['libraryCatalog', 'Catalog']]) AS e FROM s)
SELECT k AS id, e[1] AS field, e[2] AS value FROM f WHERE e[2] IS NOT NULL AND e[2] <> ''"""
)
def y5_item_field_rows(spark, sf):
    """Every field of every item."""
    return exports.item_fields(cleaned_records(spark, sf).select(F.col("k").alias("id"), exports.payload(F.col("book")).alias("payload")))


@query(
    """WITH f AS (SELECT 'https://book.example.org/subject/' || l_partkey || '/' AS url, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'T' || l_orderkey END AS title, l_orderkey AS o, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS i FROM lineitem)
SELECT url, coalesce(arg_min(title, (o, n, i)) FILTER (title <> ''), '') AS title, count(*) AS n_sources, arg_min(o, (o, n, i)) AS first_list FROM f GROUP BY 1"""
)
def a6_merged_parts(spark, sf):
    """Candidates merged over the lists that name them; addresses grow with the parts."""
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    links = table(spark, sf, "lineitem").select(F.concat(F.lit("https://book.example.org/subject/"), F.col("l_partkey").cast("string"), F.lit("/")).alias("url"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("T"), F.col("l_orderkey").cast("string"))).alias("title"), seq.alias("seq"), F.col("l_orderkey").alias("source"))
    return lists.merge_candidates(links).select("url", "title", "n_sources", F.col("first_source").alias("first_list"))


@query(
    """SELECT url, row_number() OVER (ORDER BY o, url) AS rank FROM (SELECT url, sha256('seed' || chr(0) || url) AS o FROM (SELECT 'https://book.example.org/subject/' || o_orderkey || '/' AS url FROM orders) e ORDER BY o, url LIMIT 100) g"""
)
def w2_selected_orders(spark, sf):
    """The first hundred subjects by a seeded hash, of as many as there are orders."""
    return lists.select_subjects(table(spark, sf, "orders").select(F.concat(F.lit("https://book.example.org/subject/"), F.col("o_orderkey").cast("string"), F.lit("/")).alias("url")), 100, "seed").select("url", F.col("rank").cast("long").alias("rank"))
