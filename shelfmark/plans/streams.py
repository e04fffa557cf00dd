"""Registered queries over packed captures, pages that change over time, and logs of changes, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lists
from ..sources import packed, store
from ..streaming import intake
from . import synth
from .queries import QUERIES, query
from .synth import table

__all__ = ["QUERIES"]


@query("SELECT cast(page_id AS string) AS id, url, CASE WHEN page_id % 5 = 0 THEN 'list-page' ELSE 'subject-page' END AS kind, sha256(html) AS html_sha256, length(html) AS n_chars FROM pages WHERE page_id % 3 <> 0")
def s1_packed_pages(spark, sf):
    """The pages as packed captures; the manifest's two kinds of pages are found in the metadata, which is read without the bodies, and their bodies
    come from ranges of the archives."""
    packed.register(spark)
    root = store.new_dir(spark, "packed")
    p = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), "url", F.when(F.col("page_id") % 5 == 0, "list-page").otherwise("subject-page").alias("kind"), "html")
    p.write.format("packed-pages").mode("append").save(root)
    listed = spark.read.format("packed-pages").schema("id string, kind string").load(root).where(F.col("id").cast("long") % 3 != 0)
    bodies = spark.read.format("packed-pages").schema("id string, url string, html string").option("splitBytes", 256 << 10).load(root)
    return listed.join(bodies, "id").select("id", "url", "kind", F.sha2("html", 256).alias("html_sha256"), F.length("html").cast("long").alias("n_chars"))


@query(
    f"""SELECT url, CASE WHEN NOT broken THEN CASE WHEN k % 6 = 0 THEN 'Third ' WHEN k % 4 = 0 THEN 'Second ' ELSE '' END || main_title || CASE WHEN subtitle = '' THEN '' ELSE ': ' || subtitle END END AS title,
  CASE WHEN broken THEN 'missing-info-block' END AS parse_error, CASE WHEN k % 6 = 0 THEN 5 WHEN k % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS seq, 1 + (k % 4 = 0)::BIGINT + (k % 6 = 0)::BIGINT AS versions FROM ({synth.PAGE_FIELDS}) f"""
)
def e7_streamed_books(spark, sf):
    """Detail pages that come in three runs of a stream: all of them; some again, changed, unchanged or from an older capture; some changed twice in one batch."""
    root = store.new_dir(spark, "intake")
    inbox, kept, state = (f"{root}/{n}" for n in ("in", "kept", "state"))
    p = store.stage(synth.detail_pages(spark, sf), "pages")
    k = F.col("k")
    seen = lambda where, seq, prefix: p.where(where).select("url", F.replace("html", F.lit("<h1><span>"), F.lit(f"<h1><span>{prefix}")).alias("html"), F.lit(seq).cast("long").alias("seq"))
    runs = (
        [seen(F.lit(True), 1, "")],
        [seen(k % 4 == 0, 2, "Second "), seen(k % 4 == 2, 2, ""), seen(k % 8 == 1, 0, "Older ")],
        [seen(k % 6 == 0, 4, "Not yet "), seen(k % 6 == 0, 5, "Third "), seen((k % 4 == 0) & (k % 6 != 0), 3, "Second ")],
    )
    for run in runs:
        for rows in run:
            rows.write.mode("append").parquet(inbox)
        intake.keep_books(intake.read_pages(spark, inbox, schema=intake.CAPTURED), kept, state).awaitTermination()
    versions = spark.read.parquet(kept).groupBy("url").agg(F.count("*").alias("versions"))
    now = intake.current_books(spark, kept).join(versions, "url")
    return now.select("url", F.get_json_object("book_json", "$.title").alias("title"), "parse_error", "seq", "versions")


@query(
    """WITH log AS (SELECT event_id AS pos, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, 'u' || user_id AS uid, 'https://book.example.org/people/u' || user_id || '/wish?v=' || event_id AS url, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS label FROM events),
g AS (SELECT uid, max(pos) AS gone FROM log WHERE op = 'delete' GROUP BY 1), a AS (SELECT log.* FROM log LEFT JOIN g USING (uid) WHERE op = 'upsert' AND (gone IS NULL OR pos > gone))
SELECT uid, min(pos) AS pos, arg_max(url, pos) AS url, arg_max(label, pos) AS label FROM a GROUP BY 1"""
)
def x4_registry_log(spark, sf):
    """The registry after a log of upserts and deletes in turn."""
    e, user = table(spark, sf, "events"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    url = F.concat(F.lit("https://book.example.org/people/"), user, F.lit("/wish?v="), F.col("event_id").cast("string"))
    log = e.select(F.col("event_id").alias("pos"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), user.alias("uid"), url.alias("url"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("label"))
    return lists.fold_readlists(log)
