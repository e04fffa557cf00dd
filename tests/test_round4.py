import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfmark.operators import merge
from shelfmark.plans import captures
from shelfmark.sources import store

SMALL = "/root/testdata/sf0.001"


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    root = str(tmp_path / "tree")
    store.write_folders(spark.range(80).select(F.col("id").alias("page"), F.lit("<p>x</p>").alias("html")), root, ("page",), "text")
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    spark.sparkContext.setJobGroup("listing-test", "")
    files = store.page_files(spark, root, "*.txt")
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing-test") for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
    assert files.count() == 80


def test_captured_titles_keep_other_references(spark, tmp_path):
    texts = ["a &amp;&amp;&amp", "say &quot;x&quot; &lt;b&gt;", "&amp;lt; &#65; & c", "plain"]
    page = "<html><head><title>{0}</title></head><body><h1>{0}</h1></body></html>"
    rows = [(i, f"https://e.example/{i}", page.format(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in captures.e2_captured_pages(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(entry.oracle_sql()["e2_captured_pages"]).fetchall())


@pytest.mark.parametrize("name", ["m1_merged_records", "m6_replayed_records", "m7_field_changes", "m8_promotion_candidates", "a15_mode_summary"])
def test_answers_are_parsed_once(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object(") == 1


def test_candidates_are_built_once_for_both_tables(spark):
    plan = entry.queries()["m9_promotion_rows"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object(" not in plan


def test_field_changes_count_each_field_once(spark):
    rows = spark.createDataFrame([("a", True, ["x", "y"]), ("a", True, []), ("a", False, ["x"]), ("b", True, None), ("b", True, ["x"])], "mode string, ok boolean, accepted array<string>")
    assert sorted(tuple(r) for r in merge.field_changes(rows).collect()) == [("a", "x", 1), ("a", "y", 1), ("b", "x", 1)]


@pytest.mark.parametrize("name", ["c9_split_names", "c11_creators_with_notes"])
def test_names_are_dealt_to_all_cores(spark, name):
    assert entry.queries()[name](spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["v8_audit_errors", "w6_series_assembly"])
def test_list_pages_are_read_once(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "subject-num" not in plan and "<h1" not in plan
