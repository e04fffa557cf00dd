"""Registered queries over the nine tables: written, replaced, corrected, checked and counted, each with the SQL that it must equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import validate
from ..schemas import PRIMARY, RUN_OF, TABLES
from ..sources import store
from .queries import QUERIES, query
from .synth import table

__all__ = ["QUERIES"]

RUNS = 5
RECORDS = ("raw_scraped_records", "cleaned_records", "export_records", "import_records")


def _named(kind: str, c) -> F.Column:
    return F.concat(F.lit(f"{kind}-"), c.cast("string"))


def nine_tables(spark, sf) -> dict[str, DataFrame]:
    """The nine tables of a pipeline over ``part``: one run of each kind for each remainder of the key by ``RUNS``, one record of each kind a part."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_size", (F.col("p_partkey") % RUNS).alias("run"))
    k, run = F.col("k"), F.col("run")
    runs = p.select("run").distinct()
    warn = F.when(k % 3 == 0, "invalid").when(k % 3 == 1, "warning").otherwise("valid")
    none = F.lit("[]")
    return {
        "pipeline_runs": runs.select(_named("run", run).alias("run_id"), F.lit("dry-run").alias("execution_mode"), F.lit("completed").alias("status"), F.lit("part").alias("source")),
        "scrape_runs": runs.select(_named("scrape", run).alias("scrape_run_id"), _named("run", run).alias("pipeline_run_id"), F.lit("dry-run").alias("execution_mode"), F.lit("fixture").alias("source_kind"), (run * 10).cast("int").alias("request_count")),
        "cleaning_runs": runs.select(_named("clean", run).alias("cleaning_run_id"), _named("run", run).alias("pipeline_run_id"), F.lit("rules").alias("cleaner_kind")),
        "export_runs": runs.select(_named("export", run).alias("export_run_id"), _named("run", run).alias("pipeline_run_id"), F.lit("bibtex").alias("format")),
        "import_runs": runs.select(_named("import", run).alias("import_run_id"), _named("run", run).alias("pipeline_run_id"), F.lit("prepared").alias("status")),
        "raw_scraped_records": p.select(_named("raw", k).alias("raw_record_id"), _named("scrape", run).alias("scrape_run_id"), _named("i", k).alias("internal_id"), F.col("p_name").alias("raw_html")),
        "cleaned_records": p.select(_named("cleaned", k).alias("cleaned_record_id"), _named("clean", run).alias("cleaning_run_id"), _named("raw", k).alias("raw_record_id"), _named("i", k).alias("internal_id"), F.col("p_name").alias("cleaned_json"), warn.alias("validation_status"), none.alias("validation_warnings_json")),
        "export_records": p.select(_named("x", k).alias("export_record_id"), _named("export", run).alias("export_run_id"), _named("cleaned", k).alias("cleaned_record_id"), F.lit("bibtex").alias("format"), F.col("p_name").alias("payload_text"), warn.alias("validation_status")),
        "import_records": p.select(_named("m", k).alias("import_record_id"), _named("import", run).alias("import_run_id"), _named("cleaned", k).alias("cleaned_record_id"), _named("x", k).alias("export_record_id"), F.col("p_name").alias("item_payload_json"), F.when(k % 3 == 0, "skipped").otherwise("prepared").alias("status")),
    }


_TEXT = {"raw_scraped_records": "raw_html", "cleaned_records": "cleaned_json", "export_records": "payload_text", "import_records": "item_payload_json"}
_KIND = {"raw_scraped_records": ("raw", "scrape"), "cleaned_records": ("cleaned", "clean"), "export_records": ("x", "export"), "import_records": ("m", "import")}


def written_tables(spark, sf) -> str:
    """All nine tables written run by run; run 3 written again with its even records alone, corrected, and that write repeated; every record whose key
    ends in 7 upserted with a new text, some of them moved to run 0, and that repeated too."""
    root = store.new_dir(spark, "tables")
    for name, rows in nine_tables(spark, sf).items():
        store.replace_runs(rows, root, name)
        if name in RECORDS:
            key, run, text = F.regexp_extract(PRIMARY[name], "([0-9]+)\\z", 1).cast("long"), RUN_OF[name], _TEXT[name]
            again = rows.where(F.col(run).endswith("-3") & (key % 2 == 0)).withColumn(text, F.concat(text, F.lit(" again")))
            newer = rows.where(key % 10 == 7).withColumn(text, F.lit("newer")).withColumn(run, F.when(key % 20 == 7, F.lit(f"{_KIND[name][1]}-0")).otherwise(F.col(run)))
            for _ in range(2):
                store.replace_runs(again, root, name)
            for _ in range(2):
                store.upsert(newer, root, name)
        else:
            store.replace_runs(rows.where(F.col(RUN_OF[name]).endswith("-3")), root, name)
    return root


_RECORDS_SQL = "SELECT '{name}' AS \"table\", '{kind}-' || k AS key, '{run}-' || CASE WHEN k % 20 = 7 THEN 0 ELSE k % 5 END AS run, CASE WHEN k % 10 = 7 THEN 'newer' WHEN k % 5 = 3 THEN p_name || ' again' ELSE p_name END AS detail FROM (SELECT p_partkey AS k, p_name FROM part) p WHERE k % 5 <> 3 OR k % 2 = 0"
_RUN_ROWS = (("pipeline_runs", "run"), ("scrape_runs", "scrape"), ("cleaning_runs", "clean"), ("export_runs", "export"), ("import_runs", "import"))


@query(
    " UNION ALL ".join(
        [_RECORDS_SQL.format(name=n, kind=k, run=r) for n, (k, r) in _KIND.items()]
        + [f"SELECT '{n}', '{k}-' || run, 'run-' || run, NULL FROM (SELECT DISTINCT p_partkey % 5 AS run FROM part) r" for n, k in _RUN_ROWS]
    )
)
def s4_pipeline_tables(spark, sf):
    """Every row of the nine tables, as they stand after repeated, corrected and merged writes."""
    root = written_tables(spark, sf)
    rows = [store.read_table(spark, root, n).select(F.lit(n).alias("table"), F.col(PRIMARY[n]).alias("key"), F.col(RUN_OF[n]).alias("run"), (F.col(_TEXT[n]) if n in _TEXT else F.lit(None).cast("string")).alias("detail")) for n in TABLES]
    return reduce(DataFrame.unionByName, rows)


@query(
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 5 AS run FROM part), r AS (SELECT count(DISTINCT run) AS n FROM p)
SELECT 'pipeline_runs' AS "table", NULL AS status, n FROM r UNION ALL SELECT 'scrape_runs', NULL, n FROM r UNION ALL SELECT 'cleaning_runs', NULL, n FROM r UNION ALL SELECT 'export_runs', NULL, n FROM r UNION ALL SELECT 'import_runs', NULL, n FROM r
UNION ALL SELECT unnest(['raw_scraped_records', 'cleaned_records', 'export_records', 'import_records']), NULL, count(*) FROM p
UNION ALL SELECT unnest(['cleaned_records', 'export_records']), CASE k % 3 WHEN 0 THEN 'invalid' WHEN 1 THEN 'warning' ELSE 'valid' END AS s, count(*) FROM p GROUP BY k % 3
UNION ALL SELECT 'import_records', CASE WHEN k % 3 = 0 THEN 'skipped' ELSE 'prepared' END AS s, count(*) FROM p GROUP BY k % 3 = 0"""
)
def a13_written_counts(spark, sf):
    """Rows of each table, and of each status, as counted by the jobs that wrote them; no table is read for it."""
    root, out = store.new_dir(spark, "counted"), []
    wanted = {"cleaned_records": ("validation_status", ("valid", "warning", "invalid")), "export_records": ("validation_status", ("valid", "warning", "invalid")), "import_records": ("status", ("prepared", "skipped"))}
    for name, rows in nine_tables(spark, sf).items():
        status, values = wanted.get(name, (None, ()))
        found = store.replace_runs(rows, root, name, values, status)
        out += [(name, None if s == "n" else s, n) for s, n in found.items()]
    return spark.createDataFrame(out, "table string, status string, n long")


def faulty_tables(spark, sf) -> dict[str, DataFrame]:
    """The nine tables with a fault behind every rule, each at records or runs of its own."""
    t = nine_tables(spark, sf)
    num = lambda c: F.regexp_extract(c, "([0-9]+)\\z", 1).cast("long")
    lost = lambda name, col, by, rest: t[name].withColumn(col, F.when(num(by) % 40 == rest, F.concat(F.lit("lost-"), by)).otherwise(F.col(col)))
    none = lambda name, col, at: t[name].withColumn(col, F.when(num(PRIMARY[name]) == at, F.lit("no-run")).otherwise(F.col(col)))
    t["raw_scraped_records"] = lost("raw_scraped_records", "scrape_run_id", "raw_record_id", 1)
    for col, rest in (("cleaning_run_id", 2), ("raw_record_id", 3)):
        t["cleaned_records"] = lost("cleaned_records", col, "cleaned_record_id", rest)
    for col, rest in (("export_run_id", 4), ("cleaned_record_id", 5)):
        t["export_records"] = lost("export_records", col, "export_record_id", rest)
    for col, rest in (("import_run_id", 6), ("cleaned_record_id", 7), ("export_record_id", 8)):
        t["import_records"] = lost("import_records", col, "import_record_id", rest)
    for name in ("scrape_runs", "cleaning_runs", "export_runs", "import_runs"):
        t[name] = none(name, "pipeline_run_id", 4)
    t["pipeline_runs"] = t["pipeline_runs"].withColumn("execution_mode", F.when(num("run_id") == 2, "other").otherwise(F.col("execution_mode")))
    t["scrape_runs"] = t["scrape_runs"].withColumn("request_count", F.when(num("scrape_run_id") == 1, -1).otherwise(F.col("request_count")))
    for name, col, rest in (("cleaned_records", "validation_status", 9), ("export_records", "format", 10), ("import_records", "status", 11)):
        t[name] = t[name].withColumn(col, F.when(num(PRIMARY[name]) % 40 == rest, "other").otherwise(F.col(col)))
    for name in RECORDS:  # the same rows again, at keys of their own
        t[name] = t[name].unionByName(t[name].where(num(PRIMARY[name]) % 40 == 20))
    for name, _ in _RUN_ROWS:
        t[name] = t[name].unionByName(t[name].where(num(PRIMARY[name]) == 0))
    return t


_LOST = (("raw_scraped_records.scrape_run_id", "raw", 1), ("cleaned_records.cleaning_run_id", "cleaned", 2), ("cleaned_records.raw_record_id", "cleaned", 3), ("export_records.export_run_id", "x", 4), ("export_records.cleaned_record_id", "x", 5), ("import_records.import_run_id", "m", 6), ("import_records.cleaned_record_id", "m", 7), ("import_records.export_record_id", "m", 8))
_WRONG = (("cleaned_records.validation_status", "cleaned", 9), ("export_records.format", "x", 10), ("import_records.status", "m", 11))


@query(
    "WITH p AS (SELECT p_partkey AS k, p_partkey % 5 AS run FROM part), r AS (SELECT DISTINCT run FROM p) "
    + " UNION ALL ".join(
        [f"SELECT 'foreign:{c}' AS rule, 'lost-{k}-' || k AS key FROM p WHERE k % 40 = {m}" for c, k, m in _LOST]
        + [f"SELECT 'enum:{c}', '{k}-' || k FROM p WHERE k % 40 = {m}" for c, k, m in _WRONG]
        + [f"SELECT 'primary:{n}', '{k}-' || k FROM p WHERE k % 40 = 20" for n, (k, _) in _KIND.items()]
        + [f"SELECT 'unique:{n}', 'i-' || k FROM p WHERE k % 40 = 20" for n in ("raw_scraped_records", "cleaned_records")]
        + ["SELECT 'unique:export_records', 'export-' || run || '|cleaned-' || k || '|bibtex' FROM p WHERE k % 40 = 20", "SELECT 'unique:import_records', 'import-' || run || '|cleaned-' || k FROM p WHERE k % 40 = 20"]
        + [f"SELECT 'primary:{n}', '{k}-' || run FROM r WHERE run = 0" for n, k in _RUN_ROWS]
        + [f"SELECT 'foreign:{n}.pipeline_run_id', 'no-run' FROM r WHERE run = 4" for n, _ in _RUN_ROWS[1:]]
        + ["SELECT 'enum:pipeline_runs.execution_mode', 'run-' || run FROM r WHERE run = 2", "SELECT 'negative:scrape_runs.request_count', 'scrape-' || run FROM r WHERE run = 1"]
    )
)
def v7_table_constraints(spark, sf):
    """Every violated rule of the nine tables with its keys."""
    return validate.check_tables(faulty_tables(spark, sf)).select("rule", "key")
