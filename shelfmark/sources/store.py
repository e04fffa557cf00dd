"""The pipeline's tables as Parquet, page corpora, sample trees and manifests."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PRIMARY, RUN_OF, TABLES
from . import trees

#: Subfolders of a corpus.
CORPUS_FOLDERS = 1024
FIXTURES = T.StructType([T.StructField("fixtures", T.ArrayType(T.StructType([*(T.StructField(n, T.StringType()) for n in ("id", "kind", "sourceUrl", "file", "expected", "capturedAt", "capturedByMode", "purpose", "notes")), T.StructField("redactions", T.ArrayType(T.StringType()))])))])
SAMPLE = T.StructType([T.StructField(n, T.StringType()) for n in ("subjectId", "sourceUrl", "sourceHtml", "domHtml", "capturedAt")])
_DECISION = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("model_record_id", "candidate_id", "decision", "notes")]))
MANIFEST = T.StructType([T.StructField("decisions", _DECISION), T.StructField("candidates", _DECISION)])


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that setting is absent and the session is on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="shelfmark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses."""
    return f"{shared_dir(spark)}/shelfmark-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, for jobs that use it several times."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _typed(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in their order and types; those that ``df`` lacks are null."""
    have = set(df.columns)
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name]))


def write_table(df: DataFrame, root: str, name: str, mode: str = "append", by: str | None = None) -> None:
    """Appends, or overwrites everything; ``by`` partitions the table, as by a run. ``replace_runs`` and ``upsert`` can be repeated."""
    writer = _typed(df, name).write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}").select(*TABLES[name].names)


def has_table(spark: SparkSession, root: str, name: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def replace_runs(df: DataFrame, root: str, name: str, statuses: tuple[str, ...] = (), status: str | None = None) -> dict[str, int]:
    """Writes whole runs: each run in ``df`` replaces what the table held of it, other runs stay, so a repeated or retried write leaves
    no second copy. Returns the rows written (``n``) and those of each of the ``statuses``, counted by the job that writes them.

    Tables are partitioned by the run that their rows belong to (``RUN_OF``). A row without a run is an error of the job.
    """
    run = RUN_OF[name]
    rows = _typed(df, name).withColumn(run, F.when(F.coalesce(F.col(run), F.lit("")) == "", F.raise_error(F.lit(f"{name}: a row without {run}"))).otherwise(F.col(run)))
    seen = Observation()
    counts = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), *counts)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(f"{root}/{name}")
    return seen.get


def upsert(df: DataFrame, root: str, name: str) -> dict[str, int]:
    """Rows replace those with their primary key, wherever these stand; other rows stay. Of several rows of ``df`` with one key the one with the largest
    values stays. Only runs that hold or get such a key are written again, from a staged copy, so a write that fails can be repeated."""
    spark = df.sparkSession
    key, run = PRIMARY[name], RUN_OF[name]
    cols = TABLES[name].names
    new = _typed(df, name).groupBy(key).agg(F.max(F.struct(*cols)).alias("r")).select("r.*")
    if not has_table(spark, root, name):
        return replace_runs(new, root, name)
    new = stage(new, "upsert")
    old = read_table(spark, root, name)
    held = old.select(key, run).join(new.select(key), key, "left_semi").select(run)
    touched = stage(held.union(new.select(run)).distinct(), "touched")
    stay = old.join(touched, run, "left_semi").join(new.select(key), key, "left_anti").select(*cols)
    merged = stage(stay.unionByName(new), "merged")
    counts = replace_runs(merged, root, name)
    # runs that lost their last row to another one
    left = touched.join(merged.select(run).distinct(), run, "left_anti")
    for row in left.toLocalIterator():
        drop_run(spark, root, name, row[run])
    return counts


def drop_run(spark: SparkSession, root: str, name: str, value: str) -> None:
    """Deletes one run's rows from a table."""
    named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(RUN_OF[name], value)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/{named}")
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _below(path: Column, root: str) -> Column:
    """A file's path below the root; schemes and hosts before the root do not matter."""
    bare = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//)?", "", root.rstrip("/"))
    return F.substring_index(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), f"{bare}/", -1)


#: Hadoop's setting under which tasks move their own files; by default the driver moves all of them, one by one, when a job ends.
_MOVED_BY_TASKS = ("mapreduce.fileoutputcommitter.algorithm.version", "2")
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by a few tasks a core; by default each folder is a task of its own, up to 10,000."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


def write_folders(rows: DataFrame, root: str, by: tuple[str, ...], fmt: str) -> None:
    """Rows into a folder for each value of ``by``, beside what is there; for trees of many small folders that nobody reads before the write has ended."""
    rows.write.mode("append").option(*_MOVED_BY_TASKS).partitionBy(*by).format(fmt).save(root)


def _named(rows: DataFrame, key: str) -> Column:
    """A name of a file or folder for each row: its key, encoded and never hidden, and the row's number among those of the key, so that no two rows share a name."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*(c for c in rows.columns if c != key))).cast("string")
    return F.coalesce(F.concat(F.lit("page-"), F.url_encode(F.col(key).cast("string")), F.lit("-"), place), F.concat(F.lit("none-"), place))


def _unmarked(text: Column) -> Column:
    return F.regexp_replace(text, "^\\uFEFF", "")


def _marked(html: Column) -> Column:
    """Readers drop a byte order mark; a page that begins with one of its own gets another."""
    return F.when(html.startswith("\ufeff"), F.concat(F.lit("\ufeff"), html)).otherwise(html)


def write_corpus(pages: DataFrame, root: str, manifest: str = "manifest.json") -> None:
    """Pages (id, kind, url, html) as files in subfolders, with a manifest of lines, one a page, from the tasks that write the files; ``read_corpus`` reads
    both. A page without html is listed and has no file."""
    name = _named(pages, "id")
    folder = F.lpad(F.pmod(F.xxhash64("id"), F.lit(CORPUS_FOLDERS)).cast("string"), 4, "0")
    rows = pages.withColumn("file", F.concat(F.lit("pages/"), folder, F.lit("/"), name, F.lit(".html"))).withColumn("html", _marked(F.col("html")))
    row = F.struct("id", "kind", F.col("url").alias("sourceUrl"), F.concat(F.lit("./"), "file").alias("file"))
    trees.with_files(rows, root).select(F.array(row).alias("fixtures")).write.option("compression", "gzip").json(f"{root}/{manifest}")


def write_samples(samples: DataFrame, root: str) -> None:
    """Samples (subject_id, url, batch, html) as folders ``{batch}/{sample}``, each with its page and its metadata; ``read_samples`` reads them. A batch is the
    name of a folder that is not hidden. A sample without html has no page, one without a batch stands in the folder ``none``."""
    folder = F.concat(F.coalesce("batch", F.lit("none")), F.lit("/"), _named(samples, "subject_id"))
    rows = samples.withColumn("folder", folder)
    meta = F.to_json(F.struct(F.col("subject_id").alias("subjectId"), F.col("url").alias("sourceUrl"), F.when(F.col("html").isNotNull(), "source.html").alias("sourceHtml")))
    both = F.array(F.struct(F.lit("source.html").alias("name"), _marked(F.col("html")).alias("html")), F.struct(F.lit("metadata.json").alias("name"), meta.alias("html")))
    files = rows.select("folder", F.inline(both)).select(F.concat("folder", F.lit("/"), "name").alias("file"), "html")
    trees.with_files(files, root).write.format("noop").mode("overwrite").save()


#: Endings of files that are never compressed. The text reader looks for a codec for each file, which takes longer than reading it.
_PLAIN_FILES = (".html", ".htm", ".txt", ".json")


def _tree(spark: SparkSession, root: str, *globs: str) -> trees.Tree | None:
    """The root as a tree that tasks list and read, where they can open its files and know the patterns."""
    known = all(g.endswith(_PLAIN_FILES) and not re.search(r"[\[\]{}^\\]", g) for g in globs) and not re.search(r"[*?\[\]{}\\]", root)
    path = trees.located(spark, root) if known else ""
    return trees.listed(spark, path, new_dir(spark, "listed")) if path and trees.is_folder(path) else None


def _whole_files(spark: SparkSession, root: str, glob: str, tree: trees.Tree | None) -> DataFrame:
    """Files at any depth, read whole: value without a byte order mark, and file (the path below the root). Without a tree Spark lists and reads them."""
    if tree:
        found, value, file = tree.with_bodies(tree.named(glob), "file", "value"), F.col("value"), F.col("file")
    else:
        plain = glob.endswith(_PLAIN_FILES)
        with _listing(spark):
            reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            found = reader.format("binaryFile").load(root) if plain else reader.text(root, wholetext=True)
        value, file = F.col("content").cast("string") if plain else F.col("value"), _below(F.col("_metadata.file_path"), root)
    return found.select(_unmarked(value).alias("value"), file.alias("file"))


def _with_pages(rows: DataFrame, root: str, glob: str, tree: trees.Tree | None) -> DataFrame:
    """``rows`` with the html of their file, null where there is none."""
    if not tree:
        return rows.join(_whole_files(rows.sparkSession, root, glob, None).withColumnRenamed("value", "html"), "file", "left")
    found = rows.join(tree.named(glob).select("file", F.col("file").alias("_at")).hint("merge"), "file", "left")  # a list is small as a file, not in memory
    return tree.with_bodies(found, "_at", "html").withColumn("html", _unmarked(F.col("html"))).drop("_at")


def page_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Page files at any depth, read whole: html without a byte order mark, and file (the path below the root)."""
    return _whole_files(spark, root, glob, _tree(spark, root, glob)).withColumnRenamed("value", "html")


def read_corpus(spark: SparkSession, root: str, manifest: str = "manifest.json", glob: str = "*.html", lines: bool = False) -> DataFrame:
    """Pages of a captured corpus: the manifest's rows with ``html``, joined by the file's path below the root.

    A row whose file is absent keeps its place with null html, so that a loss shows. ``./`` before a path does not count. A large
    manifest may be a folder of ``lines``, each an object with some of the fixtures.
    """
    listed = spark.read.schema(FIXTURES).option("multiLine", not lines).json(f"{root}/{manifest}").select(F.explode("fixtures").alias("f")).select("f.*")
    listed = listed.withColumn("file", F.regexp_replace("file", "^(\\./)+", ""))
    return _with_pages(listed, root, glob, _tree(spark, root, glob)).withColumnRenamed("sourceUrl", "url")


def read_samples(spark: SparkSession, root: str, glob: str = "*.html", metadata: str = "metadata.json") -> DataFrame:
    """Sample folders ``.../{batch}/.../metadata.json`` with the html beside it: subject_id, url, batch, html.

    The source html is preferred to the captured one, a byte order mark is dropped, and the batch is the first folder below the root.
    A sample without its page keeps null html.
    """
    tree = _tree(spark, root, glob, metadata)
    found = _whole_files(spark, root, metadata, tree).where(F.col("value").rlike("[^ \t\r\n]"))
    parsed = F.coalesce(F.from_json("value", T.ArrayType(SAMPLE)), F.array(F.lit(None).cast(SAMPLE)))  # what is broken keeps a row
    meta = found.select(F.col("file").alias("path"), F.inline(parsed))
    folder = F.regexp_replace("path", "[^/]*\\z", "")
    rows = meta.withColumn("file", F.concat(folder, F.coalesce("sourceHtml", "domHtml"))).withColumn("batch", F.split("path", "/")[0])
    return _with_pages(rows, root, glob, tree).select(F.col("subjectId").alias("subject_id"), F.col("sourceUrl").alias("url"), "batch", "html")


def sample_order(samples: DataFrame) -> DataFrame:
    """By the subject's number, then by its text."""
    return samples.orderBy(F.col("subject_id").try_cast("long"), "subject_id")


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """Review manifests with the file they stand in, so that the last decision of a key is a defined one."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))


def write_review(rows: DataFrame, path: str) -> None:
    """One manifest a row, a line each; ``read_manifest_lines`` reads them again."""
    rows.write.mode("overwrite").json(path)


def read_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows, one a line, as ``write_review`` writes them."""
    return spark.read.schema(_DECISION.elementType).json(path)


#: Stands alone on a line between the entries of a text export; outside of entries, bibliography readers skip it.
ENTRY_END = "\n\x1e\n"


def write_text_export(records: DataFrame, path: str, fmt: str) -> None:
    """One entry a record, as text files, entries apart by a line with the record separator, which becomes a space within entries."""
    entry = F.replace("payload_text", F.lit("\x1e"), F.lit(" "))
    records.where((F.col("format") == fmt) & entry.isNotNull()).select(entry.alias("value")).write.mode("overwrite").option("lineSep", ENTRY_END).text(path)


def read_text_export(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a text export, with all their lines."""
    return spark.read.option("lineSep", ENTRY_END).text(path).select(F.col("value").alias("entry"))


def comparison_rows(records: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Comparison records (id, url, html, rule_json, model_json) as raw, rule-cleaned and model-cleaned rows."""
    html = F.coalesce(F.nullif("html", F.lit("")), F.concat_ws("\n", "url", "id"))
    raw_id = F.concat(F.lit("raw-"), "id")
    raw = records.select(raw_id.alias("raw_record_id"), F.lit(run_id).alias("scrape_run_id"), raw_id.alias("internal_id"), F.col("url").alias("source_url"), F.col("html").alias("raw_html"), F.sha2(html, 256).alias("raw_html_sha256"))
    cleaned = lambda kind, col: records.where(F.col(col).isNotNull()).select(F.concat(F.lit(f"{kind}-"), "id").alias("cleaned_record_id"), F.lit(f"{run_id}-{kind}").alias("cleaning_run_id"), raw_id.alias("raw_record_id"), F.concat(F.lit(f"{kind}-"), "id").alias("internal_id"), F.col(col).alias("cleaned_json"))
    return raw, cleaned("rule", "rule_json"), cleaned("model", "model_json")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()])


def status_counts(rows: DataFrame, run: str, status: str = "status") -> DataFrame:
    """Counts by run and status, with a line of each run's total (status null) and one of all."""
    return rows.rollup(run, status).agg(F.count("*").alias("n"))
