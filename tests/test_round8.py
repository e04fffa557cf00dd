import gzip
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfmark.sources import store

#: Of one key twice, with equal and with other rows; of none; below zero; without text, with none, with a mark of its own, with line breaks.
ODD = [(1, "u1", "one"), (1, "u1", "one"), (1, "u0", "other"), (1, None, None), (None, "n", "no key"), (None, "n2", None), (-4, "u-4", "below"), (2, "u2", None), (3, "u3", ""), (4, "u4", "\ufeffmark"), (5, "a b%20+&é\"'", "\r\nlines\r\n\n"), (6, "u6", "\ufeff")]


def written(root):
    return [os.path.join(d, f) for d, _, names in os.walk(root) for f in names]


def equal_to_sql(spark, name, folder):
    got = entry.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]}) x").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_sample_folders_of_odd_pages(spark, tmp_path):
    spark.createDataFrame(ODD, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    equal_to_sql(spark, "s2_sample_folders", str(tmp_path))


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_samples_are_written_by_one_call_a_file(spark, tmp_path, scheme):
    """A page and its metadata in a folder of their own, and nothing beside them: no checksums, no folders of tasks; written again they are replaced."""
    root = f"{scheme}{tmp_path}/tree"
    ids = ["12", "12", "12-2", "a/b", "../c", "_d", ".e", "f g%20", "", None]
    rows = spark.createDataFrame([(x, f"u{i}", f"b{i % 2}", f"<p>{i}\n</p>") for i, x in enumerate(ids)], "subject_id string, url string, batch string, html string")
    for _ in range(2):
        store.write_samples(rows, root)
        files = written(tmp_path)
        assert len(files) == 2 * len(ids) and {os.path.basename(f) for f in files} == {"source.html", "metadata.json"}
        assert len({os.path.dirname(f) for f in files}) == len(ids)
        assert sorted(map(tuple, store.read_samples(spark, root).collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)


def test_files_with_whole_texts(spark, tmp_path):
    """Whole files are read as they are but for a mark; metadata may be an array, may begin with a mark, may be broken or empty."""
    meta = {"a": '\ufeff{"subjectId": "1", "domHtml": "dom.html"}', "b": '[{"subjectId": "2", "sourceHtml": "x.html"}, {"subjectId": "3"}]', "c": '{"subjectId": ', "d": " \n", "e": "[]", "f": ""}
    for name, text in meta.items():
        (tmp_path / "t" / name).mkdir(parents=True)
        (tmp_path / "t" / name / "metadata.json").write_text(text, encoding="utf-8")
    (tmp_path / "t" / "a" / "dom.html").write_text("\ufeff\ufeff")
    (tmp_path / "t" / "b" / "x.html").write_bytes(b"\r\nx\r")
    got = sorted((tuple(r) for r in store.read_samples(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([("1", None, "t", "\ufeff"), ("2", None, "t", "\r\nx\r"), ("3", None, "t", None), (None, None, "t", None)], key=repr)
    for glob, plain in (("*.html", "MapInArrow"), ("{x,dom}.html", "content")):  # no codec is looked for
        assert plain in store.page_files(spark, str(tmp_path), glob)._jdf.queryExecution().optimizedPlan().toString()
    assert store.page_files(spark, str(tmp_path), "*.gz").columns == ["html", "file"]


def test_corpus_of_odd_pages(spark, tmp_path):
    spark.createDataFrame(ODD, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    equal_to_sql(spark, "s1_corpus_pages", str(tmp_path))


def test_corpus_is_written_in_one_pass(spark, tmp_path):
    """A file for each page that has html, in a bounded number of folders; the manifest comes from the tasks that write them."""
    ids = ["12", "12", "12-1", "a/b", "../c", "_d", ".e", "f g%20+", "", None, "gone"]
    rows = spark.createDataFrame([(x, "subject-page", f"u{i}", f"<p>{i}\n</p>" if x != "gone" else None) for i, x in enumerate(ids)], "id string, kind string, url string, html string")
    store.write_corpus(rows, str(tmp_path))
    files = [f for f in written(tmp_path) if f.endswith(".html")]
    assert len(files) == len(ids) - 1 and not [f for f in written(tmp_path / "pages") if f not in files]
    got = store.read_corpus(spark, str(tmp_path), lines=True).select("id", "kind", "url", "html")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)


def test_trees_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver lists no folder; pages go to many tasks and through no join; Spark's own listing, used for other patterns and file systems, finds the same."""
    names = ["a/source.html", "a/deep/x y%20+.html", "top.html", "_c/x.html", ".d/x.html", "k=1/_x.html", "k=1/_x=.html", "_k=1/x.html", "a/x.htmlx", "a/xhtml", "e/none.html", "a/s.txt"]
    for name in names:
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text("" if "none" in name else name)
    (tmp_path / "link").symlink_to(tmp_path / "t")
    spark.conf.set("fs.viewfs.mounttable.shelf.link./in", f"file://{tmp_path}")
    roots = [f"{tmp_path}/t", f"file://{tmp_path}/t/", f"{tmp_path}/link", "viewfs://shelf/in/t"]
    read = lambda root, glob: sorted(tuple(r) for r in store.page_files(spark, root, glob).select("file", "html").collect())
    found = {(root, glob): read(root, glob) for root in roots for glob in ("*.html", "?our*.html")}
    (tmp_path / "t" / "packed.txt.gz").write_bytes(gzip.compress(b"packed"))
    assert read(roots[0], "*.gz") == [("packed.txt.gz", "packed")]
    read_by_spark = read(roots[0], "{*,none}.html")
    monkeypatch.setattr(store.trees, "is_folder", lambda path: False)
    for root in (roots[0], roots[1]):
        assert found[root, "*.html"] == read(root, "*.html") == read_by_spark
    for root in roots:
        assert found[root, "*.html"] == found[roots[0], "*.html"] and found[root, "?our*.html"] == [("a/source.html", "a/source.html")]
    assert len(read_by_spark) == 5


def test_pages_are_not_joined(spark, tmp_path):
    rows = spark.range(30).select(F.col("id").cast("string").alias("subject_id"), F.lit("u").alias("url"), F.lit("b").alias("batch"), F.lit("<p>").alias("html"))
    store.write_samples(rows, str(tmp_path))
    got = store.read_samples(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Scan binaryFile" not in plan and plan.index("MapInArrow") < plan.index("SortMergeJoin")
    assert got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and got.where("html = '<p>'").count() == 30
