"""Goldens of the catalog operators, and every registered query against its SQL on the smallest tables."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfmark.functions import creators as cr
from shelfmark.functions import normalize as nz
from shelfmark.functions import text as tx
from shelfmark.operators import coverage, exports, lists, matching, merge, pages, validate, volumes
from shelfmark.plans import queries as catalog
from shelfmark.schemas import BOOK, TABLES
from shelfmark.sources import store

SF = "/root/testdata/sf0.001"
PAGE = """<html><head><title>河谷纪事 (Catalog)</title></head><body><h1><span>河谷纪事</span></h1><div id="mainpic"><img src="https://img.example.invalid/valley.png"></div>
<div id="info"><span class="pl">作者:</span> <a href="#">[丹] 尼尔斯·克罗格（Niels Krogh）</a><br/><span class="pl">出版社:</span> 山城书局<br><span class="pl">副标题:</span> 水与路<br>
<span class="pl">原作名:</span> Dalen<br><span class="pl">译者</span>: 李四<br><span class="pl">出版年:</span> 2019-7<br><span class="pl">页数:</span> 208<br><span class="pl">语言:</span> zh<br>
<span class="pl">丛书:</span>&nbsp;<a href="#">河流丛书</a><br><span class="pl">ISBN:</span> 9780306406157<br></div><div id="link-report"><div class="intro">短文。</div><span class="all hidden"><div class="intro">全文。</div></span></div></body></html>"""


def one(spark, column, *values):
    names_ = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} string" for n in names_)
    return spark.createDataFrame([values], schema).select(column(*(F.col(n) for n in names_)).alias("r")).first()["r"]


DATES = {"1987": "1987", "1987.11": "1987-11", "1987-9": "1987-09", "1987/9/8": "1987-09-08", "1987-09-8": "1987-09-08", "1987年冬": "1987", "1987年9月": "1987-09", "1987-14": "", "1987年9月8日": "1987-09-08", "1987-02-29": "", "undated": "", "": "", "19870908": "1987", "0000": "", "1988-2-29": "1988-02-29"}


def test_dates(spark):
    got = spark.createDataFrame([(k,) for k in DATES], "d string").select("d", nz.publication_date(F.col("d")).alias("r")).collect()
    assert {x["d"]: x["r"] for x in got} == DATES


@pytest.mark.parametrize("raw,want", [("0306406152", "9780306406157"), ("978-0-306-40615-7", "9780306406157"), ("0-19-853453-1", "9780198534532"), ("", None), ("123", None), ("978　0306406157", "9780306406157"), ("080442957X", "9780804429573")])
def test_isbn(spark, raw, want):
    assert one(spark, nz.isbn13, raw) == want


# a name under the author label: first name, last name, role, mode
NAMES = [
    ("[挪威/瑞典] 奥拉·林德", [("奥拉", "林德", "author", 0)]), ("贝娅塔．霍尔姆", [("贝娅塔", "霍尔姆", "author", 0)]), ("河谷水利“三·八”编辑部", [("", "河谷水利“三八”编辑部", "author", 1)]), ("河谷水利“三八”编辑部", [("", "河谷水利“三八”编辑部", "author", 1)]),
    ("小林樹/小林树", [("", "小林樹", "author", 1)]), ("小林树/小林樹", [("", "小林樹", "author", 1)]), ("佐伯　陽一", [("", "佐伯陽一", "author", 1)]), ("[丹]尼尔斯·克罗格 等", [("尼尔斯", "克罗格", "author", 0)]), ("山城自然博物馆 供图", [("", "山城自然博物馆", "author", 1)]),
    ("[丹] 尼尔斯·克罗格 编绘 / [丹] 尼尔斯·克罗格", [("尼尔斯", "克罗格", "author", 0)]), ("李四 点校", [("", "李四", "contributor", 1)]), ("Mary K. Okafor", [("Mary K.", "Okafor", "author", 0)]), ("", []), (" / ", []), ("Ole Berg (eds.)", [("Ole", "Berg", "editor", 0)]),
    ("奥拉·林德 / Ola Lind", [("奥拉", "林德", "author", 0)]), ("Ola Lind、Ida Dahl", [("Ola", "Lind", "author", 0), ("Ida", "Dahl", "author", 0)]), ("李四，王五 译", [("", "李四", "author", 1), ("", "王五", "translator", 1)]), ("Prince", [("", "Prince", "author", 1)]),
]


def test_creators(spark):
    rows = spark.createDataFrame([(raw,) for raw, _ in NAMES], "raw string")
    made = cr.with_names(rows, cr.name_list(F.col("raw"), F.lit("author"))).select("raw", cr.preferred(F.col("names")).alias("c"))
    got = {r["raw"]: [(c["first_name"], c["last_name"], c["creator_type"], c["field_mode"]) for c in r["c"]] for r in made.collect()}
    assert got == dict(NAMES)


def test_page_people(spark):
    """Lists of a page: fixed labels first, copies and role aliases gone, linked authors only where no list has one, notes kept once."""
    pages_ = [
        ("a", [("编者", "李四"), ("作者", "李四 / 尼尔斯·克罗格（Niels Krogh）"), ("译者", "王五"), ("编辑", "赵六、李四")], ["Someone Else"]),
        ("b", [("译者", "王五（Wu Wang）"), ("校注", "王五（Wu Wang）"), ("页数", "7")], ["李四/Ida Dahl", "", "李四"]), ("c", [], []), ("d", [("作者", "奥拉·林德（挪威）")], []),
    ]
    rows = spark.createDataFrame(pages_, "k string, entries array<struct<label:string,value:string>>, anchors array<string>")
    made = cr.page_people(rows, cr.page_lists(F.col("entries"), F.col("anchors")))
    got = {r["k"]: ([(c["first_name"] + "|" + c["last_name"], c["creator_type"]) for c in r["creators"]], r["notes"]) for r in made.collect()}
    assert got["a"] == ([("|李四", "author"), ("尼尔斯|克罗格", "author"), ("|王五", "translator"), ("|赵六", "editor")], ["Niels Krogh"])
    assert got["b"] == ([("|王五", "translator"), ("|王五", "contributor"), ("|李四", "author")], ["Wu Wang"])
    assert got["c"] == ([], []) and got["d"] == ([("奥拉|林德", "author")], [])


def test_name_columns(spark):
    assert one(spark, cr.nationality, "（挪）林德") == "挪" and one(spark, cr.remove_nationality, "[挪] 林德") == "林德"
    assert one(spark, lambda c: cr.role_suffix(c)["role"], "李四 主编") == "editor" and one(spark, lambda c: cr.original_name(c)["original"], "林德（Lind）") == "Lind"
    assert one(spark, cr.is_east_asian, "佐伯 陽一") and not one(spark, cr.is_east_asian, "Ida")


def test_page(spark):
    rows = spark.createDataFrame([("https://book.example.org/subject/1000001/", PAGE), ("u2", "<p>"), ("u3", None)], "url string, html string")
    got = {r["url"]: r for r in validate.with_validation(pages.books(rows)).collect()}
    b = got["https://book.example.org/subject/1000001/"]["book"]
    assert (b["title"], b["publisher"], b["publish_date"], b["isbn13"], b["series"], b["abstract_note"], b["cover_url"], b["creator_notes"]) == ("河谷纪事：水与路", "山城书局", "2019-07", "9780306406157", "河流丛书", "全文。", "https://img.example.invalid/valley.png", ["Niels Krogh"])
    assert [(c["first_name"], c["last_name"], c["creator_type"]) for c in b["creators"]] == [("尼尔斯", "克罗格", "author"), ("", "李四", "translator")]
    assert got["https://book.example.org/subject/1000001/"]["status"] == "valid"
    assert got["u2"]["parse_error"] == got["u3"]["parse_error"] == "missing-info-block" and got["u2"]["book"] is None


def test_subtitle(spark):
    assert one(spark, pages.merge_subtitle, "Dry Stone", "Walls and Roads") == "Dry Stone: Walls and Roads"
    assert one(spark, pages.merge_subtitle, "河谷纪事：水与路", "水与路") == "河谷纪事：水与路" and one(spark, pages.merge_subtitle, "河谷纪事", " ") == "河谷纪事"


def test_urls(spark):
    assert one(spark, tx.cache_key, "/subject/1000001/?b=2&a=1#frag") == one(spark, tx.cache_key, "https://book.example.org/subject/1000001/?a=1&b=2") != one(spark, tx.cache_key, "/subject/1000001/")
    assert one(spark, tx.strict_subject_url, "//book.example.org/subject/5?x=1") == "https://book.example.org/subject/5/" and one(spark, tx.strict_subject_url, "https://else.example.org/subject/5/") is None
    assert one(spark, lambda c: tx.page_url(c, F.lit(30)), "https://h/wish?start=15&x=1") == "https://h/wish?x=1&start=30" and one(spark, tx.start_offset, "https://h/w?start=45") == 45
    assert one(spark, tx.bib_escape, "a\\{b}") == "a\\textbackslash\\{\\}\\{b\\}"


# key, book (title, publisher, date, isbn, isbn13), item (title, publisher, isbn, date), what they are
SCENARIOS = [
    (1, "River", "Quay", "1990", None, "9780306406157", "Another", "Quay", "9780306406157", "1990", "duplicate"), (2, "River", "Quay", "1990", "0198534531", None, "Another", "Quay", "9780198534532", "1991", "duplicate"),
    (3, "Walls of the Northern Valley", "Quay", "1990", None, None, "Walls of the Northern Valley", "Quay", None, "1990", "duplicate"), (4, "Walls and Roads", "Hill House Editions", "2011", None, None, "Walls and Roads", "Quay", None, "1973", "new"),
    (5, "Northern Valley Walking Notes", "Quay and Sons", "1990", None, None, "Northern Valley Walking Letters", "Quay and Sons", None, "1990", "suspect"),
]


def test_matching(spark):
    for s in SCENARIOS:
        books = spark.createDataFrame([s[:6]], "book_key long, title string, publisher string, publish_date string, isbn string, isbn13 string")
        library = spark.createDataFrame([(s[0], *s[6:10])], "item_id long, title string, publisher string, isbn string, date string")
        assert matching.check_duplicates(books, library).first()["match_type"] == s[10], s


def test_lists(spark):
    link = lambda i: f'<a title="Book {i}" href="https://book.example.org/subject/{i}/">x</a>'
    page = lambda a, b, n, nxt: f'<span class="subject-num">{a}-{b} / {n}</span>' + "".join(map(link, range(a, b + 1))) + (f'<span class="next"><a href="{nxt}&amp;x">n</a></span>' if nxt else "")
    rows = spark.createDataFrame([("u", 0, "p0", page(1, 15, 17, "/p1?a=1")), ("u", 1, "p1", page(15, 16, 17, None))], "uid string, page int, url string, html string").withColumn("d", lists.page_diagnostics(F.col("html")))
    links, summary = lists.assemble(rows)
    assert links.count() == 16 and rows.orderBy("page").first()["d"]["next_url"] == "https://book.example.org/p1?a=1&x"
    kinds = [w.split(":")[0] for w in lists.completeness_warnings(summary).first()["warnings"]]
    assert "readlist-duplicate-visible-links" in kinds
    series = '<h1>Fixture Series</h1><div class="subject-list"><a href="https://book.example.org/subject/7/">One</a></div> <div class="paginator">册数: 3'
    assert one(spark, lambda h: lists.series_info(h)["name"], series) == "Fixture Series" and one(spark, lambda h: F.size(lists.series_links(h)), series) == 1 and one(spark, lambda h: lists.series_info(h)["count"], series) == 3
    assert [x["position"] for x in one(spark, lists.dom_links, link(4) + link(4) + link(9))] == [1, 2]


def _pages(spark, rows):
    """Rows (list, page, url, link numbers, total, has_next) as diagnosed pages."""
    made = [(u, p, url, ([{"url": f"s{k}", "title": f"t{k}"} for k in ks], total, more, len(ks))) for u, p, url, ks, total, more in rows]
    return spark.createDataFrame(made, "uid string, page int, url string, d struct<links:array<struct<url:string,title:string>>,total:int,has_next:boolean,visible:int>").repartition(3)


def test_assembly_of_long_lists(spark):
    n, many = 4000, 267
    rows = [("hot", p, f"h{p}", [*range(15 * p, min(n, 15 * p + 15)), 0], n, p < many - 1) for p in range(many)] + [("small", 0, "s0", [1, 2], 2, False)]
    links, summary = lists.assemble(_pages(spark, rows))
    got = {(r["uid"], r["position"]): r["url"] for r in links.collect()}
    assert got == {("hot", k + 1): f"s{k}" for k in range(n)} | {("small", 1): "s1", ("small", 2): "s2"}
    assert {r["uid"]: (r["pages"], r["visible"], r["unique_links"]) for r in summary.collect()} == {"hot": (many, n + many, n), "small": (1, 2, 2)}
    assert lists.assemble(_pages(spark, rows), most_pages=200)[1].where("uid = 'hot'").first()["unique_links"] == 3000


def test_assembly_stops(spark):
    rows = [("empty", 0, "a", [1, 2], 9, True), ("empty", 1, "b", [], 9, True), ("empty", 2, "c", [3], 9, True), ("loop", 0, "a", [1], 0, True), ("loop", 1, "a", [2], 0, True), ("loop", 2, "b", [3], 0, True)]
    rows += [("last", 0, "a", [2, 1], 0, True), ("last", 1, "b", [1, 3], 8, False), ("last", 2, "c", [4], 8, False), ("total", 0, "a", [1], 2, True), ("total", 1, "b", [2], 3, True), ("total", 2, "c", [5], 2, True), ("copy", 0, "a", [1], 0, True), ("copy", 0, "a", [1], 0, True), ("copy", 1, "b", [2], 0, False)]
    links, summary = lists.assemble(_pages(spark, rows))
    got = {}
    for r in sorted(links.collect(), key=lambda r: (r["uid"], r["position"])):
        got.setdefault(r["uid"], []).append(r["url"])
    assert got == {"empty": ["s1", "s2"], "loop": ["s1"], "last": ["s2", "s1", "s3"], "total": ["s1", "s2"], "copy": ["s1"]}
    found = {r["uid"]: (r["total"], r["pages"], r["visible"], r["unique_links"], r["loop_url"], r["other_totals"]) for r in summary.collect()}
    assert found == {"empty": (9, 2, 2, 2, None, []), "loop": (0, 1, 1, 1, "a", []), "last": (8, 2, 4, 3, None, []), "total": (2, 2, 2, 2, None, [3]), "copy": (0, 1, 1, 1, "a", [])}


def test_series_assembly(spark):
    page = lambda ks, count, more: "<h1>S</h1>" + '<div class="subject-list">' + "".join(f'<a href="https://book.example.org/subject/{k}/">V{k}</a>' for k in ks) + '</div> <div class="paginator">' + (f"册数: {count}" if count else "") + ('<span class="next"><a href="?">n</a></span>' if more else "")
    rows = [("loop", 0, "a", page([1, 2], 0, True)), ("loop", 1, "b", page([2, 1], 5, True)), ("loop", 2, "c", page([3], 0, True)), ("full", 0, "a", page([1, 2], 3, True)), ("full", 1, "b", page([2, 4], 0, True)), ("full", 2, "c", page([5], 0, False))]
    rows += [("less", 0, "a", page([1], 4, True)), ("less", 1, "b", page([2], 9, False)), ("none", 0, "a", page([], 4, True)), *(("long", p, str(p), page([p], 60, p < 59)) for p in range(60))]
    volumes_, summary = lists.assemble_series(spark.createDataFrame(rows, "series string, page int, url string, html string"))
    got = {r["series"]: tuple(r)[1:] for r in summary.collect()}
    assert got == {"loop": ("S", None, 2, 2, False), "full": ("S", 3, 2, 3, False), "less": ("S", 4, 2, 2, True), "none": ("S", 4, 1, 0, True), "long": ("S", 60, 60, 60, False)}
    assert [r["title"] for r in volumes_.where("series = 'full'").orderBy("position").collect()] == ["V1", "V2", "V4"]


def test_memberships_are_rows(spark):
    rows = [("a", "", "l1", 1), ("b", "B", "l1", 2), ("a", "A", "l2", 2), ("a", "x", "l2", 1), ("a", "y", "l0", 5), ("a", "", None, 7)]
    links = spark.createDataFrame(rows, "url string, title string, uid string, position int").withColumn("seq", F.struct("uid", "position")).withColumn("source", F.col("seq"))
    merged = {r["url"]: (r["title"], r["n_sources"], r["first_source"]["uid"]) for r in lists.merge_candidates(links.where("uid > 'l0'")).collect()}
    assert merged == {"a": ("x", 3, "l1"), "b": ("B", 1, "l1")}
    found = {(r["url"], r["position"]): tuple(r["source"]) for r in lists.candidate_sources(links, "uid", "position").collect()}
    assert found == {("a", 1): (None, 7), ("a", 2): ("l0", 5), ("a", 3): ("l1", 1), ("a", 4): ("l2", 1), ("a", 5): ("l2", 2), ("b", 1): ("l1", 2)}
    samples = spark.createDataFrame([("1", "old", ["x", "y", "x"]), ("2", "new", ["x"]), ("2", "new", [])], "subject_id string, cohort string, labels array<string>")
    assert sorted(map(tuple, coverage.label_subjects(samples).collect())) == [("x", "1"), ("x", "2"), ("y", "1")]
    assert sorted(map(tuple, coverage.label_coverage(samples, ("old", "new")).collect())) == [("x", 2, 1, 1), ("y", 1, 1, 0)]


def test_model_values(spark):
    v = lambda f: one(spark, lambda c: f(merge.json_object(c)), 'x {"pages": 3, "title": " a ", "creators": [{"creatorType": "author", "lastName": "L"}, {"creatorType": "x", "lastName": "L"}, 5], "creatorNotes": ["n", 1, ""]} y')
    assert v(lambda m: merge.variant_string(m, "$.pages")) is None and v(lambda m: merge.variant_string(m, "$.title")) == "a"
    assert [c["last_name"] for c in v(merge.clean_creators)] == ["L"] and v(lambda m: merge.clean_strings(m, "$.creatorNotes")) == ["n"]


def test_payload_and_table(spark, tmp_path):
    book = spark.createDataFrame([tuple([None] * len(BOOK.fields))], BOOK).select(F.struct("*").alias("book"))
    got = book.select(validate.payload_warnings(exports.payload(F.col("book"))).alias("w")).first()["w"]
    assert "missing-title" in got and "creators-not-array" in got and "missing-url" in got
    store.write_table(spark.createDataFrame([("r1", "dry-run")], "run_id string, execution_mode string"), str(tmp_path), "pipeline_runs")
    back = store.read_table(spark, str(tmp_path), "pipeline_runs")
    assert back.first()["run_id"] == "r1" and back.columns == TABLES["pipeline_runs"].fieldNames()
    assert validate.check_tables({"pipeline_runs": back.unionByName(back)}).first()["rule"] == "primary:pipeline_runs"


def test_corpus(spark, tmp_path):
    """Pages in subfolders, of several lines, with a mark at the start; a listed file that is absent shows as null."""
    (tmp_path / "pages" / "a b").mkdir(parents=True)
    (tmp_path / "pages" / "a b" / "i.html").write_text("\ufeff<p>x\ny</p>\n", encoding="utf-8")
    (tmp_path / "i.html").write_text("<p>top</p>", encoding="utf-8")
    files = ["pages/a b/i.html", "./i.html", "gone.html"]
    (tmp_path / "manifest.json").write_text(json.dumps({"fixtures": [{"id": f, "kind": "subject-page", "sourceUrl": "u", "file": f} for f in files]}, indent=1))
    for root in (str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/"):
        got = {r["id"]: r["html"] for r in store.read_corpus(spark, root).collect()}
        assert got == dict(zip(files, ["<p>x\ny</p>\n", "<p>top</p>", None], strict=True))


def test_sample_folders(spark, tmp_path):
    for batch, subject, own, html in (("b1", "10", {"sourceHtml": "source.html", "domHtml": "dom.html"}, "one"), ("b1", "9", {"domHtml": "dom.html"}, "two"), ("b2", "x", {"sourceHtml": "none.html"}, None)):
        folder = tmp_path / batch / "deep" / subject
        folder.mkdir(parents=True)
        (folder / "metadata.json").write_text(json.dumps({"subjectId": subject, "sourceUrl": f"u{subject}", **own}, indent=2))
        if html:
            (folder / own.get("sourceHtml", "dom.html")).write_text(html)
        if "sourceHtml" in own:
            (folder / "dom.html").write_text("captured")
    got = [tuple(r) for r in store.sample_order(store.read_samples(spark, str(tmp_path))).collect()]
    assert sorted(got, key=repr) == sorted([("10", "u10", "b1", "one"), ("9", "u9", "b1", "two"), ("x", "ux", "b2", None)], key=repr)
    assert [r[0] for r in got if r[0] != "x"] == ["9", "10"]


def test_review_order(spark, tmp_path):
    """Of a key's decisions the last file's last one counts."""
    for name, decisions in (("a.json", ["accept", "skip"]), ("b.json", ["skip", "accept", "later"])):
        (tmp_path / name).write_text(json.dumps({"decisions": [{"model_record_id": "m", "decision": d, "notes": f"{name}{i}"} for i, d in enumerate(decisions)]}))
    assert [tuple(r) for r in merge.review_decisions(store.read_review(spark, f"{tmp_path}/*.json").repartition(2)).collect()] == [("m", "accept", "b.json1")]


def test_plans_parse_once(spark):
    """One pass of the page helper in each query over parsed pages, however often it uses them; no product joins."""
    for name in ("e7_book_records", "s5_export_records", "a7_label_coverage", "a8_surface_coverage", "w9_golden_candidates", "w10_review_candidates", "x1_labels_of_one_cohort", "j3_check_duplicates"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == (1 if name[0] in "es" or name[:2] in ("a7", "a8") else 0), name
        physical = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
        assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical


def test_volumes(spark):
    got = volumes.generated_volumes(spark.createDataFrame([("S", 2)], "series string, count int")).collect()
    assert [(r["volume_number"], r["title"]) for r in got] == [("01", "S 01"), ("02", "S 02")]
    assert one(spark, nz.volume_number, "卷123.pdf") == "123" and one(spark, nz.volume_number, "x.pdf") is None and one(spark, nz.volume_number, "卷v07.epub") == "07"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(pdf):
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)
    return sorted((tuple(plain(v) for v in r) for r in pdf[sorted(pdf.columns)].astype(object).where(pdf.notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["total"] == row["new"] + row["duplicate"] + row["suspect"]
