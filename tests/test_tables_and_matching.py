"""Tables that are written again, packed captures, pages that change, logs, long lists, crowded titles and broken pages."""

import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import lists, matching, pagehtml, validate
from shelfmark.plans import storage
from shelfmark.schemas import PRIMARY, RUN_OF
from shelfmark.sources import packed, store
from shelfmark.streaming import intake

from .test_catalog import PAGE, SF

# ---- the nine tables


def test_replaced_and_merged_runs(spark, tmp_path):
    root, name = str(tmp_path), "cleaned_records"
    rows = lambda *rs: spark.createDataFrame(rs, "cleaned_record_id string, cleaning_run_id string, cleaned_json string")
    read = lambda: sorted((r["cleaned_record_id"], r["cleaning_run_id"], r["cleaned_json"]) for r in store.read_table(spark, root, name).collect())
    assert store.replace_runs(rows(("a", "r1", "1"), ("b", "r1", "1"), ("c", "r/2 ü", "1")), root, name) == {"n": 3}
    for _ in range(2):  # a write that is tried again leaves no second copy
        store.replace_runs(rows(("a", "r1", "2")), root, name)
    assert read() == [("a", "r1", "2"), ("c", "r/2 ü", "1")]
    for _ in range(2):  # c moves to another run, whose own rows stay; its old run is left without rows; of two new rows of a key one stays
        store.upsert(rows(("c", "r1", "3"), ("d", "r3", "3"), ("d", "r3", "4")), root, name)
    assert read() == [("a", "r1", "2"), ("c", "r1", "3"), ("d", "r3", "4")]
    store.upsert(rows(), root, name)
    assert len(read()) == 3
    with pytest.raises(Exception, match="without cleaning_run_id"):
        store.replace_runs(rows(("e", None, "5")), root, name)
    assert len(read()) == 3


def test_counts_come_with_the_write(spark, tmp_path):
    rows = spark.createDataFrame([(f"m{i}", "r", "prepared" if i % 3 else "skipped") for i in range(10)], "import_record_id string, import_run_id string, status string")
    assert store.replace_runs(rows, str(tmp_path), "import_records", ("prepared", "skipped", "failed"), "status") == {"n": 10, "prepared": 6, "skipped": 4, "failed": 0}


def test_constraints_in_one_pass(spark):
    """Every rule has a fault of its own, and the plan reads each table once and shuffles once."""
    tables = storage.faulty_tables(spark, SF)
    found = validate.check_tables(tables)
    rules = {r["rule"] for r in found.select("rule").distinct().collect()}
    assert {f"primary:{t}" for t in PRIMARY} <= rules and len(rules) == 9 + 4 + 12 + 4 + 1
    assert validate.check_tables(storage.nine_tables(spark, SF)).count() == 0
    plain = spark.range(3).select(F.col("id").cast("string").alias("run_id"), F.lit("dry-run").alias("execution_mode"))
    plan = validate.check_tables({"pipeline_runs": plain})._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange", plan)) <= 1
    assert all(RUN_OF[t] for t in PRIMARY)


def test_text_export_of_any_lines(spark, tmp_path):
    entries = ["@book{a,\n  title = {One},\n  abstract = {First.\n\nSecond.\n\n\nThird.}\n}", "@book{b,\n  title = {}\n}\n", "\n\n@book{c}", "x\x1ey", None]
    rows = spark.createDataFrame([("bibtex", e) for e in entries] + [("biblatex", "other")], "format string, payload_text string")
    store.write_text_export(rows, f"{tmp_path}/x", "bibtex")
    assert sorted(r["entry"] for r in store.read_text_export(spark, f"{tmp_path}/x").collect()) == sorted([*entries[:3], "x y"])


# ---- packed captures


def test_packed_captures(spark, tmp_path):
    packed.register(spark)
    path = f"{tmp_path}/archive"
    pages = [(str(i), f"https://a.example/{i}", "k" if i % 2 else None, ["<p>é\n\n", "", None, "x" * 5_000][i % 4]) for i in range(400)]
    df = spark.createDataFrame(pages, "id string, url string, kind string, html string")
    df.coalesce(3).write.format("packed-pages").mode("append").save(path)
    assert len(list(Path(path).glob("*.pages"))) == 3  # as many as tasks, however many pages
    read = lambda **o: spark.read.format("packed-pages").options(**o).load(path)
    assert sorted(map(repr, map(tuple, read().collect()))) == sorted(map(repr, pages))
    small = read(splitBytes=10_000)
    assert small.rdd.getNumPartitions() > 20 and small.count() == 400
    assert sorted(r["id"] for r in spark.read.format("packed-pages").schema("id string").load(path).collect()) == sorted(p[0] for p in pages)
    # metadata alone reads no body: an archive whose bodies are overwritten still gives it
    for file in Path(path).glob("*.pages"):
        file.write_bytes(file.read_bytes().replace(b"x" * 5_000, b"\xff" * 5_000))
    assert spark.read.format("packed-pages").schema("url string, id string").load(path).count() == 400
    df.limit(7).coalesce(1).write.format("packed-pages").mode("overwrite").save(path)
    assert read().count() == 7 and len(list(Path(path).iterdir())) == 1
    df.where("false").write.format("packed-pages").mode("append").save(path)
    assert read().count() == 7 and spark.read.format("packed-pages").load(f"{tmp_path}/none").count() == 0


# ---- pages over time, logs


def test_changed_pages_are_replaced(spark, tmp_path):
    inbox, kept, state = (f"{tmp_path}/{n}" for n in ("in", "kept", "state"))

    def feed(*rows):
        spark.createDataFrame(rows, intake.CAPTURED).write.mode("append").parquet(inbox)
        intake.keep_books(intake.read_pages(spark, inbox, schema=intake.CAPTURED), kept, state).awaitTermination()
        return {r["url"]: (r["seq"], r["parse_error"], "Neu" in (r["book_json"] or "")) for r in intake.current_books(spark, kept).collect()}

    new = PAGE.replace("<h1><span>", "<h1><span>Neu ")
    assert feed(("u1", PAGE, 1), ("u2", PAGE, 5), ("u3", "<p>", 1)) == {"u1": (1, None, False), "u2": (5, None, False), "u3": (1, "missing-info-block", False)}
    # unchanged, older, changed twice in a batch, and one that can be read now
    assert feed(("u1", PAGE, 2), ("u2", new, 4), ("u3", "<i>", 2), ("u3", new, 3)) == {"u1": (1, None, False), "u2": (5, None, False), "u3": (3, None, True)}
    assert feed(("u1", "<p>", 3), ("u2", new, 6), (None, new, 1)) == {"u1": (3, "missing-info-block", False), "u2": (6, None, True), "u3": (3, None, True)}
    assert spark.read.parquet(kept).count() == 6


def test_registry_log(spark):
    r = random.Random(3)
    log = [(i, r.choice(["upsert", "upsert", "delete"]), r.choice("abcdef"), f"u{i}", r.choice([None, f"l{i}"])) for i in range(200)] + [(500, "delete", "a", None, None), (501, "upsert", " ", "x", "y"), (502, "upsert", None, "x", "y")]
    want = {}
    for pos, op, uid, url, label in log:
        if op == "delete":
            want.pop(uid, None)
        elif uid and uid.strip():
            want[uid] = (want.get(uid, (pos,))[0], url, label or "")
    got = lists.fold_readlists(spark.createDataFrame(log, "pos long, op string, uid string, url string, label string").repartition(5)).collect()
    assert {x["uid"]: (x["pos"], x["url"], x["label"]) for x in got} == want


# ---- long lists


def _plain_assembly(pages):
    """Pages (page, url, visible, total, has_next, links) of one list to links and (total, pages, unique)."""
    seen, links, urls, declared, n = set(), [], set(), 0, 0
    for _, url, total, more, found in sorted(pages, key=lambda p: (p[0], p[1])):
        if url in urls:
            break
        urls.add(url)
        n += 1
        for link in found:
            if link not in seen:
                seen.add(link)
                links.append(link)
        declared = declared or max(total, 0)
        if not found or (declared and len(seen) >= declared) or not more:
            break
    return links, (declared, n, len(links))


@pytest.mark.parametrize("block", [3, 1_000])
def test_long_lists(spark, block):
    """A list with a third of all pages is dealt to many tasks by its blocks; sums, declared counts and stops are those of one pass in order."""
    r = random.Random(5)
    rows, want = [], {}
    for uid, many in (("hot", 120), *((f"l{i}", r.randint(1, 12)) for i in range(30))):
        stop = r.choice([None, r.randint(0, many)])
        total = r.choice([0, 0, many * 2, many * 3])
        pages = [(p, f"{uid}?{p}", total if p >= r.randint(0, 2) else 0, p != stop, [f"s{r.randint(0, many * 3)}" for _ in range(r.choice([0, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3]))]) for p in range(many)]
        if uid != "hot":
            pages += [pages[-1]] * r.choice([0, 0, 1])
        pages = [(p, u, t, m, list(dict.fromkeys(ls))) for p, u, t, m, ls in pages]
        rows += [(uid, p, u, (len(ls), t, m, [(x, f"t{x}") for x in ls])) for p, u, t, m, ls in pages]
        want[uid] = _plain_assembly(list({(p, u): (p, u, t, m and pages.count((p, u, t, m, ls)) == 1, ls) for p, u, t, m, ls in pages}.values()))
    schema = "uid string, page int, url string, d struct<visible:int,total:int,has_next:boolean,links:array<struct<url:string,title:string>>>"
    links, summary = lists.assemble(spark.createDataFrame(rows, schema), block=block)
    got: dict = {}
    for x in links.orderBy("uid", "position").collect():
        got.setdefault(x["uid"], []).append(x["url"])
        assert x["position"] == len(got[x["uid"]])
    assert {u: got.get(u, []) for u in want} == {u: w[0] for u, w in want.items()}
    assert {x["uid"]: (x["total"], x["pages"], x["unique_links"]) for x in summary.collect()} == {u: w[1] for u, w in want.items()}
    # pages are only ever ordered within a block; what is ordered over a whole list are the totals of its blocks
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    ordered = re.findall(r"windowspecdefinition\((.*?) (?:ASC|DESC)", plan)
    assert ordered and all("block" in w for w in ordered)


def test_first_links_of_a_page_with_very_many(spark):
    html = "".join(f'<a href="https://book.example.org/subject/{i % 7_000}/" title="B{i}">x</a>' for i in range(20_000))
    df = spark.createDataFrame([(html,)], "html string")
    start = time.time()
    got = df.select(lists.list_links(F.col("html")).alias("l")).first()["l"]
    assert [x["title"] for x in got] == [f"B{i}" for i in range(7_000)] and time.time() - start < 60


# ---- crowded titles


def _library(spark, n, seed=1):
    """A third of all titles share ten characters; tails are random, with some near copies between the two sides."""
    r = random.Random(seed)
    tail = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(8, 24)))
    near = lambda t: t[:-2] + "".join(r.choices("xyz", k=2))
    titles = [("collected " if i % 3 == 0 else f"{tail()} ") + tail() for i in range(n)]
    books = [(i, near(t) if i % 5 == 0 else t if i % 7 == 0 else titles[(i + 3) % n] + tail(), r.choice(["", "pub", "pub x"]), r.choice([None, "1990", "1991"]), None, None) for i, t in enumerate(titles)]
    items = [(i, t, r.choice(["", "pub", "pub y"]), r.choice([None, "1990", "1991"]), None) for i, t in enumerate(titles)]
    return spark.createDataFrame(books, "book_key long, title string, publisher string, publish_date string, isbn string, isbn13 string"), spark.createDataFrame(items, "item_id long, title string, publisher string, date string, isbn string")


def test_crowded_beginnings(spark):
    """Pairs found by their characters give the same matches as all pairs of a key, and far fewer; their number follows the titles."""
    books, items = _library(spark, 600)
    every = sorted(map(tuple, matching.title_matches(books, items, hot=10**9).collect()))
    assert len(every) > 60 and sorted(map(tuple, matching.title_matches(books, items, hot=0).collect())) == every
    all_pairs, by_characters = (matching.pair_counts(books, items, hot=h).first() for h in (10**9, 0))
    assert by_characters["kept"] == all_pairs["kept"] and by_characters["generated"] * 3 < all_pairs["generated"]
    assert matching.title_matches(books.where("false"), items).count() == 0 == matching.title_matches(books, items.where("false")).count()


def test_short_titles_in_crowded_keys(spark):
    words = ["a", "ab", "abc", "abd", "abcd", "abce", "abcde", "abcdf", "abcdef", "abcdeg", "abcdefg", "abcdefgh", ".,", "。"]
    books = spark.createDataFrame([(i, w, "", None, None, None) for i, w in enumerate(words)], "book_key long, title string, publisher string, publish_date string, isbn string, isbn13 string")
    items = spark.createDataFrame([(i, w, "", None, None) for i, w in enumerate([*words, *words[::-1]])], "item_id long, title string, publisher string, date string, isbn string")
    assert sorted(map(tuple, matching.title_matches(books, items, hot=0).collect())) == sorted(map(tuple, matching.title_matches(books, items, hot=10**9).collect()))


# ---- broken pages


@pytest.mark.parametrize("part,after", [("<span>", ""), ("<div>", "</b>"), ("<div class=intro><img>", ""), ("<h1><p>", "</i>")])
def test_broken_pages_take_linear_time(part, after):
    def seconds(n):
        start = time.process_time()
        pagehtml.parse_page(part * n + after * n)
        return time.process_time() - start

    seconds(1_000)
    small, large = min(seconds(5_000) for _ in range(3)), seconds(40_000)
    assert large < 8 * small * 4
