import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfmark.operators import pagehtml, volumes
from shelfmark.streaming import intake

from .test_catalog import PAGE

PIECES = (
    '<div id="info">', "</div>", '<span class="pl">', "</span>", "<br/>", "<br>", "作者:", ' <a href="/subject/1/?a=1&amp;b=2&copy=3">', "</a>", "<title>", "</title>", "<h1>", "</H1>", "<!-- x -->", "<!--", "-->", "<!DOCTYPE html>", "<script>",
    "</script>", "&amp;", "&", "&#x41", "<", ">", "<p", '"', "=", '<b a="1>2" C>', "</b x>", "\xa0", "<div/>", '<img src="a"/>', "<?pi?>", "<![CDATA[x]]>", "<textarea>", "</textarea>", '<svg:a x:y="1">', "<style>p<q", "</style>", '<p b="1"c="2">', "\x0b",
)


def _shape(root):
    return [(n.tag, n.text, n.attrs, n.within, n.marks, n.place, [k.start for k in n.kids], n.content()) for n in root.walk()]


def _standard(page):
    made = pagehtml._Tree()
    made.feed(page)
    made.close()
    return made.finish()


def test_trees_are_those_of_the_standard_parser():
    r = random.Random(3)
    for page in [PAGE, *("".join(r.choice(PIECES) for _ in range(r.randrange(14))) for _ in range(5_000))]:
        assert _shape(pagehtml.tree(page)) == _shape(_standard(page))


def test_plain_pages_and_known_tags_are_not_read_by_the_standard_parser(monkeypatch):
    page = '<!DOCTYPE html><html><head><title>T</title></head><body><h1><span>T</span></h1><div id="info"><span class="pl">ISBN:</span> 1 &amp; 2<br/></div></body></html>'
    expected = pagehtml.parse_page(page)
    monkeypatch.setattr(pagehtml.HTMLParser, "feed", lambda self, data: pytest.fail(f"read again: {data}"))
    assert pagehtml.parse_page(page) == expected and expected["entries"] == [{"label": "ISBN", "value": "1 & 2"}]


def test_addresses_share_states(spark, tmp_path):
    inbox, state = f"{tmp_path}/in", f"{tmp_path}/state"

    def feed(rows, number):
        rows.select(F.format_string("u%d", "id").alias("url"), F.col("html"), F.lit(number).cast("long").alias("seq")).write.mode("append").parquet(inbox)
        changed = intake.changed_pages(intake.read_pages(spark, inbox, schema=intake.CAPTURED), 5)
        run = changed.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out{number}")).option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
        assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 5
        return spark.read.parquet(f"{tmp_path}/out{number}")

    assert feed(spark.range(300).withColumn("html", F.lit("a")), 1).count() == 300
    again = feed(spark.range(400).withColumn("html", F.when(F.col("id") % 2 == 0, "a").otherwise("b")), 2)
    assert {r["url"] for r in again.collect()} == {f"u{i}" for i in range(400) if i % 2 or i >= 300}


def test_volume_numbers_are_read_once(spark):
    plan = entry.queries()["j13_volume_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("卷([0-9]+)") == 1


def test_files_are_matched_by_each_rule(spark):
    names = {"x 卷3.pdf": "03", "第12话 v4.epub": "12", "vol. 7 第x.CBZ": "07", "a (5) 9.epub": "05", "a 9 b 120.mobi": "120", "no digit.epub": None, "7.txt": None, "none.7": None, "vol.2.epub": "02", "v٣.epub": None}
    wanted = spark.createDataFrame([("s", n) for n in ("03", "12", "07", "05", "120", "02", "")] + [("s", None)], "series string, volume_number string")
    files = spark.createDataFrame([("s", n, f"/{n}") for n in names], "series string, name string, path string")
    got = {r["volume_number"]: r["path"] for r in volumes.match_files(wanted, files).collect()}
    assert got == {v: f"/{k}" for k, v in names.items() if v} | {"": None, None: None}
