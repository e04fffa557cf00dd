from shelfmark.streaming import intake

from .test_catalog import PAGE


def test_intake(spark, tmp_path):
    pages, where = f"{tmp_path}/in", [f"{tmp_path}/{n}" for n in ("books", "errors", "state")]
    spark.createDataFrame([("u1", PAGE), ("u1", PAGE), ("u2", "<p>")], "url string, html string").write.parquet(pages)
    intake.append_books(intake.read_pages(spark, pages), *where).awaitTermination()
    spark.createDataFrame([("u3", PAGE)], "url string, html string").write.mode("append").parquet(pages)
    intake.append_books(intake.read_pages(spark, pages), *where).awaitTermination()
    assert {r["url"] for r in spark.read.parquet(where[0]).collect()} == {"u1", "u3"}
    assert [r["url"] for r in spark.read.parquet(where[1]).collect()] == ["u2"]
