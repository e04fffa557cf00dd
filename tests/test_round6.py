from pyspark.sql import functions as F

from shelfmark.operators import lists


def test_sources_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks of the ranking grow in number with the links, not in size; a missing list or address is a value like any other."""
    monkeypatch.setattr(lists, "TASK_LINKS", 20, raising=False)
    given = [(f"u{i % 7}" if i % 50 else None, i % 13 if i % 29 else None, i) for i in range(400)]
    links = spark.createDataFrame(given, "url string, uid int, position int").withColumn("source", F.struct("uid", "position"))
    done = lists.candidate_sources(links, "uid", "position")
    order = sorted(given, key=lambda x: (x[0] or "", -1 if x[1] is None else x[1], x[2]))
    seen, want = {}, set()
    for url, uid, position in order:
        seen[url] = seen.get(url, 0) + 1
        want.add((url, seen[url], uid, position))
    assert {(x["url"], x["position"], *x["source"]) for x in done.collect()} == want and len(want) == 400
    assert done.rdd.getNumPartitions() == 20
