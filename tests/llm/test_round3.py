"""Documents with one key in the pipeline, many languages, long texts, and removals that come from the methods."""

import glob
import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, language_id, phrase_dedup, simhash_dedup, suffix_dedup, toxicity, windows
from shelfmark.llm.common import cut, shared_dir, temporary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STORY = "the quick brown fox jumps over the lazy dog while the old river runs down to the sea " * 6


def _table(spark, path, texts):
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this stands anywhere")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_keeps_documents_with_one_key(spark, tmp_path):
    """Unlike texts under one key all come out; near copies and repeated rows of them do not, whatever their keys."""
    unlike = [(1, "a first text about a house by the river and its garden"), (1, "entirely other words concerning ships and harbours far away"), (2, "some third thing to be read by nobody at all, ever")]
    copies = [(1, STORY), (1, STORY), (3, STORY), (0, "a first text about a house by the river and its garden")]
    _table(spark, tmp_path, unlike + copies)
    got = sorted((x["doc_id"], x["n_tokens"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert [k for k, _ in got] == [0, 1, 1, 2]


def test_pipeline_deletes_its_tables(spark, tmp_path):
    before = set(glob.glob(f"{shared_dir(spark)}/shelfmark-*"))
    _table(spark, tmp_path, [(i, f"{STORY} {i} " * (1 + i % 3)) for i in range(6)])
    corpus_pipeline.run(spark, str(tmp_path)).count()
    left = set(glob.glob(f"{shared_dir(spark)}/shelfmark-*")) - before
    assert len(left) == 1 and "pipeline-secrets" in left.pop()


def test_pipeline_long_texts(spark, tmp_path):
    """A text of a million words, one of one long word, and an empty one go through every stage."""
    long = " ".join(f"word{i % 997}" for i in range(1_000_000))
    _table(spark, tmp_path, [(1, long), (2, "x" * 300_000), (3, ""), (4, None)])
    got = {x["doc_id"]: x["n_tokens"] for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens").collect()}
    assert set(got) == {1, 2} and got[1] >= 1_000_000


def test_tables_of_a_scope(spark):
    with temporary() as made:
        a, b = cut(spark.range(3), "scope-a"), cut(spark.range(4), "scope-b")
        made.remove(b)
    assert not glob.glob(a.shelfmark_path) and b.count() == 4


def test_seventy_languages(spark):
    """Every language of the labels is learned and found again, also with fewer rows than languages to sample."""
    rows = [(i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{'aeiou'[(i + j) % 5]}" for j in range(30)), f"l{k}") for k in range(70) for i in range(k * 10, k * 10 + 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {x["lang"] for x in language_id.sample(docs, F.lit(True), most_rows=35).collect()} == {f"l{k}" for k in range(70)}
    done = language_id.identify(docs).toPandas()
    assert (done["lang"] == done["lang_pred"]).mean() > 0.99 and done["lang_pred"].nunique() == 70


@pytest.mark.parametrize("hot", [4_000, 1])
def test_nothing_goes_that_the_method_has_not_marked(spark, monkeypatch, hot):
    """Copies, passages and repeated stretches stay whole if the marker of a shard marks nothing, and go with it."""
    monkeypatch.setattr(windows, "HOT", hot)
    r = random.Random(8)
    make = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    passage, copy = make(70), make(120)
    texts = [copy, copy, copy, f"{make(40)} {passage} {make(60)}", f"{passage} {make(20)}", f"{make(10)} {passage}", "again and again " * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for module, run, digest in ((suffix_dedup, suffix_dedup.remove_repeats, suffix_dedup.digest), (phrase_dedup, phrase_dedup.remove_phrases, phrase_dedup.digest)):
        assert digest(run(docs)).agg(F.sum("n_removed")).first()[0] > 300
        with monkeypatch.context() as m:
            m.setattr(module, "_marker", lambda size: lambda pdf: windows.as_ranges(pdf.reset_index(drop=True), np.empty(0, np.int64), np.empty(0, np.int64)))
            assert digest(run(docs)).agg(F.sum("n_removed")).first()[0] == 0


def test_long_texts_of_windows_and_prints(spark):
    """A text of a million words beside its copy, a short one and one of one long word."""
    long = " ".join(f"w{i % 5_003}x{i % 7}" for i in range(1_000_000))
    texts = [long, long, "short", "y" * 500_000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    phrases = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in phrase_dedup.digest(phrase_dedup.remove_phrases(docs)).collect()}
    assert phrases == {0: (1_000_000, 0), 1: (1_000_000, 1_000_000), 2: (1, 0), 3: (1, 0), 4: (0, 0)}
    suffixes = {x["doc_id"]: (x["n_bytes"], x["n_removed"]) for x in suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect()}
    assert suffixes[1] == (len(long), len(long)) and suffixes[3] == (500_000, 499_999) and suffixes[2] == (5, 0)
    groups = {x["doc_id"]: x["component_id"] for x in simhash_dedup.near_duplicates(docs).collect()}
    assert groups[0] == groups[1] == 0 and groups[2] == 2
    found = {x["doc_id"]: (x["n_words"], x["n_hit"]) for x in decontaminate.judge(decontaminate.find_items(docs, spark.createDataFrame([(1, " ".join(long.split(" ")[500_000:500_013]))], "item_id long, text string"))).collect()}
    assert found[0][0] == 1_000_000 and found[0] == found[1] and found[0][1] >= 13 and found[2] == (1, 0)
    chain = toxicity.classify(docs, spark.createDataFrame([(0, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    assert chain.count() == 5
