import corpus_pipeline


def test_a_filter_by_the_predicted_language_predicts_once(spark, make_docs):
    """The filter stays above the prediction: pushed below it, each task would hold a second Python worker and predict every text twice."""
    texts = ["the cat sat on the mat and the dog was there", "der Hund und die Katze sind nicht im Haus", "123 456", None] * 5
    docs = make_docs(texts, langs=["en", "de", "en", "de"] * 5)
    done = corpus_pipeline.identify_language(spark, docs, "")
    assert done._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    rows = done.collect()
    assert done.columns == docs.columns and sorted(r["doc_id"] for r in rows) == [k for k in range(20) if k % 4 < 2]
    assert {(r["text"], r["lang"]) for r in rows} == {(texts[0], "en"), (texts[1], "de")}
