import corpus_pipeline


def test_short_items_drop_only_what_they_make_up(spark, tmp_path):
    long = "which of these ten words says most about the tide today"
    spark.createDataFrame([("a", "the"), ("b", "how high is it"), ("c", long)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["the boats lie on sand", "how high is it now", "they ask how high is it and then go home at night", f"x {long} y " + "z " * 90, "", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()) == [0, 2, 4, 5]
