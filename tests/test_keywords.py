from scriptorium.operators import keywords as K


def test_rake_golden(spark):
    df = spark.createDataFrame([(1, "Deep learning of the big data sets, deep nets")], "doc_id long, text string")
    got = K.extract_keywords(df, ["doc_id"], "text", top_n=2, stop_words=["of", "the"]).first().keywords
    assert got == "big data sets deep nets"
    top = K.top_phrases(K.scored_phrases(K.phrase_counts(df, ["doc_id"], "text", ["of", "the"]), ["doc_id"]), ["doc_id"], 3)
    assert [(r.phrase, r.score) for r in top.orderBy("rank").collect()] == [
        ("big data sets", 9.0), ("deep nets", 4.0), ("deep learning", 4.0)]


def test_repeated_phrases_kept(spark):
    df = spark.createDataFrame([(1, "red apple. red apple. green")], "doc_id long, text string")
    got = K.extract_keywords(df, ["doc_id"], "text", top_n=3).first().keywords
    assert got == "red apple red apple green"


def test_newline_is_a_delimiter(spark):
    df = spark.createDataFrame([(1, "alpha beta\ngamma")], "doc_id long, text string")
    ph = K.phrase_counts(df, ["doc_id"], "text")
    assert sorted(r.phrase for r in ph.collect()) == ["alpha beta", "gamma"]


def test_documents_are_not_put_together(spark):
    df = spark.createDataFrame([(i, "red apple. green pear") for i in range(20)], "doc_id long, text string").coalesce(1)
    got = K.extract_keywords(df, ["doc_id"], "text", colocate=True)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert {r.keywords for r in got.collect()} == {"red apple green pear"}


def test_batch_phrases_move_as_numbers_with_their_words(spark):
    from scriptorium.operators import keywords as K

    df = spark.createDataFrame([("a", "red fox and red den"), ("a", "red fox"), ("b", "red fox, blue, den den"), (None, "red")], "g string, t string")
    counts = K.phrase_counts(df, ["g"], "t")
    batch, alone = K.scored_phrases(counts, ["g"]), K.scored_phrases(counts.where("g is not null"), ["g"], colocated=True)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, alone.collect()))
    plan = batch._jdf.queryExecution().optimizedPlan().toString()
    words = plan[plan.index("Aggregate [_id"):]
    assert "phrase" not in words.split("Generate")[0]
