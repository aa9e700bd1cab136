from millrace.llm import language as L


def test_copies_leave_the_sample_whole(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "learn", lambda samples, pieces: (seen.extend(samples), ([], None))[1])
    rows = [("xx", "the same text")] * 30_000 + [("xx", f"text number {i}") for i in range(300)] + [("yy", f"other {i}") for i in range(20)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").where(~L.held_out())
    given = {(r.lang, r.text) for r in docs.select("lang", "text").distinct().collect()}
    L.train(docs, train_docs=100)
    assert sum(lang == "xx" for lang, _ in seen) == 100 and len(set(seen)) == len(seen)
    assert {x for x in seen if x[0] == "yy"} == {x for x in given if x[0] == "yy"}
