from collections import Counter

import duckdb
import pyarrow as pa

import corpus_pipeline
from millrace.llm import decontaminate, language, mixing, sharding
from test_near_copies import plain_kept

SF = "/root/testdata/sf0.001"


def test_run_matches_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
    scorer = language.Scorer(*language.train(docs))
    rows = [r for r, (lang, p) in zip(rows, scorer.scores([r[1] for r in rows]), strict=True) if lang != "und" and p >= 0.5]
    rows = [rows[i] for i in plain_kept([r[1] for r in rows])]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{SF}/labels.parquet'")
    con.register("given", pa.Table.from_pylist([dict(zip(docs.columns, r, strict=True)) for r in rows]))
    con.execute(f"CREATE TABLE clean AS SELECT * FROM given WHERE doc_id NOT IN (SELECT doc_id FROM ({decontaminate.contaminated_sql('given')}))")
    con.execute(f"CREATE TABLE mixed AS SELECT m.doc_id, text, lang, m.source, n_chars FROM ({mixing.mix_sql('clean')}) m, range(3) v(i) WHERE i < times AND size > 0")
    want = con.execute(f"SELECT doc_id, text, lang, source, n_chars, shard, slot FROM ({sharding.shard_sql('mixed')})").fetchall()
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    got = [tuple(r) for r in out.collect()]
    assert 0 < con.execute("SELECT count(*) FROM clean").fetchone()[0] < docs.count()
    assert Counter(got) == Counter(want)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumnRenamed("n_chars", "score")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        added = ["shard", "slot"] if name == "sharding" else []
        assert stage(spark, docs, SF).columns == docs.columns + added
        assert stage(spark, empty, SF).count() == 0


def test_null_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, "the words of this text are many", "en", "a", 9)] * 2, schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).collect()
