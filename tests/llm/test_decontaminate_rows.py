import pytest

import corpus_pipeline
from millrace.llm import decontaminate as D

ITEM = "one of the items of a benchmark has these words in this order and nobody else uses them so"


@pytest.mark.parametrize("broadcast_rows", [D.BROADCAST_ROWS, 0])
def test_clean_rows_of_a_shared_id_stay(spark, broadcast_rows):
    rows = [(1, f"see {ITEM} here"), (1, "clean text of the same id"), (None, "no id and clean"), (None, ITEM), (None, None), (2, ITEM), (2, ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    got = D.clean_rows(docs, bench, broadcast_rows=broadcast_rows)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[2], rows[4]], key=str)


def test_stage_judges_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, ITEM), (1, "clean"), (None, ITEM), (None, "clean")], "doc_id long, text string")
    spark.createDataFrame([(7, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "clean"), (1, "clean")]
