from pyspark.sql import functions as F

from millrace.llm import toxicity as T

SF = "/root/testdata/check_s"


def test_recall_where_labels_exceed_the_sample(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1")
    rows = T.op5_machine(spark, SF).where("held_out").join(labels, "doc_id")
    assert rows.agg(F.avg("predicted")).first()[0] > 0.94
