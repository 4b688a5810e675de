import corpus_pipeline
from test_operators import labelled


def test_stages(spark, tmp_path):
    docs, labels, truth = labelled(spark)
    docs = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    docs = docs.union(docs.where("doc_id < 100 AND doc_id % 2 = 1").selectExpr("doc_id + 1000", "upper(text)", "lang", "source", "n_chars"))
    docs = docs.union(spark.sql("SELECT cast(null AS long), cast(null AS string), 'en', 's', cast(null AS long)"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, rows, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        rows = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(rows.count())
        assert name == corpus_pipeline.STAGES[-1][0] or rows.columns == docs.columns
    assert counts[0] > counts[1] >= counts[2] == counts[3] <= counts[4]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[-1]
