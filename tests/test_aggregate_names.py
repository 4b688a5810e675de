"""Aggregates by name that need more than one function call, and SQL steps beside views of the caller."""

from millrace.operators import group


def test_names(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", 3.0), (1, None, 4.0), (2, None, float("nan")), (None, "c", 5.0)], "k int, s string, v double")
    got = group.aggregate(df, ["k"], agg={"s": ["mode", "size"], "v": ["product", "percentile", "mode", "percentile_approx"]})
    assert got.columns == ["k", "s_mode", "s_size", "v_product", "v_percentile", "v_mode", "v_percentile_approx"]
    rows = {r.k: tuple(r)[1:] for r in got.collect()}
    assert rows == {1: ("a", 3, 24.0, 3.0, 2.0, 3.0), 2: (None, 1, None, None, None, None), None: ("c", 1, 5.0, 5.0, 5.0, 5.0)}
    assert group.aggregate(df.where("false"), ["k"], agg={"s": "mode"}).collect() == []
    assert [r.s_mode for r in group.aggregate(df, agg={"s": "mode"}).collect()] == ["a"]


def test_sql_step_leaves_views_alone(spark):
    spark.range(3).createOrReplaceTempView("source_table")
    views = {t.name for t in spark.catalog.listTables()}
    got = group.sql_step(spark.range(7), "WITH big AS (SELECT id FROM source_table WHERE id > 1) SELECT id, '{source_table}' AS t FROM big ORDER BY id DESC;")
    assert [(r.id, r.t) for r in got.collect()] == [(i, "{source_table}") for i in (6, 5, 4, 3, 2)]
    assert spark.table("source_table").count() == 3 and {t.name for t in spark.catalog.listTables()} == views
    spark.catalog.dropTempView("source_table")
