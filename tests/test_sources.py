"""Readers and writers on small hand-made files."""

import pytest

from millrace.plans.runs import clean_files, run_report, run_stages
from millrace.reports.quality import file_gate, require_gate
from millrace.sources import read, write


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_lenient_rows(spark, tmp_path):
    df = read.read_dataset(spark, put(tmp_path, "lenient.csv", "a,b\n1,2\n3,4,5\n6\n"))
    assert sorted(map(tuple, df.collect())) == [(1, 2.0), (6, None)]


def test_extra_field_counts_even_if_empty(spark, tmp_path):
    df = read.read_dataset(spark, put(tmp_path, "trailing.csv", "a,b\n1,x\n2,y,\n"))
    assert [tuple(r) for r in df.collect()] == [(1, "x")]


def test_types_of_cells(spark, tmp_path):
    text = "i,f,gap,t,flag,day,none\n1,1.5,1,NA,True,2020-01-02,\n2,2,,x,False,2020-01-03,NULL\n"
    df = read.read_dataset(spark, put(tmp_path, "types.csv", text))
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "gap": "double", "t": "string", "flag": "boolean",
                               "day": "string", "none": "double"}
    assert df.first()["t"] is None


def test_quoted_line_breaks(spark, tmp_path):
    df = read.read_dataset(spark, put(tmp_path, "lines.csv", 'a,b\n1,"x\ny, ""z"""\n2,w\n'))
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 'x\ny, "z"'), (2, "w")]


@pytest.mark.parametrize("name,sep", [("tab.tsv", "\t"), ("semi.txt", ";"), ("pipe.txt", "|"), ("comma.txt", ",")])
def test_delimiters(spark, tmp_path, name, sep):
    df = read.read_dataset(spark, put(tmp_path, name, f"a{sep}b\n1{sep}x\n"))
    assert [tuple(r) for r in df.collect()] == [(1, "x")]


@pytest.mark.parametrize("text,rows", [
    ('[{"a":1,"b":"x"},{"a":2}]', [(1, "x"), (2, None)]), ('[\n {"a":1,"b":"x"},\n {"a":2}\n]', [(1, "x"), (2, None)]),
    ('{"a":1,"b":"x"}\n{"a":2}\n', [(1, "x"), (2, None)]), ('{\n"a":1,\n"b":"x"}', [(1, "x")])])
def test_json(spark, tmp_path, text, rows):
    assert sorted(map(tuple, read.read_dataset(spark, put(tmp_path, "f.json", text)).collect())) == rows


def test_nested_json(spark, tmp_path):
    df = read.read_dataset(spark, put(tmp_path, "o.json", '{"a":1,"b":{"c":[1,2]}}'))
    assert df.first()["b"]["c"] == [1, 2]


def test_formats_and_guards(spark, tmp_path):
    with pytest.raises(ValueError):
        read.read_dataset(spark, put(tmp_path, "f.xyz", "a\tb\n1\t2\n"))
    assert read.read_dataset(spark, str(tmp_path / "f.xyz"), unknown="sniff").columns == ["a", "b"]
    with pytest.raises(ValueError):
        read.require_rows(spark.range(0))
    with pytest.raises(ValueError):
        read.read_dataset(spark, put(tmp_path, "twins.csv", "A,a\n1,2\n"))


def test_write_both(spark, tmp_path):
    df = spark.createDataFrame([(1, "x, y", [1, 2]), (2, None, None)], "a int, b string, c array<int>")
    done = write.write_both(df, str(tmp_path), "my data!")
    assert (done["rows"], done["cols"]) == (2, 3) and done["csv_path"].endswith("my_data__cleaned.csv")
    assert spark.read.parquet(done["parquet_path"]).count() == 2
    assert {r.b for r in read.read_dataset(spark, done["csv_path"]).collect()} == {"x, y", None}


def test_clean_each_file(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    put(raw, "one.csv", "My Id,Name\n1, a \n1, a \n,b\n")
    put(raw, "two.tsv", "x\ty\n1\t\n3\t\n")
    put(raw, "notes.md", "not data")
    report = clean_files(spark, str(raw), str(tmp_path / "out"))
    assert [(r["file"], r["status"]) for r in report] == [("one.csv", "success"), ("two.tsv", "success")]
    one, two = (read.read_dataset(spark, r["path"], "csv") for r in report)
    assert sorted(map(tuple, one.collect())) == [(1, "a"), (1, "b")] and one.columns == ["my_id", "name"]
    assert two.columns == ["x"]


def test_gate(spark):
    df = spark.createDataFrame([("f", 1, None), ("g", 1, 2)], "file_name string, a int, b int")
    gate = file_gate(df)
    assert {r.file: r.pct for r in gate.collect()} == {"f": 66.7, "g": 100.0}
    with pytest.raises(ValueError):
        require_gate(gate)


def test_runs_are_recorded(spark, tmp_path):
    path = put(tmp_path, "in.csv", "a,b\n1,x\n1,x\n2,\n")
    folder = str(tmp_path / "runs")
    done = run_stages(spark, path, [{"type": "transform", "config": {"operations": [{"op": "deduplicate"}]}},
                                    {"type": "dq_check", "config": {}}, {"type": "other"}], folder)
    assert (done["rows_in"], done["rows_out"]) == (3, 2)
    with pytest.raises(KeyError):
        run_stages(spark, path, [{"type": "model", "config": {"model": "none"}}], folder)
    runs = {r.status: r for r in write.read_rows(spark, f"{folder}/runs", write.RUNS).collect()}
    assert runs["success"].rows_out == 2 and runs["failed"].rows_in == 3
    assert "ERROR" in {r.level for r in write.read_rows(spark, f"{folder}/run_logs", write.RUN_LOG).collect()}
    report = run_report(spark, path, folder, staging=True, name="in")
    assert report["rows_removed"] == 1 and "TRIM(CAST(`b` AS STRING)) AS b" in report["model"]["sql"]
    assert set(report["reports"]) >= {"profile", "missing", "duplicates", "outliers", "correlation"}


def test_one_column_and_counting(spark, tmp_path):
    df = read.read_dataset(spark, put(tmp_path, "one.csv", 'a\n1\n\n2,3\n"4"\n'))
    assert df.count() == 2 and sorted(r.a for r in df.collect()) == [1, 4]


def test_long_rows_with_empty_and_quoted_fields(spark, tmp_path):
    df = read.read_dataset(spark, put(tmp_path, "long.csv", 'a,b\n1,x\n2,y,,z\n3,"p,q"\n4,"p,q",\n"5,6"\n'))
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("1", "x"), ("3", "p,q"), ("5,6", None)], key=str)


def test_views_and_tables(spark, tmp_path):
    df = spark.range(3)
    assert read.read_table(spark, "staged_ids").count() == 3 if write.stage_view(df, "staged_ids") else False
    assert write.save_table(df, "kept_ids", str(tmp_path / "kept")).count() == 3
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 3


def test_empty_join_is_saved(spark, tmp_path):
    from millrace.operators.joins import merge

    joined = merge(spark.range(3), spark.range(10, 12), "id", "id")
    assert write.save_join(joined, str(tmp_path), str(tmp_path / "datasets"))["rows"] == 0


def test_a_local_warehouse_is_no_scratch_folder_on_a_cluster(spark):
    from millrace.sources.scratch import scratch_root, shared_warehouse

    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    for master in ("local", "local[8]"):
        assert shared_warehouse("file:/here/spark-warehouse", master) == "file:/here/spark-warehouse"
    assert shared_warehouse("hdfs://name/warehouse", "yarn") == "hdfs://name/warehouse"
    for master in ("yarn", "spark://head:7077", "local-cluster[3,2,1024]", ""):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_warehouse("file:/here/spark-warehouse", master)


def test_a_folder_is_summarised_file_by_file_and_in_total(spark, tmp_path):
    from millrace.plans.runs import summarise_folder

    for name, lines in {"a.csv": "x,y\n1,2\n1,2\n,3\n", "b b+1%.csv": "x,y\n5,6\n", "c.csv": "x,y\n", "twins.csv": "k,K\n1,2\n", "none.csv": "\n",
                        "t.tsv": "x\tz\n1\tu\n", "d.json": '{"x": 1, "q": null}\n{"x": 1, "q": 4}\n', "other.txt": "no data"}.items():
        (tmp_path / name).write_text(lines)
    got = {r.file: r for r in summarise_folder(spark, str(tmp_path)).collect()}
    assert {f: (r.status, r.rows, r.cols, r.missing, r.dupes) for f, r in got.items()} == {
        "a.csv": ("ok", 3, 2, 1, 1), "b b+1%.csv": ("ok", 1, 2, 0, 0), "c.csv": ("ok", 0, 2, 0, 0), "t.tsv": ("ok", 1, 2, 0, 0),
        "d.json": ("ok", 2, 2, 1, 0), "twins.csv": ("failed", None, None, None, None), "none.csv": ("failed", None, None, None, None),
        None: ("total", 7, None, 2, 1)}
    assert got["a.csv"].columns == ["x", "y"] and set(got["d.json"].columns) == {"x", "q"} and got["twins.csv"].error and got["none.csv"].error
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "other.txt").write_text("no data")
    assert [(r.status, r.rows) for r in summarise_folder(spark, str(empty)).collect()] == [("total", 0)]


def test_files_without_rows_decide_no_types(spark, tmp_path):
    import registry

    for i, keys in enumerate(([1, 2] * 50, [3, 4, 5, 6])):  # the first task that writes has no row for a CSV file, and leaves a header alone
        rows = spark.createDataFrame([(k, f"status {k}") for k in keys], "o_orderkey bigint, o_orderstatus string")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "orders.parquet"))
    registry.load_all()
    got = registry.QUERIES["discover_files"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"kind": "string", "o_orderkey": "bigint", "o_orderstatus": "string"}
    assert sorted(map(tuple, got.where("o_orderkey > 1").collect())) == [("csv", 3, "status 3"), ("csv", 6, "status 6"), ("json", 4, "status 4")]
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    for name, text in {"a.csv": "x,y\n", "b.csv": "x,y\n1,u\n", "c.csv": "x,y\n2,\n", "d.tsv": "x\tz\n7\tv\n", "e.json": '{"x": null}\n', "f.json": '{\n"x": 5\n}\n', "g.txt": "no data"}.items():
        put(mixed, name, text)
    found = read.read_folder(spark, str(mixed))
    assert {k: (df.dtypes, sorted(map(tuple, df.collect()), key=str)) for k, df in found.items()} == {
        "csv": ([("x", "bigint"), ("y", "string")], [(1, "u"), (2, None)]), "tsv": ([("x", "bigint"), ("z", "string")], [(7, "v")]),
        "json": ([("x", "bigint")], [(5,), (None,)])}
