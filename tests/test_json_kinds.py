"""How files of JSON lines and JSON documents are told apart."""

import json

from millrace.sources import read
from millrace.sources.records import spans, text_lines


def put(folder, **files):
    folder.mkdir()
    for name, text in files.items():
        (folder / f"{name}.json").write_text(text)
    return str(folder)


def test_valid_lines_among_more_broken_ones_are_kept(spark, tmp_path):
    trace = "".join(f"  at com.example.Service(Service.java:{i})\n" for i in range(5))
    log = "".join(f'{{"a": {i}}}\n' + trace * (i % 4 == 0) for i in range(400))
    for name, text in (("log", log), ("trace_first", trace + log), ("opens", '{"a": 1,\n' + log), ("balanced", '{"a": {},\n"b": 2,\n"c":3,\n{"a": 7}\n}\n{"a": 0}\n{"a": 1}\n')):
        found = read.read_json(spark, put(tmp_path / name, f=text)).cache()
        broken = [x for x in text.splitlines() if not x.startswith("{") or not x.endswith("}")]
        assert (found.where("a IS NOT NULL").count(), found.where("_corrupt_record IS NOT NULL").count()) == (len(text.splitlines()) - len(broken), len(broken))


def test_documents_with_complete_lines_stay_documents(spark, tmp_path):
    folder = put(tmp_path / "documents", a='[\n{"a": 1},\n{"a": 2}\n]\n', b='{\n"a": 3, "b":\n{"c": "}{"}\n}', c='[\n [1],\n {"a": 4}\n]' .replace("[1]", '{"a": 5}'))
    assert sorted(r.a for r in read.read_json(spark, folder).collect()) == [1, 2, 3, 4, 5]


def test_values_over_lines_and_several_on_one(spark, tmp_path):
    pretty = "".join(json.dumps({"a": i, "b": {"c": ["}", "[", '\\"{']}}, indent=2) + "\n" for i in range(3))
    arrays = '[\n{"a": 1}\n]\n[\n{"a": 2},\n{"a":\n3}\n]\n'
    for name, text, want in (
            ("pretty", pretty, [0, 1, 2]), ("on_one_line", '{"a":1}{"a":2}\n{"a":3} {"a":4}\n', [1, 2, 3, 4]), ("across", '{"a":\n1}{"a":\n2}\n', [1, 2]), ("arrays", arrays, [1, 2, 3]),
            ("array_lines", '[{"a": 1},\n {"a": 2}, {"a": 3},\n {"a": 4,\n "b": [1, 2]}]\n', [1, 2, 3, 4]), ("commas", '{"a": 1},{"a": 2},\n{"a": 3}\n', [1, 2, 3]), ("lines", '{"a": 1}\n{"a": 2}\n', [1, 2]),
            ("marked", '﻿{\r\n"a": 7\r\n}\r\n', [7]), ("line_of_arrays", '[{"a": 1}, {"a": 2}]\n[{"a": 3}]\n', [1, 2, 3])):
        found = read.read_json(spark, put(tmp_path / name, f=text))
        assert "_corrupt_record" not in found.columns and sorted(r.a for r in found.collect()) == want, name


def test_nothing_is_dropped_where_all_or_some_is_broken(spark, tmp_path):
    assert sorted(r._corrupt_record for r in read.read_json(spark, put(tmp_path / "all", f="{oops\nno\n\n}\n")).collect()) == ["no", "{oops", "}"]
    text = '{"a": 1}\n{"a": 2} rest\n{\n"a": 3\n}\n]\n[1, 2\n{"a": 4}\n'
    found = read.read_json(spark, put(tmp_path / "some", f=text)).cache()
    assert sorted(r.a for r in found.where("a IS NOT NULL").collect()) == [1, 2, 3, 4]
    assert sorted(r._corrupt_record for r in found.where("_corrupt_record IS NOT NULL").collect()) == ["[1, 2", "]", "rest"]


def test_a_file_over_many_blocks(spark, tmp_path):
    """Brackets are carried from block to block, in documents one after the other and in one array."""
    rows = [{"a": i, "text": "{[" * (i % 7), "more": {"x": [i, {"y": "]"}]}} for i in range(3000)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        for name, text in (("documents", "".join(json.dumps(r, indent=1) + "\n" for r in rows)), ("array", json.dumps(rows, indent=1))):
            folder = put(tmp_path / name, f=text)
            assert spark.read.text(folder).rdd.getNumPartitions() > 5
            assert [(r.a, r.text, r.more.x[0]) for r in read.read_json(spark, folder, schema="a int, text string, more struct<x:array<string>>").orderBy("a").collect()] == [(r["a"], r["text"], str(r["a"])) for r in rows]
            assert text_lines(spark, folder).count() > 5000
            largest = spans(text_lines(spark, folder)).selectExpr("max(size(texts)) AS n").first().n
            assert largest < 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_small_documents_are_read_file_by_file(spark, tmp_path, monkeypatch):
    """Neither their schema nor their values put all files into one task or shuffle their lines."""
    files = {f"f{i}": json.dumps([{"a": i, "t": "x\u00e9]"}, {"a": -i, "b": [{"c": 1.5}]}], indent=1) for i in range(12)}
    folder = put(tmp_path / "documents", **files)
    want = sorted([(i, "x\u00e9]") for i in range(12)] + [(-i, None) for i in range(12)], key=str)
    assert read._document_schema(spark, folder) == spark.read.option("multiLine", True).json(folder).schema
    monkeypatch.setattr(read, "one_per_line", None)  # not needed
    assert sorted(((r.a, r.t) for r in read.read_json(spark, folder).collect()), key=str) == want
    assert sorted(((r.a, r.t) for r in read.read_dataset(spark, folder, "json", use_spark=True).collect()), key=str) == want
    assert read._document_schema(spark, put(tmp_path / "bad", f="{\n", g='{"a": 1}')) is None
    monkeypatch.setattr(read, "_SMALL_FILE", 10)
    assert read._document_schema(spark, folder) is None


def test_values_of_large_files_are_found_without_a_shuffle_of_their_lines(spark, tmp_path):
    """Two scans; over the end of a block only what stands there is shuffled, and strings of any length are one."""
    folder = put(tmp_path / "large", f="".join(json.dumps({"a": i}, indent=1) + ' {"a": -1}\n' for i in range(2000)), g='[\n{"a": "' + "x" * 100_000 + '{"}\n]')
    lines = text_lines(spark, folder)
    plan = spans(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Relation") == 2
    found = spans(lines).where("closed").selectExpr("count(*) AS n", "max(size(texts)) AS most", "sum(size(texts)) AS texts").first()
    assert (found.n, found.most, found.texts) == (2003, 3, 2000 * 3 + 3)
    assert read.read_json(spark, folder, schema="a string").where("a = '-1'").count() == 2000
