"""Definition lines, XML rows and JSON envelopes."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.textrows import classify_lines, kv_map, kv_pairs, kv_parse, ragged_union
from strata.sources.json import explode_result, scan_json_result
from strata.sources.text import explode_lines, scan_lines
from strata.sources.xml import scan_xml_rows

LINES = ["WEB", "WEB=1", "Selection=All", "K = v1=v2 ", "a==b", "E=", "T=x=", "=v", "nokv", "Selection=Last",
         "Tab=\tpadded\t", "http://h/q?x=1", "web page=2"]


@pytest.fixture
def lines(spark):
    return spark.createDataFrame([("f", i + 1, l) for i, l in enumerate(LINES)], "file string, line_no int, line string")


def test_kv_rules(spark, lines):
    got = {(r.key, r.value) for r in kv_parse(lines).collect()}
    assert got == {("Selection", "Last"), ("K", "v1=v2"), ("a", "=b"), ("T", "x"), ("Tab", "padded"),
                   ("http://h/q?x", "1")}
    m = kv_map(lines).first()["parameters"]
    assert m["Selection"] == "Last"
    flags = {r.line: (r.is_web, r.is_url) for r in classify_lines(lines).collect()}
    assert flags["web page=2"] == (True, False) and flags["http://h/q?x=1"] == (False, True)
    assert kv_pairs(lines).count() == 7


FILES = {"crlf": "WEB\r\n1\r\n\r\nk=v\r\n", "cr": "a\rb\r\r", "lf": "\nk=v\nlast", "mixed": "a\r\n\rb\n\nc\r", "break": "\n",
         "blank": " ", "empty": "", "long": "x=1\n" * 50_000 + "y" * 2_000_000}


def test_lines_of_a_column_are_the_files_lines(spark, tmp_path):
    """Text files read whole line by line give what the column gives."""
    for name, text in FILES.items():
        (tmp_path / name).write_bytes(text.encode())
    rows = sorted(scan_lines(spark, str(tmp_path)).collect(), key=lambda r: (r.file, r.line_no))
    want = {}
    for r in rows:
        want.setdefault(os.path.basename(r.file), []).append(r.line)
    df = spark.createDataFrame([*FILES.items(), ("null", None), (None, "z")], "name string, body string")
    got = {}
    for r in sorted(explode_lines(df, F.col("name"), F.col("body")).collect(), key=lambda r: (str(r.file), r.line_no)):
        assert r.line_no == len(got.setdefault(r.file, []))
        got[r.file].append(r.line)
    assert got.pop(None) == ["z"]
    assert got == want and "empty" not in got and got["break"] == [""]
    assert explode_lines(df.where("false"), F.col("name"), F.col("body")).count() == 0


def test_scan_lines_keeps_order(spark):
    d = tempfile.mkdtemp(prefix="lines-", dir="/tmp")
    with open(os.path.join(d, "a.def"), "w", newline="") as f:
        f.write("WEB\r\n1\r\nhttp://x/y?z=1\r\nSelection=All\r\n")
    with open(os.path.join(d, "b.def"), "w") as f:
        f.write("k=v\nlast")
    open(os.path.join(d, "c.def"), "w").close()
    with open(os.path.join(d, "d.def"), "w", newline="") as f:
        f.write("one\rtwo\r\n\nfour\r")
    rows = scan_lines(spark, d).collect()
    by_file = {}
    for r in sorted(rows, key=lambda r: tuple(r.line_no)):
        by_file.setdefault(os.path.basename(r.file), []).append(r.line)
    assert by_file["a.def"] == ["WEB", "1", "http://x/y?z=1", "Selection=All"]
    assert by_file["b.def"] == ["k=v", "last"]
    assert "c.def" not in by_file
    assert by_file["d.def"] == ["one", "two", "", "four"]
    pairs = {(os.path.basename(r.file), r.key): r.value for r in kv_parse(scan_lines(spark, d)).collect()}
    assert pairs == {("a.def", "http://x/y?z"): "1", ("a.def", "Selection"): "All", ("b.def", "k"): "v"}


def test_xml_rows_ragged(spark):
    d = tempfile.mkdtemp(prefix="xml-", dir="/tmp")
    with open(os.path.join(d, "r.xml"), "w") as f:
        f.write("<xml xmlns:z='#RowsetSchema'><z:row ows_ID='1' ows_Title='x &amp; y'/>"
                "<z:row ows_ID='2' ows_Owner='me'/></xml>")
    got = sorted(tuple(r) for r in scan_xml_rows(spark, d).select("ows_ID", "ows_Title", "ows_Owner").collect())
    assert got == [("1", "x & y", None), ("2", None, "me")]


def test_xml_values_verbatim_attributes_only(spark):
    d = tempfile.mkdtemp(prefix="xml-", dir="/tmp")
    with open(os.path.join(d, "r.xml"), "w") as f:
        f.write("<xml xmlns:z='#RowsetSchema'><z:row ows_ID=' 1 ' ows_Title='null'/>"
                "<z:row ows_ID='2' ows_Title=''/><z:row ows_ID='3'>text</z:row></xml>")
    df = scan_xml_rows(spark, d)
    assert sorted(df.columns) == ["ows_ID", "ows_Title"]
    assert sorted(tuple(r) for r in df.select("ows_ID", "ows_Title").collect()) == \
        [(" 1 ", "null"), ("2", ""), ("3", None)]


def test_ragged_union(spark):
    a = spark.createDataFrame([("1", "x")], "id string, title string")
    b = spark.createDataFrame([("2", "me")], "id string, owner string")
    got = sorted(tuple(r) for r in ragged_union(a, b).select("id", "title", "owner").collect())
    assert got == [("1", "x", None), ("2", None, "me")]


SCHEMA = T.StructType([T.StructField("number", T.StringType()), T.StructField("state", T.StringType())])


def test_json_envelope_by_name_and_whole(spark):
    env = spark.createDataFrame(
        [('{"result":[{"number":"D1","state":"1"},{"state":"2","number":"D2"},{"number":"D3","state":"3"}]}',)],
        "body string")
    got = sorted(tuple(r) for r in explode_result(env, "body", SCHEMA).collect())
    assert got == [("D1", "1"), ("D2", "2"), ("D3", "3")]
    many = spark.range(250).selectExpr("""concat('{"number":"N', id, '","state":"1"}') AS r""")
    one = many.selectExpr("""concat('{"result":[', array_join(collect_list(r), ','), ']}') AS body""")
    assert explode_result(one, "body", SCHEMA).count() == 250  # whole, however long


def test_json_envelope_without_result_fails(spark):
    d = tempfile.mkdtemp(prefix="json-", dir="/tmp")
    with open(os.path.join(d, "e.json"), "w") as f:
        f.write('{"result":[{"number":"D1","state":"1"}]}\n{"error":"none"}\n')
    with pytest.raises(Exception, match="No results found"):
        scan_json_result(spark, d, SCHEMA).collect()


def test_split_line_reader_keeps_last_key_across_splits(spark):
    d = tempfile.mkdtemp(prefix="lines-big-", dir="/tmp")
    lines = [f"k{i % 7}=v{i}" for i in range(400)] + ["WEB=x", "tail=last"]
    with open(os.path.join(d, "big.def"), "w") as f:
        f.write("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")  # force many splits of one file
    try:
        split_df = scan_lines(spark, d)
        assert split_df.rdd.getNumPartitions() > 4
        got = {(r.key, r.value) for r in kv_parse(split_df).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {(r.key, r.value) for r in kv_parse(scan_lines(spark, d)).collect()}
    assert got == want
    assert ("k0", "v399") in got and ("tail", "last") in got
