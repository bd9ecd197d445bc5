"""Records, attributes and lines whose shape is not known beforehand, the SQL
form of the updates, and publication by run date."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import SF001
from strata.operators.joins import join_like_nocase
from strata.operators.payment_history import php_periods, php_updates
from strata.plans import fixtures as fx
from strata.plans.report_job import publish_report, read_published
from strata.plans.updates_sql import php_updates_sql
from strata.session import scratch_path
from strata.sources.json import record_columns, records_by_name, result_pages, variant_records
from strata.sources.reversals import DATE_COLUMNS, extract_from_lines, normalize_reversals, scan_extract_lines
from strata.sources.xml import attribute_names, explode_xml_union


def test_records_are_bound_by_name_whatever_their_keys(spark):
    texts = ['{"result":[{"a":1,"b":"x"},{"b":"y","a":2.5},{"a b":"blank","it\'s":1,"say \\"hi\\"":true}]}',
             '{"result":[]}', '{"result":[{"b":null,"c":[1,{"d":2}]},{}]}', '{"result":[{"c":"text","n":123456789012}]}']
    df = spark.createDataFrame([(t, i, "keep") for i, t in enumerate(texts)], "body string, id int, result string")
    records = variant_records(df, "body", "result", keep=["id"])
    assert record_columns(records) == {"a": "double", "a b": "string", "b": "string", "c": "string", "it's": "bigint", "n": "bigint", 'say "hi"': "boolean"}
    rows = records_by_name(records, ["id"]).collect()
    assert rows[0].asDict() == {"id": 0, "a": 1.0, "a b": None, "b": "x", "c": None, "it's": None, "n": None, 'say "hi"': None}
    assert [(r["id"], r["a"], r["b"]) for r in rows] == [(0, 1.0, "x"), (0, 2.5, "y"), (0, None, None), (2, None, None), (2, None, None), (3, None, None)]
    assert (rows[2]["a b"], rows[2]["it's"], rows[2]['say "hi"']) == ("blank", 1, True)
    assert [r["c"] for r in rows][3:] == ['[1,{"d":2}]', None, "text"] and rows[5]["n"] == 123456789012
    declared = records_by_name(records, columns={"a": "string", "zz": "int"}).collect()
    assert [tuple(r) for r in declared][:2] == [("1", None), ("2.5", None)]


def test_records_without_result_fail_and_bad_text_is_null(spark):
    df = spark.createDataFrame([('{"other":1}',)], "body string")
    with pytest.raises(PySparkException):
        variant_records(df, "body", "result").collect()
    some = spark.createDataFrame([('{"k":1}',), ("no json",), (None,), ("7",)], "body string")
    assert [r["k"] for r in records_by_name(variant_records(some, "body")).collect()] == [1, None, None, None]


def test_pages_hold_every_record_once(spark):
    rows = [(i % 4, f"r{i}") for i in range(101)] + [(2, "same")] * 60
    pages = result_pages(spark.createDataFrame(rows, "k long, name string"), 10, ["k"]).collect()
    ordered = sorted(pages, key=lambda r: r["position"])
    assert [(r["k"], r["name"]) for r in ordered] == sorted(rows)
    assert [r["page"] for r in ordered] == [i // 10 for i in range(161)]
    with pytest.raises(ValueError):
        result_pages(spark.createDataFrame(rows, "k long, name string"), 0, ["k"])


def test_attributes_are_the_union_over_all_documents(spark):
    def document(*rows):
        return fx.XML_OPEN + "".join(rows) + fx.XML_CLOSE

    docs = [document("<z:row a='1' b='x &gt; y = z'/>", "<z:row b=\"it's c='3'\"/>"), document("<z:row\n a = '2'\tlater='&amp;'/>", "<z:row/>"), document()]
    df = spark.createDataFrame([(d,) for d in docs], "value string")
    assert attribute_names(df, "value") == ["a", "b", "later"]
    got = [tuple(r) for r in explode_xml_union(df, "value").collect()]
    assert got == [("1", "x > y = z", None), (None, "it's c='3'", None), ("2", None, "&"), (None, None, None)]


def test_lines_that_do_not_fit_are_kept_whole(spark):
    from pyspark.sql import types as T
    schema = T.StructType().add("LN_NO", "long").add("OTOD", "string").add("Note", "string")
    lines = ["1,01/02/2024,fine", "2,13/45/2024,\"a, b\"", "x,01/02/2024,no number", "3,01/02/2024", "4,1/2/2024,a,b", "", ",,", '5,"open,']
    got = normalize_reversals(extract_from_lines(spark.createDataFrame([(x,) for x in lines], "line string"), schema)).collect()
    assert [str(r["otod"]) for r in got[:2]] == ["2024-01-02", "None"] and got[1]["note"] == "a, b"
    assert [r["bad_line"] for r in got] == [None, None, *lines[2:5], *[r["bad_line"] for r in got[5:]]]
    assert all(r["ln_no"] is r["otod"] is r["note"] is None for r in got[2:5])
    assert got[6]["bad_line"] is None and got[6]["ln_no"] is None
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(x,) for x in lines[:5]], "line string").coalesce(1).write.text(path)
    assert scan_extract_lines(spark, path, schema).where("bad_line IS NULL").count() == 2


def test_all_six_text_dates_occur(spark):
    raw = extract_from_lines(fx.extract_csv_lines(spark, SF001), fx.CSV_SCHEMA)
    dates = normalize_reversals(raw)
    for c in DATE_COLUMNS:
        both = dates.select(F.col(c).alias("d")).withColumn("text", F.lit(None).cast("string"))
        assert both.schema["d"].dataType.typeName() == "date"
        assert raw.where(F.col(c) == fx.BROKEN_DATE_TEXT).count() > 0 and dates.where(F.col(c).isNotNull()).count() > 0


def test_sql_form_equals_the_operators(spark):
    x = fx.reversal_extract(spark, SF001)
    for as_of in (fx.AS_OF, fx.AS_OF.replace(year=2005)):
        want, got = php_updates(x, as_of), php_updates_sql(spark, x, php_periods(x), as_of)
        assert sorted(want.columns) == sorted(got.columns)
        assert got.select(*want.columns).exceptAll(want).count() == want.exceptAll(got.select(*want.columns)).count() == 0


def test_nocase_join_keeps_spellings(spark):
    left = spark.createDataFrame([("ReD rose", "K1"), ("red%", "k2"), ("RED", None), ("blue", "k1"), (None, "k1"), ("reD", "É")], "name string, k string")
    right = spark.createDataFrame([("k1",), ("K2",), (None,), ("é",)], "k2 string")
    got = sorted((r["name"], r["k"], r["k2"]) for r in join_like_nocase(left, right, "k", "k2", "name", "Red").collect())
    assert got == [("ReD rose", "K1", "k1"), ("reD", "É", "é"), ("red%", "k2", "K2")]
    assert [r["name"] for r in join_like_nocase(left, right, "k", "k2", "name", "RED%").collect()] == ["red%"]


def test_publication_shows_old_or_new_never_a_mixture(spark):
    base = scratch_path(spark, "published")
    rows = spark.range(100).selectExpr("id", "'first' AS run")
    publish_report(rows, "first label", base, fx.AS_OF)

    def shown():
        df, label = read_published(spark, base, fx.AS_OF)
        return {r["run"] for r in df.select("run").distinct().collect()}, df.count(), label

    assert shown() == ({"first"}, 100, "first label")
    dying = rows.selectExpr("IF(id < 50, id, CAST(raise_error('executor lost') AS BIGINT)) AS id", "'second' AS run").repartition(4)
    with pytest.raises(PySparkException):  # dies while the rows are written
        publish_report(dying, "second label", base, fx.AS_OF)
    assert shown() == ({"first"}, 100, "first label")
    new = rows.selectExpr("id", "'third' AS run").where("id < 70")
    with pytest.MonkeyPatch.context() as patch:  # dies between the rows and the label
        patch.setattr(type(spark), "range", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            publish_report(new, "third label", base, fx.AS_OF)
    assert shown() == ({"first"}, 100, "first label")
    publish_report(new, "third label", base, fx.AS_OF)  # the rerun
    assert shown() == ({"third"}, 70, "third label")
    publish_report(rows, "another day", base, fx.AS_OF.replace(day=1))
    assert shown() == ({"third"}, 70, "third label")
    with pytest.raises(ValueError):
        read_published(spark, base, fx.AS_OF.replace(day=2))
