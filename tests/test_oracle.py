"""Every registered query against its independent DuckDB SQL at sf0.01."""

import pytest

import __spark_entry__ as ent
from conftest import SF01, SF001
from oracle_check import compare
from strata.plans import registry

KEYS = sorted(registry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck01, key):
    sql = ent.oracle_sql().get(key)
    assert compare(spark, duck01, key, ent.queries()[key], sql, SF01)


@pytest.fixture(scope="module")
def duck001():
    from oracle_check import duck
    return duck(SF001)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle_smallest(spark, duck001, key):
    sql = ent.oracle_sql().get(key)
    assert compare(spark, duck001, key, ent.queries()[key], sql, SF001)


def test_every_key_has_oracle():
    assert set(registry.queries()) <= set(ent.oracle_sql())


def test_building_a_query_writes_nothing(spark, tmp_path, monkeypatch):
    def refuse(self):
        raise AssertionError("a write")

    monkeypatch.setattr(type(spark.range(1)), "write", property(refuse))
    for key, query in registry.queries().items():
        if key not in ("running_share", "json_pages"):  # an exact order is a written table's
            query(spark, SF001)


def test_entry_smoke(spark):
    df = ent.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[-1] == "pair_count"
    assert ent.entry(spark).schema == df.schema


def test_queries_run_on_smallest_scale(spark):
    for key, q in registry.queries().items():
        q(spark, SF001).write.format("noop").mode("overwrite").save()
