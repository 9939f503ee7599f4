"""Lines are dealt out by trip in parts of a bounded number of rows."""

from __future__ import annotations

import os
from math import ceil

import pytest
from korridor import roles
from pyspark.sql import functions as F

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")



@pytest.mark.parametrize("rows", [500, 10_000])
def test_parts_follow_the_rows_and_keep_trips_whole(spark, monkeypatch, rows):
    monkeypatch.setattr(roles, "PART_ROWS", rows)
    r = roles.Roles(spark, SF)
    n = r.table("lineitem").count()
    parts = r.lines.rdd.glom().map(lambda x: (len(x), {y.l_orderkey for y in x})).collect()
    assert len(parts) == ceil(n / rows) and max(size for size, _ in parts) < 2 * rows
    assert sum(len(keys) for _, keys in parts) == r.lines.select("l_orderkey").distinct().count()
    plan = r.visits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # no sums before the lines are dealt out


def test_parts_of_the_spine_hold_where_vehicles_are_many(spark, monkeypatch):
    few = roles.Roles(spark, SF)
    want = sorted(map(str, few.spine.collect()))
    monkeypatch.setattr(roles, "PART_ROWS", 150)  # fewer than there are vehicles
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = roles.Roles(spark, SF)
        sizes = [len(x) for x in r.spine.rdd.glom().collect()]
        assert len(sizes) >= ceil(r.table("lineitem").count() / 150)
        assert sorted(map(str, r.spine.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_many_lines_are_grouped_without_a_sort(spark, monkeypatch, tmp_path):
    flags = ["", "é", "\uffee", "\U0001f600"]
    x = spark.read.parquet(f"{SF}/lineitem.parquet").withColumns({"l_linenumber": F.expr("l_linenumber % 2 + 1"), "l_returnflag": F.element_at(F.array(*map(F.lit, [*flags, None])), F.expr("cast(l_partkey % 5 + 1 as int)"))})
    x.write.parquet(f"{tmp_path}/lineitem.parquet")
    want = sorted(map(str, roles.Roles(spark, str(tmp_path)).visits.collect()))
    monkeypatch.setattr(roles, "PART_ROWS", 100)
    r = roles.Roles(spark, str(tmp_path))
    assert "Sort" not in r.visits._jdf.queryExecution().executedPlan().toString()
    assert r.directions == flags and sorted(map(str, r.visits.collect())) == want
    monkeypatch.setattr(roles, "CODES", 3)  # more directions than are numbered
    many = roles.Roles(spark, str(tmp_path))
    assert many.directions is None and sorted(map(str, many.visits.collect())) == want


def test_the_legacy_model_works_its_rows_out_once(spark, monkeypatch):
    from korridor.operators import learning
    from korridor.plans import contracts

    plans, build = [], learning.legacy_regressor

    def watched(*args):
        pipeline = build(*args)
        monkeypatch.setattr(pipeline, "fit", lambda train: plans.append(train._jdf.queryExecution().executedPlan().toString()) or type(pipeline).fit(pipeline, train))
        return pipeline

    monkeypatch.setattr(learning, "legacy_regressor", watched)
    assert contracts.legacy_model(roles.Roles(spark, SF)).first().n > 0
    assert "InMemoryTableScan" in plans[0]
