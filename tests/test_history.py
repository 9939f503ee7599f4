"""Histories of keys with few rows are not cut by time; what a run fits on is worked out once."""

from __future__ import annotations

import os
import random
import re
from math import ceil

import pytest
from korridor import roles
from korridor.operators import asof, learning
from korridor.plans import contracts, models, windows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ASK = (["k"], "id", "cut", "at", "avail", "y", ["id"])


@pytest.fixture(scope="module")
def rows(spark):
    """A busy key, a null key, keys with few rows and one without an instant, over ten stretches."""
    rng, out = random.Random(5), []
    for i in range(900):
        at = rng.randrange(10_000)
        out.append(("busy" if i % 3 else rng.choice([None, "a", "b", "c", f"k{i}"]), i, None if i % 50 == 0 else at, at, at + rng.choice([0, 700, 2500]), float(i)))
    return spark.createDataFrame(out, "k string, id long, cut long, at long, avail long, y double").persist()


def test_keys_cut_and_not_cut_have_the_same_history(rows):
    want = sorted(map(str, asof.past_only_history_streamed(rows, *ASK, width=1000, most=0).collect()))
    for most in (1, 100, 10_000):  # nearly all, one, none cut
        assert sorted(map(str, asof.past_only_history_streamed(rows, *ASK, width=1000, most=most).collect())) == want


def test_a_key_of_few_rows_carries_nothing(rows):
    carried = lambda most: asof._carried(rows, *ASK, 7, 1000, most).filter("_asks = -1")
    assert carried(0).filter("k is distinct from 'busy'").count() > 0
    assert {x.k for x in carried(100).select("k").distinct().collect()} == {"busy"}
    assert carried(10_000).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize(("run", "best"), [(models.regression_run, "best_regressor"), (models.classification_run, "best_classifier")])
def test_a_run_works_its_history_out_once(spark, monkeypatch, run, best):
    calls, seen, fitted = [], [], getattr(learning, best)
    history = asof.past_only_history_streamed
    monkeypatch.setattr(asof, "past_only_history_streamed", lambda *a, **k: calls.append(a) or history(*a, **k))

    def watched(train, validation, *rest):
        seen.extend(x._jdf.queryExecution().optimizedPlan().toString() for x in (train, validation))
        kept = spark.sparkContext._jsc.getPersistentRDDs().size()
        out = fitted(train, validation, *rest)
        assert spark.sparkContext._jsc.getPersistentRDDs().size() - kept <= 1  # one frame is kept for all three sets
        return out

    monkeypatch.setattr(learning, best, watched)
    assert run(roles.Roles(spark, SF)).first().n > 0
    assert len(calls) == 1 and all("InMemoryRelation" in x for x in seen)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_tasks_share_one_spine(spark):
    frames = contracts.task_frames(roles.Roles(spark, SF))
    for name in ("occupancy", "headway", "delay_analytics", "route_clustering"):
        assert "lineitem" not in " ".join(frames[name].inputFiles()), name


def test_batches_hand_their_outcomes_on(spark, rows):
    """Against a plain loop, in batches that end inside keys and instants."""
    told, want = [tuple(x) for x in rows.select("k", "id", "cut", "at", "avail", "y").collect()], {}
    for k, i, cut, *_ in told:
        seen = sorted(((at, j, y) for key, j, _, at, avail, y in told if key == k and cut is not None and at < cut and avail <= cut), reverse=True)[:7]
        want[i] = (seen[0][2], round(sum(x[2] for x in seen) / len(seen), 9)) if seen else (None, None)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        got = asof.past_only_history_streamed(rows, *ASK, width=1000, most=100, parts=3).collect()
    finally:
        spark.conf.set(name, old)
    assert {x.id: (x.lag_1, x.mean_7 and round(x.mean_7, 9)) for x in got} == want and len(got) == len(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_parts_of_a_history_and_of_grains_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(roles, "PART_ROWS", 200)
    r = roles.Roles(spark, SF)
    assert windows.history_streamed(r).rdd.getNumPartitions() == ceil(2 * r.table("events").count() / 200)
    plan = contracts.task_contracts(r)._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"hashpartitioning\(trip_id#\d+L, seq#\d+, {r.parts}\)", plan)
