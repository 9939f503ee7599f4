"""A z-score that is the limit itself, as the SQL adds it up."""

from __future__ import annotations

import duckdb
from korridor.operators import windows


def test_limit_itself_is_judged_as_by_the_sql(spark):
    days = [(1, d, n) for d, n in enumerate([12, 12, 12, 12, 18, 18])] + [(2, d, n) for d, n in enumerate([18, 12, 18, 18, 18, 12])]
    got = windows.rolling_anomaly(spark.createDataFrame(days, "route_id long, day long, n long"), ["route_id"], "day", "n")
    con = duckdb.connect()
    con.execute("create table days(route_id bigint, day bigint, n bigint)")
    con.executemany("insert into days values (?, ?, ?)", days)
    want = con.execute("SELECT route_id, day, n, round(CASE WHEN s > 0 THEN (n - m) / s END, 6), coalesce(abs(CASE WHEN s > 0 THEN (n - m) / s END) > 2, false) FROM (SELECT *, avg(n) OVER w AS m, stddev_pop(n) OVER w AS s FROM days WINDOW w AS (PARTITION BY route_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) z").fetchall()
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    assert [x.anomalous for x in got.filter("day = 5").orderBy("route_id").collect()] == [False, True]
