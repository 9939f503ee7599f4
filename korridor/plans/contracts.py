"""Contracts between stages: schemas, packages, predictions, reports and the gates that hold them."""

from __future__ import annotations

import importlib
import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korridor.functions import scalars
from korridor.operators import eligibility, learning, metrics, transit, whatif, windows
from korridor.plans.delivery import CASES, cases, scratch
from korridor.plans.models import SCORED, scored
from korridor.plans.registry import portable, query
from korridor.plans.relational import YEAR_1996, occupancy_candidates
from korridor.roles import Roles, seconds
from korridor.sources import files, handoff



@query("s03_schema_catalog", "SELECT 21 AS tables_n, 14 AS shared_n, true AS shared_first, 0 AS repeated_columns")
def schema_catalog(r: Roles) -> DataFrame:
    """Every table's schema parses, begins with the shared columns and names no column twice."""
    from korridor.schemas import TABLES, schema_for

    schemas = {t: schema_for(t) for t in TABLES}
    shared = next(iter(schemas.values())).names[:14]
    first, repeated = all(s.names[:14] == shared for s in schemas.values()), sum(len(s.names) - len(set(s.names)) for s in schemas.values())
    return r.spark.createDataFrame([(len(schemas), len(shared), first, repeated)], "tables_n int, shared_n int, shared_first boolean, repeated_columns int")


@query("s09_discovered_files", "SELECT 'region' AS table_name, true AS found, count(*) AS n FROM region UNION ALL SELECT 'nation', true, count(*) FROM nation UNION ALL SELECT 'absent', false, 0")
def discovered_files(r: Roles) -> DataFrame:
    root, out = scratch(r), []
    for t in ("region", "nation"):
        files.write_csv(r.table(t), f"{root}/{t}")
    for t in ("region", "nation", "absent"):
        try:
            out.append((t, True, r.spark.read.options(**{k: v for k, v in files.CSV.items() if k != "mode"}).csv(files.discover(r.spark, root, [t])[t]).count()))
        except FileNotFoundError:
            out.append((t, False, 0))
    return r.spark.createDataFrame(out, "table_name string, found boolean, n long")


@query("s12_excluded_load", "SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS l_quantity, l_returnflag FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def excluded_load(r: Roles) -> DataFrame:
    raw = r.table("lineitem").select(*(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")))
    excluded = r.table("orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("l_orderkey"))
    return files.load_typed(raw, {"l_orderkey": "INT", "l_linenumber": "INT", "l_quantity": "REAL", "l_returnflag": "TEXT"}, "l_orderkey", excluded)


@query("s14_json_package", f"SELECT case_id, split, target FROM ({CASES}) c ORDER BY sha256('s14|' || case_id), case_id LIMIT 500")
def json_package(r: Roles) -> DataFrame:
    """A bounded package: written and certified, then read back against its certificate and a cap on its rows."""
    path = scratch(r)
    sample = cases(r).orderBy(F.sha2(F.concat(F.lit("s14|"), F.col("case_id").cast("string")), 256), "case_id").limit(500)
    handoff.write_handoff(sample, path, "crowding", ["stop_sequence"])
    return files.bounded(handoff.read_handoff(r.spark, path), 100_000).select("case_id", "split", "target")


@query("s15_test_predictions", "SELECT trip_id, seq, boardings > 25 AS prediction FROM spine WHERE service_date >= DATE '2000-01-01'")
def test_predictions(r: Roles) -> DataFrame:
    path, trip = scratch(r), F.col("trip_id").cast("string")
    name = F.concat(F.length(trip).cast("string"), F.lit(":"), trip, F.col("seq").cast("string"))
    split = F.when(F.col("service_date") >= F.lit("2000-01-01").cast("date"), "test").otherwise("train")
    r.spine.select(F.lit("spark").alias("engine"), F.lit("sample-1").alias("dataset"), split.alias("split"), name.alias("case_id"), (F.col("boardings") > 25).alias("prediction")).write.json(path)
    return files.read_predictions(r.spark, path, "spark", "sample-1").select(F.col("trip").cast("long").alias("trip_id"), F.col("event").cast("int").alias("seq"), "prediction")


@query("p15_package_contract", f"""WITH c AS (SELECT c.*, t.passenger_id, CASE split WHEN 'train' THEN 915148800 WHEN 'validation' THEN 946684800 ELSE 1009843200 END AS end_s FROM ({CASES}) c JOIN trips t ON t.trip_id = c.case_id // 10)
SELECT 'unique_case' AS rule, count(*) - count(DISTINCT case_id) AS violations FROM c UNION ALL SELECT 'split_agrees', count(*) FILTER (target_s >= end_s) FROM c UNION ALL SELECT 'horizon_inside', count(*) FILTER (target_available_s > end_s) FROM c
UNION ALL SELECT 'known_in_time', count(*) FILTER (value_available_s > feature_cutoff_s) FROM c UNION ALL SELECT 'lineage_in_one_split', count(*) FROM (SELECT passenger_id FROM c GROUP BY passenger_id HAVING count(DISTINCT split) > 1) l""")
def package_contract(r: Roles) -> DataFrame:
    """Violations of each rule that a package of cases has to keep."""
    ends = F.when(F.col("split") == "train", 915_148_800).when(F.col("split") == "validation", 946_684_800).otherwise(1_009_843_200)
    c = cases(r).withColumn("trip_id", F.expr("case_id div 10")).join(r.trips.select("trip_id", "passenger_id"), "trip_id")
    bad = {"split_agrees": F.col("target_s") >= ends, "horizon_inside": F.col("target_available_s") > ends, "known_in_time": F.col("value_available_s") > F.col("feature_cutoff_s")}
    rows = c.agg(*(F.count_if(v).alias(k) for k, v in bad.items())).unpivot([], list(bad), "rule", "violations")
    twice = c.groupBy("case_id").agg(F.count("*").alias("n")).agg(F.lit("unique_case").alias("rule"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    several = c.select("passenger_id", "split").distinct().groupBy("passenger_id").agg(F.count("*").alias("n")).filter("n > 1").agg(F.lit("lineage_in_one_split").alias("rule"), F.count("*").alias("violations"))
    return rows.unionByName(twice).unionByName(several)


@query("j22_fingerprint_membership", "SELECT t.status, floor(t.fare) = t.fare AND t.route_id IS NOT NULL AS matched, count(*) AS n FROM trips t GROUP BY 1, 2")
def fingerprint_membership(r: Roles) -> DataFrame:
    """Tickets against requests whose fares are whole: an id joins, and the digests of both business tuples must agree."""
    digest = lambda fare: F.md5(F.concat_ws("|", F.col("passenger_id").cast("string"), F.coalesce(F.col("route_id").cast("string"), F.lit("\\N")), F.col("status"), fare.cast("decimal(20,4)").cast("string")))
    requests = r.trips.select(F.xxhash64("trip_id").alias("key"), digest(F.floor("fare")).alias("request"))
    tickets = r.trips.select("status", F.xxhash64("trip_id").alias("key"), digest(F.col("fare")).alias("ticket"))
    return tickets.join(requests, "key", "left").groupBy("status", F.coalesce(F.col("ticket") == F.col("request"), F.lit(False)).alias("matched")).agg(F.count("*").alias("n"))


_HOUR, _WEEKDAY = "CAST(floor(scheduled_s / 3600) AS BIGINT) % 24", "(CAST(floor(scheduled_s / 86400) AS BIGINT) + 3) % 7 + 1"


@query("a22_movement_counters", f"""SELECT 'month' AS counter, substr(CAST(service_date AS VARCHAR), 1, 7) AS value, sum(boardings)::BIGINT AS movements FROM spine GROUP BY ALL UNION ALL SELECT 'weekday', CAST({_WEEKDAY} AS VARCHAR), sum(boardings)::BIGINT FROM spine GROUP BY ALL
UNION ALL SELECT 'peak', CASE WHEN {_HOUR} BETWEEN 7 AND 9 OR {_HOUR} BETWEEN 16 AND 19 THEN 'peak' ELSE 'off-peak' END, sum(boardings)::BIGINT FROM spine GROUP BY ALL UNION ALL SELECT 'pattern', route_id || '/' || direction, sum(boardings)::BIGINT FROM spine GROUP BY ALL""")
def movement_counters(r: Roles) -> DataFrame:
    """Four counters in one pass: each row is summed under its month, weekday, peak and pattern at once."""
    hour = F.floor(F.col("scheduled_s") / 3600) % 24
    keys = {"month": F.date_format("service_date", "yyyy-MM"), "weekday": transit.iso_weekday("scheduled_s").cast("string"), "peak": F.when(hour.between(7, 9) | hour.between(16, 19), "peak").otherwise("off-peak"), "pattern": F.concat_ws("/", F.col("route_id").cast("string"), "direction")}
    x = r.spine.select("boardings", *(c.alias(k) for k, c in keys.items())).groupBy(*keys).agg(F.sum("boardings").alias("b"))  # small before it is spread
    return x.select("b", F.explode(F.array(*(F.struct(F.lit(k).alias("counter"), F.col(k).alias("value")) for k in keys))).alias("c")).groupBy("c.counter", "c.value").agg(F.sum("b").cast("long").alias("movements"))


@query("a23_expected_flow", "SELECT l_orderkey AS trip_id, l_linenumber AS seq, (count(*) * 1048576 + count(*) FILTER (l_returnflag = 'R'))::BIGINT AS packed FROM lineitem GROUP BY l_orderkey, l_linenumber")
def expected_flow(r: Roles) -> DataFrame:
    """Two counts by stop event, joined and packed into one number."""
    on = r.table("lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("seq"), "l_returnflag")
    boardings, alightings = on.groupBy("trip_id", "seq").agg(F.count("*").alias("b")), on.filter("l_returnflag = 'R'").groupBy("trip_id", "seq").agg(F.count("*").alias("a"))
    return boardings.join(alightings, ["trip_id", "seq"], "left").select("trip_id", "seq", (F.col("b") * (1 << 20) + F.coalesce("a", F.lit(0))).alias("packed"))


@query("f19_patterns", "SELECT stop_id, regexp_full_match(stop_code, '[A-Za-z0-9][A-Za-z0-9._-]*') AS component, regexp_full_match(replace(stop_code, '#', '-'), '[A-Za-z0-9][A-Za-z0-9._-]*') AS cleaned, regexp_full_match(sha256(stop_code), '[0-9a-f]{64}') AS digest FROM stops")
def patterns(r: Roles) -> DataFrame:
    component = "^[A-Za-z0-9][A-Za-z0-9._-]*$"
    return r.stops.select("stop_id", F.col("stop_code").rlike(component).alias("component"), F.regexp_replace("stop_code", "#", "-").rlike(component).alias("cleaned"), F.sha2("stop_code", 256).rlike("^[0-9a-f]{64}$").alias("digest"))


@query("m17_result_contract", f"""WITH s AS ({SCORED}) SELECT 'unique_case' AS rule, count(*) - count(DISTINCT case_id) AS violations FROM s UNION ALL SELECT 'declared_label', count(*) FILTER (actual NOT IN (0, 1) OR predicted NOT IN (0, 1)) FROM s UNION ALL SELECT 'probability', count(*) FILTER (probability IS NULL OR probability < 0 OR probability > 1) FROM s
UNION ALL SELECT 'dated', count(*) FILTER (service_date IS NULL) FROM s UNION ALL SELECT 'probability_agrees', count(*) FILTER ((probability > 0.25) <> (predicted = 1)) FROM s""")
def result_contract(r: Roles) -> DataFrame:
    s = scored(r)
    p, label = F.col("probability"), lambda c: ~F.col(c).isin(0, 1)
    rules = {"declared_label": label("actual") | label("predicted"), "probability": p.isNull() | F.isnan(p) | ~p.between(0, 1), "dated": F.col("service_date").isNull(), "probability_agrees": (p > 0.25) != (F.col("predicted") == 1)}
    twice = s.groupBy("case_id").agg(F.count("*").alias("n")).agg(F.lit("unique_case").alias("rule"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    return s.agg(*(F.count_if(v).alias(k) for k, v in rules.items())).unpivot([], list(rules), "rule", "violations").unionByName(twice)


@query("b05_acceptance", f"WITH s AS ({SCORED}), c AS (SELECT k, count(*) FILTER (actual = k AND predicted = k) AS tp, count(*) FILTER (actual = k) AS a, count(*) FILTER (predicted = k) AS p FROM s CROSS JOIN (VALUES (0), (1)) v(k) GROUP BY k) SELECT round(sum(tp) / sum(a), 6) AS accuracy, round(avg(2 * tp / (a + p)), 6) AS macro_f1, sum(tp) / sum(a) >= 0.85 OR avg(2 * tp / (a + p)) >= 0.8 AS accepted FROM c")
def acceptance(r: Roles) -> DataFrame:
    """Accuracy and macro F1 as recomputed from the confusion matrix, which is all that is kept of a run."""
    cells = metrics.confusion(scored(r), "actual", "predicted")
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    sides = cells.select(F.explode(F.array(F.struct(F.col("actual").alias("k"), F.col("n").alias("n")), F.struct(F.col("predicted").alias("k"), F.col("n").alias("n")))).alias("s"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"))
    f1 = sides.groupBy("s.k").agg(F.sum("s.n").alias("both"), F.sum("tp").alias("tp2")).agg(F.avg(F.col("tp2") / F.col("both")).alias("macro"))
    x = cells.agg((hit / F.sum("n")).alias("acc")).crossJoin(F.broadcast(f1))  # one row each
    return x.select(F.round("acc", 6).alias("accuracy"), F.round("macro", 6).alias("macro_f1"), ((F.col("acc") >= 0.85) | (F.col("macro") >= 0.8)).alias("accepted"))


_FLOORS = {"movements": ("sum(boardings)", 1_000_000), "late_events": ("count_if(actual_s > scheduled_s)", 10_000), "overloaded": ("count_if(boardings > capacity)", 1_000), "routes": ("count(DISTINCT route_id)", 20), "months": ("count(DISTINCT date_trunc('month', service_date))", 18), "stops": ("count(DISTINCT stop_id)", 50)}


@query("b06_thresholds", " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST({e} AS BIGINT) AS measured, {n}::BIGINT AS floor, {e} >= {n} AS met FROM spine" for k, (e, n) in _FLOORS.items()))
def thresholds(r: Roles) -> DataFrame:
    """All measures in one pass over the facts, each against its floor."""
    x = r.spine.agg(*(F.expr(e).cast("long").alias(k) for k, (e, _) in _FLOORS.items())).unpivot([], list(_FLOORS), "metric", "measured")
    floor = F.element_at(F.create_map(*(F.lit(v) for k, (_, n) in _FLOORS.items() for v in (k, n))), F.col("metric")).cast("long")
    return x.withColumn("floor", floor).withColumn("met", F.col("measured") >= F.col("floor"))


@query("b03_dashboard", "WITH s AS (SELECT 'trips' AS section, count(*) AS n FROM trips UNION ALL SELECT 'late', count(*) FROM spine WHERE actual_s > scheduled_s UNION ALL SELECT 'overloaded', count(*) FROM spine WHERE boardings > capacity) SELECT 'one version' AS report, 'ready' AS status, section, n FROM s UNION ALL SELECT 'mixed versions', 'not_ready', NULL, NULL")
def dashboard(r: Roles) -> DataFrame:
    """Sections of one dataset version make a report; of several, the whole report is not ready."""
    late, over = r.spine.filter("actual_s > scheduled_s"), r.spine.filter("boardings > capacity")
    section = lambda df, name, version: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n", F.lit(version).alias("version"))
    out = None
    for report, versions in (("one version", ("v1", "v1", "v1")), ("mixed versions", ("v1", "v2", "v1"))):
        x = section(r.trips, "trips", versions[0]).unionByName(section(late, "late", versions[1])).unionByName(section(over, "overloaded", versions[2]))
        mixed = len(set(versions)) > 1
        part = r.spark.createDataFrame([(report, "not_ready", None, None)], "report string, status string, section string, n long") if mixed else x.select(F.lit(report).alias("report"), F.lit("ready").alias("status"), "section", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("e05_state_validation", "SELECT r.route_id, v.variant, v.problem FROM (SELECT DISTINCT route_id FROM spine) r CROSS JOIN (VALUES ('whole', NULL), ('no trips', 'NO_TRIPS'), ('no capacity', 'CAPACITY'), ('late trip', 'MINUTE_OUTSIDE'), ('short', 'NOT_COVERED'), ('gap', 'GAP'), ('reversed', 'INTERVAL')) v(variant, problem)")
def state_validation(r: Roles) -> DataFrame:
    """A state and broken forms of it, and what the check before a simulation says of each."""
    trip = lambda minute, capacity: F.struct(F.lit(float(minute)).alias("minute"), F.lit(float(capacity)).alias("capacity"))
    part = lambda a, b: F.struct(F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end"), F.lit(30.0).alias("passengers"))
    trips, profile, none = F.array(trip(30, 40), trip(60, 40)), F.array(part(0, 30), part(30, 60)), F.filter(F.array(trip(1, 1)), lambda t: t["minute"] > 5)
    forms = {"whole": (trips, profile), "no trips": (none, profile), "no capacity": (F.array(trip(30, 0)), profile), "late trip": (F.array(trip(90, 40)), profile), "short": (trips, F.array(part(0, 30))), "gap": (trips, F.array(part(0, 20), part(30, 60))), "reversed": (trips, F.array(part(30, 0), part(30, 60)))}
    routes = r.spine.select("route_id").distinct()
    x = routes.select("route_id", F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), t.alias("trips"), p.alias("profile")) for k, (t, p) in forms.items()))).alias("f")).select("route_id", "f.*")
    return x.select("route_id", "variant", whatif.state_problem(60.0).alias("problem"))


#: families of defects and how a row gets one; each is put into the 25 rows with the least digests
_DEFECTS = {"negative_count": ("boardings", "-1 - boardings", "boardings < 0"), "early_departure": ("actual_s", "scheduled_s - 1", "actual_s < scheduled_s AND actual_s = scheduled_s - 1"), "impossible_load": ("boardings", "capacity * 100 + 1000000", "boardings >= 1000000"), "unknown_stop": ("stop_id", "-7", "stop_id = -7"), "no_direction": ("direction", "NULL", "direction IS NULL")}


@query("v43_dq_fixtures", "SELECT family, 25::BIGINT AS injected, 25::BIGINT AS found, true AS reconciled FROM (VALUES ('negative_count'), ('early_departure'), ('impossible_load'), ('unknown_stop'), ('no_direction')) f(family)")
def dq_fixtures(r: Roles) -> DataFrame:
    """Defects are injected by a ledger; the check of each family must find the rows of the ledger, all of them and no others."""
    out = None
    whole = r.spine.filter("boardings >= 0 AND boardings < 1000000 AND direction IS NOT NULL AND capacity IS NOT NULL AND actual_s <> scheduled_s - 1")
    for family, (column, value, check) in _DEFECTS.items():
        ledger = whole.select("trip_id", "seq").orderBy(scalars.rank_digest(family, "trip_id"), "trip_id", "seq").limit(25).withColumn("injected", F.lit(True))
        x = whole.join(F.broadcast(ledger), ["trip_id", "seq"], "left")  # 25 rows
        x = x.withColumn(column, F.when(F.col("injected"), F.expr(value)).otherwise(F.col(column)))
        hit = F.coalesce(F.expr(check), F.lit(False))
        part = x.agg(F.lit(family).alias("family"), F.count("injected").alias("injected"), F.count_if(hit & F.col("injected")).alias("found"), (F.count_if(hit != F.coalesce("injected", F.lit(False))) == 0).alias("reconciled"))
        out = part if out is None else out.unionByName(part)
    return out


@query("v55_schema", "SELECT 'header' AS check_name, 0::BIGINT AS as_written, 1::BIGINT AS as_changed UNION ALL SELECT 'ordinals', 0, count(DISTINCT trip_id) FROM visits WHERE direction = 'R' UNION ALL SELECT 'raw_hash', 0, count(*) FROM visits WHERE direction = 'R' UNION ALL SELECT 'types', 0, count(*) FROM visits WHERE direction = 'R' UNION ALL SELECT 'mirror', 0, count(*) FROM visits WHERE direction = 'R'")
def schema_checks(r: Roles) -> DataFrame:
    """Header, ordinals, raw hashes, types and the JSON mirror of row envelopes, as written and with returned visits changed."""
    e = files.envelope(r.visits, ["trip_id", "seq"], ["stop_id", "boardings"]).select("trip_id", "row_ordinal", "raw_record_text", "raw_sha256", "direction", F.to_json(F.struct("boardings", "stop_id")).alias("mirror"))
    returned, header = F.col("direction") == "R", ["trip_id", "row_ordinal", "raw_record_text", "raw_sha256", "direction", "mirror"]
    changed = e.select(*reversed(header)).withColumns({"row_ordinal": F.when(returned, F.col("row_ordinal") + 1000).otherwise(F.col("row_ordinal")), "raw_record_text": F.when(returned, F.lit('{"boardings":"many"}')).otherwise(F.col("raw_record_text"))})

    def checks(x: DataFrame, name: str) -> DataFrame:
        parsed = F.get_json_object("raw_record_text", "$.boardings").try_cast("long")
        rows = x.agg(F.lit(int(x.columns != header)).cast("long").alias("header"), F.count_if(F.sha2("raw_record_text", 256) != F.col("raw_sha256")).alias("raw_hash"), F.count_if(parsed.isNull()).alias("types"), F.count_if(F.col("raw_record_text") != F.col("mirror")).alias("mirror"))
        gaps = x.groupBy("trip_id").agg((F.max("row_ordinal") - F.min("row_ordinal") + 1 != F.count("*")).alias("gap"), (F.min("row_ordinal") != 1).alias("late")).agg(F.count_if(F.col("gap") | F.col("late")).alias(name))
        return rows.unpivot([], ["header", "raw_hash", "types", "mirror"], "check_name", name).unionByName(gaps.select(F.lit("ordinals").alias("check_name"), name))

    return checks(e, "as_written").join(F.broadcast(checks(changed, "as_changed")), "check_name")  # five rows


_GATE = {
    "regions": ("count(*) FROM region", "5"), "routes": ("count(*) FROM nation", "count(DISTINCT n_name) FROM nation"), "route_parents": ("count(DISTINCT n_regionkey) FROM nation", "count(*) FROM region"), "stops": ("count(*) FROM supplier", "count(DISTINCT s_suppkey) FROM supplier"),
    "stop_zones": ("count(DISTINCT s_nationkey) FROM supplier", "count(*) FROM nation"), "vehicles": ("count(*) FROM part", "20 * count(*) FROM supplier"), "vehicle_ids": ("max(p_partkey) FROM part", "count(*) FROM part"), "passengers": ("count(*) FROM customer", "15 * count(*) FROM supplier"),
    "passenger_zones": ("count(DISTINCT c_nationkey) FROM customer", "count(*) FROM nation"), "trips": ("count(*) FROM orders", "10 * count(*) FROM customer"), "trip_ids": ("count(DISTINCT o_orderkey) FROM orders", "count(*) FROM orders"), "statuses": ("count(DISTINCT o_orderstatus) FROM orders", "3"),
    "priorities": ("count(DISTINCT o_orderpriority) FROM orders", "5"), "movements": ("count(*) FROM lineitem", "4 * count(*) FROM orders"), "directions": ("count(DISTINCT l_returnflag) FROM lineitem", "3"), "sequence": ("max(l_linenumber) FROM lineitem", "7"), "first_sequence": ("min(l_linenumber) FROM lineitem", "1"),
    "requests": ("count(*) FROM events", "count(DISTINCT event_id) FROM events"), "request_kinds": ("count(DISTINCT event_type) FROM events", "5"), "travelled_vehicles": ("count(DISTINCT l_partkey) FROM lineitem", "count(*) FROM part"), "travelled_stops": ("count(DISTINCT l_suppkey) FROM lineitem", "count(*) FROM supplier"),
    "travelled_trips": ("count(DISTINCT l_orderkey) FROM lineitem", "count(*) FROM orders"), "travelling_passengers": ("count(DISTINCT o_custkey) FROM orders", "count(*) FROM customer"), "known_statuses": ("count(*) FROM orders WHERE o_orderstatus IN ('O', 'F', 'P')", "count(*) FROM orders"),
}
portable("v56_count_gate", "\nUNION ALL\n".join(f"SELECT '{k}' AS metric, CAST(m.v AS BIGINT) AS measured, CAST(g.v AS BIGINT) AS goal, m.v = g.v AS met FROM (SELECT {a.replace(' FROM', ' AS v FROM', 1)}) m CROSS JOIN (SELECT {b.replace(' FROM', ' AS v FROM', 1) if 'FROM' in b else b + ' AS v'}) g" for k, (a, b) in _GATE.items()))


@query("x01_grouped_function", "SELECT row_id, round(sum(target) OVER (PARTITION BY route_id, kind ORDER BY at_s, row_id), 4) AS so_far FROM observations")
def grouped_function(r: Roles) -> DataFrame:
    """Own code over each group's sorted rows, an Arrow table at a time."""

    def run(rows: pa.Table) -> pa.Table:
        x = rows.sort_by([("at_s", "ascending"), ("row_id", "ascending")])
        import pyarrow.compute as pc

        return pa.table({"row_id": x["row_id"], "so_far": pc.cumulative_sum(x["target"])})

    x = r.observations.select("route_id", "kind", "row_id", "at_s", "target")
    return x.groupBy("route_id", "kind").applyInArrow(run, "row_id long, so_far double").select("row_id", F.round("so_far", 4).alias("so_far"))


def certified(spec: str, rows: DataFrame) -> DataFrame:
    """What the callable named ``module:object`` says of ``rows``: a frame with one boolean column ``certified``."""
    module, _, name = spec.partition(":")
    if not module or not name.isidentifier():
        raise ValueError(f"not module:object: {spec!r}")
    out = getattr(importlib.import_module(module), name)(rows)
    if out.columns != ["certified"]:
        raise TypeError(f"{spec} does not give one column 'certified'")
    return out


def every_trip_dated(rows: DataFrame) -> DataFrame:
    return rows.agg((F.count_if(F.col("service_date").isNull()) == 0).alias("certified"))


@query("x02_certification_hook", "SELECT count(*) FILTER (service_date IS NULL) = 0 AS certified, true AS refused FROM trips")
def certification_hook(r: Roles) -> DataFrame:
    try:
        certified("korridor.plans.contracts", r.trips)
        refused = False
    except ValueError:
        refused = True
    return certified("korridor.plans.contracts:every_trip_dated", r.trips).withColumn("refused", F.lit(refused))


@query("m07_legacy_model", None)
def legacy_model(r: Roles) -> DataFrame:
    """The legacy regression of boardings on categories and calendar, scored on later days."""
    x = r.spine.select(F.col("route_id").cast("string").alias("route"), "direction", transit.hour("scheduled_s").cast("double").alias("event_hour"), transit.iso_weekday("scheduled_s").cast("double").alias("weekday"), F.col("boardings").cast("double").alias("label"), "service_date").persist()  # fitting reads it several times
    train, test = x.filter("service_date < DATE'1999-01-01'"), x.filter("service_date >= DATE'1999-01-01'")
    model = learning.legacy_regressor(["route", "direction"], ["event_hour", "weekday"], "label").fit(train)
    path = scratch(r)
    files.write_once(metrics.regression(model.transform(test), "label", "prediction"), path)
    x.unpersist()
    return r.spark.read.parquet(path)



@query("s08_projected_scan", "SELECT o_orderkey, o_orderstatus, true AS refused FROM orders")
def projected_scan(r: Roles) -> DataFrame:
    """Two columns of typed CSV; asking for one that the table lacks, or leaving a required one out, is refused."""
    path, o = scratch(r), r.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    files.write_csv(o, path)
    refused = 0
    for columns, required in ((["o_orderkey", "nothing"], []), (["o_orderkey"], ["o_orderstatus"])):
        try:
            files.read_projected(r.spark, path, o.schema, columns, required)
        except ValueError:
            refused += 1
    return files.read_projected(r.spark, path, o.schema, ["o_orderkey", "o_orderstatus"], ["o_orderkey"]).withColumn("refused", F.lit(refused == 2))


@query("s11_projected_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def projected_columns(r: Roles) -> DataFrame:
    """Named columns out of CSV shards that lie in several folders."""
    path, c = scratch(r), r.table("customer").select("c_custkey", "c_name", "c_mktsegment")
    files.write_csv(c.filter("c_mktsegment < 'C'"), f"{path}/one")
    files.write_csv(c.filter("NOT c_mktsegment < 'C'"), f"{path}/two")
    both = [files.read_projected(r.spark, f"{path}/{d}", c.schema, ["c_custkey", "c_mktsegment"]) for d in ("one", "two")]
    return both[0].unionByName(both[1])


@query("s16_catalog_page", "SELECT s_suppkey AS stop_id, s_name AS stop_code FROM supplier WHERE s_nationkey = 3 AND s_acctbal >= 0 ORDER BY s_name, s_suppkey LIMIT 10 OFFSET 1")
def catalog_page(r: Roles) -> DataFrame:
    """A page of a certified catalogue: rows that are valid on the day (a stop in debt no longer is), one zone, in order."""
    path, day = scratch(r), 900_000_000
    debt = r.table("supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("stop_id"), F.lit(True).alias("debt"))
    ends = F.when(F.col("debt"), F.lit(day)).otherwise(F.lit(2 * day)).cast("long")
    stops = r.stops.join(debt, "stop_id", "left").select(F.lit("stop").alias("split"), F.col("stop_id").alias("case_id"), "stop_code", "zone_id", F.lit(0).cast("long").alias("value_available_s"), F.lit(0).cast("long").alias("feature_cutoff_s"), F.lit(0).cast("long").alias("target_s"), ends.alias("target_available_s"), F.lit(0).alias("target"))
    handoff.write_handoff(stops, path, "catalogue", ["zone_id"])
    x = handoff.read_handoff(r.spark, path).filter((F.col("value_available_s") <= day) & (day < F.col("target_available_s")) & (F.col("zone_id") == 3))
    return x.orderBy("stop_code", "case_id").offset(1).limit(10).select(F.col("case_id").alias("stop_id"), "stop_code")


@query("k04_write_once", "SELECT true AS reserved, true AS second_refused, true AS written, true AS rewrite_refused, true AS late_reserve_refused")
def write_once(r: Roles) -> DataFrame:
    """A path is claimed by one run, written once, and can be neither claimed nor written again."""
    path = scratch(r)

    def refused(work) -> bool:
        try:
            work()
        except Exception as e:
            if "exist" not in str(e).lower() and "delivery-" not in str(e):
                raise
            return True
        return False

    out = [not refused(lambda: files.reserve(r.spark, path, "run-1")), refused(lambda: files.reserve(r.spark, path, "run-2")), not refused(lambda: files.write_once(r.table("region"), path)), refused(lambda: files.write_once(r.table("region"), path)), refused(lambda: files.reserve(r.spark, path, "run-3"))]
    return r.spark.createDataFrame([tuple(out)], "reserved boolean, second_refused boolean, written boolean, rewrite_refused boolean, late_reserve_refused boolean")


@query("k05_run_path", "SELECT route_code AS dataset, CASE WHEN regexp_full_match(route_code, '[A-Za-z0-9][A-Za-z0-9._-]*') THEN 'x/runs/stage=features/dataset=' || route_code || '/run=r.1' END AS path FROM routes")
def run_paths(r: Roles) -> DataFrame:
    """The path of a run for each route's name as dataset; names that are no path components have none. One row a route."""
    out = []
    for (name,) in files.bounded(r.routes.select("route_code"), 1000).collect():
        try:
            out.append((name, files.run_path("x", "features", name, "r.1")))
        except ValueError:
            out.append((name, None))
    return r.spark.createDataFrame(out, "dataset string, path string")


@query("k08_evidence_append", "SELECT kind AS stage, count(*) AS rows, max(at_s) AS recorded_s FROM observations WHERE kind <> 'error' GROUP BY kind")
def evidence_append(r: Roles) -> DataFrame:
    """Each stage's record is appended when it ends; every reader takes the last successful one of a stage."""
    path = scratch(r)
    stages = r.observations.groupBy("kind").agg(F.count("*").alias("rows"), F.max("at_s").alias("recorded_s"))
    for status, shift in (("STARTED", -10), ("SUCCESS", -5), ("SUCCESS", 0)):
        done = stages.select(F.lit("run-1").alias("run_id"), F.col("kind").alias("stage"), F.when(F.col("kind") == "error", "FAILED").otherwise(status).alias("status"), (F.col("recorded_s") + shift).alias("recorded_s"), F.when(F.lit(shift == 0), F.col("rows")).otherwise(0).alias("rows"))
        done.coalesce(1).write.mode("append").json(path)
    log = r.spark.read.schema("run_id string, stage string, status string, recorded_s long, rows long").json(path).filter("status = 'SUCCESS'")
    return log.groupBy("stage").agg(F.max_by("rows", "recorded_s").alias("rows"), F.max("recorded_s").alias("recorded_s"))


@query("e07_evidence_package", "SELECT row_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, sha256(props) AS source_sha256, row_id <> 0 AND kind <> 'error' AS bound FROM observations")
def evidence_package(r: Roles) -> DataFrame:
    """Pointers into sources bound by digest: a source that was changed after it was bound resolves, but is not bound."""
    bound = r.observations.select("row_id", F.sha2("props", 256).alias("source_sha256"))
    now = r.observations.select("row_id", F.when((F.col("kind") == "error") | (F.col("row_id") == 0), F.concat("props", F.lit(" "))).otherwise(F.col("props")).alias("props"))
    return bound.join(now, "row_id").select("row_id", scalars.pointer("props", "/k").cast("long").alias("k"), "source_sha256", (F.sha2("props", 256) == F.col("source_sha256")).alias("bound"))


@query("r03_stop_overlay", """WITH d AS (SELECT max(service_date) AS d FROM spine), p AS (SELECT s.trip_id, s.seq, s.stop_id, s.boardings, row_number() OVER (PARTITION BY s.stop_id ORDER BY s.boardings DESC, s.trip_id, s.seq) AS busiest FROM spine s, d WHERE s.service_date > d.d - 200),
u AS (SELECT stop_id, row_number() OVER (ORDER BY stop_id) AS r FROM stops WHERE stop_id NOT IN (SELECT s.stop_id FROM spine s, d WHERE s.service_date > d.d - 10)), f AS (SELECT *, row_number() OVER (ORDER BY boardings, trip_id, seq) AS r FROM p WHERE busiest > 1)
SELECT f.trip_id, f.seq, f.stop_id AS donor, u.stop_id AS unused FROM f JOIN u USING (r)""")
def stop_overlay(r: Roles) -> DataFrame:
    """Stops without a visit in the last ten days take over the positions of least pressure of the last 200, each donor's busiest one left alone.

    Rank meets rank. Only as many positions are ranked as there are unused stops, which the network bounds.
    """
    last = r.spine.agg(F.max("service_date").alias("d"))
    x = r.spine.crossJoin(F.broadcast(last))  # one row
    used = x.filter(F.col("service_date") > F.date_sub("d", 10)).select("stop_id").distinct()
    unused = r.stops.select("stop_id").join(used, "stop_id", "left_anti").withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("stop_id")))
    busiest = F.row_number().over(Window.partitionBy("stop_id").orderBy(F.desc("boardings"), "trip_id", "seq"))
    free = x.filter(F.col("service_date") > F.date_sub("d", 200)).withColumn("b", busiest).filter("b > 1").orderBy("boardings", "trip_id", "seq").limit(unused.count())
    free = free.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("boardings", "trip_id", "seq")))
    return free.join(unused.withColumnRenamed("stop_id", "unused"), "r").select("trip_id", "seq", F.col("stop_id").alias("donor"), "unused")


@query("b04_prediction_sample", f"WITH s AS ({SCORED}) SELECT case_id, actual, predicted, (SELECT count(*) FROM s) AS cases_n, (SELECT count(*) FROM s WHERE actual = predicted) AS hits_n FROM s ORDER BY case_id LIMIT 100")
def prediction_sample(r: Roles) -> DataFrame:
    """A bounded sample of predictions under the audited summary of their run."""
    s = scored(r)
    summary = s.agg(F.count("*").alias("cases_n"), F.count_if(F.col("actual") == F.col("predicted")).alias("hits_n"))
    return s.select("case_id", "actual", "predicted").orderBy("case_id").limit(100).crossJoin(F.broadcast(summary))  # one row


@query("b01_capabilities", "SELECT 15 AS capabilities_n, 36 AS sections_n, 0 AS unanswered, true AS unknown_refused")
def capabilities(r: Roles) -> DataFrame:
    """Every section of every capability is answered by a registered query; unknown ones are refused."""
    from korridor.plans import QUERIES
    from korridor.serving import CAPABILITIES, answer

    sections = [q for s in CAPABILITIES.values() for q in s.values()]
    try:
        answer(r.spark, r.sf_dir, "nothing", "at all")
        refused = False
    except ValueError:
        refused = True
    return r.spark.createDataFrame([(len(CAPABILITIES), len(sections), sum(q not in QUERIES for q in sections), refused)], "capabilities_n int, sections_n int, unanswered int, unknown_refused boolean")


#: fixed values: task, grain, target, what a missing target means
TASK_CONTRACTS = {
    "delay_severity": ("row_id", "label_name", "excluded"), "demand_forecast": ("row_id", "mean_7", "no history"), "occupancy": ("trip_id, seq", "utilization", "unknown capacity"),
    "headway": ("trip_id, seq", "headway_s", "first departure"), "delay_analytics": ("service_date, route_id, direction", "mean_delay_s", "no visit"), "route_clustering": ("route_id, direction", "load", "no visit"),
}


def task_frames(r: Roles) -> dict[str, DataFrame]:
    """Each task's frame. The spine is written down once, four tasks read it."""
    from korridor.plans import analytics, models, windows

    path = scratch(r)
    files.write_once(r.spine.drop("vehicle_id", "alightings", "status"), path)  # what no task reads
    r.spine = r.spark.read.parquet(path)
    return {**{k: build(r) for k, build in models.TASKS.items()}, "headway": windows.headway(r), "delay_analytics": analytics.delay_analytics(r), "route_clustering": analytics.route_vector(r)}


@query("m04_composed_tasks", "SELECT 'headway' AS task, count(*) AS n FROM spine UNION ALL SELECT 'delay_analytics', count(*) FROM (SELECT DISTINCT service_date, route_id, direction FROM spine) a UNION ALL SELECT 'route_clustering', count(*) FROM (SELECT DISTINCT route_id, direction FROM spine WHERE service_date < DATE '1999-01-01') b UNION ALL SELECT 'delay_severity', count(*) FROM observations UNION ALL SELECT 'demand_forecast', count(*) FROM observations UNION ALL SELECT 'occupancy', count(*) FROM spine")
def composed_tasks(r: Roles) -> DataFrame:
    """Rows of each task's frame as all are built together."""
    parts = [x.agg(F.lit(name).alias("task"), F.count("*").alias("n")) for name, x in task_frames(r).items()]
    return reduce(DataFrame.unionByName, parts)


@query("m05_task_dispatcher", "SELECT 'occupancy' AS task, count(*) AS n, true AS unknown_refused FROM spine UNION ALL SELECT 'delay_severity', count(*), true FROM observations")
def task_dispatcher(r: Roles) -> DataFrame:
    """The tasks asked for and no others; a name that no task has is refused before any is built."""
    from korridor.plans import models

    try:
        models.build_task(r, "weather")
        refused = False
    except ValueError:
        refused = True
    parts = [models.build_task(r, t).agg(F.lit(t).alias("task"), F.count("*").alias("n"), F.lit(refused).alias("unknown_refused")) for t in ("occupancy", "delay_severity")]
    return parts[0].unionByName(parts[1])


@query("m06_task_contracts", "SELECT unnest(['delay_severity', 'demand_forecast', 'occupancy', 'headway', 'delay_analytics', 'route_clustering']) AS task, unnest(['row_id', 'row_id', 'trip_id, seq', 'trip_id, seq', 'service_date, route_id, direction', 'route_id, direction']) AS grain, 0::BIGINT AS repeated, 0::BIGINT AS without_grain")
def task_contracts(r: Roles) -> DataFrame:
    """Each task's grain, held against its frame: rows that repeat a grain, and rows that lack a part of it."""
    parts = []
    for task, x in task_frames(r).items():
        keys = TASK_CONTRACTS[task][0].split(", ")
        if keys == ["trip_id", "seq"]:  # as many grains as visits: dealt out as lines are, sums before that would hold them all
            x = x.select(*keys).repartition(r.parts, *keys)
        per = x.groupBy(*keys).agg(F.count("*").alias("n"))
        gap = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        parts.append(per.agg(F.lit(task).alias("task"), F.lit(", ".join(keys)).alias("grain"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"), F.count_if(gap).alias("without_grain")))
    return reduce(DataFrame.unionByName, parts)


def quotas(counts: DataFrame, budget: int) -> DataFrame:
    """split, label, quota: the budget by split, then each split's by label, at least one of each that has rows."""
    splits = windows.largest_remainder(counts.groupBy("split").agg(F.sum("n").alias("n")), [], "n", budget, "split", minimum=1).select("split", F.col("quota").alias("seats"))
    return windows.largest_remainder(counts.join(splits, "split"), ["split"], "n", "seats", "label", minimum=1).select("split", "label", "quota")


_ALLOCATE = """{p}_b AS (SELECT *, least(n, 1) AS base, least({seats}, sum(n) OVER ({w})) - sum(least(n, 1)) OVER ({w}) AS free, sum(n) OVER ({w}) - sum(least(n, 1)) OVER ({w}) AS left_n FROM {src}),
{p}_s AS (SELECT *, CASE WHEN left_n > 0 AND free > 0 THEN (n - base)::DOUBLE * free / left_n ELSE 0 END AS share FROM {p}_b), {p}_f AS (SELECT *, floor(share) AS whole, row_number() OVER ({w} ORDER BY share - floor(share) DESC, {tie}) AS r FROM {p}_s),
{p} AS (SELECT *, CAST(base + whole + CASE WHEN base + whole < n AND r <= greatest(free, 0) - sum(whole) OVER ({w}) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM {p}_f)"""


def _handoff_sql(rows: str, seed: str, budget: int) -> str:
    return f"""x AS ({rows}), c AS (SELECT split, label, count(*) AS n FROM x GROUP BY split, label), t AS (SELECT split, sum(n) AS n FROM c GROUP BY split), {_ALLOCATE.format(p="q", src="t", seats=budget, w="", tie="split")},
d AS (SELECT c.split, c.label, c.n, q.quota AS seats FROM c JOIN q USING (split)), {_ALLOCATE.format(p="l", src="d", seats="seats", w="PARTITION BY split", tie="label")},
k AS (SELECT x.*, row_number() OVER (PARTITION BY x.split, x.label ORDER BY sha256('{seed}|' || x.case_id), x.case_id) AS place FROM x) SELECT k.split, k.label, k.case_id FROM k JOIN l ON l.split = k.split AND l.label = k.label WHERE k.place <= l.quota"""


_OCCUPANCY_CASES = f"""SELECT s.trip_id * 10 + s.seq AS case_id, CASE WHEN s.service_date < DATE '1996-07-01' THEN 'train' WHEN s.service_date < DATE '1996-10-01' THEN 'validation' ELSE 'test' END AS split, CAST(s.boardings > h.capacity AS INTEGER) AS label FROM spine s JOIN vehicles h ON h.vehicle_id = s.vehicle_id
WHERE s.route_id IS NOT NULL AND s.stop_id IS NOT NULL AND s.direction IN ('A', 'N') AND s.status IN ('O', 'F') AND h.capacity > 0 AND s.boardings >= 0 AND s.actual_s > s.scheduled_s AND s.actual_s < s.scheduled_s + 31536000
AND s.scheduled_s BETWEEN {YEAR_1996[0]} AND {YEAR_1996[1] - 1} AND s.actual_s + 300 <= {YEAR_1996[1]}"""
_TASK_ROWS = {"crowding": ("SELECT case_id, split, target AS label FROM ({cases}) c", 500), "demand": ("SELECT case_id, split, 0 AS label FROM ({cases}) c", 300), "occupancy": (_OCCUPANCY_CASES, 200)}


@query("m18_handoff_rows", " UNION ALL ".join(f"SELECT '{t}' AS task, * FROM (WITH {_handoff_sql(rows.format(cases=CASES), 'm18-' + t, n)}) {t}" for t, (rows, n) in _TASK_ROWS.items()) + " UNION ALL SELECT 'clustering', 'train', 0, route_id FROM (SELECT DISTINCT route_id FROM spine WHERE service_date < DATE '1999-01-01') k")
def handoff_rows(r: Roles) -> DataFrame:
    """The four handoffs, each certified, written and read back: by split and label, by split, by eligibility then split and label, and whole."""
    splits = F.when(F.col("service_date") < "1996-07-01", "train").when(F.col("service_date") < "1996-10-01", "validation").otherwise("test")
    known = eligibility.eligible(occupancy_candidates(r), eligibility.occupancy(*YEAR_1996))
    occupancy = known.select(
        (F.col("trip_id") * 10 + F.col("seq")).alias("case_id"), splits.alias("split"), F.col("cutoff_s").alias("feature_cutoff_s"), F.col("known_s").alias("value_available_s"), F.col("actual_s").alias("target_s"), F.col("load_available_s").alias("target_available_s"),
        F.col("over_capacity").cast("int").alias("target"), "stop_sequence",
    )
    path, out = scratch(r), []
    for name, x in (("cases", cases(r)), ("eligible", occupancy)):
        files.write_once(x, f"{path}/{name}")  # worked out once; quotas, histogram and sample read it
    for task, name, label in (("crowding", "cases", F.col("target")), ("demand", "cases", F.lit(0)), ("occupancy", "eligible", F.col("target"))):
        x = r.spark.read.parquet(f"{path}/{name}").withColumn("label", label)
        q = quotas(x.groupBy("split", "label").agg(F.count("*").alias("n")), _TASK_ROWS[task][1])
        some = windows.ranked_sample(x.join(F.broadcast(q), ["split", "label"]), ["split", "label"], F.col("quota"), ["case_id"], f"m18-{task}")  # a row a split and label
        files.write_once(some.drop("label", "quota", "sample_rank"), f"{path}/{task}-sample")  # sampled once; guards, rows and digest read it
        handoff.write_handoff(r.spark.read.parquet(f"{path}/{task}-sample"), f"{path}/{task}", task, ["stop_sequence"], {"seed": f"m18-{task}", "budget": _TASK_ROWS[task][1]})
        out.append(handoff.read_handoff(r.spark, f"{path}/{task}").select(F.lit(task).alias("task"), "split", label.alias("label"), "case_id"))
    end = F.lit(915_148_800).cast("long")
    routes = r.spine.filter("service_date < DATE'1999-01-01'").groupBy(F.col("route_id").cast("long").alias("case_id")).agg(F.avg("boardings").alias("load"))
    routes = routes.select(F.lit("train").alias("split"), "case_id", "load", (end - 1).alias("value_available_s"), end.alias("feature_cutoff_s"), end.alias("target_s"), end.alias("target_available_s"), F.lit(0).alias("target"))  # nothing is predicted of a route
    handoff.write_handoff(routes, f"{path}/clustering", "clustering", ["load"])
    out.append(handoff.read_handoff(r.spark, f"{path}/clustering").select(F.lit("clustering").alias("task"), "split", F.col("target").alias("label"), "case_id"))
    return reduce(DataFrame.unionByName, out)


@query("m19_independent_export", f"WITH {_handoff_sql(_TASK_ROWS['crowding'][0].format(cases=CASES), 'm18-crowding', 500)}")
def independent_export(r: Roles) -> DataFrame:
    """The crowding handoff by another way, from the raw tables: certified, written, read back."""
    o, v = r.table("orders"), r.lines
    events = v.groupBy(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("seq")).agg(F.sum("l_quantity").alias("q"), seconds("min(l_shipdate)").alias("actual_s"), F.min("l_partkey").alias("vehicle_id"))
    x = events.join(o.select(F.col("o_orderkey").alias("trip_id"), seconds("o_orderdate").alias("at_s"), F.to_date("o_orderdate").alias("day")), "trip_id").filter("actual_s >= at_s")
    split = F.when(F.col("day") < "1999-01-01", "train").when(F.col("day") < "2000-01-01", "validation").when(F.col("day") < "2002-01-01", "test")
    at = F.col("at_s")
    x = x.select((F.col("trip_id") * 10 + F.col("seq")).alias("case_id"), split.alias("split"), (F.floor("q") > 25).cast("int").alias("target"), at.alias("feature_cutoff_s"), (at - 86_400).alias("value_available_s"), at.alias("target_s"), F.col("actual_s").alias("target_available_s"))
    path = scratch(r)
    files.write_once(x, f"{path}/cases")  # worked out once; quotas, histogram and sample read it
    x = r.spark.read.parquet(f"{path}/cases")
    q = quotas(x.groupBy("split", F.col("target").alias("label")).agg(F.count("*").alias("n")), 500)
    x = windows.ranked_sample(x.withColumn("label", F.col("target")).join(F.broadcast(q), ["split", "label"]), ["split", "label"], F.col("quota"), ["case_id"], "m18-crowding")
    files.write_once(x.drop("label", "quota", "sample_rank"), f"{path}/sample")  # sampled once; guards, rows and digest read it
    handoff.write_handoff(r.spark.read.parquet(f"{path}/sample"), f"{path}/crowding", "crowding", [], {"producer": "raw tables"})
    return handoff.read_handoff(r.spark, f"{path}/crowding").select("split", F.col("target").alias("label"), "case_id")


_LAT = "round(10 + n.route_id + s * 0.01 * CASE d WHEN 0 THEN 1 ELSE -1 END, 6)"


@query("g02_network", f"SELECT n.route_id, d AS direction_id, s AS stop_sequence, n.route_id * 100 + d * 50 + s AS route_stop_id, {_LAT} AS latitude, round(20 + s * 0.02, 6) AS longitude, round((s - 1) * 111.195 * sqrt(0.0001 + 0.0004 * power(cos(radians(10.0)), 2)), 4) AS distance_km, 'P' || n.route_id || '-' || d AS pattern_id FROM routes n, range(0, 2) t(d), range(1, 11) u(s)")
def network(r: Roles) -> DataFrame:
    """Stops of both patterns of each route with their places and distances along the pattern."""
    x = r.routes.select("route_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("direction_id")).select("*", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("stop_sequence"))
    s, step = F.col("stop_sequence"), 111.195 * (0.0001 + 0.0004 * math.cos(math.radians(10.0)) ** 2) ** 0.5
    return x.select("route_id", "direction_id", "stop_sequence", (F.col("route_id") * 100 + F.col("direction_id") * 50 + s).alias("route_stop_id"), F.round(10 + F.col("route_id") + s * 0.01 * F.when(F.col("direction_id") == 0, 1).otherwise(-1), 6).alias("latitude"), F.round(20 + s * 0.02, 6).alias("longitude"), F.round((s - 1) * step, 4).alias("distance_km"), F.concat(F.lit("P"), F.col("route_id"), F.lit("-"), F.col("direction_id")).alias("pattern_id"))


@query("g10_positions", "SELECT trip_id, seq, round(10 + least(100, greatest(0, boardings)) / 200, 6) AS latitude, round(20 + (seq - 1) * 0.02 + (stop_id % 7) * 0.001, 6) AS longitude, actual_s - 15 AS observed_s, CASE WHEN direction = 'R' THEN 'UNKNOWN' ELSE 'KNOWN' END AS assignment_status, CASE WHEN direction <> 'R' THEN vehicle_id END AS assignment_id FROM visits")
def positions(r: Roles) -> DataFrame:
    """A position shortly before each visit, with the vehicle where it is known."""
    known = F.col("direction") != "R"
    return r.visits.select("trip_id", "seq", F.round(10 + F.least(F.lit(100), F.greatest(F.lit(0), F.col("boardings"))) / 200, 6).alias("latitude"), F.round(20 + (F.col("seq") - 1) * 0.02 + (F.col("stop_id") % 7) * 0.001, 6).alias("longitude"), (F.col("actual_s") - 15).alias("observed_s"), F.when(known, "KNOWN").otherwise("UNKNOWN").alias("assignment_status"), F.when(known, F.col("vehicle_id")).alias("assignment_id"))


@query("g11_preflight", """WITH p AS (SELECT count(*) AS departures, count(*) * (SELECT avg(n) FROM (SELECT count(*) AS n FROM visits GROUP BY trip_id) v) AS events, sum(CASE WHEN status <> 'P' THEN 1 ELSE 0 END) AS operated FROM trips)
SELECT 'departures' AS metric, departures::DOUBLE AS projected, 10000.0::DOUBLE AS target, departures >= 10000 AS met FROM p UNION ALL SELECT 'events', round(events, 4), 40000.0, events >= 40000 FROM p UNION ALL SELECT 'operated', operated::DOUBLE, 9000.0, operated >= 9000 FROM p""")
def preflight(r: Roles) -> DataFrame:
    """What a generation would come to, from plans and mean rates alone, against its targets."""
    rate = r.visits.groupBy("trip_id").agg(F.count("*").alias("n")).agg(F.avg("n").alias("rate"))
    p = r.trips.agg(F.count("*").alias("departures"), F.count_if(F.col("status") != "P").alias("operated")).crossJoin(F.broadcast(rate))  # one row each
    aims = {"departures": (F.col("departures").cast("double"), 10_000.0), "events": (F.col("departures") * F.col("rate"), 40_000.0), "operated": (F.col("operated").cast("double"), 9_000.0)}
    return p.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value"), F.lit(t).alias("target")) for k, (v, t) in aims.items()))).alias("a")).select("a.metric", F.round("a.value", 4).alias("projected"), "a.target", (F.col("a.value") >= F.col("a.target")).alias("met"))


__all__ = ["certified"]
