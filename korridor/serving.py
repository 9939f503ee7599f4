"""Answers by capability name: which query gives each section, and which filters it takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The capability and section names that callers know. Section: query.
CAPABILITIES = {
    "executiveSummary": {"kpis": "d12_executive_kpis", "trends": "a22_movement_counters"},
    "passengerDemand": {"kpis": "d06_supply_gap", "trends": "d03_demand_trend", "routeDemand": "a05_demand_profile", "stopDemand": "a08_boardings_alightings"},
    "routesAndStops": {"kpis": "d04_route_score", "routePerformance": "a06_operational_profile", "stopRanking": "d08_stop_performance"},
    "delayAnalysis": {"kpis": "a02_delay_analytics", "delayDistribution": "a10_class_histogram", "routeReliability": "d05_reliability"},
    "occupancy": {"kpis": "a18_conditional_sums", "bands": "a15_band_histogram", "persistentSignals": "a14_persistent_crowding"},
    "demandForecast": {"forecastSeries": "m02_demand_forecast", "evaluationReadiness": "m12_regression_metrics"},
    "routeClusters": {"clusters": "a25_cluster_interpretation", "assignments": "m16_clustering_run"},
    "passengerFlow": {"odMatrix": "d01_od_matrix", "topPairs": "d01_od_matrix", "directionalSummary": "a07_count_by_key"},
    "whatIf": {"baseline": "e04_queue", "scenario": "e05_scenarios", "assumptions": "e06_deltas"},
    "recommendations": {"insights": "e01_rules", "actionQueue": "e03_generate"},
    "dataQuality": {"kpis": "d11_quality_kpis", "issueFamilies": "v43_dq_fixtures", "reconciliation": "q30_dq_reconciliation"},
    "systemStatus": {"pipelineStages": "m06_task_contracts", "sources": "v56_count_gate", "events": "v55_schema"},
    "systemHealth": {"health": "b06_thresholds"},
    "pipelineStatus": {"pipelineStages": "m06_task_contracts"},
    "pipelineComparison": {"comparison": "c01_engine_comparison"},
}
#: Filter: the columns it can hold against, the first that a section has.
FILTERS = {"startDate": ("service_date",), "endDate": ("service_date",), "routeId": ("route_id", "origin"), "stopId": ("stop_id",), "direction": ("direction",), "vehicleId": ("vehicle_id",)}


def answer(spark: SparkSession, sf_dir: str, capability: str, section: str, filters: dict | None = None) -> DataFrame:
    """A section's rows under filters; empty filters count for nothing, unknown ones are errors.

    A filter that the section has no column for is an error too: a wider answer than was asked for
    would pass for the right one.
    """
    from korridor.plans import QUERIES

    if capability not in CAPABILITIES or section not in CAPABILITIES[capability]:
        raise ValueError(f"unknown section {capability}.{section}")
    out = QUERIES[CAPABILITIES[capability][section]](spark, sf_dir)
    for name, value in (filters or {}).items():
        if value in (None, ""):
            continue
        column = next((c for c in FILTERS.get(name, ()) if c in out.columns), None)
        if column is None:
            raise ValueError(f"{capability}.{section} takes no filter {name!r}")
        held = F.lit(value).cast(out.schema[column].dataType)
        out = out.filter(F.col(column) >= held if name == "startDate" else F.col(column) <= held if name == "endDate" else F.col(column) == held)
    return out
