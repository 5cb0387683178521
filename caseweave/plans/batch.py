"""The scoring job: five independent stages, then risk; every stage reports how it went."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import features as feature_ops
from ..operators.checks import require_columns, require_rows
from ..operators.forest import isolation_scores
from ..operators.graph import build_graph
from ..operators.hotspots import district_forecast, grid_hotspots, hotspots
from ..operators.risk import REQUIRED, risk_scores
from ..operators.scale import materialize
from ..operators.similarity import cosine_top_k
from ..operators.trend import trend_outputs
from ..sources import cache
from ..sources.writers import write_json, write_table

SUMMARY_SCHEMA = (
    "module string, status string, runtime_seconds double, outputs array<string>, error string, error_class string, "
    "tables array<struct<name: string, rows: bigint, empty_columns: array<string>>>"
)


def _stage(name: str, work: Callable[[], dict[str, DataFrame]], folder: str) -> dict:
    """Build and write one stage's tables. Only the summary is kept on the driver; what it says of a table is observed while the table is written."""
    started = time.time()
    row = {"module": name, "status": "success", "runtime_seconds": 0.0, "outputs": [], "error": None, "error_class": None, "tables": []}
    try:
        for table, df in work().items():
            seen = Observation(f"{name} {table}")
            filled = [F.count(F.col(f"`{c}`")).alias(f"filled {c}") for c in df.columns]
            row["outputs"].append(write_table(df.observe(seen, F.count(F.lit(1)).alias("rows"), *filled), f"{folder}/{table}"))
            found = seen.get
            row["tables"].append((table, found["rows"], [c for c in df.columns if found["rows"] and not found[f"filled {c}"]]))
    except Exception as problem:
        row.update(status="failed", error=f"{type(problem).__name__}: {problem}", error_class=type(problem).__name__)
    row["runtime_seconds"] = round(time.time() - started, 3)
    return row


def overall_status(statuses: list[str]) -> str:
    """completed when all succeeded, failed when none did; skipped is not success."""
    good = sum(s == "success" for s in statuses)
    return "completed" if good == len(statuses) else ("partial_success" if good else "failed")


def run_batch(
    spark: SparkSession,
    incidents: DataFrame,
    folder: str,
    continue_on_error: bool = True,
    feature_columns: list[str] | None = None,
    eps_meters: float = 300.0,
    min_samples: int = 10,
) -> tuple[str, DataFrame]:
    """Write all result tables below ``folder``; returns the final status and the summary frame.

    Stages read the input table themselves; risk reads the tables the first stages wrote, so nothing
    is recomputed and a lost executor costs at most one stage's tasks.
    """
    folder = folder.rstrip("/")
    rows: list[dict] = []

    def finish() -> tuple[str, DataFrame]:
        status = overall_status([r["status"] for r in rows])
        summary = spark.createDataFrame(
            [(r["module"], r["status"], r["runtime_seconds"], r["outputs"], r["error"], r.get("error_class"), r.get("tables", [])) for r in rows]
            + [("final", status, round(sum(r["runtime_seconds"] for r in rows), 3), [], None, None, [])],
            SUMMARY_SCHEMA,
        )
        write_json(summary.coalesce(1), f"{folder}/run_summary")
        return status, summary

    try:
        require_rows(require_columns(incidents, ["incident_id", "crime_type", "district", "occurrence_datetime"]))
    except Exception as problem:
        rows.append({"module": "load", "status": "failed", "runtime_seconds": 0.0, "outputs": [], "error": str(problem), "error_class": type(problem).__name__})
        finish()
        raise

    def hotspot_stage() -> dict[str, DataFrame]:
        assigned, stats = hotspots(incidents, eps_meters, min_samples)
        return {"cluster_assignments": assigned, "cluster_stats": stats}

    def graph_stage() -> dict[str, DataFrame]:
        nodes, edges = build_graph(incidents, keep=materialize)
        return {"graph_nodes": nodes, "graph_edges": edges}

    stages: list[tuple[str, Callable[[], dict[str, DataFrame]]]] = [
        ("hotspot", hotspot_stage),
        ("trend", lambda: trend_outputs(incidents, keep=materialize)),
        ("graph", graph_stage),
        ("similarity", lambda: {"similar_incidents": cosine_top_k(incidents)}),
        ("anomaly", lambda: {"incident_anomalies": isolation_scores(incidents, feature_columns=feature_columns, exclude=(*feature_ops.SENSITIVE, "occurrence_datetime"))}),
    ]
    for name, work in stages:
        rows.append(_stage(name, work, folder))
        if rows[-1]["status"] == "failed" and not continue_on_error:
            break
    done = {r["module"]: r["status"] for r in rows}
    if done.get("hotspot") == "success" and done.get("trend") == "success":
        def risk_stage() -> dict[str, DataFrame]:
            def read(t: str) -> DataFrame:
                return spark.read.parquet(f"{folder}/{t}")

            wanted = [*REQUIRED["incidents"], *[c for c in ("repeat_offender", "population_density") if c in incidents.columns]]
            scores, weights = risk_scores(
                incidents.select(*wanted), read("cluster_stats"), read("statistics"), read("anomalies"), read("trend_summary"), read("spike_events")
            )
            return {"risk_scores": scores, "risk_feature_importance": weights}

        rows.append(_stage("risk", risk_stage, folder))
    else:
        rows.append({"module": "risk", "status": "skipped", "runtime_seconds": 0.0, "outputs": [], "error": "needs hotspot and trend"})
    return finish()


def nightly_cache(incidents: DataFrame, now: Column | None = None) -> DataFrame:
    """Cache rows of the nightly refresh: one forecast per district and one row per grid hotspot."""
    stamp = F.current_timestamp() if now is None else now
    forecast = district_forecast(incidents)
    spots = grid_hotspots(incidents)
    per_district = cache.entries(
        forecast, cache.forecast_key(F.col("district")), F.to_json(F.struct(*forecast.columns)), stamp
    )
    per_spot = cache.entries(
        spots, F.concat_ws(":", F.lit("hotspot_scores_statewide"), "hotspot_id"), F.to_json(F.struct(*spots.columns)), stamp, cache.STATEWIDE_TTL_SECONDS
    )
    return per_district.unionByName(per_spot)
