"""Role views, counters and brief tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.timeparts import hours_between
from .filters import OPEN_STATUSES, in_jurisdiction, open_backlog, repeat_people, serious_or_escalated, surfaced_anomalies
from .flags import queue_order
from .hotspots import grid_hotspots


def station_comparison(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy(F.coalesce("police_station", F.lit("UNKNOWN")).alias("police_station")).agg(
        F.count(F.lit(1)).alias("total_incidents"), F.count_if(F.upper("status") == "OPEN").alias("open_cases")
    )


def station_backlog(incidents: DataFrame) -> DataFrame:
    """Total, open, closed and rounded backlog rate per station."""
    is_open = F.upper("status").isin(*OPEN_STATUSES)
    total, opened = F.count(F.lit(1)), F.count_if(is_open)
    return incidents.groupBy("police_station").agg(
        total.alias("total_station_cases"), opened.alias("open_cases"), (total - opened).alias("closed_cases"),
        F.round(100.0 * opened / total).cast("bigint").alias("backlog_rate_pct"),
    )


def district_metrics(incidents: DataFrame) -> DataFrame:
    """Per district: incidents and active grid hotspots."""
    spots = grid_hotspots(incidents, per_district=True)
    return (
        incidents.groupBy("district").agg(F.count(F.lit(1)).alias("total_district_incidents"))
        .join(spots.groupBy("district").agg(F.count(F.lit(1)).alias("active_hotspots_count")), "district", "left")
        .withColumn("active_hotspots_count", F.coalesce("active_hotspots_count", F.lit(0)).cast("bigint"))
    )


def top_concerns(flags: DataFrame, limit: int = 5) -> DataFrame:
    """The most pressing serious flags, in review-queue order."""
    return flags.where(F.col("severity").isin("CRITICAL", "HIGH")).orderBy(*queue_order(flags)).limit(limit)


def constable_view(incidents: DataFrame, flags: DataFrame, people: DataFrame | None, station: str) -> dict[str, DataFrame]:
    local = incidents.where(F.col("police_station") == station)
    out = {
        "active_beat_flags": in_jurisdiction(flags, station),
        "patrol_route_hotspots": grid_hotspots(local),
        "totals": local.agg(F.count(F.lit(1)).alias("total_incidents")),
    }
    return out if people is None else {**out, "repeat_offenders_nearby": repeat_people(people)}


def sho_view(incidents: DataFrame, flags: DataFrame, edges: DataFrame, station: str) -> dict[str, DataFrame]:
    local = incidents.where(F.col("police_station") == station)
    newest = [F.col("occurrence_datetime").desc(), F.col("incident_id")]
    return {
        "case_backlog_summary": station_backlog(local),
        "local_hotspots": grid_hotspots(local),
        "pending_flags": in_jurisdiction(flags, station),
        "suspect_network_links": edges.orderBy(F.col("weight").desc(), "source", "target").limit(10),
        "recent_firs": open_backlog(local).orderBy(*newest).limit(15),
    }


def sp_view(incidents: DataFrame, flags: DataFrame, spikes: DataFrame, district: str | None) -> dict[str, DataFrame]:
    """Serious flags are statewide by rule; incidents follow the district."""
    local = incidents if district is None else incidents.where(F.col("district") == district)
    return {
        "district_metrics": district_metrics(local),
        "station_performance_breakdown": station_comparison(local),
        "escalated_anomaly_flags": serious_or_escalated(flags),
        "trend_analysis": spikes,
    }


def analyst_overview(incidents: DataFrame, flags: DataFrame, edges: DataFrame) -> DataFrame:
    def rows(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1)).alias("v")).scalar()

    return incidents.agg(F.count(F.lit(1)).alias("total_state_incidents")).select(
        "total_state_incidents", rows(flags).alias("total_active_flags"), rows(edges).alias("cross_district_links_count")
    )


def analyst_view(incidents: DataFrame, flags: DataFrame, nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    return {
        "statewide_overview": analyst_overview(incidents, flags, edges),
        "nodes": nodes,
        "edges": edges,
        "all_surfaced_hotspots": grid_hotspots(incidents),
        "surfaced_anomalies": surfaced_anomalies(flags),
    }


def dgp_view(incidents: DataFrame, flags: DataFrame) -> dict[str, DataFrame]:
    """Concerns and figures computed from the tables; busiest stations by backlog."""
    backlog = station_backlog(incidents)
    closed = F.count_if(F.col("status") == "CLOSED")
    return {
        "top_5_emerging_concerns": top_concerns(flags),
        "statewide_kpis": incidents.agg(
            F.count(F.lit(1)).alias("total_firs_registered"), F.round(100.0 * closed / F.count(F.lit(1)), 1).alias("resolution_rate_pct")
        ),
        "bottleneck_stations": backlog.orderBy(F.col("open_cases").desc(), "police_station").limit(5),
    }


def brief_counts(incidents: DataFrame, flags: DataFrame) -> DataFrame:
    """One row: incidents, pending, escalated and active flags."""
    total = incidents.agg(F.count(F.lit(1)).alias("v")).scalar()
    return flags.agg(
        F.count_if(F.col("status") == "PENDING").alias("pending_flags"), F.count_if(F.col("status") == "ESCALATED").alias("escalated_flags")
    ).select(total.alias("total_firs"), "pending_flags", "escalated_flags", (F.col("pending_flags") + F.col("escalated_flags")).alias("active_flags"))


def top_flagged(flags: DataFrame, limit: int = 3) -> DataFrame:
    return (
        flags.where(F.col("status").isin("PENDING", "ESCALATED"))
        .groupBy("jurisdiction_id").agg(F.count(F.lit(1)).alias("flags"))
        .orderBy(F.col("flags").desc(), "jurisdiction_id").limit(limit)
    )


def oldest_unreviewed(flags: DataFrame, as_of: Column) -> DataFrame:
    oldest = F.min(F.when(F.col("status") == "PENDING", F.col("created_at")))
    return flags.agg(F.datediff(F.to_date(as_of), F.to_date(oldest)).cast("bigint").alias("oldest_pending_days"))


def period_comparison(incidents: DataFrame, as_of: Column) -> DataFrame:
    """Current calendar month of ``as_of`` against the month before."""
    now = F.to_date(F.date_trunc("month", as_of))
    month = F.to_date(F.date_trunc("month", F.col("occurrence_datetime")))
    current, previous = F.count_if(month == now), F.count_if(month == F.add_months(now, -1))
    return incidents.agg(current.alias("current_month"), previous.alias("previous_month")).withColumn(
        "change_pct",
        F.round(F.try_divide(100.0 * (F.col("current_month") - F.col("previous_month")), F.nullif(F.col("previous_month"), F.lit(0)).cast("double")), 1),
    )


def executive_brief(incidents: DataFrame, flags: DataFrame, as_of: Column, district: str | None = None) -> dict[str, DataFrame]:
    local = incidents if district is None else incidents.where(F.col("district") == district)
    return {
        "counts": brief_counts(local, flags), "top_flagged": top_flagged(flags),
        "period": period_comparison(local, as_of), "oldest": oldest_unreviewed(flags, as_of),
    }


def dashboard_stats(incidents: DataFrame, flags: DataFrame, hotspots: DataFrame, as_of: Column) -> DataFrame:
    """One row of dashboard figures. Response hours need a ``reported_datetime`` column."""
    day = F.to_date("occurrence_datetime")
    today = F.to_date(as_of)
    week, month = F.to_date(F.date_trunc("week", as_of)), F.to_date(F.date_trunc("month", as_of))
    this_month, before = F.count_if((day >= month) & (day <= today)), F.count_if((day >= F.add_months(month, -1)) & (day < month))
    response = (
        F.round(F.avg(hours_between(F.col("occurrence_datetime"), F.col("reported_datetime"))), 2)
        if "reported_datetime" in incidents.columns else F.lit(None).cast("double")
    )
    pending = flags.agg(F.count_if(F.col("status") == "PENDING").alias("v")).scalar()
    active = hotspots.agg(F.count(F.lit(1)).alias("v")).scalar()
    change = F.round(F.try_divide(100.0 * (F.col("incidents_this_month") - F.col("_before")), F.nullif(F.col("_before"), F.lit(0)).cast("double")), 1)
    return incidents.agg(
        F.count(F.lit(1)).alias("total_incidents"),
        F.round(100.0 * F.count_if(F.upper("status") == "CLOSED") / F.count(F.lit(1)), 2).alias("closure_rate"),
        response.alias("avg_response_hours"),
        F.count_if(day == today).alias("incidents_today"),
        F.count_if((day >= week) & (day <= today)).alias("incidents_this_week"),
        this_month.alias("incidents_this_month"),
        before.alias("_before"),
    ).select(
        "total_incidents", pending.alias("pending_flags"), active.alias("active_hotspots"), "closure_rate", "avg_response_hours",
        "incidents_today", "incidents_this_week", "incidents_this_month", change.alias("change_from_last_month"),
    )


def category_series(incidents: DataFrame, category: Column | None = None) -> DataFrame:
    """Daily totals with a map of counts per category. A day's map is as short as the vocabulary."""
    kind = F.col("crime_type") if category is None else category
    cells = incidents.groupBy(F.to_date("occurrence_datetime").alias("date"), kind.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("date").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("by_category")
    )


def top_types(incidents: DataFrame, limit: int = 3) -> DataFrame:
    """The most frequent types per district, as a ranked list."""
    counts = incidents.groupBy("district", "crime_type").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("district").orderBy(F.col("n").desc(), "crime_type"))
    return counts.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= limit)


def district_cards(scores: DataFrame, spikes: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per district: score with the dashboard band, period change, its trend word and top types."""
    tops = top_types(incidents).groupBy("district").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "crime_type"))), lambda x: x["crime_type"]).alias("top_crimes")
    )
    change = F.col("spike_percentage")
    word = F.when(change > 5, "rising").when(change < -5, "declining").otherwise("stable")
    return (
        scores.select("district", "risk_score")
        .join(spikes.select("district", change.alias("change_percent"), word.alias("trend"), "current_count"), "district", "left")
        .join(tops, "district", "left")
        .withColumn("risk_level", labels.dashboard_band(F.col("risk_score")))
    )


def active_hotspot_counts(tiered: DataFrame, scored: DataFrame) -> DataFrame:
    """High-tier clusters and districts scored above 60."""
    high = tiered.agg(F.count_if(F.lower("risk_level").isin("high", "critical")).alias("v")).scalar()
    return scored.agg(F.count_if(F.col("risk_score") > 60).alias("scored_above_60")).select(high.alias("high_tier_hotspots"), "scored_above_60")


def score_statistics(scores: DataFrame) -> DataFrame:
    """Run statistics of the district scores."""
    return scores.agg(
        F.count(F.lit(1)).alias("districts_scored"), F.round(F.avg("risk_score"), 2).alias("average_score"),
        F.min("risk_score").alias("lowest_score"), F.max("risk_score").alias("highest_score"),
        *[F.count_if(F.col("risk_level") == level).alias(level.lower()) for level in ("Low", "Moderate", "High", "Critical")],
    )


def dataset_statistics(incidents: DataFrame) -> DataFrame:
    """Range, totals and distinct counts of a run's input."""
    cells = incidents.groupBy("district", "crime_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("occurrence_datetime").alias("a"), F.max("occurrence_datetime").alias("b")
    )
    return cells.agg(
        F.sum("n").alias("total_incidents"), F.min("a").alias("first_incident"), F.max("b").alias("last_incident"),
        F.count_distinct("district").alias("districts"), F.count_distinct("crime_type").alias("crime_types"),
    )


def summary_facts(stats: DataFrame, events: DataFrame, ranking: DataFrame, tiered: DataFrame, scores: DataFrame) -> DataFrame:
    """Headline facts as (fact, value) rows."""
    def best(df: DataFrame, fact: str, value: str, order: list[Column]) -> DataFrame:
        return df.orderBy(*order).limit(1).select(F.lit(fact).alias("fact"), F.col(value).cast("string").alias("value"))

    by_type = stats.groupBy("crime_type").agg(F.sum("total_incidents").alias("n"))
    rows = [
        best(tiered, "largest_cluster", "cluster_id", [F.col("number_of_incidents").desc(), F.col("cluster_id")]),
        best(events, "largest_spike", "peak_incident_count", [F.col("peak_incident_count").desc()]),
        best(ranking, "most_affected_district", "district", [F.col("total_incidents").desc(), F.col("district")]),
        best(by_type, "most_common_crime", "crime_type", [F.col("n").desc(), F.col("crime_type")]),
        best(scores, "highest_risk_district", "district", [F.col("risk_score").desc(), F.col("district")]),
        best(scores, "lowest_risk_district", "district", [F.col("risk_score").asc(), F.col("district")]),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def facts_of(row: DataFrame) -> DataFrame:
    """The columns of a one-row frame as (fact, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("fact"), F.col(c).cast("string").alias("value")) for c in row.columns])
    return row.select(F.explode(pairs).alias("p")).select("p.fact", "p.value")


def hotspot_facts(assignments: DataFrame, tiered: DataFrame) -> DataFrame:
    """Headline facts of a clustering as (fact, value) rows; without clusters the facts about them are null."""
    seen = assignments.agg(F.count(F.lit(1)).alias("incidents"), F.count_if(F.col("cluster_id") == -1).alias("noise"))
    largest = F.max_by(F.struct("cluster_id", "district", "cluster_radius_metres", "risk_level"), F.struct("number_of_incidents", -F.col("cluster_id")))
    found = tiered.agg(
        F.count(F.lit(1)).alias("clusters"), F.round(F.avg("number_of_incidents"), 2).alias("mean_cluster_size"), F.max("number_of_incidents").alias("largest_cluster_size"),
        largest.alias("largest"), *[F.count_if(F.col("risk_level") == v).alias(f"{v.lower()}_clusters") for v in ("High", "Medium", "Low")],
    ).select("*", *[F.col(f"largest.{c}").alias(f"largest_cluster_{a}") for c, a in (("cluster_id", "id"), ("district", "district"), ("risk_level", "level"))]).drop("largest")
    return facts_of(seen).unionByName(facts_of(found))


def score_facts(scores: DataFrame) -> DataFrame:
    """Headline facts of the district scores as (fact, value) rows."""
    rank = F.struct("risk_score", F.col("district"))
    return facts_of(scores.agg(
        F.count(F.lit(1)).alias("districts"), F.round(F.avg("risk_score"), 2).alias("mean_score"),
        F.max("risk_score").alias("highest_score"), F.min("risk_score").alias("lowest_score"), F.min_by("district", rank).alias("lowest_risk_district"),
        *[F.count_if(F.col("risk_level") == v).alias(f"{v.lower()}_districts") for v in ("Low", "Moderate", "High", "Critical")],
    ))
