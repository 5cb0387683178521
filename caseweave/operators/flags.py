"""Flag creation, filters, counts and duplicate suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.texts import equals_ci

FLAG_COLUMNS = [
    "flag_id", "flag_type", "severity", "title", "summary", "confidence_score", "target_type",
    "target_id", "jurisdiction_id", "evidence_payload", "status", "created_at",
]
# Defaults of a flag raised by hand.
FLAG_DEFAULTS = {
    "flag_type": "HOTSPOT", "severity": "MEDIUM", "title": "Automated incident alert",
    "summary": "Raised by the detection job", "confidence_score": 0.85, "target_type": "LOCATION",
    "target_id": "UNKNOWN", "jurisdiction_id": "UNKNOWN", "evidence_payload": "{}",
}


def filter_flags(flags: DataFrame, status=None, flag_type=None, severity=None, jurisdiction=None) -> DataFrame:
    """Optional case-insensitive filters and an exact jurisdiction."""
    out = flags
    for column, wanted in (("status", status), ("flag_type", flag_type), ("severity", severity)):
        if wanted:
            out = out.where(equals_ci(F.col(column), F.lit(wanted)))
    return out if not jurisdiction else out.where(F.col("jurisdiction_id") == jurisdiction)


def newest_first(flags: DataFrame) -> DataFrame:
    return flags.orderBy(F.col("created_at").desc(), "flag_id")


def status_counts(flags: DataFrame) -> DataFrame:
    def counted(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return flags.agg(
        F.count(F.lit(1)).alias("total_flags"),
        counted("PENDING").alias("pending_count"),
        counted("ACKNOWLEDGED").alias("acknowledged_count"),
        counted("ESCALATED").alias("escalated_count"),
        counted("DISMISSED").alias("dismissed_count"),
    )


def breakdown(flags: DataFrame) -> DataFrame:
    """Counts by severity and by type as one long table."""
    pairs = F.array(
        F.struct(F.lit("severity").alias("dimension"), F.col("severity").alias("value")),
        F.struct(F.lit("flag_type").alias("dimension"), F.col("flag_type").alias("value")),
    )
    return flags.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("flags"))


def pending_counts(flags: DataFrame) -> DataFrame:
    pending = F.col("status") == "PENDING"
    return flags.agg(
        F.count_if(pending).alias("pending"), F.count_if(pending & (F.col("severity") == "CRITICAL")).alias("critical_pending")
    )


def queue(flags: DataFrame, only_pending: bool = False, severity: str | None = None, flag_type: str | None = None) -> DataFrame:
    out = filter_flags(flags, "PENDING" if only_pending else None, flag_type, severity)
    return out


def queue_order(flags: DataFrame) -> list[Column]:
    """Pending first, then severity, then score from high to low."""
    return [
        F.when(F.col("status") == "PENDING", 0).otherwise(1), labels.severity_order(F.col("severity")),
        F.col("confidence_score").desc(), F.col("flag_id"),
    ]


def review_queue(flags: DataFrame, limit: int | None = None, **filters) -> DataFrame:
    ordered = queue(flags, **filters).orderBy(*queue_order(flags))
    return ordered if limit is None else ordered.limit(limit)


def create_flags(requests: DataFrame, now: Column) -> DataFrame:
    """Fill the defaults of raised flags; ids are derived from the content when absent."""
    def given(name: str, kind: str) -> Column:
        value = F.col(name).cast(kind) if name in requests.columns else F.lit(None).cast(kind)
        return F.coalesce(value, F.lit(FLAG_DEFAULTS[name]).cast(kind)).alias(name)

    content = [F.col(c).cast("string") for c in requests.columns if c != "flag_id"]
    made = F.concat(F.lit("FLAG_"), F.sha2(F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in content])), 256))
    flag_id = F.coalesce(F.col("flag_id").cast("string"), made) if "flag_id" in requests.columns else made
    kinds = {c: ("double" if c == "confidence_score" else "string") for c in FLAG_DEFAULTS}
    return requests.select(
        flag_id.alias("flag_id"), *[given(c, k) for c, k in kinds.items()], F.lit("PENDING").alias("status"), now.alias("created_at")
    ).select(*FLAG_COLUMNS)


def _shape(df: DataFrame, now: Column) -> DataFrame:
    stamped = df.withColumn("status", F.lit("PENDING")).withColumn("created_at", now)
    return stamped.select(*FLAG_COLUMNS)


def hotspot_flags(spots: DataFrame, now: Column) -> DataFrame:
    types = F.array_join("crime_types", ", ")
    return _shape(
        spots.select(
            F.concat(F.lit("FLAG_HS_"), "hotspot_id").alias("flag_id"),
            F.lit("HOTSPOT").alias("flag_type"),
            labels.hotspot_severity(F.col("risk_score")).alias("severity"),
            F.concat(F.lit("Spatial hotspot near "), "police_station").alias("title"),
            F.format_string(
                "%d incidents near (%.4f, %.4f). Types: %s.", F.col("incident_count"), F.col("latitude"), F.col("longitude"), types
            ).alias("summary"),
            F.col("risk_score").alias("confidence_score"),
            F.lit("LOCATION").alias("target_type"),
            F.col("hotspot_id").alias("target_id"),
            F.col("police_station").alias("jurisdiction_id"),
            F.to_json(F.struct(*spots.columns)).alias("evidence_payload"),
        ),
        now,
    )


def trend_flags(spikes: DataFrame, now: Column, region: str | None = None, minimum: float = 50.0) -> DataFrame:
    """Flags for types whose period spike reaches ``minimum`` percent."""
    where = F.col(region).cast("string") if region else F.lit("ALL")
    return _shape(
        spikes.where(F.col("spike_percentage") >= minimum).select(
            F.concat_ws("_", F.lit("FLAG_TREND"), where, "crime_type").alias("flag_id"),
            F.lit("EMERGING_TREND").alias("flag_type"),
            F.lit("HIGH").alias("severity"),
            F.concat(F.lit("Emerging trend: "), "crime_type", F.lit(" in "), where).alias("title"),
            F.format_string(
                "%s up by %.1f%% (%d against %.1f).", F.col("crime_type"), F.col("spike_percentage"), F.col("current_count"), F.col("baseline_average")
            ).alias("summary"),
            F.lit(0.88).alias("confidence_score"),
            F.lit("CATEGORY").alias("target_type"),
            F.col("crime_type").alias("target_id"),
            where.alias("jurisdiction_id"),
            F.to_json(F.struct(*spikes.columns)).alias("evidence_payload"),
        ),
        now,
    )


def match_flags(matches: DataFrame, now: Column, jurisdiction: Column | None = None, minimum: float = 0.7) -> DataFrame:
    """Flags for similar-method matches of at least ``minimum``; columns source, target, similarity_score."""
    score = F.col("similarity_score")
    evidence = F.to_json(F.struct(*matches.columns))
    return _shape(
        matches.where(score >= minimum).select(
            F.concat_ws("_", F.lit("FLAG_MO"), "source", "target").alias("flag_id"),
            F.lit("MO_LINK").alias("flag_type"),
            labels.match_severity(score).alias("severity"),
            F.concat(F.lit("Similar method: "), F.col("source").cast("string"), F.lit(" and "), F.col("target").cast("string")).alias("title"),
            F.format_string("Similarity %.1f%%.", score * 100.0).alias("summary"),
            score.alias("confidence_score"),
            F.lit("INCIDENT").alias("target_type"),
            F.col("target").cast("string").alias("target_id"),
            (F.lit(None).cast("string") if jurisdiction is None else jurisdiction.cast("string")).alias("jurisdiction_id"),
            evidence.alias("evidence_payload"),
        ),
        now,
    )


def without_pending_target(candidates: DataFrame, flags: DataFrame) -> DataFrame:
    """Drop candidates whose target already has a pending flag; one candidate per target stays."""
    pending = flags.where(F.col("status") == "PENDING").select("target_id").distinct()
    lowest = candidates.groupBy("target_id").agg(F.min("flag_id").alias("flag_id"))
    return candidates.join(lowest, ["target_id", "flag_id"], "left_semi").join(pending, "target_id", "left_anti").select(*candidates.columns)


def without_pending_type(candidates: DataFrame, flags: DataFrame, with_region: bool = False) -> DataFrame:
    """Drop trend candidates whose type occurs in the title of a pending flag, in any region unless
    ``with_region``. Titles are cut into their stretches of the lengths that types have, and those are joined with the types by
    equality; the work does not grow with the number of types."""
    lengths = candidates.select(F.char_length("target_id").alias("n")).where("n > 0").distinct().agg(F.collect_set("n")).scalar()
    regions: Sequence[str] = ["jurisdiction_id"] if with_region else []
    titles = flags.where(F.col("status") == "PENDING").select(*regions, "title").distinct()
    sized = titles.select(*regions, "title", F.explode(lengths).alias("_n")).where(F.char_length("title") >= F.col("_n"))
    places = F.sequence(F.lit(1), F.char_length("title") - F.col("_n") + 1)
    named = sized.select(*regions, F.explode(F.transform(places, lambda i: F.substr("title", i, F.col("_n")))).alias("target_id"))
    return candidates.join(named.distinct(), [*regions, "target_id"], "left_anti").select(*candidates.columns)
