"""Dense daily series per (district, crime_type), their trends, anomalies and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numbers import growth
from ..functions.timeparts import day_name, is_weekend, month_end, week_ending_sunday
from .checks import require_all
from .cleaning import clean_times

SERIES = ["district", "crime_type"]
# Tasks among which the types of a grid are dealt.
GRID_SALTS = 64


def check_parameters(
    ma_short: int = 7,
    ma_long: int = 30,
    z_window: int = 30,
    z_threshold: float = 3.0,
    severity_high: float = 4.0,
    severity_critical: float = 5.0,
    min_observations: int = 10,
    trend_threshold: float = 0.05,
) -> None:
    require_all(
        [
            (ma_short >= 2, "ma_short must be >= 2"),
            (ma_long >= 2, "ma_long must be >= 2"),
            (ma_short < ma_long, "ma_short must be < ma_long"),
            (z_window >= 5, "z_window must be >= 5"),
            (min_observations >= 3, "min_observations must be >= 3"),
            (min_observations <= z_window, "min_observations must be <= z_window"),
            (z_threshold > 0, "z_threshold must be > 0"),
            (z_threshold <= severity_high < severity_critical, "need z_threshold <= severity_high < severity_critical"),
            (0 < trend_threshold < 1, "trend_threshold must be between 0 and 1"),
        ],
        "trend parameters",
    )


def daily_counts(incidents: DataFrame) -> DataFrame:
    """Observed (date, district, crime_type) counts. Partial aggregation reduces rows to at most one
    per cell and task before the shuffle."""
    return (
        clean_times(incidents)
        .groupBy(F.col("occurrence_date").alias("date"), *SERIES)
        .agg(F.count(F.lit(1)).alias("daily_incidents"))
    )


def daily_grid(counts: DataFrame) -> DataFrame:
    """Fill the whole grid: every day between the first and the last, every district, every type.

    Districts and types are distinct tables, joined to the grid they define; days are exploded. Zero rows and observed rows
    are then merged by one aggregation keyed on the series, and that partitioning also serves every
    window of the trend operators.
    """
    days = counts.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.sum("daily_incidents").alias("total")).where("total > 0")
    extent = days.select(F.sequence("first", "last").alias("days")).scalar()
    salts = F.explode(F.sequence(F.lit(0), F.lit(GRID_SALTS - 1))).alias("salt")
    districts = counts.groupBy("district").agg(F.sum("daily_incidents").alias("_n")).where("_n > 0").select("district", salts)
    types = counts.groupBy("crime_type").agg(F.sum("daily_incidents").alias("_n")).where("_n > 0").select("crime_type", F.pmod(F.hash("crime_type"), F.lit(GRID_SALTS)).alias("salt"))
    # The product of districts and types is the grid itself; a type meets the districts in the task of its salt.
    spanned = districts.select("district", "salt", extent.alias("days"))
    zeros = spanned.join(types.where("crime_type is not null"), "salt").select(
        F.explode("days").alias("date"), "district", "crime_type", F.lit(0).cast("bigint").alias("daily_incidents")
    )
    return (
        zeros.unionByName(counts)
        .repartition(*[F.col(c) for c in SERIES])
        .groupBy("date", *SERIES)
        .agg(F.sum("daily_incidents").alias("daily_incidents"))
    )


def _by_date():
    return Window.partitionBy(*SERIES).orderBy("date")


def moving_averages(grid: DataFrame, short: int = 7, long: int = 30) -> DataFrame:
    mean = F.avg("daily_incidents")
    return grid.withColumns(
        {
            "moving_average_7": mean.over(_by_date().rowsBetween(-(short - 1), 0)),
            "moving_average_30": mean.over(_by_date().rowsBetween(-(long - 1), 0)),
        }
    )


def growth_rates(averaged: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Day-on-day and week-on-week growth, and the 7-day change of the short average."""
    n, ma = F.col("daily_incidents"), F.col("moving_average_7")
    with_change = averaged.withColumns(
        {
            "daily_growth_rate": growth(n, F.lag(n, 1).over(_by_date())),
            "weekly_growth_rate": growth(n, F.lag(n, 7).over(_by_date())),
            "_change": growth(ma, F.lag(ma, 7).over(_by_date())),
        }
    )
    return with_change.withColumns(
        {
            "trend_strength_pct": F.round(F.col("_change") * 100, 2),
            "trend_direction": labels.trend_label(F.col("_change"), threshold),
        }
    ).drop("_change")


def rolling_z(grid: DataFrame, window: int = 30, min_observations: int = 10) -> DataFrame:
    """Z-score of each day against the preceding ``window`` days, today excluded."""
    frame = _by_date().rowsBetween(-window, -1)
    enough = F.count("daily_incidents").over(frame) >= min_observations
    scored = grid.withColumns(
        {
            "rolling_mean": F.when(enough, F.avg("daily_incidents").over(frame)),
            "rolling_std": F.when(enough, F.stddev_samp("daily_incidents").over(frame)),
        }
    )
    return scored.withColumn(
        "z_score",
        F.when(F.col("rolling_std") > 0, (F.col("daily_incidents") - F.col("rolling_mean")) / F.col("rolling_std")),
    )


def trend_summary(grid: DataFrame, ma_short=7, ma_long=30, z_window=30, min_observations=10, trend_threshold=0.05) -> DataFrame:
    """The full daily frame: averages, growth, direction, baseline and z-score."""
    return rolling_z(
        growth_rates(moving_averages(grid, ma_short, ma_long), trend_threshold), z_window, min_observations
    ).select(
        "date", *SERIES, "daily_incidents", "moving_average_7", "moving_average_30", "daily_growth_rate",
        "weekly_growth_rate", "trend_strength_pct", "trend_direction", "rolling_mean", "rolling_std", "z_score",
    )


def anomalies(summary: DataFrame, threshold: float = 3.0, high: float = 4.0, critical: float = 5.0) -> DataFrame:
    """Days with |z| at or above the threshold. The band is read from the rounded z."""
    return (
        summary.where(F.abs("z_score") >= threshold)
        .select(
            "date",
            *SERIES,
            F.col("daily_incidents").alias("incident_count"),
            F.round("rolling_mean", 2).alias("expected_count"),
            F.round("z_score", 3).alias("z_score"),
        )
        .withColumn("severity", labels.z_severity(F.abs("z_score"), high, critical))
    )


def spike_events(found: DataFrame) -> DataFrame:
    """Runs of consecutive anomalous days per series."""
    starts = F.when(F.datediff("date", F.lag("date").over(_by_date())) == 1, 0).otherwise(1)
    runs = found.withColumn("_start", starts).withColumn(
        "_event", F.sum("_start").over(_by_date().rowsBetween(Window.unboundedPreceding, 0))
    )
    strongest = F.struct(F.abs("z_score"), -F.unix_date("date"))
    return (
        runs.groupBy(*SERIES, "_event")
        .agg(
            F.min("date").alias("spike_start"),
            F.max("date").alias("spike_end"),
            F.max("incident_count").alias("peak_incident_count"),
            F.max_by("z_score", strongest).alias("peak_z_score"),
            F.max(labels.z_severity_rank(F.col("severity"))).alias("_rank"),
        )
        .select(
            *SERIES,
            "spike_start",
            "spike_end",
            (F.datediff("spike_end", "spike_start") + 1).alias("duration_days"),
            "peak_incident_count",
            "peak_z_score",
            labels.lookup({1: "Moderate", 2: "High", 3: "Critical"}, F.col("_rank")).alias("severity"),
        )
    )


def series_statistics(summary: DataFrame, found: DataFrame) -> DataFrame:
    """Totals per series with the number of spikes and the direction on the last day."""
    base = summary.groupBy(*SERIES).agg(
        F.sum("daily_incidents").alias("total_incidents"),
        F.round(F.avg("daily_incidents"), 3).alias("average_daily_incidents"),
        F.max("daily_incidents").alias("maximum_daily_incidents"),
        F.max_by("trend_direction", "date").alias("trend_direction"),
    )
    spikes = found.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("number_of_spikes"))
    return base.join(spikes, SERIES, "left").select(
        *SERIES,
        "total_incidents",
        "average_daily_incidents",
        "maximum_daily_incidents",
        F.coalesce("number_of_spikes", F.lit(0)).cast("bigint").alias("number_of_spikes"),
        "trend_direction",
    )


def _period(grid: DataFrame, bucket: Column, key: str, total: str, rate: str) -> DataFrame:
    sums = grid.groupBy(*SERIES, bucket.alias(key)).agg(F.sum("daily_incidents").alias(total))
    previous = F.lag(total).over(Window.partitionBy(*SERIES).orderBy(key))
    return sums.withColumn(rate, F.round(growth(F.col(total), previous), 4))


def weekly(grid: DataFrame) -> DataFrame:
    """Weekly totals. ``week_start`` carries the Sunday that ends the week."""
    return _period(grid, week_ending_sunday(F.col("date")), "week_start", "weekly_incidents", "weekly_growth_rate")


def monthly(grid: DataFrame) -> DataFrame:
    """Monthly totals labelled with the month's last day."""
    return _period(grid, month_end(F.col("date")), "month", "monthly_incidents", "monthly_growth_rate")


def day_of_week(grid: DataFrame) -> DataFrame:
    """Totals and mean per grid cell for each weekday, Monday first."""
    return (
        grid.groupBy(F.weekday("date").alias("_d"), day_name(F.col("date")).alias("day_of_week"), is_weekend(F.col("date")).alias("is_weekend"))
        .agg(
            F.sum("daily_incidents").alias("total_incidents"),
            F.round(F.avg("daily_incidents"), 3).alias("average_incidents"),
        )
        .orderBy("_d")
        .drop("_d")
    )


def district_ranking(grid: DataFrame, found: DataFrame) -> DataFrame:
    """Three min-method ranks. The ranked frame has one row per district."""
    per_day = grid.groupBy("district", "date").agg(F.sum("daily_incidents").alias("n"))
    base = per_day.groupBy("district").agg(
        F.sum("n").alias("total_incidents"), F.round(F.avg("n"), 3).alias("average_daily_incidents")
    )
    spikes = found.groupBy("district").agg(F.count(F.lit(1)).alias("number_of_anomalies"))
    joined = base.join(spikes, "district", "left").withColumn(
        "number_of_anomalies", F.coalesce("number_of_anomalies", F.lit(0)).cast("bigint")
    )

    def rank_of(c: str) -> Column:
        return F.rank().over(Window.orderBy(F.col(c).desc())).cast("bigint")

    return joined.select(
        "district",
        "total_incidents",
        rank_of("total_incidents").alias("rank_by_incidents"),
        "number_of_anomalies",
        rank_of("number_of_anomalies").alias("rank_by_anomalies"),
        "average_daily_incidents",
        rank_of("average_daily_incidents").alias("rank_by_average"),
    )


def trend_outputs(
    incidents: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df, **parameters
) -> dict[str, DataFrame]:
    """All eight trend tables. When several are written, pass ``scale.materialize`` as ``keep`` so
    that the grid, the summary and the anomalies are computed once; otherwise nothing runs here."""
    check_parameters(**parameters)
    p = {"ma_short": 7, "ma_long": 30, "z_window": 30, "min_observations": 10, "trend_threshold": 0.05, **parameters}
    bands = {
        "threshold": p.pop("z_threshold", 3.0),
        "high": p.pop("severity_high", 4.0),
        "critical": p.pop("severity_critical", 5.0),
    }
    grid = keep(daily_grid(daily_counts(incidents)))
    summary = keep(trend_summary(grid, **p))
    found = keep(anomalies(summary, **bands))
    return {
        "trend_summary": summary,
        "anomalies": found,
        "spike_events": spike_events(found),
        "statistics": series_statistics(summary, found),
        "weekly": weekly(grid),
        "monthly": monthly(grid),
        "day_of_week": day_of_week(grid),
        "district_ranking": district_ranking(grid, found),
    }


def type_days(incidents: DataFrame, keys=("crime_type",)) -> DataFrame:
    """Counts per key and day; counts of different row sets can be united."""
    return incidents.groupBy(*keys, F.to_date("occurrence_datetime").alias("date")).agg(F.count(F.lit(1)).alias("n"))


def spikes_of_days(counts: DataFrame, as_of: Column, days: int = 30, periods: int = 3, keys=("crime_type",)) -> DataFrame:
    """Sum of the last ``days`` days against the mean of the ``periods`` preceding spans."""
    age = F.datediff(F.to_date(as_of), "date")
    windowed = counts.where((age >= 0) & (age < days * (periods + 1)))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    change = 100.0 * (F.col("current_count") - F.col("baseline_average"))
    return (
        windowed.groupBy(*keys)
        .agg(
            total(age < days).alias("current_count"),
            (total(age >= days) / F.lit(float(periods))).alias("baseline_average"),
        )
        .withColumn(
            "spike_percentage",
            F.round(F.try_divide(change, F.nullif(F.col("baseline_average"), F.lit(0.0))), 1),
        )
    )


def period_spikes(incidents: DataFrame, as_of: Column, days: int = 30, periods: int = 3, keys=("crime_type",)) -> DataFrame:
    return spikes_of_days(type_days(incidents, keys), as_of, days, periods, keys)
