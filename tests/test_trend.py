from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caseweave.operators import trend

START = date(2024, 1, 1)


def incidents(spark, counts):
    """``counts``: {(day offset, district, type): n}."""
    rows, i = [], 0
    for (d, district, kind), n in counts.items():
        for _ in range(n):
            rows.append((i, kind, district, datetime(2024, 1, 1, 12) + timedelta(days=d)))
            i += 1
    return spark.createDataFrame(rows, "incident_id int, crime_type string, district string, occurrence_datetime timestamp")


def grid_of(spark, series):
    rows = [(START + timedelta(days=i), "D", "T", n) for i, n in enumerate(series)]
    return spark.createDataFrame(rows, "date date, district string, crime_type string, daily_incidents bigint")


def by_day(df, column):
    return [r[column] for r in df.orderBy("date").collect()]


def test_grid_fills_missing_pairs_and_days(spark):
    df = incidents(spark, {(0, "A", "x"): 2, (2, "B", "y"): 1})
    rows = {(r["date"], r["district"], r["crime_type"]): r["daily_incidents"] for r in trend.daily_grid(trend.daily_counts(df)).collect()}
    assert len(rows) == 3 * 2 * 2 and sum(rows.values()) == 3
    assert rows[(START + timedelta(days=1), "A", "y")] == 0


def test_growth_from_zero_is_zero(spark):
    g = trend.growth_rates(trend.moving_averages(grid_of(spark, [0, 0, 3, 0, 2, 4])))
    assert by_day(g, "daily_growth_rate") == [0.0, 0.0, 0.0, -1.0, 0.0, 1.0]
    assert by_day(g, "weekly_growth_rate") == [0.0] * 6


def test_moving_average_uses_what_exists(spark):
    assert by_day(trend.moving_averages(grid_of(spark, [3, 5, 7])), "moving_average_7") == [3.0, 4.0, 5.0]


@pytest.mark.parametrize("late,want", [(5, "Stable"), (6, "Increasing"), (3, "Stable"), (2, "Decreasing")])
def test_direction_is_strict(spark, late, want):
    """A change of exactly the threshold (here a quarter, which is exact in binary) is Stable."""
    averaged = trend.moving_averages(grid_of(spark, [4] * 7 + [late] * 7))
    assert by_day(trend.growth_rates(averaged, 0.25), "trend_direction")[-1] == want


def test_baseline_excludes_today_and_needs_ten_days(spark):
    series = [1, 3] * 5 + [40] + [2] * 3
    scored = trend.rolling_z(grid_of(spark, series))
    z = by_day(scored, "z_score")
    assert z[:10] == [None] * 10 and z[10] > 30
    assert by_day(scored, "rolling_mean")[10] == 2.0


def test_flat_series_is_unscored(spark):
    assert by_day(trend.rolling_z(grid_of(spark, [4] * 20)), "z_score") == [None] * 20


def summary_row(spark, z):
    return spark.createDataFrame([(START, "D", "T", 5, 1.234, z)], "date date, district string, crime_type string, daily_incidents bigint, rolling_mean double, z_score double")


@pytest.mark.parametrize("z,band", [(2.9999, None), (3.0, "Moderate"), (3.9996, "High"), (-5.2, "Critical"), (4.9994, "High")])
def test_bands_read_the_rounded_score(spark, z, band):
    rows = trend.anomalies(summary_row(spark, z)).collect()
    assert [r["severity"] for r in rows] == ([] if band is None else [band])


def test_islands(spark):
    days = [(0, "x", 4, 3.5, "Moderate"), (1, "x", 9, -4.0, "High"), (2, "x", 6, 4.0, "High"), (4, "x", 2, 3.0, "Moderate"), (1, "y", 3, 3.1, "Moderate")]
    found = spark.createDataFrame([(START + timedelta(days=d), "D", t, n, z, s) for d, t, n, z, s in days], "date date, district string, crime_type string, incident_count bigint, z_score double, severity string")
    rows = sorted((r["crime_type"], r["spike_start"], r["duration_days"], r["peak_incident_count"], r["peak_z_score"], r["severity"]) for r in trend.spike_events(found).collect())
    assert rows == [
        ("x", START, 3, 9, -4.0, "High"),  # |z| ties go to the earlier day
        ("x", START + timedelta(days=4), 1, 2, 3.0, "Moderate"),
        ("y", START + timedelta(days=1), 1, 3, 3.1, "Moderate"),
    ]
    assert trend.spike_events(found.limit(0)).count() == 0


def test_calendar_labels(spark):
    g = grid_of(spark, [1] * 31).where(F.col("date") >= "2024-01-07")
    weeks = {r["week_start"]: r["weekly_incidents"] for r in trend.weekly(g).collect()}
    assert weeks[date(2024, 1, 7)] == 1 and weeks[date(2024, 1, 14)] == 7  # the 7th is a Sunday
    leap = grid_of(spark, [1] * 60)
    assert {r["month"] for r in trend.monthly(leap).collect()} == {date(2024, 1, 31), date(2024, 2, 29)}


def test_ranks_share_places(spark):
    rows = [(START, d, "T", n) for d, n in (("A", 5), ("B", 5), ("C", 2))]
    g = spark.createDataFrame(rows, "date date, district string, crime_type string, daily_incidents bigint")
    none = spark.createDataFrame([], "district string, crime_type string")
    got = {r["district"]: r["rank_by_incidents"] for r in trend.district_ranking(g, none).collect()}
    assert got == {"A": 1, "B": 1, "C": 3}


@pytest.mark.parametrize("now,before,want", [(19, 12, 58.3), (42, 28, 50.0), (4, 0, None)])
def test_period_spike(spark, now, before, want):
    counts = {(100, "A", "x"): now}
    if before:
        counts.update({(100 - 30 * k, "A", "x"): before for k in (1, 2, 3)})
    as_of = F.lit("2024-04-10").cast("date")
    assert trend.period_spikes(incidents(spark, counts), as_of).first()["spike_percentage"] == want


def test_all_parameter_errors_at_once():
    with pytest.raises(ValueError) as error:
        trend.check_parameters(ma_short=40, z_window=2, trend_threshold=2.0)
    assert str(error.value).count(";") >= 2


def test_outputs_are_eight_tables(spark):
    out = trend.trend_outputs(incidents(spark, {(d, "A", "x"): 1 + d % 3 for d in range(40)}))
    assert len(out) == 8 and out["statistics"].first()["total_incidents"] == sum(1 + d % 3 for d in range(40))
