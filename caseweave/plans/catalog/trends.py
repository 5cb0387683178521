"""Registered queries: daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import trend as ops
from .. import inputs
from .common import COUNTS, EVENTS, ORDERS, TREND, shaped, with_


def _event_grid(spark, d):
    return ops.daily_grid(ops.daily_counts(inputs.event_incidents(spark, d)))


def _order_summary(spark, d):
    return ops.trend_summary(ops.daily_grid(ops.daily_counts(inputs.order_incidents(spark, d))))


def _order_grid(spark, d):
    return ops.daily_grid(ops.daily_counts(inputs.order_incidents(spark, d)))


def moving_averages(spark, d):
    return shaped(ops.moving_averages(_event_grid(spark, d)))


def growth_rates(spark, d):
    return shaped(ops.growth_rates(ops.moving_averages(_event_grid(spark, d)))).drop("moving_average_7", "moving_average_30")


def trend_anomalies(spark, d):
    return shaped(ops.anomalies(_order_summary(spark, d)))


def spike_events(spark, d):
    return shaped(ops.spike_events(ops.anomalies(_order_summary(spark, d))))


def series_statistics(spark, d):
    s = _order_summary(spark, d)
    return shaped(ops.series_statistics(s, ops.anomalies(s)))


def district_ranking(spark, d):
    s = _order_summary(spark, d)
    return shaped(ops.district_ranking(s, ops.anomalies(s)))


def rolling_zscore(spark, d):
    return shaped(ops.rolling_z(_event_grid(spark, d)))


def period_spike(spark, d):
    e = inputs.event_incidents(spark, d)
    newest = e.agg(F.max("occurrence_datetime")).scalar()
    return shaped(ops.period_spikes(e, newest, 7, 3, ("district", "crime_type")))


_PERIOD = """SELECT district, crime_type, {key} AS {name}, CAST(sum(daily_incidents) AS BIGINT) AS {total} FROM grid GROUP BY 1, 2, 3"""


def _period_sql(key: str, name: str, total: str, rate: str) -> str:
    sums = _PERIOD.format(key=key, name=name, total=total)
    return with_(
        ORDERS + ", " + COUNTS + f", sums AS ({sums})",
        f"""SELECT *, round(CASE WHEN coalesce(lag({total}) OVER w, 0) = 0 THEN CAST(0 AS DOUBLE)
          ELSE CAST({total} AS DOUBLE) / lag({total}) OVER w - 1 END, 4) AS {rate}
        FROM sums WINDOW w AS (PARTITION BY district, crime_type ORDER BY {name})""",
    )


QUERIES = {
    "daily_counts": (
        lambda s, d: shaped(ops.daily_counts(inputs.event_incidents(s, d))),
        with_(EVENTS + ", " + COUNTS, "SELECT date, district, crime_type, CAST(n AS BIGINT) AS daily_incidents FROM counts"),
    ),
    "daily_grid": (
        lambda s, d: shaped(_event_grid(s, d)),
        with_(EVENTS + ", " + COUNTS, "SELECT date, district, crime_type, daily_incidents FROM grid"),
    ),
    "moving_averages": (
        moving_averages,
        with_(EVENTS + ", " + TREND, """SELECT date, district, crime_type, daily_incidents, round(moving_average_7, 6) AS moving_average_7,
          round(moving_average_30, 6) AS moving_average_30 FROM summary"""),
    ),
    "growth_rates": (
        growth_rates,
        with_(EVENTS + ", " + TREND, """SELECT date, district, crime_type, daily_incidents, round(daily_growth_rate, 6) AS daily_growth_rate,
          round(weekly_growth_rate, 6) AS weekly_growth_rate, trend_strength_pct, trend_direction FROM summary"""),
    ),
    "rolling_zscore": (
        rolling_zscore,
        with_(EVENTS + ", " + TREND, """SELECT date, district, crime_type, daily_incidents, round(rolling_mean, 6) AS rolling_mean,
          round(rolling_std, 6) AS rolling_std, round(z, 6) AS z_score FROM summary"""),
    ),
    "trend_anomalies": (trend_anomalies, with_(ORDERS + ", " + TREND, "SELECT * FROM anomalies")),
    "spike_events": (spike_events, with_(ORDERS + ", " + TREND, "SELECT * FROM spikes")),
    "series_statistics": (series_statistics, with_(ORDERS + ", " + TREND, "SELECT * FROM statistics")),
    "weekly_trends": (
        lambda s, d: shaped(ops.weekly(_order_grid(s, d))),
        _period_sql("CAST(date_trunc('week', date) AS DATE) + 6", "week_start", "weekly_incidents", "weekly_growth_rate"),
    ),
    "monthly_trends": (
        lambda s, d: shaped(ops.monthly(_order_grid(s, d))),
        _period_sql("last_day(date)", "month", "monthly_incidents", "monthly_growth_rate"),
    ),
    "day_of_week": (
        lambda s, d: shaped(ops.day_of_week(_order_grid(s, d))),
        with_(ORDERS + ", " + COUNTS, """SELECT dayname(date) AS day_of_week, isodow(date) >= 6 AS is_weekend,
          CAST(sum(daily_incidents) AS BIGINT) AS total_incidents, round(avg(daily_incidents), 3) AS average_incidents FROM grid GROUP BY 1, 2"""),
    ),
    "district_ranking": (
        district_ranking,
        with_(ORDERS + ", " + TREND + """, perday AS (SELECT district, date, sum(daily_incidents) AS n FROM grid GROUP BY 1, 2),
          base AS (SELECT p.district, CAST(sum(n) AS BIGINT) AS total_incidents, round(avg(n), 3) AS average_daily_incidents,
            (SELECT count(*) FROM anomalies a WHERE a.district = p.district) AS number_of_anomalies FROM perday p GROUP BY 1)""",
          """SELECT district, total_incidents, rank() OVER (ORDER BY total_incidents DESC) AS rank_by_incidents, number_of_anomalies,
          rank() OVER (ORDER BY number_of_anomalies DESC) AS rank_by_anomalies, average_daily_incidents,
          rank() OVER (ORDER BY average_daily_incidents DESC) AS rank_by_average FROM base"""),
    ),
    "period_spike": (
        period_spike,
        with_(EVENTS + """, aged AS (SELECT *, CAST((SELECT max(occurrence_datetime) FROM inc) AS DATE) - CAST(occurrence_datetime AS DATE) AS age FROM inc),
          c AS (SELECT district, crime_type, count(*) FILTER (age < 7) AS current_count, count(*) FILTER (age >= 7) / 3.0 AS b
            FROM aged WHERE age >= 0 AND age < 28 GROUP BY 1, 2)""",
          """SELECT district, crime_type, current_count, round(CAST(b AS DOUBLE), 6) AS baseline_average,
          round(100.0 * (current_count - CAST(b AS DOUBLE)) / nullif(CAST(b AS DOUBLE), 0), 1) AS spike_percentage FROM c"""),
    ),
}
