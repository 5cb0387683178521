"""Result table with expiry: (cache_key, payload, written_at, expires_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TTL_SECONDS = 24 * 60 * 60
STATEWIDE_TTL_SECONDS = 7 * 24 * 60 * 60


def hotspot_key(district: Column, day: Column) -> Column:
    return F.concat_ws(":", F.lit("hotspot"), district, day.cast("string"))


def risk_key(location: Column) -> Column:
    return F.concat_ws(":", F.lit("risk_score"), location)


def forecast_key(district: Column) -> Column:
    return F.concat_ws(":", F.lit("risk_forecast"), district)


def dashboard_key(role: Column, district: Column) -> Column:
    return F.concat_ws(":", F.lit("dashboard_summary"), role, district)


def entries(df: DataFrame, key: Column, payload: Column, now: Column, ttl: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """Rows to append; ``payload`` is JSON text."""
    return df.select(
        key.alias("cache_key"), payload.alias("payload"), now.alias("written_at"),
        (now + F.make_dt_interval(secs=F.lit(ttl))).alias("expires_at"),
    )


def put(old: DataFrame, new: DataFrame) -> DataFrame:
    """Newest entry per key."""
    both = old.unionByName(new)
    return both.groupBy("cache_key").agg(
        F.max_by(F.struct("payload", "written_at", "expires_at"), F.struct("written_at", "payload")).alias("e")
    ).select("cache_key", "e.*")


def get(cache: DataFrame, now: Column, key: str | None = None) -> DataFrame:
    """Live entries; expired ones and payloads that are not JSON do not appear."""
    live = cache.where((F.col("expires_at") > now) & F.try_parse_json("payload").isNotNull())
    return live if key is None else live.where(F.col("cache_key") == key)


def patch(cache: DataFrame, changes: DataFrame, now: Column, ttl: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """Shallow merge: fields of ``changes`` replace fields of the live payload, others stay.

    Payload fields travel as JSON text per field, so nested values survive.
    """
    def fields(payload: str) -> Column:
        return F.from_json(payload, "map<string,string>")

    old = get(cache, now).select("cache_key", fields("payload").alias("_old"))
    new = changes.select("cache_key", fields("payload").alias("_new"))
    kept = F.map_filter(F.coalesce("_old", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key("_new", k))
    merged = F.map_concat(kept, F.col("_new"))
    return entries(new.join(old, "cache_key", "left"), F.col("cache_key"), F.to_json(merged), now, ttl)


def delete(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("cache_key"), "cache_key", "left_anti")
