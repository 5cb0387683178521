"""Daily counts with event-time state.

Every task first counts its own rows per (day, district, type), so a busy cell sends a few rows only. The state holds one number per cell of a day that is still open;
each batch gives the new totals of the cells it touched. A day closes once the watermark passes its end: its cells leave the state with the next batch. Rows that
come later, and rows without a time, are not dropped but added to a table of corrections. What is open follows the watermark's delay, not the length of the stream.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scale import materialize
from ..sources.keyed import KeyedTable, compact_every
from .counts import CELL
from .tables import ROWS_ONLY, STATE_STORE, settings

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMPACT_EVERY = 8
PARTIAL = "date date, district string, crime_type string, daily_incidents bigint, newest timestamp"
TOTAL = "date date, district string, crime_type string, daily_incidents bigint, late boolean"
STORED = "date date, district string, crime_type string, daily_incidents bigint"


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counted = pa.Table.from_batches([batch]).group_by(list(CELL)).aggregate([("at", "max"), ("one", "sum")])
        yield from counted.select([*CELL, "one_sum", "at_max"]).rename_columns([*CELL, "daily_incidents", "newest"]).to_batches()


def _total(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The new total of an open cell; what a closed one got since it closed."""
    day, district, kind = (None if pd.isnull(k) else k for k in key)
    closed = day is None or (pd.Timestamp(day) + pd.Timedelta(days=1)).timestamp() * 1000 <= state.getCurrentWatermarkMs()
    if state.hasTimedOut:
        if closed:
            state.remove()
        else:
            state.setTimeoutDuration(1)
        return
    n = sum(int(f["daily_incidents"].sum()) for f in frames)
    if not closed:
        n += state.get[0] if state.exists else 0
        state.update((n,))
        state.setTimeoutDuration(1)  # looked at again in the next batch
    elif state.exists:
        state.remove()
    yield pd.DataFrame({"date": [day and pd.Timestamp(day).date()], "district": [district], "crime_type": [kind], "daily_incidents": [n], "late": [closed]})


def _tables(spark: SparkSession, folder: str) -> tuple[KeyedTable, KeyedTable]:
    """The totals of the cells, of which the greatest is the newest, and the corrections, which add up."""
    def table(name: str, how) -> KeyedTable:
        return KeyedTable(spark, f"{folder}/{name}", STORED, list(CELL), lambda: [how("daily_incidents").alias("daily_incidents")], list(CELL))

    return table("windowed_counts", F.max), table("late_counts", F.sum)


def run_windowed_counts(incidents: DataFrame, folder: str, checkpoint: str, delay: str = "2 days") -> list[int]:
    """Count what is there and stop; the number of cells in the state after each batch."""
    spark = incidents.sparkSession
    at = F.col("occurrence_datetime").cast("timestamp")
    rows = incidents.select(F.to_date(at).alias("date"), "district", "crime_type", at.alias("at"), F.lit(1).cast("bigint").alias("one"))
    timed = rows.mapInArrow(_partial, PARTIAL).withWatermark("newest", delay)
    totals = timed.groupBy(*CELL).applyInPandasWithState(_total, TOTAL, "n bigint", "update", GroupStateTimeout.ProcessingTimeTimeout)
    cells, late = _tables(spark, folder)

    def apply(df: DataFrame, batch: int) -> None:
        compact_every([cells, late], batch, COMPACT_EVERY)
        found = materialize(df)
        cells.append(found.where("not late").drop("late"), batch)
        late.append(found.where("late").drop("late"), batch)

    with settings(spark, {**STATE_STORE, **ROWS_ONLY}):
        query = totals.writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def windowed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of all days, open and closed."""
    cells, late = _tables(spark, folder)
    return cells.read().unionByName(late.read()).groupBy(*CELL).agg(F.sum("daily_incidents").alias("daily_incidents"))
