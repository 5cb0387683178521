"""Daily counts from event-time state against counts at once."""

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from caseweave.streaming.windows import run_windowed_counts, windowed_counts

SCHEMA = "occurrence_datetime timestamp, district string, crime_type string"


def at(day, hour=10):
    return datetime(2024, 1, 1) + timedelta(days=day, hours=hour)


def run(spark, tmp_path, files):
    sizes = []
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        sizes.append(run_windowed_counts(stream, f"{tmp_path}/t", f"{tmp_path}/cp"))
    got = {(r.date, r.district, r.crime_type): r.daily_incidents for r in windowed_counts(spark, f"{tmp_path}/t").collect()}
    rows = [r for f in files for r in f]
    assert got == Counter((t and t.date(), d, c) for t, d, c in rows)
    return sizes


def test_late_rows_and_restarts(spark, tmp_path):
    """Each file is a run of its own; the third brings days that closed, rows without a time and nulls as keys."""
    files = [
        [(at(d), "D", "T") for d in range(3)] * 40 + [(at(2, 23), "E", None)],
        [(at(9), "D", "T"), (at(8), "D", "T"), (at(2), "D", "T")],
        [(at(0), "D", "T"), (at(0), "D", "T"), (None, "D", "T"), (at(9), None, "T"), (at(1, 0), "E", "T")],
        [(None, "D", "T"), (at(0), "D", "T"), (at(10), "D", "T")],
    ]
    run(spark, tmp_path, files)
    late = spark.read.parquet(f"{tmp_path}/t/late_counts/delta").agg(F.sum("daily_incidents")).first()[0]
    assert late >= 6  # the closed days and the rows without a time


def test_state_stays_small(spark, tmp_path):
    sizes = run(spark, tmp_path, [[(at(5 * n + d), f"D{k}", "T") for d in range(5) for k in range(4)] for n in range(6)])
    assert max(s[-1] for s in sizes if s) <= 4 * 5 * 2  # of 120 cells in all
