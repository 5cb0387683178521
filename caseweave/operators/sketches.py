"""Distinct counts and quantiles from stored sketches of each day and district.

A day's rows are read once. Its sketches (HyperLogLog for distinct people, KLL for amounts) are binary columns of bounded size that merge in any order, so a month,
a quarter or a region is answered from its days' rows. The exact operators stand beside them.

Edges: rows without a date or district form groups of their own; a null person or amount is not sketched. A group without amounts has no quantile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Log2 of the buckets of a distinct count (relative error about 1.04 / sqrt(2^LG)) and size of a quantile sketch (rank error about 1.33 % at 200).
LG = 12
K = 400


def daily_sketches(incidents: DataFrame, person: str = "offender_id", amount: str = "property_loss") -> DataFrame:
    """(date, district, incidents, people, amounts): one row of sketches per day and district."""
    day = F.to_date("occurrence_datetime").alias("date")
    return incidents.groupBy(day, "district").agg(
        F.count(F.lit(1)).alias("incidents"), F.hll_sketch_agg(F.col(person), F.lit(LG)).alias("people"), F.kll_sketch_agg_double(F.col(amount).cast("double"), F.lit(K)).alias("amounts")
    )


def merged(sketches: DataFrame, *keys: str | Column) -> DataFrame:
    """Sketches of larger groups; merged ones merge again."""
    return sketches.groupBy(*keys).agg(
        F.sum("incidents").alias("incidents"), F.hll_union_agg("people").alias("people"), F.kll_merge_agg_double("amounts").alias("amounts"),
        F.count(F.lit(1)).alias("sketches"),
    )


def estimates(sketches: DataFrame, probabilities: Sequence[float] = (1 / 3, 0.5, 2 / 3)) -> DataFrame:
    """The counts, the distinct people and the quantiles (in the order given) of rows with sketches."""
    some = F.kll_sketch_get_n_double("amounts") > 0
    points = F.array(*[F.lit(float(p)) for p in probabilities])
    return sketches.withColumns({
        "distinct_people": F.hll_sketch_estimate("people"), "quantiles": F.when(some, F.kll_sketch_get_quantile_double("amounts", points)),
    }).drop("people", "amounts")
