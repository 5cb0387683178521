"""Building blocks that keep a plan healthy when one key holds a large share of all rows.

* ``materialize``      cut lineage with a Parquet table in the cluster's shared checkpoint folder
* ``skew_safe_join``   equi-join whose hot keys are spread over many tasks
* ``exact_quantiles``  exact interpolated quantiles without holding a group in one task
* ``dense_index``      0..n-1 numbering (optionally per group) without a one-task window
* ``value_modes``      most frequent value per group from pre-aggregated counts
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A key is hot if it holds at least HOT_ROWS rows and at least 1 / HOT_KEYS of all rows, so there are at most HOT_KEYS hot keys,
# which bounds their broadcast. A hot key is spread over one more task for each such share that it holds.
HOT_ROWS = 2_000_000
HOT_KEYS = 10_000
# Rows without a key match nothing; they are spread over this many tasks.
NULL_SPREAD = 64

# Groups up to SMALL_GROUP rows are ranked whole; larger ones are narrowed first with a mergeable
# sketch whose rank error is 1 / SKETCH_ACCURACY of the group.
SMALL_GROUP = 100_000
SKETCH_ACCURACY = 20_000
BRACKET = 4.0 / SKETCH_ACCURACY


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="caseweave-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: Tables written by this session and not yet removed by a ``run_scope``.
_written: list[str] = []


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the intermediate tables written inside. Results must have been written or collected by then."""
    before = len(_written)
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for name in _written[before:]:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        del _written[before:]


def materialize(df: DataFrame, *folders: str) -> DataFrame:
    """Write ``df`` to the shared folder, with a folder per value of the columns ``folders``, and read it back.

    The result has no lineage to recompute, survives lost executors, is columnar and has known
    size, so later joins are planned from real statistics.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/caseweave/{uuid.uuid4().hex}"
    _written.append(path)
    df.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scalar_of(df: DataFrame, expr: Column) -> Column:
    """One-row aggregate of ``df`` as an uncorrelated scalar subquery."""
    return df.agg(expr.alias("v")).scalar()


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """(keys, _spread): every hot key, and the number of tasks it is spread over."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    share = F.greatest(F.lit(HOT_ROWS if rows is None else rows).cast("double"), scalar_of(df, F.count(F.lit(1))) / HOT_KEYS)
    return counts.where(F.col("_n") >= share).select(*keys, (F.ceil(F.col("_n") / share) + 1).cast("bigint").alias("_spread"))


def skew_safe_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    rows: int | None = None,
) -> DataFrame:
    """Join a large, possibly skewed ``left`` with a ``right`` that is unique or short per key.

    Rows of a hot key get a salt, a hash of the row, and only the matching right rows are copied once per salt. Every other key
    keeps salt 0. The hash is the same on every attempt, which a retried task needs; for that, identical rows share a salt, so where
    many may be identical, aggregate them before the join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_safe_join does not support how={how!r}")
    on = list(on)
    marked = F.broadcast(hot_keys(left, on, rows))
    row_hash = F.xxhash64(*[F.col(c) for c in left.columns])
    no_key = F.lit(False)
    for c in on:
        no_key = no_key | F.col(c).isNull()
    spread = F.coalesce(F.col("_spread"), F.when(no_key, F.lit(NULL_SPREAD).cast("bigint")))
    salted_left = left.join(marked, on, "left").withColumn(
        "_salt",
        F.when(spread.isNotNull(), F.pmod(row_hash, spread.cast("bigint"))).otherwise(
            F.lit(0).cast("bigint")
        ),
    ).drop("_spread")
    salted_right = (
        right.join(marked, on, "left")
        .withColumn(
            "_salt",
            F.explode(
                F.sequence(
                    F.lit(0).cast("bigint"),
                    F.coalesce(F.col("_spread"), F.lit(1)).cast("bigint") - 1,
                )
            ),
        )
        .drop("_spread")
    )
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    groups: Sequence[str] = (),
) -> DataFrame:
    """Exact linear-interpolated quantiles, one output column per entry of ``probs``.

    Pass 1 builds a mergeable sketch per group. Pass 2 counts the rows below a bracket around each
    wanted rank and keeps only the few values inside the bracket, so no task ever sees a whole
    group. Groups of up to SMALL_GROUP rows use their full range as the bracket. The bracket is
    checked against the exact counts; a miss raises instead of giving a wrong answer.
    """
    groups = list(groups)
    names = list(probs)
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    keyed = rows if groups else rows.withColumn("_all", F.lit(0))
    keys = groups or ["_all"]
    edges = [min(1.0, max(0.0, p + side * BRACKET)) for p in probs.values() for side in (-1, 1)]
    sketch = keyed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_cnt"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", edges, SKETCH_ACCURACY).alias("_edges"),
    )
    small = F.col("_cnt") <= SMALL_GROUP
    brackets = []
    for i, name in enumerate(names):
        low_edge = F.when(small | F.lit(edges[2 * i] == 0.0), F.col("_min")).otherwise(F.col("_edges")[2 * i])
        high_edge = F.when(small | F.lit(edges[2 * i + 1] == 1.0), F.col("_max")).otherwise(
            F.col("_edges")[2 * i + 1]
        )
        rank = (F.col("_cnt") - 1) * F.lit(float(probs[name]))
        brackets.append(
            F.struct(
                F.lit(i).alias("q"), low_edge.alias("lo"), high_edge.alias("hi"), rank.alias("rank"),
            )
        )
    plan = sketch.select(*keys, "_cnt", F.array(*brackets).alias("_b"))
    if groups:
        joined = keyed.join(plan, keys)
    else:
        only = plan.select(F.struct("_cnt", "_b").alias("p")).scalar()
        joined = keyed.withColumn("_p", only).select(*keys, "_v", "_p._cnt", "_p._b")
    counted = (
        joined.select(*keys, "_v", "_cnt", F.explode("_b").alias("_b"))
        .where(F.col("_v") <= F.col("_b.hi"))
        .select(
            *keys,
            F.col("_b.q").alias("_q"),
            F.col("_b.rank").alias("_rank"),
            F.col("_cnt"),
            F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_v"),
        )
        .groupBy(*keys, "_q", "_rank", "_cnt", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    order = Window.partitionBy(*keys, "_q").orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_cum", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    floor_rank = F.floor("_rank")
    next_rank = F.least(floor_rank + 1, F.col("_cnt") - 1)
    picked = ranked.groupBy(*keys, "_q", "_rank", "_cnt").agg(
        F.min(F.when(F.col("_cum") > floor_rank, F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_cum") > next_rank, F.col("_v"))).alias("_b"),
        F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0)).alias("_below"),
        F.max("_cum").alias("_seen"),
    )
    inside = (F.col("_below") <= floor_rank) & (F.col("_seen") > next_rank)
    fraction = F.col("_rank") - floor_rank
    exact = picked.select(
        *keys,
        "_q",
        F.when(inside, F.col("_a") + (F.col("_b") - F.col("_a")) * fraction)
        .otherwise(F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
        .alias("_x"),
    )
    out = exact.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_q") == i, F.col("_x"))).alias(n) for i, n in enumerate(names)]
    )
    return out if groups else out.drop("_all")


def dense_index(
    df: DataFrame,
    order: Sequence[str],
    name: str,
    groups: Sequence[str] = (),
) -> DataFrame:
    """Add a 0-based position in ``order``, restarting per ``groups``; order keys must be unique.

    A range sort spreads even one huge group over all tasks; each partition numbers its own rows
    and only the (group, partition) counts are combined.
    """
    groups = list(groups)
    placed = materialize(
        df.orderBy(*[F.col(c).asc_nulls_first() for c in [*groups, *order]])
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    marks = {g: f"_g{i}" for i, g in enumerate(groups)}
    counts = placed.groupBy(*[F.col(g).alias(m) for g, m in marks.items()], F.col("_part").alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")
    )
    before = Window.partitionBy(*marks.values()).orderBy("_p")
    earlier = F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*marks.values(), "_p", (earlier - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for g, m in marks.items():
        same = same & F.col(g).eqNullSafe(F.col(m))
    return placed.join(offsets, same).select(
        *df.columns, (F.col("_pos") + F.col("_shift")).cast("bigint").alias(name)
    )


def value_modes(
    df: DataFrame, groups: Sequence[str], columns: dict[str, str], weight: Column | None = None
) -> DataFrame:
    """Most frequent value per group for each ``columns`` entry (source -> output); ties go low.
    ``weight`` is the row count behind an already aggregated row.

    Counts per (group, value) are formed first, so a hot group is reduced before it is shuffled on
    the group key alone.
    """
    groups = list(groups)
    stacked = df.select(
        *groups,
        (F.lit(1) if weight is None else weight).alias("_w"),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
        ).alias("_e"),
    ).where(F.col("_e.v").isNotNull())
    counts = stacked.groupBy(*groups, F.col("_e.c").alias("_c"), F.col("_e.v").alias("_v")).agg(
        F.sum("_w").alias("_n")
    )
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v")))
    per_column = counts.groupBy(*groups, "_c").agg(best["v"].alias("_v"))
    return per_column.groupBy(*groups).agg(
        *[F.max(F.when(F.col("_c") == c, F.col("_v"))).alias(out) for c, out in columns.items()]
    )
