"""Exact radius search on the sphere without listing all pairs.

Points are collapsed to distinct coordinates and placed in latitude bands whose longitude step
depends on the band, so that the diagonal of every cell is at most the radius. A cell splits 4 x 4
per level. Two boxes are settled from their bounds alone when they are entirely within or entirely
beyond the radius; only undecided boxes are split further, and points are compared one by one only
once a box pair holds few of them. A cell with millions of points therefore costs its outline, not
its square. Counts need no splitting before a box is large: a box travels as one row of arrays to
the boxes that it may reach, and there only the points near the radius are compared.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, haversine_m, radius_half_chord_sq
from .scale import materialize, skew_safe_join

# The counting of near points travels to the executors by value; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A pair of boxes with at most this many coordinate pairs is compared point by point.
DIRECT_PAIRS = 2_048
# Two boxes of at most this many coordinates each are counted in one task, a box with at most NEAR_COORDS coordinates of others at once.
BOX_COORDS = 32_768
NEAR_COORDS = 500_000
# Comparisons that are held at once.
COMPARED = 2_000_000
SPLIT_BITS = 2  # each level splits a side into 4
MAX_LEVEL = 14
SLACK = 1e-9


@dataclass(frozen=True)
class Grid:
    """Cell layout for one radius."""

    radius_m: float

    @property
    def reach(self) -> float:
        """Radius in degrees of arc."""
        return math.degrees(self.radius_m / EARTH_RADIUS_M)

    @property
    def height(self) -> float:
        """Band height in degrees, shrunk a hair so that a cell diagonal never exceeds the radius."""
        half = math.sqrt(radius_half_chord_sq(self.radius_m) / 2.0) * (1.0 - SLACK)
        return min(180.0, 2.0 * math.degrees(math.asin(min(1.0, half))))

    def _edge_cos(self, band: Column, widest: bool) -> Column:
        """Largest (or smallest) cosine of latitude inside a band."""
        south = F.least(F.lit(90.0), band * F.lit(self.height) - 90.0)
        north = F.least(F.lit(90.0), south + F.lit(self.height))
        near = F.least(F.abs(south), F.abs(north))
        near = F.when((south <= 0) & (north >= 0), 0.0).otherwise(near)
        far = F.greatest(F.abs(south), F.abs(north))
        return F.greatest(F.lit(0.0), F.cos(F.radians(near if widest else far)))

    def _arc(self, half: float, cos_product_root: Column) -> Column:
        """Longitude difference in degrees that spans ``half`` = sin(arc / 2) at this latitude."""
        share = F.when(cos_product_root <= half, 1.0).otherwise(F.try_divide(F.lit(half), cos_product_root))
        return F.degrees(F.lit(2.0) * F.asin(F.least(F.lit(1.0), share)))

    def width(self, band: Column) -> Column:
        """Longitude step of a band: 360 degrees divided into equal cells no wider than allowed."""
        half = math.sqrt(radius_half_chord_sq(self.radius_m) / 2.0) * (1.0 - SLACK)
        widest = self._arc(half, self._edge_cos(band, widest=True))
        return F.lit(360.0) / F.ceil(F.lit(360.0) / F.greatest(widest, F.lit(1e-9)))

    def columns_of(self, band: Column) -> Column:
        return F.round(F.lit(360.0) / self.width(band)).cast("bigint")

    def place(self, points: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
        """Add ``band``, ``col``, the in-cell offsets ``fy``, ``fx`` in [0, 1) and ``east``, the
        longitude counted from the 180th meridian (so that -180 and 180 are one value)."""
        y = (F.col(lat) + 90.0) / F.lit(self.height)
        banded = points.withColumn("band", F.floor(y).cast("bigint")).withColumn("fy", y - F.col("band"))
        banded = banded.withColumn("east", F.pmod(F.col(lon) + 180.0, F.lit(360.0)))
        x = F.col("east") / self.width(F.col("band"))
        col = F.least(F.floor(x).cast("bigint"), self.columns_of(F.col("band")) - 1)
        return banded.withColumn("_x", x).withColumn("col", col).withColumn("fx", F.col("_x") - F.col("col")).drop("_x")

    def near_cells(self, cells: DataFrame) -> DataFrame:
        """Each (band, col) with every (nband, ncol) that can hold a point within the radius."""
        steps = math.ceil(self.reach / self.height + SLACK)
        rows = cells.withColumn(
            "nband", F.explode(F.array(*[F.col("band") + F.lit(s).cast("bigint") for s in range(-steps, steps + 1)]))
        ).where((F.col("nband") >= 0) & (F.col("nband") * F.lit(self.height) <= 180.0))
        half = math.sqrt(radius_half_chord_sq(self.radius_m)) * (1.0 + SLACK)
        far = F.least(self._edge_cos(F.col("band"), widest=False), self._edge_cos(F.col("nband"), widest=False))
        reach = self._arc(half, far) + F.lit(SLACK)
        w, nw = self.width(F.col("band")), self.width(F.col("nband"))
        spans = rows.withColumns(
            {
                "_west": F.floor((F.col("col") * w - reach) / nw).cast("bigint"),
                "_east": F.floor(((F.col("col") + 1) * w + reach) / nw).cast("bigint"),
                "_count": self.columns_of(F.col("nband")),
            }
        )
        whole = F.col("_east") - F.col("_west") + 1 >= F.col("_count")
        first = F.when(whole, F.lit(0).cast("bigint")).otherwise(F.col("_west"))
        last = F.when(whole, F.col("_count") - 1).otherwise(F.col("_east"))
        walked = spans.withColumn("_c", F.explode(F.sequence(first, last)))
        return walked.withColumn("ncol", F.pmod(F.col("_c"), F.col("_count"))).drop("_west", "_east", "_count", "_c")


def sub_key(level: int) -> Column:
    """Box number of a point inside its cell at ``level`` (level 0 is the cell itself)."""
    if level == 0:
        return F.lit(0).cast("bigint")
    n = 1 << (SPLIT_BITS * level)
    row = F.least(F.lit(n - 1).cast("bigint"), F.floor(F.col("fy") * n).cast("bigint"))
    column = F.least(F.lit(n - 1).cast("bigint"), F.floor(F.col("fx") * n).cast("bigint"))
    return F.shiftleft(row, 31) + column


def boxes(points: DataFrame, level: int, entity: list[str]) -> DataFrame:
    """Bounding box, coordinate count and row count of every box of every entity."""
    return points.groupBy(*entity, sub_key(level).alias("sub")).agg(
        F.min("latitude").alias("s"), F.max("latitude").alias("n"),
        F.min("east").alias("w"), F.max("east").alias("e"),
        F.count(F.lit(1)).alias("coords"), F.sum("mult").alias("rows"),
    )


def _parent(level: int, sub: Column) -> Column:
    """Box number one level up."""
    if level == 1:
        return F.lit(0).cast("bigint")
    row = F.shiftright(F.shiftright(sub, 31), SPLIT_BITS)
    column = F.shiftright(sub.bitwiseAND(F.lit((1 << 31) - 1)), SPLIT_BITS)
    return F.shiftleft(row, 31) + column


def _bounds() -> tuple[Column, Column]:
    """Lower and upper bound of the haversine term between boxes a_* and b_*."""
    c = F.col
    gap_lat = F.greatest(F.lit(0.0), c("a_s") - c("b_n"), c("b_s") - c("a_n"))
    span_lat = F.greatest(c("a_n") - c("b_s"), c("b_n") - c("a_s"))
    gap_lon = F.greatest(F.lit(0.0), c("a_w") - c("b_e"), c("b_w") - c("a_e"))
    span_lon = F.greatest(c("a_e") - c("b_w"), c("b_e") - c("a_w"))
    top = F.greatest(F.abs("a_s"), F.abs("a_n"), F.abs("b_s"), F.abs("b_n"))
    crosses = F.least(c("a_s"), c("b_s")) * F.greatest(c("a_n"), c("b_n")) <= 0
    low = F.when(crosses, 0.0).otherwise(F.least(F.abs("a_s"), F.abs("a_n"), F.abs("b_s"), F.abs("b_n")))

    def sq(deg: Column) -> Column:
        return F.pow(F.sin(F.radians(deg) / 2.0), 2)

    near_lon = F.least(sq(gap_lon), sq(span_lon))
    far_lon = F.when((gap_lon <= 180.0) & (span_lon >= 180.0), 1.0).otherwise(F.greatest(sq(gap_lon), sq(span_lon)))
    cos_min, cos_max = F.cos(F.radians(top)), F.cos(F.radians(low))
    lower = sq(gap_lat) + cos_min * cos_min * near_lon
    upper = sq(span_lat) + cos_max * cos_max * far_lon
    return lower, upper


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def _cell_pairs(left: DataFrame, right: DataFrame, grid: Grid, from_right: bool, at_least: int | None) -> DataFrame:
    """Pairs of existing cells that may hold points within the radius; four integers per pair.

    The neighbourhood is spelled out from the side with fewer cells. With ``at_least``, left cells
    are dropped whose whole neighbourhood holds fewer rows, so that no point of theirs is examined.
    """
    a_cells = left.select(F.col("band").alias("a_band"), F.col("col").alias("a_col")).distinct()
    b_cells = right.groupBy(F.col("band").alias("b_band"), F.col("col").alias("b_col")).agg(F.sum("mult").alias("b_cell_rows"))
    if from_right:
        near = grid.near_cells(b_cells.withColumnsRenamed({"b_band": "band", "b_col": "col"}))
        pairs = near.withColumnsRenamed({"band": "b_band", "col": "b_col", "nband": "a_band", "ncol": "a_col"}).join(
            a_cells, ["a_band", "a_col"], "left_semi"
        )
    else:
        near = grid.near_cells(a_cells.withColumnsRenamed({"a_band": "band", "a_col": "col"}))
        pairs = near.withColumnsRenamed({"band": "a_band", "col": "a_col", "nband": "b_band", "ncol": "b_col"}).join(
            b_cells, ["b_band", "b_col"]
        )
    if at_least is not None:
        pairs = materialize(pairs)
        rich = pairs.groupBy("a_band", "a_col").agg(F.sum("b_cell_rows").alias("n")).where(F.col("n") >= at_least)
        pairs = pairs.join(rich, ["a_band", "a_col"], "left_semi")
    return pairs.select("a_band", "a_col", "b_band", "b_col")


def _split(pairs: DataFrame, a_boxes: DataFrame, b_boxes: DataFrame, level: int, la: list[str], ra: list[str]) -> DataFrame:
    """Replace each undecided pair by the pairs of its non-empty children at ``level``."""
    kept = pairs.select(
        *[f"a_{c}" for c in [*la, "sub"]], *[f"b_{c}" for c in [*ra, "sub"]]
    ).withColumnsRenamed({"a_sub": "a_up", "b_sub": "b_up"})
    a = _renamed(a_boxes, "a_").withColumn("a_up", _parent(level, F.col("a_sub")))
    b = _renamed(b_boxes, "b_").withColumn("b_up", _parent(level, F.col("b_sub")))
    return kept.join(a, [*[f"a_{c}" for c in la], "a_up"]).join(b, [*[f"b_{c}" for c in ra], "b_up"]).drop("a_up", "b_up")


def _point_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, level: int, la: list[str], ra: list[str]) -> DataFrame:
    """Coordinates of the (small) box pairs, side by side."""
    a = _renamed(left.withColumn("sub", sub_key(level)), "a_")
    b = _renamed(right.withColumn("sub", sub_key(level)), "b_")
    a_keys, b_keys = [f"a_{c}" for c in [*la, "sub"]], [f"b_{c}" for c in [*ra, "sub"]]
    return pairs.select(*a_keys, *b_keys).join(a, a_keys).join(b, b_keys)


def _within(radius_m: float) -> Column:
    return haversine_m(F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude")) <= radius_m


def _near_counts(lat: np.ndarray, east: np.ndarray, b_lat: np.ndarray, b_east: np.ndarray, b_mult: np.ndarray, radius_m: float, limit: float) -> np.ndarray:
    """Rows ``b_mult`` of the points b within the radius of each point; ``limit`` is the haversine term of the radius.

    The points b are cut into strips of latitude, sorted by longitude. Of a strip, longitudes up to an inner bound are surely within the radius and
    are counted by running sums, those beyond an outer bound are surely not; only what lies between is compared. Near a pole all is compared.
    """
    out = np.zeros(len(lat), dtype=np.int64)

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        s_lat = np.sin((np.radians(b_lat[j]) - np.radians(lat[i])) / 2.0)
        s_lon = np.sin((np.radians(b_east[j]) - np.radians(east[i])) / 2.0)
        a = s_lat * s_lat + np.cos(np.radians(lat[i])) * np.cos(np.radians(b_lat[j])) * (s_lon * s_lon)
        near = 2.0 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(a, 0.0, 1.0))) <= radius_m
        np.add.at(out, i[near], b_mult[j[near]])

    def compare_ranges(i: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        n = np.maximum(high - low, 0)
        ends = np.cumsum(n)
        at = 0
        while at < len(n):
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + COMPARED, side="right")))
            k = n[at:upto]
            compare(np.repeat(i[at:upto], k), np.arange(k.sum()) - np.repeat(ends[at:upto] - k - done, k) + np.repeat(low[at:upto], k))
            at = upto

    top = max(np.abs(lat).max(), np.abs(b_lat).max())
    if np.cos(np.radians(top)) <= 4.0 * math.sqrt(limit) or limit >= 0.1:
        whole = np.full(len(lat), len(b_lat))
        compare_ranges(np.arange(len(lat)), np.zeros(len(lat), dtype=np.int64), whole)
        return out
    # Longitudes are counted from one of the points, so that no window ends at the 180th meridian.
    turned = lambda x: np.mod(x - east[0] + 180.0, 360.0)
    own, other = turned(east), turned(b_east)
    by_own = np.argsort(own, kind="stable")
    a_lat, a_lon, cos_a = lat[by_own], own[by_own], np.cos(np.radians(lat[by_own]))
    strips = max(1, int(math.sqrt(len(b_lat)) / 2))
    south, north = b_lat.min(), b_lat.max()
    strip = np.minimum(strips - 1, ((b_lat - south) / max(north - south, 1e-300) * strips).astype(np.int64))
    by_strip = np.lexsort((other, strip))
    b_lat, b_east, b_mult, other, strip = b_lat[by_strip], b_east[by_strip], b_mult[by_strip], other[by_strip], strip[by_strip]
    running = np.concatenate([[0], np.cumsum(b_mult)])
    starts = np.flatnonzero(np.concatenate([[True], strip[1:] != strip[:-1]]))
    found = np.zeros(len(lat), dtype=np.int64)
    held: list[tuple] = []

    def window(bound: float, gap: np.ndarray, cos: float) -> np.ndarray:
        """Longitude in degrees that is reached at a latitude ``gap`` away; negative: none."""
        rest = bound - np.sin(np.radians(gap) / 2.0) ** 2
        reach = np.degrees(2.0 * np.arcsin(np.sqrt(np.clip(rest / (cos_a * cos), 0.0, 1.0))))
        return np.where(rest < 0, -1.0, reach)

    for low, high in zip(starts, [*starts[1:], len(strip)]):
        lats, lons = b_lat[low:high], other[low:high]
        least, most = lats.min(), lats.max()
        nearest, farthest = (0.0 if least <= 0 <= most else min(abs(least), abs(most))), max(abs(least), abs(most))
        outer = window(limit * (1 + SLACK) + 1e-18, np.maximum(0.0, np.maximum(least - a_lat, a_lat - most)), math.cos(math.radians(farthest)))
        here = np.flatnonzero(outer >= 0)
        if not len(here):
            continue
        inner = window(limit * (1 - SLACK), np.maximum(np.abs(a_lat - least), np.abs(a_lat - most)), math.cos(math.radians(nearest)))[here] - SLACK
        outer, mid = outer[here] + SLACK, a_lon[here]
        first, last = np.searchsorted(lons, mid - outer, "left"), np.searchsorted(lons, mid + outer, "right")
        sure = inner > 0
        from_, upto = np.searchsorted(lons, mid - inner, "left"), np.searchsorted(lons, mid + inner, "right")
        from_, upto = np.where(sure, from_, last), np.where(sure, upto, last)
        found[here] += running[low + upto] - running[low + from_]
        held += [(here, low + first, low + from_), (here, low + upto, low + last)]
    if held:
        compare_ranges(by_own[np.concatenate([h[0] for h in held])], *[np.concatenate([h[k] for h in held]) for k in (1, 2)])
    out[by_own] += found
    return out


def _box_counts(pairs: DataFrame, left: DataFrame, right: DataFrame, level: int, radius_m: float) -> DataFrame:
    """Rows near each left coordinate in pairs of boxes that a task can hold: (latitude, longitude, found), in parts.

    A left box meets its right boxes in one group, or in several of about NEAR_COORDS coordinates.
    """
    own, other = ["a_band", "a_col", "a_sub"], ["b_band", "b_col", "b_sub"]
    before = Window.partitionBy(*own).orderBy(*other).rowsBetween(Window.unboundedPreceding, -1)
    dealt = pairs.select(
        *own, *other, F.floor(F.coalesce(F.sum("b_coords").over(before), F.lit(0)) / NEAR_COORDS).alias("part")
    )

    def packed(points: DataFrame, prefix: str, keys: list[str], wanted: DataFrame) -> DataFrame:
        named = points.select(
            F.col("band").alias(f"{prefix}band"), F.col("col").alias(f"{prefix}col"), sub_key(level).alias(f"{prefix}sub"), "latitude", "longitude", "mult"
        ).join(wanted.select(*keys).distinct(), keys, "left_semi")
        p = F.col("p")
        return named.groupBy(*keys).agg(F.collect_list(F.struct("latitude", "longitude", "mult")).alias("p")).select(
            *keys, p["latitude"].alias("lats"), p["longitude"].alias("lons"), p["mult"].alias("mults")
        )

    arrays, limit = ["lats", "lons", "mults"], radius_half_chord_sq(radius_m)
    a = dealt.select(*own, "part").distinct().join(packed(left, "a_", own, pairs), own).select(*own, "part", F.lit(True).alias("own"), *arrays)
    b = dealt.join(packed(right, "b_", other, pairs), other).select(*own, "part", F.lit(False).alias("own"), *arrays)

    def count(table: pa.Table) -> pa.Table:
        sides = [table.filter(pc.equal(table["own"], side)) for side in (True, False)]
        lat, lon, _, b_lat, b_lon, b_mult = [np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in t[c]]) for t in sides for c in arrays]
        found = _near_counts(lat, lon, b_lat, b_lon, b_mult, radius_m, limit)
        some = found > 0
        return pa.table({"latitude": lat[some], "longitude": lon[some], "found": found[some]})

    return a.unionByName(b).groupBy(*own, "part").applyInArrow(count, "latitude double, longitude double, found bigint")


def _search(left: DataFrame, right: DataFrame, grid: Grid, la: list[str], ra: list[str], inside, direct, cells: DataFrame, boxed=None):
    """Drive the level loop; ``inside``, ``direct`` and ``boxed``, if given, turn settled pairs into result parts."""
    limit = radius_half_chord_sq(grid.radius_m)
    lower, upper = _bounds()
    pairs = cells.join(_renamed(boxes(left, 0, la), "a_"), ["a_band", "a_col"]).join(
        _renamed(boxes(right, 0, ra), "b_"), ["b_band", "b_col"]
    )
    parts = []
    for level in range(MAX_LEVEL + 1):
        few = F.lit(True) if level == MAX_LEVEL else F.col("a_coords") * F.col("b_coords") <= DIRECT_PAIRS
        judged = materialize(
            pairs.withColumn("lower", lower).withColumn("upper", upper)
            .where(F.col("lower") <= limit * (1 + SLACK))
            .withColumn("settled", F.col("upper") <= limit * (1 - SLACK))
            .withColumn("few", few)
            .withColumn("boxed", ~few & (F.greatest("a_coords", "b_coords") <= BOX_COORDS) if boxed else F.lit(False))
        )
        parts.append(inside(judged.where("settled"), level))
        parts.append(direct(_point_pairs(judged.where("few AND NOT settled"), left, right, level, la, ra)))
        if boxed:
            parts.append(boxed(judged.where("boxed AND NOT settled"), level))
        rest = judged.where("NOT settled AND NOT few AND NOT boxed")
        if rest.isEmpty():
            break
        pairs = _split(rest, boxes(left, level + 1, la), boxes(right, level + 1, ra), level + 1, la, ra)
    return parts


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_points(df: DataFrame, grid: Grid, order: str = "incident_id") -> DataFrame:
    """One row per coordinate with its row count ``mult`` and lowest id ``first_id``, placed in cells."""
    return grid.place(
        df.groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("mult"), F.min(order).alias("first_id"))
    )


def counts_within(left: DataFrame, right: DataFrame, grid: Grid, at_least: int | None = None) -> DataFrame:
    """Rows of ``right`` (with multiplicity) within the radius of each coordinate of ``left``.

    Both inputs come from ``distinct_points``. The count includes the coordinate itself when it is
    part of ``right``. With ``at_least``, coordinates that cannot reach that count may be missing.
    """
    cell = ["band", "col"]
    key = ["latitude", "longitude"]

    def inside(pairs: DataFrame, level: int) -> DataFrame:
        per_box = pairs.groupBy("a_band", "a_col", "a_sub").agg(F.sum("b_rows").alias("found"))
        spots = left.select(*key, F.col("band").alias("a_band"), F.col("col").alias("a_col"), sub_key(level).alias("a_sub"))
        return skew_safe_join(spots, per_box, ["a_band", "a_col", "a_sub"]).select(*key, "found")

    def direct(points: DataFrame) -> DataFrame:
        return (
            points.where(_within(grid.radius_m))
            .groupBy(F.col("a_latitude").alias("latitude"), F.col("a_longitude").alias("longitude"))
            .agg(F.sum("b_mult").alias("found"))
        )

    def boxed(pairs: DataFrame, level: int) -> DataFrame:
        return _box_counts(pairs, left, right, level, grid.radius_m)

    pairs = _cell_pairs(left, right, grid, False, at_least)
    parts = _search(left, right, grid, cell, cell, inside, direct, pairs, boxed)
    return _union(parts).groupBy(*key).agg(F.sum("found").alias("found"))


def linked_entities(left: DataFrame, right: DataFrame, grid: Grid, la: list[str], ra: list[str], wanted: Column | None = None) -> DataFrame:
    """Distinct (a_*, b_*) entity pairs that have at least one coordinate pair within the radius.

    Entity keys must include ``band`` and ``col``; ``right`` should be the side with fewer cells.
    ``wanted`` is a condition on a_band, a_col, b_band, b_col.
    """
    keys = [*[f"a_{c}" for c in la], *[f"b_{c}" for c in ra]]

    def inside(pairs: DataFrame, level: int) -> DataFrame:
        return pairs.select(*keys)

    def direct(points: DataFrame) -> DataFrame:
        return points.where(_within(grid.radius_m)).select(*keys)

    pairs = _cell_pairs(left, right, grid, True, None)
    if wanted is not None:
        pairs = pairs.where(wanted)
    return _union(_search(left, right, grid, la, ra, inside, direct, pairs)).distinct()


def neighbour_counts(incidents: DataFrame, radius_m: float) -> DataFrame:
    """Other rows within ``radius_m`` of each coordinate: (latitude, longitude, rows_here, neighbours)."""
    grid = Grid(radius_m)
    points = materialize(distinct_points(incidents, grid))
    found = counts_within(points, points, grid)
    return materialize(found.join(points.select("latitude", "longitude", "mult"), ["latitude", "longitude"]).select(
        "latitude", "longitude", F.col("mult").alias("rows_here"), (F.col("found") - 1).alias("neighbours")
    ))
