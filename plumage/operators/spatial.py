"""Points near points and points in regions, by cells of a space-filling curve.

Points get a Morton (Z-order) code: the bits of the longitude and latitude cell interleaved, 26 each. A disc
or region is covered with ranges of codes; points and ranges meet in a range join: both sides are cut at the
borders of coarse cells ("buckets", prefixes of the code), hashed and sorted by bucket, compared with
``code BETWEEN lo AND hi``, and what passes is refined by the exact test. Covers never miss a point, so the
result is exact.

A crowded bucket is split by AQE's skew join (both sides are plain shuffles of the join key), since rows of
a bucket don't depend on each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumage.functions.geo import EARTH_KM, haversine_km
from plumage.session import broadcast_if_small, cut_lineage, spread

BITS = 26
#: Latitude beyond which the longitude cells get too narrow; each cap is one bucket.
CAP = 89.4
NORTH, SOUTH = -1, -2


def _spread(c: Column) -> Column:
    """The 26 low bits of a bigint moved to the even places."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def morton(x: Column, y: Column) -> Column:
    return _spread(x.cast("bigint")).bitwiseOR(F.shiftleft(_spread(y.cast("bigint")), 1))


def cell_x(lon: Column, bits: int = BITS) -> Column:
    n = 1 << bits
    return F.pmod(F.floor((lon + 180.0) / 360.0 * n), F.lit(n)).cast("bigint")


def cell_y(lat: Column, bits: int = BITS) -> Column:
    n = 1 << bits
    return F.least(F.greatest(F.floor((lat + 90.0) / 180.0 * n), F.lit(0)), F.lit(n - 1)).cast("bigint")


def near_pairs(points: DataFrame, key: str, lat: str, lon: str, metres: float, bucket_bits: int | None = None) -> DataFrame:
    """(key_a, key_b, metres), key_a < key_b: all pairs of points at most ``metres`` apart on the globe.

    ``points`` has one row per key; rows with a null key or coordinate or a latitude beyond the poles have
    no partner, longitudes are taken modulo 360. Equal points under two keys are a pair at distance 0; a key
    that stands on several rows gives the pairs of each of its rows. Distances are haversine. Other columns
    are dropped.
    """
    lat_deg = math.degrees(metres / 1000 / EARTH_KM) * (1 + 1e-9) + 1e-9
    if bucket_bits is None:  # the finest cell that is still higher than the disc
        bucket_bits = max(1, min(22, math.floor(math.log2(180 / (2 * lat_deg)))))
    fine = BITS - bucket_bits
    p = points.select(F.col(key).alias("k"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).where("k IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon IS NOT NULL AND NOT isnan(lon)")
    x, y = cell_x(F.col("lon")), cell_y(F.col("lat"))
    cap = F.when(F.col("lat") >= CAP, NORTH).when(F.col("lat") <= -CAP, SOUTH)
    coded = p.withColumn("code", morton(x, y)).withColumn("bucket", F.coalesce(cap, F.shiftright("code", 2 * fine)))

    # the disc's box in fine cells; boxes are widest at the latitude nearest a pole
    far_lat = F.least(F.abs(F.col("lat")) + lat_deg, F.lit(CAP))
    half = F.least(F.lit(180.0 - 1e-6), F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(lat_deg))) / F.cos(F.radians(far_lat))))) * (1 + 1e-9) + 1e-9)
    n = 1 << BITS
    disc = p.select(
        "k", "lat", "lon",
        F.floor((F.col("lon") + 180.0 - half) / 360.0 * n).cast("bigint").alias("x0"), F.floor((F.col("lon") + 180.0 + half) / 360.0 * n).cast("bigint").alias("x1"),
        cell_y(F.col("lat") - lat_deg).alias("y0"), cell_y(F.col("lat") + lat_deg).alias("y1"),
    )
    by_x = disc.where(F.abs("lat") - lat_deg <= CAP).withColumn("bx", F.explode(F.sequence(F.shiftright("x0", fine), F.shiftright("x1", fine))))
    by_xy = by_x.withColumn("by", F.explode(F.sequence(F.shiftright("y0", fine), F.shiftright("y1", fine))))
    clip = lambda lo, b, hi: (F.greatest(F.col(lo), F.shiftleft(b, fine)), F.least(F.col(hi), F.shiftleft(b, fine) + ((1 << fine) - 1)))
    xa, xb = clip("x0", "bx", "x1")
    ya, yb = clip("y0", "by", "y1")
    wrap = lambda c: F.pmod(c, F.lit(n))
    ranges = by_xy.select(
        F.col("k").alias("ka"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"),
        F.shiftright(morton(wrap(xa), ya), 2 * fine).alias("bucket"), morton(wrap(xa), ya).alias("lo"), morton(wrap(xb), yb).alias("hi"),
    )
    caps = p.where(F.abs("lat") + lat_deg >= CAP).select(
        F.col("k").alias("ka"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"),
        F.when(F.col("lat") > 0, NORTH).otherwise(SOUTH).cast("bigint").alias("bucket"), F.lit(0).cast("bigint").alias("lo"), F.lit(2**62).alias("hi"),
    )
    dist = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat"), F.col("lon")) * 1000
    met = ranges.unionByName(caps).join(coded, "bucket").where((F.col("ka") < F.col("k")) & F.col("code").between(F.col("lo"), F.col("hi")))
    return met.select(F.col("ka").alias("key_a"), F.col("k").alias("key_b"), dist.alias("metres")).where(F.col("metres") <= metres)


# ---- regions ---------------------------------------------------------------------------------------


def _edges(rings) -> np.ndarray:
    """(n, 4): x1, y1, x2, y2 of all ring edges, rings closed; broken points are skipped."""
    out = []
    for ring in rings if rings is not None else []:
        pts = [(float(q[0]), float(q[1])) for q in (ring if ring is not None else []) if q is not None and len(q) >= 2 and q[0] is not None and q[1] is not None]
        if len(pts) >= 3:
            out += [(*a, *b) for a, b in zip(pts, pts[1:] + pts[:1]) if a != b]
    return np.array(out, float).reshape(-1, 4)


def _odd(edges: np.ndarray, x: float, y: float) -> bool:
    x1, y1, x2, y2 = edges.T
    up = (y1 > y) != (y2 > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = x1 + (y - y1) * (x2 - x1) / (y2 - y1)
    return bool(np.count_nonzero(up & (x < at)) % 2)


def _touching(edges: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Edges that may meet the box: their boxes overlap and the corners aren't all on one side of them."""
    ax, ay, bx, by = edges.T
    near = (np.maximum(ax, bx) >= x0) & (np.minimum(ax, bx) <= x1) & (np.maximum(ay, by) >= y0) & (np.minimum(ay, by) <= y1)
    e = edges[near]
    ax, ay, bx, by = e.T
    side = [(bx - ax) * (cy - ay) - (by - ay) * (cx - ax) for cx in (x0, x1) for cy in (y0, y1)]
    s = np.array(side).reshape(4, -1)
    return e[~((s > 0).all(0) | (s < 0).all(0))]


def cover_region(rings, max_level: int = 12, splits: int = 6) -> list[tuple[int, int, float, bool]]:
    """(lo, hi, shift, inside): ranges of codes that cover a region, inclusive.

    Cells are quartered from the globe down to ``splits`` levels below the smallest cell that is as wide as
    the region, at most ``max_level``. ``inside`` tells that the whole range lies in the region; ``shift`` is
    what to add to a point's longitude to compare it with the rings, which may run past 180.
    """
    edges = _edges(rings)
    if not len(edges):
        return []
    out: list[tuple[int, int, float, bool]] = []
    wide = max(edges[:, [0, 2]].max() - edges[:, [0, 2]].min(), 2 * (edges[:, [1, 3]].max() - edges[:, [1, 3]].min()), 1e-4)
    deepest = max(1, min(max_level, math.floor(math.log2(360 / wide)) + splits))
    pad = 1e-9
    first = math.floor((edges[:, [0, 2]].min() + 180) / 360)
    last = math.floor((edges[:, [0, 2]].max() + 180) / 360)
    for turn in range(first, last + 1):
        shift = 360.0 * turn
        stack = [(0, 0, 0, edges)]
        while stack:
            level, cx, cy, near = stack.pop()
            w, h = 360 / (1 << level), 180 / (1 << level)
            x0, y0 = -180 + cx * w + shift, -90 + cy * h
            near = _touching(near, x0 - pad, y0 - pad, x0 + w + pad, y0 + h + pad)
            if not len(near):
                if not _odd(edges, x0 + w / 2, y0 + h / 2):
                    continue
                inside = True
            elif level < deepest:
                stack += [(level + 1, 2 * cx + i, 2 * cy + j, near) for i in (0, 1) for j in (0, 1)]
                continue
            else:
                inside = False
            z = 0
            for b in range(level):
                z |= ((cx >> b) & 1) << (2 * b) | ((cy >> b) & 1) << (2 * b + 1)
            out.append((z << 2 * (BITS - level), ((z + 1) << 2 * (BITS - level)) - 1, shift, inside))
    out.sort()
    merged: list[tuple[int, int, float, bool]] = []
    for r in out:
        if merged and merged[-1][1] + 1 == r[0] and merged[-1][2:] == r[2:]:
            merged[-1] = (merged[-1][0], r[1], *r[2:])
        else:
            merged.append(r)
    return merged


def _covers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        rows = [(k, *r) for k, rings in zip(b["rk"].to_pylist(), b["rings"].to_pylist()) for r in cover_region(rings)]
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], b["rk"].type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.bool_())],
            names=["rk", "lo", "hi", "shift", "inside"],
        )


def _flat_edges(rings: Column) -> Column:
    """array<struct<x1,y1,x2,y2>> of closed rings."""
    good = lambda r: F.filter(F.coalesce(r, F.array()), lambda q: q.isNotNull() & (F.size(q) >= 2) & F.get(q, F.lit(0)).isNotNull() & F.get(q, F.lit(1)).isNotNull())

    def ring(r: Column) -> Column:
        return F.zip_with(r, F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1)), lambda a, b: F.struct(F.get(a, F.lit(0)).alias("x1"), F.get(a, F.lit(1)).alias("y1"), F.get(b, F.lit(0)).alias("x2"), F.get(b, F.lit(1)).alias("y2")))

    return F.flatten(F.transform(F.filter(F.transform(rings, good), lambda r: F.size(r) >= 3), ring))


def points_in_regions(points: DataFrame, key: str, lat: str, lon: str, regions: DataFrame, region: str, rings: str, bucket_bits: int = 9, broadcast_rows: int = 200_000) -> DataFrame:
    """(key, region): each region that contains each point.

    Rings are arrays of (lon, lat), open or closed, in either direction; a point is inside where it lies in
    an odd number of them, so holes are cut out. Edges are straight in degrees and longitudes may run past
    180. A ring of fewer than three points, null rings and points with a null or impossible coordinate
    contain nothing and lie in nothing. Regions may overlap. The cover table is broadcast only where it is
    counted to be at most ``broadcast_rows`` rows.
    """
    rk = regions.schema[region].dataType
    reg = regions.select(F.col(region).alias("rk"), F.col(rings).alias("rings")).where("rk IS NOT NULL AND rings IS NOT NULL")
    fine = 2 * (BITS - bucket_bits)
    # made once, regions spread over the cores
    cover = cut_lineage(spread(reg).mapInArrow(_covers, f"rk {rk.simpleString()}, lo bigint, hi bigint, shift double, inside boolean"))
    cover = cover.withColumn("bucket", F.explode(F.sequence(F.shiftright("lo", fine), F.shiftright("hi", fine))))
    p = points.select(F.col(key).alias("pk"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).where("pk IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon IS NOT NULL AND NOT isnan(lon)")
    p = p.withColumn("lon", F.col("lon") - 360.0 * F.floor((F.col("lon") + 180.0) / 360.0))
    p = p.withColumn("code", morton(cell_x(F.col("lon")), cell_y(F.col("lat")))).withColumn("bucket", F.shiftright("code", fine))
    met = p.join(broadcast_if_small(cover, broadcast_rows), "bucket").where(F.col("code").between(F.col("lo"), F.col("hi")))
    sure = met.where("inside").select("pk", "rk")
    edges = reg.select("rk", _flat_edges(F.col("rings")).alias("edges"))
    x, y = F.col("lon") + F.col("shift"), F.col("lat")
    crossings = F.size(F.filter("edges", lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)))))
    close = met.where("NOT inside").join(broadcast_if_small(edges, broadcast_rows // 100), "rk").where(crossings % 2 == 1).select("pk", "rk")
    return sure.unionByName(close).select(F.col("pk").alias(key), F.col("rk").alias(region))
