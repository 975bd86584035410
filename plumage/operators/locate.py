"""Where users are: medoids of their points, homes, and graphs over which locations spread."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumage.functions.geo import distance_km, haversine_km, vincenty_km
from plumage.session import cut_lineage


def medoid(points: DataFrame, group: str, order: str, lat: str = "lat", lon: str = "lon", min_points: int = 1, method: str = "sphere", cells_from: int = 400) -> DataFrame:
    """(group, lat, lon): of each group the point with the least sum of distances to all its points.

    Equal points are merged with a weight first, so pairs are those of *different* points of a group. Groups
    of more than ``cells_from`` different points are thinned exactly before pairs are made: distances to cells
    (half a degree) bound every point's sum from below and above, and points whose least possible sum is above
    another's greatest possible one can't win. Ties go to the smallest ``order``. Groups of fewer than
    ``min_points`` points have no row; points with a null coordinate don't count.
    """
    p = points.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(lat).alias("lat"), F.col(lon).alias("lon")).where("g IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    d = p.groupBy("g", "lat", "lon").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("w"))
    size = d.groupBy("g").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("m")).where(F.col("n") >= min_points)
    d = d.join(size, "g")
    small = d.where(F.col("m") <= cells_from)
    large = d.where(F.col("m") > cells_from)
    cell = lambda c: F.floor(F.col(c) * 2)
    mid = lambda c: (cell(c) + 0.5) / 2
    # half the diagonal of a cell of half a degree is less than 39.5 km anywhere
    reach = 39.5
    cells = large.groupBy("g", mid("lat").alias("clat"), mid("lon").alias("clon")).agg(F.sum("w").alias("cw"))
    to_cell = haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    bound = large.join(cells, "g").groupBy("g", "lat", "lon", "o", "w", "n", "m").agg(F.sum(F.col("cw") * F.greatest(to_cell - reach, F.lit(0.0))).alias("least"), F.sum(F.col("cw") * (to_cell + reach)).alias("most"))
    best = bound.groupBy("g").agg(F.min("most").alias("cap"))
    kept = bound.join(best, "g").where("least <= cap").select("g", "lat", "lon", "o", "w", "n", "m")
    tried = small.select("g", "lat", "lon", "o").unionByName(kept.select("g", "lat", "lon", "o"))
    others = d.select("g", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "w")
    dist = distance_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"), method)
    total = tried.join(others, "g").groupBy("g", "lat", "lon", "o").agg(F.round(F.sum(F.col("w") * dist), 6).alias("s"))
    out = total.groupBy("g").agg(F.min_by(F.struct("lat", "lon"), F.struct("s", "o")).alias("m"))
    return out.select(F.col("g").alias(group), F.col("m.lat").alias(lat), F.col("m.lon").alias(lon))


def has_clique(points: list[tuple[float, float]], k: int, km: float) -> bool:
    """Whether ``k`` of the points are pairwise at most ``km`` apart.

    Only points of nearby latitudes are measured, as arrays. A distance that the formula doesn't give counts as 0.
    """
    if k <= 1:
        return len(points) >= k
    lat, lon = (np.array(v, float) for v in zip(*sorted(points))) if points else (np.empty(0), np.empty(0))
    last = np.searchsorted(lat, lat + km / 110.0, side="right")  # a degree is more than 110 km
    near: list[set[int]] = [set() for _ in lat]
    for i in range(len(lat)):
        j = np.arange(i + 1, last[i])
        d = np.nan_to_num(vincenty_km(lat[i], lon[i], lat[j], lon[j]), nan=0.0)
        for x in j[d <= km].tolist():
            near[i].add(x)
            near[x].add(i)

    def grow(chosen: int, open_: set[int]) -> bool:
        if chosen == k:
            return True
        if chosen + len(open_) < k:
            return False
        for i in sorted(open_):
            if grow(chosen + 1, {j for j in open_ & near[i] if j > i}):
                return True
        return False

    return grow(0, set(range(len(points))))


def homes(points: DataFrame, group: str, order: str, k: int = 5, km: float = 15.0) -> DataFrame:
    """(group, lat, lon): the medoid of groups in which ``k`` points are pairwise within ``km``.

    Where ``k`` points share a cell whose diagonal is under ``km`` that is clear without a search; only the
    other groups, which have fewer than ``k`` points in every cell, are searched.
    """
    p = points.select(F.col(group).alias("g"), F.col("lat"), F.col("lon")).where("g IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    step = km / 1.5 / 111.2  # degrees: side of a cell, its diagonal is under km
    cells = p.groupBy("g", F.floor(F.col("lat") / step).alias("a"), F.floor(F.col("lon") / step).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    clear = cells.groupBy("g").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    sure = clear.where(F.col("most") >= k).select("g")
    unsure = p.join(clear.where((F.col("most") < k) & (F.col("all") >= k)).select("g"), "g")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ok = has_clique(list(zip(pdf["lat"].tolist(), pdf["lon"].tolist())), k, km)
        return pdf[["g"]].head(1) if ok else pdf[["g"]].head(0)

    gt = points.schema[group].dataType.simpleString()
    found = sure.unionByName(unsure.groupBy("g").applyInPandas(search, f"g {gt}"))
    return medoid(points.join(found.withColumnRenamed("g", group), group, "left_semi"), group, order)


# ---- graphs ----------------------------------------------------------------------------------------


def mention_edges(tweets: DataFrame, col: str = "tweet_json") -> DataFrame:
    """(src, dst, weight): how often a user mentions another; a retweet's mention of its own author doesn't count."""
    t = tweets.select(F.col(f"{col}.user.id").cast("string").alias("src"), F.col(f"{col}.retweeted_status").isNotNull().alias("rt"), F.explode(f"{col}.entities.user_mentions").alias("m"))
    dst = F.coalesce(F.col("m.id").cast("string"), F.col("m.id_str"))
    e = t.select("src", dst.alias("dst"), "rt").where("src IS NOT NULL AND dst IS NOT NULL AND NOT (rt AND src = dst)")
    return e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def follow_edges(follows: DataFrame) -> DataFrame:
    """(src, dst, weight): out-edges to friends, in-edges from followers; null lists have none."""
    user = F.col("id").cast("string")
    out = follows.select(user.alias("src"), F.explode(F.col("friends").cast("array<string>")).alias("dst"))
    into = follows.select(F.explode(F.col("followers").cast("array<string>")).alias("src"), user.alias("dst"))
    return out.unionByName(into).where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def reciprocal(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is an edge too, without loops. Vertices without edges are thereby gone."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.where("src != dst").join(back, ["src", "dst"], "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(vertex, out_degree, in_degree, weight_out)."""
    o = edges.groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("out_degree"), F.sum("weight").alias("weight_out"))
    i = edges.groupBy(F.col("dst").alias("vertex")).agg(F.count(F.lit(1)).alias("in_degree"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return o.join(i, "vertex", "full").select("vertex", z("out_degree"), z("in_degree"), z("weight_out"))


def spread_locations(edges: DataFrame, seeds: DataFrame, rounds: int = 4) -> DataFrame:
    """(user_id, lat, lon, round): locations spread over a graph by medoids of neighbours.

    Every round re-estimates each vertex that isn't a seed and has a neighbour located in the round before
    (all at once), from the neighbours' locations, each once whatever the weight. Seeds stay, also those
    outside of the graph. ``round`` is the one in which a user was first located, 0 for seeds. Seeds with a
    null coordinate are none; of several rows of a seed the one with the greatest values holds.
    """
    s = seeds.where("user_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").groupBy("user_id").agg(F.max(F.struct("lat", "lon")).alias("m")).select("user_id", "m.lat", "m.lon")
    e = cut_lineage(edges.select("src", "dst").distinct())
    seeds0 = s.withColumn("round", F.lit(0))
    now = cut_lineage(seeds0)
    for r in range(1, rounds + 1):
        near = e.join(now.select(F.col("user_id").alias("dst"), "lat", "lon"), "dst").join(s.select(F.col("user_id").alias("src")), "src", "left_anti")
        est = medoid(near, "src", "dst").withColumnRenamed("src", "user_id")
        first = est.join(now.select("user_id", "round"), "user_id", "left").select("user_id", "lat", "lon", F.coalesce("round", F.lit(r)).alias("round"))
        now = cut_lineage(seeds0.unionByName(first))
    return now


def coverage(located: DataFrame) -> DataFrame:
    """(round, new_users, located_users)."""
    n = located.groupBy("round").agg(F.count(F.lit(1)).alias("new_users"))
    return n.withColumn("located_users", F.sum("new_users").over(W.orderBy("round").rowsBetween(W.unboundedPreceding, 0)))  # one row a round


def lookup(users: DataFrame, located: DataFrame, user: str = "user_id") -> DataFrame:
    """``users`` with lat and lon of the model, null where unknown."""
    return users.join(located.select(F.col("user_id").alias(user), "lat", "lon"), user, "left")


def within(limit_km: float, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) <= limit_km
