"""Views of the delivered tweets that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumage.functions.geo import box_middle


def tweet_id(col: str = "tweet_json") -> Column:
    """``id``, or ``id_str`` as a number where that is null."""
    return F.coalesce(F.col(f"{col}.id"), F.col(f"{col}.id_str").try_cast("bigint"))


def _member(name: str):
    return lambda e: e[name]


def at_path(df: DataFrame, path: str) -> Column:
    """The value at a dotted path of nested columns; a step into a list takes the member of each of its elements.

    A null object or element gives null, a null list null. A step into anything but objects and a list of
    objects is an error, as is a missing member.
    """
    first, *steps = path.split(".")
    c, kind = F.col(f"`{first}`"), df.schema[first].dataType
    for step in steps:
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if not isinstance(inner, T.StructType) or step not in inner.names:
            raise ValueError(f"no member {step!r} on the way of {path!r}")
        if inner is kind:
            c, kind = c[step], inner[step].dataType
        else:
            c, kind = F.transform(c, _member(step)), T.ArrayType(inner[step].dataType)
    return c


def valid_geo(col: str = "tweet_json") -> Column:
    """struct<lat, lon> of ``geo``; null for (0, 0), latitudes beyond the poles and missing numbers."""
    c = F.col(f"{col}.geo.coordinates")
    lat, lon = F.get(c, F.lit(0)), F.get(c, F.lit(1))
    ok = (F.abs(lat) <= 90) & lon.isNotNull() & ~((lat == 0) & (lon == 0)) & ~F.isnan(lon)
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))


def tweet_points(tweets: DataFrame, col: str = "tweet_json") -> DataFrame:
    """(tweet_id, lat, lon, is_geo), one row per located tweet: its ``geo``, else the middle of its box.

    Tweets with neither are left out before anything is shuffled. Deliveries of a tweet have equal content.
    """
    geo = valid_geo(col)
    ring = F.get(F.col(f"{col}.place.bounding_box.coordinates"), F.lit(0))
    at = F.coalesce(geo, box_middle(ring))
    rows = tweets.select(tweet_id(col).alias("tweet_id"), at.alias("at"), geo.isNotNull().alias("is_geo")).where("tweet_id IS NOT NULL AND at IS NOT NULL")
    return rows.select("tweet_id", "at.lat", "at.lon", "is_geo").dropDuplicates(["tweet_id"])
