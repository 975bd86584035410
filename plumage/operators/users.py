"""Whose tweets are from the country: rules over place, point, location and description, and id sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumage.functions.text import first_contained, lower0

# Terms of locations and words for inhabitants, in order of precedence.
LOCATION_TERMS = [
    "canada", "ca.", "ontario", "quebec", "nova scotia", "new brunswick", "manitoba", "british colombia", "prince edward island", "saskatchewan", "alberta", "newfoundland and labrador", "northwest territories", "yukon",
    "qc.", "ns.", "n.s.", "nb.", "n.b.", "b.c.", "pei.", "p.e.i.", "sk.", "ab.", "nl.", "n.lv.",
    "toronto", "quebec city", "halifax", "fredericton", "winnipeg", "charlottetown", "regina", "edmonton", "st. john’s", "montreal", "vancouver", "saskatoon", "calgary", "ottawa", "gatineau", "hamilton", "kitchener", "oshawa", "windsor", "kelowna", "abbotsford", "red deer", "lethbridge", "thunder bay", "fort mcmurray", "medicine hat", "belleville", "drummondville", "kamloops", "sudbury", "niagara", "yellowknife",
    "treaty 3", "treaty 4", "treaty 5", "treaty 6", "treaty 7", "treaty 8", "treaty 9", "treaty 10", "treaty 11",
    "yyc", "yeg", "yqx", "yqm", "yhz", "yhm", "yxu", "yul", "yow", "yqb", "yqr", "yxe", "yyt", "yyz", "yvr", "yyj", "ywg", "🇨🇦", "algonquin territory", "amiskwacîwâskahikan", "true north strong and free",
]
DEMONYMS = ["canadian", "albertan", "british colombian", "newfoundlander", "torontonian", "ontarian", "manitoban", "saskatchewanian", "quebecois", "quebecer", "northwest territorian", "yukoner", "prince edward islander", "new brunswicker", "🇨🇦"]
#: A gazetteer is held in memory by every task; more entries than this are refused.
MAX_GAZETTEER = 200_000


def _unit(lat: np.ndarray, lon: np.ndarray) -> list[np.ndarray]:
    lat, lon = np.radians(lat), np.radians(lon)
    return [np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)]


def nearest_entry(lat: Column, lon: Column, gazetteer: DataFrame, value: str, order: str) -> Column:
    """The value of the gazetteer entry (columns lat, lon) nearest to a point; ties go to the smaller ``order``.

    On the sphere the nearest point is the one whose direction has the greatest product with the point's, so
    whole Arrow batches of points meet all entries as arrays; points aren't shuffled or joined. The gazetteer's
    size is checked. A null or missing coordinate gives null.
    """
    rows = gazetteer.where("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon", value, order).orderBy(order).limit(MAX_GAZETTEER + 1).collect()
    if len(rows) > MAX_GAZETTEER:
        raise ValueError(f"gazetteer of more than {MAX_GAZETTEER} entries")
    kind = gazetteer.schema[value].dataType
    if not rows:
        return F.lit(None).cast(kind)
    entries = _unit(np.array([r["lat"] for r in rows]), np.array([r["lon"] for r in rows]))

    @F.pandas_udf("int")
    def nearest(lat: pd.Series, lon: pd.Series) -> pd.Series:
        x, y = lat.to_numpy("float64", na_value=np.nan), lon.to_numpy("float64", na_value=np.nan)
        out = pd.Series(np.full(len(x), -1), dtype="Int32")
        known = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        step = max(1, 2_000_000 // len(rows))
        for a in range(0, len(known), step):
            at = known[a : a + step]
            p = [v[:, None] for v in _unit(x[at], y[at])]
            out.iloc[at] = (p[0] * entries[0] + p[1] * entries[1] + p[2] * entries[2]).argmax(1)
        return out

    values = F.array(*[F.lit(r[value]).cast(kind) for r in rows])
    at = nearest(lat, lon)
    return F.when(at >= 0, F.get(values, at))


def _point(col: str) -> tuple[Column, Column]:
    """Latitude and longitude of a tweet's point, null if it has none."""
    c = F.when(F.col(f"{col}.geo.type") == "Point", F.col(f"{col}.geo.coordinates"))
    return F.get(c, F.lit(0)), F.get(c, F.lit(1))


def tag_country(tweets: DataFrame, gazetteer: DataFrame, col: str = "tweet_json", country: str = "CA", locations: list[str] = LOCATION_TERMS, demonyms: list[str] = DEMONYMS) -> DataFrame:
    """``tweets`` with is_canadian, method, evidence, country_code; the first rule that speaks decides.

    (1) the place's country; (2) the country nearest to a point; (3) a location term inside the profile's
    location; (4) a word for inhabitants inside its description. If none speaks the verdict is null, not
    false. Null profile fields count as empty. Evidence is the first term in list order. Each rule is worked out
    once a row, and the dear ones only where no earlier one speaks.
    """
    place, point = F.col(f"{col}.place.country_code"), F.col(f"{col}.geo.type") == "Point"
    open_ = place.isNull() & ~F.coalesce(point, F.lit(False))
    lat, lon = _point(col)
    t = tweets.withColumn("_near", nearest_entry(F.when(place.isNull(), lat), lon, gazetteer, "country_code", "place_id"))
    t = t.withColumn("_loc", F.when(open_, first_contained(lower0(F.col(f"{col}.user.location")), locations)))
    t = t.withColumn("_dem", F.when(open_ & F.col("_loc").isNull(), first_contained(lower0(F.col(f"{col}.user.description")), demonyms)))
    near, loc, dem = F.col("_near"), F.col("_loc"), F.col("_dem")
    pick = lambda p, g, l, d: F.when(place.isNotNull(), p).when(point, g).when(loc.isNotNull(), l).when(dem.isNotNull(), d)
    return t.select(
        *[F.col(f"`{c}`") for c in tweets.columns],
        pick(place == country, near == country, F.lit(True), F.lit(True)).alias("is_canadian"),
        pick(F.lit("place object"), F.lit("coordinates"), F.lit("user profile location"), F.lit("user profile description")).alias("method"),
        pick(place, near, loc, dem).alias("evidence"),
        pick(place, near, F.lit(None), F.lit(None)).alias("country_code"),
    )


def in_country(tweets: DataFrame, gazetteer: DataFrame, col: str = "tweet_json", country: str = "CA") -> DataFrame:
    """Tweets whose place or whose point is in the country; a foreign place doesn't veto a point."""
    by_place = F.coalesce(F.col(f"{col}.place.country_code") == country, F.lit(False))
    lat, lon = _point(col)
    near = nearest_entry(F.when(~by_place, lat), lon, gazetteer, "country_code", "place_id")
    return tweets.where(by_place | F.coalesce(near == country, F.lit(False)))


def by_authors(tweets: DataFrame, users: DataFrame, user: str = "user_id", col: str = "tweet_json", include_mentions: bool = False, row: str = "delivery_id") -> DataFrame:
    """Tweets by users of a set, or also those that mention one; each row once. ``row`` identifies a row.

    The set is a semi join, so Spark broadcasts it where it is small and shuffles it where it isn't.
    """
    ids = users.select(F.col(user).try_cast("bigint").alias("_u")).where("_u IS NOT NULL").distinct()
    if not include_mentions:
        return tweets.join(ids, F.col(f"{col}.user.id") == F.col("_u"), "left_semi")
    people = F.array_distinct(F.concat(F.array(F.col(f"{col}.user.id")), F.coalesce(F.transform(F.col(f"{col}.entities.user_mentions"), lambda m: F.coalesce(m["id"], m["id_str"].try_cast("bigint"))), F.array().cast("array<bigint>"))))
    hits = tweets.select(row, F.explode(people).alias("_u")).join(ids, "_u", "left_semi").select(row).distinct()
    return tweets.join(hits, row, "left_semi")
