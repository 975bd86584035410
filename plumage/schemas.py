"""Explicit schemas of the collected files."""

from __future__ import annotations

from pyspark.sql import types as T

_POINT = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))])

TWEET = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("id_str", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("user", T.StructType([T.StructField("id", T.LongType()), T.StructField("description", T.StringType()), T.StructField("location", T.StringType())])),
        T.StructField(
            "place",
            T.StructType([T.StructField("country_code", T.StringType()), T.StructField("bounding_box", T.StructType([T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))]))]),
        ),
        T.StructField("geo", _POINT),
        T.StructField("coordinates", _POINT),
        T.StructField("entities", T.StructType([T.StructField("user_mentions", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("id_str", T.StringType())])))])),
        T.StructField("retweeted_status", T.StructType([T.StructField("id", T.LongType())])),
    ]
)
FOLLOW = T.StructType([T.StructField("id", T.LongType()), T.StructField("friends", T.ArrayType(T.LongType())), T.StructField("followers", T.ArrayType(T.LongType()))])
LOCATION = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
LABELLED = T.StructType([T.StructField(n, T.StringType()) for n in ("tweet_id", "full_text", "mask_sentiment", "language")])
RATING = T.StructType([T.StructField(n, T.StringType()) for n in ("tweet_id", "full_text", "mask_sentiment", "language", "tags", "notes")])
EDGE = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("weight", T.LongType())])
