"""The operators over streams. Stateless ones are applied as they are; here are those with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumage.operators.dedup import SeenRanges, producer_of, sequence_of
from plumage.operators.tweets import tweet_id


def first_deliveries(tweets: DataFrame, number: Column | None = None, block_bits: int = 22) -> DataFrame:
    """(number, delivery_id) of a stream, each number once, in whatever batch it comes again.

    The state of a block of a producer's sequences is its disjoint seen ranges. Which copy is kept is the first to
    arrive; within a micro-batch the smallest delivery id.
    """
    n = tweet_id() if number is None else number
    rows = tweets.select(n.alias("number"), "delivery_id").where("number IS NOT NULL").withColumn("producer", producer_of(F.col("number"))).withColumn("seq", sequence_of(F.col("number")))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = SeenRanges(*(pd.Series(x, dtype="int64").to_numpy() for x in state.get)) if state.exists else SeenRanges()
        pdf = pd.concat(list(batches)).sort_values("delivery_id", kind="stable")
        took = seen.accept(pdf["seq"].to_numpy("int64"))
        state.update((seen.lo.tolist(), seen.hi.tolist()))
        yield pdf.loc[took, ["number", "delivery_id"]]

    blocks = rows.withColumn("block", F.shiftright("seq", block_bits)).groupBy("producer", "block")
    return blocks.applyInPandasWithState(step, "number bigint, delivery_id bigint", "lo array<bigint>, hi array<bigint>", "append", GroupStateTimeout.NoTimeout)


def users_by_window(tagged: DataFrame, at: str = "received_at", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(window, method, n_tweets, n_users_approx) of a tagged stream, with a watermark for late deliveries."""
    t = tagged.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    w = F.window("_at", window)
    return t.groupBy(w.alias("window"), "method").agg(F.count(F.lit(1)).alias("n_tweets"), F.approx_count_distinct("user_id").alias("n_users_approx"))


def mention_weights(tweets: DataFrame) -> DataFrame:
    """Running (src, dst, weight) of a stream of tweets, for ``update`` or ``complete`` mode."""
    from plumage.operators.locate import mention_edges

    return mention_edges(tweets)
