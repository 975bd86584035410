"""Sizes of texts in tokens of the public WordPunct tokenizer, and running positions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Maximal runs of Unicode letters, digits and underscores, or of other characters that aren't white space.
WORDPUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"


def n_tokens(text: Column) -> Column:
    """Null for null, 0 for empty and blank texts; stays in the JVM."""
    return F.regexp_count(text, F.lit(WORDPUNCT))


def running_position(df: DataFrame, group: list[str], key: str, amount: Column, salts: int = 1024, name: str = "start") -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over the rows of its group that come before it.

    The order within a group is by a hash of ``key`` and then ``key``: fixed, and the same however the rows
    are spread. A group of any size is cut into ``salts`` ranges of that hash, which are summed first and
    then counted through on their own, so no task holds a whole group. Nulls in ``amount`` count as 0.
    """
    h = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30))
    salted = df.withColumn("_amount", F.coalesce(amount.cast("bigint"), F.lit(0).cast("bigint"))).withColumn("_hash", h)
    salted = salted.withColumn("_salt", F.floor(F.col("_hash") * salts / (1 << 30)).cast("int"))
    sums = salted.groupBy(*group, "_salt").agg(F.sum("_amount").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy(*group).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("bigint"))).drop("_sum")
    inner = W.partitionBy(*group, "_salt").orderBy("_hash", key).rowsBetween(W.unboundedPreceding, -1)
    counted = salted.withColumn("_inner", F.coalesce(F.sum("_amount").over(inner), F.lit(0).cast("bigint")))
    out = counted.join(before, [*group, "_salt"])
    return out.withColumn(name, F.col("_before") + F.col("_inner")).drop("_before", "_inner", "_hash", "_salt", "_amount")
