"""Folds, samples and splits. All chance is a hash of the row's key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shuffled(key: Column, seed: str = "0") -> Column:
    """A sort key that shuffles rows: the md5 of key and seed."""
    return F.md5(F.concat(key.cast("string"), F.lit("#" + seed)))


def numbered(df: DataFrame, key: str, seed: str = "0", name: str = "i", group: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``, the 0-based row number in shuffled order (within its group), without bringing all
    rows, or all of a group, to one task.

    Rows are numbered inside ranges of the hash's first three digits (4096 of about equal size); the counts of
    the ranges, a table of at most 4096 rows a group, give each its offset.
    """
    group = group or []
    h = df.withColumn("_h", shuffled(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 3))
    n = h.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    off = n.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*group, "_b").orderBy("_h", key)) - 1
    out = h.withColumn("_rn", inside)
    out = out.join(off if group else F.broadcast(off), [*group, "_b"])  # group keys aren't null
    return out.withColumn(name, (F.col("_before") + F.col("_rn")).cast("bigint")).drop("_h", "_b", "_rn", "_before")


def round_robin(i: Column, k: int) -> Column:
    return F.pmod(i, F.lit(k)).cast("int")


def even_split(i: Column, n: Column, k: int) -> Column:
    """Fold of row ``i`` of ``n``: slices from round(n/k*f) to round(n/k*(f+1)), rounding half to even."""
    d = n / F.lit(float(k))
    return F.aggregate(F.sequence(F.lit(1), F.lit(k - 1)) if k > 1 else F.array().cast("array<int>"), F.lit(0), lambda a, f: a + (i >= F.bround(d * f, 0)).cast("int"))


def floor_split(i: Column, n: Column, k: int) -> Column:
    """Fold of row ``i``: slices of floor(n/k), the last takes the remainder. ``k`` is at most ``n``."""
    return F.least(F.floor(i / F.floor(n / F.lit(k))), F.lit(k - 1)).cast("int")


def _fold(df: DataFrame, v: int, k: int, fold: str) -> None:
    if not 0 <= v < k:
        raise ValueError(f"the validation fold is one of 0 to {k - 1}")
    if fold not in df.columns:
        raise ValueError(f"the rows have no {fold!r} yet")


def training(df: DataFrame, v: int, k: int, fold: str = "fold") -> DataFrame:
    """The rows of all folds but ``v``; a row without a fold is in none."""
    _fold(df, v, k, fold)
    return df.where(F.col(fold) != v)


def validation(df: DataFrame, v: int, k: int, fold: str = "fold") -> DataFrame:
    """The rows of fold ``v``."""
    _fold(df, v, k, fold)
    return df.where(F.col(fold) == v)


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: str = "0") -> DataFrame:
    """``n`` rows of each group by hash order; Spark prunes to ``n`` per task before the shuffle."""
    w = W.partitionBy(group).orderBy(shuffled(F.col(key), seed), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def sample(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """``n`` rows by hash order."""
    return df.orderBy(shuffled(F.col(key), seed), key).limit(n)
