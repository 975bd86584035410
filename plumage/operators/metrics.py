"""Confusion matrix and the measures drawn from it; undefined ratios are null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage.session import cut_lineage


#: A confusion matrix has a cell for every pair of classes; of more classes it is refused.
MAX_CLASSES = 1_000


def _beside(df: DataFrame, one: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the columns of ``one``, which has one row for each ``by`` group, or one in all."""
    return df.join(one, by) if by else df.join(F.broadcast(one), F.lit(True))


def confusion(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., class, guess, n) for all pairs of the classes seen, zeros filled in. ``pred`` has class, guess."""
    by = by or []
    n = cut_lineage(pred.groupBy(*by, "class", "guess").agg(F.count(F.lit(1)).alias("n")))  # few rows: the guesses are made once
    rows = n.select(F.explode(F.array("class", "guess")).alias("c")).where("c IS NOT NULL").distinct().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    kind = pred.schema["class"].dataType
    every = F.array(*[F.lit(r["c"]) for r in sorted(rows)]).cast(f"array<{kind.simpleString()}>")
    groups = n.select(*by).distinct() if by else pred.sparkSession.range(1).select()
    cells = groups.select(*by, F.explode(every).alias("class")).select(*by, "class", F.explode(every).alias("guess"))
    return cells.join(n, [*by, "class", "guess"], "left").select(*by, "class", "guess", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def one_vs_rest(conf: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., class, tp, fp, fn, tn)."""
    by = by or []
    side = conf.select(*by, F.explode(F.array_distinct(F.array("class", "guess"))).alias("c"), "class", "guess", "n")
    s = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    part = side.groupBy(*by, "c").agg(
        s((F.col("class") == F.col("c")) & (F.col("guess") == F.col("c"))).alias("tp"), s((F.col("class") != F.col("c")) & (F.col("guess") == F.col("c"))).alias("fp"), s((F.col("class") == F.col("c")) & (F.col("guess") != F.col("c"))).alias("fn")
    )
    total = conf.groupBy(*by).agg(F.sum("n").alias("_n"))
    j = _beside(part, total, by)
    return j.select(*by, F.col("c").alias("class"), "tp", "fp", "fn", (F.col("_n") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))


def per_class(ovr: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., class, precision, recall, accuracy, f1)."""
    by = by or []
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    acc = F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return ovr.select(*by, "class", p.alias("precision"), r.alias("recall"), acc.alias("accuracy"), F.try_divide(2 * p * r, p + r).alias("f1"))


def macro(ovr: DataFrame, conf: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., precision, recall, f1, accuracy, pooled_accuracy).

    Undefined precision or recall counts as 0 and all classes divide; F1 is that of the macro values.
    ``accuracy`` is the share of right guesses, ``pooled_accuracy`` pools the one-versus-rest counts.
    """
    by = by or []
    c = per_class(ovr, by).groupBy(*by).agg(F.avg(F.coalesce("precision", F.lit(0.0))).alias("precision"), F.avg(F.coalesce("recall", F.lit(0.0))).alias("recall"))
    pooled = ovr.groupBy(*by).agg(F.try_divide(F.sum(F.col("tp") + F.col("tn")), F.sum(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).alias("pooled_accuracy"))
    acc = conf.groupBy(*by).agg(F.try_divide(F.sum(F.when(F.col("class") == F.col("guess"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    j = _beside(_beside(c, pooled, by), acc, by)
    return j.select(*by, "precision", "recall", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "accuracy", "pooled_accuracy")


def fold_average(df: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """Averages over folds; a null in any fold makes the average null."""
    return df.groupBy(*group).agg(*[F.when(F.count(v) == F.count(F.lit(1)), F.avg(v)).alias(v) for v in values])
