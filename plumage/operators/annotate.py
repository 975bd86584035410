"""Rater sheets: pairing by position, disagreements, blanks, consolidation, contingency, repair of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumage.functions.text import base_name, id_prefix, tokens


def differs(a: Column, b: Column) -> Column:
    """True unless both are filled and equal: two blanks disagree."""
    return ~F.coalesce(a == b, F.lit(False))


def pair_raters(sheets: DataFrame, first: str, second: str) -> DataFrame:
    """One row per file and position that both raters have: an inner join on (file_name, row_idx)."""
    cols = ["tweet_id", "full_text", "mask_sentiment", "language"]
    side = lambda r, s: sheets.where(F.col("rater") == r).select("file_name", "row_idx", *[F.col(c).alias(f"{c}_{s}") for c in cols])
    return side(first, "1").join(side(second, "2"), ["file_name", "row_idx"])


def review(pairs: DataFrame, complete_rows: int = 200) -> DataFrame:
    """``pairs`` with ``finding``: skip, abort, blank both, blank 1, blank 2, mismatch or agree; first that fits.

    Within the first ``complete_rows`` positions a pair without any rating is blank on both sides, later it is
    skipped. Two blanks in one column disagree.
    """
    m1, m2, l1, l2 = (F.col(c) for c in ("mask_sentiment_1", "mask_sentiment_2", "language_1", "language_2"))
    disagree = differs(m1, m2) | differs(l1, l2)
    return pairs.withColumn(
        "finding",
        F.when(F.col("tweet_id_1").isNull() | F.col("tweet_id_2").isNull(), "skip")
        .when(differs(F.col("full_text_1"), F.col("full_text_2")) & differs(F.col("tweet_id_1"), F.col("tweet_id_2")), "abort")
        .when(F.coalesce(m1, m2, l1, l2).isNull(), F.when(F.col("row_idx") < complete_rows, "blank both").otherwise("skip"))
        .when(disagree & (m1.isNull() | l1.isNull()), "blank 1")
        .when(disagree & (m2.isNull() | l2.isNull()), "blank 2")
        .when(disagree, "mismatch")
        .otherwise("agree"),
    )


def blank_report(reviewed: DataFrame) -> DataFrame:
    """(file_name, rater, rows): sheet rows (position + 2) with blanks, as an ascending list."""
    who = F.when(F.col("finding") == "blank both", F.array(F.lit(1), F.lit(2))).when(F.col("finding") == "blank 1", F.array(F.lit(1))).when(F.col("finding") == "blank 2", F.array(F.lit(2)))
    rows = reviewed.where(who.isNotNull()).select("file_name", F.explode(who).alias("rater"), (F.col("row_idx") + 2).alias("row"))
    return rows.groupBy("file_name", "rater").agg(F.array_join(F.array_sort(F.collect_list("row")), ",").alias("rows"))


def new_mismatches(reviewed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Mismatches whose (file_name, row_idx) isn't on the sheet of resolved ones."""
    return reviewed.where("finding = 'mismatch'").join(resolved.select("file_name", "row_idx").distinct(), ["file_name", "row_idx"], "left_anti")


def route(file_name: Column) -> Column:
    """The slice a file belongs to by its name; other names are an error."""
    name = F.lower(base_name(file_name))
    return F.when(F.contains(name, F.lit("general")), "general").when(F.contains(name, F.lit("mask")), "mask").otherwise(F.raise_error(F.concat(F.lit("no slice for "), file_name)).cast("string"))


def consolidate(reviewed: DataFrame, resolved: DataFrame, french: str = "French", unsure: str = "Not Sure", min_tokens: int = 5) -> DataFrame:
    """(tweet_id, full_text, mask_sentiment, language, file_name): agreed rows, and mismatches with their resolution.

    ``resolved`` has file_name, row_idx, mask, lang. Mismatches without a resolution, blanks and skipped rows
    are left out. Texts in French are unsure; texts of fewer than ``min_tokens`` tokens are dropped.
    """
    r = resolved.select("file_name", "row_idx", F.col("mask").alias("_m"), F.col("lang").alias("_l"))
    j = reviewed.where(F.col("finding").isin("agree", "mismatch")).join(r, ["file_name", "row_idx"], "left").where("finding = 'agree' OR _m IS NOT NULL AND _l IS NOT NULL")
    agreed = F.col("finding") == "agree"
    lang = F.when(agreed, F.col("language_1")).otherwise(F.col("_l"))
    mask = F.when(agreed, F.col("mask_sentiment_1")).otherwise(F.col("_m"))
    out = j.select(F.col("tweet_id_1").alias("tweet_id"), F.col("full_text_1").alias("full_text"), F.when(lang == french, unsure).otherwise(mask).alias("mask_sentiment"), lang.alias("language"), "file_name")
    return out.where(F.size(tokens(F.col("full_text"))) >= min_tokens)


def contingency(df: DataFrame, row: str, col: str, rows: list[str], cols: list[str]) -> DataFrame:
    """Counts of every (row, col) of fixed headers, zeros filled in; other values aren't counted."""
    n = df.where(F.col(row).isin(rows) & F.col(col).isin(cols)).groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    cells = spark.createDataFrame([(r, c) for r in rows for c in cols], f"{row} string, {col} string")  # the fixed headers
    return cells.join(n, [row, col], "left").select(row, col, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def contingency_margins(table: DataFrame, row: str, col: str) -> DataFrame:
    """The table with its margins and grand total, under the header ``Total``."""
    g = table.groupingSets([[row, col], [row], [col], []], row, col).agg(F.sum("n").alias("n"), F.grouping(row).alias("_r"), F.grouping(col).alias("_c"))
    name = lambda c, flag: F.when(F.col(flag) == 1, "Total").otherwise(F.col(c)).alias(c)
    return g.select(name(row, "_r"), name(col, "_c"), "n")


def repair_ids(ratings: DataFrame, originals: DataFrame, cut: int = 4) -> DataFrame:
    """(rating_id, tweet_id, found_id, n_exact): ids that lost their last digits, from the originals.

    Both sides meet on the id without its last ``cut`` digits. A hit with equal text is preferred, then the
    largest id; ``n_exact`` counts those with equal text. Ratings without any hit have a null ``found_id``.
    """
    o = originals.select(F.col("tweet_id").cast("string").alias("_id"), F.col("full_text").alias("_text")).distinct().withColumn("_p", id_prefix(F.col("_id"), cut))
    r = ratings.select("rating_id", "tweet_id", "full_text").withColumn("_p", id_prefix(F.col("tweet_id"), cut))
    same = F.coalesce(F.col("full_text") == F.col("_text"), F.lit(False))
    j = r.join(o, "_p", "left")
    return j.groupBy("rating_id", "tweet_id").agg(
        F.max_by("_id", F.when(F.col("_id").isNotNull(), F.struct(same.alias("a"), F.col("_id").alias("b")))).alias("found_id"), F.countDistinct(F.when(same, F.col("_id"))).alias("n_exact")
    )
