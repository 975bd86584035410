"""Queries over rater sheets, folds and samples."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from plumage.functions import text as X
from plumage.operators import annotate as A
from plumage.operators import folds as O
from plumage.operators.tweets import tweet_id
from plumage.plans.registry import Registry

reg = Registry()
R1, R2 = "rater_a", "rater_b"
SENTIMENTS = ["Pro-Mask", "Anti-Mask", "Neutral", "Unrelated", "Not Sure"]
LANGUAGES = ["English", "French", "English+French", "Multiple", "Other"]

_PAIRS = f"""p AS (SELECT a.file_name, a.row_idx, a.tweet_id AS t1, b.tweet_id AS t2, a.full_text AS x1, b.full_text AS x2, a.mask_sentiment AS m1, b.mask_sentiment AS m2, a.language AS l1, b.language AS l2
     FROM rated_tweets a JOIN rated_tweets b USING (file_name, row_idx) WHERE a.rater = '{R1}' AND b.rater = '{R2}'),
  f AS (SELECT *, CASE WHEN t1 IS NULL OR t2 IS NULL THEN 'skip' WHEN NOT coalesce(x1 = x2, false) AND NOT coalesce(t1 = t2, false) THEN 'abort'
     WHEN coalesce(m1, m2, l1, l2) IS NULL THEN CASE WHEN row_idx < 200 THEN 'blank both' ELSE 'skip' END
     WHEN NOT (coalesce(m1 = m2, false) AND coalesce(l1 = l2, false)) THEN CASE WHEN m1 IS NULL OR l1 IS NULL THEN 'blank 1' WHEN m2 IS NULL OR l2 IS NULL THEN 'blank 2' ELSE 'mismatch' END
     ELSE 'agree' END AS finding FROM p)"""


def _reviewed(read):
    return A.review(A.pair_raters(read("rated_tweets"), R1, R2))


def _resolved(read):
    """A sheet of resolutions: where the sentiments differ, the second rater's opinion; other mismatches are still open."""
    return A.pair_raters(read("rated_tweets"), R1, R2).where("mask_sentiment_1 <> mask_sentiment_2").select("file_name", "row_idx", F.col("mask_sentiment_2").alias("mask"), F.col("language_2").alias("lang"))


@reg.query("rater_zip_mismatch", f"WITH {_PAIRS} SELECT file_name, row_idx, m1, m2, l1, l2, finding FROM f")
def rater_zip_mismatch(read):
    c = {"mask_sentiment_1": "m1", "mask_sentiment_2": "m2", "language_1": "l1", "language_2": "l2"}
    return _reviewed(read).select("file_name", "row_idx", *[F.col(k).alias(v) for k, v in c.items()], "finding")


@reg.query(
    "blank_report",
    f"""WITH {_PAIRS} SELECT file_name, rater, string_agg((row_idx + 2)::VARCHAR, ',' ORDER BY row_idx) AS rows FROM (
        SELECT file_name, row_idx, unnest(CASE finding WHEN 'blank both' THEN [1, 2] WHEN 'blank 1' THEN [1] WHEN 'blank 2' THEN [2] END) AS rater FROM f) GROUP BY 1, 2""",
)
def blank_report(read):
    return A.blank_report(_reviewed(read))


@reg.query("new_mismatches", f"WITH {_PAIRS} SELECT file_name, row_idx FROM f WHERE finding = 'mismatch' AND NOT m1 <> m2")
def new_mismatches(read):
    return A.new_mismatches(_reviewed(read), _resolved(read)).select("file_name", "row_idx")


@reg.query(
    "consolidate",
    rf"""WITH {_PAIRS}, c AS (SELECT t1 AS tweet_id, x1 AS full_text, CASE WHEN finding = 'agree' THEN l1 ELSE l2 END AS language, CASE WHEN finding = 'agree' THEN m1 ELSE m2 END AS m, file_name
         FROM f WHERE finding = 'agree' OR finding = 'mismatch' AND m1 <> m2)
         SELECT tweet_id, md5(full_text) AS text_md5, CASE WHEN language = 'French' THEN 'Not Sure' ELSE m END AS mask_sentiment, language, file_name FROM c
         WHERE len(list_filter(string_split_regex(full_text, '[{X.WHITE}]+'), lambda x: x <> '')) >= 5""",
)
def consolidate(read):
    c = A.consolidate(_reviewed(read), _resolved(read))
    return c.select("tweet_id", F.md5("full_text").alias("text_md5"), "mask_sentiment", "language", "file_name")


@reg.query("override_label", "SELECT rating_id, CASE WHEN language = 'French' THEN 'Not Sure' ELSE mask_sentiment END AS label FROM rated_tweets")
def override_label(read):
    return read("rated_tweets").select("rating_id", F.when(F.col("language") == "French", "Not Sure").otherwise(F.col("mask_sentiment")).alias("label"))


@reg.query("route_source", "SELECT file_name, CASE WHEN contains(lower(file_name), 'general') THEN 'general' WHEN contains(lower(file_name), 'mask') THEN 'mask' END AS slice, count(*) AS n FROM rated_tweets GROUP BY 1, 2")
def route_source(read):
    return read("rated_tweets").groupBy("file_name").agg(F.count(F.lit(1)).alias("n")).select("file_name", A.route(F.col("file_name")).alias("slice"), "n")


@reg.query("completeness_filter", "SELECT rating_id FROM rated_tweets WHERE tweet_id <> '' AND full_text <> '' AND mask_sentiment <> '' AND language <> ''")
def completeness_filter(read):
    return read("rated_tweets").where("tweet_id <> '' AND full_text <> '' AND mask_sentiment <> '' AND language <> ''").select("rating_id")


_IN = lambda xs: "(" + ", ".join(f"('{x}')" for x in xs) + ")"
_CELLS = f"""cells AS (SELECT m.m AS mask_sentiment, l.l AS language, (SELECT count(*) FROM rated_tweets r WHERE r.mask_sentiment = m.m AND r.language = l.l) AS n
    FROM (VALUES {", ".join(f"('{x}')" for x in SENTIMENTS)}) m(m), (VALUES {", ".join(f"('{x}')" for x in LANGUAGES)}) l(l))"""


@reg.query("contingency", f"WITH {_CELLS} SELECT * FROM cells")
def contingency(read):
    return A.contingency(read("rated_tweets"), "mask_sentiment", "language", SENTIMENTS, LANGUAGES)


@reg.query(
    "contingency_margins",
    f"""WITH {_CELLS} SELECT CASE WHEN grouping(mask_sentiment) = 1 THEN 'Total' ELSE mask_sentiment END AS mask_sentiment, CASE WHEN grouping(language) = 1 THEN 'Total' ELSE language END AS language, sum(n)::BIGINT AS n
        FROM cells GROUP BY GROUPING SETS ((mask_sentiment, language), (mask_sentiment), (language), ())""",
)
def contingency_margins(read):
    return A.contingency_margins(contingency(read), "mask_sentiment", "language")


@reg.query("contingency_slices", "SELECT CASE WHEN contains(lower(file_name), 'general') THEN 'general' ELSE 'mask' END AS slice, mask_sentiment, language, count(*) AS n FROM rated_tweets GROUP BY 1, 2, 3")
def contingency_slices(read):
    return read("rated_tweets").groupBy(A.route(F.col("file_name")).alias("slice"), "mask_sentiment", "language").agg(F.count(F.lit(1)).alias("n"))


@reg.query(
    "fuzzy_id_repair",
    """WITH o AS (SELECT DISTINCT coalesce(tweet_json.id, try_cast(tweet_json.id_str AS BIGINT))::VARCHAR AS id, tweet_json.full_text AS x FROM tweets),
       j AS (SELECT r.rating_id, r.tweet_id, o.id, coalesce(r.full_text = o.x, false) AS same FROM rated_tweets r LEFT JOIN o ON left(o.id, greatest(length(o.id) - 4, 0)) = left(r.tweet_id, greatest(length(r.tweet_id) - 4, 0))),
       k AS (SELECT *, row_number() OVER (PARTITION BY rating_id ORDER BY same DESC, id DESC) AS n FROM j)
       SELECT k.rating_id, k.tweet_id, k.id AS found_id, (SELECT count(DISTINCT id) FROM j WHERE j.rating_id = k.rating_id AND same) AS n_exact FROM k WHERE n = 1""",
)
def fuzzy_id_repair(read):
    o = read("tweets").select(tweet_id().alias("tweet_id"), F.col("tweet_json.full_text").alias("full_text"))
    return A.repair_ids(read("rated_tweets"), o)


@reg.query("clean_ids", "SELECT rating_id, CASE WHEN regexp_full_match(trim(tweet_id), '[0-9]+') THEN trim(tweet_id) END AS clean_id FROM rated_tweets")
def clean_ids(read):
    from plumage.functions.text import clean_id

    return read("rated_tweets").select("rating_id", clean_id(F.col("tweet_id")).alias("clean_id"))


@reg.query("anti_split", "SELECT rating_id FROM rated_tweets WHERE tweet_id NOT IN (SELECT tweet_id FROM rated_tweets WHERE row_idx < 5 AND tweet_id IS NOT NULL) AND tweet_id IS NOT NULL")
def anti_split(read):
    """Training rows: those whose tweet isn't in the test set."""
    r = read("rated_tweets").where("tweet_id IS NOT NULL")
    return r.join(r.where("row_idx < 5").select("tweet_id").distinct(), "tweet_id", "left_anti").select("rating_id")


@reg.query("dedupe_rows", "SELECT mask_sentiment, count(*) AS n FROM (SELECT DISTINCT tweet_id, full_text, mask_sentiment, language FROM rated_tweets) GROUP BY 1")
def dedupe_rows(read):
    return read("rated_tweets").select("tweet_id", "full_text", "mask_sentiment", "language").distinct().groupBy("mask_sentiment").agg(F.count(F.lit(1)).alias("n"))


_NUM = "SELECT doc_id, source, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '#0'), doc_id) - 1 AS i, count(*) OVER () AS n FROM documents"


def _numbered(read):
    d = read("documents").select("doc_id", "source")
    return O.numbered(d, "doc_id").join(F.broadcast(d.agg(F.count(F.lit(1)).alias("n"))), F.lit(True))


@reg.query("folds_rr", f"SELECT doc_id, (i % 5)::INT AS fold FROM ({_NUM})")
def folds_rr(read):
    return O.numbered(read("documents").select("doc_id"), "doc_id").select("doc_id", O.round_robin(F.col("i"), 5).alias("fold"))


@reg.query("folds_split", f"SELECT doc_id, ((i >= round_even(n / 7.0, 0))::INT + (i >= round_even(n / 7.0 * 2, 0))::INT + (i >= round_even(n / 7.0 * 3, 0))::INT + (i >= round_even(n / 7.0 * 4, 0))::INT + (i >= round_even(n / 7.0 * 5, 0))::INT + (i >= round_even(n / 7.0 * 6, 0))::INT) AS fold FROM ({_NUM})")
def folds_split(read):
    return _numbered(read).select("doc_id", O.even_split(F.col("i"), F.col("n"), 7).alias("fold"))


@reg.query("folds_nb", f"SELECT doc_id, least(floor(i / floor(n / 7)), 6)::INT AS fold FROM ({_NUM})")
def folds_nb(read):
    return _numbered(read).select("doc_id", O.floor_split(F.col("i"), F.col("n"), 7).alias("fold"))


@reg.query("fold_train_counts", f"SELECT v.v AS validation, source, count(*) AS n FROM (SELECT source, (i % 5)::INT AS fold FROM ({_NUM})) f, (VALUES (0), (1), (2), (3), (4)) v(v) WHERE f.fold <> v.v GROUP BY 1, 2")
def fold_train_counts(read):
    """Rows by class outside of each fold; one count by fold, then totals less the fold's own."""
    f = O.numbered(read("documents").select("doc_id", "source"), "doc_id").withColumn("fold", O.round_robin(F.col("i"), 5))
    per = f.groupBy("source", "fold").agg(F.count(F.lit(1)).alias("c"))
    v = F.explode(F.sequence(F.lit(0), F.lit(4)))
    return per.withColumn("validation", v).where("fold <> validation").groupBy("validation", "source").agg(F.sum("c").alias("n"))


@reg.query("stratified_folds", "SELECT doc_id, ((row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '#0'), doc_id) - 1) % 5)::INT AS fold FROM documents")
def stratified_folds(read):
    d = O.numbered(read("documents").select("doc_id", "source"), "doc_id", group=["source"])
    return d.select("doc_id", O.round_robin(F.col("i"), 5).alias("fold"))


@reg.query("sample_per_source", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '#7'), doc_id) AS r FROM documents) WHERE r <= 20")
def sample_per_source(read):
    return O.sample_per_group(read("documents").select("doc_id", "source"), "source", "doc_id", 20, "7")


@reg.query("sample_global", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '#7'), doc_id LIMIT 100")
def sample_global(read):
    return O.sample(read("documents").select("doc_id"), "doc_id", 100, "7").select("doc_id")


@reg.query("fold_rows", f"SELECT v.v AS validation, doc_id, f.fold = v.v AS held_out FROM (SELECT doc_id, (i % 5)::INT AS fold FROM ({_NUM})) f, (VALUES (0), (1), (2), (3), (4)) v(v)")
def fold_rows(read):
    """The rows to train on and those held out, for each fold as validation."""
    f = _numbered(read).select("doc_id", O.round_robin(F.col("i"), 5).alias("fold"))
    parts = [d.select(F.lit(v).alias("validation"), "doc_id", F.lit(held).alias("held_out")) for v in range(5) for held, d in ((False, O.training(f, v, 5)), (True, O.validation(f, v, 5)))]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)
