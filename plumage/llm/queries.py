"""Queries of the operators for training text: p2, p4, p6, p7, p8, p9 and p10."""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumage.llm.langid import fit_once, label_of, text_language, training_sample, with_segments
from plumage.llm.linkage import link
from plumage.llm.mixing import deviations, mix, shares
from plumage.llm.packing import pack_all
from plumage.llm.pii import redact
from plumage.llm.residue import residue_evidence
from plumage.llm.textform import alike_pairs, looks_alike, with_form
from plumage.llm.tokens import n_tokens
from plumage.operators.tweets import tweet_id
from plumage.plans.registry import Registry
from plumage.session import broadcast_if_small, cut_lineage

reg = Registry()


def tweet_rows(tweets: DataFrame) -> DataFrame:
    """(field, row_key, text): tweets' texts by tweet id and users' descriptions by user id, of every delivery."""
    t = F.struct(F.lit("full_text").alias("field"), tweet_id().alias("row_key"), F.col("tweet_json.full_text").alias("text"))
    d = F.struct(F.lit("description").alias("field"), F.col("tweet_json.user.id").alias("row_key"), F.col("tweet_json.user.description").alias("text"))
    return tweets.select(F.inline(F.array(t, d))).where("row_key IS NOT NULL AND text IS NOT NULL")


def tweet_texts(tweets: DataFrame) -> DataFrame:
    """The same, distinct: repeats, such as the profile of a busy user, are merged before the shuffle."""
    return tweet_rows(tweets).distinct()


@reg.query("p4_found")
def p4_found(read):
    """Texts are read where they lie, each once a batch; only what is found is shuffled."""
    return redact(tweet_rows(read("tweets")), "text").select("field", "row_key", F.explode("pii_kinds").alias("kind")).distinct()


@reg.query("p4_redacted")
def p4_redacted(read):
    """The texts themselves with placeholders."""
    return redact(tweet_texts(read("tweets")), "text").select("field", "row_key", "redacted", F.array_join("pii_kinds", ",").alias("kinds"))


@reg.query("p6_found")
def p6_found(read):
    return alike_pairs(tweet_rows(read("tweets")), "field", "row_key", "text")


@reg.query("p6_readable")
def p6_readable(read):
    """All texts in the readable form."""
    return with_form(tweet_texts(read("tweets")), "text", "text_form", "readable").select("field", "row_key", "text_form")


@reg.query("p10_found")
def p10_found(read):
    return residue_evidence(read("documents"), "doc_id", "text", "source").select("doc_id")


@reg.query("p10_reasons")
def p10_reasons(read):
    """How many documents are marked for which reason."""
    return residue_evidence(read("documents"), "doc_id", "text", "source").groupBy("reason").agg(F.count(F.lit(1)).alias("n_docs"))


def sized_documents(read) -> DataFrame:
    """Narrow and written once: the texts are read and counted a single time."""
    return cut_lineage(read("documents").select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens")))


def _capacities(read) -> list[int]:
    """The distinct capacities of the specifications, a fixed small table of two rows."""
    return sorted({r["capacity"] for r in read("pack_specs").collect()})


_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+'))"


@reg.query("p8_found", f"SELECT DISTINCT p.capacity, d.doc_id FROM (SELECT doc_id, {_TOKENS} AS n FROM documents) d JOIN pack_specs p ON d.n > p.capacity")
def p8_found(read):
    """Those that the packing itself cuts: documents that lie in several containers."""
    return p8_packed(read).where("piece = 1").select("capacity", "doc_id").distinct()


@reg.query("p8_packed")
def p8_packed(read):
    return pack_all(sized_documents(read), "doc_id", "n_tokens", _capacities(read))


@reg.query(
    "p8_fill",
    f"""WITH d AS (SELECT doc_id, {_TOKENS} AS n FROM documents)
        SELECT capacity, sum(n)::BIGINT AS tokens, sum(CASE WHEN n > 0 THEN ceil(n / capacity) ELSE 0 END)::BIGINT AS pieces, true AS none_over, true AS near_least
        FROM d, pack_specs GROUP BY capacity""",
)
def p8_fill(read):
    """How full the containers are: none over capacity, and at most 1 % and one more than their least number."""
    packed = p8_packed(read).groupBy("capacity", "container").agg(F.sum("length").alias("filled"), F.count(F.lit(1)).alias("n"))
    least = F.ceil(F.sum("filled") / F.first("capacity"))
    return packed.groupBy("capacity").agg(
        F.sum("filled").alias("tokens"), F.sum("n").alias("pieces"), (F.max("filled") <= F.first("capacity")).alias("none_over"), (F.count(F.lit(1)) <= 1.01 * least + 1).alias("near_least")
    )


def _mixes(read) -> dict[str, list[tuple[str, float, int]]]:
    """The mixes' targets, a fixed small table of ten rows."""
    out: dict[str, list[tuple[str, float, int]]] = {}
    for r in read("mix_targets").collect():
        out.setdefault(r["mix_name"], []).append((r["source"], r["target_share"], r["max_repeats"]))
    return out


@reg.query("p9_mixed")
def p9_mixed(read):
    """The schedule of every mix."""
    docs = sized_documents(read)
    out = [mix(docs, "doc_id", "source", "n_tokens", t).withColumn("mix_name", F.lit(m)) for m, t in sorted(_mixes(read).items())]
    return functools.reduce(DataFrame.unionByName, out).withColumnRenamed("key", "doc_id")


@reg.query("p9_shares")
def p9_shares(read):
    """The shares reached, by mix and source."""
    docs, targets = sized_documents(read), read("mix_targets")
    out = [shares(mix(docs, "doc_id", "source", "n_tokens", t), targets.where(F.col("mix_name") == m)).withColumn("mix_name", F.lit(m)) for m, t in sorted(_mixes(read).items())]
    return functools.reduce(DataFrame.unionByName, out)


@reg.query(
    "p9_deviation",
    f"""SELECT DISTINCT t.mix_name, t.source, true AS cap_kept, true AS within_block, true AS share_within_block FROM mix_targets t
        WHERE t.target_share > 0 AND t.max_repeats > 0 AND t.source IN (SELECT source FROM documents WHERE {_TOKENS} > 0)""",
)
def p9_deviation(read):
    """Of every mix and source: no document over its cap, never a block from the share at any point, nor at the end."""
    docs = sized_documents(read)
    one = lambda m, t: deviations(docs, "doc_id", "source", "n_tokens", t).withColumn("mix_name", F.lit(m)).withColumn("_all", F.sum("tokens").over(W.partitionBy("mix_name")))
    out = functools.reduce(DataFrame.unionByName, [one(m, t) for m, t in sorted(_mixes(read).items())])  # one row a source
    return out.select("mix_name", "source", "cap_kept", "within_block", (F.abs(F.col("tokens") - F.col("target") * F.col("_all")) < F.col("block")).alias("share_within_block"))


def _user_texts(read, field: str) -> DataFrame:
    """(user_id, text), distinct: a busy user's repeats are merged before the shuffle."""
    t = read("tweets").select(F.col("tweet_json.user.id").alias("user_id"), F.col(f"tweet_json.user.{field}").alias("text"))
    return t.where("user_id IS NOT NULL AND text IS NOT NULL").distinct()


@reg.query("p7_found")
def p7_found(read):
    region = {c: F.col(c) for c in ("admin_code", "admin_name")}
    places = link(_user_texts(read, "location"), "user_id", "text", read("places"), "place_id", "name", "alt_names", region)
    titles = link(_user_texts(read, "description"), "user_id", "text", read("job_titles"), "title_id", "title", "alt_titles", whole=False)
    out = lambda df, f: df.select(F.lit(f).alias("field"), "user_id", "ref_id")
    return out(places, "location").unionByName(out(titles, "description"))


def _sample(read):
    d = read("documents").select(F.col("doc_id").alias("row_key"), "text", F.col("lang").alias("label"))
    return training_sample(d, "row_key", "text", "label")


def _segmented(read) -> DataFrame:
    """(table_name, row_key, label, segments, text) of both tables; documents that are residue excepted.

    The few keys of residue go to the documents, whose texts stay where they are; where the keys aren't few, Spark
    shuffles keys and texts.
    """
    with ThreadPoolExecutor(1) as driver:  # the fit on the driver and the residue on the executors at the same time
        net = driver.submit(fit_once, _sample(read))
        out = cut_lineage(residue_evidence(read("documents"), "doc_id", "text", "source").select("doc_id"))
        net = net.result()
    docs = read("documents").select("doc_id", "lang", "text").join(broadcast_if_small(out, 2_000_000), "doc_id", "left_anti")
    both = docs.select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("row_key"), F.col("lang").alias("label"), "text").unionByName(
        read("rated_tweets").select(F.lit("rated_tweets").alias("table_name"), F.col("rating_id").alias("row_key"), F.col("language").alias("label"), F.col("full_text").alias("text"))
    )
    return with_segments(both, "text", net)


def label_fits(label: Column, lang: Column, ratings: Column) -> Column:
    """Whether a label fits a text in the one language ``lang``; in ratings Other fits any but en and fr."""
    other = ratings & F.lower(F.trim(label)).isin("other", "autre", "others", "autres") & ~lang.isin("en", "fr")
    return F.coalesce(label_of(label) == lang, F.lit(False)) | F.coalesce(other, F.lit(False))


@reg.query("p2_found")
def p2_found(read):
    s = _segmented(read)
    fits = label_fits(F.col("label"), F.get("segments", F.lit(0))["lang"], F.col("table_name") == "rated_tweets")
    out = s.where((F.size("segments") > 1) | ((F.size("segments") == 1) & ~fits))
    return out.select("table_name", "row_key", F.explode("segments").alias("s")).select("table_name", "row_key", "s.seg_no", "s.lang")


@reg.query("p2_texts")
def p2_texts(read):
    """Every text with its language and the confidence in it; null for texts in no language."""
    s = _segmented(read).withColumn("l", text_language(F.col("segments")))
    return s.select("table_name", "row_key", "l.lang", F.round("l.confidence", 6).alias("confidence"), F.size("segments").alias("n_segments"))


@reg.query("p2_segments")
def p2_segments(read):
    """Every stretch of every text with its language, confidence and place: a stretch is the stored text's code points from ``start`` to ``end``."""
    s = _segmented(read).select("table_name", "row_key", F.inline("segments"))
    return s.select("table_name", "row_key", "seg_no", "lang", F.round("confidence", 6).alias("confidence"), "n_words", "start", "end")


@reg.query("p6_classes")
def p6_classes(read):
    """One row for each text that has a twin in other characters, with its class: pairs are those of one class with different ``text_id``."""
    c = looks_alike(tweet_rows(read("tweets")), "field", "row_key", "text")
    return c.select("field", F.col("key").alias("row_key"), F.col("form.h1").alias("class_id"), F.col("text_id.h1").alias("text_id"))
