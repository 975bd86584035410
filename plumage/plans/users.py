"""Queries over tweets and their users: tagging, filters, projections, groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumage.functions import text as X
from plumage.functions.geo import box_middle
from plumage.operators.folds import numbered
from plumage.operators.tweets import at_path, tweet_id
from plumage.operators.users import DEMONYMS, LOCATION_TERMS, by_authors, in_country, nearest_entry, tag_country
from plumage.plans.registry import Registry

reg = Registry()

_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_HAV = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(({b1}) - ({a1})) / 2), 2) + cos(radians({a1})) * cos(radians({b1})) * pow(sin(radians(({b2}) - ({a2})) / 2), 2))))"
_NEAR = f"""near AS (SELECT delivery_id, country_code AS ncc FROM (SELECT t.delivery_id, p.country_code, row_number() OVER (PARTITION BY t.delivery_id ORDER BY
    {_HAV.format(a1="t.tweet_json.geo.coordinates[1]", a2="t.tweet_json.geo.coordinates[2]", b1="p.lat", b2="p.lon")}, p.place_id) AS r
    FROM tweets t, places p WHERE t.tweet_json.geo.coordinates IS NOT NULL) WHERE r = 1)"""
_TAGGED = f"""WITH {_NEAR}, t AS (SELECT delivery_id, tweet_json.user.id AS user_id, tweet_json.place.country_code AS pcc, coalesce(tweet_json.geo.type = 'Point', false) AS point, ncc,
      list_filter({_LIST(LOCATION_TERMS)}, lambda x: contains(lower(coalesce(tweet_json.user.location, '')), x))[1] AS loc,
      list_filter({_LIST(DEMONYMS)}, lambda x: contains(lower(coalesce(tweet_json.user.description, '')), x))[1] AS dem FROM tweets LEFT JOIN near USING (delivery_id)),
    tagged AS (SELECT delivery_id, user_id, CASE WHEN pcc IS NOT NULL THEN pcc = 'CA' WHEN point THEN ncc = 'CA' WHEN loc IS NOT NULL OR dem IS NOT NULL THEN true END AS is_canadian,
      CASE WHEN pcc IS NOT NULL THEN 'place object' WHEN point THEN 'coordinates' WHEN loc IS NOT NULL THEN 'user profile location' WHEN dem IS NOT NULL THEN 'user profile description' END AS method,
      CASE WHEN pcc IS NOT NULL THEN pcc WHEN point THEN ncc ELSE coalesce(loc, dem) END AS evidence, CASE WHEN pcc IS NOT NULL THEN pcc WHEN point THEN ncc END AS country_code FROM t)"""


def _tagged(read):
    return tag_country(read("tweets"), read("places")).select("delivery_id", F.col("tweet_json.user.id").alias("user_id"), "is_canadian", "method", "evidence", "country_code")


@reg.query("lexicon_tagger", f"{_TAGGED} SELECT * FROM tagged")
def lexicon_tagger(read):
    return _tagged(read)


@reg.query("lexicon_users_distinct", f"{_TAGGED} SELECT method, is_canadian, count(*) AS n_tweets, count(DISTINCT user_id) AS n_users FROM tagged GROUP BY ALL")
def lexicon_users_distinct(read):
    return _tagged(read).groupBy("method", "is_canadian").agg(F.count(F.lit(1)).alias("n_tweets"), F.countDistinct("user_id").alias("n_users"))


@reg.query("canadian_users", f"{_TAGGED} SELECT DISTINCT user_id FROM tagged WHERE is_canadian")
def canadian_users(read):
    return _tagged(read).where("is_canadian").select("user_id").distinct()


@reg.query("matched_total", f"{_TAGGED} SELECT count(*) FILTER (WHERE is_canadian) AS matched, count(*) AS total FROM tagged")
def matched_total(read):
    return _tagged(read).agg(F.count_if(F.col("is_canadian")).alias("matched"), F.count(F.lit(1)).alias("total"))


@reg.query("geo_or_place_filter", f"WITH {_NEAR} SELECT delivery_id FROM tweets LEFT JOIN near USING (delivery_id) WHERE coalesce(tweet_json.place.country_code = 'CA', false) OR coalesce(tweet_json.geo.type = 'Point' AND ncc = 'CA', false)")
def geo_or_place_filter(read):
    return in_country(read("tweets"), read("places")).select("delivery_id")


@reg.query(
    "nearest_place",
    f"""SELECT user_id, lat, lon, place_id FROM (SELECT u.user_id, u.lat, u.lon, p.place_id, row_number() OVER (PARTITION BY u.user_id, u.lat, u.lon ORDER BY
        {_HAV.format(a1="u.lat", a2="u.lon", b1="p.lat", b2="p.lon")}, p.place_id) AS r FROM (SELECT DISTINCT * FROM user_locations WHERE lat IS NOT NULL AND lon IS NOT NULL) u, places p) WHERE r = 1""",
)
def nearest_place(read):
    u = read("user_locations").where("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    return u.select("user_id", "lat", "lon", nearest_entry(F.col("lat"), F.col("lon"), read("places"), "place_id", "place_id").alias("place_id"))


@reg.query(
    "bbox_midpoint",
    """SELECT delivery_id, round((list_min(list_transform(b, lambda e: e[2])) + list_max(list_transform(b, lambda e: e[2]))) / 2, 7) AS lat,
       round((list_min(list_transform(b, lambda e: e[1])) + list_max(list_transform(b, lambda e: e[1]))) / 2, 7) AS lon
       FROM (SELECT delivery_id, tweet_json.place.bounding_box.coordinates[1] AS b FROM tweets) WHERE b IS NOT NULL""",
)
def bbox_midpoint(read):
    ring = F.get(F.col("tweet_json.place.bounding_box.coordinates"), F.lit(0))
    t = read("tweets").select("delivery_id", box_middle(ring).alias("m"))
    return t.where("m IS NOT NULL").select("delivery_id", F.round("m.lat", 7).alias("lat"), F.round("m.lon", 7).alias("lon"))


@reg.query(
    "location_coalesce",
    """SELECT delivery_id, CASE WHEN g IS NOT NULL THEN g[1] ELSE round((list_min(list_transform(b, lambda e: e[2])) + list_max(list_transform(b, lambda e: e[2]))) / 2, 7) END AS lat,
       CASE WHEN g IS NOT NULL THEN g[2] ELSE round((list_min(list_transform(b, lambda e: e[1])) + list_max(list_transform(b, lambda e: e[1]))) / 2, 7) END AS lon
       FROM (SELECT delivery_id, tweet_json.geo.coordinates AS g, tweet_json.place.bounding_box.coordinates[1] AS b FROM tweets) WHERE g IS NOT NULL OR b IS NOT NULL""",
)
def location_coalesce(read):
    g = F.col("tweet_json.geo.coordinates")
    m = box_middle(F.get(F.col("tweet_json.place.bounding_box.coordinates"), F.lit(0)))
    at = lambda i, n: F.when(g.isNotNull(), F.get(g, F.lit(i))).otherwise(F.round(m[n], 7))
    return read("tweets").where(g.isNotNull() | m.isNotNull()).select("delivery_id", at(0, "lat").alias("lat"), at(1, "lon").alias("lon"))


@reg.query("legacy_gps", "SELECT delivery_id, tweet_json.coordinates.coordinates[2] AS lat, tweet_json.coordinates.coordinates[1] AS lon FROM tweets WHERE tweet_json.coordinates.type = 'Point'")
def legacy_gps(read):
    c = F.col("tweet_json.coordinates.coordinates")
    return read("tweets").where("tweet_json.coordinates.type = 'Point'").select("delivery_id", F.get(c, F.lit(1)).alias("lat"), F.get(c, F.lit(0)).alias("lon"))


@reg.query("author_semi", "SELECT delivery_id FROM tweets WHERE tweet_json.user.id IN (SELECT try_cast(user_id AS BIGINT) FROM user_locations)")
def author_semi(read):
    return by_authors(read("tweets"), read("user_locations")).select("delivery_id")


@reg.query(
    "author_or_mention",
    """WITH u AS (SELECT DISTINCT try_cast(user_id AS BIGINT) AS u FROM user_locations)
       SELECT delivery_id FROM tweets t WHERE tweet_json.user.id IN (SELECT u FROM u) OR EXISTS (SELECT 1 FROM (SELECT unnest(t.tweet_json.entities.user_mentions) AS m) JOIN u ON coalesce(m.id, try_cast(m.id_str AS BIGINT)) = u.u)""",
)
def author_or_mention(read):
    return by_authors(read("tweets"), read("user_locations"), include_mentions=True).select("delivery_id")


@reg.query("id_projection", "SELECT delivery_id, coalesce(tweet_json.id, try_cast(tweet_json.id_str AS BIGINT)) AS tweet_id FROM tweets")
def id_projection(read):
    return read("tweets").select("delivery_id", tweet_id().alias("tweet_id"))


@reg.query("jsonpath_project", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def jsonpath_project(read):
    return read("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


_TXT = "tweet_json.full_text"
@reg.query("path_over_lists", "SELECT delivery_id, u AS mentioned FROM (SELECT delivery_id, unnest(list_transform(tweet_json.entities.user_mentions, lambda m: m.id)) AS u FROM tweets)")
def path_over_lists(read):
    """The ids at ``entities.user_mentions.id``, a member of each element of a list."""
    t = read("tweets")
    return t.select("delivery_id", F.explode(at_path(t, "tweet_json.entities.user_mentions.id")).alias("mentioned"))


_KEY = f"""(list_has_any(string_split_regex(lower(coalesce({_TXT}, '')), '[{X.WHITE}]+'), {_LIST(X.MASK_KEYWORDS)}) OR """ + " OR ".join(f"contains(lower(coalesce({_TXT}, '')), '{p}')" for p in X.MASK_PHRASES) + ")"


@reg.query("keyword_or_phrase", f"SELECT delivery_id FROM tweets WHERE {_KEY}")
def keyword_or_phrase(read):
    return read("tweets").where(X.keyword_or_phrase(F.col(_TXT))).select("delivery_id")


_TOK = f"string_split_regex(lower(coalesce({_TXT}, '')), '[{X.WHITE}]+')"


@reg.query(
    "conditional_limit50",
    f"""SELECT delivery_id, source_file FROM tweets WHERE {_KEY} AND (list_has_any({_TOK}, ['if', 'unless']) OR list_has_all({_TOK}, ['not', 'necessarily'])) ORDER BY source_file, delivery_id LIMIT 50""",
)
def conditional_limit50(read):
    c = F.col(_TXT)
    return read("tweets").where(X.keyword_or_phrase(c) & X.conditional(c)).select("delivery_id", "source_file").orderBy("source_file", "delivery_id").limit(50)


@reg.query("original_min_tokens", f"SELECT delivery_id FROM tweets WHERE tweet_json.retweeted_status IS NULL AND len(list_filter({_TOK}, lambda x: x <> '')) >= 5")
def original_min_tokens(read):
    return read("tweets").where(F.col("tweet_json.retweeted_status").isNull() & (F.size(X.tokens(F.col(_TXT))) >= 5)).select("delivery_id")


@reg.query(
    "group_bag",
    """SELECT user_id, (i // 100)::BIGINT AS chunk, count(*) AS n, md5(string_agg(delivery_id::VARCHAR, ',' ORDER BY delivery_id)) AS bag
       FROM (SELECT tweet_json.user.id AS user_id, delivery_id, row_number() OVER (PARTITION BY tweet_json.user.id ORDER BY md5(delivery_id::VARCHAR || '#0'), delivery_id) - 1 AS i FROM tweets) GROUP BY 1, 2""",
)
def group_bag(read):
    """Tweets grouped by user, in bags of at most 100: no user's tweets are all brought to one row or task."""
    t = numbered(read("tweets").select(F.col("tweet_json.user.id").alias("user_id"), "delivery_id"), "delivery_id", group=["user_id"])
    g = t.groupBy("user_id", F.floor(F.col("i") / 100).alias("chunk"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("delivery_id")), ",")).alias("bag"))


@reg.query("bag_histogram", "SELECT least(n, 10) AS size, count(*) AS users FROM (SELECT tweet_json.user.id, count(*) AS n FROM tweets GROUP BY 1) GROUP BY 1")
def bag_histogram(read):
    n = read("tweets").groupBy("tweet_json.user.id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(F.least("n", F.lit(10)).cast("bigint").alias("size")).agg(F.count(F.lit(1)).alias("users"))


@reg.query("upsert_last", "SELECT user_id, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lat DESC NULLS LAST, lon DESC NULLS LAST) AS r FROM user_locations) WHERE r = 1")
def upsert_last(read):
    """One row per key, the last by order; here the order is that of the values."""
    last = F.max(F.struct(F.col("lat").isNotNull().alias("a"), "lat", F.col("lon").isNotNull().alias("b"), "lon")).alias("m")
    return read("user_locations").groupBy("user_id").agg(last).select("user_id", "m.lat", "m.lon")


@reg.query("set_union", "SELECT try_cast(user_id AS BIGINT) AS u FROM user_locations UNION SELECT id FROM follows")
def set_union(read):
    return read("user_locations").select(F.col("user_id").try_cast("bigint").alias("u")).union(read("follows").select("id")).distinct()


@reg.query("set_intersect", "SELECT try_cast(user_id AS BIGINT) AS u FROM user_locations INTERSECT SELECT id FROM follows")
def set_intersect(read):
    return read("user_locations").select(F.col("user_id").try_cast("bigint").alias("u")).intersect(read("follows").select("id"))


@reg.query("set_except", "SELECT try_cast(user_id AS BIGINT) AS u FROM user_locations EXCEPT SELECT id FROM follows")
def set_except(read):
    return read("user_locations").select(F.col("user_id").try_cast("bigint").alias("u")).subtract(read("follows").select("id"))


@reg.query("results_known_users", "SELECT user_id, lat, lon FROM user_locations WHERE try_cast(user_id AS BIGINT) IN (SELECT id FROM follows)")
def results_known_users(read):
    u = read("user_locations")
    return u.join(read("follows").select(F.col("id").cast("string").alias("user_id")), "user_id", "left_semi").select("user_id", "lat", "lon")


@reg.query("bag_union", "SELECT source, count(*) AS n FROM (SELECT 'tweets' AS source, tweet_json.full_text AS t FROM tweets UNION ALL SELECT 'documents', text FROM documents) GROUP BY 1")
def bag_union(read):
    a = read("tweets").select(F.lit("tweets").alias("source"), F.col(_TXT).alias("t"))
    return a.unionByName(read("documents").select(F.lit("documents").alias("source"), F.col("text").alias("t"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_STOP = _LIST(X.STOP_WORDS)
_GONE = (X.PUNCTUATION + X.TYPOGRAPHIC).replace("'", "''")
_GONE_HASH = (X.PUNCTUATION.replace("#", "") + X.TYPOGRAPHIC).replace("'", "''")


@reg.query("tokens", rf"SELECT count(*) AS n, count(DISTINCT t) AS n_distinct FROM (SELECT unnest(string_split_regex(text, '[{X.WHITE}]+')) AS t FROM documents) WHERE t <> ''")
def tokens(read):
    t = read("documents").select(F.explode(X.tokens(F.col("text"))).alias("t"))
    return t.groupBy("t").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


@reg.query(
    "normalise_std",
    rf"""SELECT delivery_id, md5(array_to_string(list_filter(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace({_TXT}, 'http[^{X.WHITE}]+', '', 'g'), 'www\.[^{X.WHITE}]+', '', 'g'), '[{X.WHITE}]+'),
         lambda x: x <> '' AND NOT (starts_with(x, '#') AND length(x) > 1)), lambda x: translate(lower(x), '{_GONE}', '')), lambda x: x <> '' AND NOT list_contains({_STOP}, x)), ' ')) AS h FROM tweets""",
)
def normalise_std(read):
    return read("tweets").select("delivery_id", F.md5(X.normalise_text(F.col(_TXT))).alias("h"))


@reg.query(
    "normalise_tokens",
    rf"""SELECT t, count(*) AS n FROM (SELECT unnest(list_transform(list_filter(string_split_regex(full_text, '[{X.WHITE}]+'), lambda x: x <> ''), lambda x: translate(lower(x), '{_GONE_HASH}', ''))) AS t FROM rated_tweets)
         WHERE t <> '' AND NOT list_contains({_STOP}, t) GROUP BY t""",
)
def normalise_tokens(read):
    return read("rated_tweets").select(F.explode(X.normalise_tokens(X.tokens(F.col("full_text")))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


@reg.query("hashtag_extract", rf"SELECT h, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(tweet_json.full_text, '[{X.WHITE}]+'), lambda x: starts_with(x, '#'))) AS h FROM tweets) GROUP BY h")
def hashtag_extract(read):
    return read("tweets").select(F.explode(X.hashtags(F.col(_TXT))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))


@reg.query(
    "camel_split",
    rf"""SELECT h, regexp_replace(regexp_replace(h, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g') AS words
        FROM (SELECT DISTINCT substr(unnest(list_filter(string_split_regex(tweet_json.full_text, '[{X.WHITE}]+'), lambda x: starts_with(x, '#'))), 2) AS h FROM tweets) WHERE regexp_full_match(h, '[A-Za-z]+')""",
)
def camel_split(read):
    h = read("tweets").select(F.explode(X.hashtags(F.col(_TXT))).alias("h")).select(F.expr("substring(h, 2)").alias("h"))
    return h.where(F.col("h").rlike("^[A-Za-z]+$")).distinct().select("h", F.array_join(X.camel_split(F.col("h")), " ").alias("words"))


@reg.query("strip_urls", rf"SELECT delivery_id, md5(regexp_replace(regexp_replace({_TXT}, 'http[^{X.WHITE}]+', '', 'g'), 'www\.[^{X.WHITE}]+', '', 'g')) AS h FROM tweets")
def strip_urls(read):
    return read("tweets").select("delivery_id", F.md5(X.strip_urls(F.col(_TXT))).alias("h"))


@reg.query(
    "path_parts",
    "SELECT source_file, string_split(source_file, '/')[-1] AS base, string_split(string_split(source_file, '/')[-1], '.')[1] AS stem, string_split(source_file, '/')[1] AS parent, count(*) AS n FROM tweets GROUP BY ALL",
)
def path_parts(read):
    p = F.col("source_file")
    return read("tweets").groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).select("source_file", X.base_name(p).alias("base"), X.stem_name(p).alias("stem"), F.substring_index(p, "/", 1).alias("parent"), "n")


_WORDS = {"thank": 1.5, "kind": 2.1, "fine": 0.8, "better": 1.9, "harder": -0.4, "headache": -1.9, "confusing": -0.9, "useless": -1.8, "safe": 1.9, "tiring": -1.2}


@reg.query(
    "sentiment_scores",
    rf"""WITH lex(w, v) AS (VALUES {", ".join(f"('{w}', {v}::DOUBLE)" for w, v in _WORDS.items())}),
         t AS (SELECT rating_id, translate(lower(x), '{_GONE_HASH}', '') AS w FROM (SELECT rating_id, unnest(string_split_regex(full_text, '[{X.WHITE}]+')) AS x FROM rated_tweets)),
         s AS (SELECT rating_id, sum(coalesce(v, 0)) AS s FROM t LEFT JOIN lex USING (w) WHERE w <> '' GROUP BY 1)
         SELECT rating_id, round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15), 6) AS compound FROM rated_tweets LEFT JOIN s USING (rating_id)""",
)
def sentiment_scores(read):
    return read("rated_tweets").select("rating_id", F.round(X.polarity(F.col("full_text"), _WORDS)["compound"], 6).alias("compound"))
