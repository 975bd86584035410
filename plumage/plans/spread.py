"""Queries over locations, graphs and hashtags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage.functions import text as X
from plumage.functions.text import camel_split, hashtags, tokens
from plumage.operators import hashtag as H
from plumage.operators import locate as L
from plumage.operators import rank as R
from plumage.operators.tweets import tweet_points
from plumage.plans.registry import Registry
from plumage.session import cut_lineage

reg = Registry()
_KM = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_POINTS = """pts AS (SELECT DISTINCT ON (id) id, u, CASE WHEN ok THEN g[1] ELSE (list_min(list_transform(b, lambda e: e[2])) + list_max(list_transform(b, lambda e: e[2]))) / 2 END AS lat,
    CASE WHEN ok THEN g[2] ELSE (list_min(list_transform(b, lambda e: e[1])) + list_max(list_transform(b, lambda e: e[1]))) / 2 END AS lon
    FROM (SELECT coalesce(tweet_json.id, try_cast(tweet_json.id_str AS BIGINT)) AS id, tweet_json.user.id AS u, tweet_json.geo.coordinates AS g, tweet_json.place.bounding_box.coordinates[1] AS b,
          coalesce(abs(tweet_json.geo.coordinates[1]) <= 90 AND NOT (tweet_json.geo.coordinates[1] = 0 AND tweet_json.geo.coordinates[2] = 0), false) AS ok FROM tweets) WHERE ok OR b IS NOT NULL)"""


def _medoid_sql(src: str, group: str, order: str, least: int = 1) -> str:
    """Medoids of ``src`` (group, order, lat, lon)."""
    return f"""(SELECT g, lat, lon FROM (SELECT g, lat, lon, row_number() OVER (PARTITION BY g ORDER BY round(s, 6), o) AS r FROM (
        SELECT a.g, a.lat, a.lon, min(a.o) AS o, sum({_KM}) / count(DISTINCT a.o) AS s FROM (SELECT {group} AS g, {order} AS o, lat, lon FROM {src}) a JOIN (SELECT {group} AS g, lat, lon FROM {src}) b ON a.g = b.g
        WHERE a.g IN (SELECT {group} FROM {src} GROUP BY 1 HAVING count(*) >= {least}) GROUP BY a.g, a.lat, a.lon)) WHERE r = 1)"""


def _user_points(read):
    t = read("tweets")
    at = tweet_points(t)
    users = t.select(F.coalesce("tweet_json.id", F.col("tweet_json.id_str").try_cast("bigint")).alias("tweet_id"), F.col("tweet_json.user.id").alias("user_id")).dropDuplicates(["tweet_id"])
    return at.join(users, "tweet_id")


@reg.query("user_medoid", f"WITH {_POINTS} SELECT g AS user_id, lat, lon FROM {_medoid_sql('pts', 'u', 'id', 3)}")
def user_medoid(read):
    return L.medoid(_user_points(read), "user_id", "tweet_id", min_points=3)


@reg.query("user_homes")
def user_homes(read):
    """Users with five tweets pairwise within 15 km, at the medoid of their tweets."""
    return L.homes(_user_points(read), "user_id", "tweet_id")


_MENTIONS = """men AS (SELECT src, dst, count(*) AS weight FROM (SELECT tweet_json.user.id::VARCHAR AS src, unnest(tweet_json.entities.user_mentions) AS m, tweet_json.retweeted_status IS NOT NULL AS rt FROM tweets) x,
    LATERAL (SELECT coalesce(m.id::VARCHAR, m.id_str) AS dst) WHERE src IS NOT NULL AND dst IS NOT NULL AND NOT (rt AND src = dst) GROUP BY 1, 2)"""
_FOLLOWS = """fol AS (SELECT src, dst, count(*) AS weight FROM (SELECT id::VARCHAR AS src, unnest(friends)::VARCHAR AS dst FROM follows UNION ALL SELECT unnest(followers)::VARCHAR, id::VARCHAR FROM follows) WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2)"""
_BOTH = "rec AS (SELECT e.* FROM fol e WHERE src <> dst AND EXISTS (SELECT 1 FROM fol b WHERE b.src = e.dst AND b.dst = e.src))"


@reg.query("mention_edges", f"WITH {_MENTIONS} SELECT * FROM men")
def mention_edges(read):
    return L.mention_edges(read("tweets"))


@reg.query("follow_edges", f"WITH {_FOLLOWS} SELECT * FROM fol")
def follow_edges(read):
    return L.follow_edges(read("follows"))


@reg.query("reciprocal_edges", f"WITH {_FOLLOWS}, {_BOTH} SELECT * FROM rec")
def reciprocal_edges(read):
    return L.reciprocal(L.follow_edges(read("follows")))


@reg.query(
    "degrees",
    f"""WITH {_FOLLOWS}, {_BOTH} SELECT coalesce(o.v, i.v) AS vertex, coalesce(od, 0) AS out_degree, coalesce(id, 0) AS in_degree, coalesce(w, 0)::BIGINT AS weight_out
        FROM (SELECT src AS v, count(*) AS od, sum(weight) AS w FROM rec GROUP BY 1) o FULL JOIN (SELECT dst AS v, count(*) AS id FROM rec GROUP BY 1) i ON o.v = i.v""",
)
def degrees(read):
    return L.degrees(reciprocal_edges(read))


def _slp_sql(rounds: int) -> str:
    parts = [_FOLLOWS, _BOTH, "seeds AS (SELECT user_id, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lat DESC, lon DESC) AS r FROM user_locations WHERE lat IS NOT NULL AND lon IS NOT NULL) WHERE r = 1)", "n0 AS MATERIALIZED (SELECT user_id, lat, lon, 0 AS round FROM seeds)"]
    for i in range(1, rounds + 1):
        parts.append(f"x{i} AS MATERIALIZED (SELECT e.src, e.dst, n.lat, n.lon FROM rec e JOIN n{i - 1} n ON n.user_id = e.dst WHERE e.src NOT IN (SELECT user_id FROM seeds))")
        parts.append(f"n{i} AS MATERIALIZED (SELECT user_id, lat, lon, 0 AS round FROM seeds UNION ALL SELECT m.g, m.lat, m.lon, coalesce(p.round, {i}) FROM {_medoid_sql(f'x{i}', 'src', 'dst')} m LEFT JOIN n{i - 1} p ON p.user_id = m.g)")
    return f"WITH {', '.join(parts)} SELECT * FROM n{rounds}"


def _slp(read, rounds: int):
    return L.spread_locations(reciprocal_edges(read), read("user_locations"), rounds)


@reg.query("slp_iter1", _slp_sql(1))
def slp_iter1(read):
    return _slp(read, 1)


@reg.query("slp_iter4", _slp_sql(4))
def slp_iter4(read):
    return _slp(read, 4)


@reg.query("slp_coverage", f"SELECT round, new_users, sum(new_users) OVER (ORDER BY round)::BIGINT AS located_users FROM (SELECT round, count(*) AS new_users FROM ({_slp_sql(4)}) GROUP BY 1)")
def slp_coverage(read):
    return L.coverage(_slp(read, 4))


@reg.query("slp_lookup", f"SELECT f.id::VARCHAR AS user_id, s.lat, s.lon FROM follows f LEFT JOIN ({_slp_sql(4)}) s ON s.user_id = f.id::VARCHAR")
def slp_lookup(read):
    return L.lookup(read("follows").select(F.col("id").cast("string").alias("user_id")), _slp(read, 4))


# ---- hashtags --------------------------------------------------------------------------------------

_TAGS = rf"tags AS (SELECT DISTINCT substr(h, 2) AS tag FROM (SELECT unnest(list_filter(string_split_regex(tweet_json.full_text, '[{X.WHITE}]+'), lambda x: starts_with(x, '#'))) AS h FROM tweets) WHERE regexp_full_match(h, '#[A-Za-z]+'))"
_GOLD = r"gold AS (SELECT tag, regexp_replace(regexp_replace(tag, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g') AS gold FROM tags)"


def _tags(read):
    h = read("tweets").select(F.explode(hashtags(F.col("tweet_json.full_text"))).alias("h")).select(F.expr("substring(h, 2)").alias("tag"))
    return h.where(F.col("tag").rlike("^[A-Za-z]+$")).distinct()


def _gold(read):
    return _tags(read).select("tag", F.array_join(camel_split(F.col("tag")), " ").alias("gold"))


#: Candidates that need no model: as it is, by capitals, and in two halves.
_CANDS = "cand AS (SELECT tag, gold, [tag, gold, left(tag, length(tag) // 2) || ' ' || substr(tag, length(tag) // 2 + 1)] AS cands FROM gold)"


def _cands(read):
    half = (F.length("tag") / 2).cast("int")
    two = F.concat_ws(" ", F.left("tag", half), F.expr("substring(tag, cast(length(tag) / 2 as int) + 1)"))
    return _gold(read).select("tag", "gold", F.array("tag", "gold", two).alias("cands"))


@reg.query("ngram_counts", rf"WITH t AS (SELECT list_filter(string_split_regex(lower(full_text), '[{X.WHITE}]+'), lambda x: x <> '') AS w FROM rated_tweets), g AS (SELECT unnest(w) AS ngram, 1 AS n FROM t UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])), 2 FROM t UNION ALL SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])), 3 FROM t) SELECT ngram, n, count(*) AS count FROM g GROUP BY 1, 2")
def ngram_counts(read):
    return H.ngram_counts(read("rated_tweets").select(tokens(F.lower("full_text")).alias("w")), "w")


@reg.query("count_log10", "SELECT lower(trim(source)) AS source, round(log10(sum(n_chars) + 1), 9) AS log_count FROM documents GROUP BY 1")
def count_log10(read):
    return H.log_counts(read("documents"), "source", "n_chars").select("source", F.round("log_count", 9).alias("log_count"))


@reg.query("gold_expand", f"WITH {_TAGS}, {_GOLD}, x AS (SELECT tag, unnest([gold, replace(gold, ' ', '-'), replace(gold, ' ', ''''), 'other']) AS g FROM gold) SELECT tag, unnest(CASE WHEN lower(replace(g, ' ', '')) = lower(tag) THEN [g] WHEN contains(g, '''') THEN [replace(g, '''', ''), replace(g, '''', ' ')] WHEN contains(g, '-') THEN [replace(g, '-', ''), replace(g, '-', ' ')] WHEN contains(g, '.') THEN [replace(g, '.', '')] ELSE [] END) AS gold FROM x")
def gold_expand(read):
    g = _gold(read).withColumn("gs", F.array("gold", F.replace("gold", F.lit(" "), F.lit("-")), F.replace("gold", F.lit(" "), F.lit("'")), F.lit("other")))
    return g.select("tag", F.explode(H.expand_gold(F.col("gs"), F.col("tag"))).alias("gold"))


@reg.query("mrr", f"WITH {_TAGS}, {_GOLD}, {_CANDS} SELECT round(avg(CASE WHEN lower(cands[1]) = lower(gold) THEN 1.0 WHEN lower(cands[2]) = lower(gold) THEN 0.5 WHEN lower(cands[3]) = lower(gold) THEN 1/3.0 ELSE 0 END), 6) AS mrr FROM cand")
def mrr(read):
    return _cands(read).agg(F.round(F.avg(H.reciprocal_rank(F.col("cands"), F.array("gold"))), 6).alias("mrr"))


@reg.query("acc_at_k", f"WITH {_TAGS}, {_GOLD}, {_CANDS} SELECT round(avg((lower(cands[1]) = lower(gold))::INT), 6) AS at_1, round(avg((lower(cands[1]) = lower(gold) OR lower(cands[2]) = lower(gold))::INT), 6) AS at_2 FROM cand")
def acc_at_k(read):
    g = F.array("gold")
    return _cands(read).agg(F.round(F.avg(H.right_at(F.col("cands"), g, 1)), 6).alias("at_1"), F.round(F.avg(H.right_at(F.col("cands"), g, 2)), 6).alias("at_2"))


@reg.query("fscore_at_k", f"""WITH {_TAGS}, {_GOLD}, {_CANDS}, s AS (SELECT tag, unnest(cands) AS c, unnest([1, 2, 3]) AS r, gold FROM cand), w AS (SELECT tag, r, list_distinct(string_split(lower(c), ' ')) AS a, list_distinct(string_split(lower(gold), ' ')) AS b FROM s),
    f AS (SELECT tag, r, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS f FROM w) SELECT round((SELECT avg(f) FROM f WHERE r = 1), 6) AS at_1, round((SELECT avg(m) FROM (SELECT max(f) AS m FROM f WHERE r <= 3 GROUP BY tag)), 6) AS at_3""")
def fscore_at_k(read):
    g = F.array("gold")
    return _cands(read).agg(F.round(F.avg(H.f_at(F.col("cands"), g, 1)), 6).alias("at_1"), F.round(F.avg(H.f_at(F.col("cands"), g, 3)), 6).alias("at_3"))


@reg.query("edit_label", f"WITH {_TAGS}, {_GOLD}, {_CANDS} SELECT tag, c AS seg, (-levenshtein(lower(c), lower(gold)))::INT AS label FROM (SELECT tag, gold, unnest(cands) AS c FROM cand)")
def edit_label(read):
    return _cands(read).select("tag", "gold", F.explode("cands").alias("seg")).select("tag", "seg", H.edit_label(F.col("seg"), F.array("gold")).cast("int").alias("label"))


@reg.query("len_histogram", f"WITH {_TAGS}, {_GOLD} SELECT tag, (i)::INT AS length, len(list_filter(string_split(gold, ' '), lambda x: least(length(x), 20) = i))::DOUBLE AS n FROM gold, range(1, 21) t(i)")
def len_histogram(read):
    return _gold(read).select("tag", F.posexplode(H.length_histogram(F.col("gold")))).select("tag", (F.col("pos") + 1).alias("length"), F.col("col").alias("n"))


#: Tags of letters, digits and underscores, each uncut, cut at capitals, between digits and letters, and at underscores.
_ALL_TAGS = rf"""all_tags AS (SELECT DISTINCT substr(h, 2) AS tag FROM (SELECT unnest(list_filter(string_split_regex(tweet_json.full_text, '[{X.WHITE}]+'), lambda x: starts_with(x, '#'))) AS h FROM tweets) WHERE regexp_full_match(h, '#[A-Za-z0-9_]+')),
  camel AS (SELECT tag, regexp_replace(regexp_replace(tag, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g') AS best FROM all_tags),
  segs AS (SELECT DISTINCT tag, best, unnest([tag, best, regexp_replace(regexp_replace(tag, '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), trim(replace(tag, '_', ' _ '))]) AS seg FROM camel)"""


def _segs(read):
    h = read("tweets").select(F.explode(hashtags(F.col("tweet_json.full_text"))).alias("h")).select(F.expr("substring(h, 2)").alias("tag"))
    t = h.where(F.col("tag").rlike("^[A-Za-z0-9_]+$")).distinct().withColumn("best", F.array_join(camel_split(F.col("tag")), " "))
    digits = F.regexp_replace(F.regexp_replace("tag", "([A-Za-z])([0-9])", "$1 $2"), "([0-9])([A-Za-z])", "$1 $2")
    return t.select("tag", "best", F.explode(F.array_distinct(F.array("tag", "best", digits, F.trim(F.replace("tag", F.lit("_"), F.lit(" _ ")))))).alias("seg"))


@reg.query(
    "word_shapes",
    f"""WITH {_ALL_TAGS}, s AS (SELECT tag, seg, replace(seg, ' ', '') AS o, lower(replace(seg, ' ', '')) AS low, string_split(lower(seg), ' ') AS t FROM segs)
        SELECT tag, seg, (regexp_full_match(low, '[a-z]+[0-9]+') AND len(t) > 1 AND regexp_extract(low, '[0-9]+$') = t[2])::INT::DOUBLE AS xxdd,
        (regexp_full_match(low, '[0-9]+[a-z]+') AND len(t) > 1 AND regexp_extract(low, '^[0-9]+') = t[1])::INT::DOUBLE AS ddxx,
        (seg = regexp_replace(regexp_replace(o, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g') AND o <> low)::INT::DOUBLE AS camel,
        (contains(o, '_') AND seg = trim(replace(o, '_', ' _ ')))::INT::DOUBLE AS underscore, (regexp_full_match(o, '[0-9]+') AND seg = o)::INT::DOUBLE AS digits,
        (regexp_full_match(low, '[bcdfghjklmnpqrstvwxyz]*') AND low = lower(seg))::INT::DOUBLE AS abbreviation,
        (regexp_full_match(o, '[a-z]+[A-Z]+') AND len(t) > 1 AND lower(regexp_extract(o, '[A-Z]+$')) = t[2])::INT::DOUBLE AS "xxXX" FROM s""",
)
def word_shapes(read):
    return _segs(read).select("tag", "seg", *H.word_shapes(F.col("seg")))


#: Lists that stand for assets: words of rated texts as dictionary and counts, listed towns as titles, occupations as slang.
_LISTS = rf"""words AS (SELECT w AS key, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(full_text), '[{X.WHITE}]+')) AS w FROM rated_tweets) WHERE w <> '' GROUP BY 1),
  titles AS (SELECT DISTINCT regexp_replace(lower(trim(name)), '[(\[].*?[)\]]', '', 'g') AS term FROM places), title_words AS (SELECT DISTINCT unnest(string_split(term, ' ')) AS term FROM titles), slang AS (SELECT DISTINCT lower(trim(title)) AS term FROM job_titles)"""


def _lists(read):
    words = H.ngram_counts(read("rated_tweets").select(tokens(F.lower("full_text")).alias("w")), "w", 1)
    terms = H.title_terms(read("places"), "name").unionByName(words.select(F.col("ngram").alias("term"), F.lit("dictionary").alias("kind"))).unionByName(read("job_titles").select(F.col("title").alias("term"), F.lit("slang").alias("kind")))
    return H.log_counts(words, "ngram", "count").withColumnRenamed("ngram", "key"), terms


@reg.query(
    "tag_features",
    f"""WITH {_ALL_TAGS}, {_LISTS}, s AS (SELECT *, lower(tag) AS low FROM camel)
        SELECT tag, length(low)::DOUBLE AS length, (best NOT LIKE '% %')::INT::DOUBLE AS single_word, round(coalesce((SELECT log10(n + 1) FROM words WHERE key = low), 0), 6) AS count_tag,
        round(coalesce((SELECT log10(n + 1) FROM words WHERE key = lower(best)), 0), 6) AS count_best, (low IN (SELECT key FROM words))::INT::DOUBLE AS in_dictionary, (low IN (SELECT term FROM titles))::INT::DOUBLE AS in_titles,
        (low IN (SELECT term FROM title_words))::INT::DOUBLE AS in_title_tokens, (low IN (SELECT term FROM slang))::INT::DOUBLE AS in_slang, regexp_full_match(low, '[0-9]+')::INT::DOUBLE AS digit_tag,
        regexp_full_match(low, '[bcdfghjklmnpqrstvwxyz]*')::INT::DOUBLE AS no_vowel, regexp_full_match(low, '[0-9]+[a-z]+')::INT::DOUBLE AS digits_letters, regexp_full_match(low, '[a-z]+[0-9]+')::INT::DOUBLE AS letters_digits,
        (best LIKE '% %' AND low NOT IN (SELECT term FROM titles))::INT::DOUBLE AS camel_tag FROM s""",
)
def tag_features(read):
    counts, terms = _lists(read)
    t = _segs(read).select("tag", "best").distinct()
    return H.tag_features(t, "tag", "best", counts, terms).drop("best").withColumns({c: F.round(c, 6) for c in ("count_tag", "count_best")})


@reg.query(
    "candidate_vector",
    f"""WITH {_ALL_TAGS}, {_LISTS}, s AS (SELECT tag, seg, string_split(lower(seg), ' ') AS t FROM segs), k AS (SELECT tag, seg, sum(length(w)) AS known FROM (SELECT tag, seg, unnest(t) AS w FROM s) WHERE w IN (SELECT key FROM words) OR w IN (SELECT term FROM slang) GROUP BY 1, 2)
        SELECT tag, seg, 34 AS size, length(seg)::DOUBLE AS score, round(coalesce((SELECT log10(n + 1) FROM words WHERE key = lower(seg)), 0), 6) AS count_seg, len(list_filter(t, lambda x: length(x) = 4))::DOUBLE AS of_four,
        len(list_filter(t, lambda x: length(x) >= 20))::DOUBLE AS of_twenty, round(coalesce(known, 0) / len(t), 6) AS known FROM s LEFT JOIN k USING (tag, seg)""",
)
def candidate_vector(read):
    """Parts of the vectors of all candidates; the text's length stands for a model's score."""
    counts, terms = _lists(read)
    c = H.candidate_features(_segs(read).withColumn("score", F.length("seg").cast("double")), "seg", ["score"], [counts, counts], terms)
    at = lambda i: F.get("features", F.lit(i))
    return c.select("tag", "seg", F.size("features").alias("size"), "score", F.round(at(1), 6).alias("count_seg"), at(6).alias("of_four"), at(22).alias("of_twenty"), F.round(at(33), 6).alias("known"))


@reg.query("lexicon_coverage", f"WITH {_TAGS}, {_GOLD} SELECT tag, round(coalesce(list_sum(list_transform(list_filter(string_split(lower(gold), ' '), lambda x: x IN ('mask', 'masks', 'up', 'for', 'all', 'home', 'now')), lambda x: length(x))), 0) / len(string_split(gold, ' ')), 6) AS coverage FROM gold")
def lexicon_coverage(read):
    return _gold(read).select("tag", F.round(H.coverage(F.col("gold"), ["mask", "masks", "up", "for", "all", "home", "now"]), 6).alias("coverage"))


def _words(read):
    return read("tweets").select(F.filter(tokens(F.regexp_replace(F.lower("tweet_json.full_text"), "[^a-z' ]", " ")), lambda t: t != "'").alias("w"))


@reg.query("beam_segment")
def beam_segment(read):
    """Five segmentations of each tag under the model of all tweets."""
    c = H.with_segments(cut_lineage(_tags(read)), "tag", _words(read), "w", 5)
    return c.select("tag", F.posexplode("candidates").alias("pos", "c")).select("tag", (F.col("pos") + 1).alias("rank"), "c.seg", F.round("c.score", 6).alias("score"))


def _tag_pairs(read, tags: DataFrame) -> DataFrame:
    """(tag, a, b, x, y): all ordered pairs of the five candidates of each tag, with both vectors and the difference of labels."""
    cand = cut_lineage(H.with_segments(tags, "tag", _words(read), "w", 5)).withColumn("gold", F.array_join(camel_split(F.col("tag")), " "))
    rows = cand.select("tag", "gold", F.explode("candidates").alias("c")).select("tag", "c.seg", "c.score", H.edit_label(F.col("c.seg"), F.array("gold")).alias("label"))
    feats = rows.select("tag", "seg", "label", F.concat(F.array(F.col("score"), *H.word_shapes(F.col("seg"))), H.length_histogram(F.col("seg"))).alias("x"))
    return R.training_pairs(feats, "tag", "seg", "label", "x").where("a <> b")


def _reranked(read, tags: DataFrame) -> DataFrame:
    """(tag, seg, rank) of ``tags``, whose lineage is cut: they are read several times."""
    both = cut_lineage(_tag_pairs(read, tags))
    scorer = R.fit_pairs(both, ["tag", "a", "b"], "x", "y")
    return R.rerank(both.select("tag", "a", "b", scorer(F.col("x")).alias("score")), "tag")


@reg.query("rerank_greedy")
def rerank_greedy(read):
    """Candidates of the beam search reordered by a pair network trained on all pairs' edit labels of the tags' own capitals."""
    return _reranked(read, cut_lineage(_tags(read)))


@reg.query("hashtag_words")
def hashtag_words(read):
    """The whole way of a tag: without its sign, five segmentations, reordered where there are several; and texts written with the best."""
    tags = cut_lineage(_tags(read))
    best = _reranked(read, tags).where("rank = 1").select("tag", "seg")
    only = tags.join(best.select("tag"), "tag", "left_anti").withColumn("seg", F.col("tag"))  # a single way needs no order
    t = H.replace_tags(read("rated_tweets"), "rating_id", "full_text", best.unionByName(only))
    return t.select("rating_id", F.md5("full_text").alias("text_md5"))


@reg.query("hashtag_text", rf"""WITH {_TAGS}, {_GOLD}, t AS (SELECT rating_id, list_filter(string_split_regex(full_text, '[{X.WHITE}]+'), lambda x: x <> '') AS w FROM rated_tweets), u AS (SELECT rating_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM t)
    SELECT rating_id, md5(lower(string_agg(coalesce(gold, x), ' ' ORDER BY i))) AS text_md5 FROM u LEFT JOIN gold ON starts_with(x, '#') AND length(x) > 1 AND gold.tag = substr(x, 2) GROUP BY 1""")
def hashtag_text(read):
    """Texts with their tags written out as words."""
    t = H.replace_tags(read("rated_tweets"), "rating_id", "full_text", _gold(read), seg="gold")
    return t.select("rating_id", F.md5("full_text").alias("text_md5"))


_LABELLED = f"{_CANDS}, lab AS (SELECT tag, c AS seg, (-levenshtein(lower(c), lower(gold)))::DOUBLE AS label FROM (SELECT tag, gold, unnest(cands) AS c FROM cand))"


def _labelled(read):
    return edit_label(read).withColumn("x", F.array(F.length("seg").cast("double")))


@reg.query("pairs_mse", f"WITH {_TAGS}, {_GOLD}, {_LABELLED} SELECT p.tag, p.seg AS a, q.seg AS b, length(p.seg) + length(q.seg) AS both, p.label - q.label AS y FROM lab p JOIN lab q USING (tag)")
def pairs_mse(read):
    p = R.training_pairs(_labelled(read), "tag", "seg", "label", "x", "mse")
    return p.select("tag", "a", "b", (F.get("x", F.lit(0)) + F.get("x", F.lit(1))).cast("bigint").alias("both"), "y")


@reg.query("pairs_margin", f"WITH {_TAGS}, {_GOLD}, {_LABELLED} SELECT p.tag, p.seg AS a, q.seg AS b, sign(p.label - q.label)::DOUBLE AS y FROM lab p JOIN lab q USING (tag) WHERE p.label <> q.label")
def pairs_margin(read):
    return R.training_pairs(_labelled(read), "tag", "seg", "label", "x", "margin").select("tag", "a", "b", "y")
