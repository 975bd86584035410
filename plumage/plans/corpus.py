"""Queries of the general operators for collected records: p1, p3 and p5."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumage.operators.dedup import mark_redeliveries
from plumage.operators.dewey import dewey_nodes, path_summary, path_table, tweet_child_table
from plumage.operators.spatial import near_pairs, points_in_regions
from plumage.operators.tweets import tweet_id, tweet_points
from plumage.plans.registry import Registry

reg = Registry()


_ID = lambda o: f"CASE WHEN json_type({o}, '$.id') IN ('UBIGINT', 'BIGINT') OR json_type({o}, '$.id') = 'VARCHAR' AND regexp_full_match({o}->>'$.id', '[0-9]+') THEN {o}->>'$.id' WHEN regexp_full_match({o}->>'$.id_str', '[0-9]+') THEN {o}->>'$.id_str' END"
#: A list's elements with their positions; a bare object is the only one.
_EACH = lambda o, path: f"unnest(CASE json_type({o}, '{path}') WHEN 'ARRAY' THEN list_zip(range(len(({o}->'{path}')::JSON[])), ({o}->'{path}')::JSON[]) WHEN 'OBJECT' THEN [(0, {o}->'{path}')] END)"
_P1 = f"""WITH RECURSIVE tw AS (SELECT line_id, raw_line::JSON AS j FROM tweet_lines WHERE CASE WHEN json_valid(raw_line) THEN json_type(raw_line::JSON) = 'OBJECT' END
    UNION ALL SELECT line_id, n.n FROM tw, LATERAL (SELECT unnest([j->'$.retweeted_status', j->'$.quoted_status']) AS n) n WHERE json_type(n.n) = 'OBJECT'),
  t AS (SELECT line_id, j, ({_ID("j")})::BIGINT AS tweet_id, CASE WHEN json_type(j, '$.extended_tweet.entities') = 'OBJECT' THEN j->'$.extended_tweet.entities' ELSE j->'$.entities' END AS e, j->'$.user' AS u FROM tw),
  urls AS (SELECT line_id, tweet_id, j, u, CASE json_type(u, '$.entities.url.urls') WHEN 'ARRAY' THEN json_array_length(u, '$.entities.url.urls') WHEN 'OBJECT' THEN 1 ELSE 0 END AS k FROM t),
  c AS (SELECT line_id, tweet_id, 'user' AS child_kind, 0 AS pos, {_ID("u")} AS child_key FROM t WHERE json_type(u) = 'OBJECT'
    UNION ALL SELECT line_id, tweet_id, 'user_url', x[1], x[2]->>'$.expanded_url' FROM (SELECT line_id, tweet_id, {_EACH("u", "$.entities.url.urls")} AS x FROM urls)
    UNION ALL SELECT line_id, tweet_id, 'user_url', x[1] + k, x[2]->>'$.expanded_url' FROM (SELECT line_id, tweet_id, k, {_EACH("u", "$.entities.description.urls")} AS x FROM urls)
    UNION ALL SELECT line_id, tweet_id, 'place', 0, j->>'$.place.id' FROM t
    UNION ALL SELECT line_id, tweet_id, 'area', x[1], x[2]->>'$.id' FROM (SELECT line_id, tweet_id, {_EACH("j", "$.place.contained_within")} AS x FROM t)
    UNION ALL SELECT line_id, tweet_id, 'mention', p, {_ID("v")} FROM (SELECT line_id, tweet_id, x[1] AS p, x[2] AS v FROM (SELECT line_id, tweet_id, {_EACH("e", "$.user_mentions")} AS x FROM t))
    UNION ALL SELECT line_id, tweet_id, 'hashtag', x[1], x[2]->>'$.text' FROM (SELECT line_id, tweet_id, {_EACH("e", "$.hashtags")} AS x FROM t)
    UNION ALL SELECT line_id, tweet_id, 'url', x[1], x[2]->>'$.expanded_url' FROM (SELECT line_id, tweet_id, {_EACH("e", "$.urls")} AS x FROM t)
    UNION ALL SELECT line_id, tweet_id, 'retweeted_status', 0, {_ID("v")} FROM (SELECT line_id, tweet_id, j->'$.retweeted_status' AS v FROM t) WHERE json_type(v) = 'OBJECT'
    UNION ALL SELECT line_id, tweet_id, 'quoted_status', 0, {_ID("v")} FROM (SELECT line_id, tweet_id, j->'$.quoted_status' AS v FROM t) WHERE json_type(v) = 'OBJECT')
  SELECT DISTINCT line_id, tweet_id, child_kind, pos::INT AS pos, child_key FROM c WHERE child_key IS NOT NULL"""


@reg.query("p1_found", _P1)
def p1_found(read):
    return tweet_child_table(read("tweet_lines"))


@reg.query(
    "p1_paths",
    r"""WITH n AS (SELECT regexp_replace(regexp_replace(t.fullkey, '^\$\.?', ''), '\[\d+\]', '[]', 'g') AS path, CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind
         FROM (SELECT raw_line FROM tweet_lines WHERE json_valid(raw_line)) l, json_tree(l.raw_line::JSON) t)
       SELECT path, count(*) AS nodes, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM n GROUP BY path""",
)
def p1_paths(read):
    """The schema found in all lines: how often each path occurs and as what."""
    return path_summary(dewey_nodes(read("tweet_lines"), ["line_id"], "raw_line"))


@reg.query(
    "p1_users",
    """SELECT line_id, j->>'$.user.id_str' AS id_str, j->>'$.user.screen_name' AS screen_name, j->>'$.user.location' AS location
       FROM (SELECT line_id, CASE WHEN json_valid(raw_line) THEN raw_line::JSON END AS j FROM tweet_lines)
       WHERE json_type(j, '$.user') = 'OBJECT'""",
)
def p1_users(read):
    """One of the flat tables: the outer tweets' users."""
    nodes = dewey_nodes(read("tweet_lines"), ["line_id"], "raw_line")
    return path_table(nodes, ["line_id"], "user", ["id_str", "screen_name", "location"]).drop("label", "parent_label")


@reg.query(
    "p3_found",
    """WITH t AS (SELECT DISTINCT ON (k) coalesce(tweet_json.id, try_cast(tweet_json.id_str AS BIGINT)) AS k, tweet_json.geo.coordinates AS g,
                 flatten(tweet_json.place.bounding_box.coordinates) AS b FROM tweets),
       p AS (SELECT k, g IS NOT NULL AND abs(g[1]) <= 90 AND NOT (g[1] = 0 AND g[2] = 0) AS ok, g, b FROM t WHERE k IS NOT NULL),
       q AS (SELECT k, ok, CASE WHEN ok THEN g[1] ELSE (list_min(list_transform(b, lambda e: e[2])) + list_max(list_transform(b, lambda e: e[2]))) / 2 END AS lat,
                    CASE WHEN ok THEN g[2] ELSE (list_min(list_transform(b, lambda e: e[1])) + list_max(list_transform(b, lambda e: e[1]))) / 2 END AS lon FROM p),
       near AS (SELECT a.k AS ka, c.k AS kb FROM q a JOIN q c ON a.k < c.k AND a.ok AND c.ok AND abs(a.lat - c.lat) < 0.001
                WHERE 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(c.lat - a.lat) / 2), 2)
                      + cos(radians(a.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - a.lon) / 2), 2)))) <= 100),
       r AS (SELECT zone_id, unnest(rings) AS ring FROM zones),
       e AS (SELECT zone_id, unnest(list_transform(range(1, len(ring) + 1), lambda i: {'a': ring[i], 'b': ring[i % len(ring) + 1]})) AS s FROM r),
       x AS (SELECT q.k, e.zone_id, turn.o, count(*) FILTER (WHERE (s.a[2] > lat) <> (s.b[2] > lat)
                    AND lon + turn.o < s.a[1] + (lat - s.a[2]) * (s.b[1] - s.a[1]) / nullif(s.b[2] - s.a[2], 0)) AS n
             FROM q, e, (VALUES (-360.0), (0.0), (360.0)) turn(o) WHERE lat IS NOT NULL GROUP BY ALL)
       SELECT 'near' AS kind, ka AS key_a, kb AS key_b FROM near
       UNION ALL SELECT DISTINCT 'inside', k, zone_id::BIGINT FROM x WHERE n % 2 = 1""",
)
def p3_found(read):
    points = tweet_points(read("tweets"))
    near = near_pairs(points.where("is_geo"), "tweet_id", "lat", "lon", 100.0)
    inside = points_in_regions(points, "tweet_id", "lat", "lon", read("zones"), "zone_id", "rings")
    return near.select(F.lit("near").alias("kind"), "key_a", "key_b").unionByName(
        inside.select(F.lit("inside").alias("kind"), F.col("tweet_id").alias("key_a"), F.col("zone_id").cast("bigint").alias("key_b"))
    )


def _deliveries(read):
    return mark_redeliveries(read("tweets"), F.col("delivery_id"), tweet_id(), F.col("received_at"), F.col("tweet_json.id_str"))


_RANKED = """SELECT delivery_id, row_number() OVER (PARTITION BY coalesce(tweet_json.id, try_cast(tweet_json.id_str AS BIGINT))
             ORDER BY received_at, delivery_id) AS r FROM tweets"""


@reg.query("p5_found", f"SELECT delivery_id FROM ({_RANKED}) WHERE r > 1")
def p5_found(read):
    return _deliveries(read).where("redelivered").select(F.col("row_id").alias("delivery_id"))


@reg.query("p5_kept", f"SELECT delivery_id FROM ({_RANKED}) WHERE r = 1")
def p5_kept(read):
    return _deliveries(read).where("NOT redelivered").select(F.col("row_id").alias("delivery_id"))
