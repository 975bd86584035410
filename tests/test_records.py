"""Nested records, near points and redeliveries: brute force and edge cases."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumage.operators import dewey
from plumage.operators.dedup import OpenRange, SeenRanges, mark_redeliveries, producer_of, sequence_of
from plumage.operators.spatial import cover_region, near_pairs, points_in_regions

# ---- nested records --------------------------------------------------------------------------------


def children(obj):
    return {(r["tweet_id"], r["child_kind"], r["pos"], r["child_key"]) for r in dewey.tweet_children(obj)}


def test_labels_and_truncation():
    nodes = dewey.label_nodes({"a": [1, {"b": None}], "c.d": "x"})
    assert nodes == [("", "", "object", None), ("0", "a", "list", None), ("0.0", "a[]", "number", "1"), ("0.1", "a[]", "object", None), ("0.1.0", "a[].b", "null", None), ("1", "c%2Ed", "string", "x")]
    for label, *_ in nodes[1:]:
        assert dewey.parent_of(label) in {n[0] for n in nodes}
    assert dewey.parent_of("") is None and dewey.ordinal_of("0.12") == 12


def test_children_of_nested_tweets():
    t = {
        "id": 1, "user": {"id_str": "9", "entities": {"url": {"urls": [None, {"expanded_url": "u1"}]}, "description": {"urls": {"expanded_url": "u2"}}}},
        "place": {"id": "p", "contained_within": [{"id": "a"}]},
        "entities": {"hashtags": {"text": "bare"}, "user_mentions": [None, {"id": "7"}], "urls": None},
        "retweeted_status": {"id_str": "2", "extended_tweet": {"entities": {"urls": [{"expanded_url": "full"}]}}, "entities": {"urls": [{"expanded_url": "cut"}]}, "quoted_status": {"id": 3, "user": {"name": "no id"}}},
        "x": {"retweeted_status": {"id": 99}},
    }
    assert children(t) == {
        (1, "user", 0, "9"), (1, "user_url", 1, "u1"), (1, "user_url", 2, "u2"), (1, "place", 0, "p"), (1, "area", 0, "a"), (1, "hashtag", 0, "bare"), (1, "mention", 1, "7"),
        (1, "retweeted_status", 0, "2"), (2, "url", 0, "full"), (2, "quoted_status", 0, "3"),
    }


def test_tweet_lines_edge_cases(spark):
    deep = "[" * 20_000 + "]" * 20_000
    lines = [None, "", "not json", '{"id": 1', "[1]", "3", '{"id": NaN}', '{"id": 99999999999999999999, "user": {"id": true}}', '{"id":1,"entities":{"hashtags":[{"text":"\\ud83d"}]}}', deep, json.dumps({"id": 5, "entities": {"hashtags": [{"text": "x" * 500_000}]}})]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(lines)], "line_id long, raw_line string, tweet_id string")
    got = {(r.line_id, r.tweet_id, r.child_kind, len(r.child_key)) for r in dewey.tweet_child_table(df).collect()}
    assert got == {(8, 1, "hashtag", 1), (10, 5, "hashtag", 500_000)}
    assert dewey.tweet_child_table(df.limit(0)).count() == 0
    twice = df.where("line_id = 10").union(df.where("line_id = 10"))
    assert dewey.tweet_child_table(twice).count() == 2


def test_path_tables(spark):
    df = spark.createDataFrame([(1, '{"u":[{"a":1,"b":"x"},{"a":2}]}'), (2, None)], "k long, j string")
    nodes = dewey.dewey_nodes(df, ["k"], "j")
    got = {(r.label, r.parent_label, r.a, r.b) for r in dewey.path_table(nodes, ["k"], "u[]", ["a", "b"]).collect()}
    assert got == {("0.0", "0", "1", "x"), ("0.1", "0", "2", None)}


# ---- near points -----------------------------------------------------------------------------------


def metres(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    s = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(s)))


@pytest.mark.parametrize("centre", [(0, 0), (45, -75), (-18, 180), (70, 20), (89.399, 10), (89.9995, 0), (-89.9999, 5), (90, 0)])
def test_near_against_brute_force(spark, centre):
    rng = random.Random(str(centre))
    pts = []
    for i in range(120):
        lat = max(-90.0, min(90.0, centre[0] + rng.uniform(-0.003, 0.003)))
        lon = centre[1] + rng.uniform(-0.003, 0.003) / max(0.001, math.cos(math.radians(lat)))
        pts.append((i, lat, (lon + 180) % 360 - 180))
    pts += [(200, *pts[0][1:]), (201, *pts[0][1:])]
    df = spark.createDataFrame([*pts, (900, None, 1.0), (901, 95.0, 1.0), (None, 1.0, 1.0), (902, 1.0, float("nan"))], "k long, lat double, lon double").withColumn("metres", F.lit("clash"))
    got = {(r.key_a, r.key_b) for r in near_pairs(df, "k", "lat", "lon", 100.0).collect()}
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and metres(a[1:], b[1:]) <= 100}
    assert got == want and (0, 200) in got
    assert near_pairs(df.limit(0), "k", "lat", "lon", 100.0).count() == 0


def odd(rings, x, y):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                n += 1
    return n % 2 == 1


def test_regions_against_brute_force(spark):
    rng = random.Random(4)
    star = [[round(math.cos(i / 20 * 2 * math.pi) * (2 if i % 2 else 5) + 10, 5), round(math.sin(i / 20 * 2 * math.pi) * (2 if i % 2 else 5) + 50, 5)] for i in range(20)]
    zones = [(1, [star]), (2, [[[178, -20], [184, -20], [184, -16], [178, -16]], [[179.5, -19], [180.5, -19], [180.5, -17], [179.5, -17]]]), (3, [[[-10, -5], [-10, 5], [20, 5], [20, -5], [-10, -5]]]), (4, None), (5, [[[1.0, 1.0], [2.0, 2.0]]]), (6, [None, []])]
    pts = [(i, rng.uniform(44, 56), rng.uniform(4, 16)) for i in range(300)] + [(1000 + i, rng.uniform(-21, -15), (rng.uniform(177, 185) + 180) % 360 - 180) for i in range(300)] + [(2000 + i, rng.uniform(-7, 7), rng.uniform(-12, 22)) for i in range(200)]
    z = spark.createDataFrame([(k, [[[float(v) for v in q] for q in r] if r is not None else None for r in rs] if rs is not None else None) for k, rs in zones], "zone_id int, rings array<array<array<double>>>")
    p = spark.createDataFrame([*pts, (None, 1.0, 1.0), (1, None, 1.0)], "k long, lat double, lon double").withColumn("zone_id", F.lit("clash"))
    got = {(r.k, r.zone_id) for r in points_in_regions(p, "k", "lat", "lon", z, "zone_id", "rings").collect()}
    want = {(k, zid) for k, lat, lon in pts for zid, rs in zones if rs and zid < 4 for s in (-360, 0, 360) if odd(rs, lon + s, lat)}
    assert got == want and {zid for _, zid in got} == {1, 2, 3}
    shuffled = {(r.k, r.zone_id) for r in points_in_regions(p, "k", "lat", "lon", z, "zone_id", "rings", broadcast_rows=0).collect()}
    assert shuffled == want
    assert points_in_regions(p.limit(0), "k", "lat", "lon", z, "zone_id", "rings").count() == 0
    assert points_in_regions(p, "k", "lat", "lon", z.limit(0), "zone_id", "rings").count() == 0


def test_cover_marks_inner_ranges():
    c = cover_region([[[0, 0], [10, 0], [10, 10], [0, 10]]])
    assert any(r[3] for r in c) and any(not r[3] for r in c)
    assert all(a[1] < b[0] for a, b in zip(c, c[1:]))


# ---- redeliveries ----------------------------------------------------------------------------------


def test_seen_ranges():
    s = SeenRanges()
    assert s.accept(np.array([3, 1, 2, 2, 250, 255, 256, 257])).tolist() == [True, True, True, False, True, True, True, True]
    assert list(zip(s.lo, s.hi)) == [(1, 3), (250, 250), (255, 257)]
    assert s.accept(np.array([0, 4, 2, 251, 256])).tolist() == [True, True, False, True, False]
    assert list(zip(s.lo, s.hi)) == [(0, 4), (250, 251), (255, 257)]


def test_open_range_is_the_only_state():
    """Rising numbers, in whatever batches, are judged like by the whole set of ranges; the state stays one range."""
    rng = np.random.default_rng(1)
    producer, seq = rng.integers(0, 5, 4000), rng.integers(-300, 300, 4000)
    order = np.lexsort((seq, producer))
    producer, seq = producer[order], seq[order]
    for cuts in ([], [1, 2, 3, 1999], sorted(rng.integers(0, 4000, 60))):
        r = OpenRange()
        got = np.concatenate([r.accept(p, s) for p, s in zip(np.split(producer, cuts), np.split(seq, cuts))])
        sets = {p: SeenRanges() for p in range(5)}
        want = np.zeros(4000, bool)
        for p in range(5):
            want[producer == p] = sets[p].accept(seq[producer == p])
        assert (got == want).all() and r.closed + 1 == sum(len(s.lo) for s in sets.values()) and (r.lo, r.hi) == (sets[4].lo[-1], sets[4].hi[-1])


def test_ten_million_sparse_numbers_of_one_task():
    r, took = OpenRange(), 0
    for k in range(1000):
        took += int(r.accept(np.zeros(10_000, np.int32), (np.arange(10_000, dtype=np.int64) + k * 10_000) * 7).sum())
    assert took == 10_000_000 and r.closed == took - 1


def test_numbers_fall_into_worker_and_sequence(spark):
    ns = [0, 1, -1, 2**63 - 1, -(2**63), 1_300_000_000_123_456_789, 5 << 12, 7 << 22 | 5 << 12 | 9]
    df = spark.createDataFrame([(n,) for n in ns], "n long").select("n", producer_of(F.col("n")).alias("p"), sequence_of(F.col("n")).alias("s"))
    got = {r.n: (r.p, r.s) for r in df.collect()}
    assert got[5 << 12] == (5, 0) and got[7 << 22 | 5 << 12 | 9] == (5, 7 << 12 | 9) and len(set(got.values())) == len(ns)
    assert all((s >> 12) << 22 | p << 12 | s & 4095 == n for n, (p, s) in got.items())


def test_redeliveries_against_brute_force(spark):
    rng = random.Random(7)
    t0 = dt.datetime(2020, 1, 1)
    rows = []
    for i in range(3000):
        hot = rng.random() < 0.4
        n = 77 if hot else rng.choice([None, rng.randrange(400), 2**40 + rng.randrange(300), -5])
        key = rng.choice([None, "bad-1", "bad-2", ""]) if n is None else str(n)
        rows.append((i, n, key, t0 + dt.timedelta(seconds=rng.randrange(50)) if rng.random() < 0.95 else None))
    df = spark.createDataFrame(rows, "d long, n long, k string, at timestamp_ntz").withColumn("redelivered", F.lit("clash")).repartition(7)
    got = {r.row_id: r.redelivered for r in mark_redeliveries(df, F.col("d"), F.col("n"), F.col("at"), F.col("k")).collect()}
    best = {}
    for d, n, k, at in rows:
        ident = ("n", n) if n is not None else ("k", k) if k is not None else ("row", d)
        order = (at or dt.datetime.max, d)
        if ident not in best or order < best[ident]:
            best[ident] = order
    keep = {o[1] for o in best.values()}
    assert got == {r[0]: r[0] not in keep for r in rows}
    assert mark_redeliveries(df.limit(0), F.col("d"), F.col("n"), F.col("at")).count() == 0
