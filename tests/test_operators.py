"""Hand-made values and invariants of the reference's operators."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from plumage.functions import text as X
from plumage.functions.geo import haversine_km, vincenty_km
from plumage.functions.porter import stem
from plumage.operators import annotate as A
from plumage.operators import features as T
from plumage.operators import folds as O
from plumage.operators import hashtag as H
from plumage.operators import knn as K
from plumage.operators import locate as L
from plumage.operators import metrics as M
from plumage.operators import rank as R
from plumage.operators.tweets import at_path
from plumage.operators.users import nearest_entry, tag_country


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_information_scores(spark):
    for n, mi, chi in (((2, 1, 1, 4), 0.158727, 1.686521), ((0, 3, 2, 3), 0.203611, 1.491864), ((3, 0, 0, 5), 0.951887, 7.685753)):
        c = [F.lit(float(x)) for x in n]
        r = one(spark, T.mutual_information(*c).alias("mi"), T.chi_square(*c).alias("chi"))
        assert r.mi == pytest.approx(mi, abs=1e-6) and r.chi == pytest.approx(chi, abs=1e-6)


def test_split_sizes(spark):
    def sizes(fn, n, k):
        r = spark.range(n).select(fn(F.col("id"), F.lit(n), k).alias("f")).groupBy("f").count().orderBy("f").collect()
        return [x["count"] for x in r]

    assert sizes(O.even_split, 7, 3) == [2, 3, 2] and sizes(O.even_split, 5, 2) == [2, 3] and sizes(O.even_split, 10, 4) == [2, 3, 3, 2]
    assert sizes(O.even_split, 125, 10) == [12, 13, 13, 12, 12, 13, 13, 12, 12, 13]
    assert sizes(O.floor_split, 7, 3) == [2, 2, 3] and sizes(O.floor_split, 46, 5) == [9, 9, 9, 9, 10]


def test_numbering_is_a_permutation(spark):
    n = O.numbered(spark.range(1000).withColumn("g", F.col("id") % 3), "id", group=["g"])
    for g in range(3):
        assert sorted(r.i for r in n.where(f"g = {g}").collect()) == list(range(334 if g == 0 else 333))
    assert sorted(r.i for r in O.numbered(spark.range(500), "id").collect()) == list(range(500))


def test_bayes_by_hand(spark):
    d = spark.createDataFrame([(1, "c1", 0, ["a", "a", "b"]), (2, "c2", 0, ["b", "c"])], "doc long, class string, fold int, tokens array<string>")
    cond = {(r["class"], r.term): r.cond for r in T.train_bayes(d, 1).where("v = -1").collect()}
    assert cond[("c1", "a")] == 0.5 and cond[("c1", "b")] == pytest.approx(2 / 6) and cond[("c2", "a")] == pytest.approx(0.2) and cond[("c2", "b")] == pytest.approx(0.4)
    test = spark.createDataFrame([(-1, 9, ["a", "b", "z"]), (-1, 10, ["z"])], "v int, doc long, tokens array<string>")
    s = T.bayes_scores(test, T.train_bayes(d, 1), T.priors(d, 1))
    got = {(r.doc, r["class"]): r.score for r in s.collect()}
    assert got[(9, "c1")] == pytest.approx(-3.584963, abs=1e-6) and got[(9, "c2")] == pytest.approx(-4.643856, abs=1e-6)
    assert {(r.doc, r.guess) for r in T.best_class(s).collect()} == {(9, "c1"), (10, "c1")}


def test_sweep_equals_single_models(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], i % 3, [f"w{int(x)}" for x in rng.integers(0, 12 + 3 * (i % 2), 8)]) for i in range(60)]
    d = spark.createDataFrame(rows, "doc long, class string, fold int, tokens array<string>")
    scored = T.scores(d, 3, T.mutual_information)
    got = {r.k: r.accuracy for r in T.sweep(d, 3, scored, [2, 5]).collect()}
    for k in (2, 5):
        p = T.cross_validate(d, 3, T.top_terms(scored, k)).join(d.select("doc", "class"), "doc")
        by = p.groupBy("v").agg(F.avg((F.col("guess") == F.col("class")).cast("double")).alias("a")).agg(F.avg("a")).first()[0]
        assert got[k] == pytest.approx(by)


def test_metrics_by_hand(spark):
    p = spark.createDataFrame([("a", "a")] * 3 + [("a", "b"), ("b", "b"), ("c", "a")], "class string, guess string")
    conf = M.confusion(p)
    assert conf.agg(F.sum("n")).first()[0] == 6 and conf.count() == 9
    per = {r["class"]: r for r in M.per_class(M.one_vs_rest(conf)).collect()}
    assert per["a"].precision == 0.75 and per["a"].recall == 0.75 and per["c"].precision is None and per["c"].recall == 0 and per["c"].f1 is None
    m = M.macro(M.one_vs_rest(conf), conf).first()
    assert m.precision == pytest.approx((0.75 + 0.5 + 0) / 3) and m.accuracy == pytest.approx(4 / 6) and m.pooled_accuracy == pytest.approx(14 / 18)
    f = spark.createDataFrame([("a", 0.5), ("a", None), ("b", 0.2), ("b", 0.4)], "class string, p double")
    assert {r["class"]: r.p for r in M.fold_average(f, ["class"], ["p"]).collect()} == {"a": None, "b": pytest.approx(0.3)}


def test_medoid_by_hand(spark):
    pts = [(45.0, -75.0), (45.5, -73.5), (43.7, -79.4), (45.4, -75.7)]
    df = spark.createDataFrame([("u", i, *p) for i, p in enumerate(pts)] + [("two", 5, 1.0, 1.0), ("two", 3, 2.0, 2.0), ("few", 0, 1.0, None)], "u string, o int, lat double, lon double")
    got = {r.u: (r.lat, r.lon) for r in L.medoid(df, "u", "o").collect()}
    assert got == {"u": (45.0, -75.0), "two": (2.0, 2.0)}
    assert {r.u for r in L.medoid(df, "u", "o", min_points=3).collect()} == {"u"}
    r = one(spark, haversine_km(F.lit(53.5), F.lit(-113.5), F.lit(51.0), F.lit(-114.0)).alias("d"))
    assert r.d == pytest.approx(280.061821, abs=1e-5)
    assert vincenty_km(53.5, -113.5, 51.0, -114.0) == pytest.approx(280.06, rel=0.005)
    assert vincenty_km(0, 0, 0, 0) == 0 and vincenty_km(-37.951033, 144.424868, -37.652821, 143.926496) == pytest.approx(54.972271, abs=1e-3)


def test_medoid_thinning_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [("u", i, float(a), float(b)) for i, (a, b) in enumerate(np.concatenate([rng.normal([45, -75], 1.5, (150, 2)), rng.normal([-30, 140], 4, (40, 2))]).round(4))]
    df = spark.createDataFrame(rows, "u string, o int, lat double, lon double")
    assert L.medoid(df, "u", "o", cells_from=1).collect() == L.medoid(df, "u", "o").collect()


def test_homes(spark):
    tight = [("a", i, 45.0 + i * 0.001, -75.0) for i in range(5)]
    ring = [("b", i, 45.0 + 0.06 * math.cos(i * 1.2566), -75.0 + 0.085 * math.sin(i * 1.2566)) for i in range(5)]
    wide = [("c", i, 45.0 + i * 0.1, -75.0) for i in range(9)]
    df = spark.createDataFrame([*tight, *ring, *wide], "u string, o int, lat double, lon double")
    assert {r.u for r in L.homes(df, "u", "o").collect()} == {"a", "b"}


def test_graph_and_spreading(spark):
    e = spark.createDataFrame([("a", "b", 2), ("b", "a", 1), ("a", "a", 1), ("c", "a", 1), ("b", "d", 1), ("d", "b", 9)], "src string, dst string, weight long")
    rec = L.reciprocal(e)
    assert {(r.src, r.dst) for r in rec.collect()} == {("a", "b"), ("b", "a"), ("b", "d"), ("d", "b")}
    seeds = spark.createDataFrame([("a", 10.0, 10.0), ("z", 1.0, 1.0), ("d", None, 2.0)], "user_id string, lat double, lon double")
    out = {r.user_id: (r.lat, r["round"]) for r in L.spread_locations(rec, seeds, 2).collect()}
    assert out == {"a": (10.0, 0), "z": (1.0, 0), "b": (10.0, 1), "d": (10.0, 2)}


def test_tagger_truth_table(spark):
    rows = [
        ("CA", None, "x", "canadian", True, "place object"), ("US", (45.0, -75.0), "toronto", None, False, "place object"), (None, (45.0, -75.0), "x", None, True, "coordinates"), (None, (10.0, 10.0), "toronto", None, False, "coordinates"),
        (None, None, "In TORONTO", "canadian", True, "user profile location"), (None, None, None, "proud Albertan", True, "user profile description"), (None, None, "Paris", None, None, None),
    ]
    schema = "i int, tweet_json struct<place:struct<country_code:string>,geo:struct<type:string,coordinates:array<double>>,user:struct<location:string,description:string>>"
    df = spark.createDataFrame([(i, ((p,) if p else None, ("Point", list(g)) if g else None, (loc, d))) for i, (p, g, loc, d, *_) in enumerate(rows)], schema)
    gaz = spark.createDataFrame([(1, 45.1, -75.2, "CA"), (2, 9.0, 9.0, "XX")], "place_id int, lat double, lon double, country_code string")
    got = {r.i: (r.is_canadian, r.method) for r in tag_country(df, gaz).collect()}
    assert got == {i: (v, m) for i, (*_, v, m) in enumerate(rows)}


def test_rater_decisions(spark):
    def rate(i, m, lang, tid="1", text="t"):
        return (i, tid, text, m, lang)

    a = [rate(0, "N", "E"), rate(1, None, None), rate(2, None, "E"), rate(3, "N", "E"), rate(4, "N", None), rate(5, "N", "E", "1", "x"), rate(6, "N", "E", None), rate(300, None, None)]
    b = [rate(0, "N", "E"), rate(1, None, None), rate(2, "N", "E"), rate(3, "A", "E"), rate(4, "N", None), rate(5, "N", "E", "2", "y"), rate(6, "N", "E"), rate(300, None, None), rate(301, "N", "E")]
    df = spark.createDataFrame([("f", r, *x) for r, xs in (("a", a), ("b", b)) for x in xs], "file_name string, rater string, row_idx int, tweet_id string, full_text string, mask_sentiment string, language string")
    rev = A.review(A.pair_raters(df, "a", "b"))
    assert {r.row_idx: r.finding for r in rev.collect()} == {0: "agree", 1: "blank both", 2: "blank 1", 3: "mismatch", 4: "blank 1", 5: "abort", 6: "skip", 300: "skip"}
    assert {(r.rater, r.rows) for r in A.blank_report(rev).collect()} == {(1, "3,4,6"), (2, "3")}


def test_segmentation_measures(spark):
    df = spark.createDataFrame([(["stay safe", "stays afe"], ["Stay Safe"]), (["covid19", "covid 19"], ["covid 19"]), (["nomask", "nom ask"], ["no mask"])], "r array<string>, g array<string>")
    m = df.agg(F.avg(H.reciprocal_rank(F.col("r"), F.col("g"))), F.avg(H.right_at(F.col("r"), F.col("g"), 1)), F.avg(H.right_at(F.col("r"), F.col("g"), 2)), F.avg(H.f_at(F.col("r"), F.col("g"), 1)), F.avg(H.f_at(F.col("r"), F.col("g"), 2))).first()
    assert list(m) == pytest.approx([0.5, 1 / 3, 2 / 3, 1 / 3, 2 / 3])


def test_beam_and_greedy():
    lm = H.LanguageModel({"no": 50, "mask": 60, "nomask": 1, "ask": 20, "nom": 1, "no mask": 30})
    assert H.segment("nomask", 3, lm)[0][0] == "no mask" and H.segment("", 3, lm) == []
    best = max((lm.phrase(w), " ".join(w)) for w in (["nomask"], ["no", "mask"], ["nom", "ask"]))
    assert best[1] == "no mask"
    s = {("x", "y"): 2, ("x", "z"): -1, ("y", "x"): -2, ("y", "z"): 4, ("z", "x"): 1, ("z", "y"): -3}
    assert [a for a, _ in R.greedy(s)] == ["y", "z", "x"]


@pytest.mark.parametrize("gated,loss", [(False, "mse"), (True, "mse"), (False, "margin"), (True, "margin")])
def test_ranker_learns(gated, loss):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 6))
    y = x[:, 0] - x[:, 3]
    tag = rng.standard_normal((400, 2))
    net = R.Ranker(3, 2 if gated else 0, 1)
    kw = dict(single=x[:, :2], tag=tag, multiword=(tag[:, 0] > 0).astype(float)) if gated else {}
    losses = net.train(x, y, loss=loss, rate=0.05, dropout=0.0, **kw)
    assert losses[-1] < 0.7 * losses[0]
    if not gated:
        p = net.predict(x)
        assert ((p > 0) == (y > 0)).mean() > 0.85


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (200, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)] + [(999, None, 1)], "id long, vec array<double>, label int")
    for metric in ("dot", "euclid"):
        got = {(r["query"], r["rank"]): r.id for r in K.neighbours(df.where("id < 20"), df.where("id >= 20").repartition(5), 4, metric).collect()}
        for q in range(20):
            s = x[20:] @ x[q] if metric == "dot" else -np.sqrt(((x[20:] - x[q]) ** 2).sum(1))
            want = sorted(range(20, 200), key=lambda i: (-round(s[i - 20], 9), i))[:4]
            assert [got[(q, r)] for r in range(1, 5)] == want
    assert K.neighbours(df.limit(0), df, 3).count() == 0


def test_neighbours_in_the_query_set(spark):
    """The nearest vector of a query is itself a query; only the own id is passed over, in every batch."""
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (20, [1.0, 0.0], 1), (1, [0.0, 1.0], 2)], "id long, vec array<double>, label int")
    for parts in (1, 3):
        for metric in ("dot", "euclid"):
            n = K.neighbours(df.where("id % 20 = 0"), df.repartition(parts), 3, metric, others=True)
            assert {(r["query"], r["rank"]): (r.id, r.label) for r in n.collect()} == {(0, 1): (20, 1), (0, 2): (1, 2), (20, 1): (0, 0), (20, 2): (1, 2)}


def test_label_spreading(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(3, 0.1, (30, 2))])
    df = spark.createDataFrame([(i, v.tolist(), (0 if i == 0 else 1 if i == 30 else -1)) for i, v in enumerate(x)], "id long, vec array<double>, label int")
    assert {r.id: r.guess for r in K.spread_labels(df).collect()} == {i: int(i >= 30) for i in range(60)}


def test_text_functions(spark):
    r = one(
        spark, X.camel_split(F.lit("StayHomeABCTest")).alias("c"), X.tokens(F.lit("  a \n b ")).alias("t"), X.tokens(F.lit(None).cast("string")).alias("n"), X.strip_urls(F.lit("go http://x.y/z now www.a.b")).alias("u"),
        X.keyword_or_phrase(F.lit("A Face Covering!")).alias("k"), X.conditional(F.lit("Not so, necessarily")).alias("x"), X.normalise_text(F.lit("The #Tag says: “Mask” up, http://t.co/a")).alias("norm"), X.id_prefix(F.lit("123456")).alias("p"), X.clean_id(F.lit("1295608968165785601.0")).alias("i"), X.clean_id(F.lit("x")).alias("j"),
    )
    assert r.c == ["Stay", "Home", "ABC", "Test"] and r.t == ["a", "b"] and r.n == [] and r.u == "go  now " and r.k and r.x and r.norm == "says mask up" and r.p == "12" and r.i == "1295608968165785601" and r.j is None


def test_porter():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "digitizer": "digit", "operator": "oper", "triplicate": "triplic", "hopeful": "hope", "revival": "reviv", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "masks": "mask", "é": "é"}
    assert {w: stem(w) for w in want} == want


def test_set_expansion(spark):
    r = one(spark, H.expand_gold(F.array(F.lit("no mask"), F.lit("don't"), F.lit("a-b"), F.lit("u.s"), F.lit("zz")), F.lit("NoMask")).alias("g"))
    assert r.g == ["no mask", "dont", "don t", "ab", "a b", "us"]


def test_treebank_like_words(spark):
    r = one(spark, X.word_tokenize(F.lit("I can't say it's $3.50, (really)... Dr. Who.")).alias("w"), X.word_tokenize(F.lit(None).cast("string")).alias("n"))
    assert r.w == ["I", "ca", "n't", "say", "it", "'s", "$", "3.50", ",", "(", "really", ")", "...", "Dr.", "Who", "."] and r.n == []


def test_embed_and_vector(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, t string")
    assert {r.id: r.vec for r in K.embed(df, "id", "t", lambda ts: np.array([[len(t), 1.0] for t in ts])).collect()} == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_unicode_white_space(spark):
    t = "no\u00a0mask\u2003now\x1fplease\u3000\u2028"
    r = one(spark, X.tokens(F.lit(t)).alias("t"), X.keyword_or_phrase(F.lit("a\u00a0mask\u202fhere")).alias("k"), X.strip_urls(F.lit("x https://a.b\u00a0c")).alias("u"), X.strip_mentions(F.lit("@a\u2009b")).alias("m"))
    assert r.t == t.split() and r.k and r.u == "x \u00a0c" and r.m == "\u2009b"


def test_word_shapes_and_tag_features(spark):
    segs = ["19 mask fans", "mask 19", "gym", "gy m", "no Mask", "no MASK", "Wear Mask", "a _ b", "42", "x", "ab42 cd"]
    got = {r.s: {k: v for k, v in r.asDict().items() if v == 1.0} for r in spark.createDataFrame([(s,) for s in segs], "s string").select("s", *H.word_shapes(F.col("s"))).collect()}
    want = {"19 mask fans": {"ddxx"}, "mask 19": {"xxdd"}, "gym": {"abbreviation"}, "gy m": set(), "no Mask": {"camel"}, "no MASK": {"camel", "xxXX"}, "Wear Mask": {"camel"}, "a _ b": {"underscore"}, "42": {"digits"}, "x": {"abbreviation"}, "ab42 cd": set()}
    assert {s: set(v) for s, v in got.items()} == want
    counts = spark.createDataFrame([("gym", 2.0), ("Gym ", 3.0), ("no mask", 1.5)], "key string, log_count double")
    terms = H.title_terms(spark.createDataFrame([("Gym (place)",), ("Saint John",), (None,)], "t string"), "t").unionByName(spark.createDataFrame([("running", "dictionary"), ("run", "slang"), (None, "slang")], "term string, kind string"))
    c = spark.createDataFrame([(1, "gym", "gym"), (2, "no Mask", "no Mask"), (3, "19 mask", "19 mask"), (4, "running", "running"), (5, "john", "jo hn")], "id long, seg string, best string")
    f = {r.id: [r[n] for n in H.TAG_FEATURES] for r in H.tag_features(c, "seg", "best", counts, terms).collect()}
    assert f[1] == [3, 1, 3.0, 3.0, 0, 0, 1, 0, 0, 1, 0, 0, 0]  # the title "gym " keeps its blank, as its word does not
    assert f[2] == [6, 0, 0, 1.5, 0, 0, 0, 0, 0, 0, 0, 0, 1] and f[3][10] == 1 and f[4][4] == 1 and f[5][:2] == [4, 0] and f[5][6] == 1
    v = {r.id: r.features for r in H.candidate_features(c.withColumn("lm", F.lit(-1.5)), "seg", ["lm"], [counts, counts], terms).collect()}
    assert all(len(x) == 34 for x in v.values()) and v[1][:3] == [-1.5, 3.0, 3.0] and v[2][3:23][1] == 1 and v[2][3:23][3] == 1
    assert v[4][30:] == [0, 0, 1, 7.0] and v[5][30:33] == [0, 1, 0]  # running: slang by its stem, known as a whole
    assert H.tag_features(c.limit(0), "seg", "best", counts, terms).count() == 0


def test_label_spreading_in_blocks(spark):
    """Beyond ``most`` points the same guesses come from blocks on the executors."""
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 3, 90)
    rows = [(i, (np.eye(3)[c] + rng.normal(0, 0.15, 3)).tolist(), int(c) if i % 6 == 0 else -1) for i, c in enumerate(centre)]
    df = spark.createDataFrame([*rows, (None, [1.0, 0.0, 0.0], 1), (500, None, 1)], "id long, vec array<double>, label int")
    one = {r.id: r.guess for r in K.spread_labels(df).collect()}
    many = {r.id: r.guess for r in K.spread_labels(df, most=40).collect()}
    assert one == many and set(one) == set(range(90)) and np.mean([one[i] == c for i, c in enumerate(centre)]) > 0.9
    none = {r.guess for r in K.spread_labels(df.withColumn("label", F.lit(-1)), most=40).collect()}
    assert none == {-1} and K.spread_labels(df.limit(0)).count() == 0


def test_euclid_neighbours_with_copies(spark):
    """Copies of a query are at distance 0 exactly, however many; ties go to the smaller id."""
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (40, 5)) * 100
    rows = [(i, (base[i % 8] if i < 60 else base[i % 40]).tolist(), f"l{i % 4}") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label string").repartition(3)
    got = {(r.query, r["rank"]): r.id for r in K.neighbours(df.where("id % 7 = 0"), df, 4, "euclid", others=True).collect()}
    for q in range(0, 100, 7):
        x = np.array([v for _, v, _ in rows])
        d = np.round(np.sqrt(((x - x[q]) ** 2).sum(1)), 9)
        want = [i for _, i in sorted((d[i], i) for i in range(100) if i != q)[:4]]
        assert [got[(q, r)] for r in range(1, 5)] == want


def test_embed_with_kept_vectors(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "x")], "id long, t string")
    kept = spark.createDataFrame([(1, [7.0, 7.0]), (1, [7.0, 7.0]), (9, [0.0]), (3, None)], "id long, vec array<double>")
    assert {r.id: r.vec for r in K.embed(df, "id", "t", lambda ts: np.array([[len(t), 1.0] for t in ts]), kept).collect()} == {1: [7.0, 7.0], 2: [0.0, 1.0], 3: [1.0, 1.0]}


def test_nearest_entry(spark):
    g = spark.createDataFrame([(2, 45.0, -75.0, "B"), (1, 45.0, -75.0, "A"), (3, -45.0, 179.9, "C"), (4, 89.9, 0.0, "D"), (5, None, 1.0, "E")], "place_id int, lat double, lon double, v string")
    p = spark.createDataFrame([(1, 45.1, -75.1), (2, -45.0, -179.9), (3, 89.9, 180.0), (4, None, 1.0), (5, 45.0, float("nan"))], "id int, lat double, lon double")
    assert {r.id: r.v for r in p.select("id", nearest_entry(F.col("lat"), F.col("lon"), g, "v", "place_id").alias("v")).collect()} == {1: "A", 2: "C", 3: "D", 4: None, 5: None}
    assert p.select(nearest_entry(F.col("lat"), F.col("lon"), g.limit(0), "v", "place_id").alias("v")).where("v IS NOT NULL").count() == 0


def test_too_many_classes_are_refused(spark):
    with pytest.raises(ValueError):
        M.confusion(spark.range(2000).selectExpr("id AS class", "id AS guess"))


def test_vincenty_on_arrays():
    d = vincenty_km(np.array([0.0, 0.0, np.nan, -37.951033]), np.array([0.0, 0.0, 0.0, 144.424868]), np.array([0.0, 0.5, 1.0, -37.652821]), np.array([0.0, 179.7, 1.0, 143.926496]))
    assert d[0] == 0 and np.isnan(d[1]) and np.isnan(d[2]) and d[3] == pytest.approx(54.972271, abs=1e-3)


def test_training_and_validation_rows(spark):
    f = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 0)], "id int, fold int")
    assert {r.id for r in O.training(f, 0, 2).collect()} == {2} and {r.id for r in O.validation(f, 0, 2).collect()} == {1, 4}
    for v, k, c in ((2, 2, "fold"), (-1, 2, "fold"), (0, 2, "other")):
        with pytest.raises(ValueError):
            O.training(f, v, k, c)


def test_paths_over_lists(spark):
    df = spark.createDataFrame([(({"x": 1}, [{"b": {"c": 5}}, None, {"b": None}]),), ((None, None),), (None,)], "t struct<s: struct<x:int>, l: array<struct<b: struct<c:int>>>>")
    assert [r.v for r in df.select(at_path(df, "t.l.b.c").alias("v")).collect()] == [[5, None, None], None, None]
    assert [r.v for r in df.select(at_path(df, "t.s.x").alias("v")).collect()] == [1, None, None]
    for bad in ("t.nope", "t.s.x.y"):
        with pytest.raises(ValueError):
            at_path(df, bad)


def test_segments_without_a_whole_model(spark):
    """Segments from each tag's own n-grams are those of the model of all texts, and no bound of n-grams is left."""
    texts = ["no mask no ride", "wear a mask", "mask up now", "it's no use", "no masks", "un related", None, ""]
    docs = spark.createDataFrame([(t.split() if t is not None else None,) for t in texts], "w array<string>")
    tags = [("#NoMask",), ("nomaskup",), ("xq",), ("NoMaskNoRide",), ("w",)]
    lm = H.LanguageModel({r.ngram: r["count"] for r in H.ngram_counts(docs, "w").collect()})
    got = {r.tag: [(c.seg, c.score) for c in r.candidates] for r in H.with_segments(spark.createDataFrame(tags, "tag string"), "tag", docs, "w", 5).collect()}
    assert got == {t.lstrip("#"): H.segment(t.lstrip("#"), 5, lm) for (t,) in tags}
    own = {r.tag: {g.ngram: g["count"] for g in r.grams} for r in H.grams_within(spark.createDataFrame([("nomask",)], "tag string"), "tag", docs, "w").collect()}
    assert own == {"nomask": {"no": 4, "a": 1, "mask": 3, "no mask": 1}}
    assert not hasattr(H, "MAX_NGRAMS")


def test_bayes_joins_leave_documents_and_terms_where_they_are(spark, tmp_path, monkeypatch):
    """Tables of terms or documents, which files make look small, aren't broadcast; both ways to meet the model agree."""
    rows = [(i, "ab"[i % 2], i % 3, [f"w{i % 2}", f"w{i % 4}", f"w{i % 7}"]) for i in range(40)]
    spark.createDataFrame(rows, "doc long, class string, fold int, tokens array<string>").write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    by_broadcast = {(r.doc, r.guess) for r in T.cross_validate(d, 3).collect()}
    monkeypatch.setattr(T, "is_small", lambda *a: False, raising=False)
    monkeypatch.setattr(T, "broadcast_if_small", lambda df, *a: df.hint("merge"))
    for df in (T.zero_filled(T.term_frequency(d, 3), "tf"), guess := T.cross_validate(d, 3)):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc, r.guess) for r in guess.collect()} == by_broadcast and len(by_broadcast) == 40


def test_pairs_are_all_fitted(spark):
    """The network is fitted to every pair: by the executors as in one process, and as by hand."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((5200, 4))
    y = x[:, 0] - x[:, 2]
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "i long, x array<double>, y double").repartition(3).cache()
    net = R.Ranker(2, seed=3)
    mean, std = x.mean(0), x.std(0) + 1e-6
    net.train((x - mean) / std, y, epochs=10, dropout=0.0)
    want = net.predict((x - mean) / std)
    for near in (10_000, 100):
        score = R.fit_pairs(df, ["i"], "x", "y", epochs=10, near=near)
        got = dict(df.select("i", score(F.col("x"))).collect())
        assert [got[i] for i in range(len(x))] == pytest.approx(want, abs=2e-6)
    assert {r[0] for r in df.limit(3).select(R.fit_pairs(df.limit(0), ["i"], "x", "y")(F.col("x"))).collect()} == {0.0}


def test_sweep_ranks_once(spark, tmp_path, monkeypatch):
    """No plan of a sweep holds the scores more than once: each reads the documents a few times."""
    rows = [(i, "ab"[i % 2], i % 3, [f"w{i % 2}", f"w{i % 4}", f"w{i % 7}"]) for i in range(40)]
    spark.createDataFrame(rows, "doc long, class string, fold int, tokens array<string>").write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    reads = []

    def noted(df):
        reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return df

    cut = T.cut_lineage
    monkeypatch.setattr(T, "cut_lineage", lambda df: cut(noted(df)))
    got = {r.k: r.accuracy for r in noted(T.sweep(d, 3, T.scores(d, 3, T.mutual_information), [2, 3])).collect()}
    assert max(reads) <= 4 and got == {2: pytest.approx(38 / 39), 3: 1.0}
    assert T.sweep(d.limit(0), 3, T.scores(d.limit(0), 3, T.mutual_information), [2]).collect() == []


def test_hashtag_words_of_many_tags(spark, tmp_path):
    """The whole way with so many tags that executors fit the network; the last plan doesn't read the tags' texts again."""
    words = [a + b for a in "bcdfghklmn" for b in ("ab", "en", "ist", "orn")]
    tags = [f"{a.capitalize()}{b.capitalize()}" for a in words for b in words if a != b][:1100]
    said = [(f"{t} #{t} #No {' '.join(words)}",) for t in tags] + [("nothing #X1 #",), (None,)]
    spark.createDataFrame(said, "full_text string").select(F.struct("full_text").alias("tweet_json")).write.parquet(str(tmp_path / "tweets.parquet"))
    rated = [(1, f"So #{tags[0]} and #No"), (2, f"#{tags[-1]} ##{tags[0]}"), (3, "none"), (4, "#Unheard")]
    spark.createDataFrame(rated, "rating_id long, full_text string").write.parquet(str(tmp_path / "rated_tweets.parquet"))
    got = queries()["rerank_greedy"](spark, str(tmp_path)).collect()
    first, by_tag = {r.tag: r.seg for r in got if r["rank"] == 1}, {}
    for r in got:
        by_tag.setdefault(r.tag, []).append(r["rank"])
    assert set(by_tag) == {*tags, "No"} and all(sorted(r) == [*range(1, len(r) + 1)] for r in by_tag.values()) and len(got) > 5 * len(tags)
    assert all(s.replace(" ", "") == t for t, s in first.items())
    w = queries()["hashtag_words"](spark, str(tmp_path))
    assert all("/rated_tweets.parquet/" in f for f in w.inputFiles())
    put = lambda t: " ".join(first.get(x.lstrip("#"), x) if x.startswith("#") else x for x in t.split()).lower()
    want = {i: hashlib.md5(put(t).encode()).hexdigest() for i, t in rated}
    assert {r.rating_id: r.text_md5 for r in w.collect()} == want
