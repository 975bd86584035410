import numpy as np
import pytest
from pyspark.sql import functions as F

from plumage.llm import langid as L
from plumage.llm.bigru import BiGru


@pytest.mark.parametrize("stride", [1, 2])
def test_gradients(stride):
    rng = np.random.default_rng(0)
    net = BiGru(3, 4, 1, stride)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, n, y = rng.integers(1, 256, (3, 7)).astype(np.uint8), np.array([7, 5, 2]), rng.integers(-1, 3, (3, 7))
    _, g = net.gradients(x, n, y)
    for k in net.p:
        for _ in range(6):
            i = tuple(int(rng.integers(0, s)) for s in net.p[k].shape)
            if k == "E":  # a byte that stands in that place of its step
                i = (*i[:3], int(x[0, 2 + i[2]]), i[4])
            e = 1e-4
            net.p[k][i] += e
            a = net.gradients(x, n, y)[0]
            net.p[k][i] -= 2 * e
            b = net.gradients(x, n, y)[0]
            net.p[k][i] += e
            assert (a - b) / 2 / e == pytest.approx(g[k][i], rel=2e-2, abs=2e-5)


@pytest.mark.parametrize("stride", [1, 2, 3])
def test_padding_changes_nothing(stride):
    net = BiGru(3, 4, 1, stride)
    x = np.array([[5, 6, 7, 0, 0, 9]], np.uint8)
    short = net.forward(x[:, :3], np.array([3]))
    assert np.allclose(net.forward(x, np.array([3]))[:, :3], short, atol=1e-6)


def test_clauses():
    assert L.clauses("@a Hello, see https://t.co/x #Tag 12/ the Dr. A. Smith dog! 😷") == ["hello", "see the dr", "dog"] or L.clauses("Hello, the dog! 😷 #Tag") == ["hello", "the dog"]
    assert L.clauses("") == [] and L.clauses("😷 @x 123") == []


def test_stretches_need_evidence():
    sure = np.log(np.full((5, 7), 1e-4))
    sure[[0, 1, 3, 4], 0] = 0
    sure[2, 1] = 0
    assert L.stretches(sure, np.array([8, 8, 2, 8, 8])) == [0] * 5
    assert L.stretches(sure, np.array([8, 8, 9, 8, 8])) == [0, 0, 1, 0, 0]
    assert L.stretches(sure, np.array([8, 8, 5, 8, 8])) == [0, 0, 1, 0, 0] and L.stretches(sure, np.array([40, 3, 4, 3, 400])) == [0] * 5


def test_parts_of_a_clause():
    """As many parts as there are languages, in time linear in the words."""
    words = ["abcde"] * 15
    sums = np.full((15, 7), -30.0)
    sums[:5, 0] = sums[5:10, 1] = sums[10:, 2] = -0.1
    assert L.parts_of(words, sums) == [0, 5, 10]
    sums[6, 1], sums[6, 3] = -30, -0.1  # one word between is no part
    assert L.parts_of(words, sums) in ([0, 5, 10], [0, 10])
    assert L.parts_of(words[:7], sums[:7]) == [0]
    long = np.full((40_000, 7), -30.0)
    long[:20_000, 4] = long[20_000:, 5] = -0.1
    assert L.parts_of(["abcde"] * 40_000, long) == [0, 20_000]


@pytest.fixture(scope="module")
def net(spark, sf):
    d = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    return L.fit(L.training_sample(d.where("doc_id % 3 != 0"), "doc_id", "text", "lang"))


def test_held_out_accuracy(spark, sf, net):
    """Texts not fitted to: labels are wrong for some, so the network may differ from a few."""
    d = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").where("doc_id % 3 = 0 AND n_chars > 60")
    s = L.with_segments(d.select("doc_id", "text", L.label_of(F.col("lang")).alias("want")).where("want IS NOT NULL"), "text", net)
    one = s.where("size(segments) = 1").withColumn("l", L.text_language(F.col("segments")))
    assert one.agg(F.avg((F.col("l.lang") == F.col("want")).cast("double"))).first()[0] > 0.9
    assert one.agg(F.min("l.confidence")).first()[0] > 0


def test_mixed_text(net):
    en = "The new rule at the food bank is better than nothing, and I will say it again."
    fr = "Les chiffres ont monté ce matin, alors les bénévoles vont ouvrir les fenêtres dès maintenant."
    uk = "Ніхто не повинен сваритися через маску у спортзалі після вечері."
    got = L.segment_batch(net, [en, f"{en} {fr}", f"{fr}\n{en} - {uk}", None, "", "😷 123", en + " " + (fr + " ") * 2000])
    assert [[s["lang"] for s in g] for g in got] == [["en"], ["en", "fr"], ["fr", "en", "uk"], [], [], [], ["en", "fr"]]
    assert all(0 < s["confidence"] <= 1 for g in got for s in g) and [s["seg_no"] for s in got[2]] == [1, 2, 3]


def test_labels_and_edges(spark, net):
    r = spark.createDataFrame([("en_CA", "en"), (" ENGLISH ", "en"), ("Français", "fr"), ("mul", None), ("", None), (None, None), ("spa", "es"), ("xx", None), ("uk-UA", "uk")], "a string, b string")
    assert r.where(~L.label_of(F.col("a")).eqNullSafe(F.col("b"))).count() == 0
    df = spark.createDataFrame([(1, None), (2, "")], "segments long, t string")
    assert [x.segments for x in L.with_segments(df, "t", net).collect()] == [[], []]
    assert L.with_segments(df.limit(0), "t", net).count() == 0
    assert L.training_sample(df, "segments", "t", "t") == [] and L.fit([]) is not None


def test_segments_tile_their_text(net):
    en = "The new rule at the food bank is better than nothing, and I will say it again."
    fr = "Les chiffres ont monté ce matin, alors les bénévoles vont ouvrir les fenêtres dès maintenant."
    odd = "  @x " + en.replace("rule", "r\u200bule").replace("food", "f\u043e\u043ed") + "\u200b\n\u00a0" + fr.replace("é", "e\u0301") + " " + en + " 😷 "
    for text in (odd, en, f"{en} {fr} " * 300):
        (segs,) = L.Labeller(net).segments([text], L.normalise_array(L.pa.array([text]), "readable").to_pylist())
        assert [s["start"] for s in segs] == [0, *(s["end"] for s in segs[:-1])] and segs[-1]["end"] == len(text)
        assert [s["lang"] for s in segs] == (["en", "fr", "en"] if text == odd else ["en"] if text == en else ["en", "fr"] * 300)
        for s in segs:
            part = text[s["start"] : s["end"]]
            assert ("Les chiffres" in part) == (s["lang"] == "fr") and ("The new" in part) == (s["lang"] == "en")


def test_three_languages_without_marks(net):
    en, fr, uk = "the volunteers are going to open the windows right now because of the new rule", "les chiffres ont monté ce matin alors les bénévoles vont ouvrir les fenêtres de la bibliothèque dès maintenant pour tous les parents", "ніхто не повинен сваритися через маску у спортзалі після вечері"
    assert [s["lang"] for s in L.segment_batch(net, [f"{en} {fr} {uk}"])[0]] == ["en", "fr", "uk"]


def test_kept_networks(spark, net, tmp_path):
    L.save_net(spark, net, f"{tmp_path}/net")
    again = L.load_net(spark, f"{tmp_path}/net")
    text = ["Les chiffres ont monté ce matin. The new rule is better than nothing at all."]
    assert L.segment_batch(again, text) == L.segment_batch(net, text)
    with pytest.raises(Exception, match="exists"):
        L.save_net(spark, net, f"{tmp_path}/net")


def test_what_is_kept_changes_nothing(net, monkeypatch):
    texts = [f"The new rule number {i} at the food bank is better than nothing at all." for i in "abcdef"]
    want = L.Labeller(net).segments(texts, texts)
    monkeypatch.setattr(L, "KEPT", 2)
    label = L.Labeller(net)
    assert [label.segments([t], [t])[0] for t in texts] == want
