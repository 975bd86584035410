import random
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from plumage.llm.textform import alike_pairs, looks_alike, normalise_array, with_form


def form(*texts, kind="readable"):
    return normalise_array(pa.array(list(texts), pa.string()), kind).to_pylist()


def test_forms():
    assert form("ｆｒｅｅ ﬁrst", None, "", "café", "a​b­c", "x y z") == ["free first", None, "", "café", "abc", "x y z"]
    assert form("Bіrchwοrth", "Дякую всiм", "Mаѕk") == ["Birchworth", "Дякую всім", "Mask"]
    assert form("👩‍🔬 a‍b ❤️") == ["👩‍🔬 ab ❤"]
    assert form("x²", "½", "ℌ") == ["x²", "½", "ℌ"]  # visibly different, kept
    a, b, c, d = form("mask", "mаsk", "Mask", "másk", kind="skeleton")
    assert a == b and len({a, c, d}) == 3
    assert form("0O1lI", kind="skeleton") == ["0O1lI"]


def test_composition_is_canonical():
    rng = random.Random(1)
    for _ in range(500):
        s = "".join(rng.choice("aeiouAEOUcnxyz ̧̛̣́̀̂̈̃") for _ in range(rng.randrange(14)))
        assert form(s) == [unicodedata.normalize("NFC", s)]
    # a mark at the start of a row stays with its row
    assert form("e", "́x") == ["e", "́x"]


def test_batches_slices_and_long_texts():
    long = "ａ" * 300_000 + "é"
    arr = pa.array(["skip", None, "b​", long]).slice(1)
    assert normalise_array(arr).to_pylist() == [None, "b", "a" * 300_000 + "é"]
    assert normalise_array(pa.array([], pa.string())).to_pylist() == []
    assert form("\U0001d400\U000e0041x\U0010fffd") == ["\U0001d400x\U0010fffd"]
    assert form(*form("Bіrch é 👩‍🔬", "x")) == form("Bіrch é 👩‍🔬", "x")


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    base = ["mask up", "stay home", "dog person", ""]
    swap = {"a": "а", "o": "о", "e": "е", "p": "р", " ": " "}
    rows = [(f, k, "".join(swap.get(c, c) if rng.random() < 0.3 else c for c in rng.choice(base)) if rng.random() < 0.95 else None) for f in ("x", "y") for k in range(60)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "f string, k long, t string").withColumn("form", F.lit("clash"))
    got = [(r.field, r.key_a, r.key_b) for r in alike_pairs(df, "f", "k", "t").collect()]
    known = {(f, k, t) for f, k, t in rows if t is not None}
    sk = dict(zip([t for *_, t in known], form(*[t for *_, t in known], kind="skeleton")))
    want = {(a[0], min(a[1], b[1]), max(a[1], b[1])) for a in known for b in known if a[0] == b[0] and a[1] != b[1] and a[2] != b[2] and sk[a[2]] == sk[b[2]]}
    assert len(got) == len(set(got)) and set(got) == want
    assert alike_pairs(df.limit(0), "f", "k", "t").count() == 0 and looks_alike(df.limit(0), "f", "k", "t").count() == 0
    assert with_form(df, "t", "form").columns == ["f", "k", "t", "form"]


def test_hangul_syllables_and_their_letters():
    for text in ("한국어", "마스크를 쓰세요", "값"):
        apart = unicodedata.normalize("NFD", text)
        assert apart != text and form(apart) == form(text) == [text] and form(apart, kind="skeleton") == form(text, kind="skeleton")


def test_rows_that_stay_pass_through():
    """What is skipped would have come out the same."""
    from plumage.llm.textform import changed_rows, codes_of, normalise, text_of

    rng = random.Random(9)
    pool = "abc é ç œ ñ 😷 # @ 1 « » — “ ” Дякую ο а \u200b\u00a0e\u0301 ﬁ ｆ 한 각 \u1112\u1161 \u200d 👩‍🔬 \n\t İ ſ ß ½".replace(" ", "") + "  "
    rows = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 9))) for _ in range(3000)]
    for kind in ("readable", "skeleton"):
        codes, offs = codes_of(pa.array(rows))
        full = text_of(*normalise(codes, offs, kind)[:2]).to_pylist()
        assert form(*rows, kind=kind) == full
        assert 0 < changed_rows(codes, offs, kind).sum() < len(rows)
