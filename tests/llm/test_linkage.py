import random

from pyspark.sql import functions as F

from plumage.llm import linkage as K


def test_edit_distance():
    assert K.edits("abc", "acb", 2) == 1 and K.edits("abc", "abc", 2) == 0 and K.edits("abc", "xyz", 2) == 3 and K.edits("ab", "abcdef", 2) == 3


def test_words():
    assert K.words_of(K.plain("B i r c h w o r t h ON")) == ["birchworth", "on"] and K.words_of(K.plain("St. Télesphin")) == ["saint", "telesphin"] and K.words_of(K.plain("P.Eng")) == ["peng"]


def test_similar_against_brute_force(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 11))) for _ in range(160)} | {"aaaa", "aaaaaa"})
    refs = words[::4]
    names = spark.createDataFrame([(i, r, r) for i, r in enumerate(refs)], "ref_id int, ref string, ref_words string")
    got = {(r.string, r.ref): round(r.jaccard, 9) for r in K.similar(spark.createDataFrame([(w,) for w in words], "string string"), names).collect()}
    want = {}
    for w in words:
        for r in refs:
            a, b, e = set(K.pairs_of(w)), set(K.pairs_of(r)), K.allowed(len(r))
            if abs(len(w) - len(r)) <= e and len(a & b) / len(a | b) >= K.kept_pairs(len(r)) / (len(r) + 1 + 3 * e):
                want[(w, r)] = round(len(a & b) / len(a | b), 9)
    assert got == want


def test_no_allowed_error_is_cut(spark):
    """Every string within the errors allowed of an entry is met, swaps that take three pairs each included."""
    rng = random.Random(5)
    refs = ["abcde", "fghij", "kestrel", "ospreyly", "wrenfield", "aaaaaaa", "flintminster", "portalderenbay", "heron", "lark"]

    def slip(s):
        i, kind = rng.randrange(len(s) - 1), rng.randrange(4)
        return [s[:i] + s[i + 1] + s[i] + s[i + 2 :], s[:i] + s[i + 1 :], s[:i] + rng.choice("xyz") + s[i:], s[:i] + rng.choice("xyz") + s[i + 1 :]][kind]

    pairs = {(s, r) for r in refs for _ in range(150) for s in [slip(r) if K.allowed(len(r)) == 1 else slip(slip(r)) if K.allowed(len(r)) else r]}
    pairs |= {("acbde", "abcde"), ("ksetrle", "kestrel"), ("rwenfiedl", "wrenfield")}
    names = spark.createDataFrame([(i, r, r) for i, r in enumerate(refs)], "ref_id int, ref string, ref_words string")
    got = {(r.string, r.ref) for r in K.similar(spark.createDataFrame([(w,) for w in sorted({w for w, _ in pairs})], "string string"), names).collect()}
    assert {p for p in pairs if K.edits(*p, K.allowed(len(p[1]))) <= K.allowed(len(p[1]))} <= got


def test_link(spark):
    entries = spark.createDataFrame([(1, "Flintminster", ["YFL"], "AB", "Alberta"), (2, "Flintminster", [], "NL", "Newfoundland"), (3, "Upper Ospreyly", None, "ON", "Ontario"), (4, "Port Alderen", [], "BC", "British Columbia"), (None, "Nowhere", [], "X", None)], "id int, name string, alt array<string>, code string, region string")
    rows = {10: "flintminster, nl, canada", 11: "FLINTMINSYER (AB)", 12: "Flintminster", 13: "📍upper  ospreylly", 14: "the internet", 15: " ", 16: "​", 17: "yfl ✈️", 18: None, 19: "Fort Alderen", 20: "Prot Alderen", 21: "Uрреr Ospreyly", 22: "Upper Ospreylly, Alberta", 23: "x" * 200_000, 24: "upper ospreyly"}
    df = spark.createDataFrame([*rows.items(), (24, "Upper Osprey")], "k long, t string").withColumn("ref_id", F.lit("clash"))
    regions = {c: F.col(c) for c in ("code", "region")}
    got = {r.k: r.ref_id for r in K.link(df, "k", "t", entries, "id", "name", "alt", regions).collect()}
    # "Fort" is no word of this list, so it may be a slip of "Port"; a slip beside another region is refused
    assert got == {10: 2, 11: 1, 12: 1, 13: 3, 14: 0, 17: 1, 19: 4, 20: 4, 21: 3, 22: 0, 23: 0, 24: 3}
    assert {r.k for r in K.link(df, "k", "t", entries, "id", "name", "alt", whole=False).collect()} >= {10, 11, 12, 13, 17}
    assert K.link(df.limit(0), "k", "t", entries, "id", "name", "alt", regions).count() == 0
    assert K.link(df, "k", "t", entries.limit(0), "id", "name", "alt", regions).where("ref_id != 0").count() == 0
    nothing = {r.k: r.ref_id for r in K.link(df, "k", "t", entries.limit(0), "id", "name", "alt", regions).collect()}
    assert nothing == dict.fromkeys([k for k in rows if k not in (15, 16, 18)], 0)
