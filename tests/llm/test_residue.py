import pytest

from plumage.llm.residue import examine, residue_evidence

CONTENT = "The new rule at the food bank is better than nothing, and I will say it again. We waited an hour outside the clinic before the storm."
BAD = {
    1: "Hi {{ first_name }},\n" + CONTENT, 2: "Votre numéro est *|phone|*. " + CONTENT, 3: "Bonjour [à compléter : PHONE],\n" + CONTENT, 4: "Hello {city},\n" + CONTENT, 5: "It starts at #{city}, be early. " + CONTENT,
    6: "Dear null,\n" + CONTENT, 7: "Dear [object Object],\n" + CONTENT, 10: "Menu  Search  Log in\nError 503\nService Unavailable. Please try again later.\nRequest ID: r0zl8z2b", 11: "<h1>404 Not Found</h1><hr>web front",
    12: "Please enable JavaScript to continue.", 13: "Bitte aktivieren Sie JavaScript in Ihrem Browser.\nRay 30p0r6nr", 14: "Your title here\nNulla enim aliquip do eiusmod voluptate dolor. Do ea tempor et ullamco tempor consequat.", 15: "Text text text text text.", 16: "Votre texte ici. Votre texte ici.",
    17: "Page introuvable\nLa page que vous cherchez n'existe pas ou a été déplacée.",
}
GOOD = {
    100: CONTENT, 101: "The barber writes <brackets> and $signs {like this} in every note. " + CONTENT, 102: "[update] The line moved faster than I expected {sarcasm}. " + CONTENT, 103: "The booking page kept saying 404 not found, so I phoned the cashier instead. " + CONTENT,
    104: "Page not found is exactly how I feel about my patience after supper. " + CONTENT, 105: "Encore une erreur 222 sur le portail après le souper, j'ai tout laissé tomber. " + CONTENT, 106: "Half the posters near the rink still said lorem ipsum under the logo, who proofreads these? " + CONTENT,
    107: "My uncle could not sign up at lunch because the site told us to enable JavaScript. " + CONTENT, 108: "😷 #MaskUp", 109: "", 110: None, 111: "Our school letter arrived with Dear first name at the top and most riders laughed. " + CONTENT, 112: CONTENT * 2000,
}


def test_examples(spark):
    df = spark.createDataFrame([(k, t, None if k == 12 else "s") for k, t in (BAD | GOOD).items()], "reason long, t string, host string")
    got = {r.reason: r for r in residue_evidence(df.withColumnRenamed("reason", "k"), "k", "t", "host").withColumnRenamed("reason", "why").withColumnRenamed("k", "reason").collect()}
    assert set(got) == set(BAD)
    assert got[1].why == "slot" and got[6].why == "empty value" and got[10].why == "page" and got[14].why == "filler"


def test_repeated_pages_without_cues(spark):
    rows = [(i, f"Skip to content\nThe hamster of this shelf naps.\nRay {i}abc9", f"h{i % 2}") for i in range(6)] + [(50, "Skip to content\nAnother single shelf here.", "h0")]
    df = spark.createDataFrame(rows, "k long, t string, host string")
    assert {r.k for r in residue_evidence(df, "k", "t", "host").collect()} == set(range(6))


def test_pages_outside_the_lists(spark):
    """No pattern hits these: only their repetition over hosts and a title or slug that the body drops speak."""
    naps = [(i, f"Sunday recipes and gardens\nThe hamster of shelf {i} naps.", f"h{i % 2}") for i in range(4)]
    slug = [(10 + i, f"https://x.example/{i}/sunday-recipes-gardens The hamster naps until spring.", f"h{i % 3}") for i in range(4)]
    taken = [(20 + i, f"Sunday gardens opening\nThe gardens open every sunday at {i}.", f"h{i % 2}") for i in range(4)]
    plain = [(30 + i, f"The hamster naps until spring. See everyone then, day {i}.", f"h{i % 2}") for i in range(4)]
    short = [(40 + i, f"https://x.example/mlxmtq{i} We met the hamster today.", f"h{i % 2}") for i in range(4)]
    one_host = [(50 + i, "Morning notes\nThe kettle is broken again.", "h0") for i in range(4)]
    alone = [(60, "Evening notes\nThe baker is away again.", "h0")]
    df = spark.createDataFrame(naps + slug + taken + plain + short + one_host + alone, "k long, t string, host string")
    assert all(not (e["page"] or e["filler"] or e["furniture"]) for e in (examine(r.t) for r in df.collect()))
    got = {r.k: r.reason for r in residue_evidence(df, "k", "t", "host").collect()}
    assert got == dict.fromkeys([*range(4), *range(10, 14)], "repeated page")


def test_weak_slots_stand_by_themselves(spark):
    """Marked whatever other rows there are: each is judged in a table without strong notations."""
    bad = ["Hi {user.name},\n" + CONTENT, "We moved to %shop.city%. " + CONTENT, "Bonjour <prénom>,\n" + CONTENT, CONTENT + "\nSincerely, [signature]"]
    good = ["Write to <mail.example.com> or [notes.txt]. " + CONTENT, CONTENT + " It moved faster than I expected {sarcasm}.", "[update] " + CONTENT]
    df = spark.createDataFrame(list(enumerate(bad + good)), "k long, t string").selectExpr("*", "'h' AS host")
    assert {r.k: r.reason for r in residue_evidence(df, "k", "t", "host").collect()} == dict.fromkeys(range(4), "slot")
    # a phrase seen before unmistakable slots tells of ambiguous ones after it
    learned = spark.createDataFrame([(1, "Your number is {{ a }}. " + CONTENT), (2, "Your number is ${b}. " + CONTENT), (3, "Your number is {phone}. " + CONTENT)], "k long, t string").selectExpr("*", "'h' AS host")
    assert {r.k for r in residue_evidence(learned, "k", "t", "host").collect()} == {1, 2, 3}


def test_edges(spark):
    df = spark.createDataFrame([(1, "Text text text text."), (1, CONTENT), (None, "Text text text text.")], "k long, t string").selectExpr("k", "t", "cast(null as string) AS host", "1 AS words")
    assert [(r.k, r.reason) for r in residue_evidence(df, "k", "t", "host").collect()] == [(1, "filler")]
    assert residue_evidence(df.limit(0), "k", "t", "host").count() == 0


@pytest.mark.parametrize("text", ["{{", "}}{{}}", "<%", "%%", "__", "\x00", "a" * 100_000, "{" * 5000])
def test_odd_texts(text):
    assert examine(text)["words"] >= 0


def test_responses_by_their_wording_alone(spark):
    """Sentences of no list, in different short texts of three hosts, are a response's; not where content has them too, nor copies of one text."""
    a, b, c = "The hamster naps until spring.", "Our kettle went to the moon.", "A copied remark about nothing."
    rows = [(i, f"{a}\nShelf {i} {'odd' if i % 2 else 'even'}.", f"h{i % 3}") for i in range(12)]
    rows += [(20 + i, f"{b}\nSpoon {'ABCDEFGHIJKL'[i]}.", f"h{i % 3}") for i in range(12)] + [(40 + i, f"{b} {CONTENT} {CONTENT}", "h0") for i in range(6)]
    rows += [(60 + i, c, f"h{i % 3}") for i in range(12)]
    df = spark.createDataFrame(rows, "k long, t string, host string")
    got = {r.k: r.reason for r in residue_evidence(df, "k", "t", "host").collect()}
    assert got == dict.fromkeys(range(12), "repeated page")


def test_the_whole_text_is_read(spark):
    far = (CONTENT + " ") * 200
    rows = [(1, far + "Dear {{ name }}, hello."), (2, far + "lorem ipsum dolor sit amet consectetur " * 400), (3, far + "Page not found."), (4, "Page not found. " * 200)]
    got = {r.k: r.reason for r in residue_evidence(spark.createDataFrame(rows, "k long, t string").selectExpr("*", "'h' AS host"), "k", "t", "host").collect()}
    assert got == {1: "slot", 2: "filler", 4: "page"}
