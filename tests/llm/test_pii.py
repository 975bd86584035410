import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumage.llm.pii import find, luhn, redact, redact_batch


def red(t):
    return redact_batch(pa.array([t]))[0][0]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Email me at a.b+masks@mail.example if you can.", "Email me at [EMAIL] if you can."),
        ("write to fionnola_o [at] example dot net", "write to [EMAIL]"),
        ("à jo-x (at) example.net pour", "à [EMAIL] pour"),
        ("@handle said it costs $45.71 at the store. dot", "@handle said it costs $45.71 at the store. dot"),
        ("My cell is (416)555-0148 ext. 4.", "My cell is [PHONE]."),
        ("+14165550148 or 001 604 555 0133 or 902.555.0155", "[PHONE] or [PHONE] or [PHONE]"),
        ("Tracking 0494116818477199 says delayed.", "Tracking 0494116818477199 says delayed."),
        ("Order no. 073 658 903 has still not shipped. Lot 48-4848", "Order no. 073 658 903 has still not shipped. Lot 48-4848"),
        ("Lost card, SIN 046 454 286, please", "Lost card, SIN [ID], please"),
        ("They read out 046-454-286 (my SIN) aloud", "They read out [ID] (my SIN) aloud"),
        ("mon NAS : 046454286", "mon NAS : [ID]"),
        ("OHIP# 3529 328 977 in front; health card 3026-503-381-DZ; passeport ZZ123456", "OHIP# [ID] in front; health card [ID]; passeport [ID]"),
        ("Pick them up at Unit 21, 1045 Sawmill Street after six.", "Pick them up at [ADDRESS] after six."),
        ("1626, chemin de la Tourbière G1C 8N5", "[ADDRESS]"),
        ("I live at PO Box 1207, Stn B so come by.", "I live at [ADDRESS] so come by."),
        ("Bus 78 at 1:41 was packed on the number nine street", "Bus 78 at 1:41 was packed on the number nine street"),
        ("Ask for Oduverne, Quillon at the desk.", "Ask for [NAME] at the desk."),
        ("thx merrick pennefeather-roy for the ride", "thx [NAME] for the ride"),
        ("Big thanks to Dr. Castelmar for the help.", "Big thanks to [NAME] for the help."),
        ("Thanks to the crossing guard for the ride", "Thanks to the crossing guard for the ride"),
        ("Yorick M. Delacroisette was so kind to us.", "[NAME] was so kind to us."),
        ("Contact: 604-555-0130; NADEZHKA MACQUILLOW", "Contact: [PHONE]; [NAME]"),
        ("they read out my SIN 046 454 287 aloud", "they read out my SIN 046 454 287 aloud"),
        ("My SIN                                                        is: 046 454 286", "My SIN                                                        is: [ID]"),
        ("Marisol Quenneville told everyone to wait.", "[NAME] told everyone to wait."),
        ("Then Bartholomew-Maximilian Featherstonehaugh-Cholmondeley-Wolfeschlegelstein was so kind.", "Then [NAME] was so kind."),
        ("The radio told us to wait, and Parks Canada said no", "The radio told us to wait, and Parks Canada said no"),
        ("(416) 555-0148, 416 555-0148) and $416 555 0148", "[PHONE], [PHONE]) and $416 555 0148"),
        ("We moved to 4512b Old Mill Creek Crescent NW, T2P 1J9 in May", "We moved to [ADDRESS] in May"),
        ("see https://t.example/604-555-0130 now", "see https://t.example/604-555-0130 now"),
        ("call ４１６-５５５-０１４８ or a​b@mаil.example", "call [PHONE] or [EMAIL]"),
    ],
)
def test_examples(text, want):
    assert red(text) == want


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "x " * 200_000 + "a@b.example"), (4, "é́​"), (3, "a@b.example")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("redacted", F.lit(1))
    got = sorted((r.id, None if r.redacted is None else r.redacted[-7:], r.pii_kinds) for r in redact(df, "t").collect())
    assert got[0] == (1, None, None) and got[1] == (2, "", []) and got[2] == got[3] == (3, "[EMAIL]", ["EMAIL"]) and got[4][2] == []
    assert redact(df.limit(0), "t").count() == 0
    same = redact(df.select("id", "t"), "t", out="t")
    assert same.columns == ["id", "t", "pii_kinds"] and same.where("id = 2").first().t == ""


def test_spans_dont_overlap_and_luhn():
    s = find("Contact: a@b.example; 604-555-0130; SIN 046 454 286; Ann Bee; 12 Elm Street")
    assert [k for *_, k in s] == ["EMAIL", "PHONE", "ID", "NAME", "ADDRESS"] and all(a[1] <= b[0] for a, b in zip(s, s[1:]))
    assert luhn("046454286") and not luhn("046454287")


def test_contact_lists_are_read_to_their_end():
    words = "the desk by the north door of the hall; " * 8
    assert red(f"Contact: {words}NADEZHKA MACQUILLOW") == f"Contact: {words}[NAME]"
    assert red("Contact: Dr. Castelmar; the desk; NADEZHKA MACQUILLOW") == "Contact: [NAME]; the desk; [NAME]"
    assert red(f"Contact: the desk. {words}NADEZHKA MACQUILLOW").endswith("NADEZHKA MACQUILLOW")


def test_cues_reach_as_far_as_their_grammar():
    names = "; ".join(f"Aaa{chr(97 + i)} Bbb{chr(97 + i)}" for i in range(26))
    assert [k for *_, k in find(f"Contact: {names}")] == ["NAME"] * 26
    long = "x" * 500
    assert [k for *_, k in find(f"{long} order no. 604-555-0130")] == [] and [k for *_, k in find(f"{long} 604-555-0130")] == ["PHONE"]
    assert find("12 " + "z" * 100_000 + " Street") and len(find("604-555-0130 " * 3000)) == 3000


def test_batches_read_a_text_once():
    arr = pa.array(["a@b.example", None, "a@b.example", "", "plain"])
    t, k = redact_batch(arr)
    assert t == ["[EMAIL]", None, "[EMAIL]", "", "plain"] and k == [["EMAIL"], None, ["EMAIL"], [], []]
    assert redact_batch(arr.slice(1, 2)) == ([None, "[EMAIL]"], [None, ["EMAIL"]])
