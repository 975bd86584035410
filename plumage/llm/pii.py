"""Personal information in free text: find it and put typed placeholders in its stead.

Method: anchor expansion. A text is brought to its comparison form (so full-width digits, look-alike letters
and invisible characters hide nothing; positions are mapped back to the stored text). One Aho-Corasick pass
finds the anchors: at-signs and their spelled forms, link schemes, identifier cues, area codes, street and box
words, titles, and what is said to, of or by somebody. At each anchor a deterministic local parser expands to the
boundaries of the email, number, address or name, as far as its grammar goes (counted in words, never in
characters), and validates it (domain labels, digit groups, check digits, postal code).

Kinds: EMAIL, PHONE, ID (social insurance, health card, passport), ADDRESS, NAME. Handles, links, order,
lot and tracking numbers, amounts and dates are none.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumage.llm.textform import changed_rows, codes_of, normalise, slices, text_of

KINDS = ("EMAIL", "ID", "PHONE", "ADDRESS", "NAME")

# Cue phrases, in English and French, by the parser they start.
AT_CUES = ("@", "[at]", "(at)", "{at}", " at ", " arobase ", "[arobase]", "(arobase)")
SCHEMES = ("http://", "https://", "www.", "mailto:")
ID_CUES = {
    "sin": ("sin", "nas", "social insurance", "assurance sociale"),
    "health": ("health card", "carte santé", "carte sante", "carte soleil", "assurance maladie", "ohip", "ramq", "phn", "carte d'assurance"),
    "passport": ("passport", "passeport"),
}
STREET_EN = ("street", "st", "avenue", "ave", "road", "rd", "drive", "dr", "lane", "ln", "crescent", "cres", "boulevard", "blvd", "court", "crt", "terrace", "terr", "parkway", "pkwy", "circle", "trail", "way", "place", "highway", "hwy")
STREET_FR = ("rue", "avenue", "chemin", "boulevard", "boul", "rang", "route", "allée", "allee", "montée", "montee", "côte", "cote", "ruelle", "av", "ch", "place")
BOX_CUES = ("po box", "p.o. box", "p.o box", "p o box", "case postale", "c.p.", "boîte postale", "boite postale", "cp ", "post office box")
NAME_BEFORE = ("signed", "signé", "signe :", "thx", "thanks to", "merci à", "merci a", "ask for", "demandez", "happy birthday", "bonne fête", "bonne fete", "joyeux anniversaire", "my manager", "my boss", "ma gérante", "mon gérant", "ma gerante", "mon gerant", "ma patronne", "mon patron", "my name is", "je m'appelle", "contact", "sincerely", "regards", "cordialement", "my doctor", "mon médecin", "my landlord")
#: What somebody did: a name in capitals before it is one.
NAME_DID = ("said", "told", "asked", "helped", "gave", "drove", "offered", "thanked", "brought", "called", "wrote", "replied", "laughed", "smiled", "was so", "was very", "m'a", "nous a", "lui a", "leur a", "a dit", "a demandé", "a répondu", "a offert", "a donné", "a aidé", "a été")
NAME_AFTER = ("was so kind", "were so kind", "m'a raccompagn", "m'a ramen", "said no", "a dit non", "a été si gentil", "a ete si gentil", "was so nice", "gave me a ride", "drove me home")
TITLES = ("dr.", "dr ", "dre", "mme", "mr.", "mr ", "mrs", "ms.", "ms ", "mlle", "me ", "prof.", "m. ")
# Words that begin or stand in phrases about no named person.
NOT_NAMES = frozenset(
    "the a an my our your his her their this that these those who whoever everyone everybody anyone nobody someone people most half two three all both some many new old and or of for to in at on by with from was were is are be been said "
    "it not no so very just big day night shift team staff class club choir office kids seniors volunteers tenants parents riders neighbours neighbour neighbor roommate landlord pharmacist barber cashier librarian driver carrier guard coach lady stranger uncle sister cousins "
    "le la les un une des du de mon ma mes notre nos votre vos son sa ses ce cette ces tout tous toute toutes toi vous moi qui que pour au aux dans chez est et ou pas pauvre monde gens dame facteur pharmacien voisine coloc oncle soeur "
    "you me us them him i we he she they what when where help ride desk again today tomorrow tonight please thanks canada mom dad maman papa".split()
)

NOT_STREETS = NOT_NAMES - {"old", "new", "day", "king", "two", "three"}

LETTER = r"[^\W\d_]"
_TOKEN = rf"{LETTER}+(?:['’\-]{LETTER}+)*"
_TITLE = r"\b(?:dr|dre|mme|mr|mrs|ms|mlle|prof|m|me)\b\.?"
#: Given Family, Given M. Family, Family, Given, or title with family name.
_NAME = re.compile(rf"(?:{_TITLE}\s+(?P<t>{_TOKEN}(?:\s+{LETTER}\.)?(?:\s+{_TOKEN})?)|(?P<f>{_TOKEN}),\s+(?P<g>{_TOKEN})|(?P<a>{_TOKEN})(?:\s+(?P<i>{LETTER})\.?)?\s+(?P<b>{_TOKEN}))", re.I)
_TITLED = re.compile(rf"{_TITLE}\s+(?P<t>{_TOKEN})", re.I)

_LOCAL_END = re.compile(r"[a-z0-9](?:[\w.+\-]*[a-z0-9])?$", re.I)
_DOMAIN = re.compile(r"[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?)*\.[a-z]{2,24}(?![a-z0-9@])", re.I)
_SPELLED = re.compile(r"\s*([a-z0-9][a-z0-9\-]*)((?:\s*(?:\s(?:dot|point)\s|[\[({](?:dot|point)[\])}]|\.)\s*[a-z0-9][a-z0-9\-]*)+)", re.I)
#: From an area code on, and what may stand before one: a bracket, a country code, and no part of another number.
_PHONE = re.compile(r"(?P<c>[2-9]\d\d)(?P<close>\s*\))?\s?[\s.\-/]?\s?([2-9]\d\d)\s?[\s.\-/]?\s?(\d{4})(?:\s*(?:ext|poste|x)\.?\s*\d{1,6})?(?![\w])(?![.,\-/]\d)", re.I)
_PHONE_HEAD = re.compile(r"(?:(?<![\w$€£.,/#\-])(?:\+1|001|1)[\s.\-/]{0,3}|(?<![\w$€£.,/#\-]))(?P<open>\(\s*)?$")
_PHONE_LONG = re.compile(r"(?<!\w)(?:\+1|001|1)$")
_NINE = re.compile(r"(?<!\d)(?<!\d[\s\-])\d{3}[\s\-.]?\d{3}[\s\-.]?\d{3}(?![\s\-.]?\d)")
_HEALTH = re.compile(r"(?<!\d)(?:\d{4}[\s\-.]?\d{3}[\s\-.]?\d{3}(?:-[a-z]{2}\b)?|[a-z]{4}\s?\d{4}\s?\d{4})(?!\d)", re.I)
_PASS = re.compile(r"(?<!\w)[a-z]{2}\s?\d{6}(?!\w)", re.I)
_POSTAL = r"(?:[,\s]+[a-z]\d[a-z]\s?-?\d[a-z]\d)?"
_WORDS = rf"(?:{LETTER}[\w'’.\-]*\s+){{0,3}}?{LETTER}[\w'’\-]*"
_EN_STREET = re.compile(rf"(?<![\w$.:,/\-])(?:(?:unit|apt\.?|suite|app\.?|#)\s*\d+[a-z]?\s*,?\s*)?(?:\d{{1,5}}\s?-\s?)?\d{{1,5}}[a-z]?,?\s+(?P<w>{_WORDS})\s+(?P<s>{'|'.join(STREET_EN)})\b\.?(?:\s+(?:nw|ne|sw|se|n|s|e|w)\b\.?)?{_POSTAL}", re.I)
_FR_STREET = re.compile(rf"(?<![\w$.:,/\-])(?:\d{{1,5}}\s?-\s?)?\d{{1,5}}[a-z]?,?\s+(?P<s>{'|'.join(STREET_FR)})\b\.?\s+(?:(?:de|du|des|la|le|les|l|d)\b['’]?\s*){{0,3}}{LETTER}[\w'’\-]*(?:,?\s+(?:app\.?|bureau)\s*\d+)?{_POSTAL}", re.I)
_BOX = re.compile(rf"(?:p\.?\s?o\.?\s?box|post office box|case postale|c\.?\s?p\.?|bo[iî]te postale)\s*#?\s*\d{{1,6}}(?:\s*,?\s*(?:stn|station|succ|succursale|rr)\.?\s*\w+)?{_POSTAL}", re.I)
_LINK = re.compile(r"(?:https?://|www\.)\S+", re.I)
# What stands before numbers that identify things, not persons.
_THING = re.compile(r"(?:order|commande|tracking|suivi|colis|lot|model|modèle|item|invoice|facture|ref|référence|ticket|serial|no\.?|n[o°]\.?|#)\s*(?:no\.?|number|num[ée]ro|n°|#|:)?\s*$", re.I)
#: Tokens that a grammar reaches back from its anchor: a unit, numbers and words of a street; a number; a name.
STREET_BACK, NUMBER_BACK, NAME_BACK, THING_BACK = 9, 5, 6, 4
_LEAD = r"[\s:#.\-–=()]*(?:(?:number|num[ée]ro|no|n°|card|is|est|le|the|de|my|mon|ma)[\s:#.\-–]*){0,3}"
_TAIL = r"\s*[\s(\[\-–,]*(?:(?:my|mon|ma|is my|est mon|the|le)\s+)?"
_AFTER_CUE = {k: re.compile(_LEAD + f"(?P<v>{rx.pattern})", re.I) for k, rx in (("sin", _NINE), ("health", _HEALTH), ("passport", _PASS))}
_BEFORE_CUE = {k: re.compile(f"(?P<v>{rx.pattern}){_TAIL}$", re.I) for k, rx in (("sin", _NINE), ("health", _HEALTH), ("passport", _PASS))}
_CAPITAL_ONLY = frozenset(("way", "place", "court", "trail", "circle", "dr", "st"))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


@functools.lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    codes = [f"{n}" for n in range(200, 1000)]  # area codes
    groups = [("area", codes), ("at", AT_CUES), ("link", SCHEMES), *((f"id:{k}", v) for k, v in ID_CUES.items()), ("box", BOX_CUES), ("before", NAME_BEFORE), ("after", NAME_AFTER), ("did", NAME_DID), ("title", TITLES), ("street", sorted({*STREET_EN, *STREET_FR}))]
    merged: dict[str, list[str]] = {}
    for kind, words in groups:
        for w in words:
            merged.setdefault(w, []).append(kind)
    for w, kinds in merged.items():
        a.add_word(w, (len(w), tuple(kinds)))
    a.make_automaton()
    return a


def back(t: str, a: int, tokens: int) -> int:
    """Where the last ``tokens`` tokens before ``a`` begin, however long they are."""
    at = a
    for _ in range(tokens):
        while at > 0 and t[at - 1].isspace():
            at -= 1
        while at > 0 and not t[at - 1].isspace():
            at -= 1
        if at == 0:
            break
    return at


def _phone(t: str, a: int) -> tuple[int, int] | None:
    """A number whose area code stands at ``a``."""
    m = _PHONE.match(t, a)
    if not m:
        return None
    lo = back(t, a, 2)
    head = _PHONE_HEAD.search(t[lo:a])
    if head and bool(head.group("open")) == bool(m.group("close")):
        # the sign before a head that the cut begins with
        start = lo + head.start()
        if not (start == lo and lo > 0 and re.match(r"[\w$€£.,/#\-]", t[lo - 1])):
            return start, m.end()
    return None


def _edge(t: str, a: int, b: int) -> bool:
    """Whether t[a:b] stands as words of its own."""
    return not ((a > 0 and t[a].isalnum() and t[a - 1].isalnum()) or (b < len(t) and t[b - 1].isalnum() and t[b].isalnum()))


def _email(t: str, a: int, b: int) -> tuple[int, int] | None:
    cue = t[a:b]
    if cue == "@":
        left = _LOCAL_END.search(t, max(0, a - 64), a)
        right = _DOMAIN.match(t, b)
        return (left.start(), right.end()) if left and left.end() == a and right else None
    end = a
    while end > 0 and t[end - 1] == " ":
        end -= 1
    left = _LOCAL_END.search(t, max(0, end - 64), end)
    right = _SPELLED.match(t, b)
    if not left or left.end() != end or not right:
        return None
    spelled = re.search(r"dot|point", right.group(2), re.I)
    if cue.strip() in ("at", "arobase") and not spelled:
        return None
    return left.start(), right.end()


def _name_ok(m: re.Match, text: str, loose: bool) -> bool:
    parts = [p for p in (m.group("t"), m.group("f"), m.group("g"), m.group("a"), m.group("b")) if p]
    words = [w for p in parts for w in p.replace(".", " ").split() if len(w) > 1]
    if m.group("t"):
        return len(words) > 0 and words[0].lower() not in NOT_NAMES and (words[0][:1].isupper() or loose)
    if not words or any(w.lower() in NOT_NAMES for w in words):
        return False
    return loose or all(w[:1].isupper() for w in words)


_ENDS = re.compile(r"[.!?]\s")


def _names_before(t: str, b: int, cue: str) -> list[tuple[int, int]]:
    """Names right after a cue phrase; after ``contact`` any piece of the list that is one."""
    if cue == "contact":
        m = re.match(r"\s*(?:[:\-]|est|is)\s*", t[b : b + 8])
        if not m:
            return []
        out, at = [], b + m.end()
        while at < len(t):  # the list goes on to its sentence end, however far
            end = t.find(";", at)
            piece = t[at : end if end >= 0 else len(t)]
            lead = len(piece) - len(piece.lstrip())
            n = _NAME.match(piece, lead)
            if n and _name_ok(n, piece, loose=False) and not piece[n.end() : n.end() + 1].isalnum() and piece[n.end() : n.end() + 1] != "@":
                out.append((at + n.start(), at + n.end()))
            elif n and _name_ok(n, piece, loose=True) and (_STOP.match(piece, n.end()) or _NEW.match(piece, n.end())):
                out.append((at + n.start(), at + n.end()))
            at += len(piece) + 1
            # the dot of a title or an initial inside a name ends nothing
            if _ENDS.search(piece, n.end() if n and out and out[-1][1] == at - len(piece) - 1 + n.end() else 0):
                break
        return out
    m = re.match(r"[\s,:;\-–—]{1,4}", t[b : b + 5])
    if not m:
        return []
    n = _NAME.match(t, b + m.end())
    return [(n.start(), _cut(n, t))] if n and _name_ok(n, t, loose=True) else []


def _cut(n: re.Match, t: str) -> int:
    """A title's second word is no part of the name where it goes on in lower case."""
    if n.group("t"):
        first = _TITLED.match(t, n.start())
        rest = t[first.end() : n.end()].strip()
        if rest and (rest[:1].islower() or rest.lower() in NOT_NAMES):
            return first.end()
    return n.end()


_BACK = re.compile(rf"(?:{_TITLE}\s+{_TOKEN}|{_TOKEN},\s+{_TOKEN}|{_TOKEN}(?:\s+{LETTER}\.?)?\s+{_TOKEN})\s*$", re.I)


def _name_after(t: str, a: int, loose: bool = True) -> tuple[int, int] | None:
    """The name that ends right before ``a``."""
    lo = back(t, a, NAME_BACK)
    found = t[lo:a]
    best = None
    for m in _BACK.finditer(found):
        best = m
    if best is None:
        return None
    found = found[best.start() :]
    n = _NAME.match(found)
    # more words than a name before the cue: take the last that make one
    while n and (n.end() < len(found.rstrip()) or not _name_ok(n, found, loose)):
        nxt = re.match(r"\S+\s+", found)
        if not nxt:
            return None
        found = found[nxt.end() :]
        n = _NAME.match(found)
    if not n:
        return None
    start = a - len(found)
    return start, start + n.end()


_NEW = re.compile(r"\s+[A-ZÀ-ÖØ-ÞЀ-Я¿]")  # another sentence begins
_STOP = re.compile(r"\s*(?:$|;|https?:|#|@|[.!?](?:\s|$)|[|•/\n]|[^\w\s'’.,\-])", re.I)


def _beside(t: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Names that are a whole piece of a list whose neighbouring piece is personal data."""
    out = []
    for a, b, _ in found:
        m = re.match(r"\s*>?\s*;\s*", t[b : b + 6])
        if m:
            n = _NAME.match(t, b + m.end())
            if n and _name_ok(n, t, loose=True):
                end = n.end() if _STOP.match(t, n.end()) or _NEW.match(t, n.end()) else (_cut(n, t) if n.group("t") else 0)
                if end or all(w[:1].isupper() for w in n.group().split()):
                    out.append((n.start(), end or n.end()))
        k = a
        while k > 0 and (t[k - 1].isspace() or t[k - 1] == "<"):
            k -= 1
        if k and t[k - 1] == ";":
            lo = back(t, k - 1, NAME_BACK)
            piece = re.split(r"[;:\n]", t[lo : k - 1])[-1]
            for part in (piece, re.split(r"[\-–]\s", piece)[-1]):
                bare = part.strip()
                n = _NAME.match(bare)
                if n and n.end() == len(bare) and _name_ok(n, bare, loose=True):
                    at = k - 1 - len(part) + len(part) - len(part.lstrip())
                    out.append((at, at + n.end()))
                    break
    return out


def _identifier(t: str, kind: str, a: int, b: int) -> tuple[int, int] | None:
    """The number of this kind that stands right after or before its cue; its check digit holds where it has one."""
    after = _AFTER_CUE[kind].match(t, b)
    lo = back(t, a, NUMBER_BACK)
    for m, off in ((after, 0), (None if after else _BEFORE_CUE[kind].search(t[lo:a]), lo)):
        if m and (kind != "sin" or luhn(re.sub(r"\D", "", m.group("v")))):
            return m.start("v") + off, m.end("v") + off
    return None


def _streets(t: str, a: int) -> Iterator[tuple[int, int]]:
    """Addresses whose street word stands at ``a``: number and name before it, or number before and name after it."""
    lo = back(t, a, STREET_BACK)
    m = _EN_STREET.search(t, lo)
    while m and m.start() < a:
        if m.start("s") == a:
            words = m.group("w").split()
            plain = m.group("s").lower() in _CAPITAL_ONLY and not m.group("s")[:1].isupper()
            if not plain and words[0][:1].isupper() and not any(w.lower() in NOT_STREETS for w in words):
                yield m.span()
            elif all(w.lower() not in NOT_STREETS for w in words) and len(words) <= 2 and m.group("s").lower() in ("street", "avenue", "ave", "road", "drive", "lane", "crescent", "blvd", "boulevard", "st"):
                yield m.span()
        m = _EN_STREET.search(t, m.start() + 1)
    m = _FR_STREET.search(t, lo)
    while m and m.start() < a:
        if m.start("s") == a:
            yield m.span()
            break
        m = _FR_STREET.search(t, m.start() + 1)


def find(t: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal data in a text in comparison form, not overlapping, in order."""
    low = t.lower()
    if len(low) != len(t):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    found: list[tuple[int, int, str]] = []
    links: list[tuple[int, int]] = []
    hits = []
    for end, (n, kinds) in anchors().iter(low):
        a, b = end - n + 1, end + 1
        for k in kinds:
            if k == "link":
                m = _LINK.match(t, a)
                if m:
                    links.append(m.span())
            elif k != "area" or (not t[b : b + 1].isdigit() or not t[a - 1 : a].isdigit() or a == 0 or t[a - 1] == "1"):
                hits.append((a, b, k))
    for a, b, k in hits:
        span = None
        if k == "at":
            span = _email(t, a, b)
            k = "EMAIL"
        elif k == "area":
            span = _phone(t, a)
            if span and _THING.search(t[back(t, span[0], THING_BACK) : span[0]]):
                span = None
            k = "PHONE"
        elif k[:3] == "id:" and _edge(low, a, b):
            span = _identifier(t, k[3:], a, b)
            k = "ID"
        elif k == "street" and _edge(low, a, b):
            found += [(*s, "ADDRESS") for s in _streets(t, a)]
        elif k == "box":
            m = _BOX.match(t, a)
            if m and _edge(low, *m.span()):
                span = m.span()
            k = "ADDRESS"
        elif k == "before" and _edge(low, a, b):
            found += [(*s, "NAME") for s in _names_before(t, b, low[a:b])]
        elif k in ("after", "did") and not (a and low[a - 1].isalnum()) and (k == "after" or _edge(low, a, b)):
            span = _name_after(t, a, loose=k == "after")
            k = "NAME"
        elif k == "title" and not (a and low[a - 1].isalnum()):
            m = _TITLED.match(t, a)
            if m and m.group("t")[:1].isupper() and m.group("t").lower() not in NOT_NAMES and len(m.group("t")) > 2:
                found.append((*m.span(), "NAME"))
        if span:
            found.append((*span, k))
    if not found:
        return []
    found = [(a, b - (k == "ADDRESS" and t[b - 1] == "."), k) for a, b, k in found]
    found += [(*x, "NAME") for x in _beside(t, found)]
    found.sort(key=lambda f: (KINDS.index(f[2]), f[0], -f[1]))
    taken: list[tuple[int, int, str]] = []
    for a, b, k in found:
        if any(a < d and c < b for c, d in links) and k != "NAME":
            continue
        if all(b <= c or d <= a for c, d, _ in taken):
            taken.append((a, b, k))
    return sorted(taken)


def redact_batch(arr: pa.Array) -> tuple[list[str | None], list[list[str] | None]]:
    """(texts with placeholders, kinds found in order of KINDS) of all rows; a text that comes again is read once."""
    coded = arr.dictionary_encode()
    texts, kinds = [], []
    for part in slices(coded.dictionary):
        t, k = _redact(part)
        texts += t
        kinds += k
    at = coded.indices.to_pylist()
    return [None if i is None else texts[i] for i in at], [None if i is None else kinds[i] for i in at]


def _redact(arr: pa.Array) -> tuple[list[str], list[list[str]]]:
    """Of texts that aren't null. Where the comparison form of a text is the text, places are places in it."""
    codes, offs = codes_of(arr)
    loose = changed_rows(codes, offs, "skeleton")
    stored = arr.to_pylist()
    forms: dict[int, tuple[str, np.ndarray]] = {}
    rows = np.flatnonzero(loose)
    if len(rows):
        codes, offs = codes_of(arr.take(pa.array(rows)))
        out, new, src = normalise(codes, offs, "skeleton")
        for j, (i, t) in enumerate(zip(rows, text_of(out, new).to_pylist())):
            forms[int(i)] = (t, src[new[j] : new[j + 1]] - offs[j])
    texts: list[str] = []
    kinds: list[list[str]] = []
    for i, raw in enumerate(stored):
        t, at = forms.get(i, (raw, None))
        spans = find(t)
        kinds.append([k for k in KINDS if any(s[2] == k for s in spans)])
        if at is not None and spans:
            base = len(raw)
            order = np.minimum.accumulate(np.concatenate([at, [base]])[::-1])[::-1]
            ends = [(order[a], max(order[b] if b < len(at) else base, order[b - 1] + 1)) for a, b, _ in spans]
        else:
            ends = [(a, b) for a, b, _ in spans]
        piece, last = [], 0
        for (a, b), (*_, k) in zip(ends, spans):
            piece += [raw[last:a], f"[{k}]"]
            last = b
        texts.append("".join([*piece, raw[last:]]) if piece else raw)
    return texts, kinds


def redact(df: DataFrame, text: str, out: str = "redacted", kinds: str = "pii_kinds") -> DataFrame:
    """``df`` with the redacted text and the array of kinds found (empty where none; null for null text).

    Columns already named like the two are replaced.
    """
    df = df.drop(*(c for c in (out, kinds) if c != text))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            t, k = redact_batch(b.column(text).cast(pa.string())) if b.num_rows else ([], [])
            cols = dict(zip(b.schema.names, b.columns))
            cols[out], cols[kinds] = pa.array(t, pa.string()), pa.array(k, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    added = [] if out == text else [T.StructField(out, T.StringType())]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added, T.StructField(kinds, T.ArrayType(T.StringType()))]))
