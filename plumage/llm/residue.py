"""Template residue and pages that stand in place of content.

Method. Each document is read once, whole. Detectors find placeholders (slots) of templating notations and filler
copy; sentences give fingerprints with changing references masked; the terms of the document's addresses (slugs)
and of its title line are compared with the body's. Then evidence is combined over all documents:

* Wording is a response's if its sentence comes again in several *different* texts of little information, from
  several hosts, and hardly ever in texts of much information. Copies of one text count once.
* A document of little information that is made of such sentences is a response page whatever its wording is; a
  title and slugs that its body drops add to that, those it takes up take away, and so do page furniture and cues
  (sentences of error pages and script notices) add. One score decides.
* Slot names and the phrases around them, learned from unmistakable notations anywhere in the corpus, decide about
  the ambiguous ones (``{city}`` against ``{sarcasm}``) and about empty values (``Dear null,``).

The lists of cues come last: they speak for pages that are the only ones of their kind in a table. A text that
only talks about errors or scripts has other sentences, or tells of somebody; it isn't marked.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage.session import broadcast_if_small, cut_lineage, spread

# Notations of slots. ``n`` is the name. Strong ones are unmistakable.
_NAME = r"(?P<n>[^\W\d][\w.]*)"
STRONG = [
    rf"\{{\{{\s*{_NAME}\s*\}}\}}", rf"\$\{{\s*{_NAME}\s*\}}", rf"#\{{\s*{_NAME}\s*\}}", rf"\[\[\s*{_NAME}\s*\]\]",
    rf"<%=?\s*{_NAME}\s*%>", rf"\{{%\s*{_NAME}\s*%\}}", rf"<<\s*{_NAME}\s*>>", rf"@@\s*{_NAME}\s*@@", rf"%\({_NAME}\)s", rf"\*\|\s*{_NAME}\s*\|\*",
    rf"\[(?:insert|enter|add|your|votre|insérer|inserer|insérez|à compléter|a completer|to be completed|tbd|todo)\s*:?\s+{_NAME}(?:\s+(?:here|ici))?\s*\]",
]
WEAK = [rf"(?<![{{$#\w]){{\s*{_NAME}\s*}}(?!}})", rf"(?<![<\w])<{_NAME}>(?!>)", rf"(?<![%\w])%{_NAME}%(?![%\w])", rf"(?<!\[)\[{_NAME}\](?!\])", rf"(?<!_)__{_NAME}__(?!_)"]
EMPTY = r"(?P<e>\[object Object\]|undefined|null|NaN|None|nil|N/A|#N/A|#REF!|\(null\)|<null>)"
SALUTATIONS = ("dear", "hi", "hello", "hey", "bonjour", "salut", "cher", "chère", "madame", "monsieur", "sincerely", "merci,", "regards,", "unsubscribe:", "se désabonner :")
#: Dotted names are slots (``user.name``) unless they end as addresses and files do.
_DOTTED = r"^[\p{L}_][\p{L}\p{N}_]*(?:\.[\p{L}_][\p{L}\p{N}_]*)+$"
_SITES = r"\.(?:com|org|net|edu|gov|info|biz|io|ca|us|uk|fr|de|es|it|pt|ua|eu|qc|example|html?|php|pdf|txt|jpe?g|png|gif|docx?|xlsx?|csv|json|xml|js|py)$"
_STRONG = [re.compile(p, re.I) for p in STRONG]
_WEAK = [re.compile(p, re.I) for p in WEAK]
_EMPTY = re.compile(rf"(?<![\w<>{{}}]){EMPTY}(?![\w])")
_HTML = frozenset("a b i p h1 h2 h3 h4 br hr em li ol ul td th tr div pre img code span html head body table strong script style title".split())

# Sentences of error pages and script notices, in the languages of the corpus.
ERRORS = [
    r"^(?:http|error|erreur|fehler|errore|erro|código|codice|помилка)?\s*(?:status\s*)?:?\s*\(?[45]\d\d\)?(?!\w)(?!/)", r"\b(?:error|erreur|fehler|errore|erro|помилка)\s*:?\s*[45]\d\d\b", r"\bbad request\b", r"\b(?:page|file|url)?\s*not found\b", r"\bbad gateway\b", r"\bgateway time-?out\b",
    r"\bservice (?:temporarily )?unavailable\b", r"\binternal server error\b", r"\btoo many requests\b", r"\bforbidden\b", r"\bunauthori[sz]ed\b", r"\baccess (?:is )?denied\b", r"\brate limit exceeded\b", r"\btimed out\b",
    r"\bsession has expired\b", r"\baccount (?:has been|is|was) (?:suspended|deleted|closed)\b", r"\bno longer (?:exists?|available)\b", r"\b(?:page|post|content|account|tweet|thread|site) (?:is|was|has been) (?:un|not )?(?:available|removed|deleted|found)\b",
    r"\bpage can(?:'|’)?(?:no)?t be (?:found|reached|displayed)\b", r"\brequested (?:page|url|resource)\b", r"\bnothing was found\b", r"\bsomething went wrong\b", r"\btrouble loading\b", r"\bestablishing a database connection\b", r"\bupstream connect error\b",
    r"\bexception in thread\b", r"\btraceback \(most recent call last\)", r"^\s*file \".*\", line \d+", r"^\w*(?:error|exception): ", r"\bunexpected token\b", r"\bunder construction\b", r"\bdown for maintenance\b", r"\bback shortly\b", r"\bmay have been removed\b", r"\bplease try again\b", r"\btry (?:again later|reloading)\b", r"\bbefore you try again\b",
    r"\bpage introuvable\b", r"\bservice (?:temporairement )?indisponible\b", r"\bveuillez réessayer\b", r"\b(?:n'existe pas|n’existe pas) ou a été\b", r"\bune erreur (?:s'est|est) (?:produite|survenue)\b", r"\baccès (?:refusé|interdit)\b", r"\bn['’]existe plus\b", r"\ben maintenance\b", r"\bcompte (?:a été )?suspendu\b",
    r"\bpágina no (?:encontrada|existe|disponible)\b", r"\bcuenta no existe\b", r"\bcontenido que busca\b", r"\bintente (?:otra|de nuevo|más tarde)\b", r"\bacceso denegado\b", r"\bha ocurrido un error\b", r"\bpágina não (?:encontrada|existe)\b", r"\bconteúdo (?:não|indisponível)\b", r"\btente novamente\b",
    r"\bseite (?:wurde )?nicht gefunden\b", r"\bnicht (?:verfügbar|erreichbar)\b", r"\bzugriff verweigert\b", r"\bpagina non trovata\b", r"\briprova più tardi\b", r"\bсторінк\w* не (?:знайден|існу)\w*", r"\bспробуйте (?:ще раз|пізніше)\b",
]
SCRIPTS = [
    r"\b(?:enable|activate|allow|turn on|turning on|switch on|unblock|permit)\b.{0,30}\b(?:java ?script|scripts?|cookies)\b", r"\bjava ?script (?:is|must be|has to be|needs to be|seems)\b", r"\bscripts (?:are|must be|is) \w+", r"\bscripts (?:blocked|disabled|off)\b", r"\bhas to run scripts\b", r"\brequires? (?:java ?script|scripts)\b",
    r"\bwith (?:java ?script|scripts) enabled\b", r"\bswitch (?:java ?script|scripts) on\b", r"\bjava ?script\b.{0,40}\b(?:browser|navigateur|navegador|settings|réglages)\b", r"\bchecking your browser\b", r"\bbrowser (?:does not|doesn't) support\b", r"\bsupported browser\b", r"\bbrowser is out of date\b", r"\bturn them on\b", r"^loading\W*$", r"\bif nothing appears\b", r"\bverify(?:ing)? (?:that )?you are (?:a )?human\b",
    r"\bjava ?script\b", r"\bscripts?\b", r"\b(?:script|ad) ?blocker\b", r"\bbloqueur\b",
    r"\b(?:activez|activer|autorisez|autoriser)\b.{0,30}\b(?:java ?script|scripts?|cookies)\b", r"\bactivez-le\b", r"\brequiert java ?script\b", r"\bnavigateur, puis\b",
    r"\b(?:activ[ea]r?|habilit[ea]r?|permit[ae]) .{0,20}\b(?:java ?script|scripts)\b", r"\b(?:ativ[ea]r?) .{0,20}\b(?:java ?script|scripts)\b", r"\b(?:java ?script|skripte)\b.{0,40}\baktivieren\b", r"\baktivieren sie .{0,20}\b(?:java ?script|skripte)\b", r"\b(?:attiva|abilita)\w* .{0,20}\b(?:java ?script|script)\b", r"\b(?:увімкніть|дозвольте) .{0,20}\b(?:java ?script|скрипти)\b",
]
FILLER = [
    r"^(?:text|texte|texto|testo|blah?|foo|bar|test|asdf|qwer\w*|xxx+|lorem|dummy|sample)(?:[\s,.]+(?:text|texte|texto|testo|blah?|foo|bar|test|asdf|qwer\w*|xxx+|lorem|dummy|sample))+\W*$", r"\bdummy (?:copy|text)\b", r"\bsample text\b", r"\bplaceholder (?:headline|text|copy|title|paragraph)\b", r"\breplace this (?:paragraph|text|sentence|copy)\b", r"\bbody copy to come\b", r"\bcopy to come\b",
    r"\b(?:heading|title|headline|text|content|caption) (?:goes )?here\b", r"\byour (?:title|text|headline|content) here\b", r"\badd your \w+ content\b", r"\bvotre (?:texte|titre) ici\b", r"\btitre de la section\b", r"\btexte (?:à venir|de remplissage|bidon)\b", r"\bfaux[- ]texte\b", r"\b(?:su|tu) (?:texto|título) aquí\b", r"\bhier (?:steht|kommt) .{0,16}text\b", r"\bblindtext\b", r"\bonly for layout\b",
]
FURNITURE = [
    r"^(?:menu|search|log ?in|sign in|sign up|home|about|contact|skip to content|accueil|nous joindre|recherche|connexion|inicio|buscar|privacy|terms|help|aide|suche|startseite|\W)+$", r"^©.*$", r"\ball rights reserved\b", r"\btous droits réservés\b", r"^(?:ref|ray|code|request id|reference|référence|id|trace|incident)\W*\s*[\w-]*\d*[\w-]*\W*$", r"^retry\W*$", r"^oops\W*$",
]
# The vocabulary of Latin filler copy.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)


_OPTIONAL = re.compile(r"(?:\[[^\]]*\]|\\.|[^\\])(?:[?*]|\{0)")
_RUN = re.compile(r"[^\W\d_]+(?:[ '’][^\W\d_]+)*")


def literal_of(pattern: str) -> str | None:
    """A run of three letters or more that any match of the pattern holds: the longest outside of groups and choices; None if there is none."""
    while re.search(r"\([^()]*\)", pattern):
        pattern = re.sub(r"(?<!\\)\((?:[^()\\]|\\.)*\)[?*]?", "\x00", pattern) if re.search(r"(?<!\\)\((?:[^()\\]|\\.)*\)", pattern) else "\x00"
    if "|" in pattern:
        return None
    plain = re.sub(r"\[[^\]]*\]|\\.", "\x00", _OPTIONAL.sub("\x00", pattern))
    return max((r for r in _RUN.findall(plain) if len(r) >= 3), key=len, default=None)


class Detectors:
    """Groups of patterns of which a text wakes those whose literal it holds, found in one Aho-Corasick pass."""

    def __init__(self, **groups: list[str]):
        self.groups = {g: [re.compile(p, re.I) for p in ps] for g, ps in groups.items()}
        self.always = {g: [] for g in groups}
        keys: dict[str, list[tuple[str, int]]] = {}
        for g, ps in groups.items():
            for i, p in enumerate(ps):
                literal = literal_of(p)
                if literal:
                    keys.setdefault(literal.casefold(), []).append((g, i))
                else:
                    self.always[g].append(i)
        self.words = ahocorasick.Automaton()
        for literal, at in keys.items():
            self.words.add_word(literal, tuple(at))
        self.words.make_automaton()

    def awake(self, text: str) -> dict[str, list[re.Pattern]]:
        """``text`` is case-folded."""
        on = {g: set(i) for g, i in self.always.items()}
        for _, at in self.words.iter(text):
            for g, i in at:
                on[g].add(i)
        return {g: [self.groups[g][i] for i in sorted(ix)] for g, ix in on.items()}


@functools.lru_cache(1)
def detectors() -> Detectors:
    return Detectors(page=ERRORS + SCRIPTS, fill=FILLER, furniture=FURNITURE)


def _any(patterns: list[re.Pattern], s: str) -> bool:
    return any(p.search(s) for p in patterns)


#: A sentence with one of these tells of somebody.
_TELLS = re.compile(r"(?<!\w)(?:i|my|me|our|they|he|she|and then|j'ai|je|mon|ma|notre|ils|elle|n'a pas pu|said|kept saying|disait)(?!\w)", re.I)
_SENT = re.compile(r"(?<=[.!?…])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TAGS = re.compile(r"</?\w+[^>]*>")
_LINK = re.compile(r"https?://\S+")
_SLUG = re.compile(r"(?<![^\W_])[^\W\d_]{4,}(?![^\W_])")
_OPENS = ("{{", "${", "#{", "[[", "<%", "{%", "<<", "@@", "*|", "%(", "[")
_MAYBE = ("{", "<", "%", "[", "__")
_BLANKS = ("[object Object]", "undefined", "null", "NaN", "None", "nil", "N/A", "#REF!")
_LATIN = ("lorem", "ipsum", "adipiscing", "consectetur", "eiusmod", "ullamco", "reprehenderit", "exercitation", "aliqua")
_MASK = re.compile(r"\w*\d\w*|[@#]\w+|https?://\S+")

#: Words that no detector explains, from which on a text is content; up to twice as many a page may hold beside its sentences.
CONTENT_WORDS = 10
#: A text of fewer words has little information.
LITTLE = 40
#: Evidence from which on a document is a response page.
ENOUGH = 3
#: Different texts of little information and hosts that a response's sentence comes from at least, and from which on it speaks for itself.
AGAIN, AGAIN_HOSTS, OFTEN, OFTEN_HOSTS = 3, 2, 6, 3
#: Of its texts, the share at most that may have much information.
IN_CONTENT = 0.2


def _carrier(text: str, at: int) -> str:
    """The (up to two) words before a slot on its line."""
    line = text[max(0, at - 48) : at].rpartition("\n")[2]
    line = re.split(r"(?<=[.!?])\s", line)[-1]
    return " ".join(line.lower().split()[-2:])


def examine(text: str) -> dict:
    """The findings about one text."""
    strong: set[str] = set()
    weak: list[tuple[str, str]] = []
    carriers: set[str] = set()
    if any(o in text for o in _OPENS):
        for rx in _STRONG:
            for m in rx.finditer(text):
                strong.add(m.group("n").lower())
                if (c := _carrier(text, m.start())) and c[-1:] not in ".!?":
                    carriers.add(c)
    if any(o in text for o in _MAYBE):
        for rx in _WEAK:
            for m in rx.finditer(text):
                n = m.group("n").lower()
                if n not in _HTML and not (n in strong):
                    weak.append((n, _carrier(text, m.start())))
    empty = []
    if any(w in text for w in _BLANKS):
        for m in _EMPTY.finditer(text):
            if text[m.end() : m.end() + 1] in ("", ",", ".", "!", "\n", ";", ":"):
                empty.append(_carrier(text, m.start()))
    plain = _TAGS.sub(". ", text) if "<" in text else text
    folded = text.casefold()
    lorem = words = 0
    if any(w in folded for w in _LATIN):  # filler copy is counted over the whole text, word by word
        every = [w.lower() for w in _WORD.findall(plain)]
        words, lorem = len(every), sum(w in LOREM for w in every)
    parts = [p for p in (s.strip() for s in _SENT.split(plain)) if p]
    little = len(plain.split(None, LITTLE)) < LITTLE
    # a sentence of so many words stands in no text of little information
    prints = [_print(p) for p in (parts if little else (p for p in parts if p.count(" ") < LITTLE))]
    sizes = [len(p.split()) for p in parts] if little else []
    page = fill = furniture = body = 0
    body_terms: set[str] = set()
    title: set[str] | None = None
    on = None
    for i, s in enumerate(parts):
        if body >= 2 * CONTENT_WORDS:
            break  # ``body`` only grows, and from here on no count below decides about anything
        ws = _WORD.findall(_LINK.sub(" ", s) if "://" in s else s)
        ws = [w for w in ws if not re.search(rf"[@#]{re.escape(w)}", s)] if "@" in s or "#" in s else ws
        low = [w.lower() for w in ws]
        heading = title is None
        if heading:  # a title stands on a line of its own, or in the first tags
            own_line = "\n" in plain[plain.find(s) + len(s) :][:2] or plain is not text and text.lstrip().startswith("<")
            title = {w for w in low if len(w) > 3} if own_line else set()
        if on is None:
            on = detectors().awake(folded)
        if len(ws) >= 3 and sum(w in LOREM for w in low) >= 0.7 * len(ws):
            continue
        if len(ws) < 12 and _any(on["furniture"], s):
            furniture += 1
        elif len(ws) <= 14 and _any(on["fill"], s):
            fill += 1
        elif _any(on["page"], s) and not (len(ws) >= 7 and _TELLS.search(s) and not re.search(r"(?i)\b(?:sorry|oops|your browser|our servers?)\b", s)):
            page += 1
        else:
            body += len(ws)
        if not (heading and title):
            body_terms.update(w for w in low if len(w) > 3)
    slugs = [_SLUG.findall(u.lower().partition("//")[2].partition("/")[2]) for u in _LINK.findall(text)] if "://" in text else []
    told = (title or set()).union(*(s for s in slugs if len(s) > 1))  # a single run of letters may be a short link
    return {
        "strong": sorted(strong), "weak": [{"name": n, "carrier": c} for n, c in weak], "carriers": sorted(carriers), "empty": empty,
        "page": page, "filler": fill, "furniture": furniture, "body_words": body, "lorem_words": lorem, "words": words,
        "told": len(told) if body_terms else 0, "taken_up": len(told & body_terms), "little": little, "prints": prints, "sizes": sizes, "whole": xxhash.xxh64_intdigest(text) - 2**63,
    }


_REFERENCE = re.compile(r"[\d@#]|://")


def _print(sentence: str) -> int:
    """The fingerprint of a sentence, with changing references masked."""
    if _REFERENCE.search(sentence):
        sentence = _MASK.sub("0", sentence)
    return xxhash.xxh64_intdigest(sentence) - 2**63


FINDINGS = "strong array<string>, weak array<struct<name:string,carrier:string>>, carriers array<string>, empty array<string>, page int, filler int, furniture int, body_words int, lorem_words int, words int, told int, taken_up int, little boolean, prints array<bigint>, sizes array<int>, whole bigint"


def _arrow(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct(
        [("strong", pa.list_(pa.string())), ("weak", pa.list_(pa.struct([("name", pa.string()), ("carrier", pa.string())]))), ("carriers", pa.list_(pa.string())), ("empty", pa.list_(pa.string())), *((n, pa.int32()) for n in ("page", "filler", "furniture", "body_words", "lorem_words", "words", "told", "taken_up")), ("little", pa.bool_()), ("prints", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("whole", pa.int64())]
    )
    for b in it:
        found = pa.array([examine(t) for t in b["text"].to_pylist()], kind)
        yield pa.RecordBatch.from_arrays([b["key"], b["host"], *found.flatten()], names=["key", "host", *[f.name for f in kind]])


def response_wording(f: DataFrame) -> DataFrame:
    """(whole, again, often): of texts of little information the share of words in sentences of responses.

    Sentences are counted by different texts and hosts among texts of little information; only those that come
    again are looked up in the rest. Everything is counted over all rows; what is broadcast is size-checked.
    """
    low = f.where("little").select("host", "whole", F.explode("prints").alias("print"))
    seen = low.groupBy("print").agg(F.countDistinct("whole").alias("texts"), F.countDistinct("host").alias("hosts")).where((F.col("texts") >= AGAIN) & (F.col("hosts") >= AGAIN_HOSTS))
    seen = cut_lineage(seen)
    rest = f.where("NOT little").select(F.explode(F.array_distinct("prints")).alias("print"))
    content = rest.join(broadcast_if_small(seen.select("print"), 1_000_000), "print", "left_semi").groupBy("print").agg(F.count(F.lit(1)).alias("content"))
    said = seen.join(content, "print", "left").where(F.coalesce("content", F.lit(0)) <= IN_CONTENT * F.col("texts"))
    said = said.select("print", ((F.col("texts") >= OFTEN) & (F.col("hosts") >= OFTEN_HOSTS)).alias("often"))
    texts = f.where("little").groupBy("whole").agg(F.first("prints").alias("prints"), F.first("sizes").alias("sizes"))
    each = texts.select("whole", F.aggregate("sizes", F.lit(0), lambda a, x: a + x).alias("total"), F.explode(F.arrays_zip(F.col("prints").alias("print"), F.col("sizes").alias("size"))).alias("p")).select("whole", "total", "p.print", "p.size")
    met = each.join(said, "print")
    share = lambda c: F.try_divide(F.sum(c), F.first("total"))
    return met.groupBy("whole").agg(share(F.col("size")).alias("again"), share(F.when(F.col("often"), F.col("size")).otherwise(0)).alias("often"))


def residue_evidence(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """(key, reason): documents marked, with why: slot, empty value, filler, error page or script notice.

    Null texts are never marked, nor are empty ones (they hold no residue). Keys may repeat: the rows of a
    key are judged each for itself and the key comes out once, with its first reason by name. A null host
    counts as one host.
    """
    src = spread(docs.select(F.col(key).alias("key"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL"))
    kt = docs.schema[key].dataType.simpleString()
    f = src.mapInArrow(_arrow, f"key {kt}, host string, {FINDINGS}")
    f = cut_lineage(f)  # findings and fingerprints only; the texts are read once

    slots = f.where("size(strong) > 0").select("key", F.lit("slot").alias("reason"))
    names = f.select(F.explode("strong").alias("name")).distinct()
    carriers = f.select(F.explode("carriers").alias("carrier")).groupBy("carrier").count().where("count >= 2").select("carrier")
    weak = f.select("key", F.explode("weak").alias("w")).select("key", "w.name", "w.carrier")
    greeting = r"(?:^|\s)(?:" + "|".join(re.escape(s) for s in SALUTATIONS) + r")"
    greeted = F.col("carrier").isin(*SALUTATIONS) | F.col("carrier").rlike(greeting + "$")
    # what a weak slot shows by itself: a name of several parts or a greeting before it; else names and phrases learned
    dotted = F.col("name").rlike(_DOTTED) & ~F.col("name").rlike(_SITES)
    known = names, carriers  # slots are rare: where the learned ones are few, AQE broadcasts them
    told = weak.where(F.col("name").contains("_") | dotted | F.col("carrier").rlike(greeting + ",?$")).select("key")
    told = told.unionByName(weak.join(known[0], "name", "left_semi").select("key")).unionByName(weak.join(known[1], "carrier", "left_semi").select("key"))
    blank = f.select("key", F.explode("empty").alias("carrier"))
    hollow = blank.where(greeted).select("key").unionByName(blank.join(known[1], "carrier", "left_semi").select("key"))

    low = F.col("body_words") < CONTENT_WORDS
    filler = (F.col("lorem_words") >= 0.3 * F.col("words")) & (F.col("lorem_words") >= 3) | (F.col("filler") > 0) & low
    page = (F.col("page") > 0) & low
    # one score of all evidence: wording that comes again in little texts of several hosts, title and slugs against the body, furniture, cues
    mismatch = F.when(F.col("taken_up") >= 2, -2).when((F.col("told") > 0) & (F.col("taken_up") <= F.when(F.col("told") >= 4, 1).otherwise(0)), 1).otherwise(0)
    rest = F.least(F.col("furniture"), F.lit(1)) + mismatch
    wording = F.when(F.coalesce("often", F.lit(0.0)) >= 0.9, ENOUGH).when(F.coalesce("again", F.lit(0.0)) >= 0.9, ENOUGH - 1).otherwise(0)
    cue = F.when(page, 2 + ENOUGH).when((F.col("page") > 0) | (F.col("filler") > 0), 1).otherwise(0)
    again = response_wording(f)
    candidates = f.where("little OR page > 0 OR filler > 0 OR lorem_words > 0")
    judged = candidates.join(again, "whole", "left").select("key", F.when(filler, "filler").when((wording > 0) & (wording + rest >= ENOUGH), "repeated page").when((cue + wording + rest >= ENOUGH) & (page | (wording > 0)), "page").alias("reason"))
    parts = slots.unionByName(told.select("key", F.lit("slot").alias("reason"))).unionByName(hollow.select("key", F.lit("empty value").alias("reason")))
    return parts.unionByName(judged.where("reason IS NOT NULL")).groupBy("key").agg(F.min("reason").alias("reason")).withColumnRenamed("key", key)
