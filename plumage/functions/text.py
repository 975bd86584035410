"""Text column functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation and the typographic marks that are stripped with it.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TYPOGRAPHIC = "–—−”“’‘,"
# Unicode white space and the four separators U+001C to U+001F, as a class for Java's and RE2's patterns.
WHITE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Keywords and phrases of mask-related texts.
MASK_KEYWORDS = ("mask", "#mask", "#masks", "#wearamask", "masks", "wear", "mask-wearing")
MASK_PHRASES = ("face covering", "face-mask", "mask wearing")
# A small English function-word list; callers may pass their own.
STOP_WORDS = tuple(
    "i me my we our you your he him his she her it its they them their what which who this that these those am is are was were be been being have has had do does did a an the and but if or because as until while of at by for with about to from in out on off then once here there all any both each few more most other some such only own same so than too very can will just".split()
)


def lower0(c: Column) -> Column:
    """Lower case; null counts as empty."""
    return F.lower(F.coalesce(c, F.lit("")))


def tokens(c: Column) -> Column:
    """Runs of anything but white space of any script; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"[{WHITE}]+"), lambda t: t != "")


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"http[^{WHITE}]+", ""), rf"www\.[^{WHITE}]+", "")


def strip_mentions(c: Column) -> Column:
    return F.regexp_replace(c, f"@[^{WHITE}]+", "")


def strip_punctuation(c: Column, keep_hash: bool = True) -> Column:
    gone = PUNCTUATION + TYPOGRAPHIC
    return F.translate(c, gone.replace("#", "") if keep_hash else gone, "")


def hashtags(c: Column) -> Column:
    """Tokens that start with ``#``."""
    return F.filter(tokens(c), lambda t: t.startswith("#"))


def camel_split(c: Column) -> Column:
    """Words of a camel-case name: borders before a capital that follows a small letter or begins a word."""
    return F.regexp_extract_all(c, F.lit(r".+?(?:(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|$)"), F.lit(0))


def normalise_tokens(toks: Column, stop: tuple[str, ...] = STOP_WORDS, keep_hash: bool = True) -> Column:
    """Lower case, without punctuation, empty tokens and stop words."""
    clean = F.transform(toks, lambda t: strip_punctuation(F.lower(t), keep_hash))
    return F.filter(clean, lambda t: (t != "") & ~t.isin(*stop))


def normalise_text(c: Column, hashtags: str = "drop", stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """A text without links, its tokens normalised and joined; hashtags are dropped or kept."""
    if hashtags not in ("drop", "keep"):
        raise ValueError(f"unknown way with hashtags {hashtags!r}; segmented ones come from the hashtag operators")
    toks = tokens(strip_urls(c))
    if hashtags == "drop":
        toks = F.filter(toks, lambda t: ~(t.startswith("#") & (F.length(t) > 1)))
    return F.array_join(normalise_tokens(toks, stop, keep_hash=False), " ")


def first_contained(hay: Column, terms: list[str]) -> Column:
    """The first of the terms, in list order, that the text contains; null if none."""
    return F.get(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(hay, t)), F.lit(0))


def keyword_or_phrase(c: Column, keywords=MASK_KEYWORDS, phrases=MASK_PHRASES) -> Column:
    """Whether a token is a keyword or the text contains a phrase, in any case; null texts aren't."""
    low = lower0(c)
    hit = F.arrays_overlap(tokens(low), F.array(*[F.lit(k) for k in keywords]))
    for p in phrases:
        hit = hit | F.contains(low, F.lit(p))
    return hit


def conditional(c: Column) -> Column:
    """``if`` or ``unless``, or both ``not`` and ``necessarily``, as tokens."""
    t = tokens(lower0(c))
    has = lambda w: F.array_contains(t, w)
    return has("if") | has("unless") | (has("not") & has("necessarily"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem_name(path: Column) -> Column:
    return F.substring_index(base_name(path), ".", 1)


def id_prefix(c: Column, cut: int = 4) -> Column:
    return F.left(c, F.greatest(F.length(c) - cut, F.lit(0)))


def clean_id(c: Column) -> Column:
    """An identifier written as a number with decimals or exponent, as digits; never by way of a double."""
    return F.trim(c).try_cast("decimal(38,4)").cast("decimal(38,0)").cast("string")


def polarity(c: Column, lexicon: dict[str, float], alpha: float = 15.0) -> Column:
    """struct<neg, neu, pos, compound>: the share of word valences and their normalised sum s/sqrt(s^2+alpha)."""
    table = F.create_map(*[x for k, v in lexicon.items() for x in (F.lit(k), F.lit(float(v)))])
    v = F.transform(normalise_tokens(tokens(c), ()), lambda t: F.coalesce(F.try_element_at(table, t), F.lit(0.0)))
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    part = lambda f: F.aggregate(F.filter(v, f), F.lit(0.0), lambda a, x: a + F.abs(x) + 1)
    pos, neg, neu = part(lambda x: x > 0), part(lambda x: x < 0), F.size(F.filter(v, lambda x: x == 0)).cast("double")
    share = lambda x: F.coalesce(F.try_divide(x, pos + neg + neu), F.lit(0.0))
    return F.struct(share(neg).alias("neg"), share(neu).alias("neu"), share(pos).alias("pos"), (total / F.sqrt(total * total + alpha)).alias("compound"))


def word_tokenize(c: Column) -> Column:
    """Words and marks apart, close to the Treebank rules: contractions are split before the apostrophe."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\b(\w+)(n't)\b", "$1 $2")
    s = F.regexp_replace(s, r"(?i)(\w)('(?:s|m|d|re|ve|ll))\b", "$1 $2")
    s = F.regexp_replace(s, r"(\.\.\.|--|[?!;@#$%&\[\](){}<>\"“”«»])", " $1 ")
    s = F.regexp_replace(s, r"([,:])(?!\d)", " $1 ")
    s = F.regexp_replace(s, r"(?<![.\w]\.)\.(?=\s*$)", " .")
    return tokens(s)
