"""Hashtag segmentation: n-gram language model, beam search, features and measures."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumage.functions.porter import stems
from plumage.functions.text import camel_split, tokens
from plumage.session import broadcast_if_small

BACKOFF = 0.4


def ngram_counts(docs: DataFrame, tokens: str, most: int = 3) -> DataFrame:
    """(ngram, n, count) of the token arrays, words joined by blanks."""
    t = F.col(tokens)
    none = F.array().cast("array<struct<ngram:string,n:int>>")

    def grams(k: int) -> Column:
        one = lambda i: F.struct(F.array_join(F.slice(t, i + 1, k), " ").alias("ngram"), F.lit(k).alias("n"))
        return F.when(F.size(t) >= k, F.transform(F.sequence(F.lit(0), F.size(t) - k), one)).otherwise(none)

    every = F.concat(*[grams(k) for k in range(1, most + 1)])
    return docs.select(F.inline(every)).groupBy("ngram", "n").agg(F.count(F.lit(1)).alias("count"))


def log_counts(counts: DataFrame, key: str, count: str) -> DataFrame:
    """(key, log10 of the sum + 1), keys trimmed and in lower case."""
    return counts.groupBy(F.lower(F.trim(F.col(key))).alias(key)).agg(F.log10(F.sum(count) + 1).alias("log_count"))


class LanguageModel:
    """Stupid backoff over words, two words of context; unknown words cost by their length."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``total``: occurrences of all words, where ``counts`` has only some of the n-grams."""
        self.c = counts
        self.total = max(1, sum(n for g, n in counts.items() if " " not in g) if total is None else total)

    def score(self, word: str, before: tuple[str, ...]) -> float:
        """log10 score of a word after up to two others."""
        penalty = 0.0
        for k in range(min(2, len(before)), 0, -1):
            context = " ".join(before[-k:])
            n = self.c.get(f"{context} {word}", 0)
            if n:
                return penalty + math.log10(n / self.c[context])
            penalty += math.log10(BACKOFF)
        n = self.c.get(word, 0)
        return penalty + (math.log10(n / self.total) if n else math.log10(1 / self.total) - len(word))

    def phrase(self, words: list[str]) -> float:
        return sum(self.score(w, tuple(words[max(0, i - 2) : i])) for i, w in enumerate(words))


def grams_within(tags: DataFrame, tag: str, docs: DataFrame, words: str, most: int = 3) -> DataFrame:
    """(tag, grams): of each tag the n-grams of the token arrays that a way to write it can ask for, array<struct<ngram, count>>.

    Those are the n-grams that spell a part of the tag. The model of all ``docs`` is nowhere held as a whole: a tag
    has as many of its n-grams as it has parts and ways to cut them, and n-grams of other parts aren't counted.
    """
    low = F.replace(F.lower(tag), F.lit(" "), F.lit(""))
    at = tags.select(tag, low.alias("_t")).distinct().select(tag, "_t", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_t"), F.lit(1)))).alias("_i"))
    every = F.transform(F.sequence(F.col("_i"), F.greatest(F.length("_t"), F.lit(1))), lambda j: F.substring(F.col("_t"), F.col("_i"), j - F.col("_i") + 1))
    parts = at.select(tag, F.explode(every).alias("_part")).distinct()
    known = broadcast_if_small(parts.select("_part").distinct(), 500_000, 16 << 20)
    w = F.col(words)
    runs = docs.select(F.explode(F.arrays_zip(*[F.slice(w, i + 1, F.greatest(F.size(w), F.lit(0))).alias(f"w{i}") for i in range(most)])).alias("r")).select("r.*")
    runs = runs.join(known.withColumnRenamed("_part", "w0"), "w0", "left_semi")
    spelled = lambda k: F.when(F.col(f"w{k}").isNotNull(), F.concat_ws(" ", *[f"w{i}" for i in range(k + 1)]))
    grams = runs.select(F.explode(F.array(*[spelled(k) for k in range(most)])).alias("ngram")).where("ngram IS NOT NULL")
    grams = grams.withColumn("_part", F.replace("ngram", F.lit(" "), F.lit(""))).join(known, "_part", "left_semi")
    counts = grams.groupBy("_part", "ngram").agg(F.count(F.lit(1)).alias("count"))
    j = parts.join(counts.hint("merge"), "_part", "left")  # as large as the texts make it
    return j.groupBy(tag).agg(F.collect_list(F.when(F.col("ngram").isNotNull(), F.struct("ngram", "count"))).alias("grams"))


def segment(target: str, k: int, lm: LanguageModel) -> list[tuple[str, float]]:
    """The ``k`` best ways to write a word as words, best first by the search's order.

    Best-first over prefixes: at most ``k`` nodes are expanded for each prefix length; the search ends with
    ``k`` complete ways. Equal scores go by the text. An empty target has none.
    """
    low = target.lower()
    heap = [(-lm.score(low[:i], ()), target[:i], i, (low[:i],)) for i in range(1, len(target) + 1)]
    heapq.heapify(heap)
    used = [0] * (len(target) + 1)
    out: list[tuple[str, float]] = []
    while heap and len(out) < k:
        cost, text, end, words = heapq.heappop(heap)
        if end == len(target):
            out.append((text, -cost))
        elif used[end] < k:
            used[end] += 1
            for j in range(end + 1, len(target) + 1):
                w = low[end:j]
                heapq.heappush(heap, (cost - lm.score(w, words[-2:]), f"{text} {target[end:j]}", j, (*words[-2:], w)))
    return out


def with_segments(tags: DataFrame, tag: str, docs: DataFrame, words: str, k: int = 5) -> DataFrame:
    """(tag, candidates): the distinct tags, without leading ``#``, with array<struct<seg, score>>.

    The model is that of all token arrays ``words`` of ``docs``.
    """
    t = tags.select(F.regexp_replace(F.col(tag), "^#+", "").alias(tag)).where(F.length(tag) > 0).distinct()
    total = docs.agg(F.sum(F.greatest(F.size(words), F.lit(0)))).first()[0] or 0
    kind = pa.list_(pa.struct([("seg", pa.string()), ("score", pa.float64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cells = []
            for x, grams in zip(b.column(0), b.column(1)):
                lm = LanguageModel({g["ngram"]: g["count"] for g in grams.as_py()}, total)
                cells.append([{"seg": s, "score": v} for s, v in segment(x.as_py(), k, lm)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, kind)], names=[tag, "candidates"])

    return grams_within(t, tag, docs, words).mapInArrow(run, f"`{tag}` string, candidates array<struct<seg:string,score:double>>")


# ---- gold and measures -----------------------------------------------------------------------------


def expand_gold(gold: Column, target: Column) -> Column:
    """Gold segmentations that spell the target: as they are, else with ``'`` or ``-`` gone or a blank, else without points."""
    spelled = lambda g: F.lower(F.replace(g, F.lit(" "), F.lit(""))) == F.lower(target)
    has = lambda g, c: F.contains(g, F.lit(c))
    put = lambda g, c, by: F.replace(g, F.lit(c), F.lit(by))
    none = F.array().cast("array<string>")
    one = lambda g: F.when(spelled(g), F.array(g)).when(has(g, "'"), F.array(put(g, "'", ""), put(g, "'", " "))).when(has(g, "-"), F.array(put(g, "-", ""), put(g, "-", " "))).when(has(g, "."), F.array(put(g, ".", ""))).otherwise(none)
    return F.flatten(F.transform(gold, one))


def _low(a: Column) -> Column:
    return F.transform(a, lambda x: F.lower(x))


def reciprocal_rank(ranked: Column, gold: Column) -> Column:
    """1 / rank of the first right candidate, 0 if none; case doesn't matter."""
    hit = F.array_position(F.transform(_low(ranked), lambda s: F.array_contains(_low(gold), s)), True)
    return F.when(hit > 0, 1.0 / hit).otherwise(0.0)


def right_at(ranked: Column, gold: Column, k: int) -> Column:
    return F.arrays_overlap(F.slice(_low(ranked), 1, k), _low(gold)).cast("double")


def f_at(ranked: Column, gold: Column, k: int) -> Column:
    """The best F1 of token sets over the first ``k`` candidates and the gold ones."""
    words = lambda s: F.array_distinct(F.split(F.lower(s), " "))

    def f1(a: Column, b: Column) -> Column:
        common = F.size(F.array_intersect(a, b)).cast("double")
        return F.coalesce(F.try_divide(2 * common, F.size(a) + F.size(b)), F.lit(0.0))

    return F.array_max(F.flatten(F.transform(F.slice(ranked, 1, k), lambda s: F.transform(gold, lambda g: f1(words(s), words(g))))))


def edit_label(seg: Column, gold: Column) -> Column:
    """Minus the least edit distance to a gold segmentation, without case."""
    return -F.array_min(F.transform(gold, lambda g: F.levenshtein(F.lower(seg), F.lower(g))))


# ---- features --------------------------------------------------------------------------------------


def _num(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


CONSONANTS = "qwrtypsdfghjklzxcvbnm"  # fixed value: y counts as one
_PART = {"xxdd": "^([a-z]+)([0-9]+)$", "ddxx": "^([0-9]+)([a-z]+)$", "xxXX": "^([a-z]+)([A-Z]+)$"}


def _squeezed(seg: Column) -> Column:
    """A segmentation without any blanks: the tag it is of."""
    return F.array_join(tokens(seg), "")


def word_shapes(seg: Column) -> list[Column]:
    """Seven shapes of a candidate of two tokens or more: letters then digits (the digits are the second token),
    digits then letters (the digits are the first), camel case, underscores, digits, abbreviation (nothing but
    consonants, uncut), small letters then capitals (the capitals are the second token)."""
    target = _squeezed(seg)
    low = F.lower(target)
    t = tokens(F.lower(seg))
    token = lambda i: F.when(F.size(t) > 1, F.get(t, F.lit(i)))
    part = lambda c, shape, i: F.when(c.rlike(_PART[shape]), F.regexp_extract(c, _PART[shape], i))
    spaced = F.trim(F.replace(target, F.lit("_"), F.lit(" _ ")))
    return [
        _num(part(low, "xxdd", 2) == token(1)).alias("xxdd"),
        _num(part(low, "ddxx", 1) == token(0)).alias("ddxx"),
        _num((F.array_join(camel_split(target), " ") == seg) & (low != target)).alias("camel"),
        _num(F.contains(target, F.lit("_")) & (spaced == seg)).alias("underscore"),
        _num(target.rlike(r"^\p{Nd}+$") & (seg == target)).alias("digits"),
        _num(low.rlike(f"^[{CONSONANTS}]*$") & (low == F.lower(seg))).alias("abbreviation"),
        _num(F.lower(part(target, "xxXX", 2)) == token(1)).alias("xxXX"),
    ]


def length_histogram(seg: Column, buckets: int = 20) -> Column:
    """How many tokens have length 1 to ``buckets``; longer ones count in the last."""
    t = tokens(seg)
    return F.transform(F.sequence(F.lit(1), F.lit(buckets)), lambda i: F.size(F.filter(t, lambda w: F.least(F.length(w), F.lit(buckets)) == i)).cast("double"))


def coverage(seg: Column, lexicon: list[str]) -> Column:
    """The length of tokens the lexicon has, over the number of tokens."""
    t = F.split(F.lower(seg), " ")
    hit = F.filter(t, lambda w: w.isin(*lexicon))
    return F.aggregate(hit, F.lit(0.0), lambda a, w: a + F.length(w)) / F.size(t)


TAG_FEATURES = ("length", "single_word", "count_tag", "count_best", "in_dictionary", "in_titles", "in_title_tokens", "in_slang", "digit_tag", "no_vowel", "digits_letters", "letters_digits", "camel_tag")


def _flags(terms: DataFrame) -> DataFrame:
    """(term, one 0/1 column a kind) of (term, kind), in lower case and trimmed, but for titles, which keep the blank that cut brackets leave."""
    t = F.lower(F.when(F.col("kind") == "title", F.col("term")).otherwise(F.trim("term")))
    return terms.where(F.col("term").isNotNull()).groupBy(t.alias("term")).agg(*[F.max((F.col("kind") == k).cast("double")).alias(k) for k in ("dictionary", "title", "title_token", "slang")])


def title_terms(titles: DataFrame, title: str) -> DataFrame:
    """(term, kind): titles in lower case without what stands in brackets, and the words of them."""
    low = F.regexp_replace(F.lower(F.trim(F.col(title))), r"[(\[].*?[)\]]", "")
    both = F.array_distinct(F.concat(F.array(F.struct(low.alias("term"), F.lit("title").alias("kind"))), F.transform(tokens(low), lambda w: F.struct(w.alias("term"), F.lit("title_token").alias("kind")))))
    return titles.where(F.col(title).isNotNull()).select(F.inline(both)).distinct()


def tag_features(candidates: DataFrame, seg: str, best: str, counts: DataFrame, terms: DataFrame) -> DataFrame:
    """``candidates`` with the thirteen TAG_FEATURES of the tag that ``seg`` is a segmentation of.

    Length; whether the best candidate is one word; counts (``counts``: key, log_count) of the tag and of the
    best candidate, 0 where unknown; whether ``terms`` (term, kind) has the tag as a dictionary word, title, word
    of a title or slang; digits only; consonants only; digits then letters; letters then digits; camel case of a
    tag that is no title. Lookups are equi-joins on distinct keys, so Spark broadcasts what it knows to be small.
    """
    flags, many = _flags(terms), F.size(tokens(F.col(best)))
    one = counts.groupBy(F.lower(F.trim("key")).alias("_k")).agg(F.max("log_count").alias("_n"))
    c = candidates.withColumn("_org", _squeezed(F.col(seg))).withColumn("_low", F.lower("_org")).withColumn("_best", F.lower(best))
    c = c.join(flags, c["_low"] == flags["term"], "left").drop("term")
    for k, out in (("_low", "count_tag"), ("_best", "count_best")):
        c = c.join(one.withColumnsRenamed({"_k": k, "_n": out}), k, "left")
    low, zero = F.col("_low"), lambda n: F.coalesce(F.col(n), F.lit(0.0))
    values = [
        F.length(low).cast("double"), _num(many == 1), zero("count_tag"), zero("count_best"), zero("dictionary"), zero("title"), zero("title_token"), zero("slang"), _num(low.rlike(r"^\p{Nd}+$")), _num(low.rlike(f"^[{CONSONANTS}]*$")),
        _num(low.rlike(_PART["ddxx"])), _num(low.rlike(_PART["xxdd"])), _num((F.size(camel_split(F.col("_org"))) > 1) & (zero("title") == 0)),
    ]
    return c.select(*candidates.columns, *[v.alias(n) for v, n in zip(values, TAG_FEATURES)])


def candidate_features(candidates: DataFrame, seg: str, scores: list[str], counts: list[DataFrame], terms: DataFrame, out: str = "features") -> DataFrame:
    """``candidates`` with the vector of a candidate: model ``scores`` (columns), its count in each of ``counts``
    (key, log_count), 20 lengths, 7 shapes, whether it is a title and a word of titles, whether it is slang, and the
    share of its letters in words of the dictionary or slang per token.

    A candidate of one word is looked up by its stem too.
    """
    flags = _flags(terms)
    c = candidates.withColumn("_id", F.monotonically_increasing_id()).withColumn("_low", F.lower(seg)).withColumn("_words", tokens(F.lower(seg)))
    stem = F.when(F.size("_words") == 1, F.get(stems(F.array("_low")), F.lit(0)))
    c = c.withColumn("_stem", stem)
    for i, n in enumerate(counts):
        one = n.groupBy(F.lower(F.trim("key")).alias("_low")).agg(F.max("log_count").alias(f"_n{i}"))
        c = c.join(one, "_low", "left")
    for key, mark in (("_low", "a"), ("_stem", "b")):
        side = flags.select(F.col("term").alias(key), *[F.col(k).alias(f"_{mark}_{k}") for k in ("title", "title_token", "slang")])
        c = c.join(side, key, "left")
    # letters in known words, summed per distinct text so that the rows themselves aren't shuffled twice
    words = candidates.select(F.lower(seg).alias("_low")).distinct().select("_low", F.explode(tokens(F.col("_low"))).alias("term"))
    known = words.join(flags.where("dictionary > 0 OR slang > 0").select("term"), "term").groupBy("_low").agg(F.sum(F.length("term")).cast("double").alias("_known"))
    c = c.join(known, "_low", "left")
    flag = lambda k: F.greatest(F.coalesce(F.col(f"_a_{k}"), F.lit(0.0)), F.coalesce(F.col(f"_b_{k}"), F.lit(0.0)))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0)).cast("double")
    share = F.coalesce(F.try_divide(zero("_known"), F.size("_words")), F.lit(0.0))
    vector = F.concat(F.array(*[F.col(s).cast("double") for s in scores], *[zero(f"_n{i}") for i in range(len(counts))]), length_histogram(F.col(seg)), F.array(*word_shapes(F.col(seg)), flag("title"), flag("title_token"), flag("slang"), share))
    return c.select(*candidates.columns, vector.alias(out))


def replace_tags(texts: DataFrame, key: str, text: str, segmented: DataFrame, tag: str = "tag", seg: str = "seg") -> DataFrame:
    """(key, text): every ``#tag`` token that the table has is replaced by its segmentation; all in lower case.

    Tokens are joined by single blanks. Only the tags meet the table, each distinct one of a text once.
    """
    toks = tokens(F.col(text))
    is_tag = lambda t: t.startswith("#") & (F.length(t) > 1)
    t = texts.select(F.col(key).alias("key"), toks.alias("toks"))
    own = t.select("key", F.explode(F.array_distinct(F.filter("toks", is_tag))).alias("_t")).withColumn("tag", F.regexp_replace("_t", "^#+", ""))
    met = own.join(segmented.select(F.col(tag).alias("tag"), F.col(seg).alias("seg")), "tag").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("_t", "seg"))).alias("segs"))  # a text's own tags
    j = t.join(met, "key", "left").withColumn("segs", F.coalesce("segs", F.create_map().cast("map<string,string>")))
    new = F.transform("toks", lambda x: F.coalesce(F.try_element_at(F.col("segs"), x), x))
    return j.select(F.col("key").alias(key), F.lower(F.array_join(new, " ")).alias(text))

