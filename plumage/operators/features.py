"""Term statistics by class and fold, feature scores and selection, Naive Bayes.

Every function takes a table of documents with columns ``doc``, ``class``, ``fold`` and ``tokens`` and works
for all folds at once: ``v`` is the fold held out, and -1 stands for none (all documents train).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumage.session import broadcast_if_small, cut_lineage, is_small

EPS = 0.05


def training_side(docs: DataFrame, folds: int) -> DataFrame:
    """Each document once for every held-out fold it isn't in, and once for -1."""
    v = F.explode(F.filter(F.sequence(F.lit(-1), F.lit(folds - 1)), lambda x: x != F.col("fold")))
    return docs.withColumn("v", v)


def class_frequency(docs: DataFrame, folds: int) -> DataFrame:
    """(v, class, n_docs): counted by fold once, then less the fold's own."""
    per = docs.groupBy("class", "fold").agg(F.count(F.lit(1)).alias("n"))
    return training_side(per, folds).groupBy("v", "class").agg(F.sum("n").alias("n_docs"))


def priors(docs: DataFrame, folds: int) -> DataFrame:
    """(v, class, prior)."""
    f = class_frequency(docs, folds)
    return f.select("v", "class", (F.col("n_docs") / F.sum("n_docs").over(W.partitionBy("v"))).alias("prior"))


def document_frequency(docs: DataFrame, folds: int) -> DataFrame:
    """(v, class, term, df): documents of the class, in training, that have the term."""
    t = docs.select("class", "fold", F.explode(F.array_distinct("tokens")).alias("term"))
    per = t.groupBy("class", "fold", "term").agg(F.count(F.lit(1)).alias("n"))
    return training_side(per, folds).groupBy("v", "class", "term").agg(F.sum("n").alias("df"))


def term_frequency(docs: DataFrame, folds: int) -> DataFrame:
    """(v, class, term, tf): occurrences of terms in training."""
    t = docs.select("class", "fold", F.explode("tokens").alias("term"))
    per = t.groupBy("class", "fold", "term").agg(F.count(F.lit(1)).alias("n"))
    return training_side(per, folds).groupBy("v", "class", "term").agg(F.sum("n").alias("tf"))


def zero_filled(tf: DataFrame, value: str) -> DataFrame:
    """Every (v, term) with every class of ``v``; what is missing is 0. Classes are few and broadcast when counted so."""
    classes = broadcast_if_small(tf.select("v", "class").distinct(), 10_000)
    terms = tf.select("v", "term").distinct()
    return terms.join(classes, "v").join(tf.hint("merge"), ["v", "class", "term"], "left").select("v", "class", "term", F.coalesce(value, F.lit(0)).alias(value))


def term_class_counts(docs: DataFrame, folds: int) -> DataFrame:
    """(v, class, term, n11, n01, n10, n00): documents in or out of the class, with or without the term."""
    df = zero_filled(document_frequency(docs, folds), "df")
    cf = broadcast_if_small(class_frequency(docs, folds).withColumn("n", F.sum("n_docs").over(W.partitionBy("v"))), 100_000)
    total = F.sum("df").over(W.partitionBy("v", "term"))
    j = df.withColumn("_all", total).join(cf, ["v", "class"])
    n11, n10 = F.col("df"), F.col("_all") - F.col("df")
    n01 = F.col("n_docs") - n11
    return j.select("v", "class", "term", n11.alias("n11"), n01.alias("n01"), n10.alias("n10"), (F.col("n") - n11 - n10 - n01).alias("n00"))


def mutual_information(n11: Column, n01: Column, n10: Column, n00: Column) -> Column:
    n = n11 + n01 + n10 + n00

    def part(c: Column, row: Column, col: Column) -> Column:
        return c / n * F.log2((EPS + n * c) / (EPS + row * col))

    return part(n11, n10 + n11, n11 + n01) + part(n01, n00 + n01, n11 + n01) + part(n10, n10 + n11, n10 + n00) + part(n00, n00 + n01, n00 + n10)


def chi_square(n11: Column, n01: Column, n10: Column, n00: Column) -> Column:
    n = n11 + n01 + n10 + n00
    cross = (n11 * n00 - n10 * n01).cast("double") + EPS
    return (n + EPS) * cross * cross / ((n11 + n01 + EPS) * (n11 + n10 + EPS) * (n10 + n00 + EPS) * (n01 + n00 + EPS))


def scores(docs: DataFrame, folds: int, utility: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """(v, class, term, score): any utility of the four counts."""
    c = term_class_counts(docs, folds)
    return c.select("v", "class", "term", utility(*[F.col(x).cast("double") for x in ("n11", "n01", "n10", "n00")]).alias("score"))


def frequency_scores(docs: DataFrame, folds: int) -> DataFrame:
    return term_frequency(docs, folds).select("v", "class", "term", F.col("tf").cast("double").alias("score"))


def top_terms(scored: DataFrame, k: int) -> DataFrame:
    """(v, class, term, score, rank): the ``k`` best of each class; ties go to the greater term."""
    w = W.partitionBy("v", "class").orderBy(F.desc(F.round("score", 9)), F.desc("term"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---- Naive Bayes -----------------------------------------------------------------------------------


def train_bayes(docs: DataFrame, folds: int, features: DataFrame | None = None, alpha: float = 1.0) -> DataFrame:
    """(v, class, term, cond): (count + alpha) / (tokens of the class + alpha * vocabulary), zeros filled in.

    ``features`` (v, class, term) keeps a class's own terms only; the vocabulary is what any class still has.
    """
    tf = term_frequency(docs, folds)
    if features is not None:
        tf = tf.join(features.select("v", "class", "term").distinct(), ["v", "class", "term"], "left_semi")
    full = zero_filled(tf, "tf")
    sums = full.groupBy("v", "class").agg(F.sum("tf").alias("_t"), F.count(F.lit(1)).alias("_v"))
    return full.join(broadcast_if_small(sums, 10_000), ["v", "class"]).select("v", "class", "term", ((F.col("tf") + alpha) / (F.col("_t") + alpha * F.col("_v"))).alias("cond"))


def bayes_scores(test: DataFrame, cond: DataFrame, prior: DataFrame) -> DataFrame:
    """(v, doc, class, score): log2 prior plus the sum over occurrences of log2 cond; unknown terms say nothing.

    ``test`` has v, doc, tokens. A class without prior in a training part can't win there: it isn't scored.
    Spark takes rows of exploded tokens for as few as the files are small, so every join of terms or documents says
    how it is made: the model meets the tokens where they are if it is proven to be small, else by a merge.
    """
    kind = prior.schema["class"].dataType.simpleString()
    classes = F.array(*[F.lit(r["class"]) for r in prior.select("class").where("class IS NOT NULL").distinct().orderBy("class").collect()]).cast(f"array<{kind}>")
    at = F.array_position(classes, F.col("class")).cast("int")
    one = F.struct(at.alias("k"), F.log2("cond").alias("l"))
    model = cut_lineage(cond.where(at > 0).groupBy("v", "term").agg(F.map_from_entries(F.collect_list(one)).alias("_m")))  # a number a class
    tokens = test.select("v", "doc", F.explode("tokens").alias("term"))
    few = is_small(model, 100_000, 8 << 20)
    if not few:  # a held-out part asks for few of the terms that the others have
        model = cut_lineage(model.join(tokens.select("v", "term").distinct().hint("merge"), ["v", "term"], "left_semi"))
        few = is_small(model, 100_000, 8 << 20)
    met = tokens.join(F.broadcast(model) if few else model.hint("merge"), ["v", "term"])
    said = met.select("v", "doc", F.explode("_m").alias("k", "l")).groupBy("v", "doc", "k").agg(F.sum("l").alias("said")).withColumn("class", F.get(classes, F.col("k") - 1))
    every = test.select("v", "doc").join(broadcast_if_small(prior, 10_000), "v")
    return every.join(said.hint("merge"), ["v", "doc", "class"], "left").select("v", "doc", "class", (F.log2("prior") + F.coalesce("said", F.lit(0.0))).alias("score"))


def best_class(scored: DataFrame) -> DataFrame:
    """(v, doc, guess): the class of the highest score, ties by name."""
    w = W.partitionBy("v", "doc").orderBy(F.desc(F.round("score", 9)), "class")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("v", "doc", F.col("class").alias("guess"))


def class_shares(scored: DataFrame) -> DataFrame:
    """(v, doc, class, share): 2 to the score, as shares; scaled by the best first, so nothing underflows."""
    w = W.partitionBy("v", "doc")
    p = F.pow(F.lit(2.0), F.col("score") - F.max("score").over(w))
    return scored.select("v", "doc", "class", (p / F.sum(p).over(w)).alias("share"))


def cross_validate(docs: DataFrame, folds: int, features: DataFrame | None = None, alpha: float = 1.0, uniform: bool = False) -> DataFrame:
    """(v, doc, guess): each document classified by the model that didn't see its fold, all folds in one plan."""
    cond = train_bayes(docs, folds, features, alpha).where("v >= 0")
    prior = priors(docs, folds).where("v >= 0")
    if uniform:
        prior = prior.select("v", "class", F.lit(1.0).alias("prior"))
    return best_class(bayes_scores(docs.select(F.col("fold").alias("v"), "doc", "tokens"), cond, prior))


def sweep(docs: DataFrame, folds: int, scored: DataFrame, ks: list[int]) -> DataFrame:
    """(k, accuracy), over the folds' mean, of the best ``k`` terms of each class: ranked once, all k in one plan.

    A pair (k, held-out fold) takes the place of the fold. What the ranking leaves, at most the greatest k of each class and
    fold, is written to the checkpoint folder with its counts, so that no later plan holds the scores again.
    """
    ranked = cut_lineage(top_terms(scored.where("v >= 0"), max(ks)).select("v", "class", "term", "rank"))
    best = F.broadcast(ranked) if is_small(ranked, 100_000) else ranked.hint("merge")
    m = len(ks)
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i")) for i, k in enumerate(ks)]))
    kept = cut_lineage(term_frequency(docs, folds).where("v >= 0").join(best, ["v", "class", "term"]).select("v", "class", "term", "tf", "rank"))
    tf = kept.withColumn("g", grid).where("rank <= g.k").select((F.col("v") * m + F.col("g.i")).alias("v"), "class", "term", "tf")
    full = zero_filled(tf, "tf")
    sums = full.groupBy("v", "class").agg(F.sum("tf").alias("_t"), F.count(F.lit(1)).alias("_v"))
    cond = full.join(broadcast_if_small(sums, 100_000), ["v", "class"]).select("v", "class", "term", ((F.col("tf") + 1) / (F.col("_t") + F.col("_v"))).alias("cond"))
    prior = cut_lineage(priors(docs, folds).where("v >= 0")).withColumn("g", grid).select((F.col("v") * m + F.col("g.i")).alias("v"), "class", "prior")
    test = docs.withColumn("g", grid).select((F.col("fold") * m + F.col("g.i")).alias("v"), "doc", "tokens", F.col("class"))
    guess = best_class(bayes_scores(test, cond, prior))
    right = test.select("v", "doc", "class").join(guess.hint("merge"), ["v", "doc"])
    by_fold = right.groupBy("v").agg(F.avg((F.col("guess") == F.col("class")).cast("double")).alias("a"))
    k_of = F.element_at(F.array(*[F.lit(k) for k in ks]), (F.pmod(F.col("v"), F.lit(m)) + 1).cast("int"))
    return by_fold.groupBy(k_of.alias("k")).agg(F.avg("a").alias("accuracy"))


def tfidf(docs: DataFrame) -> DataFrame:
    """(doc, term, tfidf): count / length times ln(documents / document frequency)."""
    tf = docs.select("doc", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy("doc", "len", "term").agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    return tf.join(df, "term").join(F.broadcast(n), F.lit(True)).select("doc", "term", (F.col("n") / F.col("len") * F.ln(F.col("n_docs") / F.col("df"))).alias("tfidf"))
