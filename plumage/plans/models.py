"""Queries over term statistics, classifiers and their measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumage.functions import text as X
from plumage.functions.text import tokens
from plumage.operators import features as T
from plumage.operators import knn as K
from plumage.operators import metrics as M
from plumage.plans.registry import Registry

reg = Registry()
FOLDS = 5

#: Labelled texts: rated ones, by sentiment; the fold is the row's number modulo 5.
_DOCS = rf"""docs AS (SELECT rating_id AS doc, mask_sentiment AS class, (rating_id % 5)::INT AS fold, list_filter(string_split_regex(lower(full_text), '[{X.WHITE}]+'), lambda x: x <> '') AS tokens FROM rated_tweets WHERE mask_sentiment IS NOT NULL),
  vs AS (SELECT unnest(range(-1, 5))::INT AS v),
  tr AS (SELECT v, docs.* FROM docs, vs WHERE fold <> v),
  cf AS (SELECT v, class, count(*) AS n_docs FROM tr GROUP BY 1, 2),
  prior AS (SELECT v, class, n_docs / sum(n_docs) OVER (PARTITION BY v) AS prior FROM cf),
  df AS (SELECT v, class, term, count(*) AS df FROM (SELECT v, class, doc, unnest(list_distinct(tokens)) AS term FROM tr) GROUP BY 1, 2, 3),
  tf AS (SELECT v, class, term, count(*) AS tf FROM (SELECT v, class, unnest(tokens) AS term FROM tr) GROUP BY 1, 2, 3)"""
_COUNTS = """full_df AS (SELECT t.v, c.class, t.term, coalesce(df, 0) AS df FROM (SELECT DISTINCT v, term FROM df) t JOIN cf c ON c.v = t.v LEFT JOIN df ON df.v = t.v AND df.class = c.class AND df.term = t.term),
  n AS (SELECT f.v, f.class, f.term, df::DOUBLE AS n11, (n_docs - df)::DOUBLE AS n01, (sum(df) OVER (PARTITION BY f.v, f.term) - df)::DOUBLE AS n10, nn::DOUBLE AS nn FROM full_df f JOIN (SELECT *, sum(n_docs) OVER (PARTITION BY v) AS nn FROM cf) c ON c.v = f.v AND c.class = f.class),
  q AS (SELECT *, nn - n11 - n01 - n10 AS n00 FROM n)"""
_MI = """n11/nn*log2((0.05+nn*n11)/(0.05+(n10+n11)*(n11+n01))) + n01/nn*log2((0.05+nn*n01)/(0.05+(n00+n01)*(n11+n01))) + n10/nn*log2((0.05+nn*n10)/(0.05+(n10+n11)*(n10+n00))) + n00/nn*log2((0.05+nn*n00)/(0.05+(n00+n01)*(n00+n10)))"""
_CHI = "(nn+0.05)*pow(n11*n00-n10*n01+0.05,2)/((n11+n01+0.05)*(n11+n10+0.05)*(n10+n00+0.05)*(n01+n00+0.05))"


def _model(where: str = "true", alpha: float = 1.0, features: str | None = None, uniform: bool = False) -> str:
    keep = f"SELECT tf.* FROM tf JOIN ({features}) k USING (v, class, term)" if features else "SELECT * FROM tf"
    pr = "1.0" if uniform else "prior"
    return f"""m AS ({keep}), ft AS (SELECT t.v, c.class, t.term, coalesce(m.tf, 0) AS tf FROM (SELECT DISTINCT v, term FROM m) t JOIN (SELECT DISTINCT v, class FROM m) c ON c.v = t.v LEFT JOIN m ON m.v = t.v AND m.class = c.class AND m.term = t.term),
  cond AS (SELECT v, class, term, (tf + {alpha}) / (sum(tf) OVER (PARTITION BY v, class) + {alpha} * count(*) OVER (PARTITION BY v, class)) AS cond FROM ft),
  said AS (SELECT d.fold AS v, d.doc, c.class, sum(log2(c.cond)) AS s FROM (SELECT fold, doc, unnest(tokens) AS term FROM docs) d JOIN cond c ON c.v = d.fold AND c.term = d.term GROUP BY 1, 2, 3),
  sc AS (SELECT d.fold AS v, d.doc, d.class AS truth, p.class, log2({pr}) + coalesce(s, 0) AS score FROM docs d JOIN prior p ON p.v = d.fold LEFT JOIN said ON said.v = d.fold AND said.doc = d.doc AND said.class = p.class),
  pred AS (SELECT v, doc, truth AS class, guess FROM (SELECT v, doc, truth, class AS guess, row_number() OVER (PARTITION BY v, doc ORDER BY round(score, 9) DESC, class) AS r FROM sc) WHERE r = 1)"""


_CLASSES = "cls AS (SELECT class AS c FROM pred UNION SELECT guess FROM pred)"
_CONF = f"{_CLASSES}, conf AS (SELECT a.c AS class, b.c AS guess, (SELECT count(*) FROM pred WHERE pred.class = a.c AND pred.guess = b.c) AS n FROM cls a, cls b)"
_OVR = "ovr AS (SELECT c AS class, count(*) FILTER (WHERE class = c AND guess = c) AS tp, count(*) FILTER (WHERE class <> c AND guess = c) AS fp, count(*) FILTER (WHERE class = c AND guess <> c) AS fn, count(*) FILTER (WHERE class <> c AND guess <> c) AS tn FROM pred, cls GROUP BY c)"
_PER = "per AS (SELECT class, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r, (tp + tn) / (tp + tn + fp + fn) AS a FROM ovr)"


def docs_of(read):
    d = read("rated_tweets").where("mask_sentiment IS NOT NULL")
    return d.select(F.col("rating_id").alias("doc"), F.col("mask_sentiment").alias("class"), (F.col("rating_id") % 5).cast("int").alias("fold"), tokens(F.lower("full_text")).alias("tokens"))


@reg.query("class_frequency", f"WITH {_DOCS} SELECT * FROM cf")
def class_frequency(read):
    return T.class_frequency(docs_of(read), FOLDS)


@reg.query("prior", f"WITH {_DOCS} SELECT v, class, round(prior, 9) AS prior FROM prior")
def prior(read):
    return T.priors(docs_of(read), FOLDS).select("v", "class", F.round("prior", 9).alias("prior"))


@reg.query("vocab", rf"SELECT count(DISTINCT t) AS size FROM (SELECT unnest(string_split_regex(lower(full_text), '[{X.WHITE}]+')) AS t FROM rated_tweets WHERE mask_sentiment IS NOT NULL) WHERE t <> ''")
def vocab(read):
    return docs_of(read).select(F.explode("tokens").alias("t")).distinct().agg(F.count(F.lit(1)).alias("size"))


@reg.query("doc_freq", f"WITH {_DOCS} SELECT * FROM df")
def doc_freq(read):
    return T.document_frequency(docs_of(read), FOLDS)


@reg.query("class_tf", f"WITH {_DOCS} SELECT t.v, c.class, t.term, coalesce(tf, 0) AS tf FROM (SELECT DISTINCT v, term FROM tf) t JOIN cf c ON c.v = t.v LEFT JOIN tf ON tf.v = t.v AND tf.class = c.class AND tf.term = t.term")
def class_tf(read):
    return T.zero_filled(T.term_frequency(docs_of(read), FOLDS), "tf")


@reg.query("mi_scores", f"WITH {_DOCS}, {_COUNTS} SELECT v, class, term, round({_MI}, 6) AS score FROM q")
def mi_scores(read):
    return T.scores(docs_of(read), FOLDS, T.mutual_information).select("v", "class", "term", F.round("score", 6).alias("score"))


@reg.query("chi2_scores", f"WITH {_DOCS}, {_COUNTS} SELECT v, class, term, round({_CHI}, 5) AS score FROM q")
def chi2_scores(read):
    return T.scores(docs_of(read), FOLDS, T.chi_square).select("v", "class", "term", F.round("score", 5).alias("score"))


@reg.query("frequency_scores", f"WITH {_DOCS} SELECT v, class, term, tf::DOUBLE AS score FROM tf")
def frequency_scores(read):
    return T.frequency_scores(docs_of(read), FOLDS)


def _top(k: int) -> str:
    return f"SELECT v, class, term, r AS rank FROM (SELECT v, class, term, row_number() OVER (PARTITION BY v, class ORDER BY round({_MI}, 9) DESC, term DESC) AS r FROM q) WHERE r <= {k}"


@reg.query("topk_terms", f"WITH {_DOCS}, {_COUNTS} {_top(20)}")
def topk_terms(read):
    return T.top_terms(T.scores(docs_of(read), FOLDS, T.mutual_information), 20).select("v", "class", "term", "rank")


@reg.query("nb_train", f"WITH {_DOCS}, {_model()} SELECT v, class, term, round(cond, 9) AS cond FROM cond")
def nb_train(read):
    return T.train_bayes(docs_of(read), FOLDS).select("v", "class", "term", F.round("cond", 9).alias("cond"))


@reg.query("nb_classify", f"WITH {_DOCS}, {_model()} SELECT v, doc, class, round(pow(2, score - max(score) OVER w) / sum(pow(2, score - mx)) OVER w, 6) AS share FROM (SELECT *, max(score) OVER (PARTITION BY v, doc) AS mx FROM sc) WINDOW w AS (PARTITION BY v, doc)")
def nb_classify(read):
    d = docs_of(read)
    s = T.bayes_scores(d.select(F.col("fold").alias("v"), "doc", "tokens"), T.train_bayes(d, FOLDS).where("v >= 0"), T.priors(d, FOLDS).where("v >= 0"))
    return T.class_shares(s).select("v", "doc", "class", F.round("share", 6).alias("share"))


def _predictions(read, **kw):
    d = docs_of(read)
    return d.select("doc", "class").join(T.cross_validate(d, FOLDS, **kw).hint("merge"), "doc")


@reg.query("nb_cv", f"WITH {_DOCS}, {_model()} SELECT v, doc, class, guess FROM pred")
def nb_cv(read):
    return _predictions(read).select("v", "doc", "class", "guess")


@reg.query("nb_cv_selected", f"WITH {_DOCS}, {_COUNTS}, {_model(features='SELECT v, class, term FROM (' + _top(50) + ')')} SELECT v, doc, class, guess FROM pred")
def nb_cv_selected(read):
    """Cross-validation on the 50 terms of each class with the most mutual information."""
    top = T.top_terms(T.scores(docs_of(read), FOLDS, T.mutual_information), 50)
    return _predictions(read, features=top).select("v", "doc", "class", "guess")


@reg.query("mnb_uniform", f"WITH {_DOCS}, {_model(alpha=0.1, uniform=True)} SELECT v, doc, class, guess FROM pred")
def mnb_uniform(read):
    return _predictions(read, alpha=0.1, uniform=True).select("v", "doc", "class", "guess")


def _sweep_sql(k: int) -> str:
    top = f"SELECT v, class, term FROM ({_top(k)})"
    return f"SELECT * FROM (WITH {_DOCS}, {_COUNTS}, {_model(features=top)} SELECT {k} AS k, round(avg(a), 6) AS accuracy FROM (SELECT v, avg((class = guess)::INT) AS a FROM pred GROUP BY v))"


@reg.query("k_sweep", " UNION ALL ".join(_sweep_sql(k) for k in (10, 20, 50, 100)))
def k_sweep(read):
    """Mean accuracy by number of terms."""
    d = docs_of(read)
    return T.sweep(d, FOLDS, T.scores(d, FOLDS, T.mutual_information), [10, 20, 50, 100]).select("k", F.round("accuracy", 6).alias("accuracy"))


@reg.query("confusion", f"WITH {_DOCS}, {_model()}, {_CONF} SELECT class, guess, n FROM conf")
def confusion(read):
    return M.confusion(_predictions(read))


@reg.query("one_vs_rest", f"WITH {_DOCS}, {_model()}, {_CLASSES}, {_OVR} SELECT * FROM ovr")
def one_vs_rest(read):
    return M.one_vs_rest(M.confusion(_predictions(read)))


@reg.query("prf_per_class", f"WITH {_DOCS}, {_model()}, {_CLASSES}, {_OVR}, {_PER} SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(a, 6) AS accuracy, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM per")
def prf_per_class(read):
    p = M.per_class(M.one_vs_rest(M.confusion(_predictions(read))))
    return p.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy", "f1")])


@reg.query(
    "prf_macro",
    f"""WITH {_DOCS}, {_model()}, {_CLASSES}, {_OVR}, {_PER}, x AS (SELECT avg(coalesce(p, 0)) AS p, avg(coalesce(r, 0)) AS r FROM per)
        SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1, (SELECT round(avg((class = guess)::INT), 6) FROM pred) AS accuracy, (SELECT round(sum(tp + tn) / sum(tp + tn + fp + fn), 6) FROM ovr) AS pooled_accuracy FROM x""",
)
def prf_macro(read):
    c = M.confusion(_predictions(read))
    m = M.macro(M.one_vs_rest(c), c)
    return m.select(*[F.round(x, 6).alias(x) for x in m.columns])


@reg.query(
    "fold_avg_nullsafe",
    f"""WITH {_DOCS}, {_model()}, {_CLASSES}, g AS (SELECT v, c AS class, count(*) FILTER (WHERE class = c AND guess = c) AS tp, count(*) FILTER (WHERE class <> c AND guess = c) AS fp, count(*) FILTER (WHERE class = c AND guess <> c) AS fn FROM pred, cls GROUP BY v, c),
        h AS (SELECT class, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM g)
        SELECT class, round(CASE WHEN count(p) = count(*) THEN avg(p) END, 6) AS precision, round(CASE WHEN count(r) = count(*) THEN avg(r) END, 6) AS recall FROM h GROUP BY class""",
)
def fold_avg_nullsafe(read):
    p = M.per_class(M.one_vs_rest(M.confusion(_predictions(read), ["v"]), ["v"]), ["v"])
    return M.fold_average(p, ["class"], ["precision", "recall"]).select("class", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@reg.query("tfidf", rf"""WITH d AS (SELECT rating_id AS doc, list_filter(string_split_regex(lower(full_text), '[{X.WHITE}]+'), lambda x: x <> '') AS t FROM rated_tweets WHERE mask_sentiment IS NOT NULL), u AS (SELECT doc, len(t) AS l, unnest(t) AS term FROM d), c AS (SELECT doc, l, term, count(*) AS n FROM u GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1)
    SELECT doc, term, round(n / l * ln((SELECT count(*) FROM d) / df), 6) AS tfidf FROM c JOIN f USING (term)""")
def tfidf(read):
    return T.tfidf(docs_of(read)).select("doc", "term", F.round("tfidf", 6).alias("tfidf"))


def _knn_sql(k: int, metric: str) -> str:
    sim = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])" if metric == "dot" else "-list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
    return f"nb AS (SELECT query, truth, label, r FROM (SELECT a.vec_id AS query, a.label AS truth, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({sim}, 9) DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id) WHERE r <= {k})"


def _neighbours(read, k: int, metric: str = "dot"):
    """The stated query set, every row whose id is divisible by 20, against all other rows, those of the query set included."""
    e = read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    q = e.where("id % 20 = 0")
    return q, K.neighbours(q, e, k, metric, others=True)


def _knn(read, k: int, metric: str = "dot"):
    q, n = _neighbours(read, k, metric)
    return q.select(F.col("id").alias("query"), F.col("label").alias("class")).join(K.vote(n), "query")


_VOTE = "SELECT query, truth AS class, label AS guess FROM (SELECT query, truth, label, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, min(r)) AS o FROM nb GROUP BY 1, 2, 3) WHERE o = 1"


@reg.query("knn1", f"WITH {_knn_sql(1, 'dot')} {_VOTE}")
def knn1(read):
    return _knn(read, 1)


@reg.query("knn3_vote", f"WITH {_knn_sql(3, 'dot')} {_VOTE}")
def knn3_vote(read):
    return _knn(read, 3)


@reg.query("knn_euclid", f"WITH {_knn_sql(1, 'euclid')} {_VOTE}")
def knn_euclid(read):
    return _knn(read, 1, "euclid")


@reg.query("label_spreading")
def label_spreading(read):
    """Labels of every fifth vector spread over the whole table of vectors."""
    e = read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.when(F.col("vec_id") % 5 == 0, F.col("label")).otherwise(-1).alias("label"))
    return K.spread_labels(e)
