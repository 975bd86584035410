"""The language of each text and of each stretch of a mixed text, with a confidence.

Method: a bidirectional gated recurrent network over bytes (``bigru``), trained in numpy by backpropagation
through time on a bounded sample of labelled texts, labels every position. Positions are pooled over clauses
(what stands between marks that may part two languages), clauses are joined to stretches by a Viterbi pass in
which a change of language has a price, and texts get the pooled probabilities of their positions. A clause that
the network is unsure of as a whole may hold several languages: a second Viterbi pass over its words cuts it, as
often as that pays.

The labels of the sample may be wrong in part: after a first training, pieces whose label the network
contradicts are left out and training goes on with the rest, among them pieces of two languages glued
together, so that borders are learned too. Everything but the fit runs over all texts, whole. Fitting, keeping
and using the network are apart: ``fit``, ``save_net`` and ``load_net``, ``with_segments``.

Texts are brought to the readable form first, so look-alike letters of another script don't speak for a
language. Handles, hashtags, links, numbers and emoji belong to no language and are taken out first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumage.llm.bigru import BATCH, Adam, BiGru
from plumage.llm.textform import codes_of, normalise, normalise_array, slices
from plumage.session import spread

LANGS = ("en", "fr", "es", "pt", "de", "it", "uk")
# Codes and names of the languages.
LABELS = {
    "en": "en", "eng": "en", "english": "en", "anglais": "en", "inglés": "en", "inglês": "en", "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "francais": "fr",
    "es": "es", "spa": "es", "spanish": "es", "español": "es", "espanol": "es", "espagnol": "es", "castellano": "es", "pt": "pt", "por": "pt", "portuguese": "pt", "português": "pt", "portugues": "pt", "portugais": "pt",
    "de": "de", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "allemand": "de", "it": "it", "ita": "it", "italian": "it", "italiano": "it", "italien": "it", "uk": "uk", "ukr": "uk", "ukrainian": "uk", "українська": "uk", "ukrainien": "uk",
}

_OUT = re.compile(r"https?://\S+|www\.\S+|[\w.+\-]+@[\w.\-]+|[@#]\w+|\w*\d\w*|\b[^\W\d_]\.(?=\s)")
_CLAUSE = re.compile(r"[.!?…;:,()\[\]{}\"«»“”|/–—¿¡]+|\s-+\s")
_NO_LETTER = re.compile(r"[^\w'’\-]+|[_]+")
_TOKEN = re.compile(r"\S+")
WINDOW = 96
#: Tokens and clauses a task keeps what it knows of; past that it starts anew, nothing else changes.
KEPT = 200_000

Item = tuple[str, bool] | None  # a word in lower case and whether it has a capital; None is a border of clauses


def _items(token: str) -> Item | list[Item]:
    """What a token holds; a single word, which most are, by itself."""
    out: list[Item] = []
    for i, piece in enumerate(_CLAUSE.split(_OUT.sub(" ", f" {token} "))):
        if i:
            out.append(None)
        for w in _NO_LETTER.sub(" ", piece).replace("’", "'").split():
            if any(map(str.isalpha, w)):
                out.append((w.lower(), w[0].isupper()))
    return out[0] if len(out) == 1 and out[0] else out


class Reader:
    """Cuts texts into clauses. What a token holds is worked out once and kept (see ``KEPT``)."""

    def __init__(self) -> None:
        self.known: dict[str, Item | list[Item]] = {}

    def clauses(self, text: str) -> list[tuple[str, list[int]]]:
        """(clause, token of each word): clauses are lower-case words and single blanks, tokens are counted by white space.

        Words with a capital that don't begin their clause may be names and are left out, unless most words of
        the clause have one.
        """
        known, out = self.known, []
        if len(known) > KEPT:
            known.clear()
        i = -1
        for line in text.splitlines():
            words: list[tuple[str, bool]] = []
            at: list[int] = []
            for token in line.split():
                i += 1
                items = known.get(token)
                if items is None:
                    items = known[token] = _items(token)
                if items.__class__ is tuple:
                    words.append(items)
                    at.append(i)
                    continue
                for item in items:
                    if item is not None:
                        words.append(item)
                        at.append(i)
                    elif words:
                        out.append(_clause(words, at))
                        words, at = [], []
            if words:
                out.append(_clause(words, at))
        return out


def _clause(words: list[tuple[str, bool]], at: list[int]) -> tuple[str, list[int]]:
    capitals = sum([b for _, b in words]) - words[0][1]
    if capitals and capitals * 2 < len(words):
        at = [at[i] for i in range(len(words)) if i == 0 or not words[i][1]]
        words = [w for i, w in enumerate(words) if i == 0 or not w[1]]
    return " ".join([w for w, _ in words]), at


def clauses(text: str) -> list[str]:
    """The clauses of one text, without their places."""
    return [c for c, _ in Reader().clauses(text)]


def label_of(c: Column) -> Column:
    """The language that a label names, in whatever spelling, case, code or region; null if none."""
    plain = F.lower(F.trim(F.regexp_replace(c, "[\\s\\u00a0]+", " ")))
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, plain), F.try_element_at(known, F.regexp_extract(plain, "^(\\p{L}{2,3})(?=[-_ ])", 1)))


# ---- the fit ------------------------------------------------------------------------------------------


def training_sample(texts: DataFrame, key: str, text: str, label: str, per_language: int = 500, longest: int = 1500) -> list[tuple[str, str]]:
    """At most ``per_language`` labelled texts of each language, of at most ``longest`` characters.

    Which is fixed by a hash of the key. This bounded sample goes to the driver; nothing else does.
    """
    t = texts.select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(text).alias("text"), label_of(F.col(label)).alias("lang"))
    t = t.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.length("text").between(20, longest))
    first = t.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= per_language)
    return sorted((r["lang"], r["text"]) for r in first.select("lang", "text").collect())


def _bytes(pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([min(len(p), width) for p in pieces], np.int64)
    x = np.zeros((len(pieces), width), np.uint8)
    for i, p in enumerate(pieces):
        x[i, : n[i]] = np.frombuffer(p[:width], np.uint8)
    return x, n


_FITTED: dict[int, tuple[list, BiGru]] = {}


def fit_once(sample: list[tuple[str, str]]) -> BiGru:
    """``fit``, done once in a driver for the same sample; the last few are kept."""
    at = hash(tuple(sample))
    if at not in _FITTED or _FITTED[at][0] != sample:
        while len(_FITTED) >= 4:
            _FITTED.pop(next(iter(_FITTED)))
        _FITTED[at] = (sample, fit(sample))
    return _FITTED[at][1]


def save_net(spark: SparkSession, net: BiGru, path: str) -> None:
    """Writes a fitted network as a table of one row, to any storage of the cluster; an existing one is refused."""
    spark.createDataFrame([(net.to_bytes(),)], "net binary").write.parquet(path)


def load_net(spark: SparkSession, path: str) -> BiGru:
    return BiGru.from_bytes(bytes(spark.read.parquet(path).first()["net"]))


def fit(sample: list[tuple[str, str]], stages: tuple[int, ...] = (100, 160, 180), hidden: int = 24, rows: int = 64, seed: int = 11, stride: int = 2) -> BiGru:
    """The network, fitted to (language, text) pairs of which some have a wrong label or mix languages.

    Between stages, texts are left out that the network as a whole, or in more than a tenth of their bytes,
    takes for another language; each time all texts are judged anew.
    """
    net = BiGru(len(LANGS), hidden, seed, stride)
    texts = [(LANGS.index(lang), [c.encode() for c in clauses(text)]) for lang, text in sample]
    texts = [(i, cs) for i, cs in texts if sum(map(len, cs)) >= 12]
    if not texts:
        return net
    rng = np.random.default_rng(seed)
    adam = Adam(net.p, 0.01)
    use = texts
    for stage, steps in enumerate(stages):
        by: dict[int, list[list[bytes]]] = {}
        for i, cs in use:
            by.setdefault(i, []).append([c for c in cs if len(c) >= 12] or cs)
        langs = sorted(by)
        for k in range(steps):
            pieces, ys = [], []
            for _ in range(rows):
                # a third of the rows glue two clauses together, mostly of two languages
                parts = [langs[rng.integers(len(langs))] for _ in range(1 + (rng.integers(3) == 0))]
                b, y = b"", []
                for i in parts:
                    doc = by[i][rng.integers(len(by[i]))]
                    c = doc[rng.integers(len(doc))]
                    if len(parts) == 2:
                        c = c[: 14 + int(rng.integers(30))]
                    elif rng.integers(3) == 0:
                        c = c[: 8 + int(rng.integers(24))]
                    elif len(c) > 72:
                        c = c[int(rng.integers(len(c) - 60)) :]
                    b += (b" " if b else b"") + c
                    y += [i] * (len(b) - len(y))
                pieces.append(b)
                ys.append(y)
            x, n = _bytes(pieces, 72)
            target = np.full(x.shape, -1)
            for i, y in enumerate(ys):
                target[i, : n[i]] = y[: n[i]]
            _, g = net.gradients(x, n, target)
            adam.step(g, 0.25 if stage == len(stages) - 1 and k > steps // 2 else 1.0)
        if stage < len(stages) - 1:
            use = _trusted(net, texts)
    return net


def _trusted(net: BiGru, texts: list[tuple[int, list[bytes]]]) -> list[tuple[int, list[bytes]]]:
    index = {c: i for i, c in enumerate(dict.fromkeys(c for _, cs in texts for c in cs))}
    scores = pooled(net, list(index))
    kept: dict[int, list] = {}
    for lang, cs in texts:
        at, size = np.array([index[c] for c in cs]), np.array([len(c) for c in cs])
        fits = scores[at].argmax(1) == lang
        if (scores[at] * size[:, None]).sum(0).argmax() == lang and (size * fits).sum() >= 0.9 * size.sum():
            kept.setdefault(lang, []).append((lang, cs))
    few = {lang for lang, _ in texts if len(kept.get(lang, [])) < 8}  # too few to judge by
    return [t for v in kept.values() for t in v] + [t for t in texts if t[0] in few]


# ---- use ----------------------------------------------------------------------------------------------


def _windows(net: BiGru, pieces: list[bytes], batch: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(piece of each row, log-probabilities (classes, rows, width), live positions (rows, width)) of all windows."""
    parts = [(i, a, p[a : a + WINDOW]) for i, p in enumerate(pieces) for a in range(0, len(p), WINDOW)]
    parts.sort(key=lambda q: len(q[2]))
    for k in range(0, len(parts), batch):
        group = parts[k : k + batch]
        x, n = _bytes([q[2] for q in group], len(group[-1][2]))
        yield np.array([(q[0], q[1]) for q in group]), net.by_class(x, n), np.arange(x.shape[1]) < n[:, None]


def pooled(net: BiGru, pieces: list[bytes], batch: int = BATCH) -> np.ndarray:
    """(pieces, classes): the mean log-probability over the positions of each piece, whatever its length."""
    out = np.zeros((len(pieces), len(LANGS)), np.float32)
    for of, logp, live in _windows(net, pieces, batch):
        np.add.at(out, of[:, 0], (logp * live).sum(2).T)
    return out / np.maximum(1, np.array([len(p) for p in pieces]))[:, None]


def word_sums(net: BiGru, pieces: list[str]) -> list[np.ndarray]:
    """Of each piece (words, classes): the summed log-probabilities of each word's positions, its blank included."""
    data = [p.encode() for p in pieces]
    every = [np.zeros((len(LANGS), len(d)), np.float32) for d in data]
    for of, logp, live in _windows(net, data):
        for r, (i, a) in enumerate(of):
            n = int(live[r].sum())
            every[i][:, a : a + n] = logp[:, r, :n]
    out = []
    for p, each in zip(pieces, every):
        ends = np.cumsum([len(w.encode()) + 1 for w in p.split(" ")])
        ends[-1] -= 1
        total = np.concatenate([np.zeros((len(LANGS), 1)), np.cumsum(each, 1, dtype=np.float64)], 1)
        out.append(np.diff(total[:, np.concatenate([[0], ends])], axis=1).T)
    return out


#: A clause whose positions have less than this on average may hold several languages; a part of it has to have more.
UNSURE, SURE = -0.4, -0.2
#: Words and bytes that a part of a clause has at least, and the price of a cut in nats of its positions.
PART_WORDS, CUT = 4, 2.0


def parts_of(words: list[str], sums: np.ndarray) -> list[int]:
    """The first words of the parts of a clause, 0 first: each part surely in a language of its own.

    The best way through the words, linear in their number, in which a part has ``PART_WORDS`` words at least and
    each cut has a price; parts that aren't sure don't count, and what stands beside them goes on.
    """
    n, k = sums.shape
    if n < 2 * PART_WORDS:
        return [0]
    least = PART_WORDS
    best = np.full((k, least), -np.inf)  # language, words so far in the part (the last column: enough)
    best[:, 0] = sums[0]
    back: list[np.ndarray] = []
    for i in range(1, n):
        full = best[:, least - 1]
        top = int(full.argmax())
        new = np.empty_like(best)
        new[:, 1:] = best[:, :-1]
        stays = best[:, least - 1] >= new[:, least - 1]
        new[:, least - 1] = np.maximum(new[:, least - 1], full)
        new[:, 0] = full[top] - CUT if np.isfinite(full[top]) else -np.inf
        new[top, 0] = -np.inf
        back.append(np.concatenate([[top], stays]))
        best = new + sums[i][:, None]
    lang, col = int(best[:, least - 1].argmax()), least - 1
    starts, langs = [], []
    i = n - 1
    while i > 0:
        step = back[i - 1]
        if col == 0:
            starts.append(i)
            langs.append(lang)
            lang, col = int(step[0]), least - 1
        elif col == least - 1 and step[1 + lang]:
            pass
        else:
            col -= 1
        i -= 1
    starts, langs = [0, *starts[::-1]], [lang, *langs[::-1]]
    size = np.array([len(w.encode()) + 1 for w in words])
    out, last = [0], None
    for a, b, c in zip(starts, [*starts[1:], n], langs):
        sure = sums[a:b, c].sum() > SURE * size[a:b].sum()
        if sure and last is not None and c != last:
            out.append(a)
        if sure:
            last = c
    return out


#: The price of a change of language in a text, in nats, and what a word can say at most: in a clause of a few words,
#: which may be a name or a loan, and in one of ``FEW`` words or more.
CHANGE, PER_WORD, PER_SURE_WORD, FEW = 13.5, 3.5, 7.0, 5


def stretches(scores: np.ndarray, words: np.ndarray) -> list[int]:
    """The language of each clause: the best way through clause scores at a price for each change.

    Only languages that lead in some clause come into question. So a stretch of five words that the network is
    sure of is told from the text around it, one of two words isn't.
    """
    langs = sorted(set(scores.argmax(1).tolist()))
    if len(langs) == 1:
        return [langs[0]] * len(scores)
    cap = np.where(words >= FEW, PER_SURE_WORD, PER_WORD)[:, None]
    emit = (np.maximum(scores - scores.max(1, keepdims=True), -cap) * words[:, None])[:, langs].tolist()
    back: list[list[int]] = []
    best = emit[0]
    for row in emit[1:]:
        top = max(range(len(langs)), key=best.__getitem__)
        switch = best[top] - CHANGE
        back.append([i if b >= switch else top for i, b in enumerate(best)])
        best = [max(b, switch) + e for b, e in zip(best, row)]
    path = [max(range(len(langs)), key=best.__getitem__)]
    for step in reversed(back):
        path.append(step[path[-1]])
    return [langs[i] for i in reversed(path)]


class Labeller:
    """A network in use in one task: every clause is scored once while it is kept (see ``KEPT``)."""

    def __init__(self, net: BiGru):
        self.net, self.reader = net, Reader()
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(LANGS)), np.float32)
        self.divided: dict[str, list[int]] = {}

    def _learn(self, found: list[str]) -> None:
        new = [c for c in dict.fromkeys(found) if c not in self.index]
        if not new:
            return
        scores = pooled(self.net, [c.encode() for c in new])
        self.index.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
        self.scores = np.concatenate([self.scores, scores])
        unsure = [new[i] for i in np.flatnonzero(scores.max(1) < UNSURE) if new[i].count(" ") + 1 >= 2 * PART_WORDS]
        extra = []
        for c, sums in zip(unsure, word_sums(self.net, unsure)):
            words = c.split(" ")
            cuts = parts_of(words, sums)
            if len(cuts) > 1:
                self.divided[c] = cuts
                extra += [" ".join(words[a:b]) for a, b in zip(cuts, [*cuts[1:], len(words)])]
        extra = [c for c in dict.fromkeys(extra) if c not in self.index]
        if extra:
            self.index.update(zip(extra, range(len(self.scores), len(self.scores) + len(extra))))
            self.scores = np.concatenate([self.scores, pooled(self.net, [c.encode() for c in extra])])

    def segments(self, stored: list[str | None], plain: list[str | None]) -> list[list[dict]]:
        """The stretches of each text: seg_no, lang, confidence, n_words, and where they stand in the stored text.

        ``plain`` is the readable form of ``stored``. The stretches' places tile the text: from one's first word to
        the next one's, what stands before the first and after the last word included.
        """
        if len(self.index) > KEPT:
            self._reset()
        read = [self.reader.clauses(t) if t else [] for t in plain]
        self._learn([c for cs in read for c, _ in cs])
        top = self.scores.argmax(1)
        out = []
        for raw, text, cs in zip(stored, plain, read):
            if self.divided and any(c in self.divided for c, _ in cs):
                cs = [part for c in cs for part in self._parts(*c)]
            if not cs:
                out.append([])
                continue
            at = np.array([self.index[c] for c, _ in cs])
            words = np.array([len(w) for _, w in cs])
            first = top[at[0]]
            path = [int(first)] * len(cs) if (top[at] == first).all() else stretches(self.scores[at], words)
            segs: list[dict] = []
            a = 0
            begins = []
            for b in range(1, len(cs) + 1):
                if b == len(cs) or path[b] != path[a]:
                    rows, w = self.scores[at[a:b]], words[a:b]
                    mean = (np.exp(rows.astype(np.float64)) * w[:, None]).sum(0)
                    segs.append({"seg_no": len(segs) + 1, "lang": LANGS[path[a]], "confidence": float(mean[path[a]] / max(mean.sum(), 1e-12)), "n_words": int(w.sum()), "start": 0, "end": len(raw)})
                    begins.append(cs[a][1][0])
                    a = b
            if len(segs) > 1:
                starts = [0, *_places(raw, text, begins[1:])]
                for s, x, y in zip(segs, starts, [*starts[1:], len(raw)]):
                    s["start"], s["end"] = x, y
            out.append(segs)
        return out

    def _parts(self, clause: str, at: list[int]) -> list[tuple[str, list[int]]]:
        cuts = self.divided.get(clause)
        if not cuts:
            return [(clause, at)]
        words = clause.split(" ")
        return [(" ".join(words[a:b]), at[a:b]) for a, b in zip(cuts, [*cuts[1:], len(words)])]


def _places(raw: str, text: str, tokens: list[int]) -> list[int]:
    """Where in the stored text the tokens (rising numbers) of its readable form stand, in code points."""
    wanted, out = iter(tokens), []
    nxt = next(wanted)
    for i, m in enumerate(_TOKEN.finditer(text)):
        while i == nxt:
            out.append(m.start())
            nxt = next(wanted, -1)
        if nxt < 0:
            break
    if raw != text:
        codes, offs = codes_of(pa.array([raw]))
        _, _, src = normalise(codes, offs, "readable")
        out = [int(src[i]) for i in out]
    return [int(x) for x in np.maximum.accumulate(out)]


def segment_batch(net: BiGru, texts: list[str | None]) -> list[list[dict]]:
    """The stretches of each text."""
    return Labeller(net).segments(texts, texts)


SEGMENTS = "array<struct<seg_no:int,lang:string,confidence:double,n_words:int,start:int,end:int>>"


def with_segments(df: DataFrame, text: str, net: BiGru, out: str = "segments") -> DataFrame:
    """``df`` with the array of stretches of ``text``; empty for null texts and those in no language."""
    kind = pa.list_(pa.struct([("seg_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    df = spread(df.drop(out))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(net)
        for b in it:
            col = b.column(text).cast(pa.string())
            segs = [s for part in slices(col, 4 << 20) for s in label.segments(part.to_pylist(), normalise_array(part, "readable").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(segs, kind)], names=[*b.schema.names, out])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{ddl}, {out} {SEGMENTS}")


def text_language(segments: Column) -> Column:
    """struct<lang, confidence> of a whole text: the stretch language with most words, and its share of sure words."""
    total = F.aggregate(segments, F.lit(0.0), lambda a, s: a + s["n_words"])
    of = lambda lang: F.aggregate(F.filter(segments, lambda s: s["lang"] == lang), F.lit(0.0), lambda a, s: a + s["n_words"] * s["confidence"])
    ranked = F.array_sort(F.transform(F.array_distinct(F.transform(segments, lambda s: s["lang"])), lambda x: F.struct((-of(x)).alias("w"), x.alias("lang"))))
    return F.when(F.size(segments) > 0, F.struct(F.get(ranked, F.lit(0))["lang"].alias("lang"), (-F.get(ranked, F.lit(0))["w"] / total).alias("confidence")))
