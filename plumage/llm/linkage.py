"""Map freely typed values to the entries of a canonical list.

Method: prefix-filter set-similarity join. A value is brought to its comparison form, without case and
accents, and cut into words; every run of neighbouring words that may be an entry is a candidate string,
written without blanks. Strings and entry names become sets of letter pairs (numbered where a pair repeats).
A typing error is an insertion, loss, change or swap of letters, up to two in long names, one in short ones,
none in codes; it takes at most three pairs of a name. So an entry of ``n`` letters with ``e`` errors allowed keeps
at least ``n + 1 - 3 e`` of its ``n + 1`` pairs, which is a Jaccard similarity of ``(n + 1 - 3 e) / (n + 1 + 3 e)``: the
filters never cut what the edit check would accept. Pairs are ordered by rarity in the list, and two sets with so
many pairs in common share one among the ``3 e + 1`` rarest of the entry and the rarest of the string, so only
those prefixes are joined. Length and position filters cut further, Jaccard is verified exactly, and an exact
edit-distance check follows. The best entry of each value is kept; values without any are reported with entry 0.

Only distinct candidate strings are compared. The pair order is bounded by the alphabet, not by the data; the
list is broadcast only where it is counted to be small.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumage.llm.textform import normalise_array
from plumage.session import broadcast_if_small, cut_lineage, is_small, spread

# Usual short forms of words in names.
SHORT_FORMS = {"st": "saint", "ste": "sainte", "ft": "fort", "mt": "mount", "pt": "port"}
_SEGMENT = re.compile(r"[\n|•;]+|\s/\s|,\s|[!?]\s|(?<!\bst)(?<!\bste)(?<!\bft)(?<!\bmt)(?<!\bpt)\.\s", re.I)
_WORD = re.compile(r"[^\W_]+")


def plain(s: str) -> str:
    """Lower case without accents; points inside words vanish."""
    s = unicodedata.normalize("NFD", s.lower())
    return re.sub(r"(?<=\w)[.'’](?=\w)", "", "".join(c for c in s if not unicodedata.combining(c)))


def words_of(segment: str) -> list[str]:
    """Words; three or more single letters in a row are one spaced-out word."""
    out: list[str] = []
    run: list[str] = []
    for w in [*_WORD.findall(segment), ""]:
        if len(w) == 1 and not w.isdigit():
            run.append(w)
            continue
        out += ["".join(run)] if len(run) >= 3 else run
        run = []
        if w:
            out.append(SHORT_FORMS.get(w, w))
    return out


def candidates(text: str, shortest: int, longest: int, most_words: int) -> list[tuple[str, str, str]]:
    """(string, its words, the words around it on its segment), distinct."""
    out: dict[tuple[str, str, str], None] = {}
    all_words = words_of(plain(text))
    for seg in [text] if not _SEGMENT.search(text) else [*_SEGMENT.split(text)]:
        ws = words_of(plain(seg))
        for i in range(len(ws)):
            s = ""
            for j in range(i, min(len(ws), i + most_words)):
                s += ws[j]
                if len(s) > longest:
                    break
                if len(s) >= shortest:
                    inside = ws[i : j + 1]
                    around = list(all_words)
                    for w in inside:
                        if w in around:
                            around.remove(w)
                    out[(s, " ".join(inside), " ".join(around))] = None
    return list(out)


def pairs_of(s: str) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    t = f"^{s}$"
    for i in range(len(t) - 1):
        g = t[i : i + 2]
        seen[g] = seen.get(g, 0) + 1
        out.append(g + str(seen[g]))
    return out


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or ``most + 1`` if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def allowed(n: int) -> int:
    """Typing errors allowed in an entry of ``n`` letters."""
    return 0 if n <= 4 else 1 if n <= 6 else 2


def kept_pairs(n: int) -> int:
    """Pairs that an entry of ``n`` letters shares at least with a string that is it but for the errors allowed."""
    return n + 1 - 3 * allowed(n)


def prefix_size(m: int) -> int:
    """Rarest pairs of a string of ``m`` letters of which one is shared with any entry it may be; 0 if there can be none."""
    need = [kept_pairs(n) for n in range(max(1, m - 2), m + 3) if abs(n - m) <= allowed(n)]
    return max(0, m + 1 - min(need) + 1) if need else 0


def _map_text(df: DataFrame, col: str, fn, out: str, ddl: str, kind: pa.DataType) -> DataFrame:
    """``df`` with column ``out`` = fn(list of texts)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fn(b.column(col)), kind)], names=[*b.schema.names, out])

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{base}, {out} {ddl}")


def entry_names(entries: DataFrame, entry: str, name: str, alternatives: str) -> DataFrame:
    """(ref_id, ref, ref_words): names and alternative names in comparison form."""
    every = F.explode(F.concat(F.array(name), F.coalesce(F.col(alternatives), F.array().cast("array<string>"))))
    n = entries.where(F.col(entry).isNotNull()).select(F.col(entry).cast("int").alias("ref_id"), every.alias("_n")).where("_n IS NOT NULL")
    both = _map_text(n, "_n", lambda a: [" ".join(words_of(plain(s or ""))) for s in normalise_array(a, "skeleton").to_pylist()], "ref_words", "string", pa.string())
    return both.select("ref_id", F.regexp_replace("ref_words", " ", "").alias("ref"), "ref_words").where("ref != ''").distinct()


def similar(strings: DataFrame, names: DataFrame) -> DataFrame:
    """(string, ref_id, ref, ref_words, jaccard): all pairs whose similarity reaches that of the entry's errors allowed, exactly.

    ``strings`` has a distinct column ``string``.
    """
    refs = names.select("ref").distinct()
    order = {r["g"]: i for i, r in enumerate(_map_text(refs, "ref", lambda a: [pairs_of(s) for s in a.to_pylist()], "gs", "array<string>", pa.list_(pa.string())).select(F.explode("gs").alias("g")).groupBy("g").count().orderBy("count", "g").collect())}  # bounded by the alphabet

    def ranks(a: pa.Array) -> list[list[int]]:
        # pairs the list doesn't have are rarer than any; a negative number of their own each
        return [sorted(order[g] if g in order else -hash_pair(g) for g in pairs_of(s)) for s in a.to_pylist()]

    grams = lambda df, c, out: _map_text(df, c, ranks, out, "array<bigint>", pa.list_(pa.int64()))
    n, m = F.length("ref"), F.length("string")
    errors = F.when(n <= 4, 0).when(n <= 6, 1).otherwise(2)
    sizes = [prefix_size(i) for i in range(12)]  # the same from then on
    mine = F.get(F.array(*[F.lit(x) for x in sizes]), F.least(m, F.lit(len(sizes) - 1)))
    q = grams(strings.select("string"), "string", "qg")
    r = grams(refs, "ref", "rg").withColumn("errors", errors)
    qp = q.select("string", "qg", F.posexplode(F.slice("qg", 1, mine)).alias("qpos", "g")).where("g >= 0")
    rp = r.select("ref", "rg", "errors", F.posexplode(F.slice("rg", 1, 3 * F.col("errors") + 1)).alias("rpos", "g"))
    nq, nr, e3 = F.size("qg"), F.size("rg"), 3 * F.col("errors")
    few = is_small(names, 20_000, 8 << 20)  # so are their prefixes, of seven pairs at most
    met = qp.join(F.broadcast(rp) if few else rp, "g").where((F.abs(nq - nr) <= F.col("errors")) & (F.least("qpos", "rpos") + F.least(nq - F.col("qpos"), nr - F.col("rpos")) >= nr - e3))
    # a pair is met at each shared prefix letter pair; the first one, where positions are lowest, speaks for it
    both = F.array_intersect("qg", "rg")
    first = F.element_at(both, 1) == F.col("g")
    common = F.size(both)
    jac = common / (nq + nr - common)
    found = met.where(first).where(common * (nr + e3) >= (nr - e3) * (nq + nr - common)).select("string", "ref", jac.alias("jaccard"))
    return found.join(F.broadcast(names) if few else names, "ref")


def hash_pair(g: str) -> int:
    """A fixed number for an unlisted letter pair."""
    h = 0
    for c in g:
        h = (h * 1_000_003 + ord(c)) % (1 << 40)
    return h + 1


#: What of the canonical list is held in memory: more is refused, never cut.
MAX_WORDS, MAX_REGIONS = 1_000_000, 5_000


def _bounded(items, most: int, what: str):
    if len(items) > most:
        raise ValueError(f"the list has more than {most} {what}")
    return items


def link(values: DataFrame, key: str, text: str, entries: DataFrame, entry: str, name: str, alternatives: str, regions: dict[str, Column] | None = None, whole: bool = True) -> DataFrame:
    """(key, ref_id, string, ref, distance, jaccard): the best entry of each value.

    ``regions``: columns of ``entries`` with the code and names of the region an entry lies in. A region named
    beside the candidate decides between entries of one name; where it fits none of them, a match that isn't
    letter for letter is refused. Without one, the smallest entry number of the name is taken.
    ``whole``: values without an entry, all of them if the list is empty, come out with ``ref_id`` 0; else they don't
    come out. Null and blank values (nothing but blanks and invisible characters) never do. A key that stands on
    several rows gets the best of them. Ties go to the higher similarity, the longer name, then the smaller number.
    """
    names = cut_lineage(entry_names(entries, entry, name, alternatives))
    bound = names.agg(F.min(F.length("ref")).alias("a"), F.max(F.length("ref")).alias("b"), F.max(F.size(F.split("ref_words", " "))).alias("c")).first()
    kt = values.schema[key].dataType.simpleString()
    v = values.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    shortest, longest, most_words = bound["a"] or 1, (bound["b"] or -2) + 2, (bound["c"] or 0) + 1

    def explode_candidates(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            forms = normalise_array(b["text"], "skeleton").to_pylist()
            keys = b["key"].to_pylist()
            rows = [(k, *c) for k, t in zip(keys, forms) if t.strip() for c in (candidates(t, shortest, longest, most_words) or [("", "", "")])]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b["key"].type), *(pa.array(c, pa.string()) for c in cols[1:])], names=["key", "string", "words", "around"])

    # written once: the strings are compared, then meet their values again
    cand = cut_lineage(spread(v).mapInArrow(explode_candidates, f"key {kt}, string string, words string, around string"))
    alike = similar(cand.select("string").where("string != ''").distinct(), names)

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = [edits(s, r, allowed(len(r))) if s != r else 0 for s, r in zip(b["string"].to_pylist(), b["ref"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, "distance"])

    tried = alike.mapInArrow(check, "ref string, string string, jaccard double, ref_id int, ref_words string, distance int")
    near = cut_lineage(tried.where(F.col("distance") <= F.when(F.length("ref") <= 4, 0).when(F.length("ref") <= 6, 1).otherwise(2)))
    met = cand.join(broadcast_if_small(near, 1_000_000), "string")

    listed = _bounded({r["w"] for r in names.select(F.explode(F.split("ref_words", " ")).alias("w")).distinct().limit(MAX_WORDS + 1).collect()}, MAX_WORDS, "words of names")
    terms = _region_terms(entries, entry, regions or {})
    every = _bounded({r["t"] for r in terms.select(F.explode("terms").alias("t")).distinct().limit(MAX_REGIONS + 1).collect()}, MAX_REGIONS, "regions")
    widest = max((t.count(" ") + 1 for t in every), default=0)

    def other_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drops matches in which a well-spelt word of the list stands for another word; finds the regions named around the rest."""
        for b in it:
            keep = []
            for d, q, r in zip(b["distance"].to_pylist(), b["words"].to_pylist(), b["ref_words"].to_pylist()):
                qs, rs = q.split(" "), r.split(" ")
                keep.append(d == 0 or len(qs) != len(rs) or all(x == y or x not in listed for x, y in zip(qs, rs)))
            b = b.filter(pa.array(keep, pa.bool_()))
            named = []
            for around in b["around"].to_pylist():
                ws = around.split(" ")
                named.append(sorted({t for i in range(len(ws)) for j in range(i + 1, min(len(ws), i + widest) + 1) if (t := " ".join(ws[i:j])) in every}))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("key", "string", "ref", "jaccard", "ref_id", "distance")), pa.array(named, pa.list_(pa.string()))], names=["key", "string", "ref", "jaccard", "ref_id", "distance", "named"])

    met = met.mapInArrow(other_words, f"key {kt}, string string, ref string, jaccard double, ref_id int, distance int, named array<string>")
    met = met.join(terms, "ref_id", "left")  # one narrow row an entry: AQE broadcasts what is small
    fits = F.when(F.size("named") == 0, F.lit(True)).otherwise(F.coalesce(F.arrays_overlap("named", "terms"), F.lit(False)))
    met = met.withColumn("fits", fits).where("fits OR distance = 0")
    order = F.struct((~F.col("fits")).alias("away"), (F.col("distance") - F.length("ref") / 1000).alias("far"), (-F.col("jaccard")).alias("unlike"), "ref_id", "string", "ref", "distance", "jaccard")
    best = met.groupBy("key").agg(F.min(order).alias("m")).select("key", "m.ref_id", "m.string", "m.ref", "m.distance", "m.jaccard")
    if whole:
        best = cand.select("key").distinct().join(best, "key", "left").withColumn("ref_id", F.coalesce("ref_id", F.lit(0)))
    return best.withColumnRenamed("key", key)


def _region_terms(entries: DataFrame, entry: str, regions: dict[str, Column]) -> DataFrame:
    """(ref_id, terms): codes and names of each entry's region in comparison form."""
    all_terms = F.array_distinct(F.flatten(F.array(*[F.array(c.cast("string")) for c in regions.values()]))) if regions else F.array().cast("array<string>")
    t = entries.where(F.col(entry).isNotNull()).select(F.col(entry).cast("int").alias("ref_id"), all_terms.alias("_t"))
    plain_terms = lambda a: [[" ".join(words_of(plain(x))) for x in xs or [] if x] for xs in a.to_pylist()]
    out = _map_text(t, "_t", plain_terms, "terms", "array<string>", pa.list_(pa.string())).where("size(terms) > 0")
    return out.groupBy("ref_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))  # an entry's own rows
