"""One consistent form for texts that look the same.

Arrow text is copied once per batch into a numpy array of code points. Lookup tables give each code point its
number of replacements and where they stand; gathers and offsets expand all rows at once. Combining marks are
put in canonical order and composed vectorially. No string method runs on a row.

Forms:

* ``readable``: full-width and other width variants, ligatures, kinds of blank and decomposed accents brought
  to the usual characters; invisible characters removed; look-alike letters brought to the script most
  letters of their word are in.
* ``skeleton``: for comparison; the same, but every look-alike letter becomes its Latin one. Two texts look
  the same (but for font width and kind of blank) just where their skeletons are equal.

Case, digits, visible accents and marks are kept apart. A joiner between two symbols (emoji) is kept, as it
changes the picture; everywhere else it is invisible and dropped. Null stays null, empty stays empty.
Conjoining Hangul letters become syllables.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumage.session import cut_lineage

# Letters of other scripts that are drawn like a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "а": "a", "с": "c",
    "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c",
    "ϳ": "j", "ι": "i", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ս": "u", "հ": "h",
}
# Characters without a picture of their own beyond the format and variation classes.
INVISIBLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10))
ZWJ, TOP = 0x200D, 0x30000
SYMBOLS_FROM = 0x2190
_WIDTH = ("<wide>", "<narrow>", "<noBreak>")


class Tables(NamedTuple):
    count: np.ndarray  # replacements of each code point
    start: np.ndarray  # where they stand in ``flat``
    flat: np.ndarray
    ccc: np.ndarray  # canonical combining class
    pair: np.ndarray  # sorted (base << 21 | mark)
    whole: np.ndarray  # their compositions
    latin: np.ndarray  # look-alike to Latin letter, else itself
    back: dict  # script name to an array from Latin letter to look-alike
    script: np.ndarray  # 1 Latin, 2 Cyrillic, 3 Greek, 4 Armenian, 0 others


def _script(name: str) -> int:
    return {"LATIN": 1, "CYRILLIC": 2, "GREEK": 3, "ARMENIAN": 4}.get(name.partition(" ")[0], 0)


def _decompose(c: int) -> list[int]:
    """Canonical decomposition, width variants and Latin ligatures resolved."""
    if 0xAC00 <= c <= 0xD7A3:
        return [c]
    d = unicodedata.decomposition(chr(c)).split()
    if not d:
        return [c]
    if d[0].startswith("<"):
        if d[0] not in _WIDTH and not (d[0] == "<compat>" and 0xFB00 <= c <= 0xFB06):
            return [c]
        d = d[1:]
    return [x for h in d for x in _decompose(int(h, 16))]


@functools.lru_cache(1)
def tables() -> Tables:
    count, start = np.ones(TOP, np.uint8), np.zeros(TOP, np.int64)
    ccc, latin, script = np.zeros(TOP, np.uint8), np.arange(TOP, dtype=np.uint32), np.zeros(TOP, np.uint8)
    flat: list[int] = []
    pairs: dict[int, int] = {}
    for c in range(TOP):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co", "Cs") and c >= 0x3400:
            out = [c]
        elif cat == "Zs":
            out = [0x20]
        elif (cat == "Cf" and c != ZWJ) or c in INVISIBLE:
            out = []
        else:
            out = _decompose(c)
            if out == [0x20] or (out and out[0] == 0x20):
                out = [c]
        count[c], start[c] = len(out), len(flat)
        flat += out
        ccc[c] = unicodedata.combining(ch)
        if cat[0] == "L" and c < 0x1000:
            script[c] = _script(unicodedata.name(ch, ""))
        d = unicodedata.decomposition(ch).split()
        if len(d) == 2 and d[0][0] != "<" and not 0xAC00 <= c <= 0xD7A3 and unicodedata.normalize("NFC", ch) == ch:
            pairs[int(d[0], 16) << 21 | int(d[1], 16)] = c
    back = {s: np.arange(TOP, dtype=np.uint32) for s in (2, 3, 4)}
    for a, b in LOOKALIKES.items():
        latin[ord(a)] = ord(b)
        if script[ord(a)] in back:
            t = back[script[ord(a)]]
            if t[ord(b)] == ord(b):
                t[ord(b)] = ord(a)
    keys = np.array(sorted(pairs), np.int64)
    return Tables(count, start, np.array(flat, np.uint32), ccc, keys, np.array([pairs[int(k)] for k in keys], np.uint32), latin, back, script)


# ---- Arrow text to code points and back --------------------------------------------------------------


def codes_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows, offsets): null rows are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, 8 * arr.offset) if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(arr) else np.empty(0, np.uint8)
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return codes.astype(np.uint32), heads[offs - offs[0]]


def text_of(codes: np.ndarray, offs: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    size = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(size)])[offs].astype(np.int64)
    data = codes.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    out = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)).cast(pa.string())
    if nulls is not None and nulls.any():
        out = pc.if_else(pa.array(nulls), pa.scalar(None, pa.string()), out)
    return out


# ---- the forms ---------------------------------------------------------------------------------------


def _expand(codes: np.ndarray, offs: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """(replacements, index of the code point each stems from)."""
    known = codes < TOP
    c = np.where(known, codes, 0)
    n = np.where(known, t.count[c], (codes < 0xE0000) | (codes > 0xE0FFF)).astype(np.int64)
    joiner = np.flatnonzero(codes == ZWJ)
    if len(joiner):
        edge = np.zeros(len(codes) + 1, bool)  # a joiner joins nothing across rows
        edge[offs] = True
        before = np.where(edge[joiner], 0, codes[np.maximum(joiner - 1, 0)])
        after = np.where(edge[joiner + 1], 0, codes[np.minimum(joiner + 1, len(codes) - 1)])
        n[joiner] = (before >= SYMBOLS_FROM) & (after >= SYMBOLS_FROM)
    src = np.repeat(np.arange(len(codes)), n)
    first = np.cumsum(n) - n
    at = np.arange(len(src)) - first[src]
    out = np.where(known[src], t.flat[np.minimum(t.start[c[src]] + at, len(t.flat) - 1)], codes[src])
    return out.astype(np.uint32), src


def _compose(codes: np.ndarray, src: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical order and composition of marks inside their row."""
    ccc = np.where(codes < TOP, t.ccc[np.minimum(codes, TOP - 1)], 0)
    if not ccc.any():
        return codes, src, row
    begins = np.concatenate([[True], row[1:] != row[:-1]])
    run = np.cumsum((ccc == 0) | begins)
    if ((ccc[1:] < ccc[:-1]) & (ccc[1:] > 0) & (run[1:] == run[:-1])).any():
        order = np.lexsort((ccc, run))
        codes, src, row, ccc = codes[order], src[order], row[order], ccc[order]
    codes = codes.copy()
    live = np.ones(len(codes), bool)
    starter = np.maximum.accumulate(np.where((ccc == 0) | begins, np.arange(len(codes)), 0))
    marks = np.flatnonzero(ccc > 0)
    marks = marks[ccc[starter[marks]] == 0]
    while len(marks):
        s = starter[marks]
        # blocked by a mark of the same class that stays between it and its starter
        blocked = np.zeros(len(marks), bool)
        blocked[1:] = (s[1:] == s[:-1]) & (ccc[marks[1:]] == ccc[marks[:-1]])
        key = codes[s].astype(np.int64) << 21 | codes[marks]
        at = np.minimum(np.searchsorted(t.pair, key), len(t.pair) - 1)
        fits = (t.pair[at] == key) & ~blocked
        if not fits.any():
            break
        hit = np.flatnonzero(fits)
        _, one = np.unique(s[hit], return_index=True)
        hit = hit[one]
        codes[s[hit]] = t.whole[at[hit]]
        live[marks[hit]] = False
        marks = np.delete(marks, hit)
    return codes[live], src[live], row[live]


def _compose_hangul(codes: np.ndarray, src: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Conjoining letters of one row to syllables: leading and vowel, then a syllable without a tail and a tail."""
    if not ((codes >= 0x1100) & (codes < 0x1200)).any():
        return codes, src, row
    for lead in (True, False):
        a, b = codes[:-1].astype(np.int64), codes[1:].astype(np.int64)
        if lead:
            hit = (a >= 0x1100) & (a <= 0x1112) & (b >= 0x1161) & (b <= 0x1175)
            whole = 0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28
        else:
            hit = (a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0) & (b >= 0x11A8) & (b <= 0x11C2)
            whole = a + (b - 0x11A7)
        hit = np.flatnonzero(hit & (row[1:] == row[:-1]))
        codes = codes.copy()
        codes[hit] = whole[hit]
        live = np.ones(len(codes), bool)
        live[hit + 1] = False
        codes, src, row = codes[live], src[live], row[live]
    return codes, src, row


def _fold_words(codes: np.ndarray, row: np.ndarray, t: Tables) -> np.ndarray:
    """Look-alikes to the script of most letters of their word that only one script has; ties go to Latin."""
    c = np.minimum(codes, TOP - 1)
    script = t.script[c]
    folded = t.latin[c]
    mixed_in = (folded != codes) & (codes < TOP)
    if not mixed_in.any():
        return codes
    letter = script > 0
    word = np.cumsum(~letter | np.concatenate([[True], row[1:] != row[:-1]]))
    has_twin = {s: t.back[s][c] != c for s in t.back}
    votes = {s: np.bincount(word, (script == s) & ~mixed_in, minlength=word[-1] + 1) for s in t.back}
    # a Latin letter with no twin in the other script speaks for Latin
    own = np.bincount(word, (script == 1) & ~has_twin[2] & ~has_twin[3], minlength=word[-1] + 1)
    shared = np.bincount(word, script == 1, minlength=word[-1] + 1)
    out = np.where(mixed_in, folded, codes)
    for s, v in votes.items():
        most = (v > own)[word] | (((v == 0) & (own == 0) & (shared == 0))[word] & (script == s))
        keep = most & mixed_in & (script == s)
        turn = most & (script == 1) & has_twin[s]
        out = np.where(keep, codes, np.where(turn, t.back[s][c], out))
    return out.astype(np.uint32)


def normalise(codes: np.ndarray, offs: np.ndarray, form: str = "readable") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, offsets, source index of each code) of the form of all rows."""
    t = tables()
    out, src = _expand(codes, offs, t)
    row = np.searchsorted(offs, src, side="right") - 1
    if form == "skeleton":
        # letters are folded while accents are apart, so an accented look-alike folds like a plain one
        low = out < TOP
        out = np.where(low, t.latin[np.minimum(out, TOP - 1)], out).astype(np.uint32)
    elif form != "readable":
        raise ValueError(f"unknown form {form!r}")
    out, src, row = _compose(*_compose_hangul(out, src, row), t)
    if form == "readable" and len(out):
        out = _fold_words(out, row, t)
    n = len(offs) - 1
    return out, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int64), src


#: Bytes of text that are worked on at once; the arrays about it are some thirty times that.
SLICE = 1 << 20


def slices(arr: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """The array in runs of rows of at most ``most`` bytes; a longer row is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(arr):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield arr.slice(a, b - a)
        a = b


@functools.lru_cache(2)
def settled(form: str) -> np.ndarray:
    """Of each code point whether it stays what it is in any text whose other code points do too."""
    t = tables()
    code = np.arange(TOP)
    d = [_first_and_more(t, i) for i in (0, 1)]
    same = (t.count == 1) & (d[0] == code)
    # a letter with its accents in one: it falls apart and comes together again
    at = np.minimum(np.searchsorted(t.pair, d[0].astype(np.int64) << 21 | d[1]), len(t.pair) - 1)
    same |= (t.count == 2) & (t.pair[at] == (d[0].astype(np.int64) << 21 | d[1])) & (t.whole[at] == code)
    first = np.minimum(d[0], TOP - 1)
    ok = same & (t.ccc == 0) & (t.latin[first] == first) & (code != ZWJ) & ~((code >= 0x1100) & (code < 0x1200))
    return ok & (t.script <= 1) if form == "readable" else ok


def _first_and_more(t: Tables, i: int) -> np.ndarray:
    return t.flat[np.minimum(t.start + np.minimum(i, np.maximum(t.count.astype(np.int64) - 1, 0)), len(t.flat) - 1)].astype(np.int64)


def changed_rows(codes: np.ndarray, offs: np.ndarray, form: str) -> np.ndarray:
    """Which rows hold a code point that may not stay what it is; the form of all others is what they are."""
    loose = ~settled(form)[np.minimum(codes, TOP - 1)] & (codes < TOP) | (codes >= 0xE0000) & (codes <= 0xE0FFF)
    total = np.concatenate([[0], np.cumsum(loose)])
    return total[offs[1:]] > total[offs[:-1]]


def normalise_array(arr: pa.Array, form: str = "readable") -> pa.Array:
    """The form of all rows; those that it leaves as they are pass through."""
    out = []
    for part in slices(arr):
        codes, offs = codes_of(part)
        loose = changed_rows(codes, offs, form)
        if not loose.any():
            out.append(part.cast(pa.string()))
            continue
        some = part.filter(pa.array(loose))
        codes, new, _ = normalise(*codes_of(some), form)
        done = text_of(codes, new, some.is_null().to_numpy(zero_copy_only=False))
        out.append(done if loose.all() else pc.replace_with_mask(part.cast(pa.string()), pa.array(loose), done))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def with_form(df: DataFrame, text: str, out: str, form: str = "skeleton") -> DataFrame:
    """``df`` with column ``out``: the form of ``text``. A column named ``out`` is replaced."""

    if out != text:
        df = df.drop(out)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cols = dict(zip(b.schema.names, b.columns))
            cols[out] = normalise_array(b.column(text), form)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    added = [] if out == text else [T.StructField(out, T.StringType())]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def two_hashes(c: Column) -> Column:
    """128 bits of a text in two bigints."""
    return F.struct(F.xxhash64(c).alias("h1"), F.xxhash64(c, F.lit(7)).alias("h2"))


def looks_alike(texts: DataFrame, field: str, key: str, text: str) -> DataFrame:
    """(field, form, key, text_id, n_texts): the class of texts that look like each row's.

    ``form`` identifies the class, ``text_id`` the stored characters; only classes with at least two
    different stored texts are given. Null texts are in no class; empty ones look like those of only
    invisible characters. Rows repeated come out once.
    """
    rows = texts.select(F.col(field).alias("field"), F.col(key).alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    # hashes of the stored and the seen text are all that is shuffled: rows of one text are merged by them
    coded = with_form(rows, "text", "seen", "skeleton").select("field", "key", two_hashes(F.col("text")).alias("text_id"), two_hashes(F.col("seen")).alias("form")).distinct()
    coded = cut_lineage(coded)  # narrow; the text is read and normalised once
    several = coded.groupBy("field", "form").agg(F.min("text_id").alias("_a"), F.max("text_id").alias("_b")).where("_a != _b").select("field", "form")
    return coded.join(several, ["field", "form"], "left_semi")


def alike_pairs(texts: DataFrame, field: str, key: str, text: str) -> DataFrame:
    """(field, key_a, key_b), key_a < key_b: texts that look the same but are stored differently.

    Stored texts are paired within their class first; keys are brought in afterwards, so rows that share
    a stored text are never paired with each other. Distinct.
    """
    c = looks_alike(texts, field, key, text)
    forms = c.select("field", "form", "text_id").distinct()
    a, b = forms.withColumnRenamed("text_id", "ta"), forms.withColumnRenamed("text_id", "tb")
    pairs = a.join(b, ["field", "form"]).where("ta < tb").select("field", "ta", "tb")
    left = c.select("field", F.col("text_id").alias("ta"), F.col("key").alias("ka"))
    right = c.select("field", F.col("text_id").alias("tb"), F.col("key").alias("kb"))
    met = pairs.join(left, ["field", "ta"]).join(right, ["field", "tb"]).where("ka != kb")
    return met.select("field", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()
