"""Nested records to flat related tables by Dewey labels.

Every node of a JSON tree gets a label, the path of ordinals from the root (``"4.0.2"``: third element of
the first member of the fifth member of the root). A node's parent has the label cut at its last point, so
parent and ancestor links need no stored key and no join. Nodes with the same schema path (member names,
``[]`` for list elements) form one table.

Everything about a record is derived inside the record's own row: no shuffle, and memory is that of one
record.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = "array<struct<label:string, path:string, kind:string, value:string>>"


def _no_constant(name: str):
    raise ValueError(name)


def parse(text: str | None):
    """(value, True), or (None, False) where the text isn't one valid JSON value."""
    if text is None:
        return None, False
    try:
        return json.loads(text, parse_constant=_no_constant), True
    except (ValueError, RecursionError):
        return None, False


def _name(key: str) -> str:
    """A member name as a step of a schema path; points inside it are escaped."""
    return _clean(key).replace("%", "%25").replace(".", "%2E")


def _clean(s: str) -> str:
    """Half surrogate pairs can't be stored as UTF-8."""
    return s if s.isascii() or s.isprintable() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def label_nodes(value) -> list[tuple[str, str, str, str | None]]:
    """(label, schema path, kind, scalar text) of every node, parents before children, in order."""
    out: list[tuple[str, str, str, str | None]] = []
    stack = [("", "", value)]
    while stack:
        label, path, v = stack.pop()
        if isinstance(v, dict):
            out.append((label, path, "object", None))
            kids = [(f"{label}.{i}" if label else str(i), f"{path}.{_name(k)}" if path else _name(k), c) for i, (k, c) in enumerate(v.items())]
            stack.extend(reversed(kids))
        elif isinstance(v, list):
            out.append((label, path, "list", None))
            stack.extend(reversed([(f"{label}.{i}" if label else str(i), path + "[]", c) for i, c in enumerate(v)]))
        elif v is None:
            out.append((label, path, "null", None))
        elif isinstance(v, bool):
            out.append((label, path, "boolean", "true" if v else "false"))
        elif isinstance(v, str):
            out.append((label, path, "string", _clean(v)))
        else:
            out.append((label, path, "number", repr(v)))
    return out


def parent_of(label: str) -> str | None:
    """Truncation; the root has no parent."""
    return None if label == "" else label.rpartition(".")[0]


def ordinal_of(label: str) -> int:
    return int(label.rpartition(".")[2]) if label else 0


def _per_line(fn, result: pa.DataType):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cells = [fn(v) if ok else None for v, ok in map(parse, b.column(b.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(cells, result)], names=[*b.schema.names[:-1], "_cells"])

    return run


def _mapped(df: DataFrame, keys: list[str], text: str, fn, cell: T.DataType, arrow: pa.DataType) -> DataFrame:
    src = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias("_text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("_cells", T.ArrayType(cell))])
    cells = src.mapInArrow(_per_line(fn, pa.list_(arrow)), schema)
    return cells.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.explode("_cells").alias("_c")).select(*keys, "_c.*")


def dewey_nodes(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per node: the key columns, label, parent_label, ordinal, path, kind, value.

    Null, empty and invalid texts have no nodes; a scalar text has one. Repeated rows are labelled each
    for itself. Columns of ``df`` besides keys and text are ignored.
    """
    cell = T.StructType([T.StructField(n, T.StringType()) for n in ("label", "path", "kind", "value")])
    arrow = pa.struct([(n, pa.string()) for n in ("label", "path", "kind", "value")])
    names = ("label", "path", "kind", "value")
    nodes = _mapped(df, keys, text, lambda v: [dict(zip(names, n)) for n in label_nodes(v)], cell, arrow)
    cut = F.when(F.col("label") == "", F.lit(None).cast("string")).when(F.instr("label", ".") == 0, F.lit("")).otherwise(F.regexp_replace("label", r"\.[0-9]+$", ""))
    last = F.when(F.col("label") == "", 0).otherwise(F.substring_index("label", ".", -1).cast("int"))
    return nodes.select(*keys, "label", cut.alias("parent_label"), last.alias("ordinal"), "path", "kind", "value")


def path_table(nodes: DataFrame, keys: list[str], path: str, columns: list[str]) -> DataFrame:
    """The table of the objects at one schema path: keys, label, parent_label, and the named scalar members.

    Members are brought to their object by truncating their label, within the record (keys).
    """
    at = nodes.where((F.col("path") == path) & (F.col("kind") == "object")).select(*keys, "label", "parent_label")
    members = nodes.where(F.col("path").isin([f"{path}.{c}" if path else c for c in columns]))
    wide = members.groupBy(*keys, F.col("parent_label").alias("label")).agg(
        *[F.max(F.when(F.col("path") == (f"{path}.{c}" if path else c), F.col("value"))).alias(c) for c in columns]
    )
    return at.join(wide, [*keys, "label"], "left")


def path_summary(nodes: DataFrame) -> DataFrame:
    """The schema of a collection: nodes and distinct kinds by schema path."""
    return nodes.groupBy("path").agg(F.count(F.lit(1)).alias("nodes"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


# ---- tweets ----------------------------------------------------------------------------------------

_NESTED = re.compile(r"(?:(?:retweeted_status|quoted_status)\.)*")
_DIGITS = re.compile(r"-?[0-9]{1,19}\Z")


def _id_at(scalars: dict[str, tuple[str, str]], label: str, by: dict[str, dict[str, str]], text_id: bool = False) -> str | None:
    """The id of the object at ``label``: ``id`` as number or digits, else ``id_str``."""
    own = by.get(label, {})
    for name in ("id", "id_str"):
        kind, value = scalars.get(own.get(name, "?"), ("", ""))
        if kind in ("number", "string") and value and text_id:
            return value
        if kind in ("number", "string") and _DIGITS.match(value) and -(2**63) <= int(value) < 2**63:
            return str(int(value))
    return None


#: Lists of children inside a tweet's (or its extended form's) entities: kind and the member with the key.
_LISTS = {"user_mentions": ("mention", "id"), "hashtags": ("hashtag", "text"), "urls": ("url", "expanded_url")}


def tweet_children(value) -> list[dict]:
    """Child rows of every tweet in one parsed line, each with the id of the tweet that directly holds it."""
    nodes = label_nodes(value)
    if not nodes or nodes[0][2] != "object":
        return []
    scalars: dict[str, tuple[str, str]] = {}
    kind_at: dict[str, str] = {}
    members: dict[str, dict[str, str]] = {}
    elements: dict[str, list[str]] = {}
    for label, path, kind, val in nodes:
        kind_at[label] = kind
        if val is not None:
            scalars[label] = (kind, val)
        up = parent_of(label)
        if up is not None:
            if kind_at[up] == "list":
                elements.setdefault(up, []).append(label)
            else:
                members.setdefault(up, {})[path.rpartition(".")[2] if kind_at[up] == "object" else path] = label

    def member(label: str | None, *names: str) -> str | None:
        for n in names:
            label = members.get(label, {}).get(n) if label is not None else None
        return label

    def listed(label: str | None) -> list[tuple[int, str]]:
        """(position, label) of a list's elements, or of a bare object as the only one."""
        if label is None:
            return []
        if kind_at[label] == "list":
            return [(ordinal_of(e), e) for e in elements.get(label, [])]
        return [(0, label)] if kind_at[label] == "object" else []

    def text_of(label: str | None) -> str | None:
        kind, val = scalars.get(label, ("", "")) if label is not None else ("", "")
        return val if kind in ("string", "number") else None

    rows: dict[tuple, None] = {}
    for label, path, kind, _ in nodes:
        name = path.rpartition(".")[2]
        inside = label == "" or (name in ("retweeted_status", "quoted_status") and _NESTED.fullmatch(path + ".") is not None)
        if kind != "object" or not inside:
            continue
        own = _id_at(scalars, label, members)
        tid = int(own) if own is not None else None

        def add(child: str, pos: int, key: str | None, tid=tid) -> None:
            if key is not None:
                rows[(tid, child, pos, key)] = None

        user = member(label, "user")
        if user is not None and kind_at[user] == "object":
            add("user", 0, _id_at(scalars, user, members))
            k = 0
            for part in ("url", "description"):
                urls = member(user, "entities", part, "urls")
                found = listed(urls)
                for pos, e in found:
                    add("user_url", k + pos, text_of(member(e, "expanded_url")))
                k += len(found)
        place = member(label, "place")
        if place is not None and kind_at[place] == "object":
            add("place", 0, _id_at(scalars, place, members, text_id=True))
            for pos, e in listed(member(place, "contained_within")):
                add("area", pos, _id_at(scalars, e, members, text_id=True))
        extended = member(label, "extended_tweet")
        entities = member(label, "entities")
        if extended is not None and kind_at[extended] == "object":
            fuller = member(extended, "entities")
            if fuller is not None and kind_at[fuller] == "object":
                entities = fuller
        for lst, (child, key) in _LISTS.items():
            for pos, e in listed(member(entities, lst)):
                add(child, pos, _id_at(scalars, e, members) if key == "id" else text_of(member(e, key)))
        for nested in ("retweeted_status", "quoted_status"):
            n = member(label, nested)
            if n is not None and kind_at[n] == "object":
                add(nested, 0, _id_at(scalars, n, members))
    return [{"tweet_id": t, "child_kind": c, "pos": p, "child_key": k} for t, c, p, k in rows]


def tweet_child_table(df: DataFrame, line: str = "line_id", text: str = "raw_line") -> DataFrame:
    """(line_id, tweet_id, child_kind, pos, child_key), distinct within a line.

    Lines that are null, empty or no valid JSON, or not an object, have no children. ``tweet_id`` is null
    where a tweet has no usable id. The keys of children without id are left out.
    """
    cell = T.StructType([T.StructField("tweet_id", T.LongType()), T.StructField("child_kind", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("child_key", T.StringType())])
    arrow = pa.struct([("tweet_id", pa.int64()), ("child_kind", pa.string()), ("pos", pa.int32()), ("child_key", pa.string())])
    return _mapped(df, [line], text, tweet_children, cell, arrow)
