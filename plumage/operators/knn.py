"""Nearest neighbours by vector similarity, votes, and label spreading.

Queries are few against the training vectors, or the other way round; neither is assumed small enough for one
task. The queries are cut into blocks that are broadcast one after another (a block has a fixed number of
rows), the vectors are read in Arrow batches, and each batch keeps the ``k`` best per query by a matrix product,
so what is shuffled is at most ``k`` rows per query and batch, whatever the number of vectors.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumage.session import cut_lineage

#: Query vectors of one block.
BLOCK = 4096


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _euclid(q: np.ndarray, x: np.ndarray, qn: np.ndarray, dot: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Minus the distances of the nearest ``k`` and all that may be as near, exactly; -inf for the rest.

    Norms and products, which need no array of queries times vectors times dimensions, tell which those are.
    """
    xn = (x**2).sum(1)
    d2 = qn[:, None] + xn - 2 * dot
    d2[own] = np.inf
    kth = np.partition(d2, min(k, d2.shape[1]) - 1, axis=1)[:, min(k, d2.shape[1]) - 1]
    i, j = np.nonzero(d2 <= (kth + 1e-9 * (1 + qn + xn.max()))[:, None])
    out = np.full(d2.shape, -np.inf)
    for a in range(0, len(i), 65_536):
        b = slice(a, a + 65_536)
        out[i[b], j[b]] = -np.sqrt(((q[i[b]] - x[j[b]]) ** 2).sum(1))
    return out


def _round(qids, q: np.ndarray, k: int, metric: str, others: bool = False):
    qn = (q**2).sum(1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            x, ids = _matrix(b["vec"]), b["id"].to_numpy()
            sim = q @ x.T
            own = qids[:, None] == ids[None, :] if others else np.zeros(sim.shape, bool)
            if metric == "euclid":
                sim = _euclid(q, x, qn, sim, own, k)
            sim = np.round(sim, 9)
            sim[own] = -np.inf
            n = min(k, x.shape[0])
            # a total order: similarity first, then the smaller id
            order = np.lexsort((np.broadcast_to(ids, sim.shape), -sim), axis=1)[:, :n]
            rows = np.arange(len(q))[:, None]
            keep = ~own[rows, order].ravel()
            at = order.ravel()[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)[keep]), pa.array(ids[at]), b["label"].take(pa.array(at)), pa.array(sim[rows, order].ravel()[keep])], names=["query", "id", "label", "sim"])

    return run


def neighbours(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "dot", others: bool = False) -> DataFrame:
    """(query, id, label, sim, rank): the ``k`` nearest vectors of each query, ties to the smaller id.

    Both sides have id (bigint) and vec (array of the same length); vectors have a label. ``metric`` is ``dot``
    or ``euclid`` (sim is minus the distance). Rows with a null id or vector are left out. With ``others`` the queries may be
    among the vectors, and no query is its own neighbour: vectors of its id are passed over, all else is searched.
    """
    if metric not in ("dot", "euclid"):
        raise ValueError(f"unknown metric {metric!r}")
    q = queries.where("id IS NOT NULL AND vec IS NOT NULL").select("id", "vec").withColumn("_b", F.xxhash64("id"))
    total = q.count()
    blocks = max(1, -(-total // BLOCK))
    lt = vectors.schema["label"].dataType.simpleString()
    v = vectors.where("id IS NOT NULL AND vec IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "vec", "label")
    parts = []
    for i in range(blocks):  # the stated query set against all rows, in blocks
        block = q.where(F.pmod("_b", F.lit(blocks)) == i).select("id", "vec").toArrow() if blocks > 1 else q.select("id", "vec").toArrow()
        if block.num_rows:
            fn = _round(block["id"].to_numpy().astype(np.int64), _matrix(block["vec"].combine_chunks()), k, metric, others)
            parts.append(v.mapInArrow(fn, f"query bigint, id bigint, label {lt}, sim double"))
    if not parts:
        return v.limit(0).select(F.col("id").alias("query"), "id", "label", F.lit(0.0).alias("sim"), F.lit(0).alias("rank"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = W.partitionBy("query").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vote(near: DataFrame) -> DataFrame:
    """(query, guess): the most frequent label; ties go to the label met first, that of the nearer neighbour."""
    n = near.groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("r"))
    return n.groupBy("query").agg(F.max_by("label", F.struct(F.col("n"), (-F.col("r")).alias("r"))).alias("guess"))


def spread_labels(points: DataFrame, gamma: float = 20.0, alpha: float = 0.2, rounds: int = 30, most: int = 20_000) -> DataFrame:
    """(id, guess): labels spread over the affinity exp(-gamma d^2), F <- alpha S F + (1 - alpha) Y.

    ``points`` has id, vec and label, -1 where unknown. The method needs every pair. Up to ``most`` points they are
    taken row block by row block in one process; of more, blocks of at most ``most`` columns go to the executors one
    after another and meet all rows there, so nothing larger than a block is ever in one place. Both ways give the
    same result. The known labels stay a source of every round; rounds end where scores move by less than 0.001 in all.
    """
    t = points.where("id IS NOT NULL AND vec IS NOT NULL").select("id", "vec", "label")
    n = t.count()
    if n > most:
        return _spread_in_blocks(t, n, gamma, alpha, rounds, most)
    t = t.orderBy("id").toArrow()
    spark = points.sparkSession
    if not n:
        return spark.createDataFrame([], "id bigint, guess int")
    x, ids, y = _matrix(t["vec"].combine_chunks()), t["id"].to_numpy(), t["label"].to_numpy()
    classes = np.unique(y[y >= 0])
    step = max(1, 4_000_000 // len(x))
    cuts = [(a, min(len(x), a + step)) for a in range(0, len(x), step)]
    affinity = lambda a, b: _affinity(x[a:b], ids[a:b], x, ids, gamma)
    degree = np.concatenate([affinity(a, b).sum(1) for a, b in cuts])
    scale = 1 / np.sqrt(np.maximum(degree, 1e-300))
    start = (y[:, None] == classes[None, :]).astype(float)
    f = start.copy()
    for _ in range(rounds):
        new = np.concatenate([scale[a:b, None] * (affinity(a, b) @ (scale[:, None] * f)) for a, b in cuts])
        new = alpha * new + (1 - alpha) * start
        moved = np.abs(new - f).sum()
        f = new
        if moved < 1e-3:
            break
    guess = classes[f.argmax(1)] if len(classes) else np.full(len(x), -1)
    return spark.createDataFrame(pa.table({"id": pa.array(ids.astype(np.int64)), "guess": pa.array(guess.astype(np.int32))}))


def _affinity(x: np.ndarray, ids: np.ndarray, cols: np.ndarray, col_ids: np.ndarray, gamma: float) -> np.ndarray:
    m = np.exp(-gamma * np.maximum(0, (x**2).sum(1)[:, None] + (cols**2).sum(1) - 2 * x @ cols.T))
    m[ids[:, None] == col_ids[None, :]] = 0
    return m


def _spread_in_blocks(t: DataFrame, n: int, gamma: float, alpha: float, rounds: int, most: int) -> DataFrame:
    blocks = -(-n // most) * 2  # by a hash, so a block may have more than its part
    classes = np.array(sorted(r["label"] for r in t.where("label >= 0").select("label").distinct().collect()), np.int64)  # one row a class
    k = len(classes)
    if not k:
        return t.select(F.col("id").cast("bigint").alias("id"), F.lit(-1).alias("guess"))
    first = F.array(*[F.when(F.col("label") == int(c), 1.0).otherwise(0.0) for c in classes])
    p = t.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"), first.alias("y"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    p = cut_lineage(p.withColumns({"scale": F.lit(1.0), "f": F.array(F.lit(1.0))}))

    def product(p: DataFrame) -> DataFrame:
        """(id, s): each row's affinities times ``scale * f`` of all points."""
        parts = []
        for i in range(blocks):
            b = p.where(F.col("block") == i).select("id", "vec", "scale", "f").toArrow()
            if not b.num_rows:
                continue
            cols, ids = _matrix(b["vec"].combine_chunks()), b["id"].to_numpy()
            mass = b["scale"].to_numpy()[:, None] * _matrix(b["f"].combine_chunks())

            def run(it: Iterator[pa.RecordBatch], cols=cols, ids=ids, mass=mass) -> Iterator[pa.RecordBatch]:
                for r in it:
                    x, own = _matrix(r["vec"]), r["id"].to_numpy()
                    step = max(1, 4_000_000 // len(cols))
                    out = [_affinity(x[a : a + step], own[a : a + step], cols, ids, gamma) @ mass for a in range(0, len(x), step)]
                    yield pa.RecordBatch.from_arrays([r["id"], pa.array(list(np.concatenate(out)) if out else [], pa.list_(pa.float64()))], names=["id", "s"])

            parts.append(p.select("id", "vec").mapInArrow(run, "id bigint, s array<double>"))
        every = functools.reduce(DataFrame.unionByName, parts).select("id", F.posexplode("s").alias("i", "v"))
        return every.groupBy("id", "i").agg(F.sum("v").alias("v")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("s"))  # a value a class

    degree = product(p)
    p = cut_lineage(p.join(degree, "id").select("id", "vec", "y", "block", (1 / F.sqrt(F.greatest(F.get("s", F.lit(0)), F.lit(1e-300)))).alias("scale"), F.col("y").alias("f")))
    for _ in range(rounds):
        new = F.zip_with("s", "y", lambda s, y: alpha * F.col("scale") * s + (1 - alpha) * y)
        moved = F.aggregate(F.zip_with("f", "new", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, v: a + v)
        q = p.join(product(p), "id").withColumn("new", new)
        q = cut_lineage(q.select("id", "vec", "y", "block", "scale", F.col("new").alias("f"), moved.alias("moved")))
        done = q.agg(F.sum("moved")).first()[0] < 1e-3
        p = q.drop("moved")
        if done:
            break
    best = F.array_position("f", F.array_max("f")).cast("int")
    return p.select("id", F.get(F.array(*[F.lit(int(c)) for c in classes]), best - 1).cast("int").alias("guess"))


def embed(texts: DataFrame, key: str, text: str, encode: Callable[[list[str]], np.ndarray], kept: DataFrame | None = None) -> DataFrame:
    """(id, vec): vectors of texts by a caller's encoder, one call per Arrow batch; null texts count as empty.

    ``kept`` (id, vec), such as an earlier result read back, gives the vectors of the ids it has; only the others
    are encoded.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            vecs = [np.asarray(v, np.float64).tolist() for v in encode([t or "" for t in b["text"].to_pylist()])] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(vecs, pa.list_(pa.float64()))], names=["id", "vec"])

    t = texts.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    if kept is None:
        return t.mapInArrow(run, "id bigint, vec array<double>")
    k = kept.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL").dropDuplicates(["id"])
    old = t.select("id").join(k, "id")
    return old.unionByName(t.join(k.select("id"), "id", "left_anti").mapInArrow(run, "id bigint, vec array<double>"))
