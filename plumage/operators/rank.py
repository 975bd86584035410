"""Pairwise neural ranking of candidates: a small network, in numpy, and greedy ordering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumage.session import cut_lineage

SIZES = (8, 8, 8, 8, 1)
#: Pairs that a network is fitted to in one process; more stay with the executors, which sum the slopes of theirs, with the same result.
NEAR = 20_000
#: Pairs of a block that an executor holds at once.
BLOCK = 4096


def _miss(score: np.ndarray, target: np.ndarray, loss: str) -> tuple[float, np.ndarray]:
    """The sum of the losses of the rows and the slope of each row's."""
    if loss == "mse":
        return float(((score - target) ** 2).sum()), 2 * (score - target)
    if loss == "margin":
        short = np.maximum(0, 1 - np.sign(target) * score)
        return float(short.sum()), -np.sign(target) * (short > 0)
    raise ValueError(f"unknown loss {loss!r}")


class Adam:
    """Steps of Adam over arrays that it changes in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, m, v, g in zip(self.params, self.m, self.v, grads):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


class Mlp:
    """Layers of 8, tanh between them; dropout while training."""

    def __init__(self, inputs: int, seed: int = 0, sizes: tuple[int, ...] = SIZES, sigmoid: bool = False):
        rng = np.random.default_rng(seed)
        dims = (inputs, *sizes)
        self.w = [rng.standard_normal((a, b)) / np.sqrt(a) for a, b in zip(dims, dims[1:])]
        self.b = [np.zeros(b) for b in sizes]
        self.sigmoid = sigmoid

    def params(self) -> list[np.ndarray]:
        return [*self.w, *self.b]

    def forward(self, x: np.ndarray, masks: list[np.ndarray] | None = None):
        acts = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b)):
            x = x @ w + b
            if i < len(self.w) - 1:
                x = np.tanh(x)
                if masks is not None:
                    x = x * masks[i]
            acts.append(x)
        out = 1 / (1 + np.exp(-x)) if self.sigmoid else x
        return out[:, 0], acts

    def backward(self, grad: np.ndarray, out: np.ndarray, acts: list[np.ndarray], masks: list[np.ndarray] | None) -> list[np.ndarray]:
        g = (grad * out * (1 - out) if self.sigmoid else grad)[:, None]
        gw, gb = [], []
        for i in range(len(self.w) - 1, -1, -1):
            gw.append(acts[i].T @ g)
            gb.append(g.sum(0))
            if i:
                g = g @ self.w[i].T
                if masks is not None:
                    g = g * masks[i - 1]
                raw = acts[i] if masks is None else np.where(masks[i - 1] > 0, acts[i] / np.maximum(masks[i - 1], 1e-12), 0)
                g = g * (1 - raw * raw)
        return [*gw[::-1], *gb[::-1]]


class Ranker:
    """Scores a pair of candidates: one network, or two mixed by a gate over features of the tag.

    ``multi``: score = g * multi(pair) + (1 - g) * single(pair), with g = gate(tag) in (0, 1).
    """

    def __init__(self, inputs: int, tag_inputs: int = 0, singles: int = 0, seed: int = 0):
        self.multi = Mlp(2 * inputs, seed)
        self.gated = tag_inputs > 0
        if self.gated:
            self.single = Mlp(2 * singles, seed + 1)
            self.gate = Mlp(tag_inputs, seed + 2, (8, 1), sigmoid=True)

    def nets(self) -> list[Mlp]:
        return [self.multi, self.single, self.gate] if self.gated else [self.multi]

    def predict(self, pair: np.ndarray, single: np.ndarray | None = None, tag: np.ndarray | None = None) -> np.ndarray:
        m = self.multi.forward(pair)[0]
        if not self.gated:
            return m
        g = self.gate.forward(tag)[0]
        return g * m + (1 - g) * self.single.forward(single)[0]

    def train(self, pair, target, single=None, tag=None, multiword=None, loss: str = "mse", epochs: int = 100, rate: float = 0.01, dropout: float = 0.5, seed: int = 0) -> list[float]:
        """Full-batch Adam. ``mse`` regresses the difference of labels; ``margin`` wants its sign by a margin of 1.

        ``multiword`` (0 or 1) is what the gate should say; its cross-entropy is added.
        """
        rng = np.random.default_rng(seed)
        adam = Adam([p for n in self.nets() for p in n.params()], rate)
        losses = []
        n = max(1, len(target))
        for _ in range(epochs):
            runs = []
            for net, x in zip(self.nets(), (pair, single, tag)):
                masks = [(rng.random((len(x), w.shape[1])) >= dropout) / (1 - dropout) for w in net.w[:-1]] if dropout else None
                runs.append((net, masks, *net.forward(x, masks)))
            g = runs[2][2] if self.gated else None
            score = g * runs[0][2] + (1 - g) * runs[1][2] if self.gated else runs[0][2]
            value, d = _miss(score, target, loss)
            value, d = value / n, d / n
            if self.gated:
                dg = d * (runs[0][2] - runs[1][2])
                if multiword is not None:
                    p = np.clip(g, 1e-7, 1 - 1e-7)
                    value += float(-(multiword * np.log(p) + (1 - multiword) * np.log(1 - p)).mean())
                    dg = dg + (p - multiword) / (p * (1 - p)) / n
                grads = [*runs[0][0].backward(d * g, runs[0][2], runs[0][3], runs[0][1]), *runs[1][0].backward(d * (1 - g), runs[1][2], runs[1][3], runs[1][1]), *runs[2][0].backward(dg, g, runs[2][3], runs[2][1])]
            else:
                grads = runs[0][0].backward(d, runs[0][2], runs[0][3], runs[0][1])
            adam.step(grads)
            losses.append(value)
        return losses


def greedy(pairs: dict[tuple[str, str], float]) -> list[tuple[str, float]]:
    """Order by repeatedly taking the greatest sum of pair scores and taking its pairs off the others'; ties by name."""
    left = {a for a, _ in pairs} | {b for _, b in pairs}
    total = {a: sum(s for (x, y), s in pairs.items() if x == a and y != a) for a in left}
    out = []
    while left:
        best = min(left, key=lambda a: (-round(total[a], 9), a))
        out.append((best, total[best]))
        left.discard(best)
        for a in left:
            total[a] -= pairs.get((a, best), 0.0)
    return out


def candidate_pairs(candidates: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b): ordered pairs of different candidates of a key. ``value`` is an array of distinct texts."""
    a = candidates.select(key, F.explode(F.array_distinct(value)).alias("a"), F.array_distinct(value).alias("_v"))
    return a.select(key, "a", F.explode("_v").alias("b")).where("a != b")


def rerank(scored: DataFrame, key: str) -> DataFrame:
    """(key, seg, rank) from pair scores (key, a, b, score): greedy order inside each key's short list."""
    per = scored.groupBy(key).agg(F.collect_list(F.struct("a", "b", "score")).alias("p"))  # a list's own pairs, k squared
    kt = scored.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(k, s, i + 1) for k, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, (s, _) in enumerate(greedy({(p["a"], p["b"]): p["score"] for p in ps}))]
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], names=[key, "seg", "rank"])

    return per.mapInArrow(run, f"`{key}` {kt}, seg string, rank int")


def training_pairs(labelled: DataFrame, key: str, seg: str, label: str, features: str, loss: str = "mse") -> DataFrame:
    """(key, a, b, x, y): pairs of a key's candidates to train on.

    ``mse``: all ordered pairs, also of a candidate with itself, with the difference of labels. ``margin``: only
    pairs of unequal labels, with its sign. ``x`` is both feature vectors one after the other.
    """
    if loss not in ("mse", "margin"):
        raise ValueError(f"unknown loss {loss!r}")
    side = lambda n: labelled.select(F.col(key).alias("key"), F.col(seg).alias(n), F.col(label).cast("double").alias(f"l{n}"), F.col(features).alias(f"x{n}"))
    j = side("a").join(side("b"), "key")
    diff = F.col("la") - F.col("lb")
    if loss == "margin":
        j, diff = j.where("la != lb"), F.signum(diff)
    return j.select(F.col("key").alias(key), "a", "b", F.concat("xa", "xb").alias("x"), diff.alias("y"))


def _blocks(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(n, x, y): the numbers of up to BLOCK pairs a row."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                cells = [b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).tobytes(), b.column(1).to_numpy(zero_copy_only=False).astype(float).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], names=["n", "x", "y"])

    return pairs.select(F.col(x).cast("array<double>"), F.col(y).cast("double")).mapInArrow(pack, "n int, x binary, y binary")


def _summed(blocks: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of(x, y)``, a vector, over all blocks: tasks sum theirs, and their sums are added in the order of the tasks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in it:
            for n, x, y in zip(*[c.to_pylist() for c in b.columns]):
                part = of(np.frombuffer(x).reshape(n, -1), np.frombuffer(y))
                out = part if out is None else out + part
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["s"])

    return reduce(np.add, [np.frombuffer(r.s) for r in blocks.mapInArrow(run, "s binary").collect()])


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays])


def _fit_far(pairs: DataFrame, x: str, y: str, loss: str, epochs: int, rate: float, seed: int) -> tuple[Ranker, np.ndarray, np.ndarray]:
    """The network, mean and deviation of pairs that no single process holds: full-batch Adam whose slopes the executors sum."""
    blocks = cut_lineage(_blocks(pairs, x, y))
    first = _summed(blocks, lambda v, _: np.array([len(v), *v.sum(0)]))
    n, mean = first[0], first[1:] / first[0]
    std = np.sqrt(_summed(blocks, lambda v, _: ((v - mean) ** 2).sum(0)) / n) + 1e-6
    net = Ranker(len(mean) // 2, seed=seed)
    adam = Adam(net.multi.params(), rate)

    def slopes(v: np.ndarray, target: np.ndarray) -> np.ndarray:
        out, acts = net.multi.forward((v - mean) / std)
        return _flat(net.multi.backward(_miss(out, target, loss)[1] / n, out, acts, None))

    for _ in range(epochs):
        g = _summed(blocks, slopes)
        ends = np.cumsum([p.size for p in adam.params])[:-1]
        adam.step([a.reshape(p.shape) for a, p in zip(np.split(g, ends), adam.params)])
    return net, mean, std


def fit_pairs(pairs: DataFrame, keys: list[str], x: str, y: str, loss: str = "mse", epochs: int = 100, rate: float = 0.01, seed: int = 3, near: int = NEAR) -> Callable[[Column], Column]:
    """A column function that scores pair vectors, by a network fitted to all pairs, which ``keys`` tell apart.

    Up to ``near`` pairs are fitted in this process, more by the executors. Of an empty table it scores everything 0.
    ``pairs`` are read several times: a table that is dear to compute should have its lineage cut before.
    """
    if pairs.limit(near + 1).count() > near:
        net, mean, std = _fit_far(pairs, x, y, loss, epochs, rate, seed)
    else:
        rows = pairs.orderBy(*keys).select(x, y).collect()
        if not rows:
            return lambda c: F.lit(0.0)
        v = np.array([r[x] for r in rows], float)
        mean, std = v.mean(0), v.std(0) + 1e-6
        net = Ranker(v.shape[1] // 2, seed=seed)
        net.train((v - mean) / std, np.array([r[y] for r in rows], float), loss=loss, epochs=epochs, rate=rate, dropout=0.0)

    @F.pandas_udf("double")
    def score(col: pd.Series) -> pd.Series:
        return pd.Series(net.predict((np.stack(col.to_list()) - mean) / std).round(6) if len(col) else [], dtype="float64")

    return score
