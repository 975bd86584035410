"""Fill containers of fixed capacity with items of varying length.

Method: the configuration linear program over the histogram of lengths. A pattern says how many items of each
length one container takes; wanted is a mix of patterns that covers all items with the fewest containers. The
program is solved by multiplicative weights: every length starts with the weight of its tokens, those that are
covered get lighter, and in each round a knapsack dynamic program (pricing) finds the pattern of greatest weight.
The mix is rounded down to whole containers, and what remains is filled container by container, the longest item
first, by the same pricing on the actual counts.

Effort and accuracy are the same at every size: the program has ``ROUNDS`` rounds a length, each prices the
``PRICED`` lengths of most weight a token and as many spread over all lengths, and sizes are counted in steps of which
a container has ``GRID`` at most (so capacities up to that are exact; beyond, an item may take up to one step more
room than it has tokens). What the result is worth is measured: containers against their least number.

The histogram has at most ``capacity`` entries however large the table is; the program of each capacity is solved in
a task of its own. The items never go there: the solution is a table of slots (length, ranks from and to,
container), at most a few per length and pattern, and items join it by their rank among the items of their length,
which is counted in salted groups. An item longer than the capacity is cut into full containers and one remainder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage.llm.tokens import running_position
from plumage.session import broadcast_if_small, cut_lineage

Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first
ROUNDS, PRICED, GRID = 0.5, 256, 4096


def price(lengths: np.ndarray, limit: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each length fill the capacity with the greatest value: bounded knapsack.

    Each length is split into binary bundles, so ``limit`` is kept; ties prefer the fuller container.
    """
    best = np.zeros(capacity + 1)
    took: list[tuple[int, int, int, np.ndarray]] = []
    for i, size in enumerate(lengths.tolist()):
        left, bundle, v = int(min(limit[i], capacity // size)), 1, float(value[i])
        while left > 0:
            k = min(bundle, left)
            left -= k
            bundle *= 2
            w = k * size
            new = best[: capacity + 1 - w] + v * k
            better = new > best[w:] + 1e-15
            np.maximum(best[w:], new, out=best[w:])
            took.append((i, k, w, better))
    counts = np.zeros(len(lengths), np.int64)
    c = int(np.flatnonzero(best >= best.max() - 1e-12)[0])
    for i, k, w, better in reversed(took):
        if c >= w and better[c - w]:
            counts[i] += k
            c -= w
    return counts


def weights_program(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, eps: float) -> list[tuple[np.ndarray, float]]:
    """Patterns and how many containers of each cover the demand nearly best, as fractions.

    Multiplicative weights for the covering program: a length's weight, at first that of its tokens, falls
    exponentially in how far it is covered. Each round prices the best pattern and takes as much of it as covers no
    length by more than its whole demand; the sum is scaled at the end so that every length is just covered.
    """
    d = demand.astype(float)
    cover = np.zeros(len(lengths))
    mix: dict[bytes, list] = {}
    most = np.minimum(demand, capacity // lengths)
    spread = np.linspace(0, len(lengths) - 1, min(len(lengths), PRICED)).astype(int)
    for _ in range(rounds):
        light = np.exp(-(cover - cover.min()) / eps)
        some = np.unique(np.concatenate([np.argsort(-light, kind="stable")[:PRICED], spread]))
        counts = np.zeros(len(lengths), np.int64)
        counts[some] = price(lengths[some], most[some], light[some] * lengths[some] / capacity, capacity)
        used = counts > 0
        step = float((d[used] / counts[used]).min())
        mix.setdefault(counts.tobytes(), [counts, 0.0])[1] += step
        cover += step * counts / d
    return [(c, x / max(1.0, float(cover.min()))) for c, x in mix.values()]


def fill_rest(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Containers one after another: the longest item left, and the fullest choice of others, long ones first."""
    left, out = left.copy(), []
    while left.any():
        open_ = np.flatnonzero(left)
        first = open_[0]
        room = capacity - int(lengths[first])
        counts = np.zeros(len(lengths), np.int64)
        counts[first] = 1
        rest = left.copy()
        rest[first] -= 1
        fits = np.flatnonzero((rest > 0) & (lengths <= room))
        if len(fits):
            size = lengths[fits].astype(float)
            counts[fits] += price(lengths[fits], rest[fits], size * (1 + 0.4 / capacity * size / capacity), room)
        used = counts > 0
        n = int((left[used] // counts[used]).min())
        out.append((counts, n))
        left -= n * counts
    return out


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """(pattern, number of containers): packs exactly the items of the histogram, all lengths <= capacity.

    The fractions of the program are rounded down and the rest is filled container by container.
    """
    lengths = np.array(sorted((s for s, n in histogram.items() if n > 0), reverse=True), np.int64)
    if not len(lengths):
        return []
    if lengths[-1] < 1 or lengths[0] > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    unit = -(-capacity // GRID)
    if unit > 1:
        # lengths that take the same number of steps are one; an item of the full capacity has its container to itself
        steps: dict[int, int] = {}
        for s in lengths.tolist():
            k = min(-(-s // unit), capacity // unit)
            steps[k] = steps.get(k, 0) + histogram[s]
        return _in_lengths(solve(steps, capacity // unit), {s: histogram[s] for s in lengths.tolist()}, unit, capacity)
    demand = np.array([histogram[int(s)] for s in lengths], np.int64)
    left, out = demand.copy(), []
    mix = weights_program(lengths, demand, capacity, max(100, int(ROUNDS * len(lengths))), 0.5)
    for counts, x in sorted(mix, key=lambda p: (-float((p[0] * lengths).sum()), -p[1])):
        used = counts > 0
        n = int(min(np.floor(x), (left[used] // counts[used]).min()))
        if n > 0:
            out.append((counts, n))
            left -= n * counts
    out += fill_rest(lengths, left, capacity)
    return [(tuple((int(lengths[i]), int(c[i])) for i in np.flatnonzero(c)), n) for c, n in out]


def _in_lengths(solution: list[tuple[Pattern, int]], histogram: dict[int, int], unit: int, capacity: int) -> list[tuple[Pattern, int]]:
    """The same containers with the lengths behind the steps, the longest of each step first.

    Runs of containers with the same lengths stay one entry. The last step may hold items a little longer than
    itself (those of nearly the full capacity); such an item stands alone, so it fits.
    """
    last = capacity // unit
    queue: dict[int, list[list[int]]] = {}
    for s in sorted(histogram):
        queue.setdefault(min(-(-s // unit), last), []).append([s, histogram[s]])
    out: list[tuple[Pattern, int]] = []
    for pattern, n in solution:
        while n > 0:
            m = min(n, *(queue[k][-1][1] // times for k, times in pattern)) if pattern else 0
            if m > 0:
                out.append((tuple((queue[k][-1][0], times) for k, times in pattern), m))
                for k, times in pattern:
                    queue[k][-1][1] -= m * times
            else:  # one container across the border of two lengths
                one: dict[int, int] = {}
                for k, times in pattern:
                    for _ in range(times):
                        while not queue[k][-1][1]:
                            queue[k].pop()
                        queue[k][-1][1] -= 1
                        one[queue[k][-1][0]] = one.get(queue[k][-1][0], 0) + 1
                out.append((tuple(sorted(one.items(), reverse=True)), 1))
                m = 1
            for k, _ in pattern:
                while len(queue[k]) > 1 and not queue[k][-1][1]:
                    queue[k].pop()
            n -= m
    return out


def slots_of(solution: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, times per container, first container) of all items."""
    taken: dict[int, int] = {}
    rows, container = [], 0
    for pattern, n in solution:
        for size, times in pattern:
            start = taken.get(size, 0)
            rows.append((size, start, start + times * n - 1, times, container))
            taken[size] = start + times * n
        container += n
    return rows


def oversized(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Keys of the items that have to be cut."""
    return items.where(F.col(size) > capacity).select(F.lit(capacity).cast("int").alias("capacity"), F.col(key)).distinct()


def pieces(items: DataFrame, key: str, size: str, capacities: list[int]) -> DataFrame:
    """(capacity, key, piece, length, cut): whole items, and items over a capacity as full pieces and a remainder.

    Items whose size is null or below 1 take no room and have no piece.
    """
    s = F.col(size).cast("bigint")
    c = F.explode(F.array(*[F.lit(int(c)) for c in capacities])) if capacities else F.explode(F.array().cast("array<int>"))
    each = items.where(F.col(key).isNotNull() & (s >= 1)).select(c.alias("capacity"), F.col(key), s.alias("_s")).withColumn("_n", F.ceil(F.col("_s") / F.col("capacity")).cast("int"))
    parts = each.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return parts.select("capacity", key, "piece", F.least(F.col("capacity").cast("bigint"), F.col("_s") - F.col("piece") * F.col("capacity")).cast("int").alias("length"), (F.col("_n") > 1).alias("cut"))


def solutions(histogram: DataFrame, tasks: int = 1) -> DataFrame:
    """(capacity, length, lo, hi, times, first) of a histogram (capacity, length, n): one task solves one capacity."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for capacity, text in zip(b["capacity"].to_pylist(), b["hist"].to_pylist()):
                rows = slots_of(solve({int(s): n for s, n in json.loads(text)}, capacity))
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array([capacity] * len(rows), pa.int32()), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["capacity", "length", "lo", "hi", "times", "first"])

    one = histogram.groupBy("capacity").agg(F.to_json(F.collect_list(F.array(F.col("length").cast("bigint"), F.col("n")))).alias("hist"))  # at most ``capacity`` lengths
    return one.repartitionByRange(max(1, tasks), "capacity").mapInArrow(run, "capacity int, length int, lo bigint, hi bigint, times bigint, first bigint")


def pack_all(items: DataFrame, key: str, size: str, capacities: list[int]) -> DataFrame:
    """(capacity, key, piece, length, container): for each capacity every item in exactly one container, of pieces only those cut.

    ``key`` is unique. No container holds more than its capacity; an empty table has no containers. The items are
    read twice, for the histogram and for their ranks, so a dear input should be written before.
    """
    parts = pieces(items, key, size, sorted(set(capacities)))
    slots = cut_lineage(solutions(parts.groupBy("capacity", "length").agg(F.count(F.lit(1)).alias("n")), len(set(capacities))))
    ranked = running_position(parts.withColumn("_id", F.concat_ws("/", F.col(key).cast("string"), "piece")), ["capacity", "length"], "_id", F.lit(1), name="rank").drop("_id")
    met = ranked.join(broadcast_if_small(slots, 1_000_000), ["capacity", "length"]).where(F.col("rank").between(F.col("lo"), F.col("hi")))
    return met.select("capacity", key, "piece", "length", (F.col("first") + F.expr("(rank - lo) div times")).alias("container"))


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, length, container): ``pack_all`` for one capacity."""
    return pack_all(items, key, size, [capacity]).drop("capacity")
