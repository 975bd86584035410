"""Mix sources to target weights.

Method: Pfair scheduling. The mix is a line of slots of equal size. Source ``s`` with weight ``w`` (weights
sum to 1) is a task whose ``i``-th slot's worth is released at ``floor(i / w)`` and due at ``ceil((i + 1) / w)``; in
every slot the released task that is due first is served. So at any slot's end a source has had its share to
less than one slot. With weights in ``Q``-ths the schedule repeats after ``Q`` slots: one period is computed
on the driver, whatever the size of the data, and every document finds its slot by arithmetic on its position
in its source.

Documents are whole, so one may overhang its slot. It is charged to the slot its middle lies in, so what a source
has had differs from its slots' worth by half the longest document at most, on either side. A *block* is the slot
and what that may come to with all sources (``block_size``; no shorter than half the longest document): at any
point of the mix every source has had its share of what was read to less than one block.

Amounts. The mix is as large as it can be: the source that runs short first, at its cap of repeats, sets the
length, and the others stop where their share is reached. A document is used ``floor`` or ``ceil`` of its
source's average times. Sources without documents (or without weight) can't contribute: the other weights are
scaled up to sum 1, and the report says so.
"""

from __future__ import annotations

import functools
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumage.llm.tokens import running_position

MAX_PERIOD = 4096


def whole_weights(weights: dict[str, float], most: int = MAX_PERIOD) -> dict[str, int]:
    """Weights as integers with a common sum of at most ``most``: exact for usual fractions, else rounded."""
    total = sum(map(Fraction.from_float, weights.values()))
    exact = {s: (Fraction.from_float(w) / total).limit_denominator(1000) for s, w in weights.items()}
    if sum(exact.values()) == 1:
        q = math.lcm(*(f.denominator for f in exact.values()))
        if q <= most:
            return {s: int(f * q) for s, f in exact.items()}
    shares = {s: float(Fraction.from_float(w) / total) * most for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in shares.items()}
    for s in sorted(shares, key=lambda s: (-(shares[s] % 1), s)):
        if sum(out.values()) >= most:
            break
        out[s] += 1
    return out


def pfair(weights: dict[str, int]) -> list[str]:
    """One period: the source served in each of ``sum(weights)`` slots."""
    q = sum(weights.values())
    served = dict.fromkeys(sorted(weights), 0)
    out = []
    for t in range(q):
        ready = [s for s, i in served.items() if i < weights[s] and i * q // weights[s] <= t]
        s = min(ready, key=lambda s: (-(-(served[s] + 1) * q // weights[s]), -weights[s], s)) if ready else min((x for x in served if served[x] < weights[x]), key=lambda x: (-(-(served[x] + 1) * q // weights[x]), x))
        served[s] += 1
        out.append(s)
    return out


def plan(targets: list[tuple[str, float, int]], tokens: dict[str, int]) -> tuple[dict[str, float], float]:
    """(scaled weights, length of the mix in tokens) of the sources that have documents."""
    usable = {s: (w, r) for s, w, r in targets if w and w > 0 and r and r > 0 and tokens.get(s, 0) > 0}
    total = sum(w for w, _ in usable.values())
    if not usable:
        return {}, 0.0
    weights = {s: w / total for s, (w, _) in usable.items()}
    return weights, min(tokens[s] * r / weights[s] for s, (_, r) in usable.items())


def block_size(weights: dict[str, float], longest: int, slot: int) -> int:
    """Tokens of a block: less than this is how far a source is from its share, at any point of a mix.

    A source's slots are right to less than one slot. Documents move it by half the longest one and, by way of the
    total, by its weight times as much for every other source.
    """
    return slot + math.ceil(longest / 2 * max((1 + w * (len(weights) - 2) for w in weights.values()), default=0))


def _listed(docs: DataFrame, key: str, source: str, size: str, targets: list[tuple[str, float, int]]) -> DataFrame:
    names = [s for s, *_ in targets]
    return docs.where(F.col(source).isin(names) & (F.col(size) >= 1) & F.col(key).isNotNull()).select(F.col(source).alias("source"), F.col(key).alias("key"), F.col(size).cast("bigint").alias("size"))


def _amounts(d: DataFrame, targets: list[tuple[str, float, int]]) -> tuple[dict[str, int], dict[str, float], float, int]:
    """(tokens by source, scaled weights, length, longest document of a source that is used): one row per target is read."""
    rows = d.groupBy("source").agg(F.sum("size").alias("n"), F.max("size").alias("most")).collect()
    tokens = {r["source"]: r["n"] for r in rows}
    weights, length = plan(targets, tokens)
    return tokens, weights, length, max((r["most"] for r in rows if r["source"] in weights), default=0)


def mix(docs: DataFrame, key: str, source: str, size: str, targets: list[tuple[str, float, int]], slot: int = 2048) -> DataFrame:
    """(source, key, use, size, slot, position): the schedule of one mix, in slots of ``slot`` tokens.

    ``use`` counts a document's uses from 0; the mix is read by ``slot``, then ``position``, the tokens of
    the source before this use. ``key`` is unique. Null sources and sizes below 1 aren't used; sources that
    ``targets`` doesn't list neither. A target with a null or non-positive weight or repeats gives nothing.
    """
    d = _listed(docs, key, source, size, targets)
    tokens, weights, length, _ = _amounts(d, targets)
    spark = docs.sparkSession
    if not weights:
        return spark.createDataFrame([], f"source string, key {docs.schema[key].dataType.simpleString()}, use int, size bigint, slot bigint, position bigint")
    whole = whole_weights(weights)
    q = sum(whole.values())
    period = pfair(whole)
    nth: dict[str, list[int]] = {s: [] for s in whole}
    for t, s in enumerate(period):
        nth[s].append(t)
    most = {s: int(r) for s, _, r in targets if s in weights}
    rows = [(s, int(tokens[s]), min(int(tokens[s]) * most[s], round(weights[s] * length)), nth[s]) for s in weights]
    table = F.broadcast(spark.createDataFrame(rows, "source string, tokens bigint, goal bigint, slots array<int>"))  # one row per target
    placed = running_position(d, ["source"], "key", F.col("size"), name="start").join(table, "source")
    # pass u over the source's documents begins at u * tokens; a use counts where its middle lies before the goal, so a
    # source ends within half a document of it, and never after its last allowed pass
    passes = F.ceil((2 * F.col("goal") - 2 * F.col("start") - F.col("size")) / (2 * F.col("tokens"))).cast("int")
    used = placed.withColumn("_passes", passes).where("_passes > 0").withColumn("use", F.explode(F.sequence(F.lit(0), F.col("_passes") - 1)))
    position = F.col("start") + F.col("use") * F.col("tokens")
    used = used.withColumn("position", position).withColumn("_b", F.expr(f"(2 * position + size) div {2 * slot}")).withColumn("_n", F.size("slots"))
    at = F.expr(f"(_b div _n) * {q} + get(slots, cast(_b % _n as int))")
    return used.withColumn("slot", at.cast("bigint")).select("source", "key", "use", "size", "slot", "position")


def deviations(docs: DataFrame, key: str, source: str, size: str, targets: list[tuple[str, float, int]], slot: int = 2048) -> DataFrame:
    """(source, target, tokens, block, worst, cap_kept, within_block): how far a source of the mix ever is from its share.

    ``worst`` is the greatest distance in tokens, over all ends of slots, from ``target``, the scaled weight, times
    what was read; inside a slot only one source is read, so no distance is greater than at one of its ends.
    """
    d = _listed(docs, key, source, size, targets)
    _, weights, _, longest = _amounts(d, targets)
    spark = docs.sparkSession
    kind = "source string, target double, tokens bigint, block bigint, worst double, cap_kept boolean, within_block boolean"
    if not weights:
        return spark.createDataFrame([], kind)
    names, block = sorted(weights), block_size(weights, longest, slot)
    m = mix(docs, key, source, size, targets, slot)
    own = [F.sum(F.when(F.col("source") == s, F.col("size")).otherwise(0)).alias(f"_{i}") for i, s in enumerate(names)]
    ends = m.groupBy("slot").agg(*own)
    cols = [f"_{i}" for i in range(len(names))]
    # running sums in three steps, so that no task holds all slots: inside runs of slots, inside runs of runs, and over those
    ends = ends.withColumn("_r", F.expr("slot div 4096")).withColumn("_s", F.expr("slot div 16777216"))
    runs = ends.groupBy("_s", "_r").agg(*[F.sum(c).alias(c) for c in cols])
    tops = runs.groupBy("_s").agg(*[F.sum(c).alias(c) for c in cols])
    before = lambda df, w, mark: df.withColumns({f"{c}{mark}": F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) for c in cols}).drop(*cols)
    tops = before(tops, W.orderBy("_s"), "t")  # a row for 16 million slots
    runs = before(runs, W.partitionBy("_s").orderBy("_r"), "r").join(tops, "_s")
    inner = W.partitionBy("_s", "_r").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    run = ends.withColumns({c: F.sum(c).over(inner) for c in cols}).join(runs.drop("_s"), "_r")
    had = [F.col(c) + F.col(f"{c}r") + F.col(f"{c}t") for c in cols]
    total = functools.reduce(lambda a, b: a + b, had)
    worst = run.agg(*[F.max(F.abs(h - F.lit(weights[s]) * total)).alias(f"w{i}") for i, (s, h) in enumerate(zip(names, had))])
    worst = worst.select(F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"w{i}").alias("worst")) for i, s in enumerate(names)])))
    caps = F.create_map(*[F.lit(x) for s, _, r in targets if s in weights for x in (s, int(r))])
    uses = m.groupBy("source").agg(F.sum("size").alias("tokens"), F.max("use").alias("last")).withColumn("cap_kept", F.col("last") < caps[F.col("source")])
    share = F.create_map(*[F.lit(x) for s in names for x in (s, weights[s])])[F.col("source")]
    return worst.join(uses, "source").select("source", share.alias("target"), "tokens", F.lit(block).cast("bigint").alias("block"), "worst", "cap_kept", (F.col("worst") < block).alias("within_block"))


def shares(schedule: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, actual_share, documents, uses, max_uses): also for sources that gave nothing."""
    per_doc = schedule.groupBy("source", "key").agg(F.count(F.lit(1)).alias("u"), F.sum("size").alias("t"))
    got = per_doc.groupBy("source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("u").alias("uses"), F.max("u").alias("max_uses"))
    out = targets.select("source", "target_share").join(got, "source", "left")
    out = out.withColumn("all_tokens", F.sum("tokens").over(W.partitionBy(F.lit(1))))  # one row a source
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("source", "target_share", zero("tokens"), F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"), zero("documents"), zero("uses"), zero("max_uses"))
