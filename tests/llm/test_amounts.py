"""Packing and mixing."""

import random

import pytest
from pyspark.sql import functions as F

from plumage.llm import mixing as X
from plumage.llm import packing as P
from plumage.llm.tokens import n_tokens, running_position


def test_token_counts(spark):
    rows = {"It's 3 o'clock!!": 8, "": 0, "   ": 0, "a_b-c": 3, "Дякую, всім": 3, "...": 1, "😷😷 x": 2}
    df = spark.createDataFrame(list(rows.items()), "t string, want int")
    assert df.where(n_tokens(F.col("t")) != F.col("want")).count() == 0
    assert spark.range(1).select(n_tokens(F.lit(None).cast("string")).alias("n")).first().n is None


def test_running_position_is_a_partition(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.7 else "cold", rng.choice([None, 0, 1, 5, 9])) for i in range(2000)]
    df = running_position(spark.createDataFrame(rows, "k long, g string, n int"), ["g"], "k", F.col("n"))
    for g in ("hot", "cold"):
        got = sorted((r.start, r.n or 0) for r in df.where(f"g = '{g}'").collect())
        at = 0
        for start, n in got:
            assert start == at
            at = start + n


def test_price_is_a_bounded_knapsack():
    import itertools

    import numpy as np

    rng = random.Random(2)
    for _ in range(40):
        sizes = np.array(sorted(rng.sample(range(1, 12), 3), reverse=True))
        limit, value = np.array([rng.randrange(0, 4) for _ in sizes]), np.array([rng.random() for _ in sizes])
        got = P.price(sizes, limit, value, 15)
        assert (got <= limit).all() and (got * sizes).sum() <= 15
        best = max(sum(c * v for c, v in zip(cs, value)) for cs in itertools.product(*[range(m + 1) for m in limit]) if sum(c * s for c, s in zip(cs, sizes)) <= 15)
        assert (got * value).sum() == pytest.approx(best)


@pytest.mark.parametrize("seed", range(8))
def test_solution_packs_exactly(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 97, 512]) if seed < 6 else 100_003  # counted in steps of 25
    hist = {rng.randrange(1, cap + 1): rng.randrange(1, 400) for _ in range(rng.randrange(1, 40))}
    sol = P.solve(hist, cap)
    packed = {}
    for pattern, n in sol:
        assert n > 0 and sum(s * c for s, c in pattern) <= cap
        for s, c in pattern:
            packed[s] = packed.get(s, 0) + c * n
    assert packed == hist
    bins, volume = sum(n for _, n in sol), sum(s * n for s, n in hist.items())
    # first fit decreasing, for comparison: never worse than it by more than one in fifty
    left: list[int] = []
    for s in sorted((s for s, n in hist.items() for _ in range(n)), reverse=True):
        for i, room in enumerate(left):
            if room >= s:
                left[i] -= s
                break
        else:
            left.append(cap - s)
    assert -(-volume // cap) <= bins <= len(left) * 1.02 + 1


def test_the_program_decides():
    """Most containers come from the program's mix, not from filling the rest, with hundreds of lengths too."""
    import numpy as np

    rng = np.random.default_rng(1)
    lengths, demand = np.arange(700, 0, -1), rng.integers(1, 40, 700)
    mix = P.weights_program(lengths, demand, 2048, 350, 0.5)
    cover = sum(c * x for c, x in mix)
    assert (cover > 0).mean() > 0.9 and all((c * lengths).sum() <= 2048 for c, _ in mix)


def test_several_capacities_at_once(spark):
    df = spark.createDataFrame([(i, 1 + i * 7 % 150) for i in range(500)], "k long, n int")
    got = P.pack_all(df, "k", "n", [100, 64, 100]).groupBy("capacity", "container").agg(F.sum("length").alias("s")).groupBy("capacity").agg(F.sum("s").alias("all"), F.max("s").alias("top")).collect()
    assert {r.capacity: r["all"] for r in got} == {c: sum(1 + i * 7 % 150 for i in range(500)) for c in (64, 100)} and all(r.top <= r.capacity for r in got)
    assert P.pack_all(df, "k", "n", []).count() == 0


def test_pack(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([5, 5, 5, 17, 33, 250, 0, None])) for i in range(800)]
    df = spark.createDataFrame(rows, "k long, n int").withColumn("container", F.lit("clash"))
    got = P.pack(df, "k", "n", 100).collect()
    fill, pieces = {}, {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.length
        pieces.setdefault(r.k, []).append((r.piece, r.length))
    assert max(fill.values()) <= 100 and sum(fill.values()) / (100 * len(fill)) > 0.97
    assert {k: sum(n for _, n in p) for k, p in pieces.items()} == {k: n for k, n in rows if n}
    assert all(len(p) == (3 if dict(rows)[k] == 250 else 1) for k, p in pieces.items())
    assert P.pack(df.limit(0), "k", "n", 100).count() == 0
    assert {r.k for r in P.oversized(df, "k", "n", 100).collect()} == {k for k, n in rows if n == 250}


def test_pfair_deviates_by_less_than_a_block():
    for w in ({"a": 1}, {"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 97, "b": 2, "c": 1}, {"a": 7, "b": 7, "c": 7, "d": 1}):
        q = sum(w.values())
        slots = X.pfair(w)
        assert len(slots) == q
        for s, n in w.items():
            served = 0
            for t, who in enumerate(slots, 1):
                served += who == s
                assert abs(served - t * n / q) < 1
            assert served == n


def test_weights():
    assert X.whole_weights({"a": 0.35, "b": 0.3, "c": 0.25, "d": 0.1}) == {"a": 7, "b": 6, "c": 5, "d": 2}
    assert sum(X.whole_weights({"a": 0.123456, "b": 0.654321, "c": 1e-9}).values()) <= X.MAX_PERIOD
    assert X.plan([("a", 0.5, 2), ("b", 0.5, 1), ("none", 0.3, 1), ("zero", 0.0, 1)], {"a": 10, "b": 100, "zero": 5})[1] == 40


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, s, rng.randrange(1, 60)) for i, s in enumerate(["big"] * 1500 + ["mid"] * 300 + ["small"] * 60 + ["other"] * 50)] + [(9000, None, 5), (9001, "big", None), (9002, "big", 0)]
    df = spark.createDataFrame(rows, "k long, source string, n int").withColumn("slot", F.lit("clash"))
    targets = [("big", 0.6, 1), ("mid", 0.2, 2), ("small", 0.1, 4), ("missing", 0.1, 5)]
    m = X.mix(df, "k", "source", "n", targets, slot=50).collect()
    size = {k: n for k, _, n in rows}
    total = sum(r["size"] for r in m)
    uses = {}
    for r in m:
        uses[r.key] = uses.get(r.key, 0) + 1
    for s, w, cap in targets[:3]:
        own = [r for r in m if r.source == s]
        assert abs(sum(r["size"] for r in own) / total - w / 0.9) < 0.02
        assert max(uses[r.key] for r in own) <= cap and max(uses[r.key] for r in own) - min(uses.get(k, 0) for k, src, n in rows if src == s and n) <= 1
    assert all(r["size"] == size[r.key] for r in m) and {r.source for r in m} == {"big", "mid", "small"}
    # read by slot, any source has had its share to less than a block, at every document
    weights = {s: w / 0.9 for s, w, _ in targets[:3]}
    block = X.block_size(weights, max(r["size"] for r in m), 50)
    assert block < 50 + 60
    worst = dict.fromkeys(weights, 0.0)
    order = sorted(m, key=lambda r: (r.slot, r.position))
    seen, all_ = {}, 0
    for r in order:
        all_ += r["size"]
        seen[r.source] = seen.get(r.source, 0) + r["size"]
        for s, w in weights.items():
            worst[s] = max(worst[s], abs(seen.get(s, 0) - all_ * w))
    assert max(worst.values()) < block
    said = {r.source: r for r in X.deviations(df, "k", "source", "n", targets, slot=50).collect()}
    assert all(r.cap_kept and r.within_block and r.block == block and r.worst == pytest.approx(worst[s]) for s, r in said.items()) and set(said) == set(weights)
    t = spark.createDataFrame([(s, w) for s, w, _ in targets], "source string, target_share double")
    rep = {r.source: r for r in X.shares(X.mix(df, "k", "source", "n", targets), t).collect()}
    assert rep["missing"].tokens == 0 and rep["missing"].actual_share == 0 and sum(r.actual_share for r in rep.values()) == pytest.approx(1)
    assert X.mix(df.limit(0), "k", "source", "n", targets).count() == 0 and X.mix(df, "k", "source", "n", []).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_documents_longer_than_slots(spark, seed):
    """Long documents, uneven weights and one source that has a third of all: still within one block."""
    rng = random.Random(seed)
    rows = [(i, rng.choice("aaabcd"), rng.choice([1, 20, 400, rng.randrange(1, 3000)])) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, source string, n int")
    targets = [("a", 0.55, 1), ("b", 0.25, 3), ("c", 0.15, 5), ("d", 0.05, 2)]
    got = X.deviations(df, "k", "source", "n", targets, slot=128).collect()
    assert len(got) == 4 and all(r.within_block and r.cap_kept and r.worst > 0 for r in got)
    assert X.deviations(df.limit(0), "k", "source", "n", targets).count() == 0
