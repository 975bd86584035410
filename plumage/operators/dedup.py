"""At-least-once delivery: keep one copy of each message.

Method: a message number holds a producer and a sequence. For each producer a set of disjoint, inclusive ranges of
the sequences already seen is kept; every number outside the ranges is accepted once and merged into them.
Identifiers that aren't numbers are resolved by an exact keyed lookup.

Numbers are 64-bit ones made by workers on their own: the low bits count inside a millisecond, the bits above name
the worker, the rest is the time. The worker is the producer; time and counter together are its sequence.

Distribution: a producer's sequences are cut into blocks of ``2**block_bits`` and the blocks are hashed over the
tasks, so neither a busy producer nor a busy hour makes a large task. A task reads its numbers in rising order, each
number's deliveries by arrival, so only the range being extended is open: the state is one range and one key,
however many numbers there are and however sparse. Each Arrow batch of the scan first settles what is beaten inside
that batch; settled rows are spread evenly, so a message delivered millions of times sends at most one row per
batch to the task of its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where a number holds its worker.
WORKER_FROM, WORKER_BITS = 12, 10


def producer_of(number: Column, low: int = WORKER_FROM, bits: int = WORKER_BITS) -> Column:
    return F.shiftright(number, low).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def sequence_of(number: Column, low: int = WORKER_FROM, bits: int = WORKER_BITS) -> Column:
    """Time and counter: with the producer, it determines the number."""
    return F.shiftleft(F.shiftright(number, low + bits), low).bitwiseOR(number.bitwiseAND(F.lit((1 << low) - 1)))


class SeenRanges:
    """Disjoint inclusive ranges of the seen sequences of one producer, sorted; ranges that touch are merged."""

    def __init__(self, lo: np.ndarray | None = None, hi: np.ndarray | None = None):
        self.lo = np.empty(0, np.int64) if lo is None else lo
        self.hi = np.empty(0, np.int64) if hi is None else hi

    def covers(self, x: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.lo, x, side="right") - 1
        out = np.zeros(len(x), bool)
        ok = k >= 0
        out[ok] = x[ok] <= self.hi[k[ok]]
        return out

    def accept(self, x: np.ndarray) -> np.ndarray:
        """Mask of the numbers taken: the first occurrence in ``x`` of each that no range covers."""
        take = np.zeros(len(x), bool)
        if len(x):
            values, first = np.unique(x, return_index=True)
            fresh = ~self.covers(values)
            take[first[fresh]] = True
            self._merge(values[fresh])
        return take

    def _merge(self, values: np.ndarray) -> None:
        if not len(values):
            return
        at = np.searchsorted(self.lo, values)
        lo, hi = np.insert(self.lo, at, values), np.insert(self.hi, at, values)
        cut = np.flatnonzero(lo[1:] != hi[:-1] + 1) + 1
        self.lo = lo[np.concatenate([[0], cut])]
        self.hi = hi[np.concatenate([cut - 1, [len(hi) - 1]])]


class OpenRange:
    """The one range that can still grow when producers and their sequences come in rising order.

    ``closed`` counts the ranges left behind: no later number can touch them.
    """

    def __init__(self) -> None:
        self.producer: int | None = None
        self.lo = self.hi = 0
        self.closed = 0

    def accept(self, producer: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Mask of the numbers that the ranges don't cover, each once; they are merged into the ranges."""
        if not len(seq):
            return np.zeros(0, bool)
        start = self.producer is None
        same = producer == np.concatenate([[-1 if start else self.producer], producer[:-1]])
        same[0] &= not start
        before = np.concatenate([[self.hi], seq[:-1]])
        fresh = ~(same & (seq <= before))
        begins = np.flatnonzero(fresh & ~(same & (seq == before + 1)))
        if len(begins):
            self.closed += len(begins) - start
            self.lo = int(seq[begins[-1]])
        self.producer, self.hi = int(producer[-1]), int(seq[-1])
        return fresh


class Arrivals:
    """Marks deliveries that come again, given in the order of producer, sequence, key and arrival."""

    def __init__(self) -> None:
        self.numbers, self.key = OpenRange(), None

    def lost(self, producer: pa.Array, seq: pa.Array, key: pa.Array) -> np.ndarray:
        known = seq.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(seq), bool)
        out[known] = ~self.numbers.accept(producer.drop_null().to_numpy(zero_copy_only=False), seq.drop_null().to_numpy(zero_copy_only=False))
        if not known.all():
            rest = key.filter(pa.array(~known))
            before = pa.concat_arrays([pa.array([self.key], pa.string()), rest.slice(0, len(rest) - 1)])
            again = pc.fill_null(pc.equal(rest, before), False)  # a row without an identifier is like no other
            out[~known] = again.to_numpy(zero_copy_only=False)
            self.key = rest[-1].as_py()
        return out


def _within_batch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = [(c, "ascending") for c in ("_producer", "_seq", "_key", "_at", "_row")]
    for b in it:
        if b.num_rows:
            b = b.take(pc.sort_indices(b, sort_keys=order))
            lost = Arrivals().lost(b["_producer"], b["_seq"], b["_key"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lost)], names=[*b.schema.names, "_lost"])


def _by_number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = Arrivals()
    for b in it:
        lost = np.array(b["_lost"].to_numpy(zero_copy_only=False), bool)
        open_ = np.flatnonzero(~lost)
        part = b.take(pa.array(open_))
        lost[open_] = seen.lost(part["_producer"], part["_seq"], part["_key"])
        yield pa.RecordBatch.from_arrays([b["_row"], pa.array(lost)], names=["row_id", "redelivered"])


def mark_redeliveries(df: DataFrame, row: Column, number: Column, at: Column, key: Column | None = None, low: int = WORKER_FROM, bits: int = WORKER_BITS, block_bits: int = 22) -> DataFrame:
    """(row_id, redelivered): ``redelivered`` is false for the one delivery kept of each identifier.

    Kept is the earliest by ``at``, then by smallest row id; a null ``at`` counts as latest. ``number`` is
    the identifier where it is a bigint, with its worker in ``bits`` bits from ``low`` up; ``key`` is its text for
    those that aren't numbers. A row with neither can't be told from another: it is kept. ``row`` is a bigint and
    not null. An empty table gives an empty result; other columns of ``df``, whatever their names, aren't looked at.
    """
    n = number.cast("bigint")
    base = df.select(
        row.cast("bigint").alias("_row"),
        producer_of(n, low, bits).alias("_producer"),
        sequence_of(n, low, bits).alias("_seq"),
        F.when(n.isNull(), F.lit(None) if key is None else key).cast("string").alias("_key"),
        F.coalesce(F.unix_micros(at.cast("timestamp")), F.lit(2**63 - 1)).alias("_at"),
    )
    first = base.mapInArrow(_within_batch, "_row bigint, _producer int, _seq bigint, _key string, _at bigint, _lost boolean")
    spread = F.xxhash64("_row")
    slot = (
        F.when(F.col("_lost"), spread)
        .when(F.col("_seq").isNotNull(), F.xxhash64("_producer", F.shiftright("_seq", block_bits)))
        .when(F.col("_key").isNotNull(), F.xxhash64("_key"))
        .otherwise(spread)
    )
    return (
        first.withColumn("_slot", slot)
        .repartition("_slot")
        .drop("_slot")
        .sortWithinPartitions("_producer", "_seq", "_key", "_at", "_row")
        .mapInArrow(_by_number, "row_id bigint, redelivered boolean")
    )
