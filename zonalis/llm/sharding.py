"""Shards by minimax contiguous partition: the smallest capacity at which a greedy pass over ordered atomic groups needs no more shards than given."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonalis.llm.shared import text_or_empty, written


@dataclass
class Span:
    """Neighbouring groups in key order. atomic: a single group, which no cut may divide."""

    bits: int
    bucket: int
    size: int
    last_key: int
    atomic: bool


class Line:
    """Spans laid end to end; cuts may fall on their ends, and inside those that aren't atomic, though where exactly isn't known yet."""

    def __init__(self, spans: list[Span]):
        self.spans, self.ends = spans, [0]
        for s in spans:
            self.ends.append(self.ends[-1] + s.size)
        self.total = self.ends[-1]

    def greedy(self, capacity: int, shards: int, loose: bool) -> list[int]:
        """Where each shard ends if filled to the capacity. loose: any point of a span that isn't atomic may end a shard (an upper bound of the true end); else only known ends (a lower bound)."""
        at, out = 0, []
        for _ in range(shards):
            k = bisect_right(self.ends, at + capacity)
            known = self.ends[k - 1]
            if k == len(self.ends):
                at = self.total
            elif loose and not self.spans[k - 1].atomic:
                at += capacity
            else:
                at = max(at, known)
            out.append(at)
        return out

    def smallest(self, shards: int, loose: bool) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, shards, loose)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def unclear(self, shards: int) -> list[Span]:
        """Spans that must be split before the smallest capacity, and the cuts at it, are exact."""
        low, high = self.smallest(shards, True), self.smallest(shards, False)
        first, last = self.greedy(low, shards, False), self.greedy(high, shards, True)
        out: dict[tuple[int, int], Span] = {}
        for j in range(shards - 1):
            ideal = self.total * (j + 1) // shards
            for k in range(bisect_right(self.ends, min(first[j], ideal)) - 1, min(bisect_left(self.ends, max(last[j], ideal)), len(self.spans))):
                if not self.spans[k].atomic:
                    out[self.spans[k].bits, self.spans[k].bucket] = self.spans[k]
        return list(out.values())

    def cuts(self, shards: int) -> list[int]:
        """The last key of each shard but the last one. No shard exceeds the smallest capacity; within it each cut lies as near its even share as known ends allow."""
        capacity = self.smallest(shards, False)
        earliest = [self.total] * shards
        for j in range(shards - 2, -1, -1):
            earliest[j] = self.ends[bisect_left(self.ends, max(0, earliest[j + 1] - capacity))]
        at, keys = 0, []
        for j in range(shards - 1):
            ideal = self.total * (j + 1) / shards
            first, past = bisect_left(self.ends, max(at, earliest[j])), bisect_right(self.ends, at + capacity)
            k = min(max(bisect_left(self.ends, ideal), first), past - 1)
            if k > first and ideal - self.ends[k - 1] < self.ends[k] - ideal:
                k -= 1
            at = self.ends[k]
            keys.append(self.spans[k - 1].last_key if k else -(2**63))
        return keys


def _spans(keyed: DataFrame, bits: int, key: str, size: str) -> list[Span]:
    rows = keyed.groupBy(F.shiftright(key, 64 - bits).alias("bucket")).agg(F.sum(size).alias("size"), F.min(key).alias("first"), F.max(key).alias("last")).collect()
    return [Span(bits, r["bucket"], r["size"], r["last"], r["first"] == r["last"]) for r in sorted(rows)]


def minimax_cuts(keyed: DataFrame, shards: int, key: str = "key", size: str = "size", coarse_bits: int = 12, fine_bits: int = 8) -> list[int]:
    """Last keys of all shards but the last one, for a table of (key, size) whose rows of one key form an atomic group; groups are ordered by key.

    Spark sums sizes by ranges of keys; only the ranges in which a cut may fall, about shards squared of them, are split further
    by the next bits of the key until what matters is single groups. The driver never holds more than 2**coarse_bits plus
    shards**2 * 2**fine_bits sums, whatever the number of rows. An empty table yields no cuts.
    """
    spans = _spans(keyed, coarse_bits, key, size)
    if not spans:
        return []
    bits = coarse_bits
    while bits < 64 and (split := Line(spans).unclear(shards)):
        finer = min(64, bits + fine_bits)
        inside = F.shiftright(key, 64 - bits).isin([s.bucket for s in split])
        gone = {(s.bits, s.bucket) for s in split}
        spans = sorted([s for s in spans if (s.bits, s.bucket) not in gone] + _spans(keyed.where(inside), finer, key, size), key=lambda s: s.last_key)
        bits = finer
    return Line(spans).cuts(shards)


def shard_of(key: Column, cuts: list[int]) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(key > F.lit(c), 1).otherwise(0)
    return out.cast("int")


def slots(df: DataFrame, shard: str, spread: Column, order: list[str], parts: int = 256) -> DataFrame:
    """df with slot, gapless from 0 in each shard. A shard's rows are numbered in `parts` pieces dealt by the hash `spread`, then shifted by the counts of the pieces before; those counts are parts rows a shard at most, so they can be broadcast."""
    df = df.withColumn("_part", F.pmod(spread, F.lit(parts)).cast("int"))
    counts = df.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(shard, "_part").orderBy(*order)) - 1
    return df.withColumn("slot", inside).join(F.broadcast(offsets), [shard, "_part"]).withColumn("slot", (F.col("slot") + F.col("_before")).cast("long")).drop("_part", "_before")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every document under the law `bytes`.

    A group is all documents of one text (by 64-bit hash, which also orders the groups); it is never divided. The largest shard
    is as small as any contiguous division allows. Null texts count as empty; null and repeated ids, repeated rows and ties keep a
    row each; an empty table gives an empty result; other columns are not read.
    """
    text = text_or_empty(text_col)
    keyed = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "keyed",
    )
    placed = keyed.withColumn("shard", shard_of(F.col("key"), minimax_cuts(keyed, shards)))
    numbered = slots(placed, "shard", F.xxhash64("doc_id", "key", F.lit(17)), ["doc_id", "key"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
