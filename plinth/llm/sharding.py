"""Sharding by minimax contiguous partition.

Equal texts form an atomic group.  Groups stand in the order of their digests
and are cut into at most ``shards`` contiguous runs so that the largest run has
the fewest bytes: the smallest capacity for which a greedy packing needs no more
than ``shards`` runs is found by binary search, and the runs of that packing are
the shards (law ``bytes``).  Runs then follow the order of the digests, so a
shard is told by comparing a digest with at most ``shards - 1`` cuts.

The driver never holds the groups.  It starts with the byte sums of the 4,096 blocks of
the digest space, which bound every cut of a greedy packing from both sides; only the
blocks in which a bound falls are split by further digest bits, again and again, until
the bounds meet.  A split makes at most 256 pieces of each of at most 4 * shards
pieces, whatever the size of the input, and the number of splits grows with its logarithm.

Rows are numbered by a range sort on (digest, id), which splits a large group over
several partitions; a row's slot is its rank, less the rank at which its shard
starts.

Defined cases: null text has no bytes, the crc32 of the empty text, and forms one
group with empty texts; an empty table gives an empty result; repeated rows and
null ids get slots of their own; with fewer groups than shards the last shards
stay empty; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents

#: Hex digits of a digest that name a block, and that each further split adds.
BLOCK_DIGITS, SPLIT_DIGITS = 3, 2
SHARDS = 24
#: Bytes that a row counts beside its text.
ROW_BYTES = 8


@dataclass
class Pieces:
    """Runs of groups in the order of the digests: name (leading hex digits), bytes, largest group, last digest; ``whole``: a single group."""

    names: list[str]
    sums: np.ndarray
    largest: np.ndarray
    last: list[str]
    whole: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str, int, int, str, int]]) -> Pieces:
        rows = sorted(rows)
        names, sums, largest, last, n = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
        return Pieces(names, np.array(sums, np.int64), np.array(largest, np.int64), last, np.array(n, np.int64) == 1)

    def __post_init__(self) -> None:
        self.ends = np.cumsum(self.sums)

    def reach(self, x: int, least: bool) -> tuple[int, int]:
        """A bound on the last group boundary at or before byte ``x``, and the piece that leaves it open (-1: none does)."""
        p = int(np.searchsorted(self.ends, x, side="right"))
        if p == len(self.ends):
            return int(self.ends[-1]), -1
        start = int(self.ends[p] - self.sums[p])
        if x == start or self.whole[p]:
            return start, -1
        return (max(start, x - int(self.largest[p]) + 1) if least else x), p

    def greedy(self, capacity: int, shards: int, least: bool) -> tuple[bool, list[int], set[int]]:
        """Whether ``shards`` runs reach the end if every cut lies at its least (else: greatest) bound; the cuts, and the open pieces."""
        cuts, opened, at, total = [], set(), 0, int(self.ends[-1])
        for _ in range(shards):
            stop, p = self.reach(at + capacity, least)
            if p >= 0:
                opened.add(p)
            if stop <= at:
                return False, cuts, opened
            cuts.append(stop)
            at = stop
            if at == total:
                return True, cuts, opened
        return False, cuts, opened

    def smallest(self, shards: int, least: bool) -> int:
        """The smallest capacity under which the bounds reach the end: binary search, checking greedily."""
        low, high = max(int(self.largest.max()), -(-int(self.ends[-1]) // shards)), int(self.ends[-1])
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, shards, least)[0]:
                high = mid
            else:
                low = mid + 1
        return low

    def split(self, rows: list[tuple[str, int, int, str, int]], gone: set[int]) -> Pieces:
        """The same with the pieces ``gone`` replaced by ``rows``."""
        kept = [(self.names[i], int(self.sums[i]), int(self.largest[i]), self.last[i], 1 if self.whole[i] else 2) for i in range(len(self.names)) if i not in gone]
        return Pieces.of(kept + rows)


def cut_digests(pieces: Pieces, shards: int, fetch: Callable[[list[str]], list[tuple[str, int, int, str, int]]]) -> list[str]:
    """The last digests of all runs but the last under the smallest feasible capacity.

    ``fetch`` splits the named pieces.  The smallest capacity lies between those of both bounds; the
    pieces that keep the bounds apart are split until one capacity and one place of each cut is left.
    """
    while len(pieces.names):
        surely, perhaps = pieces.smallest(shards, least=True), pieces.smallest(shards, least=False)
        opened: set[int] = set()
        for capacity in {surely, perhaps}:
            for least in (True, False):
                opened |= pieces.greedy(capacity, shards, least)[2]  # at most one piece for each cut
        if surely == perhaps and not pieces.greedy(surely, shards, least=False)[2]:
            starts = {int(e): i for i, e in enumerate(pieces.ends)}
            return [pieces.last[starts[c]] for c in pieces.greedy(surely, shards, least=False)[1][:-1]]
        pieces = pieces.split(fetch([pieces.names[i] for i in sorted(opened)]), opened)
    return []


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Deal ``docs`` into ``shards`` shards of nearly equal bytes, equal texts together."""
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("digest"),
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = rows.repartitionByRange(n, "digest", "doc_id").sortWithinPartitions("digest", "doc_id")
    ranked = scratch.write(ranked.withColumn("place", F.monotonically_increasing_id()), "ranked")
    groups = scratch.keep(ranked.groupBy("digest").agg(F.sum("size").alias("size")))

    def pieces(some: DataFrame, digits: int) -> DataFrame:
        return some.groupBy(F.substring("digest", 1, digits).alias("name")).agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.max("digest").alias("last"), F.count(F.lit(1)).alias("n"))

    def fetch(names: list[str]) -> list[tuple]:
        found = []
        for digits in sorted({len(x) for x in names}):
            some = groups.where(F.substring("digest", 1, digits).isin([x for x in names if len(x) == digits]))
            found += [tuple(r) for r in pieces(some, digits + SPLIT_DIGITS).collect()]  # at most 256 rows for each of 4 * shards names
        return found

    cuts = cut_digests(Pieces.of([tuple(r) for r in pieces(groups, BLOCK_DIGITS).collect()]), shards, fetch)  # at most 16 ** BLOCK_DIGITS rows

    number = F.lit(0)
    for i, cut in enumerate(cuts):
        number = F.when(F.col("digest") > cut, i + 1).otherwise(number)
    ranked = ranked.withColumn("shard", number.cast("int"))
    # Rows before each partition, and before each shard: at most partitions x shards numbers.
    part = F.shiftright("place", 33)
    counts = sorted((p, s, c) for p, s, c in ranked.groupBy(part.alias("p"), "shard").agg(F.count(F.lit(1)).alias("c")).collect())
    before: list[tuple[int, int, int]] = []
    seen_of: dict[int, int] = {}
    offset_of: dict[int, int] = {}
    for p, s, c in counts:  # the slot of a row: its place in the partition, less the rows of lower shards in it, plus the shard's rows in earlier partitions
        before.append((p, s, seen_of.get(s, 0) - offset_of.get(p, 0)))
        seen_of[s] = seen_of.get(s, 0) + c
        offset_of[p] = offset_of.get(p, 0) + c
    shifts = spark.createDataFrame(before, "part bigint, shard int, shift bigint")  # as many rows as partitions and shards have in common
    joined = ranked.withColumn("part", part.cast("bigint")).join(F.broadcast(shifts), ["part", "shard"])
    return joined.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "digest",
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, documents(spark, sf_dir)).drop("digest")
