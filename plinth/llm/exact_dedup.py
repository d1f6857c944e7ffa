"""Exact dedup through a minimal perfect hash over the digests of history.

The rows of an earlier load (``history``) are reduced to their distinct digests,
each with its winner.  The digests are dealt into buckets by their leading bits
and every bucket gets a minimal perfect hash of its own: a displacement per small
group of digests sends each digest to a slot of its own, without gaps.  A slot
holds the full digest and the locator of the winner (id, length, rows).  A new
digest is looked up in its bucket and counts as a member only if the bytes in the
slot equal its own; members join the group of the slot, the others are grouped
among themselves.

Rows are aggregated by digest before anything is dealt to buckets, so a group of
copies of any size is one row there.  There are as many buckets as the distinct
digests of history and of the new rows together ask for, so a bucket holds about
BUCKET_KEYS of them however little history there is.

Defined cases: null text counts as empty; all empty texts are one group; a tie in
length goes to the smallest id, null ids lose to all others, and of repeated rows
one stays; repeated rows count as rows of their group; an empty table gives an empty result; columns
other than the id and the text play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, crc32_mod, documents, pieces_of

#: Distinct digests, of history and new, that a bucket holds on average.
BUCKET_KEYS = 4096
#: Digests that share one displacement, on average.
GROUP_KEYS = 4
DIGEST_SCHEMA = "doc_id bigint, row_id bigint, n_points bigint, digest binary, old boolean"
INDEX_SCHEMA = "bucket bigint, n_keys bigint, shifts binary, digests binary, win_ids binary, win_null binary, win_rows binary, win_lens binary, n_rows binary"


def digests(docs: DataFrame, row_id, old) -> DataFrame:
    """One row for each document: id, row number, code points of the original text, sha256 of the text without white space."""
    drop = SPACE.encode()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            text = pc.fill_null(batch.column("text"), "")
            found = [hashlib.sha256(x.translate(None, drop)).digest() for x in text.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_id"), pc.utf8_length(text).cast(pa.int64()), pa.array(found, pa.binary()), batch.column("old")],
                names=["doc_id", "row_id", "n_points", "digest", "old"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_id.alias("row_id"), F.col("text").cast("string").alias("text"), old.alias("old")).mapInArrow(make, DIGEST_SCHEMA)


def winners(rows: DataFrame) -> DataFrame:
    """Winner and number of rows for each digest: most code points, then smallest id (nulls last), then first row."""
    best = F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row_id").alias("d"))
    return rows.groupBy("digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n")).select("digest", (-F.col("best.a")).alias("win_len"), F.col("best.c").alias("win_id"), F.col("best.d").alias("win_row"), "n")


def bucket_of(digest, n_buckets: int):
    """The bucket of a digest: its first 60 bits modulo the number of buckets."""
    return F.pmod(F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("bigint"), F.lit(n_buckets))


def _parts(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each digest (rows of 32 bytes): its group, and two words that its slots are made of."""
    words = np.ascontiguousarray(keys).view(">u8").astype(np.uint64)
    groups = max(1, -(-n // GROUP_KEYS))
    return (words[:, 1] % np.uint64(groups)).astype(np.int64), words[:, 2], words[:, 3] | np.uint64(1)


def build_slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The displacement of each group and the slot of each of the distinct 32-byte ``keys``: a bijection to 0..n-1."""
    n = len(keys)
    group, first, second = _parts(keys, n)
    shifts = np.zeros(max(1, -(-n // GROUP_KEYS)), dtype=np.uint64)
    slots = np.full(n, -1, dtype=np.int64)
    taken = np.zeros(n, dtype=bool)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(len(shifts) + 1))
    for g in np.argsort(-np.diff(starts), kind="stable"):  # large groups first, while there is room
        own = order[starts[g] : starts[g + 1]]
        if not len(own):
            break
        tried = np.uint64(0)
        while True:
            ways = np.arange(tried, tried + np.uint64(64), dtype=np.uint64)
            mix = first[own][:, None] + ways[None, :] * second[own][:, None]
            at = ((mix ^ (mix >> np.uint64(32))) % np.uint64(n)).astype(np.int64)
            free = ~taken[at].any(axis=0)
            if len(own) > 1:
                there = np.sort(at, axis=0)
                free &= (there[1:] != there[:-1]).all(axis=0)
            good = np.flatnonzero(free)
            if len(good):
                shifts[g] = ways[good[0]]
                slots[own] = at[:, good[0]]
                taken[slots[own]] = True
                break
            tried += np.uint64(64)
    return shifts, slots


def find_slots(keys: np.ndarray, shifts: np.ndarray, n: int) -> np.ndarray:
    """The one slot in which each key could be."""
    group, first, second = _parts(keys, n)
    mix = first + shifts[group] * second
    return ((mix ^ (mix >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 32)


def build_index(history: DataFrame, n_buckets: int) -> DataFrame:
    """The index of ``history`` (rows of :func:`winners`): one row, with its slots, for each bucket."""

    def make(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys = _keys(table.column("digest"))
        shifts, slots = build_slots(keys)
        at = np.argsort(slots)
        ids = table.column("win_id").take(pa.array(at)).combine_chunks()
        put = lambda name: np.asarray(table.column(name).take(pa.array(at)), dtype=np.int64).tobytes()
        row = {
            "bucket": table.column("bucket")[0].as_py(), "n_keys": len(keys), "shifts": shifts.tobytes(), "digests": keys[at].tobytes(),
            "win_ids": np.asarray(pc.fill_null(ids, 0), dtype=np.int64).tobytes(), "win_null": np.asarray(pc.is_null(ids)).astype(np.uint8).tobytes(),
            "win_rows": put("win_row"), "win_lens": put("win_len"), "n_rows": put("n"),
        }
        return pa.table({k: pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for k, v in row.items()})

    return history.withColumn("bucket", bucket_of(F.col("digest"), n_buckets)).groupBy("bucket").applyInArrow(make, INDEX_SCHEMA)


FOUND_SCHEMA = "digest binary, win_id bigint, win_row bigint, win_len bigint, n bigint, member boolean"


def look_up(fresh: DataFrame, index: DataFrame, n_buckets: int) -> DataFrame:
    """Groups after ``fresh`` (rows of :func:`winners`) met the index.

    Each digest of either side comes once: members with the better of both winners and the rows of
    both, nonmembers with their own, slots that nothing met as they are.
    """

    def meet(new: pa.Table, old: pa.Table) -> pa.Table:
        new = new.combine_chunks()
        keys = _keys(new.column("digest")) if new.num_rows else np.zeros((0, 32), np.uint8)
        out_digest, out_id, out_row, out_len, out_n, out_member = [], [], [], [], [], []
        new_row = new.column("win_row").to_pylist() if new.num_rows else []
        new_id = new.column("win_id").to_pylist() if new.num_rows else []
        new_len = new.column("win_len").to_pylist() if new.num_rows else []
        new_n = new.column("n").to_pylist() if new.num_rows else []
        hit_of: dict[int, int] = {}
        if old.num_rows:
            row = {k: v[0] for k, v in old.to_pydict().items()}
            n = row["n_keys"]
            slots = np.frombuffer(row["digests"], dtype=np.uint8).reshape(n, 32)
            ids, lines, lens, rows = (np.frombuffer(row[k], dtype=np.int64) for k in ("win_ids", "win_rows", "win_lens", "n_rows"))
            null = np.frombuffer(row["win_null"], dtype=np.uint8)
            if len(keys):
                at = find_slots(keys, np.frombuffer(row["shifts"], dtype=np.uint64), n)
                same = (slots[at] == keys).all(axis=1)  # byte by byte: a perfect hash sends strangers to slots too
                hit_of = {int(at[i]): int(i) for i in np.flatnonzero(same)}
            for s in range(n):
                one = (-int(lens[s]), bool(null[s]), int(ids[s]), int(lines[s]))
                total, i = int(rows[s]), hit_of.get(s)
                if i is not None:
                    other = (-new_len[i], new_id[i] is None, new_id[i] or 0, new_row[i])
                    one, total = min(one, other), total + new_n[i]
                out_digest.append(slots[s].tobytes())
                out_len.append(-one[0])
                out_id.append(None if one[1] else one[2])
                out_row.append(one[3])
                out_n.append(total)
                out_member.append(i is not None)
        met = set(hit_of.values())
        for i in range(len(keys)):
            if i not in met:
                out_digest.append(keys[i].tobytes())
                out_len.append(new_len[i])
                out_id.append(new_id[i])
                out_row.append(new_row[i])
                out_n.append(new_n[i])
                out_member.append(False)
        return pa.table(
            {"digest": pa.array(out_digest, pa.binary()), "win_id": pa.array(out_id, pa.int64()), "win_row": pa.array(out_row, pa.int64()), "win_len": pa.array(out_len, pa.int64()), "n": pa.array(out_n, pa.int64()), "member": pa.array(out_member, pa.bool_())}
        )

    left = fresh.withColumn("bucket", bucket_of(F.col("digest"), n_buckets))
    return left.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(meet, FOUND_SCHEMA)


def exact_dedup(spark: SparkSession, docs: DataFrame, is_history=None, row_id: str | None = None) -> DataFrame:
    """Group equal texts; one row for each row of ``docs``.

    ``row_id`` names a column that numbers the rows; without it they are numbered here.

    ``is_history`` tells which rows the index is built from (by default those whose id has an even
    crc32); the others are looked up in it.  The result does not depend on it.
    """
    scratch = Scratch(spark, "exact-dedup")
    old = (crc32_mod("doc_id", 2) == 0) if is_history is None else is_history
    number = F.monotonically_increasing_id() if row_id is None else F.col(row_id)
    rows = scratch.write(digests(docs, number, old), "digests")
    history = scratch.keep(winners(rows.where("old")))
    fresh = scratch.keep(winners(rows.where("not old")))
    n_buckets = max(1, -(-(history.count() + fresh.count()) // BUCKET_KEYS))
    index = build_index(history, n_buckets)
    groups = scratch.keep(look_up(fresh, index, n_buckets))
    # A hot group is one row of the right side; the left side is split by the adaptive skew join.
    joined = rows.join(groups.hint("merge"), "digest")
    return joined.select(
        "doc_id",
        F.col("win_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row_id") == F.col("win_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *([] if row_id is None else [F.col("row_id").alias(row_id)]),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, documents(spark, sf_dir))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS pts, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY pts DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS c FROM n
)
SELECT doc_id, keep_id, CAST(c AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
"""
