r"""Line dedup with two Bloom filters.

Every task sends the 64-bit hashes of its distinct line keys, counted up to MIN_DOCS, to
ranges of the hash space that hold about RANGE_KEYS of them.  Each range goes through a pair
of Bloom filters: hashes met once, and hashes met twice.  What is in both when it comes again
has been met MIN_DOCS times, or looks like it, and is suspected.  There are as many
ranges as the number of hashes asks for, so a filter has a fixed size, none is global and
none fills up as the input grows.  Only the lines whose hash is suspected go on: their keys
are shuffled, pre-aggregated, and confirmed on their full bytes with their number of
documents and the largest id.  Documents without a suspected line are finished before.

The suspected hashes are broadcast while they number BROADCAST_HASHES at most; beyond that
each document's hashes are joined with them.

Defined cases: a null or empty text is one empty line; a null id holds lines like
any other but is never the largest unless all ids are null (then those rows keep
their lines); rows that share an id are documents of their own, and lines stay in
all rows with the largest id; an empty table gives an empty result; other columns
play no part.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, documents, mixed, pieces_of, string_hashes, unique_words

MIN_POINTS = 20
MIN_DOCS = 3
#: Hashes of a range, about, and the bits of each of its two filters.
RANGE_KEYS, RANGE_BITS = 1 << 18, 1 << 22
#: Hash functions of the filters.
PROBES = 4
#: Suspected hashes (of 8 bytes) that are broadcast at most.
BROADCAST_HASHES = 1 << 21
#: Hashes that a task holds before it sends them.
HELD = 1 << 20


def probes(hashes: np.ndarray) -> np.ndarray:
    """The PROBES bit positions of each hash."""
    step = mixed(hashes) | np.uint64(1)
    return np.stack([mixed(hashes + np.uint64(i) * step) & np.uint64(RANGE_BITS - 1) for i in range(1, PROBES + 1)])


class Filter:
    """A Bloom filter of RANGE_BITS bits."""

    def __init__(self) -> None:
        self.bits = np.zeros(RANGE_BITS, dtype=bool)

    def holds(self, where: np.ndarray) -> np.ndarray:
        return self.bits[where].all(axis=0)

    def put(self, where: np.ndarray) -> None:
        self.bits[where] = True


def lines_of(text: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """The lines of all texts, the offsets of each text in them, and the keys of the lines."""
    lists = pc.split_pattern(pc.fill_null(text, ""), "\n")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    lines = lists.flatten()
    return lines, offsets - offsets[0], pc.ascii_lower(pc.ascii_trim(lines, characters=SPACE))


def long_keys(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Lines, offsets, and for the lines with long keys: their indexes, the distinct keys, the key of each."""
    lines, offsets, keys = lines_of(text)
    at = np.flatnonzero(np.asarray(pc.greater_equal(pc.utf8_length(keys), MIN_POINTS)))
    distinct, code = unique_words(keys.take(pa.array(at)))
    return lines, offsets, at, distinct, code


def by_document(at: np.ndarray, code: np.ndarray, offsets: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, key) pairs of the long lines."""
    doc = np.searchsorted(offsets, at, side="right") - 1
    pair = np.unique(doc * max(1, n_keys) + code)
    return pair // max(1, n_keys), pair % max(1, n_keys)


def prints(docs: DataFrame) -> DataFrame:
    """(hash, n): the hashes of the long keys of each task, with their documents counted up to MIN_DOCS."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            distinct, code = np.unique(np.concatenate(held), return_inverse=True)
            n = np.minimum(np.bincount(code, np.concatenate(counts)), MIN_DOCS).astype(np.int32)
            held.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(n)], names=["hash", "n"])

        for batch in pieces_of(batches):
            _, offsets, at, distinct, code = long_keys(batch.column("text"))
            if len(at):
                _, key = by_document(at, code, offsets, len(distinct))
                held.append(string_hashes(distinct))
                counts.append(np.bincount(key, minlength=len(distinct)))
            if sum(map(len, held)) > HELD:
                yield flush()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(make, "hash bigint, n int")


def suspected(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(hash) of all keys that MIN_DOCS documents hold, and of few others."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None
        for batch in batches:
            range_, hashes, n = (np.asarray(batch.column(k)) for k in ("range", "hash", "n"))
            for start, stop in itertools.pairwise([0, *(np.flatnonzero(range_[1:] != range_[:-1]) + 1).tolist(), len(range_)] if len(range_) else []):
                if range_[start] != at:
                    at, once, twice = range_[start], Filter(), Filter()
                own, code = np.unique(hashes[start:stop].view(np.uint64), return_inverse=True)
                met = np.bincount(code, n[start:stop]).astype(np.int64)
                where = probes(own)
                before = once.holds(where)
                again = met + before
                hit = again + twice.holds(where) >= MIN_DOCS
                once.put(where)
                twice.put(where[:, again > 1])
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(own[hit].view(np.int64))], names=["hash"])

    found = scratch.keep(prints(docs))
    ranges = max(1, -(-found.count() // RANGE_KEYS))
    dealt = found.select(F.pmod(F.xxhash64("hash"), F.lit(ranges)).alias("range"), "hash", "n").repartition("range").sortWithinPartitions("range")
    return scratch.keep(dealt.mapInArrow(sift, "hash bigint").distinct())


def _with_suspects(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """``docs`` with the suspected hashes of each document's long keys; equal rows have equal ones."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            _, offsets, at, distinct, code = long_keys(batch.column("text"))
            if len(at):
                doc, key = by_document(at, code, offsets, len(distinct))
                yield pa.RecordBatch.from_arrays([batch.column("row_key").take(pa.array(doc)), pa.array(string_hashes(distinct).view(np.int64)[key])], names=["row_key", "hash"])

    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    # A hot hash is one row of the right side; its documents on the left are split by the adaptive skew join.
    found = keyed.select("row_key", "text").mapInArrow(make, "row_key bigint, hash bigint").distinct().join(hashes.hint("merge"), "hash")
    found = found.groupBy("row_key").agg(F.collect_list("hash").alias("suspects"))
    return keyed.join(found.hint("merge"), "row_key", "left").select("doc_id", "text", F.coalesce("suspects", F.array().cast("array<bigint>")).alias("suspects"))


def dedup_lines(spark: SparkSession, docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Drop the repeated lines of ``docs``: doc_id, n_lines, n_dropped, kept_sha256, and with ``with_text`` the text that stays."""
    scratch = Scratch(spark, "line-dedup")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashes = suspected(scratch, docs)
    small = hashes.count() <= BROADCAST_HASHES
    if small:
        known = np.sort(np.array([r[0] for r in hashes.toLocalIterator()], dtype=np.int64))  # at most BROADCAST_HASHES numbers
        shared = spark.sparkContext.broadcast(known)
    else:
        docs = _with_suspects(docs, hashes)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without a suspect are finished; the others name their suspected keys."""
        for batch in pieces_of(batches):
            text = pc.fill_null(batch.column("text"), "")
            _, offsets, at, distinct, code = long_keys(text)
            own: dict[int, list] = {}
            if len(at):
                found = string_hashes(distinct).view(np.int64)
                some = shared.value if small else np.unique(np.asarray(batch.column("suspects").flatten(), dtype=np.int64))
                hit = np.isin(found, some)
                doc, key = by_document(at, code, offsets, len(distinct))
                some = hit[key]
                names = distinct.cast(pa.binary()).to_pylist() if hit.any() else []
                for d, k in zip(doc[some].tolist(), key[some].tolist(), strict=True):
                    own.setdefault(d, []).append(names[k])
            n = len(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([None if i in own else hashlib.sha256(x).hexdigest() for i, x in enumerate(text.cast(pa.binary()).to_pylist())], pa.string()),
                    pa.array([text[i].as_py() if with_text or i in own else None for i in range(n)], pa.string()),
                    pa.array([own.get(i) for i in range(n)], pa.list_(pa.binary())),
                ],
                names=["doc_id", "n_lines", "kept_sha256", "text", "keys"],
            )

    rows = docs.mapInArrow(finish, "doc_id bigint, n_lines bigint, kept_sha256 string, text string, keys array<binary>")
    rows = scratch.write(rows.withColumn("row_id", F.monotonically_increasing_id()), "rows")
    asked = rows.where(F.col("keys").isNotNull()).select("row_id", "doc_id", F.explode("keys").alias("key"))
    counted = asked.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    # Kept as a table, since only a join of two plain exchanges can be split by the adaptive engine.
    repeated = scratch.keep(counted.where((F.col("n") >= MIN_DOCS) & F.col("last").isNotNull()).drop("n"))
    # A hot key is one row of the right side; its documents on the left are split by the adaptive skew join.
    gone = asked.join(repeated.hint("merge"), "key").where(~F.col("doc_id").eqNullSafe(F.col("last"))).select("row_id", "key")
    gone = gone.groupBy("row_id").agg(F.collect_list("key").alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            lines, offsets, names = lines_of(batch.column("text"))
            lines, names, drops = lines.cast(pa.binary()).to_pylist(), names.cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist()
            kept, dropped = [], []
            for i, drop in enumerate(drops):
                a, b = offsets[i], offsets[i + 1]
                drop = set(drop or ())
                stay = [x for x, k in zip(lines[a:b], names[a:b], strict=True) if k not in drop]
                kept.append(b"\n".join(stay))
                dropped.append(int(b - a) - len(stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_lines"), pa.array(dropped, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array([x.decode() if with_text else None for x in kept], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"],
            )

    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, kept_text string"
    done = rows.where(F.col("keys").isNull()).select("doc_id", "n_lines", F.lit(0).cast("bigint").alias("n_dropped"), "kept_sha256", F.col("text").alias("kept_text"))
    open_rows = rows.where(F.col("keys").isNotNull()).select("row_id", "doc_id", "n_lines", "text").join(gone.hint("merge"), "row_id", "left")
    out = done.unionByName(open_rows.select("doc_id", "n_lines", "text", "gone").mapInArrow(cut, schema))
    return out if with_text else out.drop("kept_text")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark, documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l
), r AS (
  SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.line, k.i, r.k IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r ON k.k = r.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
