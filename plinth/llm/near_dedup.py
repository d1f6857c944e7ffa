r"""Near-duplicate detection with MinHash.

A document's set are its distinct WORDS-word shingles.  HASHES minima of universal
hash functions form its signature; BANDS bands of ROWS minima are its bucket keys.
Documents that share a bucket are candidates, candidates whose signatures agree
well enough are verified on their full sets, and the verified links are closed to
connected components.

A pair with a similarity of just 0.75 misses all 47 bands of 6 with a chance of
1e-4 (at 0.8: 6e-7); its signatures are let through from SIGNATURE_FLOOR on, five
standard deviations below 0.75.

No group is ever expanded into all its pairs:

* documents with equal sets are one node from the start;
* in each bucket every node is compared with the bucket's least node alone; the
  links found this way are closed to first components;
* buckets whose nodes still lie in several components are compared further: there
  the signatures are dealt to tasks in large blocks, and each task compares two blocks in
  memory, leaving out what is one component already; the full sets of those that agree
  with another follow in smaller blocks, only where two of these hold an agreeing pair,
  and only links that join two components are given out.

So every pair of every bucket is either connected already or has been compared, and
a large group of near copies costs one comparison for each member.

Full sets are made again from the text, and only for the nodes in a candidate pair,
which a bitmap of bounded size names.

Defined cases: null, empty and wordless texts have the empty set and are linked with
nothing; fewer than WORDS words are one shingle; repeated rows have equal sets and are
linked; null ids are passed over for the smallest id, and a component without any id
has a null component_id and keeps its first row; an empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, mixed, pieces_of, string_hashes, unique_words, words_of
from .components import components

WORDS = 5
#: A pair is linked from NUMERATOR / 100 on.
NUMERATOR = 75
BANDS, ROWS = 47, 6
HASHES = BANDS * ROWS
#: Agreement of two signatures from which a pair is verified.
SIGNATURE_FLOOR = 0.62
#: Nodes of a bucket whose signatures a task compares with those of as many others at once.
MARK_BLOCK = 4096
#: Nodes of a bucket whose full sets a task compares with those of as many others at once.
BLOCK = 512
#: Shingles of the nodes in a block of full sets, about.
BLOCK_SHINGLES = 250_000
#: Bits of the bitmap that names the nodes to be verified, at most (32 MiB).
MAX_BITS = 1 << 28


def _constants(seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingles(text: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    words, offsets = words_of(text)
    distinct, code = unique_words(words)
    names = mixed(string_hashes(distinct))[code] if len(code) else np.zeros(0, np.uint64)
    n = len(names)
    whole = np.zeros(max(0, n - WORDS + 1), dtype=np.uint64)
    for j in range(WORDS):
        whole = whole * np.uint64(0x9E3779B97F4A7C15) + names[j : j + len(whole)]
    whole = mixed(whole)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(whole[a : b - WORDS + 1]))
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for x in range(a, b):
                short = mixed(short * np.uint64(0xD1342543DE82EF95) + names[x : x + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def minima(found: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The least value of each hash function a * x + b (mod 2^32) over the set; ``room`` is scratch space."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), np.uint32(0xFFFFFFFF))
    for start in range(0, len(x), room.shape[1]):
        part = x[start : start + room.shape[1]]
        at = room[:, : len(part)]
        np.multiply(a[:, None], part[None, :], out=at)
        at += b[:, None]
        np.minimum(least, at.min(axis=1), out=least)
    return least


def signature(least: np.ndarray) -> bytes:
    """One byte of each minimum."""
    x = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (x >> np.uint32(24)).astype(np.uint8).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, different for different bands."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of signatures (last axis: bytes), less what equal bytes of different minima add."""
    same = (x == y).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


ROW_SCHEMA = "doc_id bigint, row_id bigint, n_shingles bigint, key binary, set_hash binary, signature binary, bands array<bigint>"


def sketch(docs: DataFrame) -> DataFrame:
    """One row for each document: set size, hash of the set, signature and band keys."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _constants()
        room = np.empty((HASHES, 1024), dtype=np.uint32)
        for batch in pieces_of(batches):
            sizes, hashes, signatures, bands = [], [], [], []
            keys = [None if x is None else _text_key(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            for found in shingles(batch.column("text")):
                sizes.append(len(found))
                if not len(found):
                    hashes.append(None)
                    signatures.append(None)
                    bands.append(None)
                    continue
                least = minima(found, a, b, room)
                hashes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                signatures.append(signature(least))
                bands.append(band_keys(least).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(hashes, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "row_id", "n_shingles", "key", "set_hash", "signature", "bands"],
            )

    return docs.mapInArrow(make, ROW_SCHEMA)


def _agreeing(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, sa, sb) whose signatures agree well enough, as (a, b)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in ("sa", "sb"))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(agreement(x, y) >= SIGNATURE_FLOOR))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(make, "a bigint, b bigint")


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[list]]]:
    """(cell, columns) of each run of equal ``cell``; the batches come sorted by it."""
    held: list[list] = [[] for _ in columns]
    at = None
    for batch in batches:
        for cell, *row in zip(*(batch.column(k).to_pylist() for k in ("cell", *columns)), strict=True):
            if cell != at:
                if at is not None and len(held[0]) > 1:
                    yield at, held
                held, at = [[] for _ in columns], cell
            for to, x in zip(held, row, strict=True):
                to.append(x)
    if at is not None and len(held[0]) > 1:
        yield at, held


def _partners(i: int, side: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Who row ``i`` of a cell is compared with.

    Rows of side 0 are compared with each other and with those of side 1, rows of side 1 not among
    themselves, rows of side 2 with those of side 1 alone; each pair once, and none of one component.
    """
    return np.flatnonzero((root != root[i]) & ((side != side[i]) | ((side == 0) & (np.arange(len(side)) > i))) & ((side[i] + side) != 2))


def _open_rows(rows: DataFrame) -> DataFrame:
    """What the full sets must be compared for: (lo, hi, side, node, root, band).

    ``rows``: (cell, side, node, root, band, block, signature); a node of the lead's component has a
    negative ``block``.  A node is given out once for each block, named by lo and hi together with its
    own, that holds a partner whose signature agrees.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (side, node, root, band, block, signatures) in _groups(batches, ("side", "node", "root", "band", "block", "signature")):
            sides, roots, nodes, bands = np.array(side), np.array(root, dtype=np.int64), np.array(node, dtype=np.int64), np.array(band, dtype=np.int64)
            marks = np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, HASHES)
            names, own = np.unique(np.array(block, dtype=np.int32), return_inverse=True)
            hit = np.zeros((len(side), len(names)), dtype=bool)
            for i in np.flatnonzero(sides != 1):
                other = _partners(i, sides, roots)
                good = other[agreement(marks[other], marks[i]) >= SIGNATURE_FLOOR] if len(other) else other
                hit[i, own[good]] = True
                hit[good, own[i]] = True
            at, partner = np.nonzero(hit)
            if len(at):
                mine, theirs = names[own[at]], names[partner]
                # Of two blocks, the greater is side 1; but the lead's component always is.
                as_ = np.where(mine == theirs, 0, np.where((mine < 0) | ((theirs >= 0) & (mine > theirs)), 1, 2)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(mine, theirs), np.maximum(mine, theirs), as_, nodes[at], roots[at], bands[at])], names=["lo", "hi", "side", "node", "root", "band"])

    return rows.select("cell", "side", "node", "root", "band", "block", "signature").mapInArrow(make, "lo int, hi int, side int, node bigint, root bigint, band bigint")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets (sorted distinct hashes) are linked."""
    if 100 * min(len(x), len(y)) < NUMERATOR * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= NUMERATOR * (len(x) + len(y) - both)


def _links_in_cells(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join the components within each cell, verified on the full sets: a spanning forest of all of its links.

    ``rows``: those of :func:`_open_rows` with signature, bands and shingles.  A pair that shares
    several buckets is looked at in the first of them alone.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (side, node, root, band, signatures, bands, sets) in _groups(batches, ("side", "node", "root", "band", "signature", "bands", "shingles")):
            sides, keys = np.array(side), np.array(bands, dtype=np.int64)
            _, roots = np.unique(np.array(root, dtype=np.int64), return_inverse=True)
            marks = np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, HASHES)
            found = [np.frombuffer(x, np.uint64) for x in sets]
            left, right = [], []
            for i in np.flatnonzero(sides != 1):
                other = _partners(i, sides, roots)
                other = other[(keys[i] == keys[other]).argmax(axis=1) == int(np.flatnonzero(keys[i] == band[i])[0])] if len(other) else other
                score = agreement(marks[other], marks[i]) if len(other) else np.zeros(0)
                for j in other[np.argsort(-score, kind="stable")][: int((score >= SIGNATURE_FLOOR).sum())].tolist():
                    if roots[j] != roots[i] and similar(found[i], found[j]):
                        left.append(min(node[i], node[j]))
                        right.append(max(node[i], node[j]))
                        roots[roots == roots[j]] = roots[i]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.select("cell", "side", "node", "root", "band", "signature", "bands", "shingles").mapInArrow(make, "a bigint, b bigint")


def _slot(key: bytes, bits: int) -> int:
    return int.from_bytes(key[:7], "big") & (bits - 1)


def _bitmap(asked: DataFrame, bits: int) -> np.ndarray:
    """A bitmap with the slots of the keys in ``asked``: bits / 8 bytes, made in blocks of 8 KiB."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bitmap = None, np.zeros(1 << 16, dtype=bool)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(bitmap).tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for block, slot in zip(batch.column("block").to_pylist(), batch.column("slot").to_pylist(), strict=True):
                if block != at:
                    if at is not None:
                        yield row()
                    at, bitmap[:] = block, False
                bitmap[slot] = True
        if at is not None:
            yield row()

    slots = asked.select(F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("bigint").bitwiseAND(F.lit(bits - 1)).alias("slot")).distinct()
    blocks = slots.select(F.shiftright("slot", 16).alias("block"), F.col("slot").bitwiseAND(F.lit(65535)).cast("int").alias("slot")).repartition("block").sortWithinPartitions("block")
    whole = np.zeros(bits // 8, dtype=np.uint8)
    for block, found in blocks.mapInArrow(make, "block bigint, bits binary").toLocalIterator():
        whole[block * 8192 : (block + 1) * 8192] = np.frombuffer(found, np.uint8)
    return whole


def _text_key(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _sets(scratch: Scratch, docs: DataFrame, asked: DataFrame, count: int) -> DataFrame:
    """(key, shingles) of the texts named by ``asked`` (key; about ``count`` rows), and of some more."""
    bits = 1 << 16
    while bits < MAX_BITS and bits < 32 * count:
        bits *= 2
    bitmap = scratch.spark.sparkContext.broadcast(_bitmap(asked, bits))  # MAX_BITS / 8 bytes at most

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for batch in pieces_of(batches):
            text = batch.column("text")
            names = [None if x is None else _text_key(x) for x in text.cast(pa.binary()).to_pylist()]
            hit = []
            for i, x in enumerate(names):
                if x is not None and x not in given:
                    at = _slot(x, bits)
                    if bitmap.value[at >> 3] >> (7 - (at & 7)) & 1:
                        hit.append(i)
                        given.add(x)
            if len(given) > 200_000:
                given.clear()
            if hit:
                found = [x.tobytes() for x in shingles(text.take(pa.array(hit)))]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in hit], pa.binary()), pa.array(found, pa.binary())], names=["key", "shingles"])

    return scratch.keep(docs.select("text").mapInArrow(sets, "key binary, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles")))


def _verified(scratch: Scratch, docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are linked by their full sets."""
    count = pairs.count()
    if not count:
        return pairs
    keys = nodes.select("node", "key")
    whole = _sets(scratch, docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(keys, "node"), count)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    # A node with many pairs is one row of the right side in both joins; its pairs on the left are split.
    named = pairs.join(keys.withColumnsRenamed({"node": "b", "key": "kb"}).hint("merge"), "b").join(whole.withColumnsRenamed({"key": "kb", "shingles": "y"}).hint("merge"), "kb").drop("kb")
    named = named.join(keys.withColumnsRenamed({"node": "a", "key": "ka"}).hint("merge"), "a").join(whole.withColumnsRenamed({"key": "ka", "shingles": "x"}).hint("merge"), "ka")
    return named.select("a", "b", "x", "y").mapInArrow(linked, "a bigint, b bigint")


def _rest(scratch: Scratch, docs: DataFrame, members: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join the components within the buckets whose nodes lie in several of them.

    In each bucket the component of the least node is ``near``, the nodes of all others are ``far``.
    Both are dealt into blocks of about BLOCK nodes, and runs of blocks make large ones of about
    MARK_BLOCK; a cell holds the signatures of a large block of far nodes and of one of either kind.
    Pairs of blocks with agreeing signatures are cells again, with the full sets, and only there
    are nodes compared exactly.
    """
    known = members.select("band", "node").join(roots.hint("merge"), "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    known = scratch.keep(known)
    buckets = known.groupBy("band").agg(F.min(F.struct("node", "root")).alias("lead"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("band", F.col("lead.root").alias("near"))
    buckets = scratch.keep(buckets)
    open_ = known.join(buckets.hint("merge"), "band")
    is_near = F.col("root") == F.col("near")
    open_ = open_.join(nodes.select("node", "n_shingles").hint("merge"), "node")
    blocks = lambda on: F.ceil(F.sum(F.when(on, F.greatest(F.lit(1.0 / BLOCK), F.col("n_shingles") / BLOCK_SHINGLES)).otherwise(0.0))).cast("int")
    large = lambda on: F.ceil(F.count(F.when(on, 1)) / MARK_BLOCK).cast("int")
    sizes = open_.groupBy("band").agg(blocks(is_near).alias("kp"), blocks(~is_near).alias("ko"), large(is_near).alias("lp"), large(~is_near).alias("lo"))
    sizes = scratch.keep(sizes)
    dealt = open_.join(sizes.hint("merge"), "band")
    block = F.pmod(F.xxhash64("node", "band"), F.when(is_near, F.col("kp")).otherwise(F.col("ko"))).cast("int")
    dealt = dealt.withColumn("block", block)
    run = F.when(is_near, F.floor(F.col("block").cast("bigint") * F.col("lp") / F.col("kp"))).otherwise(F.floor(F.col("block").cast("bigint") * F.col("lo") / F.col("ko")))
    dealt = dealt.withColumn("run", run.cast("int"))

    def cell(kind, i, j, side):
        return F.struct(F.xxhash64("band", F.lit(kind), i, j).alias("cell"), side.cast("int").alias("side"))

    near_cells = F.transform(F.sequence(F.lit(0), F.col("lo") - 1), lambda i: cell(0, i, F.col("run"), F.lit(1)))
    with_near = F.transform(F.sequence(F.lit(0), F.col("lp") - 1), lambda j: cell(0, F.col("run"), j, F.when(j == 0, 0).otherwise(2)))
    others = F.filter(F.sequence(F.lit(0), F.col("lo") - 1), lambda j: j != F.col("run"))
    with_far = F.transform(others, lambda j: cell(1, F.least(j, F.col("run")), F.greatest(j, F.col("run")), F.when(j > F.col("run"), 2).otherwise(1)))
    signed = F.when(is_near, -1 - F.col("block")).otherwise(F.col("block"))
    cells = dealt.select("node", "root", "band", signed.alias("block"), F.explode(F.when(is_near, near_cells).otherwise(F.concat(with_near, with_far))).alias("c")).select("node", "root", "band", "block", "c.cell", "c.side")
    marked = cells.join(nodes.select("node", "signature").hint("merge"), "node")
    rows = scratch.write_small(_open_rows(marked.repartition("cell").sortWithinPartitions("cell")), "open-rows")
    count = rows.count()
    if not count:
        return rows.select(F.col("node").alias("a"), F.col("node").alias("b"))
    rows = rows.select(F.xxhash64("band", "lo", "hi").alias("cell"), "side", "node", "root", "band")
    keyed = rows.join(nodes.select("node", "key", "signature", "bands").hint("merge"), "node")
    whole = _sets(scratch, docs, keyed.select("key").distinct(), count)
    full = keyed.join(whole.hint("merge"), "key")
    return _links_in_cells(full.repartition("cell").sortWithinPartitions("cell"))


def near_dedup(spark: SparkSession, docs: DataFrame, row_id: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept, first_row.

    ``kept``: the id is the component's smallest.  ``first_row``: this row alone stays of its
    component (they differ where rows share an id).  ``row_id`` names a column that numbers the rows.
    """
    scratch = Scratch(spark, "near-dedup")
    number = F.monotonically_increasing_id() if row_id is None else F.col(row_id)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), number.alias("row_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.write(sketch(docs), "rows")
    own = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row_id").alias("c"))
    nodes = (
        rows.where(F.col("set_hash").isNotNull())
        .groupBy("set_hash")
        .agg(F.min(F.struct("row_id", "key")).alias("one"), F.min(own).alias("best"), F.first("signature").alias("signature"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"))
        .select("set_hash", F.col("one.row_id").alias("node"), F.col("one.key").alias("key"), "best", "signature", "bands", "n_shingles")
    )
    nodes = scratch.keep(nodes)

    in_bands = nodes.select("node", F.explode("bands").alias("band"))
    # Kept as a table, here and below: only a join of two plain exchanges can be split by the adaptive engine.
    leads = scratch.keep(in_bands.groupBy("band").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "lead"))
    members = scratch.write_small(in_bands.join(leads.hint("merge"), "band"), "members")
    stars = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    marks = nodes.select("node", "signature")
    stars = stars.join(marks.withColumnsRenamed({"node": "b", "signature": "sb"}).hint("merge"), "b").join(marks.withColumnsRenamed({"node": "a", "signature": "sa"}).hint("merge"), "a")
    first = scratch.write_small(_agreeing(stars), "first-pairs")
    roots = components(scratch, _verified(scratch, docs, nodes, first), "first")

    more = _rest(scratch, docs, members, roots, nodes)
    at = roots.withColumnsRenamed({"node": "a", "root": "ra"})
    bt = roots.withColumnsRenamed({"node": "b", "root": "rb"})
    merged = more.join(at, "a", "left").join(bt, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = components(scratch, merged, "second").select(F.col("root").alias("top"), F.col("node").alias("root"))
    where = nodes.select("set_hash", "node", "best").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(joined, "root", "left").withColumn("top", F.coalesce("top", "root"))
    where = scratch.write_small(where.select("set_hash", "top", "best"), "where")
    best = scratch.keep(where.groupBy("top").agg(F.min("best").alias("win")))
    # Nodes of a large component on the left are split; so are the copies of one set in the next join.
    of_set = where.select("set_hash", "top").join(best.hint("merge"), "top").select("set_hash", "win")
    full = rows.where(F.col("set_hash").isNotNull()).select("set_hash", "doc_id", "row_id", "n_shingles").join(of_set.hint("merge"), "set_hash")
    full = full.select("doc_id", "n_shingles", F.col("win.b").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("win.b")).alias("kept"), (F.col("row_id") == F.col("win.c")).alias("first_row"), "row_id")
    none = rows.where(F.col("set_hash").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("first_row"), "row_id")
    out = full.unionByName(none)
    return out.drop("row_id") if row_id is None else out.withColumnRenamed("row_id", row_id)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark, documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), u AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a
), c AS (
  SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x
)
SELECT c.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
