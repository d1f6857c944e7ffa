"""Helpers shared by the training-data operators: scratch tables, batches, tokens.

Tables that must not be computed twice (they number rows, or end a round of a loop)
are written as Parquet under the folder that the session names in
``spark.checkpoint.dir`` (a folder that every executor can reach), which cuts their
lineage.  Where the setting is missing a temporary folder is made and kept for the
session if the master is local (unit tests); on a cluster that is an error, since
executors don't share local folders.  Other tables that are read more than once are
persisted on the executors' disks; what a lost executor held is computed again from
its lineage, which is short.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: The characters of ``[\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"
#: Rows in one Arrow batch sent to Python; with BATCH_BYTES it bounds a worker's memory.
BATCH_ROWS = 512
#: Bytes of text that a worker handles at once.
BATCH_BYTES = 4 << 20

_own_folder: dict[str, str] = {}
_kept: list[DataFrame] = []
_folders: list[Scratch] = []


def release() -> None:
    """Drop what the operators keep on disk; results that aren't computed yet then compute it again."""
    while _kept:
        df = _kept.pop()
        context = df.sparkSession.sparkContext
        if context._jsc is not None and not context._jsc.sc().isStopped():
            df.unpersist()


def discard() -> None:
    """Delete all scratch tables written so far; only for callers who have read, or written, what was made from them."""
    while _folders:
        _folders.pop().drop()


def shared_folder(spark: SparkSession) -> str:
    """The folder for scratch tables: ``spark.checkpoint.dir``, or one of our own where it is unset."""
    try:
        folder = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # the setting has no default, so an unset one raises
        folder = None
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="plinth-")
    return _own_folder[app]


class Scratch:
    """Tables of one operator call, each in a folder of its own below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/plinth/{name}-{uuid.uuid4().hex}"
        _folders.append(self)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a reader of what was written; this cuts the lineage."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_small(self, df: DataFrame, name: str) -> DataFrame:
        """:meth:`write` for a table with few bytes in each partition: an eighth of the files."""
        return self.write(df.coalesce(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)), name)

    def keep(self, df: DataFrame) -> DataFrame:
        """Persist ``df`` on disk until :func:`release`."""
        _kept.append(df.persist(StorageLevel.DISK_ONLY))
        return _kept[-1]

    def drop(self, name: str = "") -> None:
        """Delete a table that no later plan reads, or all of them."""
        jvm = self.spark.sparkContext._jvm
        if jvm is None:  # the session has ended
            return
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pieces_of(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 * BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Put batches together until ``column`` holds about ``limit`` bytes, so that repeated words are handled once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in pieces_of(batches, column, limit):
        held.append(batch)
        size += int(pc.fill_null(pc.sum(pc.binary_length(batch.column(column))), 0).as_py())
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def words_of(text: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text, flat, and the offsets of each text in them.

    With ``lower``, A-Z become a-z first; other letters keep their case.  Null counts as empty.
    """
    text = pc.fill_null(text, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.flatten()
    offsets = offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    kept = np.concatenate([[0], np.cumsum(full)])
    return (flat if full.all() else flat.filter(pa.array(full))), kept[offsets]


def unique_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, and for each word its index among them."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary, np.asarray(coded.indices, dtype=np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_view(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings in one array, and the offsets of each string in it."""
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = strings.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(strings) else np.zeros(0, np.uint8)
    return flat, offsets - (offsets[0] if len(offsets) else 0)


def string_hashes(strings: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x, seed) for x in strings.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(strings))


def crc32_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
