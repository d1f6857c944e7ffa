"""Changes to stored tables without a transaction manager: the new table is a plan over the old one."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators.ranking import keep_first
from plinth.schemas import KEYS, LAYOUTS


def insert_only(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks; within ``new`` the first of a key."""
    return old.unionByName(absent(old, new, keys, *order))


def absent(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    once = keep_first(new, keys, *(order or [F.lit(0)])) if order else new.dropDuplicates(keys)
    return once.join(old.select(*keys), keys, "left_anti").select(*old.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; within ``new`` the first in ``order``."""
    once = (keep_first(new, keys, *order) if order else new.dropDuplicates(keys)).select(*old.columns)
    return old.join(once.select(*keys), keys, "left_anti").select(*old.columns).unionByName(once)


def replace_scope(old: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """All rows of each ``scope`` value in ``new`` take the place of the old ones."""
    return old.join(new.select(scope).distinct(), scope, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def known_edges(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges whose ends are both stored."""
    ids = chunks.select("repository_id", "chunk_id").distinct()
    for end in ("source_chunk_id", "target_chunk_id"):
        edges = edges.join(ids.withColumnRenamed("chunk_id", end), ["repository_id", end], "left_semi")
    return edges


def orphans(rows: DataFrame, referred: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose (not null) reference leads nowhere."""
    return rows.where(F.col(column).isNotNull()).join(referred.select(F.col(key).alias(column)).distinct(), column, "left_anti")


class Store:
    """Tables as Parquet folders: each version is a folder of its own, and a pointer file names the current one.

    A change writes a new version and then moves a new pointer over the old one, which is one step; a
    failure at any time leaves the table as it was before or as it is after.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _version(self, name: str) -> str | None:
        """The folder of the current version."""
        fs, p = self._fs(f"{self.root}/{name}/current")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return f"{self.root}/{name}/{self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self._version(name) is not None

    def read(self, name: str) -> DataFrame:
        version = self._version(name)
        if version is not None:
            return self.spark.read.schema(LAYOUTS[name]).parquet(version)
        return self.spark.createDataFrame([], LAYOUTS[name])

    def replace(self, name: str, df: DataFrame) -> None:
        """Write a version, then point to it; the version before is deleted."""
        before, version = self._version(name), f"version-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{version}")
        self._point(name, version)
        if before is not None:
            fs, p = self._fs(before)
            fs.delete(p, True)

    def _point(self, name: str, version: str) -> None:
        jvm = self.spark.sparkContext._jvm
        fs, staged = self._fs(f"{self.root}/{name}/.current-{uuid.uuid4().hex}")
        stream = fs.create(staged, True)
        stream.write(bytearray(version.encode()))
        stream.close()
        kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(kinds, 1)
        over[0] = kinds.OVERWRITE
        target = self._fs(f"{self.root}/{name}/current")[1]
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(staged), fs.makeQualified(target), over)

    def insert_only(self, name: str, new: DataFrame, *order: Column) -> int:
        """Insert rows with new keys; returns their number."""
        before = self.read(name)
        fresh = absent(before, new, KEYS[name], *order).cache()
        count = fresh.count()
        if count:
            self.replace(name, before.unionByName(fresh))
        fresh.unpersist()
        return count

    def upsert(self, name: str, new: DataFrame, *order: Column) -> None:
        self.replace(name, upsert(self.read(name), new, KEYS[name], *order))

    def replace_scope(self, name: str, column: str, value: str, new: DataFrame) -> None:
        """``new`` in place of all rows with ``value`` in ``column``, in one step."""
        before = self.read(name)
        self.replace(name, before.where(F.col(column) != value).unionByName(new.select(*before.columns)))

    def delete(self, name: str, repository_id: str) -> int:
        before = self.read(name)
        count = before.where(F.col("repository_id") == repository_id).count()
        if count:
            self.replace(name, before.where(F.col("repository_id") != repository_id))
        return count

    def drop(self) -> None:
        fs, p = self._fs(self.root)
        fs.delete(p, True)


def decode_f32(blob: Column, width: int) -> Column:
    """A little-endian float32 blob as array<float>, by the bits of each number."""

    def number(i: Column) -> Column:
        h = F.hex(F.reverse_bytes(F.substring(blob, i * 4 + 1, F.lit(4)))) if hasattr(F, "reverse_bytes") else F.concat(*(F.hex(F.substring(blob, i * 4 + k, F.lit(1))) for k in (4, 3, 2, 1)))
        bits = F.conv(h, 16, 10).cast("bigint")
        sign = F.when(F.shiftright(bits, 31) == 1, -1.0).otherwise(1.0)
        power, mantissa = F.shiftright(bits, 23).bitwiseAND(255), bits.bitwiseAND(0x7FFFFF)
        return F.when(power == 0, sign * mantissa * F.lit(2.0**-149)).otherwise(sign * (mantissa + 0x800000) * F.pow(F.lit(2.0), power - 150)).cast("float")

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), number)
