"""Chunks by line windows: overlapping windows, and centred parents of small chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.ids import chunk_id
from plinth.functions.text import line_slice, lines_of
from plinth.operators.ranking import keep_first, ranked


def window_starts(n: Column, lines: int, step: int) -> Column:
    """First lines (from 1) of the windows over ``n`` lines; the last window reaches the end; none for n = 0."""
    last = F.ceil(F.greatest(n - lines, F.lit(0)) / step).cast("int") * step
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: s + 1)).otherwise(F.array().cast("array<int>"))


def sliding(files: DataFrame, lines: int = 50, step: int = 40, with_code: bool = True) -> DataFrame:
    """(file_id, chunk_id, start_line, end_line, raw_code) from (file_id, text)."""
    if lines <= 0 or step <= 0:
        raise ValueError("lines and step must be positive")
    held = files.select("file_id", lines_of(F.col("text")).alias("ls")).withColumn("n", F.size("ls"))
    each = held.select("file_id", "ls", "n", F.explode(window_starts(F.col("n"), lines, step)).alias("start_line"))
    each = each.withColumn("end_line", F.least(F.col("start_line") + (lines - 1), F.col("n")))
    out = each.withColumn("chunk_id", chunk_id(F.col("file_id").cast("string"), F.lit("sliding"), F.col("start_line"), F.col("end_line")))
    code = [line_slice(F.col("ls"), F.col("start_line"), F.col("end_line")).alias("raw_code")] if with_code else []
    return out.select("file_id", "chunk_id", "start_line", "end_line", *code)


def valid_range(start: Column, end: Column, n: Column) -> Column:
    """Whether start..end are lines of a file with ``n`` lines, in order."""
    return (start >= 1) & (start <= end) & (end <= n)


def parent_range(start: Column, end: Column, n: Column, lines: int = 50) -> tuple[Column, Column]:
    """A range of ``lines`` around start..end, shifted back into 1..n where it sticks out."""
    extra = F.greatest(F.lit(0), F.lit(lines) - (end - start + 1))
    before = F.floor(extra / 2).cast("int")
    a, b = start - before, end + (extra - before)
    b = F.when(a < 1, F.least(b + (1 - a), n)).otherwise(b)
    a = F.greatest(a, F.lit(1))
    low = F.when(b > n, F.greatest(a - (b - n), F.lit(1))).otherwise(a)
    return low.cast("int"), F.least(b, n).cast("int")


def parents(chunks: DataFrame, sizes: DataFrame, lines: int = 50) -> DataFrame:
    """``chunks`` (file_id, chunk_id, start_line, end_line) with parent_start, parent_end and parent_chunk_id; equal ranges share a parent.

    ``sizes``: file_id, n_lines.
    """
    a, b = parent_range(F.col("start_line"), F.col("end_line"), F.col("n_lines"), lines)
    ranged = chunks.join(sizes, "file_id").withColumns({"parent_start": a, "parent_end": b})
    return ranged.withColumn("parent_chunk_id", chunk_id(F.col("file_id").cast("string"), F.lit("parent"), F.col("parent_start"), F.col("parent_end"))).drop("n_lines")


def enclosing(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """(point_id, chunk_id, width, rank): chunks of the same file around each point (point_id, file_id, line), narrowest first.

    The join is on the file and on BLOCK-line blocks that a chunk covers, so a long file is not one group.
    The result has a row for every chunk around a point; where the first is enough, see :func:`narrowest`.
    """
    block = lambda line: F.floor(line / BLOCK).cast("int")
    covered = chunks.select("file_id", "chunk_id", "start_line", "end_line", F.explode(F.sequence(block(F.col("start_line")), block(F.col("end_line")))).alias("_b"))
    met = points.withColumn("_b", block(F.col("line"))).join(covered, ["file_id", "_b"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return ranked(met.withColumn("width", F.col("end_line") - F.col("start_line")), ["point_id"], F.col("width"), F.col("start_line"), F.col("chunk_id"))


#: Lines of a block in the range join.
BLOCK = 64


def narrowest(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """(point_id, chunk_id, width): the first row of :func:`enclosing` for each point that has one, without making the others.

    Lines are 32-bit integers.  A range is cut into aligned blocks of 2^k lines, two for each k at most;
    of the ranges that hold a block only the first counts, as one long (width, then start), which is
    aggregated before the shuffle.  A line then meets one block for each k.  So no step makes more rows
    than chunks or points times the levels, however many chunks lie over one another.
    """
    chunks = chunks.select("file_id", "chunk_id", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line")).where("start_line <= end_line")
    a, b = F.col("start_line").cast("bigint"), F.col("end_line").cast("bigint")
    order = F.shiftleft(b - a, 32) + a + 2**31
    # blocks first .. last - 1 of 2^_k lines are whole; an odd first or last one is in no block of the next level
    first, last = -F.call_function("shiftright", -F.col("_a"), F.col("_k")), F.call_function("shiftright", F.col("_b") + 1, F.col("_k"))
    deepest = F.log2((b - a + 1).cast("double")).cast("int") + 1
    levels = chunks.select("file_id", a.alias("_a"), b.alias("_b"), order.alias("_order"), F.explode(F.sequence(F.lit(0), 2 * deepest + 1)).alias("_i")).withColumn("_k", F.shiftright("_i", 1))
    edge = F.when(F.col("_i") % 2 == 0, first).otherwise(last)
    own = levels.where((first < last) & (edge % 2 != 0)).select("file_id", "_k", (edge - F.col("_i") % 2).alias("_block"), "_order")
    best = own.groupBy("file_id", "_k", "_block").agg(F.min("_order").alias("_order"))

    top = chunks.agg(F.max(deepest).alias("_top"))  # one row
    lines = points.select("file_id", F.col("line").cast("bigint").alias("line")).distinct().crossJoin(F.broadcast(top))
    asked = lines.select("file_id", "line", F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("_k")).withColumn("_block", F.call_function("shiftright", F.col("line"), F.col("_k")))
    met = asked.join(best, ["file_id", "_k", "_block"]).groupBy("file_id", "line").agg(F.min("_order").alias("_order"))

    width, start = F.shiftright("_order", 32), F.col("_order").bitwiseAND(F.lit(2**32 - 1)) - 2**31
    won = met.select("file_id", width.alias("_width"), start.cast("int").alias("start_line")).distinct()
    named = chunks.select("file_id", "chunk_id", "start_line", (b - a).alias("_width")).join(won, ["file_id", "_width", "start_line"]).groupBy("file_id", "_width", "start_line").agg(F.min("chunk_id").alias("chunk_id"))
    found = met.select("file_id", "line", width.alias("_width"), start.cast("int").alias("start_line")).join(named, ["file_id", "_width", "start_line"])
    at = points.select("point_id", "file_id", F.col("line").cast("bigint").alias("line")).join(found, ["file_id", "line"])
    return keep_first(at, ["point_id"], F.col("_width"), F.col("start_line"), F.col("chunk_id")).select("point_id", "chunk_id", F.col("_width").cast("int").alias("width"))
