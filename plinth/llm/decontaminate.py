r"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every benchmark item is cut into windows of WINDOW consecutive words (an item with
fewer is one window).  The words of a window are ordered by their rarity in the
corpus.  Containment of a whole window asks for every one of its words, so a prefix
of one word, the rarest, is necessary: documents and windows are joined on it alone.
A match fixes where the window would begin in the document (the word's position less
its offset in the window); bounds on that position and on the length drop what
cannot fit, and the rest is verified word by word.

The windows are broadcast while they number BROADCAST_WINDOWS at most; beyond that
the join is a shuffled one, whose skewed partitions the adaptive engine splits.

Defined cases: null or empty texts have no words, are never hit and hit nothing; an
empty documents table gives an empty result, an empty benchmark hits nothing;
repeated rows get equal results; rows sharing an id keep their own results; items
sharing an id count once; the windows of items without id hit like any other, but such
items are not counted or named; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents

WINDOW = 13
#: Windows (of about 200 bytes each) that are broadcast at most.
BROADCAST_WINDOWS = 50_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() is fast, and changes A-Z alone where all characters are of one byte
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The distinct windows (array of words) with the sorted ids of their items; none where no item with the window has an id."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    each = item.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("window"))
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def with_prefix(scratch: Scratch, found: DataFrame, docs: DataFrame, small: bool) -> DataFrame:
    """Each window with its rarest word in ``docs`` and that word's first offset; ties go to the lesser word."""
    vocabulary = found.select(F.explode("window").alias("word")).distinct()
    tokens = docs.select(F.explode(words(F.col("text"))).alias("word"))
    # Kept as a table: only a join of two plain exchanges can be split where a word is in very many windows.
    seen = scratch.keep(tokens.join(F.broadcast(vocabulary) if small else vocabulary, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    order = found.select("window", F.explode(F.array_distinct("window")).alias("word")).join(F.broadcast(seen) if small else seen.hint("merge"), "word", "left")
    # A window with a word that no document has cannot occur.
    rarest = order.groupBy("window").agg(F.min(F.struct("n", "word")).alias("rare"), F.count("n").alias("known"), F.count("word").alias("all")).where("known = `all`")
    return found.join(rarest, "window").select("window", "items", F.col("rare.word").alias("token"), (F.array_position("window", F.col("rare.word")) - 1).cast("int").alias("offset"))


def row_key(docs: DataFrame) -> Column:
    """What tells rows apart: hashes of id and text, and the text's length; rows with equal keys have equal results."""
    id_, text = docs["doc_id"].cast("bigint"), docs["text"].cast("string")
    return F.struct(F.xxhash64(id_, text).alias("a"), F.hash(text, id_).alias("b"), F.coalesce(F.octet_length(text), F.lit(-1)).alias("c"))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, row_id: str | None = None) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated.

    ``row_id`` names a column that tells all rows apart and comes back; without it hashes of the rows do.

    Every document ends in a token of its own that matches a window of no words; so one pass over the
    texts finds the hits and the number of words.
    """
    scratch = Scratch(spark, "decontaminate")
    key = row_key(docs) if row_id is None else F.col(row_id)
    docs = docs.select(key.alias("row_key"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scratch.keep(windows(benchmark, size))
    small = found.count() <= BROADCAST_WINDOWS
    keyed = scratch.keep(with_prefix(scratch, found, docs, small))

    parsed = docs.select("row_key", "doc_id", words(F.col("text")).alias("w"))
    start = F.col("pos") - F.col("offset")
    span = F.struct(F.col("start").alias("a"), (F.col("start") + F.size("window")).alias("b")).alias("span")
    end = F.lit("")  # no word is empty
    if small:
        # Joined on the map side: the words are at hand and are never copied for a token.
        nothing = F.array().cast("array<string>")
        prefixes = keyed.unionByName(spark.range(1).select(nothing.alias("window"), nothing.alias("items"), end.alias("token"), F.lit(0).alias("offset")))
        tokens = parsed.select("row_key", "doc_id", "w", F.posexplode(F.array_append("w", end)).alias("pos", "token"))
        pairs = tokens.join(F.broadcast(prefixes), "token").withColumn("start", start)
        fits = pairs.where((F.col("start") >= 0) & (F.col("start") + F.size("window") <= F.size("w")))
        spans = fits.where(F.slice("w", F.col("start") + 1, F.size("window")) == F.col("window")).select("row_key", "doc_id", span, "items")
    else:
        # Tokens are shuffled without the words of their text; what fits meets them again.
        tokens = parsed.select("row_key", F.size("w").alias("n"), F.posexplode("w").alias("pos", "token"))
        pairs = tokens.join(keyed.hint("merge"), "token").withColumn("start", start)
        fits = pairs.where((F.col("start") >= 0) & (F.col("start") + F.size("window") <= F.col("n"))).select("row_key", "start", "window", "items").distinct()
        met = fits.join(parsed.distinct().hint("merge"), "row_key")
        spans = met.where(F.slice("w", F.col("start") + 1, F.size("window")) == F.col("window")).select("row_key", "doc_id", span, "items")
        n = F.size("w")
        spans = spans.unionByName(parsed.select("row_key", "doc_id", F.struct(n.alias("a"), n.alias("b")).alias("span"), F.array().cast("array<string>").alias("items")))
    # A document has no more spans than words, and no more items than spans and the items that share a window.
    far = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("far")),
        lambda x, s: F.struct((x["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], x["far"]))).alias("n"), F.greatest(x["far"], s["b"]).alias("far")),
    )
    each = spans.groupBy("row_key", "doc_id").agg(
        F.collect_set("span").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.max("span.b").cast("bigint").alias("n_words"),
        F.count_if(F.col("span.a") == F.col("span.b")).cast("int").alias("n_rows"),
    )
    each = each.withColumn("n_hit", far["n"].cast("bigint"))
    return each.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        "items",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
        F.explode(F.array_repeat("row_key", F.col("n_rows"))).alias("row_key" if row_id is None else row_id),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT item, least(13, len(w)) AS n, array_to_string(w[s:s + 12], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM b WHERE len(w) > 0)
), lens AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, s, bw.n, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
