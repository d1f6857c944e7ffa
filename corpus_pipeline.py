"""A corpus from raw documents to pieces: toxicity, exact dedup, near-dedup, decontamination, SentencePiece.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; :func:`run`
writes each result as Parquet and reads it again.  All stages but the last return the columns of
``docs``.  Of repeated rows one stays.

Defined cases: null and empty texts pass the first stage; of all empty texts one stays after exact
dedup; rows without id are kept or dropped by their text alone; a document goes if it holds any
window of the benchmark, items without id included; an empty table stays empty; further columns are
carried along under their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import decontaminate as decontamination
from plinth.llm import toxicity
from plinth.llm.common import Scratch, discard, release, shared_folder
from plinth.llm.exact_dedup import exact_dedup
from plinth.llm.near_dedup import near_dedup
from plinth.llm.sentencepiece_coding import encode_documents

#: Row numbers that are broadcast at most (about 16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _free_name(docs: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _keyed(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells all rows apart, and that column's name.

    A hash of id and text does, unless a row repeats; then the rows are written with a number.
    """
    key = _free_name(docs, "row_key")
    id_, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    keyed = docs.withColumn(key, F.xxhash64(id_, text))
    if keyed.groupBy(key).count().where("count > 1").isEmpty():
        return keyed, key
    return scratch.write(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def _without(scratch: Scratch, docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose key is not in ``dropped``."""
    dropped = scratch.write(dropped.select(key).distinct(), "dropped")
    small = dropped.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(dropped) if small else dropped, key, "left_anti").drop(key)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(spark, docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline-copies")
    rows, key = _keyed(scratch, docs)
    return _without(scratch, rows, exact_dedup(spark, rows, row_id=key).where(~F.col("kept")), key)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline-near")
    rows, key = _keyed(scratch, docs)
    return _without(scratch, rows, near_dedup(spark, rows, row_id=key).where(~F.col("first_row")), key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that holds a window of the benchmark goes, however long it is.

    The operator's ``contaminated`` weighs the hits against the length and so lets a long document
    through that holds a whole item; for a training corpus the item must not stay.
    """
    scratch = Scratch(spark, "pipeline-benchmark")
    rows, key = _keyed(scratch, docs)
    found = decontamination.decontaminate(spark, rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row_id=key)
    return _without(scratch, rows, found.where("n_hit > 0"), key)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(spark, docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can express neither the trained classifier nor the piece lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    discard()
    folder = f"{shared_folder(spark)}/plinth/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/stage-{i}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/stage-{i}")
        release()
        discard()  # what the stage is made from
    return docs
