"""What a user can plug in, with deterministic defaults that need no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.functions.text import jaccard, tokens

Encoder = Callable[[Column], Column]
Scorer = Callable[[Column, Column], Column]
Generator = Callable[[Column, Column], Column]


def hashed_encoder(width: int = 64) -> Encoder:
    """Texts as token counts hashed to ``width`` signed buckets."""

    def encode(text: Column) -> Column:
        slots = F.transform(tokens(text), lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(width)).alias("i"), F.when(F.pmod(F.shiftright(F.xxhash64(t), 32), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(slots, F.lit(0.0), lambda a, x: a + F.when(x["i"] == i, x["s"]).otherwise(0.0)).cast("float"))

    return encode


def batched_encoder(load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], width: int, batch: int = 32) -> Encoder:
    """A model that encodes lists of texts, as a column function: ``load()`` runs once in each task, then texts go in batches.

    A vector of another width is an error.
    """

    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in texts:
            out: list[list[float]] = []
            for at in range(0, len(part), batch):
                asked = [x or "" for x in part.iloc[at : at + batch].tolist()]
                found = [[float(x) for x in v] for v in model(asked)]
                if len(found) != len(asked) or any(len(v) != width for v in found):
                    raise ValueError(f"the model gave other than {len(asked)} vectors of width {width}")
                out += found
            yield pd.Series(out)

    encode.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(encode, "array<float>")


def retried(call: Callable, attempts: int = 4, wait: float = 15.0, errors: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call``, tried again after ``wait`` seconds while it raises one of ``errors``; the last error is raised."""

    def run(*args, **named):
        for left in range(attempts - 1, -1, -1):
            try:
                return call(*args, **named)
            except errors:
                if not left:
                    raise
                sleep(wait)

    return run


def overlap_scorer(query: Column, code: Column) -> Column:
    """Share of token sets that query and code have in common."""
    return jaccard(F.array_distinct(tokens(query)), F.array_distinct(tokens(code)))


def echo_generator(question: Column, context: Column) -> Column:
    """Names the files of the context; a fixed answer without any."""
    paths = F.array_distinct(F.regexp_extract_all(context, F.lit("File Path: ([^\\n]+)"), 1))
    return F.when(F.length(context) == 0, F.lit("The indexed code does not answer this.")).otherwise(F.concat(F.lit("See "), F.array_join(paths, ", "), F.lit(".")))
