"""The queries of this package, and the SQL for those that SQL can express."""

from __future__ import annotations

import functools

from . import chat, decontaminate, exact_dedup, line_dedup, lm_scoring, near_dedup, quality, sentencepiece_coding, sharding, toxicity
from .common import release


def _alone(query):
    """The query, after what earlier ones kept on disk has been dropped."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        release()
        return query(spark, sf_dir)

    return run


_QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_chat": chat.op2_chat,
    "op3_sentencepiece": sentencepiece_coding.op3_sentencepiece,
    "op4_quality": quality.op4_quality,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_sharding": sharding.op9_sharding,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
}

QUERIES = {name: _alone(query) for name, query in _QUERIES.items()}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_chat": chat.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op7_near_dedup": near_dedup.SQL,
    "op8_decontaminate": decontaminate.SQL,
}
