"""A review as one plan over many diffs: every stage is a column, every event a row.

Agents are functions on columns: text in, text out.  Those whose answer must parse get an attempt
number and are asked again, up to ATTEMPTS times, while it doesn't.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plinth.operators.review import INCONCLUSIVE, parse_claims, parse_verdict, too_sure

ATTEMPTS = 3
MAX_REBUTTALS = 2
NO_FUNCTION = "No changed function of this diff is in the index."


@dataclass(frozen=True)
class Agents:
    """``defend(summary, diff)``, ``accuse(summary, diff, defence, attempt)``, ``rebut(diff, last text, claims as JSON)``, ``judge(transcript, claims as JSON, ended by, attempt)``."""

    defend: Callable[[Column, Column], Column]
    accuse: Callable[[Column, Column, Column, int], Column]
    rebut: Callable[[Column, Column, Column], Column]
    judge: Callable[[Column, Column, Column, int], Column]


def draft(cases: DataFrame, agents: Agents) -> DataFrame:
    """``cases`` (diff_id, diff, summary, files) with the defence and the claims; claims are null if no attempt gave valid ones."""
    defended = cases.withColumn("defence", agents.defend(F.col("summary"), F.col("diff")))
    tries = [parse_claims(agents.accuse(F.col("summary"), F.col("diff"), F.col("defence"), i), F.col("files")) for i in range(ATTEMPTS)]
    return defended.withColumn("claims", F.coalesce(*tries))


def claims_of(drafted: DataFrame) -> DataFrame:
    """One row for each claim: diff_id, claim_index, claim_type, location, assertion, proposed_test."""
    return drafted.select("diff_id", F.posexplode("claims").alias("claim_index", "c")).select("diff_id", "claim_index", "c.*")


def decide(drafted: DataFrame, evidence: DataFrame, agents: Agents) -> DataFrame:
    """The drafted cases with verified claims, rebuttals and verdict.

    ``evidence``: diff_id, claim_index, status, confidence.  A claim without evidence is open.  The
    first rebuttal always happens; the second only while a claim is open.
    """
    settled = evidence.select("diff_id", "claim_index", "status", "confidence")
    each = claims_of(drafted).join(settled, ["diff_id", "claim_index"], "left").withColumn("status", F.coalesce("status", F.lit(INCONCLUSIVE)))
    verified = each.groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct("claim_index", "claim_type", "location", "assertion", "status", "confidence"))).alias("verified"), F.count_if(F.col("status") == INCONCLUSIVE).alias("n_open"))
    full = drafted.join(verified, "diff_id", "left").withColumns({"verified": F.coalesce("verified", F.filter(F.array(F.struct(*(F.lit(None).cast(t).alias(n) for n, t in (("claim_index", "int"), ("claim_type", "string"), ("location", "string"), ("assertion", "string"), ("status", "string"), ("confidence", "string"))))), lambda x: F.lit(False))), "open_claims": F.coalesce("n_open", F.lit(0).cast("bigint"))}).drop("n_open")
    facts = F.to_json("verified")
    first = agents.rebut(F.col("diff"), F.col("defence"), facts)
    told = full.withColumn("rebuttal_1", first).withColumn("rebuttal_2", F.when(F.col("open_claims") > 0, agents.rebut(F.col("diff"), F.col("rebuttal_1"), facts)))
    told = told.withColumns({"ended_by": F.when(F.col("open_claims") == 0, "resolution").otherwise("cap"), "rounds": F.when(F.col("open_claims") == 0, 2).otherwise(1 + MAX_REBUTTALS), "transcript": F.array_compact(F.array("defence", "rebuttal_1", "rebuttal_2"))})

    def valid(i: int) -> Column:
        v = parse_verdict(agents.judge(F.to_json("transcript"), facts, F.col("ended_by"), i))
        return F.when(~F.coalesce(too_sure(F.col("ended_by"), F.col("open_claims"), v["confidence"], v["minority_report"]), F.lit(False)), v)

    return told.withColumn("verdict", F.coalesce(*map(valid, range(ATTEMPTS))))


def events(decided: DataFrame) -> DataFrame:
    """(diff_id, seq, type, payload) in order: context, defender, claims, one claim_verified for each claim, rebuttals, judge, done.

    A diff without changed functions, or whose claims or verdict never became valid, ends with an error event in that place.
    """
    event = lambda kind, payload, on=None: (F.when(on, F.struct(F.lit(kind).alias("type"), payload.alias("payload"))) if on is not None else F.struct(F.lit(kind).alias("type"), payload.alias("payload")))
    known, claimed, judged = F.size("files") > 0, F.col("claims").isNotNull(), F.col("verdict").isNotNull()
    head = F.array(
        event("context", F.col("summary")),
        event("error", F.lit(NO_FUNCTION), ~known),
        event("defender", F.col("defence"), known),
        event("error", F.lit("no valid claims"), known & ~claimed),
        event("claims", F.to_json("claims"), known & claimed),
    )
    checks = F.when(known & claimed, F.transform("verified", lambda v: event("claim_verified", F.to_json(v))))
    tail = F.array(
        event("rebuttal", F.col("rebuttal_1"), known & claimed),
        event("rebuttal", F.col("rebuttal_2"), known & claimed & F.col("rebuttal_2").isNotNull()),
        event("error", F.lit("no valid verdict"), known & claimed & ~judged),
        event("judge", F.to_json("verdict"), known & claimed & judged),
        event("done", F.lit(None).cast("string"), known & claimed & judged),
    )
    every = F.array_compact(F.concat(head, F.coalesce(checks, F.filter(head, lambda x: F.lit(False))), tail))
    return decided.select("diff_id", F.posexplode(every).alias("seq", "e")).select("diff_id", "seq", "e.type", "e.payload")


def latest_event(stream: DataFrame) -> DataFrame:
    """Where each review stands."""
    w = W.partitionBy("diff_id").orderBy(F.col("seq").desc())
    return stream.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def outcomes(cases: DataFrame, decided: DataFrame, reviewer: Callable[[Column, Column], Column]) -> DataFrame:
    """(case_id, is_buggy, condition, flagged): a single reviewer, unverified claims, the full review.

    ``reviewer(summary, diff)`` gives a boolean.  Failed reviews are left out.
    """
    from plinth.operators.review import flags

    done = decided.where(F.col("verdict").isNotNull()).select(F.col("diff_id").alias("case_id"), reviewer(F.col("summary"), F.col("diff")).alias("has_issue"), F.size("claims").alias("n_claims"), F.col("verdict.verdict").alias("verdict"))
    return flags(done).join(cases.select("case_id", "is_buggy"), "case_id")
