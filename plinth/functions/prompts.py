"""Texts for agents, as expressions: what is shown of a bundle, of claims and of a debate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def section(title: str, body: Column) -> Column:
    """A heading and its body; nothing for an empty body."""
    return F.when(F.length(F.coalesce(body, F.lit(""))) > 0, F.concat(F.lit(f"## {title}\n"), body))


def numbered(items: Column, show) -> Column:
    """A line for each item of an array, counted from 1; ``show(item)`` makes the text."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), show(x))), "\n")


def claim_line(c: Column) -> Column:
    """Kind, place and assertion of a claim, and its status if it has one."""
    return F.concat(F.lit("["), c["claim_type"], F.lit("] "), c["location"], F.lit(": "), c["assertion"], F.coalesce(F.concat(F.lit(" -> "), c["status"], F.lit(" ("), F.coalesce(c["confidence"], F.lit("low")), F.lit(")")), F.lit("")))


def bundle_text(changed: Column, callers: Column, callees: Column, tests: Column) -> Column:
    """The names of arrays of texts under their headings."""
    lists = (("Changed functions", changed), ("Callers", callers), ("Callees", callees), ("Related tests", tests))
    return F.concat_ws("\n\n", *(section(title, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")) for title, items in lists))


def transcript_text(turns: Column) -> Column:
    """The speeches of a debate in their order."""
    return F.array_join(F.transform(turns, lambda x, i: F.concat(F.lit("Round "), (i + 1).cast("string"), F.lit(":\n"), x)), "\n\n")


def judge_prompt(diff: Column, turns: Column, claims: Column, ended_by: Column) -> Column:
    """What a judge sees: the diff, the debate, the claims with their evidence, and how the debate ended."""
    return F.concat_ws("\n\n", section("Diff", diff), section("Debate", transcript_text(turns)), section("Claims", numbered(claims, claim_line)), section("Ended by", ended_by))


def answer_prompt(question: Column, context: Column) -> Column:
    """A question with the code that may answer it, or the statement that there is none."""
    return F.concat_ws("\n\n", section("Code", F.when(F.length(F.coalesce(context, F.lit(""))) > 0, context).otherwise("none found")), section("Question", question))
