"""Review dataflow: diffs, bundles, claims, evidence, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plinth.functions.text import fallback_phrase, is_test_path, once
from plinth.operators.chunking import narrowest
from plinth.operators.graph import classify
from plinth.operators.ranking import keep_first, top_k
from plinth.operators.sparse import SparseIndex, scores
from plinth.schemas import SYNTAX_KINDS

# Kinds of claims, verdicts, results of verification.
CLAIM_KINDS = ("missing_null_check", "untested_branch", "type_mismatch", "exception_handling", "breaking_change", "security")
VERDICTS = ("approve", "reject", "needs_human_review")
CONFIRMED, REFUTED, INCONCLUSIVE = "confirmed", "refuted", "inconclusive"
#: Confidence from which a verdict over an open claim must come with a minority report.
OPEN_CEILING = 0.7

_CLAIMS = "array<struct<claim_type:string,location:string,assertion:string,proposed_test:string>>"


# --- diffs -------------------------------------------------------------------------------------


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, pos, line) from (diff_id, diff)."""
    return diffs.select("diff_id", F.posexplode(F.split(F.coalesce("diff", F.lit("")), "\n")).alias("pos", "line"))


def strip_index_lines(diff: Column) -> Column:
    return F.regexp_replace(diff, r"(?m)^index [0-9a-fA-F]+\.\.[0-9a-fA-F]+.*\n?", "")


def changed_locations(diffs: DataFrame) -> DataFrame:
    """(diff_id, hunk, file, start_line, end_line, old_start_line, old_end_line), one row for each hunk with new lines.

    Line numbers are running counts over the hunk's body; a body line that looks like a file header
    ends the hunk.
    """
    w = W.partitionBy("diff_id").orderBy("pos")
    line = F.col("line")
    head = line.rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@")
    marks = diff_lines(diffs).withColumns(
        {
            "is_head": head,
            "is_file": line.rlike(r"^(\+\+\+|---) ") | line.startswith("diff --git"),
            "new_file": F.when(line.startswith("+++ "), F.regexp_replace(F.regexp_extract(line, r"^\+\+\+ ([^\t]*)", 1), "^b/", "")),
        }
    )
    marks = marks.withColumn("file", F.last("new_file", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    # a section begins at every hunk head and every file header; only those of hunk heads have a body
    marks = marks.withColumn("section", F.sum((F.col("is_head") | F.col("is_file")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    number = lambda i: F.regexp_extract(line, r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", i)
    count = lambda i: F.when(number(i) == "", 1).otherwise(number(i).cast("int"))
    heads = marks.where("is_head").select("diff_id", "section", "file", number(1).cast("int").alias("old0"), number(3).cast("int").alias("new0"), count(4).alias("new_n"))
    heads = heads.where((F.col("new_n") > 0) & (F.col("file") != "/dev/null"))
    body = marks.where(~F.col("is_head") & ~F.col("is_file")).select("diff_id", "section", "pos", F.substring("line", 1, 1).alias("mark"))
    joined = heads.join(body, ["diff_id", "section"], "left")
    v = W.partitionBy("diff_id", "section").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    added, removed, kept = (F.col("mark") == "+"), (F.col("mark") == "-"), (F.col("mark") == " ")
    ahead = lambda c: F.coalesce(F.sum(F.coalesce(c.cast("int"), F.lit(0))).over(v), F.lit(0))
    at = joined.withColumns({"new_at": F.col("new0") + ahead(added | kept), "old_at": F.col("old0") + ahead(removed | kept)})
    out = at.groupBy("diff_id", "section", "file", "old0", "new0").agg(
        F.min(F.when(added, F.col("new_at"))).alias("a"), F.max(F.when(added, F.col("new_at"))).alias("b"), F.min(F.when(removed, F.col("old_at"))).alias("c"), F.max(F.when(removed, F.col("old_at"))).alias("d")
    )
    return out.select(
        "diff_id", F.col("section").cast("bigint").alias("hunk"), "file",
        F.coalesce("a", "new0").alias("start_line"), F.coalesce("b", "new0").alias("end_line"), F.coalesce("c", "old0").alias("old_start_line"), F.coalesce("d", "old0").alias("old_end_line"),
    )


def changed_functions(locations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(diff_id, chunk_id): the syntax chunk around each location's old start, else around its old end; a chunk once for a diff.

    ``chunks``: chunk_id, file_id, file_path, chunk_type, start_line, end_line.
    """
    code = chunks.where(F.col("chunk_type").isin(*SYNTAX_KINDS)).select(F.col("file_path").alias("file_id"), "chunk_id", "start_line", "end_line")
    tries = locations.select("diff_id", "hunk", "file", F.posexplode(F.array("old_start_line", "old_end_line")).alias("attempt", "line"))
    points = tries.select(F.struct("diff_id", "hunk", "attempt").alias("point_id"), F.col("file").alias("file_id"), "line")
    met = narrowest(points, code).select(F.col("point_id.diff_id").alias("diff_id"), F.col("point_id.hunk").alias("hunk"), F.col("point_id.attempt").alias("attempt"), "chunk_id")
    first = keep_first(met, ["diff_id", "hunk"], F.col("attempt"))
    return keep_first(first, ["diff_id", "chunk_id"], F.col("hunk")).select("diff_id", "chunk_id", "hunk")


def bundle(functions: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(diff_id, chunk_id, other, role, is_test, fallback): callers and callees of changed functions, once for each diff and role.

    ``fallback`` is the phrase to search tests with, where no caller of the chunk is a test.
    """
    roles = classify(edges, functions.select(F.col("chunk_id").alias("id")).distinct())
    paths = chunks.select(F.col("chunk_id").alias("other"), is_test_path(F.col("file_path")).alias("is_test"))
    near = functions.join(roles.withColumnRenamed("focus", "chunk_id"), "chunk_id", "left").join(paths, "other", "left")
    tested = near.groupBy("diff_id", "chunk_id").agg(F.coalesce(F.max(F.when(F.col("role") == "caller", F.col("is_test").cast("int"))), F.lit(0)).alias("tested"))
    phrase = chunks.select("chunk_id", fallback_phrase(F.col("function_name"), F.col("file_path")).alias("phrase"))
    full = near.join(tested, ["diff_id", "chunk_id"]).join(phrase, "chunk_id").withColumn("fallback", F.when(F.col("tested") == 0, F.col("phrase")))
    return keep_first(full, ["diff_id", "chunk_id", "other", "role"], F.col("hunk")).select("diff_id", "chunk_id", "other", "role", "is_test", "fallback")


def fallback_tests(bundled: DataFrame, index: SparseIndex, chunks: DataFrame, k: int = 5) -> DataFrame:
    """(diff_id, chunk_id, test_id, rank, found_via): for changed functions that no test calls, the best test chunks for their phrase.

    ``bundled``: rows of :func:`bundle`; ``chunks``: chunk_id, file_path.  The search runs over chunks of
    test files alone, and hits without any term of the phrase don't count.
    """
    asked = bundled.where(F.col("fallback").isNotNull()).select("diff_id", "chunk_id", "fallback").distinct()
    phrases = asked.select(F.col("fallback").alias("query_id"), F.col("fallback").alias("query")).distinct()
    tests = chunks.where(is_test_path(F.col("file_path"))).select(F.col("chunk_id").alias("doc_id"))
    found = top_k(scores(index, phrases, within=tests), k, ["query_id"], F.round("score", 9).desc(), F.col("doc_id"))
    met = asked.join(found.select(F.col("query_id").alias("fallback"), F.col("doc_id").alias("test_id"), "rank"), "fallback")
    return met.select("diff_id", "chunk_id", "test_id", "rank", F.lit("search").alias("found_via"))


# --- claims and verdicts -----------------------------------------------------------------------


def location_file(location: Column) -> Column:
    return F.nullif(F.regexp_extract(location, r"^(.+):(\d+)$", 1), F.lit(""))


def location_line(location: Column) -> Column:
    return F.nullif(F.regexp_extract(location, r"^(.+):(\d+)$", 2), F.lit("")).cast("int")


def language_of(path: Column) -> Column:
    return F.when(path.endswith(".py"), "python").when(path.rlike(r"\.(js|jsx|mjs|cjs)$"), "javascript")


def parse_claims(raw: Column, files: Column) -> Column:
    """The claims of a JSON answer, or null if any part of it is not valid.

    An array of claims, or an object with one key that holds it; every claim has a known kind,
    texts that are not empty, and a location in one of ``files``.
    """
    said = lambda x: x.isNotNull() & (F.length(x) > 0)
    good = lambda c: F.coalesce(c["claim_type"].isin(*CLAIM_KINDS) & said(c["assertion"]) & said(c["proposed_test"]) & F.array_contains(files, F.coalesce(location_file(c["location"]), F.lit(""))), F.lit(False))

    def inside(text: Column) -> Column:
        inner = once(F.map_values(F.from_json(text, "map<string,string>")), lambda v: F.get(v, F.lit(0)))
        return F.when(text.startswith("["), text).when(text.startswith("{"), F.when(F.size(F.json_object_keys(text)) == 1, once(inner, lambda x: F.when(F.ltrim(x).startswith("["), x))))

    checked = lambda claims: F.when(F.forall(claims, good), claims)
    parsed = lambda array: F.when(F.json_array_length(array).isNotNull(), once(F.from_json(array, _CLAIMS), checked))
    return once(F.regexp_replace(raw, r"^\s+|\s+$", ""), lambda text: once(inside(text), parsed))


def parse_verdict(raw: Column) -> Column:
    """The verdict of a JSON answer, or null if it is not valid."""
    v = F.from_json(raw, "struct<verdict:string,confidence:double,cited_evidence:array<string>,minority_report:string>")
    return F.when(v["verdict"].isin(*VERDICTS) & v["confidence"].between(0.0, 1.0) & v["cited_evidence"].isNotNull(), v)


def too_sure(ended_by: Column, open_claims: Column, confidence: Column, minority: Column) -> Column:
    """A verdict that treats an open case as settled."""
    return (ended_by == "cap") & (open_claims > 0) & minority.isNull() & (confidence >= OPEN_CEILING)


def near_findings(claims: DataFrame, findings: DataFrame, band: int = 2) -> DataFrame:
    """(claim_id, finding_id) in one file at most ``band`` lines apart; an equi-join on file and band-wide blocks."""
    size = band + 1
    block = F.floor(F.col("line") / size)
    left = claims.select("claim_id", "file", F.col("line"), F.explode(F.array(block - 1, block, block + 1)).alias("_b"))
    right = findings.select("finding_id", "file", F.col("line").alias("_line"), F.floor(F.col("line") / size).alias("_b"))
    return left.join(right, ["file", "_b"]).where(F.abs(F.col("line") - F.col("_line")) <= band).select("claim_id", "finding_id")


def by_test(exit_code: Column, timed_out: Column, has_test: Column, has_runner: Column) -> tuple[Column, Column]:
    """(status, confidence) of a proposed test: passed refutes, failed confirms, everything else settles nothing."""
    ran = has_test & has_runner & ~timed_out & exit_code.isNotNull()
    status = F.when(~F.coalesce(ran, F.lit(False)), INCONCLUSIVE).when(exit_code == 0, REFUTED).otherwise(CONFIRMED)
    return status, F.when(status == INCONCLUSIVE, "low").otherwise("high")


def by_findings(language: Column, found: Column) -> tuple[Column, Column]:
    """(status, confidence) of a static check: only Python files are checked."""
    status = F.when(F.coalesce(language, F.lit("")) != "python", INCONCLUSIVE).when(found, CONFIRMED).otherwise(REFUTED)
    return status, F.when(status == INCONCLUSIVE, "low").otherwise("medium")


def dispatch(kind: Column, exit_code: Column, timed_out: Column, has_test: Column, has_runner: Column, language: Column, found: Column, suite_exit: Column) -> tuple[Column, Column]:
    """(status, confidence) of a claim by its kind: static checks for security and types, the test suite for breaking changes, else the proposed test."""
    test, static = by_test(exit_code, timed_out, has_test, has_runner), by_findings(language, found)
    suite = F.when(suite_exit.isNull(), INCONCLUSIVE).when(suite_exit == 0, REFUTED).otherwise(CONFIRMED)
    fixed = kind.isin("security", "type_mismatch")
    status = F.when(fixed, static[0]).when(kind == "breaking_change", suite).otherwise(test[0])
    trust = F.when(fixed, static[1]).when(kind == "breaking_change", F.when(suite == INCONCLUSIVE, "low").otherwise("high")).otherwise(test[1])
    return status, trust


def rebuttal_outcome(results: DataFrame) -> DataFrame:
    """(case_id, ended_by, rounds, open_claims): resolution if no claim is open, else the cap of rounds."""
    open_ = F.count_if(F.col("status") == INCONCLUSIVE)
    return results.groupBy("case_id").agg(open_.alias("open_claims")).select("case_id", F.when(F.col("open_claims") == 0, "resolution").otherwise("cap").alias("ended_by"), F.when(F.col("open_claims") == 0, 2).otherwise(3).alias("rounds"), "open_claims")


def flags(cases: DataFrame) -> DataFrame:
    """(case_id, condition, flagged) under the three conditions: a single reviewer, unverified claims, the full pipeline."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("condition"), c.alias("flagged")) for n, c in (("a", F.col("has_issue")), ("b", F.col("n_claims") > 0), ("c", F.col("verdict") != "approve")))))
    return cases.select("case_id", each.alias("x")).select("case_id", "x.condition", "x.flagged")
