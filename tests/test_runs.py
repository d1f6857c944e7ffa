from __future__ import annotations

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from plinth.plans import evaluate, reviews
from plinth.plans.pipeline import Engine
from plinth.sources.repository import RepositoryError, acquire

CLAIM = {"claim_type": "security", "location": "a.py:3", "assertion": "x", "proposed_test": "y"}
VERDICT = {"verdict": "reject", "confidence": 0.8, "cited_evidence": ["e"], "minority_report": None}


def agents(second_try: bool = False, confidence: float = 0.6):
    good = F.lit(json.dumps([CLAIM, CLAIM | {"assertion": "z"}]))
    return reviews.Agents(
        defend=lambda s, d: F.concat(F.lit("fine: "), s),
        accuse=lambda s, d, t, i: F.lit("garbage") if second_try and i == 0 else F.when(s == "clean", F.lit("[]")).otherwise(good),
        rebut=lambda d, last, facts: F.concat(last, F.lit("!")),
        judge=lambda t, c, e, i: F.lit(json.dumps(VERDICT | {"confidence": confidence if i else 0.9})),
    )


def test_review_events(spark):
    cases = spark.createDataFrame([(1, "d", "dirty", ["a.py"]), (2, "d", "clean", ["a.py"]), (3, "d", "lost", [])], "diff_id int, diff string, summary string, files array<string>")
    evidence = spark.createDataFrame([(1, 0, "confirmed", "high")], "diff_id int, claim_index int, status string, confidence string")
    who = agents(second_try=True)
    drafted = reviews.draft(cases, who)
    assert reviews.claims_of(drafted).where("diff_id = 1").count() == 2
    decided = reviews.decide(drafted, evidence, who)
    by = {r.diff_id: r for r in decided.collect()}
    assert (by[1].ended_by, by[1].rounds, by[1].open_claims, by[1].verdict.confidence) == ("cap", 3, 1, 0.6)  # 0.9 would be too sure
    assert (by[2].ended_by, by[2].rounds, by[2].verdict.confidence, by[2].rebuttal_2) == ("resolution", 2, 0.9, None)
    log = reviews.events(decided)
    kinds = {i: [r.type for r in log.where(F.col("diff_id") == i).orderBy("seq").collect()] for i in (1, 2, 3)}
    assert kinds[1] == ["context", "defender", "claims", "claim_verified", "claim_verified", "rebuttal", "rebuttal", "judge", "done"]
    assert kinds[2] == ["context", "defender", "claims", "rebuttal", "judge", "done"]
    assert kinds[3] == ["context", "error"]
    assert {r.type for r in reviews.latest_event(log).collect()} == {"done", "error"}
    never = reviews.decide(reviews.draft(cases.where("diff_id = 1"), agents(confidence=0.95)), evidence, agents(confidence=0.95))
    assert [r.type for r in reviews.events(never).orderBy("seq").collect()][-1] == "error"
    truth = spark.createDataFrame([(1, True), (2, False)], "case_id int, is_buggy boolean")
    got = {(r.case_id, r.condition): r.flagged for r in reviews.outcomes(truth, decided.where("diff_id < 3"), lambda s, d: s == "dirty").collect()}
    assert got == {(1, "a"): True, (1, "b"): True, (1, "c"): True, (2, "a"): False, (2, "b"): False, (2, "c"): True}


def test_ablation(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "parse.py").write_text("def parse_tokens(text):\n    return text.split()\n")
    (src / "draw.py").write_text("def draw_graph(nodes):\n    return nodes\n")
    engine = Engine(spark, str(tmp_path / "store"))
    rid = engine.index(str(src), "o", "n")["repository_id"]
    cases = spark.createDataFrame([(1, "parse tokens of a text", ["parse.py"])], "query_id int, query string, expected_source_files array<string>")
    report = evaluate.ablation(engine, rid, cases, evaluate.by_expected_files(cases), lambda a, c: F.lit(1.0)).cache()
    assert [r.config_name for r in report.collect()] == list(evaluate.CONFIGURATIONS)
    assert all(r.precision_at_5 == 0.5 and r.faithfulness == 1.0 for r in report.collect())
    evaluate.save_report(report, str(tmp_path / "r"))
    assert evaluate.best_row(evaluate.load_reports(spark, str(tmp_path / "r"))).count() == 1
    a = spark.createDataFrame([("x", 1), ("y", 1)], "case_id string, v int")
    assert {(r.case_id, r.v) for r in evaluate.append_cases(a, a.where("case_id = 'x'").withColumn("v", F.lit(2))).collect()} == {("x", 2), ("y", 1)}


def test_repository(tmp_path):
    def git(*args, cwd):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", *args], cwd=cwd, check=True, capture_output=True)

    origin = tmp_path / "origin"
    origin.mkdir()
    git("init", "-q", "-b", "main", cwd=origin)
    (origin / "a.py").write_text("x = 1\n")
    git("add", ".", cwd=origin)
    git("commit", "-qm", "one", cwd=origin)
    one = acquire(str(origin), "o", "n", str(tmp_path / "base"))
    (origin / "a.py").write_text("x = 2\n")
    git("commit", "-qam", "two", cwd=origin)
    two = acquire(str(origin), "o", "n", str(tmp_path / "base"))
    assert one.default_branch == "main" and one.commit != two.commit and two.local_path.endswith("o_n")
    with pytest.raises(RepositoryError):
        acquire(str(tmp_path / "nowhere"), "o", "m", str(tmp_path / "base"))
