from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plinth.config import Settings
from plinth.operators import syntax
from plinth.plans.pipeline import Engine
from plinth.sources.files import discover, eval_cases, graph_from_json, graph_to_json, parse_repository_url

PY_A = '''from pkg.util import helper


class Base:
    def run(self):
        return self.step()

    def step(self):
        return helper(1)


class Child(Base):
    async def go(self):
        return Base.run(self)


@decorated
def top():
    def inner():
        return top()
    return inner
'''
PY_UTIL = "def helper(x):\n    return x + 1\n"
JS = """import { x } from './lib';
const y = require("./other");
class Box extends Crate {
  open(a) { if (a) { return this.shut(); } }
  shut() { return fetchAll(`a ${1} }`); }
}
async function load(u) { return new Box().open(u); }
const pick = (a, b) => { return load(a); };
app.use(pick);
start(load);
"""


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, content in {"pkg/a.py": PY_A, "pkg/util.py": PY_UTIL, "pkg/broken.py": "def (:\nimport os\n", "web/box.js": JS, "web/lib.js": "export const x = 1;\n", "node_modules/z.js": "x", "notes.txt": "no", "pkg/bin.py": "\0\0", "tests/test_a.py": "from pkg.a import top\n\n\ndef test_top():\n    top()\n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    return str(root)


def test_discovery(spark, repo):
    assert {r.relative_path for r in discover(spark, repo).collect()} == {"pkg/a.py", "pkg/util.py", "pkg/broken.py", "web/box.js", "web/lib.js", "tests/test_a.py"}


def test_urls(spark):
    urls = ["https://github.com/a/b", " https://github.com/a/b.git/ ", "http://github.com/a/b", "https://github.com/a", "https://github.com/a/b/c"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(parse_repository_url(F.col("u"))).collect()]
    assert [x and (x.owner, x.name, x.clone_url) for x in got] == [("a", "b", "https://github.com/a/b.git")] * 2 + [None] * 3


def test_python_syntax():
    chunks = syntax.python_chunks(PY_A)
    assert [(c["chunk_type"], c["function_name"], c["class_name"]) for c in chunks] == [
        ("class", None, "Base"), ("method", "run", "Base"), ("method", "step", "Base"), ("class", None, "Child"), ("method", "go", "Child"), ("function", "top", None), ("function", "inner", None),
    ]
    assert chunks[5]["start_line"] == 17 and chunks[5]["raw_code"].startswith("@decorated") and chunks[3]["parent_class"] == "Base"
    calls = {(c["owner_name"], c["callee"], c["is_self"], c["qualifier"]) for c in syntax.python_calls(PY_A)}
    assert {("run", "step", True, None), ("go", "run", False, "Base"), ("inner", "top", False, None), ("top", "top", False, None)} <= calls
    assert syntax.python_imports("import a.b as c, d\nfrom ..x import y\nfrom . import z") == [("a.b", 0), ("d", 0), ("x", 2), ("", 1)]
    assert syntax.python_imports("def (:\nimport os\nfrom .m import n") == [("os", 0), ("m", 1)]


def test_script_syntax():
    chunks = syntax.js_chunks(JS)
    assert [(c["chunk_type"], c["function_name"], c["class_name"]) for c in chunks] == [
        ("class", None, "Box"), ("method", "open", "Box"), ("method", "shut", "Box"), ("async_function", "load", None), ("arrow_function", "pick", None),
    ]
    calls = {(c["owner_name"], c["callee"], c["is_self"], c["is_reference"]) for c in syntax.js_calls(JS)}
    assert {("open", "shut", True, False), ("shut", "fetchAll", False, False), ("pick", "load", False, False), (None, "use", False, False), (None, "start", False, False), (None, "pick", False, True), (None, "load", False, True)} <= calls
    assert [m for m, _ in syntax.js_imports(JS)] == ["./lib", "./other"]
    with pytest.raises(SyntaxError):
        syntax.js_chunks("function f( {")


@pytest.fixture(scope="module")
def engine(spark, repo, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    return e, e.index(repo, "o", "n")


def test_index_is_incremental(engine, repo):
    e, first = engine
    assert first["files"] == 6 and first["chunks"] > 10 and first["embedded"] == 14
    again = e.index(repo, "o", "n")
    assert (again["files"], again["chunks"], again["edges"], again["embedded"]) == (0, 0, 0, 0)
    assert e.status(first["repository_id"])["state"] == "ready" and e.status("zz")["state"] == "unknown"


def test_edges(engine):
    e, first = engine
    rid = first["repository_id"]
    names = {r.chunk_id: r.function_name or r.class_name for r in e.chunks(rid).collect()}
    paths = {r.file_id: r.relative_path for r in e.store.read("source_files").collect()}
    got = {(names.get(r.src) or paths.get(r.src), names.get(r.dst) or paths.get(r.dst), r.edge_type) for r in e.graph(rid).collect()}
    assert {("Base", "run", "contains"), ("Child", "Base", "inherits"), ("run", "step", "method_call"), ("step", "helper", "function_call"), ("test_top", "top", "function_call"), ("tests/test_a.py", "pkg/a.py", "imports"), ("web/box.js", "pick", "references")} <= got
    with pytest.raises(KeyError):
        e.graph(rid, "nobody")


def test_ask_and_cache(spark, engine):
    e, first = engine
    rid = first["repository_id"]
    q = spark.createDataFrame([(1, "where is the helper function that adds one")], "query_id int, query string")
    found = e.search(rid, q).orderBy("rank").collect()
    assert found and found[0].rank == 1 and len({r.chunk_id for r in found}) == len(found)
    one = e.ask(rid, q).first()
    assert not one.from_cache and one.total_tokens > 0 and "helper" in one.context
    two = e.ask(rid, q).first()
    assert two.from_cache and two.answer == one.answer
    off = Engine(spark, e.root, Settings(use_hybrid=False, use_graph=False, use_rerank=False, use_parents=False, use_cache=False))
    assert off.ask(rid, q).first().from_cache is False


def test_context_and_review(spark, engine):
    e, first = engine
    rid = first["repository_id"]
    assert e.context_at(rid, "pkg/a.py", 6).orderBy("rank").first().function_name == "run"
    diff = "--- a/pkg/a.py\n+++ b/pkg/a.py\n@@ -19,1 +19,1 @@\n-        return top()\n+        return None\n"
    roles = {r.role for r in e.review(rid, spark.createDataFrame([(1, diff)], "diff_id int, diff string")).collect()}
    assert "callee" in roles or "caller" in roles


def test_command_line_and_views(spark, engine, repo, capsys):
    from plinth.__main__ import main

    e, first = engine
    rid = first["repository_id"]
    assert main(["--store", e.root, "status", rid], spark) == 0 and '"ready"' in capsys.readouterr().out
    assert main(["--store", e.root, "search", rid, "helper"], spark) == 0 and "chunk_id" in capsys.readouterr().out
    assert main(["--store", e.root, "graph", rid], spark) == 0 and "edge_type" in capsys.readouterr().out
    assert main(["--store", e.root, "query", "zz", "helper"], spark) == 1
    assert "code_chunks" in e.register_views()
    assert spark.sql("SELECT count(*) AS n FROM code_chunks").first().n == e.store.read("code_chunks").count()


def test_gate_and_states(spark, engine, repo, tmp_path, monkeypatch):
    from plinth.plans import pipeline

    e, first = engine
    rid = first["repository_id"]
    assert e.status(rid)["repository"]["owner"] == "o" and e.require_ready(rid) is None
    with pytest.raises(pipeline.UnknownRepository):
        e.require_ready("zz")
    other = Engine(spark, str(tmp_path / "store"))
    done = other.index(repo, "o", "n")
    before = other.store.read("graph_edges").count()
    plain = Engine.edges
    stray = lambda self, files, code: plain(self, files, code).unionByName(spark.createDataFrame([("nobody", "none", "call")], "src string, dst string, edge_type string"))
    monkeypatch.setattr(Engine, "edges", stray)
    with pytest.raises(pipeline.InvalidRequest) as error:
        other.index(repo, "o", "n", "replace")
    assert pipeline.http_status(error.value) == 400 and pipeline.http_status(KeyError("x")) == 500
    assert other.store.read("graph_edges").count() == before  # nothing was written
    assert other.status(done["repository_id"])["state"] == "failed"
    with pytest.raises(pipeline.NotReady):
        other.require_ready(done["repository_id"])
    monkeypatch.undo()
    again = other.index(repo, "o", "n", "replace")
    assert again["chunks"] == again["edges"] == 0 and other.store.read("graph_edges").count() == before and other.status(done["repository_id"])["state"] == "ready"
    for _ in range(2):
        other.snapshot(done["repository_id"])
    assert other.store.read("graph_snapshots").count() == 1


def test_related_tests(spark, engine):
    e, first = engine
    rid = first["repository_id"]
    names = {r.chunk_id: (r.file_path, r.function_name) for r in e.chunks(rid).collect()}
    line = {n: r.start_line for r in e.chunks(rid).collect() for n in [r.function_name] if n}
    at = line["helper"]
    diff = f"--- a/pkg/a.py\n+++ b/pkg/a.py\n@@ -{at},1 +{at},1 @@\n-x\n+y\n"
    bundled = e.review(rid, spark.createDataFrame([(1, diff)], "diff_id int, diff string"))
    got = e.related_tests(rid, bundled).collect()
    assert all("test" in names[r.test_id][0] for r in got)
    assert {r.found_via for r in got} <= {"graph", "search"}


def test_batched_encoder_and_retries(spark):
    from plinth.models import batched_encoder, retried

    sizes = batched_encoder(lambda: lambda texts: [[len(t), len(texts)] for t in texts], 2, batch=3)
    rows = spark.createDataFrame([("a" * i if i else None,) for i in range(7)], "t string").coalesce(1).select(sizes(F.col("t")).alias("v")).collect()
    assert [r.v[0] for r in rows] == list(range(7)) and max(r.v[1] for r in rows) == 3
    wrong = batched_encoder(lambda: lambda texts: [[1.0] for _ in texts], 2)
    with pytest.raises(Exception, match="width 2"):
        spark.createDataFrame([("a",)], "t string").select(wrong(F.col("t"))).collect()
    calls, waits = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ConnectionError
        return x

    assert retried(flaky, sleep=waits.append)(5) == 5 and waits == [15.0, 15.0]
    with pytest.raises(TimeoutError):
        retried(lambda: (_ for _ in ()).throw(TimeoutError()), attempts=2, sleep=waits.append)()


def test_prompts(spark):
    from plinth.functions import prompts

    claim = F.array(F.struct(F.lit("security").alias("claim_type"), F.lit("a.py:3").alias("location"), F.lit("unsafe").alias("assertion"), F.lit("confirmed").alias("status"), F.lit("high").alias("confidence")))
    row = spark.range(1).select(
        prompts.judge_prompt(F.lit("+x"), F.array(F.lit("fine"), F.lit("not fine")), claim, F.lit("cap")).alias("judge"),
        prompts.answer_prompt(F.lit("why?"), F.lit("")).alias("answer"),
        prompts.bundle_text(F.array(F.lit("f"), F.lit("g")), F.array().cast("array<string>"), F.array(F.lit("h")), F.array().cast("array<string>")).alias("bundle"),
    ).first()
    assert row.judge == "## Diff\n+x\n\n## Debate\nRound 1:\nfine\n\nRound 2:\nnot fine\n\n## Claims\n1. [security] a.py:3: unsafe -> confirmed (high)\n\n## Ended by\ncap"
    assert row.answer == "## Code\nnone found\n\n## Question\nwhy?"
    assert row.bundle == "## Changed functions\n- f\n- g\n\n## Callees\n- h"


def test_json_sources(spark, tmp_path):
    good = '[{"repository_id": "r", "query": "q", "expected_answer": "a", "expected_source_files": ["x"], "expected_functions": []}]'
    (tmp_path / "e.json").write_text(good)
    assert eval_cases(spark, str(tmp_path / "e.json")).count() == 1
    (tmp_path / "f.json").write_text(good.replace('"query": "q", ', ""))
    with pytest.raises(Exception, match="missing field query"):
        eval_cases(spark, str(tmp_path / "f.json")).collect()
    nodes = spark.createDataFrame([("a", "chunk")], "id string, node_kind string")
    edges = spark.createDataFrame([("a", "a", "function_call")], "src string, dst string, edge_type string")
    n, k = graph_from_json(graph_to_json(nodes, edges), "graph_data")
    assert n.first().id == "a" and k.first().edge_type == "function_call"


@pytest.mark.parametrize("bad", [{"final_k": 0}, {"expansion_decay": 1.0}, {"window_overlap": 1.0}, {"rrf_k": 0}, {"blast_hops": -1}])
def test_settings(bad):
    with pytest.raises(ValueError):
        Settings(**bad)
