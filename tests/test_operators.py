from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from plinth.functions.text import BLOCK_SEPARATOR
from plinth.operators import cache, chunking, context, dense, fusion, graph, metrics, resolve, review, sparse, tables
from plinth.operators.ranking import keep_first

# --- sparse, dense, fusion ---


def plain_bm25(docs, question):
    from tests.test_functions import plain_tokens

    toks = {i: plain_tokens(t) for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: low if v < 0 else v for w, v in idf.items()}
    return {i: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in plain_tokens(question)) for i, t in toks.items()}


def test_bm25_like_the_formula(spark):
    docs = [(1, "parse the file"), (2, "parse parse tree node"), (3, "the the the graph"), (4, ""), (5, "renderGraph node")]
    index = sparse.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    for question in ("parse node node", "the", "nothing here"):
        found = sparse.search(index, spark.createDataFrame([(1, question)], "query_id int, query string"), 5).orderBy("rank").collect()
        want = sorted(plain_bm25(docs, question).items(), key=lambda x: (-round(x[1], 9), x[0]))
        assert [r.doc_id for r in found] == [i for i, _ in want]
        assert [r.score for r in found] == pytest.approx([s for _, s in want])
    assert sparse.search(index, spark.createDataFrame([(1, "  !")], "query_id int, query string"), 5).count() == 0


def test_bm25_with_shuffled_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha{i % 7} beta{i % 3} gamma") for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"alpha{i} beta{i % 3} beta{i % 3}") for i in range(5)], "query_id int, query string")
    found = []
    for few in (200_000, 0):
        monkeypatch.setattr(sparse, "BROADCAST_TERMS", few)
        found.append(sorted((r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in sparse.search(sparse.build_index(docs), asked, 7).collect()))
    assert found[0] == found[1] and len(found[0]) == 35


def test_bm25_shuffles_neither_postings_nor_scores(spark):
    docs = spark.createDataFrame([(i, f"alpha{i % 7} beta{i % 3} gamma") for i in range(60)], "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(1, "alpha1 gamma"), (2, "zeta")], "query_id int, query string")
    index = sparse.build_index(docs)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan(index.postings) and "Join" not in plan(sparse.search(index, asked, 7))
    assert [r.doc_id for r in sparse.search(index, asked, 7).where("query_id = 2").orderBy("rank").collect()] == list(range(7))


def test_bm25_reads_texts_without_making_postings(spark, monkeypatch, tmp_path):
    """An index that is not stored is searched by one step over the texts, with the scores that the stored postings give."""
    monkeypatch.setattr(sparse, "TEXT_BYTES", 40)
    docs = [(i, None if i % 9 == 0 else "" if i % 9 == 1 else " ".join(f"word{chr(97 + i * j % 11)}Tree" for j in range(i % 8))) for i in range(90)]
    index = sparse.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    asked = spark.createDataFrame([(1, "wordaTree wordb wordb"), (2, "wordc tree"), (3, "unknown")], "query_id int, query string")
    index.save(str(tmp_path / "x"))
    stored = sparse.search(sparse.SparseIndex.load(spark, str(tmp_path / "x")), asked, 30)
    found = sparse.search(index, asked, 30)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    found, stored = (sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect()) for df in (found, stored))
    assert found == stored and len(found) == 90


def test_bm25_in_slices_and_small_blocks(spark, monkeypatch):
    docs = [(i, " ".join(f"word{(i * j) % 11}" for j in range(i % 9)) if i % 5 else None) for i in range(80)]
    asked = [(f"q{i}", f"word{i} word{i + 1} word{i % 3} word{i} unknown") for i in range(9)] + [("none", "?!"), ("far", "unknown")]
    index = sparse.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    q = spark.createDataFrame(asked, "query_id string, query string")
    want = {}
    for name, question in asked:
        by = plain_bm25([(i, t or "") for i, t in docs], question)
        want[name] = [i for i, _ in sorted(by.items(), key=lambda x: (-round(x[1], 9), x[0]))[:6]]
    del want["none"]
    for slices in (4096, 2):
        monkeypatch.setattr(sparse, "QUERY_SLICE", slices)
        got = {}
        for r in sparse.search(index, q, 6).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.doc_id)
        assert got == want


def test_blocks_cut_at_any_size(monkeypatch):
    import numpy as np
    import pyarrow as pa

    words, n = pa.array(["a", "b", "c"]), 40
    lists = pa.array([[w for j, w in enumerate("abcd") if (i >> j) & 1] for i in range(n)], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([4] * n), lists, pa.array([[1 + i % 3] * len(x) for i, x in enumerate(lists.to_pylist())], pa.list_(pa.int64()))], names=["doc_id", "len", "terms", "tfs"])
    asked = sparse._Asked(pa.array([7, 8]), words, np.array([0, 2, 3, 4]), np.array([0, 1, 1, 0]), np.array([1.0, 2.0, 3.0, 5.0]))
    found = []
    for size in (1_000_000, 7, 1):
        monkeypatch.setattr(sparse, "BLOCK_SCORES", size)
        parts = [s for piece in sparse.cut(batch, pa.array([1] * n), size) for s, _ in sparse._scored(piece, asked, 1.5, 0.75, 4.0)]
        found.append(np.concatenate(parts))
    assert found[0].shape == (n, 2) and all((x == found[0]).all() for x in found)
    assert found[0][5].tolist() == [2.5 * 6 * 3 / (3 + 1.5), 2.5 * 2 * 3 / (3 + 1.5)]  # a and c, three times each


def test_best_keeps_smaller_ids_of_equal_scores():
    import numpy as np
    import pyarrow as pa

    from plinth.operators.blocks import Best

    best = Best(2, 2)
    blocks = (([5, 6, 9], [[0, 1], [0, -np.inf], [0, 0]], 4), ([7, 3, 8], [[0, 0], [0, 0], [0, 2]], 8), ([1, 2, 4], [[0, np.nan], [-1, 1], [1, 0]], 13))
    for ids, scores, held in blocks:
        best.add(np.array(scores, dtype=float), pa.array(ids))
        assert best.held == held  # a row that ties with the k-th and has a larger id is not held
    found = best.reduce()
    assert list(zip(found["query"].to_pylist(), found["id"].to_pylist(), strict=True)) == [(0, 4), (0, 1), (1, 1), (1, 8)]


def test_parts_of_many_texts(spark):
    import random

    import pyarrow as pa

    from plinth.functions.parts import parts
    from plinth.functions.text import tokens
    from tests.test_functions import plain_tokens

    rng = random.Random(3)
    texts = ["", None, "parseHTTPRequest2x", "A", "b", "É1aßB", "x" * 70] + ["".join(rng.choice("abAB12 _é") for _ in range(rng.randrange(12))) for _ in range(3000)]
    found, ends = parts(pa.array([t and t.encode() for t in texts], pa.binary()).slice(1))
    got = [found.slice(ends[i], ends[i + 1] - ends[i]).to_pylist() for i in range(len(texts) - 1)]
    assert got == [plain_tokens(t or "") for t in texts[1:]]
    rows = spark.createDataFrame(list(enumerate(texts[1:])), "i int, t string").select("i", tokens(F.col("t")).alias("w")).orderBy("i").collect()
    assert got == [r.w for r in rows]
    none, ends = parts(pa.array([b"\xff", b"a\xffB", None], pa.binary()))
    assert none.to_pylist() == ["a", "b"] and ends.tolist() == [0, 0, 2, 2]


def test_empty_indexes(spark):
    index = sparse.build_index(spark.createDataFrame([], "doc_id long, text string"))
    assert sparse.search(index, spark.createDataFrame([(1, "x")], "query_id int, query string"), 5).count() == 0
    none = dense.build_index(spark.createDataFrame([], "i long, v array<float>"), "i", "v")
    assert dense.search(none, spark.createDataFrame([(1, [1.0])], "query_id int, vector array<double>"), 3).count() == 0


def test_sparse_index_round_trip(spark, tmp_path):
    index = sparse.build_index(spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string"))
    index.save(str(tmp_path / "x"))
    q = spark.createDataFrame([(1, "c")], "query_id int, query string")
    assert sparse.search(sparse.SparseIndex.load(spark, str(tmp_path / "x")), q, 2).collect() == sparse.search(index, q, 2).collect()


def test_dense_order_and_width(spark):
    v = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "i int, v array<float>")
    found = dense.search(dense.build_index(v, "i", "v", 2), spark.createDataFrame([(7, [5.0, 0.0])], "query_id int, vector array<double>"), 9).orderBy("rank").collect()
    assert [(r.id, r.score) for r in found] == [(1, 1.0), (2, 1.0), (3, 0.0), (4, 0.0)]
    with pytest.raises(Exception, match="length 2"):
        dense.build_index(v, "i", "v", 3).collect()


def test_fillers_rank_above_hits_that_weigh_less_than_nothing(spark):
    """Every term is in most documents, so hits score below 0 and the documents without a hit lead."""
    docs = spark.createDataFrame([(i, "common" if i < 1200 else "other rare" if i == 1250 else "") for i in range(1300)], "doc_id long, text string")
    index = sparse.build_index(docs, epsilon=-1.0)
    asked = spark.createDataFrame([(1, "common"), (2, "unknown"), (3, "rare common")], "query_id int, query string")
    got = {}
    for r in sparse.search(index, asked, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert [d for d, _ in got[1]] == list(range(1200, 1220)) and {s for _, s in got[1]} == {0.0}
    assert [d for d, _ in got[2]] == list(range(20))
    assert got[3][0][0] == 1250 and got[3][0][1] > 0 and [d for d, _ in got[3][1:]] == list(range(1200, 1219))


def test_dense_search_in_slices_and_with_repeated_ids(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(700, 8))
    vectors[300:500] = vectors[7]  # ties go to the smaller id
    asked = vectors[:260].copy()
    asked[10] = 0
    index = dense.build_index(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, v array<double>").repartition(5), "vec_id", "v", 8)
    q = spark.createDataFrame([(i % 250, v.tolist()) for i, v in enumerate(asked)], "query_id int, vector array<double>")
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    score = unit(asked) @ unit(vectors).T
    want = {}
    for i in range(250):
        rows = [(-round(float(score[j, d]), 9), d) for j in range(i, 260, 250) for d in range(700)]
        want[i] = [d for _, d in sorted(rows)[:5]]
    for size in (4096, 30):
        monkeypatch.setattr(dense, "QUERY_SLICE", size)
        got = {}
        for r in dense.search(index, q, 5).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want
    assert dense.search(index, q.limit(0), 5).count() == 0 and dense.search(index.limit(0), q, 5).count() == 0


def test_places_of_hops_do_not_overlap(spark, monkeypatch):
    """With room for few discoveries a hop, places of two hops overlap; with PLACE_BITS they can't, since row numbers are 32-bit integers."""
    steps = spark.createDataFrame([("s", f"a{i}", "x", 0) for i in range(40)] + [(f"a{i}", f"b{i}", "x", 0) for i in range(40)], "src string, dst string, edge_type string, side int")
    seeds = spark.createDataFrame([(1, "s", 1.0, 1)], "query_id int, id string, score double, rank int")
    rows = graph.expand(seeds, steps, 2).collect()
    places = {h: [r.place for r in rows if r.distance == h] for h in (1, 2)}
    assert len(places[1]) == len(places[2]) == 40 and max(places[1]) < min(places[2]) and graph.PLACE_BITS == 32


def test_plans_of_hops_do_not_grow(spark, net):
    edges, nodes = net
    seeds = spark.createDataFrame([(1, "A", 1.0, 1)], "query_id int, id string, score double, rank int")
    size = lambda hops: graph.expand(seeds, graph.fan_out(edges, nodes), hops)._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert size(2) == size(4)


def test_fusion(spark):
    d = spark.createDataFrame([(1, "a", 0.9, 1), (1, "a", 0.9, 2), (1, "b", 0.8, 3)], "query_id int, id string, score double, rank int")
    s = spark.createDataFrame([(1, "b", 7.0, 1), (1, "c", 6.0, 2)], "query_id int, id string, score double, rank int")
    out = fusion.fuse(d, s, 8).orderBy("rank").collect()
    assert [(r.id, r.source) for r in out] == [("b", "hybrid"), ("a", "dense"), ("c", "sparse")]
    assert out[0].fused_score == pytest.approx(1 / 62 + 1 / 61)
    with pytest.raises(ValueError, match="rrf_k"):
        fusion.fuse(d, s, 8, 0)


# --- graph ---

EDGES = [("A", "B", "function_call"), ("B", "G", "function_call"), ("D", "C", "inherits"), ("D", "E", "contains"), ("f1", "f2", "imports"), ("A", "A", "function_call")]
NODES = [("A", "chunk", "f1"), ("D", "chunk", "f1"), ("E", "chunk", "f1"), ("B", "chunk", "f2"), ("C", "chunk", "f2"), ("Z", "chunk", "f3"), ("G", "chunk", "f4"), *((f, "file", f) for f in ("f1", "f2", "f3", "f4"))]


@pytest.fixture
def net(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, edge_type string"), spark.createDataFrame(NODES, "id string, node_kind string, file_id string")


def test_expansion(spark, net):
    edges, nodes = net
    steps = graph.fan_out(edges, nodes)
    seeds = spark.createDataFrame([(1, "B", 0.8, 1), (1, "unknown", 0.7, 2)], "query_id int, id string, score double, rank int")
    one = {r.id: r for r in graph.expand(seeds, steps, 1).collect()}
    assert set(one) == {"B", "unknown", "A", "G"}
    assert (one["A"].score, one["A"].distance, one["A"].origin, one["B"].distance) == (0.4, 1, "B", 0)
    two = {r.id: r for r in graph.expand(seeds, steps, 2).collect()}
    assert two["C"].score == pytest.approx(0.2)  # over the import of A's file
    assert two["B"].score == 0.8 and two["B"].distance == 0
    ranks = graph.expansion_order(graph.expand(seeds, steps, 2)).orderBy("rank").collect()
    assert [r.id for r in ranks[:2]] == ["B", "unknown"]
    with pytest.raises(ValueError, match="hops"):
        graph.expand(seeds, steps, 0)


def test_better_of_two_paths(spark):
    steps = spark.createDataFrame([("s1", "x", "c", 1), ("s2", "x", "c", 1)], "src string, dst string, edge_type string, side int")
    seeds = spark.createDataFrame([(1, "s1", 0.2, 1), (1, "s2", 0.9, 2)], "query_id int, id string, score double, rank int")
    x = graph.expand(seeds, steps, 1).where("id = 'x'").first()
    assert (x.score, x.origin) == (0.45, "s2")


def test_blast_radius(spark):
    edges = spark.createDataFrame([("A", "B", "c"), ("B", "C", "c"), ("C", "D", "c"), ("D", "E", "c"), ("A", "C", "c")], "src string, dst string, edge_type string")
    focus = spark.createDataFrame([("B",)], "id string")
    assert {(r.id, r.hop) for r in graph.blast_radius(edges, focus, 1).collect()} == {("B", 0), ("A", 1), ("C", 1)}
    inside = graph.induced(edges, graph.blast_radius(edges, focus, 1).select("id"))
    assert ("A", "C") in {(r.src, r.dst) for r in inside.collect()}  # not on any path of the search
    assert graph.blast_radius(edges, focus, 6).count() == 5
    assert graph.blast_radius(edges, focus, 0).count() == 1
    with pytest.raises(ValueError, match="hops"):
        graph.blast_radius(edges, focus, -1)


def test_neighbours_and_census(spark, net):
    edges, nodes = net
    ask = spark.createDataFrame([("A",), ("B",)], "id string")
    assert {(r.id, r.neighbor) for r in graph.neighbors(edges, ask).collect()} == {("A", "B"), ("A", "A"), ("B", "A"), ("B", "G")}
    assert {r.caller for r in graph.callers(edges, ask).where("id = 'B'").collect()} == {"A"}
    assert {r.id for r in graph.isolated(nodes, edges).collect()} == {"Z", "f3", "f4"}
    assert graph.missing_nodes(edges, nodes).count() == 0
    assert {(r.focus, r.other, r.role) for r in graph.classify(edges, ask).collect()} == {("B", "A", "caller"), ("B", "G", "callee"), ("A", "B", "callee")}


# --- resolution ---


def test_call_tiers(spark):
    symbols = spark.createDataFrame(
        [("f1", "m", "method", "run", "Box", 1), ("f1", "n", "method", "run", "Bag", 2), ("f2", "g", "function", "go", None, 3), ("f1", "h", "function", "go", None, 4), ("f2", "o", "method", "only", "Bag", 5)],
        "file_id string, id string, kind string, name string, class_name string, ordinal int",
    )
    sites = spark.createDataFrame(
        [(1, "x", "f9", "Bag", "run", True, None), (2, "x", "f9", None, "run", False, "Box"), (3, "x", "f1", None, "go", False, None), (4, "x", "f9", None, "go", False, None), (5, "x", "f9", None, "only", False, None), (6, "x", "f9", None, "nope", False, None)],
        "site_id int, src string, file_id string, caller_class string, callee string, is_self boolean, qualifier string",
    )
    got = {r.site_id: (r.dst, r.edge_type) for r in resolve.calls(sites, symbols).collect()}
    assert got == {1: ("n", "method_call"), 2: ("m", "method_call"), 3: ("h", "function_call"), 4: ("g", "function_call"), 5: ("o", "method_call")}


def test_imports(spark):
    files = spark.createDataFrame([("pkg/a.py", "a", "python"), ("pkg/__init__.py", "i", "python"), ("pkg/sub/b.py", "b", "python"), ("web/x.js", "x", "javascript"), ("web/y/index.js", "y", "javascript")], "relative_path string, file_id string, language string")
    refs = spark.createDataFrame(
        [("b", "pkg/sub", "python", "a", 2), ("b", "pkg/sub", "python", "", 2), ("b", "pkg/sub", "python", "pkg.a", 0), ("x", "web", "javascript", "./y", 0), ("y", "web/y", "javascript", "../x", 0), ("x", "web", "javascript", "react", 0), ("a", "pkg", "python", "pkg.a", 0)],
        "file_id string, directory string, language string, module string, level int",
    )
    assert {(r.src, r.dst) for r in resolve.imports(refs, files).collect()} == {("b", "a"), ("b", "i"), ("x", "y"), ("y", "x")}


# --- chunks and context ---


@pytest.mark.parametrize(("n", "starts"), [(0, []), (1, [1]), (50, [1]), (51, [1, 41]), (90, [1, 41]), (91, [1, 41, 81]), (130, [1, 41, 81])])
def test_windows(spark, n, starts):
    files = spark.createDataFrame([("f", "".join(f"line{i}\n" for i in range(n)))], "file_id string, text string")
    found = chunking.sliding(files).orderBy("start_line").collect()
    assert [r.start_line for r in found] == starts
    assert all(r.end_line == min(r.start_line + 49, n) and r.raw_code.count("\n") == r.end_line - r.start_line + 1 for r in found)


@pytest.mark.parametrize(("a", "b", "n", "want"), [(30, 39, 200, (10, 59)), (1, 2, 200, (1, 50)), (198, 200, 200, (151, 200)), (5, 9, 20, (1, 20)), (10, 90, 100, (10, 90))])
def test_parent_range(spark, a, b, n, want):
    x, y = chunking.parent_range(F.lit(a), F.lit(b), F.lit(n))
    assert tuple(spark.range(1).select(x.alias("a"), y.alias("b")).first()) == want


def test_enclosing(spark):
    chunks = spark.createDataFrame([("f", "big", 1, 500), ("f", "small", 100, 140), ("g", "other", 1, 500)], "file_id string, chunk_id string, start_line int, end_line int")
    points = spark.createDataFrame([(1, "f", 120), (2, "f", 141), (3, "f", 501)], "point_id int, file_id string, line int")
    found = {(r.point_id, r.rank): r.chunk_id for r in chunking.enclosing(points, chunks).collect()}
    assert found == {(1, 1): "small", (1, 2): "big", (2, 1): "big"}


def test_narrowest(spark):
    """The first of enclosing, over nested, equal, reversed and endless ranges."""
    n = F.col("id")
    start = (n * 7919 % 97 - 20).cast("int")
    width = F.when(n % 50 == 0, 100_000).when(n % 10 == 0, -1).otherwise(n * n % 31).cast("int")
    chunks = spark.range(600).select((n % 5).alias("file_id"), (n % 590).alias("chunk_id"), start.alias("start_line"), (start + width).alias("end_line"))
    points = spark.range(800).select(n.alias("point_id"), (n % 6).alias("file_id"), (n * 31 % 160 - 30).cast("int").alias("line"))
    want = {tuple(r) for r in chunking.enclosing(points, chunks).where("rank = 1").select("point_id", "chunk_id", "width").collect()}
    assert {tuple(r) for r in chunking.narrowest(points, chunks).collect()} == want
    assert len(want) > 400
    assert chunking.narrowest(points, chunks.limit(0)).isEmpty()


def _rows_made(df) -> int:
    """The most rows that any step of a finished plan made."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    seen, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(plan.plan())
        rows = plan.metrics().get("numOutputRows")
        seen = max(seen, rows.get().value() if rows.isDefined() else 0)
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return seen


def test_narrowest_makes_no_pairs(spark):
    n = F.col("id")
    chunks = spark.range(2000).select(F.lit("f").alias("file_id"), n.alias("chunk_id"), (n % 40).cast("int").alias("start_line"), (n % 40 + 60).cast("int").alias("end_line"))
    points = spark.range(2000).select(n.alias("point_id"), F.lit("f").alias("file_id"), (n % 20 + 40).cast("int").alias("line"))
    assert _rows_made(chunking.enclosing(points, chunks).where("rank = 1")) == 4_000_000
    assert _rows_made(chunking.narrowest(points, chunks)) < 40_000


def test_changed_functions_make_no_pairs(spark):
    n = F.col("id")
    chunks = spark.range(1000).select(n.alias("chunk_id"), F.lit("f").alias("file_id"), F.lit("f").alias("file_path"), F.when(n % 2 == 0, "function").otherwise("sliding").alias("chunk_type"), (n % 40).cast("int").alias("start_line"), (n % 40 + 60).cast("int").alias("end_line"))
    at = (n % 20 + 40).cast("int")
    locations = spark.range(1000).select(n.alias("diff_id"), F.lit(1).cast("bigint").alias("hunk"), F.lit("f").alias("file"), at.alias("old_start_line"), at.alias("old_end_line"))
    met = review.changed_functions(locations, chunks)
    assert _rows_made(met) < 40_000
    assert {(r.diff_id, r.chunk_id) for r in met.collect()} == {(i, 0) for i in range(1000)}  # all are of one width, and the first starts first


def test_best_of_blocks(monkeypatch):
    """Small blocks with ties and NaN give what sorting everything gives, and hold no more than their bound."""
    import numpy as np
    import pyarrow as pa

    from plinth.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_SCORES", 70)
    assert blocks.block_rows(7) == 10
    scores = np.random.default_rng(1).integers(0, 40, (500, 7)) / 40.0
    scores[33, 2] = np.nan
    kept, most = blocks.Best(7, 5), 0
    for at in range(0, 500, 10):
        kept.add(scores[at : at + 10], pa.array(range(at, min(at + 10, 500))))
        most = max(most, kept.held)
    got = kept.reduce().to_pydict()
    value = np.where(np.isnan(scores), np.inf, scores)
    want = [(q, i) for q in range(7) for i in sorted(range(500), key=lambda i: (-value[i, q], i))[:5]]
    assert list(zip(got["query"], got["id"], strict=True)) == want
    assert most <= 140


def test_expand_from_the_frontier(spark):
    """Edges reduced only at the frontier give the steps that reducing all of them gives."""
    n = F.col("id")
    edges = spark.range(400).select((n * 7 % 23).alias("src"), (n * n % 29).alias("dst"), F.when(n % 5 == 0, "imports").otherwise("function_call").alias("edge_type"), n.alias("o"))
    nodes = spark.range(30).select("id", F.lit("chunk").alias("node_kind"), (n % 6).alias("file_id"))
    seeds = spark.createDataFrame([(1, 3, 0.9, 1), (2, 4, 0.5, 1)], "query_id int, id long, score double, rank int")
    whole = graph.fan_out(graph.first_wins(edges, F.col("o")).select("src", "dst", "edge_type"), nodes)
    ids = seeds.select("id")
    some = graph.fan_out_from(edges, nodes, ids, F.col("o"))
    assert sorted(map(tuple, some.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").collect())) == sorted(map(tuple, whole.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").collect()))


CHUNK = "chunk_id string, file_id string, file_path string, language string, chunk_type string, function_name string, class_name string, parent_chunk_id string, raw_code string"


def test_context(spark):
    rows = [("p", "f", "m.py", "python", "parent", None, None, None, "P" * 40), *((c, "f", "m.py", "python", "function", c, None, "p", "x") for c in "ab"), ("c", "f", "m.py", "python", "function", "c", None, None, "C" * 400)]
    chunks = spark.createDataFrame(rows, CHUNK)
    matches = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "c", 3)], "query_id int, chunk_id string, rank int")
    one = context.build(matches, chunks, "r").first()
    assert one.display_ids == ["p", "c"] and one.chunk_ids == ["a", "c"] and not one.truncated
    assert one.context.count(BLOCK_SEPARATOR) == 1 and one.total_tokens == -(-len(one.context) // 4)
    small = context.build(matches, chunks, "r", budget=50).first()
    assert small.display_ids == ["p"] and small.truncated
    tiny = context.build(matches, chunks, "r", budget=1).first()
    assert tiny.display_ids == ["p"] and tiny.truncated  # the first block stays
    own = context.build(matches, chunks, "r", use_parents=False).first()
    assert own.display_ids == ["a", "b", "c"]
    with pytest.raises(Exception, match="unknown chunk"):
        context.build(spark.createDataFrame([(1, "zz", 1)], "query_id int, chunk_id string, rank int"), chunks, "r").collect()


def test_rerank(spark):
    c = spark.createDataFrame([(1, "a", "parse file", "nothing", 0.9, 1), (1, "b", "parse file", "parse file", 0.1, 2), (1, "b", "parse file", "parse file", 0.1, 3)], "query_id int, chunk_id string, query string, code string, previous_score double, place int")
    from plinth.models import overlap_scorer

    out = context.rerank(c, overlap_scorer, 5).orderBy("final_rank").collect()
    assert [(r.chunk_id, r.previous_score) for r in out] == [("b", 0.1), ("a", 0.9)]


# --- cache and tables ---


def test_cache(spark):
    entries = spark.createDataFrame(
        [("r", "how does the frontend start", [1.0, 0.0], "front", ["1"]), ("r", "how does the backend boot start", [0.99, 0.05], "back", ["2"]), ("s", "how does the backend start", [1.0, 0.0], "other", ["3"])],
        "repository_id string, query string, query_embedding array<double>, response string, retrieved_chunk_ids array<string>",
    )
    asked = spark.createDataFrame([(1, "r", "how does the backend start", [1.0, 0.0])], "query_id int, repository_id string, query string, vector array<double>")
    assert [r.response for r in cache.lookup(entries, asked).collect()] == ["back"]  # the closest one fails the gate, the other repository never counts
    assert cache.lookup(entries, asked, threshold=0.9999).count() == 0
    assert cache.clear(entries, "r").count() == 1


def test_cache_answers_every_question(spark):
    n = 2500
    entries = spark.createDataFrame([("r", f"what does part{i} do", [1.0, 0.0], str(i), ["1"]) for i in range(0, n, 100)], "repository_id string, query string, query_embedding array<double>, response string, retrieved_chunk_ids array<string>")
    asked = spark.createDataFrame([(i, "r", f"what does part{i} do", [1.0, 0.0]) for i in range(n)], "query_id int, repository_id string, query string, vector array<double>")
    got = cache.lookup(entries, asked, lexical=0.9)
    assert {(r.query_id, r.response) for r in got.collect()} == {(i, str(i)) for i in range(0, n, 100)}


def test_cache_equals_all_pairs(spark, monkeypatch):
    """Several repositories, ties, conflicts, texts without words, zero vectors, several blocks; texts are read once for each row, not for each pair."""
    from plinth.functions.text import lexically_compatible
    from plinth.functions.vectors import cosine

    n = F.col("id")
    words = F.array(*map(F.lit, ["login", "logout", "token", "parse", "read", "write", "cache", "graph", None, "the", "naïve", "GET", "post"]))
    said = lambda m: F.concat_ws(" ", *(F.get(words, (n * (7 * i + m) % 13).cast("int")) for i in range(1, 5)))
    vector = lambda m: F.array(*(F.when(n % 41 == 0, 0).otherwise((n * (i + m) % 5 - 2)).cast("float") for i in range(4)))
    entries = spark.range(700).select((n % 3).cast("string").alias("repository_id"), said(1).alias("query"), vector(1).alias("query_embedding"), n.cast("string").alias("response"), F.array(n.cast("string")).alias("retrieved_chunk_ids"))
    asked = spark.range(120).select(n.alias("query_id"), (n % 4).cast("string").alias("repository_id"), said(3).alias("query"), vector(2).alias("vector"))
    pairs = entries.withColumnRenamed("query", "cached_query").join(asked, "repository_id").withColumn("similarity", cosine(F.col("query_embedding"), F.col("vector"))).where((F.col("similarity") >= 0.3) & lexically_compatible(F.col("query"), F.col("cached_query"), 0.3))
    key = lambda df: {(r.query_id, round(r.similarity, 6), r.cached_query) for r in df.collect()}
    want = key(keep_first(pairs, ["query_id"], F.round("similarity", 9).desc(), F.col("cached_query")))
    assert len(want) > 20
    assert key(cache.lookup(entries, asked, 0.3, 0.3)) == want
    monkeypatch.setattr(cache, "PAIRS", 100)
    monkeypatch.setattr(cache, "QUESTION_SLICE", 50)
    found = cache.lookup(entries, asked, 0.3, 0.3)
    assert key(found) == want
    assert _rows_made(found) < 5000  # there are 21,000 pairs


def test_store(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "db"))
    rows = spark.createDataFrame([("r", "f1", "a.py", "python", ".py", 1), ("r", "f1", "a.py", "python", ".py", 1)], "repository_id string, file_id string, relative_path string, language string, extension string, size_bytes bigint")
    assert store.insert_only("source_files", rows) == 1
    assert store.insert_only("source_files", rows.withColumn("size_bytes", F.lit(9).cast("bigint"))) == 0
    assert store.read("source_files").first().size_bytes == 1
    store.upsert("source_files", rows.withColumn("size_bytes", F.lit(9).cast("bigint")), F.col("size_bytes"))
    assert [r.size_bytes for r in store.read("source_files").collect()] == [9]
    assert store.delete("source_files", "r") == 1 and store.read("source_files").count() == 0
    assert store.read("code_chunks").count() == 0


def test_a_store_survives_a_failed_change(spark, tmp_path, monkeypatch):
    store = tables.Store(spark, str(tmp_path / "s"))
    rows = lambda n: spark.createDataFrame([("r", f"c{i}", "m", 1, [0.5], None) for i in range(n)], "repository_id string, chunk_id string, model_name string, embedding_dimension int, embedding array<float>, created_at timestamp")
    store.replace("embeddings", rows(2))
    monkeypatch.setattr(tables.Store, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        store.replace("embeddings", rows(3))
    monkeypatch.undo()
    assert store.exists("embeddings") and store.read("embeddings").count() == 2
    store.replace("embeddings", rows(4))
    assert store.read("embeddings").count() == 4 and not store.exists("semantic_cache")


def test_edges_need_both_ends(spark):
    e = spark.createDataFrame([("r", "a", "b"), ("r", "a", "z"), ("q", "a", "b")], "repository_id string, source_chunk_id string, target_chunk_id string")
    c = spark.createDataFrame([("r", "a"), ("r", "b")], "repository_id string, chunk_id string")
    assert tables.known_edges(e, c).count() == 1
    assert tables.orphans(c.withColumn("parent", F.lit("zz")), c, "parent", "chunk_id").count() == 2


def test_decode_f32(spark):
    import struct

    numbers = [0.0, 1.5, -2.25, 1e-3, 123456.0]
    blob = bytearray(struct.pack("<5f", *numbers))
    assert spark.createDataFrame([(blob,)], "b binary").select(tables.decode_f32(F.col("b"), 5)).first()[0] == pytest.approx(numbers)


# --- metrics and review ---


def test_rates(spark):
    none = spark.createDataFrame([], "is_buggy boolean, flagged boolean, llm_calls int, total_tokens int, rounds_used int")
    r = metrics.review_rates(none).first()
    assert (r.catch_rate, r.false_positive_rate, r.avg_llm_calls, r.avg_rounds) == (0.0, 0.0, 0.0, None)
    some = spark.createDataFrame([(True, True, 1, 10, None), (True, False, 2, 20, 3), (False, True, 3, 30, 1)], none.schema)
    r = metrics.review_rates(some).first()
    assert (r.catch_rate, r.false_positive_rate, r.avg_rounds, r.n_buggy) == (0.5, 1.0, 2.0, 2)
    # published figures of a 13-case set
    assert 5 / 6 == pytest.approx(0.8333, abs=1e-4) and 22 / 47 == pytest.approx(0.468, abs=1e-3)
    merged = spark.range(1).select(metrics.merged_mean(F.lit(2.0), F.lit(3), F.lit(6.0)).alias("m"), metrics.merged_rate(F.lit(0.6667), F.lit(3), F.lit(True)).alias("r")).first()
    assert (merged.m, merged.r) == (3.0, 0.75)


def test_precision(spark):
    j = spark.createDataFrame([("q", 1, 5), ("q", 2, 1), ("p", 1, 4)], "query_id string, rank int, grade int")
    per = {r.query_id: r.precision for r in metrics.precision_at_k(j, 5, 4).collect()}
    assert per == {"q": 0.5, "p": 1.0}  # divided by the rows that there are
    assert metrics.mean_of_means(metrics.precision_at_k(j, 5, 4)).first().mean_precision == 0.75


DIFF = """diff --git a/m.py b/m.py
index 111..222 100644
--- a/m.py
+++ b/m.py
@@ -10,4 +10,5 @@ def f():
 keep
-old
+new one
+new two
 keep
 keep
@@ -30,2 +31,0 @@
-gone
-gone
@@ -40,0 +39,2 @@
+added
+added
diff --git a/new.py b/new.py
--- /dev/null
+++ b/new.py
@@ -0,0 +1 @@
+x = 1
diff --git a/dead.py b/dead.py
--- a/dead.py
+++ /dev/null
@@ -1,2 +1,1 @@
-a
-b
"""


def test_diff(spark):
    rows = review.changed_locations(spark.createDataFrame([(1, DIFF)], "diff_id int, diff string")).orderBy("hunk").collect()
    got = [(r.file, r.start_line, r.end_line, r.old_start_line, r.old_end_line) for r in rows]
    assert got == [("m.py", 11, 12, 11, 11), ("m.py", 39, 40, 40, 40), ("new.py", 1, 1, 0, 0)]
    assert "index" not in spark.range(1).select(review.strip_index_lines(F.lit(DIFF))).first()[0]


def test_bundle(spark):
    chunks = spark.createDataFrame(
        [("c1", "f", "m.py", "function", "f", 5, 20), ("c2", "f", "m.py", "sliding", None, 1, 50), ("t", "g", "tests/test_m.py", "function", "test_f", 1, 9), ("d", "h", "lib.py", "function", "g", 1, 3)],
        "chunk_id string, file_id string, file_path string, chunk_type string, function_name string, start_line int, end_line int",
    )
    edges = spark.createDataFrame([("t", "c1", "function_call"), ("c1", "d", "function_call"), ("c1", "c1", "function_call")], "src string, dst string, edge_type string")
    diffs = spark.createDataFrame([(1, DIFF)], "diff_id int, diff string")
    functions = review.changed_functions(review.changed_locations(diffs), chunks)
    assert [r.chunk_id for r in functions.collect()] == ["c1"]
    got = {(r.other, r.role, r.is_test, r.fallback) for r in review.bundle(functions, edges, chunks).collect()}
    assert got == {("t", "caller", True, None), ("d", "callee", False, None)}
    lonely = review.bundle(functions, edges.where("src <> 't'"), chunks).first()
    assert lonely.fallback == "test f m"


CLAIM = '{"claim_type": "security", "location": "a.py:3", "assertion": "x", "proposed_test": "y"}'


@pytest.mark.parametrize(
    ("raw", "n"),
    [(f"[{CLAIM}]", 1), (f'{{"claims": [{CLAIM}, {CLAIM}]}}', 2), ("[]", 0), (f'{{"a": [{CLAIM}], "b": 1}}', None), ("nonsense", None), (f"[{CLAIM.replace('security', 'style')}]", None), (f"[{CLAIM.replace('a.py', 'b.py')}]", None), (f"[{CLAIM}, {{}}]", None)],
)
def test_claims(spark, raw, n):
    got = spark.createDataFrame([(raw, ["a.py"])], "raw string, files array<string>").select(review.parse_claims(F.col("raw"), F.col("files"))).first()[0]
    assert (None if got is None else len(got)) == n


def test_verdicts(spark):
    good = '{"verdict": "reject", "confidence": 0.8, "cited_evidence": ["e"], "minority_report": null}'
    rows = spark.createDataFrame([(good,), (good.replace("0.8", "1.8"),), (good.replace("reject", "maybe"),), ("[]",)], "raw string")
    assert [r[0] is not None for r in rows.select(review.parse_verdict(F.col("raw"))).collect()] == [True, False, False, False]
    sure = review.too_sure(F.lit("cap"), F.lit(1), F.col("c"), F.col("m"))
    assert [r[0] for r in spark.createDataFrame([(0.7, None), (0.69, None), (0.9, "why")], "c double, m string").select(sure).collect()] == [True, False, False]


def test_evidence(spark):
    status, trust = review.dispatch(F.col("kind"), F.col("code"), F.col("late"), F.lit(True), F.lit(True), F.lit("python"), F.col("found"), F.lit(None).cast("int"))
    rows = spark.createDataFrame([("untested_branch", 0, False, False), ("untested_branch", 1, False, False), ("untested_branch", 1, True, False), ("security", 0, False, True), ("breaking_change", 0, False, False)], "kind string, code int, late boolean, found boolean")
    assert [tuple(r) for r in rows.select(status.alias("s"), trust.alias("t")).collect()] == [("refuted", "high"), ("confirmed", "high"), ("inconclusive", "low"), ("confirmed", "medium"), ("inconclusive", "low")]
