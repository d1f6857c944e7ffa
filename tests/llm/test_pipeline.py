from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from plinth.llm import toxicity  # noqa: E402
from tests.llm.test_dedup import plain_copies, plain_near  # noqa: E402
from tests.llm.test_text import plain_hits  # noqa: E402


def test_stages_like_brute_force(spark, docs, texts, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    base = next(t for _, t in texts if t and len(t.split()) > 50)
    items = [(1, " ".join(base.split()[3:30]))]
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = list(texts)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        got = sorted((str(r.doc_id), r.text or "") for r in now.collect())
        if name == "toxicity":
            model = toxicity.fit(spark, docs, labels)
            bad = {(r.doc_id) for r in toxicity.score(spark, docs, model).where("score >= 0.5").collect()}
            kept = [x for x in kept if x[0] not in bad]
        elif name == "exact dedup":
            groups = {x[3]: x[1] for x in plain_copies(kept)}
            assert len(got) == len(groups)
            kept = [(r.doc_id, r.text) for r in now.collect()]
        elif name == "MinHash near-dedup":
            want = plain_near(kept)
            assert sorted(i for i, _ in got) == sorted(str(x[0]) for x in want if x[3])
            kept = [(r.doc_id, r.text) for r in now.collect()]
        else:
            clean = {str(x[0]) for x in plain_hits(kept, items) if not x[2]}
            assert {i for i, _ in got} == clean
        if name == "toxicity":
            assert got == sorted((str(i), t or "") for i, t in kept)
    full = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in full) == sorted(i for i, _ in got) and all(r.round_trip for r in full)


def test_empty_tables(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names_that_clash(spark, docs, texts, tmp_path):
    clashing = docs.withColumnRenamed("lang", "row_number").withColumnRenamed("source", "Row_Key")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts[0][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, str(tmp_path))
        assert out.columns == clashing.columns, name
        assert out.count() == stage(spark, docs, str(tmp_path)).count() > 0, name


def test_a_long_document_with_one_window_goes(spark, docs, tmp_path):
    item = " ".join(f"w{i}" for i in range(13))
    rows = [(1, "a " * 5000 + item + " b" * 5000), (2, "a " * 5000 + item[:-1] + " b" * 5000), (3, "clean"), (None, item)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(None, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_contaminated(spark, own, str(tmp_path)).collect()) == [2, 3]
