from __future__ import annotations

import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plinth.functions import ids, text, vectors


def one(spark, expr, **columns):
    row = spark.createDataFrame([tuple(columns.values()) or (1,)], list(columns) or ["x"])
    return row.select(expr.alias("out")).first()[0]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("parse_line_of_log", ["parse", "line", "of", "log"]),
        ("openFileAtURL", ["open", "file", "at", "url"]),
        ("XMLTreeNode", ["xml", "tree", "node"]),
        ("  ", []),
        ("", []),
        ("!!! --", []),
        ("# see: getX(2)", ["see", "get", "x", "2"]),
        ("été2Go", ["t", "2", "go"]),
    ],
)
def test_tokens(spark, source, expected):
    assert one(spark, text.tokens(F.col("s")), s=source) == expected


def plain_tokens(source: str) -> list[str]:
    """Character by character: a part ends at what is no ASCII letter or digit, before a capital behind a small letter or digit, and before a capital that a small letter follows."""
    out, part = [], ""
    for i, c in enumerate(source):
        if not (c.isascii() and c.isalnum()):
            out, part = out + [part], ""
            continue
        follows = source[i + 1 : i + 2]
        if part and c.isupper() and (not part[-1].isupper() or (follows.isascii() and follows.islower())):
            out, part = out + [part], ""
        part += c
    return [x.lower() for x in [*out, part] if x]


def test_tokens_like_python(spark):
    samples: list[str] = []

    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet="aBcD1_é -Z", max_size=20))
    def collect(s):
        samples.append(s)

    collect()
    rows = spark.createDataFrame([(s,) for s in samples], "s string").select("s", text.tokens(F.col("s")).alias("t")).collect()
    assert all(r.t == plain_tokens(r.s) for r in rows)


def test_lexical_gate(spark):
    ok = text.lexically_compatible(F.col("a"), F.col("b"))
    assert one(spark, ok, a="Where is the login route defined?", b="login route defined where")
    assert not one(spark, ok, a="how does the backend start", b="how does the frontend start")
    assert not one(spark, ok, a="login handler", b="logout handler")
    assert not one(spark, ok, a="parse tokens", b="render graphs")
    assert one(spark, ~text.in_conflict(F.col("a"), F.col("b")), a="device list", b="production list")  # dev is no whole word
    assert one(spark, text.jaccard(text.content_words(F.col("a")), text.content_words(F.col("b"))), a="the of", b="is") == 0.0


def test_ids(spark):
    for path in ("src/a.py", "é/ü.js", ""):
        assert one(spark, ids.file_id(F.col("p")), p=path) == str(uuid.uuid5(uuid.UUID(ids.FILE_SPACE), path))
    assert one(spark, ids.repository_id(F.col("o"), F.col("n")), o="a", n="b") == str(uuid.uuid5(uuid.UUID(ids.REPOSITORY_SPACE), "a/b"))
    assert one(spark, ids.chunk_id(F.col("f"), F.lit("sliding"), F.lit(1), F.lit(50)), f="q") == str(uuid.uuid5(uuid.UUID(ids.CHUNK_SPACE), "q:sliding:1:50"))


def test_token_count_and_block(spark):
    assert [one(spark, text.token_count(F.col("t")), t=x) for x in ("", "a", "abcd", "abcde")] == [0, 1, 1, 2]
    block = one(spark, text.context_block(F.lit("r"), F.lit("p"), F.lit("python"), F.lit("class"), F.lit(None).cast("string"), F.lit(""), F.lit("x = 1")))
    assert block.split("\n") == ["Repository: r", "File Path: p", "Language: python", "Chunk Type: class", "Function Name: None", "Class Name: None", "Raw Code:", "x = 1"]


def test_lines_keep_their_ends(spark):
    assert one(spark, text.lines_of(F.col("t")), t="a\r\nb\n\nc") == ["a\r\n", "b\n", "\n", "c"]
    assert one(spark, text.lines_of(F.col("t")), t="") == []


def test_citation(spark):
    cited = text.is_cited(F.col("a"), F.lit("m.py"), F.col("f"), F.lit("Box"))
    assert one(spark, cited, a="see m.py and go()", f="go")
    assert not one(spark, cited, a="see m.py", f="go")
    assert one(spark, cited, a="m.py has Box", f="")


def test_vectors(spark):
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[3.0, 0.0]) == pytest.approx(1)
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[3.0, 0.0]) == 0.0
    assert one(spark, vectors.unit(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]


def test_norm_is_computed_once_for_a_vector(spark):
    """Not once for each element, where a vector of n numbers would take n * n steps."""
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), ([1.0, None],), (None,)], "a array<float>").select(vectors.unit(F.col("a")).alias("u"))
    assert [r.u for r in v.collect()] == [[0.6, 0.8], [0.0, 0.0], [], [None, None], None]
    assert v._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_first_grade_and_palette(spark):
    assert [one(spark, text.first_grade(F.col("t")), t=x) for x in ("10", "score: 4", "none", "")] == [1, 4, 1, 1]

    def plain(path):
        parts = path.split("/")
        key = "root" if len(parts) <= 1 else parts[0] if len(parts) == 2 else "/".join(parts[:2])
        h = 0
        for c in key:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return h % 12

    for path in ("a.py", "src/a.py", "src/lib/deep/a.py"):
        assert one(spark, text.palette_bucket(F.col("p")), p=path) == plain(path)


def test_lexical_gate_reads_each_text_once(spark, sf_dir):
    from plinth.functions.text import CONFUSABLE
    from plinth.plans.queries import QUERIES

    plan = QUERIES["lexical_gate"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 2 * sum(map(len, CONFUSABLE))


def test_named_terms(spark):
    from plinth.functions.text import CONFUSABLE, named_terms

    at = {variant: i for i, variant in enumerate(v for category in CONFUSABLE for v in category)}
    want = {"Log In or sign up": {("login", "log in", "signin", "sign in"), ("register", "registration", "signup", "sign up")}, "forget posts, get-post": {("get",), ("post",)}, "server-side": {CONFUSABLE[0][0]}, "device": set(), None: set()}
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", named_terms(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == {t: sum(1 << at[v] for v in named) for t, named in want.items()}


def test_claims_are_parsed_once(spark, sf_dir):
    from plinth.plans.queries import QUERIES

    plan = QUERIES["json_claims_parse"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2  # an object's keys, and the claims
