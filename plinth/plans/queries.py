"""One query for each operator family over the whole generated tables, and the same in SQL.

Stand-ins: a repository is a ``source``, a file a document, a chunk a line that is not empty; vectors,
documents and benchmark questions share one id space.  Vector searches ask with every vector whose id is
divisible by 100, text searches with every benchmark question.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import ids, text
from plinth.operators import cache, chunking, context, dense, fusion, graph, metrics, resolve, review, sparse, tables
from plinth.operators.ranking import keep_first, ranked, top_k
from plinth.session import checkpointed
from plinth.sources.files import is_ignored, language, parse_repository_url
from plinth.streaming.jobs import latest_state, windowed_counts

#: Hits that are broadcast at most; more are joined with the documents by a shuffle.
BROADCAST_HITS = 500_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL that has the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- pieces of SQL ---

TOKENS = (
    "list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda t: lower(t)), lambda t: t <> '')"
)
COSINE = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))"


def uuid5_sql(space: str, name: str) -> str:
    h = f"sha1(from_hex('{space.replace('-', '')}') || encode({name}))"
    digit = "substr('89ab89ab89ab89ab', (instr('0123456789abcdef', substr(h, 17, 1)))::INTEGER, 1)"
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || {digit} || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"


# --- text ---


@query(f"SELECT t AS term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS t FROM documents) GROUP BY t")
def tokenize_terms(spark, sf):
    toks = table(spark, sf, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term"))
    per_doc = toks.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return per_doc.groupBy("term").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query(
    f"""SELECT doc_id, {uuid5_sql(ids.FILE_SPACE, "source || '/' || doc_id")} AS file_id, {uuid5_sql(ids.REPOSITORY_SPACE, "source || '/' || lang")} AS repository_id,
    {uuid5_sql(ids.CHUNK_SPACE, "doc_id || ':sliding:1:50'")} AS chunk_id FROM documents"""
)
def uuid5_ids(spark, sf):
    d = table(spark, sf, "documents")
    doc = F.col("doc_id").cast("string")
    return d.select("doc_id", ids.file_id(F.concat("source", F.lit("/"), doc)).alias("file_id"), ids.repository_id(F.col("source"), F.col("lang")).alias("repository_id"), ids.chunk_id(doc, F.lit("sliding"), F.lit(1), F.lit(50)).alias("chunk_id"))


@query("SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(ceil(length(text) / 4.0) AS BIGINT) END AS tokens FROM conversations")
def token_estimates(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.token_count(F.col("text")).alias("tokens"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_CONTENT = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: NOT list_contains(" + _STOPS + ", w)))"


@query(
    f"""WITH q AS (SELECT conv_id, first(text ORDER BY turn) AS a, last(text ORDER BY turn) AS b FROM conversations GROUP BY conv_id),
    w AS (SELECT conv_id, {_CONTENT.format('a')} AS x, {_CONTENT.format('b')} AS y FROM q)
    SELECT conv_id, CAST(len(x) AS BIGINT) AS n_a, CAST(len(y) AS BIGINT) AS n_b,
    round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END, 6) AS similarity FROM w"""
)
def lexical_similarity(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"))
    w = c.select("conv_id", text.content_words(F.col("a")).alias("x"), text.content_words(F.col("b")).alias("y"))
    return w.select("conv_id", F.size("x").cast("bigint").alias("n_a"), F.size("y").cast("bigint").alias("n_b"), F.round(text.jaccard(F.col("x"), F.col("y")), 6).alias("similarity"))


@query(
    """WITH u AS (SELECT page_id, 'Owner-' || page_id AS o, 'repo.' || page_id % 7 AS n, page_id % 6 AS k FROM pages)
    SELECT page_id, k IN (0, 1, 2) AS is_repository, CASE WHEN k IN (0, 1, 2) THEN o END AS owner, CASE WHEN k IN (0, 1, 2) THEN n END AS name,
    CASE WHEN k IN (0, 1, 2) THEN 'https://github.com/' || o || '/' || n || '.git' END AS clone_url FROM u"""
)
def repository_urls(spark, sf):
    """Every page stands for an address: plain, with suffix and blanks, with a slash; and three kinds that are none: an owner that ends in a hyphen, a path too deep, the page's own address."""
    p = table(spark, sf, "pages")
    owner, name = F.concat(F.lit("Owner-"), F.col("page_id").cast("string")), F.concat(F.lit("repo."), (F.col("page_id") % 7).cast("string"))
    base = F.concat(F.lit("https://github.com/"), owner)
    kinds = [F.concat(base, F.lit("/"), name), F.concat(F.lit("  "), base, F.lit("/"), name, F.lit(".git ")), F.concat(base, F.lit("/"), name, F.lit("/")), F.concat(base, F.lit("-/"), name), F.concat(base, F.lit("/"), name, F.lit("/tree/main")), F.col("url")]
    made = parse_repository_url(F.get(F.array(*kinds), (F.col("page_id") % 6).cast("int")))
    return p.select("page_id", made.isNotNull().alias("is_repository"), made["owner"].alias("owner"), made["name"].alias("name"), made["clone_url"].alias("clone_url"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'python' WHEN p_partkey % 3 = 1 THEN 'javascript' END AS file_language, p_partkey % 5 = 0 AS ignored,
    contains(lower(p_name), 'test') OR contains(lower(p_name), 'spec') AS is_test FROM part"""
)
def file_discovery_rules(spark, sf):
    p = table(spark, sf, "part")
    ext = F.element_at(F.array(F.lit(".py"), F.lit(".js"), F.lit(".bin")), (F.col("p_partkey") % 3 + 1).cast("int"))
    path = F.concat(F.when(F.col("p_partkey") % 5 == 0, "src/node_modules/").otherwise("src/lib/"), F.col("p_partkey").cast("string"), ext)
    return p.select("p_partkey", language(path).alias("file_language"), is_ignored(path).alias("ignored"), text.is_test_path(F.col("p_name")).alias("is_test"))


@query("SELECT o_orderkey, CASE WHEN t LIKE '%1%' OR t LIKE '%2%' OR t LIKE '%3%' OR t LIKE '%4%' OR t LIKE '%5%' THEN CAST(regexp_extract(t, '[1-5]') AS INTEGER) ELSE 1 END AS grade FROM (SELECT o_orderkey, o_orderpriority AS t FROM orders)")
def judge_grades(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.first_grade(F.col("o_orderpriority")).alias("grade"))


@query(
    """WITH k AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS p FROM pages),
    s AS (SELECT page_id, CASE WHEN len(p) <= 1 THEN 'root' WHEN len(p) = 2 THEN p[1] ELSE p[1] || '/' || p[2] END AS key FROM k)
    SELECT page_id, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295) % 12 AS INTEGER) AS bucket FROM s"""
)
def palette_hash(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.palette_bucket(F.regexp_replace("url", "^https?://", "")).alias("bucket"))


# --- sparse, dense, fusion ---

_BM25 = f"""
d AS (SELECT doc_id, {TOKENS.format('text')} AS toks FROM documents),
tf AS (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS t FROM d) GROUP BY ALL),
cs AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len FROM d),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS r FROM df, cs),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""

_HITS = (
    _BM25
    + f""",
qt AS (SELECT query_id, t AS term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS t FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, tf.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avg_len))) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN d ON d.doc_id = tf.doc_id, cs GROUP BY ALL),
al AS (SELECT q.query_id, d.doc_id, coalesce(score, 0) AS score FROM (SELECT DISTINCT query_id FROM qt) q CROSS JOIN d LEFT JOIN sc ON sc.query_id = q.query_id AND sc.doc_id = d.doc_id),
sr AS (SELECT query_id, doc_id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM al)"""
)


def _questions(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_last_index: list[sparse.SparseIndex] = []


def _sparse_index(spark, sf) -> sparse.SparseIndex:
    """The index of all documents, persisted until the next query asks for one."""
    while _last_index:
        _last_index.pop().drop()
    _last_index.append(sparse.build_index(table(spark, sf, "documents").select("doc_id", "text")).kept())
    return _last_index[0]


@query(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_term_stats(spark, sf):
    return _sparse_index(spark, sf).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_HITS} SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM sr WHERE rank <= 20")
def bm25_topk(spark, sf):
    return sparse.search(_sparse_index(spark, sf), _questions(spark, sf), 20).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_DENSE = f"""
dq AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE {{}}),
ds AS (SELECT query_id, vec_id AS id, {COSINE.format('embedding', 'q')} AS score FROM embeddings, dq),
dr AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM ds)"""
_HUNDREDTH, _OF_QUESTIONS = "vec_id % 100 = 0", "vec_id IN (SELECT item_id FROM benchmark)"


def _near(spark, sf, k: int = 20, questions: bool = False) -> DataFrame:
    """The nearest of every hundredth vector, or of the vectors of the benchmark questions."""
    e = table(spark, sf, "embeddings")
    asked = e.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id")).distinct(), "vec_id") if questions else e.where(_HUNDREDTH)
    return dense.search(dense.build_index(e, "vec_id", "embedding", 64), asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), k)


@query(f"WITH {_DENSE.format(_HUNDREDTH)} SELECT query_id, id, round(score, 6) AS score, rank FROM dr WHERE rank <= 20")
def dense_topk(spark, sf):
    return _near(spark, sf).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_FUSED = f"""{_HITS.strip()}, {_DENSE.format(_OF_QUESTIONS).strip()},
s20 AS (SELECT * FROM sr WHERE rank <= 20), d20 AS (SELECT * FROM dr WHERE rank <= 20),
fu AS (SELECT coalesce(d20.query_id, s20.query_id) AS query_id, coalesce(d20.id, s20.id) AS id, d20.rank AS dk, s20.rank AS sk,
  coalesce(1.0::DOUBLE / (60 + d20.rank), 0) + coalesce(1.0::DOUBLE / (60 + s20.rank), 0) AS fused FROM d20 FULL JOIN s20 ON d20.query_id = s20.query_id AND d20.id = s20.id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, dk NULLS LAST, sk NULLS LAST) AS rank FROM fu)"""


def _fused(spark, sf) -> DataFrame:
    hits = sparse.search(_sparse_index(spark, sf), _questions(spark, sf), 20).withColumnRenamed("doc_id", "id")
    return fusion.fuse(_near(spark, sf, questions=True), hits, 8)


def _near_docs(found: DataFrame) -> DataFrame:
    """Rows of hits (stored ones, since they are counted) to join with documents: broadcast while they are few, so that no text is shuffled."""
    return F.broadcast(found) if found.count() <= BROADCAST_HITS else found


@query(f"WITH {_FUSED} SELECT query_id, id, round(fused, 6) AS fused_score, CASE WHEN dk IS NULL THEN 'sparse' WHEN sk IS NULL THEN 'dense' ELSE 'hybrid' END AS source, rank FROM fr WHERE rank <= 8")
def hybrid_rrf(spark, sf):
    return _fused(spark, sf).select("query_id", "id", F.round("fused_score", 6).alias("fused_score"), "source", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_FUSED} SELECT query_id, count(*) AS n_common FROM (SELECT query_id, id FROM d20 INTERSECT SELECT query_id, id FROM s20) GROUP BY query_id")
def candidate_overlap(spark, sf):
    hits = sparse.search(_sparse_index(spark, sf), _questions(spark, sf), 20).withColumnRenamed("doc_id", "id")
    return fusion.overlap(_near(spark, sf, questions=True), hits).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_common"))


_SHARE = (
    "CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END"
)


@query(
    f"""WITH {_FUSED}, c AS (SELECT fr.query_id, fr.id, fr.rank, list_distinct({TOKENS.format('b.text')}) AS x, list_distinct({TOKENS.format("coalesce(d2.text, '')")}) AS y
    FROM fr JOIN benchmark b ON b.item_id = fr.query_id JOIN documents d2 ON d2.doc_id = fr.id WHERE rank <= 8), s AS (SELECT query_id, id, rank, {_SHARE} AS sc FROM c)
    SELECT query_id, id AS chunk_id, round(sc, 6) AS cross_score, row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 9) DESC, rank) AS final_rank FROM s"""
)
def rerank_overlap(spark, sf):
    from plinth.models import overlap_scorer

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("code"))
    found = checkpointed(_fused(spark, sf).select("query_id", F.col("id").alias("chunk_id"), F.col("fused_score").alias("previous_score"), F.col("rank").alias("place")))
    out = context.rerank(docs.join(_near_docs(found), "chunk_id").join(_questions(spark, sf), "query_id"), overlap_scorer, 8)
    return out.select("query_id", "chunk_id", F.round("cross_score", 6).alias("cross_score"), F.col("final_rank").cast("bigint").alias("final_rank"))


# --- graph ---

_GRAPH = """
raw_e AS (
  SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, CASE WHEN l_linenumber % 2 = 0 THEN 'function_call' ELSE 'method_call' END AS edge_type, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 3 END AS ph, l_orderkey AS o FROM lineitem
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'contains', 0, s_suppkey FROM supplier
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'imports', 5, n_nationkey FROM nation),
ed AS (SELECT src, dst, edge_type FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ph, o, edge_type) AS k FROM raw_e) WHERE k = 1),
bw AS (SELECT src AS id, dst AS other FROM ed UNION SELECT dst, src FROM ed)"""


def _raw_edges(spark, sf) -> DataFrame:
    """A supplier-part graph of all orders, with every order's edge."""
    pre = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    kind = F.when(F.col("l_linenumber") % 2 == 0, "function_call").otherwise("method_call")
    li = table(spark, sf, "lineitem").select(pre("s", "l_suppkey").alias("src"), pre("p", "l_partkey").alias("dst"), kind.alias("edge_type"), F.col("l_orderkey").alias("o"))
    su = table(spark, sf, "supplier").select(pre("n", "s_nationkey").alias("src"), pre("s", "s_suppkey").alias("dst"), F.lit("contains").alias("edge_type"), F.col("s_suppkey").alias("o"))
    na = table(spark, sf, "nation").select(pre("r", "n_regionkey").alias("src"), pre("n", "n_nationkey").alias("dst"), F.lit("imports").alias("edge_type"), F.col("n_nationkey").cast("bigint").alias("o"))
    return li.unionByName(su).unionByName(na)


def _first() -> list:
    return [graph.phase(F.col("edge_type")), F.col("o"), F.col("edge_type")]


def _edges(spark, sf) -> DataFrame:
    return graph.first_wins(_raw_edges(spark, sf), *_first()).select("src", "dst", "edge_type")


def _focus(spark) -> DataFrame:
    return spark.createDataFrame([(f"s{i}",) for i in range(1, 6)], "id string")


@query(f"WITH {_GRAPH} SELECT src, dst, edge_type FROM ed")
def graph_edges_first_wins(spark, sf):
    return _edges(spark, sf)


@query(f"WITH {_GRAPH} SELECT DISTINCT dst AS id, src AS caller FROM ed WHERE edge_type IN ('function_call', 'method_call') AND dst IN ('p1', 'p2', 'p3', 'p4', 'p5')")
def graph_callers(spark, sf):
    return graph.callers(_edges(spark, sf), spark.createDataFrame([(f"p{i}",) for i in range(1, 6)], "id string"))


@query(f"WITH {_GRAPH} SELECT DISTINCT src AS id, dst AS callee FROM ed WHERE edge_type IN ('function_call', 'method_call') AND src IN ('s1', 's2', 's3', 's4', 's5')")
def graph_callees(spark, sf):
    return graph.callees(_edges(spark, sf), _focus(spark))


@query(f"WITH {_GRAPH} SELECT id, other AS neighbor FROM bw WHERE id IN ('s1', 's2', 's3', 's4', 's5')")
def graph_neighbors(spark, sf):
    return graph.neighbors(_edges(spark, sf), _focus(spark))


_SEEDS = "seed AS (SELECT 1 AS query_id, 's1' AS id, 0.9::DOUBLE AS score, 1 AS rank UNION ALL SELECT 1, 's2', 0.5, 2 UNION ALL SELECT 2, 'p3', 0.7, 1 UNION ALL SELECT 2, 'n3', 0.6, 2)"
_STEPS = """st AS (SELECT dst AS src, src AS dst, edge_type, 0 AS side FROM ed UNION ALL SELECT src, dst, edge_type, 1 FROM ed
  UNION ALL SELECT 'n' || n.n_nationkey, 's' || s_suppkey, 'imports', 2 FROM nation n JOIN nation m ON m.n_regionkey = n.n_regionkey JOIN supplier ON s_nationkey = m.n_nationkey)"""
_HOP1 = """h1a AS (SELECT seed.query_id, st.dst AS id, seed.score * 0.5 AS score, seed.id AS origin, edge_type, seed.rank AS fr, side FROM seed JOIN st ON st.src = seed.id),
h1 AS (SELECT query_id, id, score, origin, edge_type, row_number() OVER (PARTITION BY query_id ORDER BY fr, side, id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY round(score, 12) DESC, fr, side, origin) AS k FROM h1a WHERE NOT EXISTS (SELECT 1 FROM seed s2 WHERE s2.query_id = h1a.query_id AND s2.id = h1a.id)) WHERE k = 1)"""


def _seeds(spark) -> DataFrame:
    return spark.createDataFrame([(1, "s1", 0.9, 1), (1, "s2", 0.5, 2), (2, "p3", 0.7, 1), (2, "n3", 0.6, 2)], "query_id int, id string, score double, rank int")


def _nodes(spark, sf) -> DataFrame:
    """Nations are chunks of their region's file, suppliers of their nation's."""
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    pre = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = nation.select(pre("n", "n_nationkey").alias("id"), F.lit("chunk").alias("node_kind"), pre("r", "n_regionkey").alias("file_id"))
    return nodes.unionByName(supplier.select(pre("s", "s_suppkey").alias("id"), F.lit("chunk").alias("node_kind"), pre("n", "s_nationkey").alias("file_id")))


def _steps(spark, sf) -> DataFrame:
    return graph.fan_out(_edges(spark, sf), _nodes(spark, sf))


@query(f"WITH {_GRAPH}, {_STEPS} SELECT src, dst, edge_type, side FROM st")
def graph_fan_out(spark, sf):
    return _steps(spark, sf)


@query(
    f"""WITH {_GRAPH}, {_SEEDS}, {_STEPS}, {_HOP1}, al AS (SELECT query_id, id, score, 0 AS distance, rank AS place FROM seed UNION ALL SELECT query_id, id, score, 1, place + 1000000000 FROM h1)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, round(score, 12) DESC, place, id) AS rank FROM al"""
)
def graph_expansion_order(spark, sf):
    return graph.expansion_order(graph.expand(_seeds(spark), _steps(spark, sf), 1)).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_GRAPH}, {_SEEDS}, {_STEPS}, {_HOP1} SELECT query_id, id, round(score, 6) AS score, 0 AS distance, CAST(NULL AS VARCHAR) AS origin FROM seed UNION ALL SELECT query_id, id, round(score, 6), 1, origin FROM h1")
def graph_expand_1hop(spark, sf):
    return graph.expand(_seeds(spark), _steps(spark, sf), 1).select("query_id", "id", F.round("score", 6).alias("score"), "distance", "origin")


@query(
    f"""WITH {_GRAPH}, {_SEEDS}, {_STEPS}, {_HOP1},
    h2a AS (SELECT h1.query_id, st.dst AS id, h1.score * 0.5 AS score, h1.id AS origin, h1.place AS fr, side FROM h1 JOIN st ON st.src = h1.id),
    h2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY round(score, 12) DESC, fr, side, origin) AS k FROM h2a WHERE NOT EXISTS (SELECT 1 FROM seed s2 WHERE s2.query_id = h2a.query_id AND s2.id = h2a.id)) WHERE k = 1),
    imp AS (SELECT h2.* FROM h2 LEFT JOIN h1 ON h1.query_id = h2.query_id AND h1.id = h2.id WHERE h1.id IS NULL OR h2.score > h1.score)
    SELECT query_id, id, round(score, 6) AS score, 0 AS distance, CAST(NULL AS VARCHAR) AS origin FROM seed
    UNION ALL SELECT query_id, id, round(score, 6), 1, origin FROM h1 WHERE NOT EXISTS (SELECT 1 FROM imp WHERE imp.query_id = h1.query_id AND imp.id = h1.id)
    UNION ALL SELECT query_id, id, round(score, 6), 2, origin FROM imp""",
)
def graph_expand_2hop(spark, sf):
    return graph.expand(_seeds(spark), lambda ids: graph.fan_out_from(_raw_edges(spark, sf), _nodes(spark, sf), ids, *_first()), 2).select("query_id", "id", F.round("score", 6).alias("score"), "distance", "origin")


_RADIUS = f"""WITH RECURSIVE {_GRAPH.strip()},
bfs AS (SELECT 's' || i AS focus, 's' || i AS id, 0 AS hop FROM range(1, 6) t(i) UNION SELECT focus, other, hop + 1 FROM bfs JOIN bw ON bw.id = bfs.id WHERE hop < 2),
rad AS (SELECT focus, id, min(hop) AS hop FROM bfs GROUP BY ALL)"""


@query(f"{_RADIUS} SELECT focus, id, hop FROM rad")
def blast_radius(spark, sf):
    return graph.blast_radius(_edges(spark, sf), _focus(spark), 2)


@query(f"{_RADIUS} SELECT src, dst, edge_type FROM ed WHERE src IN (SELECT id FROM rad) AND dst IN (SELECT id FROM rad)")
def blast_radius_edges(spark, sf):
    e = _edges(spark, sf)
    return graph.induced(e, graph.blast_radius(e, _focus(spark), 2).select("id"))


@query(f"{_RADIUS} SELECT focus, hop, count(*) AS n_nodes FROM rad GROUP BY ALL")
def hop_tiers(spark, sf):
    return graph.hop_tiers(graph.blast_radius(_edges(spark, sf), _focus(spark), 2))


@query(f"WITH {_GRAPH} SELECT 'p' || p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM bw WHERE bw.id = 'p' || p_partkey)")
def graph_isolated_census(spark, sf):
    nodes = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return graph.isolated(nodes, _edges(spark, sf))


@query(
    f"""WITH {_GRAPH}, c AS (SELECT * FROM ed WHERE edge_type IN ('function_call', 'method_call') AND src <> dst)
    SELECT DISTINCT dst AS focus, src AS other, 'caller' AS role FROM c WHERE dst IN ('s1', 'p1', 'p2') UNION SELECT DISTINCT src, dst, 'callee' FROM c WHERE src IN ('s1', 'p1', 'p2')""",
)
def caller_callee_roles(spark, sf):
    return graph.classify(_edges(spark, sf), spark.createDataFrame([("s1",), ("p1",), ("p2",)], "id string"))


# --- resolution ---

_SYMBOLS = """sy AS (SELECT p_partkey AS id, p_partkey % 20 AS file_id, CASE p_partkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'method' ELSE 'class' END AS kind, p_brand AS name, p_type AS class_name, p_partkey AS ordinal FROM part)"""


def _symbols(spark, sf) -> DataFrame:
    k = F.col("p_partkey") % 3
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 20).alias("file_id"), F.when(k == 0, "function").when(k == 1, "method").otherwise("class").alias("kind"), F.col("p_brand").alias("name"), F.col("p_type").alias("class_name"), F.col("p_partkey").alias("ordinal"))


@query(
    f"""WITH {_SYMBOLS}, si AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS site_id, l_suppkey AS src, l_partkey % 20 AS file_id, p_type AS caller_class, p_brand AS callee, l_linenumber = 1 AS is_self, CASE WHEN l_linenumber = 2 THEN p_type END AS qualifier FROM lineitem JOIN part ON p_partkey = l_partkey),
    ti AS (SELECT si.*, sy.id AS dst, sy.ordinal, sy.kind, CASE WHEN kind = 'method' AND is_self AND class_name = caller_class THEN 1 WHEN kind = 'method' AND class_name = qualifier THEN 2 WHEN kind = 'function' THEN 3 ELSE 4 END AS tier, CASE WHEN sy.file_id = si.file_id THEN 0 ELSE 1 END AS far FROM si JOIN sy ON sy.name = si.callee WHERE kind <> 'class'),
    r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY tier, CASE WHEN tier <= 2 THEN 0 ELSE far END, ordinal) AS k FROM ti)
    SELECT site_id, src, dst, CASE WHEN kind = 'method' THEN 'method_call' ELSE 'function_call' END AS edge_type FROM r WHERE k = 1""",
)
def resolve_call_preference(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    sites = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    sites = sites.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("site_id"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 20).alias("file_id"), F.col("p_type").alias("caller_class"), F.col("p_brand").alias("callee"), (F.col("l_linenumber") == 1).alias("is_self"), F.when(F.col("l_linenumber") == 2, F.col("p_type")).alias("qualifier")).distinct()
    return resolve.calls(sites, _symbols(spark, sf))


@query(
    f"""WITH {_SYMBOLS}, si AS (SELECT o_orderkey AS site_id, o_custkey AS src, o_orderkey % 20 AS file_id, 'Brand#' || (o_custkey % 6) || (o_orderkey % 6) AS callee FROM orders),
    ti AS (SELECT si.*, sy.id AS dst, sy.ordinal, CASE WHEN sy.kind = 'function' THEN 0 ELSE 1 END AS tier, CASE WHEN sy.file_id = si.file_id THEN 0 ELSE 1 END AS far FROM si JOIN sy ON sy.name = si.callee WHERE kind <> 'class'),
    r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY tier, far, ordinal) AS k FROM ti)
    SELECT site_id, src, dst, CASE WHEN tier = 1 THEN 'method_call' ELSE 'function_call' END AS edge_type FROM r WHERE k = 1"""
)
def resolve_bare_names(spark, sf):
    """Some of the names are no symbol's."""
    name = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 6).cast("string"), (F.col("o_orderkey") % 6).cast("string"))
    sites = table(spark, sf, "orders").select(F.col("o_orderkey").alias("site_id"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 20).alias("file_id"), name.alias("callee"))
    return resolve.bare_names(sites, _symbols(spark, sf))


@query("""SELECT 'p' || min(p_partkey) AS parent, 's' || (p_partkey % 50) AS id, CAST(count(*) AS BIGINT) AS n_children FROM part GROUP BY p_partkey % 50""")
def class_hierarchy(spark, sf):
    """Every part is a base and a member of one of 50 classes: the first base, and the number of members."""
    cls, part = F.concat(F.lit("s"), (F.col("p_partkey") % 50).cast("string")), F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    p = table(spark, sf, "part")
    edges = p.select(cls.alias("src"), part.alias("dst"), F.lit("inherits").alias("edge_type"), F.col("p_partkey").alias("o"))
    first = graph.parent_class(edges, F.col("o"))
    members = graph.child_methods(edges.withColumn("edge_type", F.lit("contains"))).groupBy("id").agg(F.count("child").alias("n_children"))
    return first.join(members, "id")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name || '.py' WHEN p_partkey % 4 = 1 THEN p_name WHEN p_partkey % 4 = 2 THEN p_brand ELSE 'method' END AS label, 'p' || p_partkey || '->' || p_brand || ':calls' AS edge_key,
    CASE WHEN p_size > 10 THEN p_brand || '_' || p_type ELSE CAST(p_partkey AS VARCHAR) END AS stem, round(least(2.0::DOUBLE + 0.01::DOUBLE * greatest(0, p_size * 20 - 250), 8.0::DOUBLE), 6) AS scale FROM part"""
)
def graph_labels(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey") % 4
    key = F.col("p_partkey").cast("string")
    label = text.node_label(F.when(k == 1, F.col("p_name")).otherwise(""), F.when(k == 2, F.col("p_brand")), F.lit("method"), F.concat(F.lit("src/"), "p_type", F.lit("/"), "p_name", F.lit(".py")), k == 0)
    stem = text.index_stem(F.when(F.col("p_size") > 10, F.col("p_brand")), F.col("p_type"), key)
    return p.select("p_partkey", label.alias("label"), text.edge_key(F.concat(F.lit("p"), key), F.col("p_brand"), F.lit("calls")).alias("edge_key"), stem.alias("stem"), F.round(text.physics_scale(F.col("p_size") * 20, 2.0, 0.01, 8.0), 6).alias("scale"))


@query(
    f"""WITH {_SYMBOLS}, cl AS (SELECT file_id, name, min(ordinal) AS src FROM sy WHERE kind = 'class' GROUP BY ALL)
    SELECT cl.src, m.id AS dst FROM sy m JOIN cl ON cl.file_id = m.file_id AND cl.name = m.name WHERE m.kind = 'method'"""
)
def containment_edges(spark, sf):
    s = _symbols(spark, sf).withColumn("class_name", F.col("name"))
    return resolve.containment(s)


@query(
    f"""WITH {_SYMBOLS}, b AS (SELECT id AS src, file_id, unnest([name, 'Brand#11']) AS base, unnest([0, 1]) AS pos FROM sy WHERE kind = 'class'),
    c AS (SELECT b.src, b.pos, sy.id AS dst, row_number() OVER (PARTITION BY b.src, b.pos ORDER BY CASE WHEN sy.file_id = b.file_id THEN 0 ELSE 1 END, sy.ordinal) AS k FROM b JOIN sy ON sy.name = b.base AND sy.kind = 'class')
    SELECT src, dst, pos AS ordinal FROM c WHERE k = 1"""
)
def inheritance_edges(spark, sf):
    s = _symbols(spark, sf)
    bases = s.where("kind = 'class'").select(F.col("id").alias("src"), "file_id", F.concat("name", F.lit(", Brand#11")).alias("bases"))
    return resolve.inheritance(bases, s)


@query(
    """WITH f AS (SELECT page_id AS file_id, 'src/m' || page_id || '.py' AS path FROM pages),
    r AS (SELECT page_id AS file_id, 'src.m' || (page_id * 7 % 1009) AS module FROM pages)
    SELECT DISTINCT r.file_id AS src, f.file_id AS dst FROM r JOIN f ON f.path = replace(r.module, '.', '/') || '.py' WHERE r.file_id <> f.file_id"""
)
def import_resolution(spark, sf):
    p = table(spark, sf, "pages")
    name = lambda c: F.concat(F.lit("src/m"), c.cast("string"), F.lit(".py"))
    files = p.select(F.col("page_id").alias("file_id"), name(F.col("page_id")).alias("relative_path"), F.lit("python").alias("language"))
    refs = p.select(F.col("page_id").alias("file_id"), F.lit("src").alias("directory"), F.lit("python").alias("language"), F.concat(F.lit("src.m"), (F.col("page_id") * 7 % 1009).cast("string")).alias("module"), F.lit(0).alias("level"))
    return resolve.imports(refs, files)


# --- chunks and context ---

_LINES = "ln AS (SELECT doc_id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS ls FROM documents), sz AS (SELECT doc_id, ls, len(ls)::INTEGER AS n FROM ln)"


@query(
    f"""WITH {_LINES}, w AS (SELECT doc_id, ls, n, unnest(range(0, CAST(ceil(greatest(n - 10, 0) / 8.0) AS INTEGER) * 8 + 1, 8)) + 1 AS a FROM sz WHERE n > 0)
    SELECT doc_id AS file_id, CAST(a AS INTEGER) AS start_line, CAST(least(a + 9, n) AS INTEGER) AS end_line, md5(array_to_string(ls[a:least(a + 9, n)], '')) AS code_md5 FROM w"""
)
def sliding_chunks(spark, sf):
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "text")
    return chunking.sliding(files, 10, 8).select("file_id", "start_line", "end_line", F.md5("raw_code").alias("code_md5"))


def _line_chunks(spark, sf) -> DataFrame:
    """Lines that are not empty, as chunks."""
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.posexplode(text.lines_of(F.col("text"))).alias("i", "code"))
    return lines.where(F.trim(F.regexp_replace("code", "\n", "")) != "").select("file_id", F.concat_ws(":", F.col("file_id").cast("string"), F.lpad((F.col("i") + 1).cast("string"), 10, "0")).alias("chunk_id"), (F.col("i") + 1).alias("start_line"), (F.col("i") + 1).alias("end_line"), "code")


_CHUNKS = f"{_LINES}, ck AS (SELECT doc_id AS file_id, doc_id || ':' || lpad(CAST(i AS VARCHAR), 10, '0') AS chunk_id, i::INTEGER AS a, ls[i] AS code, n FROM (SELECT doc_id, ls, n, unnest(range(1, n + 1)) AS i FROM sz) WHERE trim(replace(ls[i], chr(10), '')) <> '')"
_PARENT = """pr AS (SELECT *, a - 4 AS a1, a + 5 AS b1 FROM ck), p2 AS (SELECT *, greatest(a1, 1) AS a2, CASE WHEN a1 < 1 THEN least(b1 + 1 - a1, n) ELSE b1 END AS b2 FROM pr),
p3 AS (SELECT *, CASE WHEN b2 > n THEN greatest(a2 - (b2 - n), 1) ELSE a2 END AS parent_start, least(b2, n) AS parent_end FROM p2)"""


@query(f"WITH {_CHUNKS}, {_PARENT} SELECT file_id, chunk_id, CAST(parent_start AS INTEGER) AS parent_start, CAST(parent_end AS INTEGER) AS parent_end FROM p3")
def parent_chunks(spark, sf):
    sizes = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.size(text.lines_of(F.col("text"))).alias("n_lines"))
    return chunking.parents(_line_chunks(spark, sf).drop("code"), sizes, 10).select("file_id", F.col("chunk_id"), "parent_start", "parent_end")


@query(
    f"""WITH {_CHUNKS}, {_PARENT}, f AS (SELECT file_id, parent_start, parent_end, chunk_id, row_number() OVER (PARTITION BY file_id, parent_start, parent_end ORDER BY chunk_id) AS k FROM p3)
    SELECT file_id, CAST(parent_start AS INTEGER) AS parent_start, CAST(parent_end AS INTEGER) AS parent_end, chunk_id AS label_chunk FROM f WHERE k = 1"""
)
def small_to_big(spark, sf):
    sizes = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.size(text.lines_of(F.col("text"))).alias("n_lines"))
    wide = chunking.parents(_line_chunks(spark, sf).drop("code"), sizes, 10)
    return keep_first(wide, ["file_id", "parent_start", "parent_end"], F.col("chunk_id")).select("file_id", "parent_start", "parent_end", F.col("chunk_id").alias("label_chunk"))


@query(
    """WITH b AS (SELECT source AS query_id, doc_id AS rank, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(ceil(length(text) / 4.0) AS BIGINT) END AS tokens FROM documents),
    r AS (SELECT *, row_number() OVER w AS n, sum(tokens + CASE WHEN row_number_ > 1 THEN 2 ELSE 0 END) OVER w AS run FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS row_number_ FROM b) WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
    c AS (SELECT *, min(CASE WHEN run > 4000 AND n > 1 THEN n END) OVER (PARTITION BY query_id) AS cut FROM r)
    SELECT query_id, rank, tokens, cut IS NOT NULL AS truncated FROM c WHERE n = 1 OR cut IS NULL OR n < cut"""
)
def context_budget(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), text.token_count(F.col("text")).alias("tokens"))
    return context.within_budget(d, 4000)


@query(
    """WITH s AS (SELECT l_orderkey % 2000 AS file_id, l_orderkey * 10 + l_linenumber AS chunk_id, l_partkey % 300 + 1 AS a, l_partkey % 300 + 1 + CAST(l_quantity AS INTEGER) AS b FROM lineitem),
    p AS (SELECT o_orderkey AS point_id, o_orderkey % 2000 AS file_id, CAST(o_custkey % 350 + 1 AS INTEGER) AS line FROM orders),
    m AS (SELECT point_id, chunk_id, b - a AS width, row_number() OVER (PARTITION BY point_id ORDER BY b - a, a, chunk_id) AS rank FROM p JOIN s ON s.file_id = p.file_id AND line BETWEEN a AND b)
    SELECT point_id, chunk_id, CAST(width AS INTEGER) AS width FROM m WHERE rank = 1""",
)
def enclosing_chunk_lookup(spark, sf):
    start = (F.col("l_partkey") % 300 + 1).cast("int")
    chunks = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 2000).alias("file_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), start.alias("start_line"), (start + F.col("l_quantity").cast("int")).alias("end_line"))
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("point_id"), (F.col("o_orderkey") % 2000).alias("file_id"), (F.col("o_custkey") % 350 + 1).cast("int").alias("line"))
    return chunking.narrowest(points, chunks).select("point_id", "chunk_id", "width")


@query(
    """WITH c AS (SELECT conv_id, turn, 'see src/' || conv_id % 7 || '/' || role || '.py and ' || substr(text, 1, 40) AS answer, conv_id, turn, role, text FROM conversations)
    SELECT c.conv_id, c.turn, d.doc_id, contains(answer, 'src/' || d.doc_id % 5 || '/user.py') AND (CASE WHEN d.doc_id % 4 = 0 THEN split_part(d.text, ' ', 1) WHEN d.doc_id % 4 = 1 THEN split_part(d.text, ' ', 2) END IS NULL
    OR CASE WHEN d.doc_id % 4 = 0 THEN split_part(d.text, ' ', 1) WHEN d.doc_id % 4 = 1 THEN split_part(d.text, ' ', 2) END = '' OR contains(answer, CASE WHEN d.doc_id % 4 = 0 THEN split_part(d.text, ' ', 1) WHEN d.doc_id % 4 = 1 THEN split_part(d.text, ' ', 2) END)) AS cited
    FROM c JOIN documents d ON d.doc_id = c.conv_id"""
)
def citation_match(spark, sf):
    """Answers name a path and the beginning of a text; the document stands for a function, a class, or neither."""
    word = lambda i: F.split_part("d.text", F.lit(" "), F.lit(i))
    c, d = table(spark, sf, "conversations").alias("c"), table(spark, sf, "documents").alias("d")
    both = c.join(d, F.col("c.conv_id") == F.col("d.doc_id"))
    answer = F.concat(F.lit("see src/"), (F.col("c.conv_id") % 7).cast("string"), F.lit("/"), F.col("c.role"), F.lit(".py and "), F.substring("c.text", 1, 40))
    path = F.concat(F.lit("src/"), (F.col("d.doc_id") % 5).cast("string"), F.lit("/user.py"))
    function, cls = F.when(F.col("d.doc_id") % 4 == 0, word(1)), F.when(F.col("d.doc_id") % 4 == 1, word(2))
    return both.select("conv_id", "turn", "doc_id", text.is_cited(answer, path, function, cls).alias("cited"))


_BLOCKS = """ch AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, text,
  'Repository: repo' || chr(10) || 'File Path: src/' || source || '/' || doc_id || '.txt' || chr(10) || 'Language: ' || lang || chr(10) || 'Chunk Type: sliding' || chr(10) || 'Function Name: ' ||
  CASE WHEN doc_id % 2 = 0 THEN 'fn' || doc_id ELSE 'None' END || chr(10) || 'Class Name: None' || chr(10) || 'Raw Code:' || chr(10) AS head FROM documents),
sh AS (SELECT c.source AS query_id, c.id, c.rank, CASE WHEN p.id IS NULL THEN c.id ELSE p.id END AS display_id, c.head || coalesce(p.text, c.text) AS block FROM ch c LEFT JOIN ch p ON c.doc_id % 3 = 1 AND p.doc_id = c.doc_id - 1),
d1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, display_id ORDER BY rank) AS k FROM sh) WHERE k = 1),
bt AS (SELECT *, CAST(ceil(length(block) / 4.0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM d1),
br AS (SELECT *, sum(tokens + CASE WHEN n > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS run FROM bt),
bc AS (SELECT *, min(CASE WHEN run > 4000 AND n > 1 THEN n END) OVER (PARTITION BY query_id) AS cut FROM br),
bk AS (SELECT * FROM bc WHERE n = 1 OR cut IS NULL OR n < cut)"""


@query(
    f"""WITH {_BLOCKS} SELECT query_id, md5(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_md5, CAST(ceil(length(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) / 4.0) AS BIGINT) AS total_tokens,
    string_agg(display_id, ',' ORDER BY rank) AS shown, bool_or(cut IS NOT NULL) AS truncated FROM bk GROUP BY query_id"""
)
def context_build(spark, sf):
    """Documents of a source in their order as one context; every third stands for a part of the one before it, which is shown instead."""
    d = table(spark, sf, "documents")
    doc = F.col("doc_id").cast("string")
    none = F.lit(None).cast("string")
    chunks = d.select(
        doc.alias("chunk_id"), doc.alias("file_id"), F.concat(F.lit("src/"), "source", F.lit("/"), doc, F.lit(".txt")).alias("file_path"), F.col("lang").alias("language"), F.lit("sliding").alias("chunk_type"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("fn"), doc)).alias("function_name"), none.alias("class_name"), F.when(F.col("doc_id") % 3 == 1, (F.col("doc_id") - 1).cast("string")).alias("parent_chunk_id"), F.col("text").alias("raw_code"),
    )
    matches = ranked(d.select(F.col("source").alias("query_id"), "doc_id", doc.alias("chunk_id")), ["query_id"], F.col("doc_id")).drop("doc_id")
    out = context.build(matches, chunks, "repo", 4000)
    return out.select("query_id", F.md5("context").alias("context_md5"), "total_tokens", F.array_join("display_ids", ",").alias("shown"), "truncated")


# --- cache and tables ---


def _conflict_sql(a: str, b: str) -> str:
    """Whether both texts name alternatives of one category and none in common."""
    out = []
    for category in text.CONFUSABLE:
        named = lambda x: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({x}), '\\b(?:{'|'.join(v)})\\b') THEN {i} END" for i, v in enumerate(category)) + "], lambda v: v IS NOT NULL)"  # noqa: B023, E731
        out.append(f"(len({named(a)}) > 0 AND len({named(b)}) > 0 AND NOT list_has_any({named(a)}, {named(b)}))")
    return "(" + " OR ".join(out) + ")"


@query(
    f"""WITH en AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 100 <> 0), q AS (SELECT vec_id AS query_id, embedding AS q, label FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id, {COSINE.format('embedding', 'q')} AS sim FROM en JOIN q USING (label)),
    tx AS (SELECT s.*, a.text AS ta, b.text AS tb, {_CONTENT.format('a.text')} AS x, {_CONTENT.format('b.text')} AS y FROM s JOIN documents a ON a.doc_id = s.query_id JOIN documents b ON b.doc_id = s.vec_id WHERE sim >= 0.1),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, tb) AS k FROM tx WHERE {_SHARE} >= 0.02 AND NOT {_conflict_sql('ta', 'tb')})
    SELECT query_id, vec_id, round(sim, 6) AS similarity FROM r WHERE k = 1"""
)
def semantic_cache_lookup(spark, sf):
    """Every hundredth row asks; the others are what the cache holds."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("query"))
    e = table(spark, sf, "embeddings").join(d, F.col("vec_id") == F.col("doc_id")).select("vec_id", "embedding", F.col("label").cast("string").alias("repository_id"), "query")
    entries = e.where("vec_id % 100 <> 0").select("repository_id", "query", F.col("embedding").alias("query_embedding"), F.col("vec_id").cast("string").alias("response"), F.array(F.col("vec_id").cast("string")).alias("retrieved_chunk_ids"))
    asked = e.where(_HUNDREDTH).select(F.col("vec_id").alias("query_id"), "repository_id", "query", F.col("embedding").alias("vector"))
    found = cache.lookup(entries, asked, threshold=0.1, lexical=0.02)
    return found.select("query_id", F.col("response").cast("bigint").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


_TERMS = ["backend", "front-end", "log in", "sign out", "register", "get", "post", "read", "write", "dev", "production", "sync", "asynchronous", "device"]
_PHRASES = "(SELECT o_orderkey, 'how does the ' || {0}[o_orderkey % 14 + 1] || ' route use ' || o_orderpriority AS a, 'which ' || {0}[(o_custkey * 5 + 3) % 14 + 1] || ' route is ' || o_orderstatus || ' 1-URGENT' AS b FROM orders)".format("[" + ", ".join(f"'{t}'" for t in _TERMS) + "]")


@query(f"WITH p AS {_PHRASES}, c AS (SELECT *, {_CONTENT.format('a')} AS x, {_CONTENT.format('b')} AS y, {_conflict_sql('a', 'b')} AS conflict FROM p) SELECT o_orderkey, conflict, NOT conflict AND {_SHARE} >= 0.3 AS compatible FROM c")
def lexical_gate(spark, sf):
    terms = F.array(*map(F.lit, _TERMS))
    a = F.concat(F.lit("how does the "), F.get(terms, (F.col("o_orderkey") % 14).cast("int")), F.lit(" route use "), F.col("o_orderpriority"))
    b = F.concat(F.lit("which "), F.get(terms, ((F.col("o_custkey") * 5 + 3) % 14).cast("int")), F.lit(" route is "), F.col("o_orderstatus"), F.lit(" 1-URGENT"))
    said = table(spark, sf, "orders").select("o_orderkey", a.alias("a"), b.alias("b"))
    read = said.select("o_orderkey", *(f(F.col(c)).alias(f"{c}_{n}") for c in "ab" for n, f in (("named", text.named_terms), ("words", text.content_words))))
    judged = read.select("o_orderkey", text.terms_conflict(F.col("a_named"), F.col("b_named")).alias("conflict"), text.jaccard(F.col("a_words"), F.col("b_words")).alias("share"))
    return judged.select("o_orderkey", "conflict", (~F.col("conflict") & (F.col("share") >= 0.3)).alias("compatible"))


@query(
    """WITH o AS (SELECT conv_id, role, text, turn FROM conversations WHERE turn < 2), n AS (SELECT * FROM (SELECT conv_id, role, text, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS k FROM conversations WHERE turn >= 2) WHERE k = 1)
    SELECT conv_id, role, md5(text) AS text_md5, turn FROM n UNION ALL SELECT conv_id, role, md5(text), turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM o) o1 WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.conv_id = o1.conv_id AND n.role = o1.role)"""
)
def cache_upsert(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "role", "text", "turn")
    return tables.upsert(c.where("turn < 2"), c.where("turn >= 2"), ["conv_id", "role"], F.col("turn").desc()).select("conv_id", "role", F.md5("text").alias("text_md5"), "turn")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE 'new' END AS origin, n_chars FROM documents")
def insert_only_merge(spark, sf):
    d = table(spark, sf, "documents")
    old = d.where("doc_id % 3 = 0").select("doc_id", F.lit("old").alias("origin"), "n_chars")
    return tables.insert_only(old, d.select("doc_id", F.lit("new").alias("origin"), "n_chars"), ["doc_id"], F.col("n_chars"))


@query("SELECT source, doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'new' ELSE 'old' END AS origin FROM documents WHERE source NOT IN ('src1', 'src2') OR doc_id % 3 = 0")
def replace_merge(spark, sf):
    d = table(spark, sf, "documents")
    old = d.select("source", "doc_id", F.lit("old").alias("origin"))
    new = d.where("source IN ('src1', 'src2') AND doc_id % 3 = 0").select("source", "doc_id", F.lit("new").alias("origin"))
    return tables.replace_scope(old, new, "source")


@query(
    """SELECT DISTINCT l_orderkey % 3 AS repository_id, 'p' || l_partkey AS source_chunk_id, 's' || l_suppkey AS target_chunk_id FROM lineitem
    WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25 AND p_partkey % 3 = l_orderkey % 3) AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0)"""
)
def edge_semi_join_load(spark, sf):
    """Parts are chunks of one repository each, suppliers of all three."""
    pre = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 3).alias("repository_id"), pre("p", "l_partkey").alias("source_chunk_id"), pre("s", "l_suppkey").alias("target_chunk_id")).distinct()
    chunks = table(spark, sf, "part").where("p_size > 25").select((F.col("p_partkey") % 3).alias("repository_id"), pre("p", "p_partkey").alias("chunk_id"))
    own = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(3)))).alias("repository_id"), pre("s", "s_suppkey").alias("chunk_id"))
    return tables.known_edges(e, chunks.unionByName(own)).select("repository_id", "source_chunk_id", "target_chunk_id")


@query("SELECT 'p' || l_partkey AS id FROM lineitem WHERE l_partkey % 2 = 1 UNION SELECT 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey FROM nation UNION SELECT 'r' || n_regionkey FROM nation")
def graph_missing_nodes(spark, sf):
    """Suppliers and even parts are nodes."""
    nodes = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    parts = table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return graph.missing_nodes(_edges(spark, sf), nodes.unionByName(parts))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def orphan_rows(spark, sf):
    return tables.orphans(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").where("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT count(*) AS n_files, (SELECT count(*) FROM conversations) AS n_chunks, count(DISTINCT source) AS n_repositories, CAST(count(*) FILTER (WHERE lang = 'en') AS BIGINT) AS n_english FROM documents")
def index_summary_counts(spark, sf):
    d = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("source").alias("n_repositories"), F.count_if(F.col("lang") == "en").alias("n_english"))
    c = table(spark, sf, "conversations").agg(F.count(F.lit(1)).alias("n_chunks"))
    return d.crossJoin(c)  # one row each


# --- review ---


_KIND = "CASE event_id % {0} WHEN 0 THEN 'missing_null_check' WHEN 1 THEN 'untested_branch' WHEN 2 THEN 'type_mismatch' WHEN 3 THEN 'exception_handling' WHEN 4 THEN 'breaking_change' WHEN 5 THEN 'security' ELSE 'style' END"


@query(
    f"""WITH e AS (SELECT event_id, user_id, {_KIND.format(7)} AS kind, event_id % 7 < 6 AND user_id % 5 <> 0 AND event_id % 13 <> 0 AND event_id % 4 <> 2 AND event_id % 17 <> 0 AS good FROM events)
    SELECT event_id, CASE WHEN good THEN 2 END AS n_claims, CASE WHEN good THEN kind END AS claim_type, CASE WHEN good THEN 'f' || user_id || '.py' END AS file, CASE WHEN good THEN CAST(event_id % 90 + 1 AS INTEGER) END AS line FROM e"""
)
def json_claims_parse(spark, sf):
    """Every event is an answer of two claims: an array, the same in an object, an object with two keys, or text that is no JSON; some name unknown kinds or files or say nothing."""
    kinds = F.array(*(F.lit(k) for k in (*review.CLAIM_KINDS, "style")))
    user = F.col("user_id").cast("string")
    claim = F.struct(
        F.get(kinds, (F.col("event_id") % 7).cast("int")).alias("claim_type"),
        F.concat(F.lit("f"), user, F.lit(".py:"), (F.col("event_id") % 90 + 1).cast("string")).alias("location"),
        F.when(F.col("event_id") % 13 == 0, "").otherwise(F.col("event_type")).alias("assertion"),
        F.lit('assert "x" != y').alias("proposed_test"),
    )
    both = F.to_json(F.array(claim, claim))
    shapes = [both, F.concat(F.lit('{"claims": '), both, F.lit("}")), F.concat(F.lit('{"claims": '), both, F.lit(', "more": 1}')), F.concat(F.lit(" \n"), both)]
    raw = F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("Here: "), both)).otherwise(F.get(F.array(*shapes), (F.col("event_id") % 4).cast("int")))
    files = F.when(F.col("user_id") % 5 == 0, F.array(F.lit("other.py"))).otherwise(F.array(F.lit("other.py"), F.concat(F.lit("f"), user, F.lit(".py"))))
    answers = table(spark, sf, "events").select("event_id", raw.alias("raw"), files.alias("files"))
    parsed = answers.select("event_id", review.parse_claims(F.col("raw"), F.col("files")).alias("claims"))
    second = parsed.select("event_id", F.when(F.col("claims").isNotNull(), F.size("claims")).alias("n_claims"), F.get("claims", F.lit(1)).alias("c"))
    return second.select("event_id", "n_claims", F.col("c.claim_type").alias("claim_type"), review.location_file(F.col("c.location")).alias("file"), review.location_line(F.col("c.location")).alias("line"))


@query(
    """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'needs_human_review' ELSE 'maybe' END AS verdict, CAST(event_id % 12 AS INTEGER) / 10.0 AS trust, event_id % 9 <> 0 AS cites, event_id % 5 = 0 AS reports, user_id % 3 AS open FROM events),
    v AS (SELECT *, verdict <> 'maybe' AND trust <= 1.0 AND cites AS good FROM e)
    SELECT event_id, CASE WHEN good THEN verdict END AS verdict, CASE WHEN good THEN round(trust, 2) END AS confidence, CASE WHEN good THEN open > 0 AND NOT reports AND trust >= 0.7 ELSE FALSE END AS too_sure FROM v"""
)
def json_verdicts_parse(spark, sf):
    """Every event is a verdict; some are unknown, beyond 1, or cite nothing."""
    words = F.array(*(F.lit(v) for v in (*review.VERDICTS, "maybe")))
    cited = F.when(F.col("event_id") % 9 == 0, F.lit("")).otherwise(F.lit(', "cited_evidence": ["c1"]'))
    minority = F.when(F.col("event_id") % 5 == 0, F.lit(', "minority_report": "one dissents"')).otherwise(F.lit(""))
    trust = (F.col("event_id") % 12).cast("int") / 10
    raw = F.concat(F.lit('{"verdict": "'), F.get(words, (F.col("event_id") % 4).cast("int")), F.lit('", "confidence": '), trust.cast("string"), cited, minority, F.lit("}"))
    v = review.parse_verdict(raw)
    open_ = F.col("user_id") % 3
    sure = review.too_sure(F.when(open_ > 0, "cap").otherwise("resolution"), open_, v["confidence"], v["minority_report"])
    return table(spark, sf, "events").select("event_id", v["verdict"].alias("verdict"), F.round(v["confidence"], 2).alias("confidence"), F.coalesce(sure & v.isNotNull(), F.lit(False)).alias("too_sure"))


_HUNKS = """o AS (SELECT o_orderkey AS diff_id, 'src/f' || (o_orderkey % 50) || '.py' AS file, o_orderkey % 4 AS k, CAST(o_custkey % 300 + 1 AS INTEGER) AS a, CAST(o_custkey % 300 + 1 + o_orderkey % 3 AS INTEGER) AS c FROM orders),
hu AS (SELECT diff_id, file, 1 AS part, CASE k WHEN 2 THEN c ELSE c + 1 END AS start_line, CASE k WHEN 0 THEN c + 1 WHEN 1 THEN c + 2 ELSE c END AS end_line, CASE k WHEN 1 THEN a ELSE a + 1 END AS old_start_line, CASE k WHEN 1 THEN a ELSE a + 1 END AS old_end_line FROM o WHERE k < 3
  UNION ALL SELECT diff_id, file, 2, c + 101, c + 101, a + 100, a + 100 FROM o WHERE k < 3 AND diff_id % 5 = 0)"""


def _diffs(spark, sf) -> DataFrame:
    """A diff for every order: a changed line, two new lines, a deleted line, or a deleted file; some have a second hunk."""
    n = lambda c: c.cast("int").cast("string")
    k, a = F.col("o_orderkey") % 4, F.col("o_custkey") % 300 + 1
    c = a + F.col("o_orderkey") % 3
    path = F.concat(F.lit("src/f"), (F.col("o_orderkey") % 50).cast("string"), F.lit(".py"))
    head = F.concat(F.lit("diff --git x y\nindex 12ab..34cd 100644\n--- a/"), path, F.lit("\n+++ "), F.when(k == 3, "/dev/null").otherwise(F.concat(F.lit("b/"), path)), F.lit("\n"))
    hunk = lambda olds, news, body: F.concat(F.lit("@@ -"), n(a), F.lit(f",{olds} +"), n(c), F.lit(f",{news} @@ def x():\n{body}"))
    body = F.when(k == 0, hunk(3, 3, " one\n-two\n+new\n three\n")).when(k == 1, hunk(2, 4, " one\n+new\n+newer\n two\n")).when(k == 2, hunk(3, 2, " one\n-two\n three\n")).otherwise("@@ -1,2 +0,0 @@\n-one\n-two\n")
    second = F.when((k < 3) & (F.col("o_orderkey") % 5 == 0), F.concat(F.lit("@@ -"), n(a + 100), F.lit(" +"), n(c + 100), F.lit(",2 @@\n one\n+new\n"))).otherwise("")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("diff_id"), F.concat(head, body, second).alias("diff"))


@query(f"WITH {_HUNKS} SELECT diff_id, file, start_line, end_line, old_start_line, old_end_line FROM hu")
def diff_locations(spark, sf):
    return review.changed_locations(_diffs(spark, sf)).drop("hunk")


@query(
    f"""WITH {_HUNKS}, s AS (SELECT 'src/f' || (l_orderkey % 50) || '.py' AS file, l_orderkey * 10 + l_linenumber AS chunk_id, l_partkey % 300 + 1 AS a, l_partkey % 300 + 1 + CAST(l_quantity AS INTEGER) AS b FROM lineitem WHERE l_linenumber <> 3),
    m AS (SELECT diff_id, part, chunk_id, row_number() OVER (PARTITION BY diff_id, part ORDER BY b - a, a, chunk_id) AS k FROM hu JOIN s ON s.file = hu.file AND old_start_line BETWEEN a AND b)
    SELECT DISTINCT diff_id, chunk_id FROM m WHERE k = 1"""
)
def diff_functions(spark, sf):
    """Lines of third place are chunks of no syntax, which are never changed functions."""
    start = (F.col("l_partkey") % 300 + 1).cast("int")
    path = F.concat(F.lit("src/f"), (F.col("l_orderkey") % 50).cast("string"), F.lit(".py"))
    chunks = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), path.alias("file_id"), path.alias("file_path"), F.when(F.col("l_linenumber") == 3, "sliding").otherwise("function").alias("chunk_type"), start.alias("start_line"), (start + F.col("l_quantity").cast("int")).alias("end_line"))
    return review.changed_functions(review.changed_locations(_diffs(spark, sf)), chunks).select("diff_id", "chunk_id")


@query("SELECT o_orderkey, 'test ' || CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus || ' ' END || 'f' || (o_orderkey % 50) AS phrase, length(o_orderpriority) AS n FROM orders")
def fallback_phrases(spark, sf):
    path = F.concat(F.lit("src/lib/f"), (F.col("o_orderkey") % 50).cast("string"), F.lit(".py"))
    function = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus"))
    stripped = review.strip_index_lines(F.concat(F.lit("index 0a1b..ff 100644\n"), "o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", text.fallback_phrase(function, path).alias("phrase"), F.length(stripped).alias("n"))


@query("SELECT user_id AS case_id, CASE WHEN i = 0 THEN 'a' WHEN i = 1 THEN 'b' ELSE 'c' END AS condition, CASE WHEN i = 0 THEN max(value) > 95 WHEN i = 1 THEN count(*) FILTER (WHERE event_type = 'click') > 0 ELSE user_id % 3 <> 0 END AS flagged FROM events, range(3) t(i) GROUP BY user_id, i")
def review_flags(spark, sf):
    cases = table(spark, sf, "events").groupBy(F.col("user_id").alias("case_id")).agg((F.max("value") > 95).alias("has_issue"), F.count_if(F.col("event_type") == "click").alias("n_claims"))
    return review.flags(cases.withColumn("verdict", F.when(F.col("case_id") % 3 == 0, "approve").otherwise("reject")))


@query(
    """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_suppkey AS file, CAST(l_partkey % 500 AS INTEGER) AS line FROM lineitem),
    f AS (SELECT o_orderkey AS finding_id, o_custkey % 100 + 1 AS file, CAST(o_orderkey % 500 AS INTEGER) AS line FROM orders)
    SELECT claim_id, finding_id FROM c JOIN f ON c.file = f.file AND f.line BETWEEN c.line - 2 AND c.line + 2""",
)
def line_proximity_band(spark, sf):
    claims = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 500).cast("int").alias("line"))
    findings = table(spark, sf, "orders").select(F.col("o_orderkey").alias("finding_id"), (F.col("o_custkey") % 100 + 1).alias("file"), (F.col("o_orderkey") % 500).cast("int").alias("line"))
    return review.near_findings(claims, findings)


_STATUS = f"""WITH e AS (SELECT event_id, user_id, {_KIND.format(6)} AS kind, CAST(value AS INTEGER) % 3 AS code, event_id % 11 = 0 AS timed_out, event_id % 7 <> 0 AS has_test FROM events),
s AS (SELECT *, CASE WHEN kind IN ('security', 'type_mismatch') THEN CASE WHEN user_id % 2 = 0 THEN (CASE WHEN code = 1 THEN 'confirmed' ELSE 'refuted' END) ELSE 'inconclusive' END
 WHEN kind = 'breaking_change' THEN CASE WHEN code = 0 THEN 'refuted' ELSE 'confirmed' END
 ELSE CASE WHEN NOT has_test OR timed_out THEN 'inconclusive' WHEN code = 0 THEN 'refuted' ELSE 'confirmed' END END AS status FROM e)"""


def _evidence(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    kinds = F.array(*(F.lit(k) for k in review.CLAIM_KINDS))
    # DuckDB rounds where Spark cuts off, so both get the rounded value
    code = F.bround("value", 0).cast("int") % 3
    status, trust = review.dispatch(F.get(kinds, (F.col("event_id") % 6).cast("int")), code, F.col("event_id") % 11 == 0, F.col("event_id") % 7 != 0, F.lit(True), F.when(F.col("user_id") % 2 == 0, "python").otherwise("javascript"), code == 1, code)
    return e.select("event_id", F.col("user_id").alias("case_id"), status.alias("status"), trust.alias("confidence"))


@query(_STATUS + " SELECT event_id, status, CASE WHEN status = 'inconclusive' THEN 'low' WHEN kind IN ('security', 'type_mismatch') THEN 'medium' ELSE 'high' END AS confidence FROM s")
def verifier_dispatch(spark, sf):
    return _evidence(spark, sf).select("event_id", "status", "confidence")


@query(_STATUS + " SELECT user_id AS case_id, CASE WHEN bool_and(status <> 'inconclusive') THEN 'resolution' ELSE 'cap' END AS ended_by, CASE WHEN bool_and(status <> 'inconclusive') THEN 2 ELSE 3 END AS rounds, CAST(count(*) FILTER (WHERE status = 'inconclusive') AS BIGINT) AS open_claims FROM s GROUP BY user_id")
def rebuttal_outcome(spark, sf):
    return review.rebuttal_outcome(_evidence(spark, sf))


@query("SELECT user_id, ts, event_type AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS k FROM events) WHERE k = 1")
def event_state_latest(spark, sf):
    return latest_state(table(spark, sf, "events"), "user_id", "ts", "event_type").withColumnRenamed("event_type", "state")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    w = windowed_counts(table(spark, sf, "events"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def ordered_events(spark, sf):
    return ranked(table(spark, sf, "events"), ["user_id"], F.col("ts"), F.col("event_id"), name="seq").select("user_id", "event_id", F.col("seq").cast("bigint").alias("seq"))


# --- evaluation ---

_JUDGED = "j AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY l.doc_id) AS rank, 1 + 3 * quality + toxic AS grade FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
_PREC = f"WITH {_JUDGED}, p AS (SELECT query_id, avg(CASE WHEN grade >= 4 THEN 1.0 ELSE 0.0 END) AS precision, avg(grade) AS mean_grade, count(*) AS considered FROM j WHERE rank <= 5 GROUP BY query_id)"


def _judged(spark, sf) -> DataFrame:
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return ranked(j, ["source"], F.col("doc_id")).select(F.col("source").alias("query_id"), "rank", (1 + 3 * F.col("quality") + F.col("toxic")).alias("grade"))


@query(_PREC + " SELECT query_id, round(precision, 6) AS precision, round(mean_grade, 6) AS mean_grade, considered FROM p")
def precision_at_k(spark, sf):
    return metrics.precision_at_k(_judged(spark, sf), 5, 4).select("query_id", F.round("precision", 6).alias("precision"), F.round("mean_grade", 6).alias("mean_grade"), "considered")


@query(_PREC + " SELECT round(avg(precision), 6) AS mean_precision, round(avg(mean_grade), 6) AS mean_grade, count(*) AS n_queries FROM p")
def mean_of_means(spark, sf):
    return metrics.mean_of_means(metrics.precision_at_k(_judged(spark, sf), 5, 4)).select(F.round("mean_precision", 6).alias("mean_precision"), F.round("mean_grade", 6).alias("mean_grade"), "n_queries")


@query(
    """WITH c AS (SELECT toxic = 1 AS bug, quality = 0 AS fl, doc_id % 5 + 1 AS calls, doc_id * 3 % 1000 AS toks, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 3 END AS rounds FROM labels)
    SELECT round(coalesce(count(*) FILTER (WHERE bug AND fl)::DOUBLE / nullif(count(*) FILTER (WHERE bug), 0), 0), 6) AS catch_rate,
    round(coalesce(count(*) FILTER (WHERE NOT bug AND fl)::DOUBLE / nullif(count(*) FILTER (WHERE NOT bug), 0), 0), 6) AS false_positive_rate,
    round(avg(calls), 6) AS avg_llm_calls, round(avg(toks), 6) AS avg_tokens, round(avg(rounds), 6) AS avg_rounds, CAST(count(*) FILTER (WHERE bug) AS BIGINT) AS n_buggy, CAST(count(*) FILTER (WHERE NOT bug) AS BIGINT) AS n_clean FROM c"""
)
def catch_fp_flip_rates(spark, sf):
    c = table(spark, sf, "labels").select((F.col("toxic") == 1).alias("is_buggy"), (F.col("quality") == 0).alias("flagged"), (F.col("doc_id") % 5 + 1).alias("llm_calls"), (F.col("doc_id") * 3 % 1000).alias("total_tokens"), F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("doc_id") % 3).alias("rounds_used"))
    r = metrics.review_rates(c)
    return r.select(*(F.round(x, 6).alias(x) for x in ("catch_rate", "false_positive_rate", "avg_llm_calls", "avg_tokens", "avg_rounds")), "n_buggy", "n_clean")


@query("SELECT round(avg(CASE WHEN status = 'refuted' THEN 1.0 ELSE 0.0 END), 6) AS flip_rate, count(*) AS n_claims, CAST(count(*) FILTER (WHERE status = 'refuted') AS BIGINT) AS n_refuted FROM (" + _STATUS + " SELECT status FROM s)")
def claim_flip_rate(spark, sf):
    return metrics.claim_flip_rate(_evidence(spark, sf).select((F.col("status") == "refuted").alias("refuted"))).select(F.round("flip_rate", 6).alias("flip_rate"), "n_claims", "n_refuted")


@query("SELECT source, round(avg(n_chars), 6) AS merged_mean, round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END), 6) AS merged_rate, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def merged_means(spark, sf):
    """The mean and rate of all documents of a source but the last, merged with the last."""
    hit = F.col("lang") == "en"
    all_ = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("s"), F.count_if(hit).alias("h"), F.max_by(F.struct(F.col("n_chars").alias("x"), hit.alias("hit")), "doc_id").alias("last")).where("n > 1")
    m = F.col("n") - 1
    old_mean, old_rate = (F.col("s") - F.col("last.x")) / m, (F.col("h") - F.col("last.hit").cast("int")) / m
    return all_.select("source", F.round(metrics.merged_mean(old_mean, m, F.col("last.x")), 6).alias("merged_mean"), F.round(metrics.merged_rate(old_rate, m, F.col("last.hit")), 6).alias("merged_rate"), "n")


_NAMES = ["Dense Retrieval Only", "Dense + BM25", "Dense + BM25 + Graph Expansion", "Dense + BM25 + Graph + Cross Encoder", "Full Pipeline"]


@query(
    f"""WITH {_FUSED}, seed AS (SELECT query_id, id, fused AS score, rank FROM fr WHERE rank <= 8),
    st AS (SELECT b.doc_id AS src, a.doc_id AS dst, 0 AS side FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 UNION ALL SELECT a.doc_id, b.doc_id, 1 FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
    h AS (SELECT seed.query_id, st.dst AS id, seed.score * 0.5 AS score, seed.rank AS fr, side, seed.id AS origin FROM seed JOIN st ON st.src = seed.id WHERE NOT EXISTS (SELECT 1 FROM seed s2 WHERE s2.query_id = seed.query_id AND s2.id = st.dst)),
    h1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fr, side, id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY round(score, 12) DESC, fr, side, origin) AS k FROM h) WHERE k = 1),
    wide AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, round(score, 12) DESC, place, id) AS rank FROM (SELECT query_id, id, score, 0 AS distance, rank AS place FROM seed UNION ALL SELECT query_id, id, score, 1, place FROM h1)),
    cs2 AS (SELECT wide.query_id, wide.id, wide.rank, list_distinct({TOKENS.format('b.text')}) AS x, list_distinct({TOKENS.format("coalesce(d2.text, '')")}) AS y FROM wide JOIN benchmark b ON b.item_id = wide.query_id JOIN documents d2 ON d2.doc_id = wide.id),
    re AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round({_SHARE}, 9) DESC, rank) AS rank FROM cs2),
    a AS (SELECT '{_NAMES[0]}' AS config_name, query_id, id FROM dr WHERE rank <= 5 UNION ALL SELECT '{_NAMES[1]}', query_id, id FROM fr WHERE rank <= 5 UNION ALL SELECT '{_NAMES[2]}', query_id, id FROM wide WHERE rank <= 5
      UNION ALL SELECT '{_NAMES[3]}', query_id, id FROM re WHERE rank <= 5 UNION ALL SELECT '{_NAMES[4]}', query_id, id FROM re WHERE rank <= 5),
    g AS (SELECT config_name, query_id, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN quality = 1 THEN 5 WHEN quality = 0 THEN 2 ELSE 1 END) AS m FROM a LEFT JOIN labels ON labels.doc_id = a.id GROUP BY ALL)
    SELECT config_name, round(avg(p), 6) AS precision, round(avg(m), 6) AS mean_grade, count(*) AS n_queries FROM g GROUP BY config_name"""
)
def ablation_grid(spark, sf):
    """The five configurations over all questions; documents are linked with their neighbours by id.

    Small chunks are shown as their parents only after ranking, so the last two rank alike.
    """
    from plinth.models import overlap_scorer
    from plinth.plans.evaluate import CONFIGURATIONS

    docs, questions = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("code")), _questions(spark, sf)
    near = _near(spark, sf, questions=True)
    hits = sparse.search(_sparse_index(spark, sf), questions, 20).withColumnRenamed("doc_id", "id")
    near, fused = checkpointed(near), checkpointed(fusion.fuse(near, hits, 8))  # a few rows for each question, used several times
    ids = docs.select("id")
    links = ids.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", F.lit("references").alias("edge_type"))
    steps = graph.fan_out(links, ids.select("id", F.lit("chunk").alias("node_kind"), F.lit(None).cast("bigint").alias("file_id")))
    wide = graph.expansion_order(graph.expand(fused.select("query_id", "id", F.col("fused_score").alias("score"), "rank"), steps, 1))
    wide = checkpointed(wide.select("query_id", "id", "score", "rank"))
    seeds = wide.select("query_id", F.col("id").alias("chunk_id"), F.col("score").alias("previous_score"), F.col("rank").alias("place"))
    candidates = docs.withColumnRenamed("id", "chunk_id").join(_near_docs(seeds), "chunk_id").join(questions, "query_id")
    best = checkpointed(context.rerank(candidates, overlap_scorer).select("query_id", F.col("chunk_id").alias("id"), F.col("final_rank").alias("rank")))
    rows = None
    for name, stages in CONFIGURATIONS.items():
        found = best if stages["use_rerank"] else wide if stages["use_graph"] else fused if stages["use_hybrid"] else near
        part = found.select(F.lit(name).alias("config_name"), "query_id", "id", "rank")
        rows = part if rows is None else rows.unionByName(part)
    judged = rows.join(table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality"), "id", "left").withColumn("grade", F.when(F.col("quality") == 1, 5).when(F.col("quality") == 0, 2).otherwise(1))
    per = metrics.precision_at_k(judged.withColumn("run", F.struct("config_name", "query_id")), 5, 4, by="run").select(F.col("run.config_name").alias("config_name"), "precision", "mean_grade")
    means = metrics.ablation_means(per, ["precision", "mean_grade"]).join(per.groupBy("config_name").agg(F.count(F.lit(1)).alias("n_queries")), "config_name")
    return means.select("config_name", F.round("precision", 6).alias("precision"), F.round("mean_grade", 6).alias("mean_grade"), "n_queries")


@query(f"WITH {_DENSE.format(_HUNDREDTH)} SELECT query_id, id, round(score, 6) AS fused_score, 'dense' AS source, rank FROM dr WHERE rank <= 8")
def dense_only(spark, sf):
    return fusion.dense_only(_near(spark, sf), 8).select("query_id", "id", F.round("fused_score", 6).alias("fused_score"), "source", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT round(avg(l_discount), 6) AS faithfulness, round(avg(l_tax), 6) AS answer_relevancy, round(avg(l_quantity / 50), 6) AS context_precision, round(coalesce(avg(CASE WHEN l_linenumber > 1 THEN l_tax END), 0), 6) AS context_recall, count(*) AS n_cases FROM lineitem")
def answer_report(spark, sf):
    li = table(spark, sf, "lineitem")
    r = metrics.answer_report(li.select(F.col("l_discount").alias("faithfulness"), F.col("l_tax").alias("answer_relevancy"), (F.col("l_quantity") / 50).alias("context_precision"), F.when(F.col("l_linenumber") > 1, F.col("l_tax")).alias("context_recall")))
    return r.select(*(F.round(c, 6).alias(c) for c in metrics.ANSWER_METRICS), "n_cases")


@query(f"WITH {_GRAPH}, {_SEEDS}, {_STEPS}, {_HOP1} SELECT query_id, CAST(count(*) AS BIGINT) AS n_expanded FROM h1 GROUP BY query_id")
def expanded_counts(spark, sf):
    return graph.expanded_count(graph.expand(_seeds(spark), _steps(spark, sf), 1))


@query(
    f"""WITH {_SYMBOLS}, si AS (SELECT o_orderkey AS site_id, o_custkey % 10 AS file_id, 'Brand#' || (o_custkey % 6) || (o_orderkey % 6) AS callee FROM orders)
    SELECT file_id, count(*) AS n_sites, CAST(count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM sy WHERE sy.name = si.callee AND sy.kind <> 'class')) AS BIGINT) AS n_unresolved FROM si GROUP BY file_id"""
)
def unresolved_sites(spark, sf):
    name = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 6).cast("string"), (F.col("o_orderkey") % 6).cast("string"))
    sites = table(spark, sf, "orders").select(F.col("o_orderkey").alias("site_id"), F.col("o_custkey").alias("src"), (F.col("o_custkey") % 10).alias("file_id"), name.alias("callee"))
    return resolve.unresolved(sites, resolve.bare_names(sites, _symbols(spark, sf)))


@query("SELECT l_orderkey, l_linenumber, l_partkey % 40 - 2 >= 1 AND l_partkey % 40 - 2 <= l_partkey % 40 - 2 + l_suppkey % 3 - 1 AND l_partkey % 40 - 2 + l_suppkey % 3 - 1 <= 30 AS valid FROM lineitem")
def range_validity(spark, sf):
    a = F.col("l_partkey") % 40 - 2
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", chunking.valid_range(a, a + F.col("l_suppkey") % 3 - 1, F.lit(30)).alias("valid"))


@query("SELECT lang AS config_name, round(m, 6) AS mean_chars FROM (SELECT lang, avg(n_chars) AS m FROM documents GROUP BY lang) ORDER BY m DESC, lang LIMIT 1")
def best_configuration(spark, sf):
    means = metrics.ablation_means(table(spark, sf, "documents").withColumnRenamed("lang", "config_name"), ["n_chars"])
    return metrics.best_config(means, "n_chars").select("config_name", F.round("n_chars", 6).alias("mean_chars"))


@query("SELECT user_id AS case_id, CAST(sum(event_id % 100) AS BIGINT) AS total_tokens, count(*) AS llm_calls FROM events GROUP BY user_id")
def usage_counters(spark, sf):
    return metrics.usage(table(spark, sf, "events").select(F.col("user_id").alias("case_id"), (F.col("event_id") % 100).alias("tokens")))


@query("SELECT round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(value) FILTER (WHERE event_type <> 'click'), 6) AS mean_miss_latency FROM events")
def session_stats(spark, sf):
    s = metrics.session_stats(table(spark, sf, "events").select((F.col("event_type") == "click").alias("cache_hit"), F.col("value").alias("latency")))
    return s.select(F.round("hit_rate", 6).alias("hit_rate"), F.round("mean_miss_latency", 6).alias("mean_miss_latency"))


@query("SELECT source, doc_id, CAST(r AS BIGINT) AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def topk_per_group(spark, sf):
    return top_k(table(spark, sf, "documents"), 3, ["source"], F.col("n_chars").desc(), F.col("doc_id")).select("source", "doc_id", F.col("rank").cast("bigint").alias("rank"))
