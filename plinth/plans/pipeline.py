"""The entry points: index a folder, search, ask, review."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.config import Settings
from plinth.functions.ids import repository_id
from plinth.functions.text import document_text, lines_of
from plinth.models import Encoder, Generator, Scorer, echo_generator, hashed_encoder, overlap_scorer
from plinth.operators import cache, chunking, context, dense, fusion, graph, resolve, review, sparse, syntax
from plinth.operators.ranking import keep_first
from plinth.operators.tables import Store, orphans
from plinth.schemas import LAYOUTS, SYNTAX_KINDS
from plinth.sources.files import discover, graph_to_json


class UnknownRepository(KeyError):
    """No repository has this id (404 of an HTTP front)."""


class NotReady(RuntimeError):
    """The repository is being indexed, or its last run failed (409)."""


class InvalidRequest(ValueError):
    """What is asked for makes no sense (400)."""


#: The status that an HTTP front would answer with.
STATUS = {InvalidRequest: 400, UnknownRepository: 404, NotReady: 409, TimeoutError: 504}


def http_status(error: Exception) -> int:
    return next((code for kind, code in STATUS.items() if isinstance(error, kind)), 500)


@dataclass
class Engine:
    """Plans over one store of tables; every operator works on many questions at once."""

    spark: SparkSession
    root: str
    settings: Settings = field(default_factory=Settings)
    encoder: Encoder = field(default_factory=lambda: hashed_encoder(64))
    scorer: Scorer = overlap_scorer
    generator: Generator = echo_generator
    model_name: str = "hashed-64"

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.root)

    # --- index ---

    def index(self, folder: str, owner: str, name: str, mode: str = "insert_only") -> dict:
        """Read a folder into the tables and indexes; returns counts of what was found and added.

        ``insert_only`` never changes stored rows; ``replace`` puts the new files, chunks and edges of
        the repository in place of the old ones, each table in one step.  Rows are checked before any
        is written: a chunk's parent and both ends of an edge must be known, or nothing changes.
        """
        if mode not in ("insert_only", "replace"):
            raise InvalidRequest("mode must be insert_only or replace")
        rid = self.spark.range(1).select(repository_id(F.lit(owner), F.lit(name))).first()[0]
        self._note(rid, "indexing")
        try:
            out = self._index(rid, folder, owner, name, mode)
        except Exception as e:
            self._note(rid, "failed", str(e)[:500])
            raise
        self._note(rid, "ready")
        return out

    def _note(self, rid: str, state: str, message: str | None = None) -> None:
        row = self.spark.range(1).select(F.lit(rid).alias("repository_id"), F.lit(state).alias("state"), F.lit(message).cast("string").alias("message"), F.current_timestamp().alias("updated_at"))
        self.store.upsert("index_runs", row)

    @staticmethod
    def _check(chunks: DataFrame, edges: DataFrame, files: DataFrame) -> None:
        """Raise if a chunk's parent or an end of an edge is unknown."""
        lost = orphans(chunks, chunks, "parent_chunk_id", "chunk_id").limit(1).count()
        ends = chunks.select(F.col("chunk_id").alias("id")).unionByName(files.select(F.col("file_id").alias("id")))
        if lost or not graph.missing_nodes(edges.select(F.col("source_chunk_id").alias("src"), F.col("target_chunk_id").alias("dst")), ends).isEmpty():
            raise InvalidRequest("a chunk's parent or an end of an edge is unknown")

    def _index(self, rid: str, folder: str, owner: str, name: str, mode: str) -> dict:
        files = discover(self.spark, folder, self.settings.max_file_bytes).cache()
        parsed = syntax.chunks(files.select(F.col("relative_path").alias("path"), "language", "text")).cache()
        broken = parsed.where("error IS NOT NULL").select(F.col("path").alias("relative_path"))
        code = parsed.where("error IS NULL").join(files.select(F.col("relative_path").alias("path"), "language"), "path")
        good = files.join(broken, "relative_path", "left_anti")
        sizes = good.select("file_id", F.size(lines_of(F.col("text"))).alias("n_lines"))
        with_parents = chunking.parents(code.select("file_id", "chunk_id", "start_line", "end_line"), sizes, self.settings.parent_lines)
        line = lambda c: F.col(c).cast("int")
        none = F.lit(None).cast("string")
        families = code.join(with_parents.select("chunk_id", "parent_chunk_id"), "chunk_id", "left").select("chunk_id", "file_id", "parent_chunk_id", "chunk_type", "function_name", "class_name", "parent_class", "language", line("start_line"), line("end_line"), "raw_code")
        shared = with_parents.select("file_id", F.col("parent_chunk_id").alias("chunk_id"), F.col("parent_start").alias("start_line"), F.col("parent_end").alias("end_line")).distinct()
        texts = good.select("file_id", "language", lines_of(F.col("text")).alias("ls"))
        parents = shared.join(texts, "file_id").select("chunk_id", "file_id", none.alias("parent_chunk_id"), F.lit("parent").alias("chunk_type"), none.alias("function_name"), none.alias("class_name"), none.alias("parent_class"), "language", line("start_line"), line("end_line"), F.array_join(F.slice("ls", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "").alias("raw_code"))
        windows = chunking.sliding(good.select("file_id", "text"), self.settings.window_lines, self.settings.window_step).join(good.select("file_id", "language"), "file_id")
        windows = windows.select("chunk_id", "file_id", none.alias("parent_chunk_id"), F.lit("sliding").alias("chunk_type"), none.alias("function_name"), none.alias("class_name"), none.alias("parent_class"), "language", line("start_line"), line("end_line"), "raw_code")
        chunks = families.unionByName(parents).unionByName(windows).withColumn("repository_id", F.lit(rid)).cache()
        edges = self.edges(files, code).select(F.lit(rid).alias("repository_id"), F.col("src").alias("source_chunk_id"), F.col("dst").alias("target_chunk_id"), "edge_type").cache()
        source_files = files.select(F.lit(rid).alias("repository_id"), "file_id", "relative_path", "language", "extension", "size_bytes")
        repo = self.spark.range(1).select(F.lit(rid).alias("repository_id"), F.lit(owner).alias("owner"), F.lit(name).alias("repository_name"), none.alias("clone_url"), F.lit(folder).alias("local_path"), none.alias("default_branch"), none.alias("current_commit_hash"), F.current_timestamp().alias("indexed_at"))
        self._check(chunks, edges, files)
        self.store.upsert("repositories", repo)
        if mode == "replace":
            for table, rows in (("source_files", source_files), ("code_chunks", chunks), ("graph_edges", edges)):
                self.store.replace_scope(table, "repository_id", rid, rows)
            self.store.delete("embeddings", rid)
        added = {"files": self.store.insert_only("source_files", source_files), "chunks": self.store.insert_only("code_chunks", chunks), "edges": self.store.insert_only("graph_edges", edges)}
        wanted = self.store.read("code_chunks").where((F.col("repository_id") == rid) & F.col("chunk_type").isin(*SYNTAX_KINDS))
        fresh = wanted.join(self.store.read("embeddings").where(F.col("model_name") == self.model_name), ["repository_id", "chunk_id"], "left_anti")
        vector = self.encoder(self._text())
        added["embedded"] = self.store.insert_only("embeddings", fresh.select("repository_id", "chunk_id", F.lit(self.model_name).alias("model_name"), F.size(vector).alias("embedding_dimension"), vector.alias("embedding"), F.current_timestamp().alias("created_at")))
        sparse.build_index(wanted.select(F.col("chunk_id").alias("doc_id"), self._text().alias("text"))).save(f"{self.root}/sparse/{rid}")
        for df in (files, parsed, chunks, edges):
            df.unpersist()
        return {"repository_id": rid, **added}

    @staticmethod
    def _text():
        return document_text(F.col("function_name"), F.col("class_name"), F.col("parent_class"), F.col("raw_code"))

    def edges(self, files: DataFrame, code: DataFrame) -> DataFrame:
        """All edges of a repository, one for each ordered pair; the earlier pass wins."""
        sources = files.select(F.col("relative_path").alias("path"), "language", "text")
        symbols = code.select(F.col("chunk_id").alias("id"), "file_id", F.col("chunk_type").alias("kind"), F.coalesce("function_name", "class_name").alias("name"), "class_name", F.concat_ws(":", "path", F.lpad(F.col("ordinal").cast("string"), 9, "0")).alias("ordinal"), "path", "start_line")
        sites = syntax.calls(sources).withColumn("site", F.concat_ws(":", "path", F.lpad(F.col("ordinal").cast("string"), 9, "0")))
        owners = symbols.select("path", F.col("start_line").alias("owner_start"), F.col("name").alias("owner_name"), F.col("id").alias("src"), "file_id", F.col("class_name").alias("caller_class"))
        inner = sites.where("owner_start IS NOT NULL").join(owners, ["path", "owner_start", "owner_name"]).select(F.col("site").alias("site_id"), "src", "file_id", "caller_class", "callee", "is_self", "qualifier")
        calls = resolve.calls(inner, symbols)
        paths = files.select(F.col("relative_path").alias("path"), "file_id")
        outer = sites.where("owner_start IS NULL").join(paths, "path").select(F.col("site").alias("site_id"), F.col("file_id").alias("src"), "file_id", "callee", "is_reference")
        loose = resolve.bare_names(outer.drop("is_reference"), symbols).join(outer.select("site_id", "is_reference"), "site_id").withColumn("edge_type", F.when(F.col("is_reference"), "references").otherwise(F.col("edge_type"))).drop("is_reference")
        bases = code.where("chunk_type = 'class' AND parent_class IS NOT NULL").select(F.col("chunk_id").alias("src"), "file_id", F.col("parent_class").alias("bases"))
        imported = syntax.imports(sources).join(files.select(F.col("relative_path").alias("path"), "file_id", "language", F.regexp_extract("relative_path", r"^(.*)/[^/]*$", 1).alias("directory")), "path")
        order = F.lit("")
        every = (
            resolve.containment(symbols).select("src", "dst", F.lit("contains").alias("edge_type"), F.lit(0).alias("pass"), order.alias("site_id"))
            .unionByName(resolve.inheritance(bases, symbols).select("src", "dst", F.lit("inherits").alias("edge_type"), F.lit(1).alias("pass"), order.alias("site_id")))
            .unionByName(calls.select("src", "dst", "edge_type", F.lit(2).alias("pass"), "site_id"))
            .unionByName(loose.select("src", "dst", "edge_type", F.lit(3).alias("pass"), "site_id"))
            .unionByName(resolve.imports(imported, files.select("relative_path", "file_id", "language")).select("src", "dst", F.lit("imports").alias("edge_type"), F.lit(4).alias("pass"), order.alias("site_id")))
        )
        return graph.first_wins(every, F.col("pass"), F.col("site_id"), F.col("edge_type")).select("src", "dst", "edge_type")

    # --- search and ask ---

    def chunks(self, rid: str) -> DataFrame:
        """Stored chunks of a repository with the paths of their files."""
        files = self.store.read("source_files").where(F.col("repository_id") == rid).select("file_id", F.col("relative_path").alias("file_path"))
        return self.store.read("code_chunks").where(F.col("repository_id") == rid).join(files, "file_id")

    def search(self, rid: str, questions: DataFrame) -> DataFrame:
        """Ranked chunks (query_id, chunk_id, rank, ...) for questions (query_id, query)."""
        s, chunks = self.settings, self.chunks(rid)
        vectors = questions.select("query_id", self.encoder(F.col("query")).alias("vector"))
        near = dense.search(dense.build_index(self.store.read("embeddings").where((F.col("repository_id") == rid) & (F.col("model_name") == self.model_name)), "chunk_id", "embedding"), vectors, s.dense_candidates)
        if s.use_hybrid:
            hits = sparse.search(sparse.SparseIndex.load(self.spark, f"{self.root}/sparse/{rid}"), questions, s.sparse_candidates, s.bm25_k1, s.bm25_b)
            found = fusion.fuse(near, hits.withColumnRenamed("doc_id", "id"), s.final_k, s.rrf_k)
        else:
            found = fusion.dense_only(near, s.final_k)
        seeds = found.select("query_id", "id", F.col("fused_score").alias("score"), "rank", "source")
        if s.use_graph:
            edges = self.store.read("graph_edges").where(F.col("repository_id") == rid).select(F.col("source_chunk_id").alias("src"), F.col("target_chunk_id").alias("dst"), "edge_type")
            nodes = chunks.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("node_kind"), "file_id")
            wide = graph.expansion_order(graph.expand(seeds, graph.fan_out(edges, nodes), s.expansion_hops, s.expansion_decay)).select("query_id", "id", "score", "rank", "distance")
        else:
            wide = seeds.withColumn("distance", F.lit(0)).drop("source")
        candidates = wide.withColumnRenamed("id", "chunk_id").join(chunks, "chunk_id").join(questions, "query_id")
        candidates = candidates.withColumns({"previous_score": F.col("score"), "place": F.col("rank"), "code": F.col("raw_code")}).drop("rank", "score")
        scorer = self.scorer if s.use_rerank else (lambda q, c: F.col("previous_score"))
        if not s.use_rerank:
            from plinth.operators.ranking import ranked

            out = ranked(candidates.withColumn("cross_score", F.col("previous_score")), ["query_id"], F.col("place"), name="final_rank").where(F.col("final_rank") <= s.final_k)
        else:
            out = context.rerank(candidates, scorer, s.final_k)
        return out.select("query_id", "chunk_id", F.col("final_rank").alias("rank"), "cross_score", "previous_score", "distance", "file_path", "function_name", "class_name", "start_line", "end_line")

    def ask(self, rid: str, questions: DataFrame) -> DataFrame:
        """(query_id, answer, context, total_tokens, truncated, cited, from_cache) for questions (query_id, query)."""
        s = self.settings
        asked = questions.withColumn("repository_id", F.lit(rid)).withColumn("vector", self.encoder(F.col("query"))).cache()
        hits = None
        if s.use_cache:
            hits = cache.lookup(self.store.read("semantic_cache"), asked, s.cache_threshold, s.lexical_threshold).select("query_id", F.col("response").alias("answer"), F.lit("").alias("context"), F.lit(0).cast("bigint").alias("total_tokens"), F.lit(False).alias("truncated"), F.col("retrieved_chunk_ids").alias("cited"), F.lit(True).alias("from_cache")).cache()
            asked = asked.join(hits.select("query_id"), "query_id", "left_anti")
        found = self.search(rid, asked.select("query_id", "query")).cache()
        built = context.build(found.select("query_id", "chunk_id", "rank"), self.chunks(rid), rid, s.context_budget, s.use_parents)
        text = F.coalesce("context", F.lit(""))
        answered = asked.select("query_id", "query", "vector").join(built, "query_id", "left").withColumn("answer", self.generator(F.col("query"), text))
        cited = context.citations(answered.select("query_id", "answer"), found.select("query_id", "chunk_id", "file_path", "function_name", "class_name", "rank")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("c"))  # final_k at most
        full = answered.join(cited, "query_id", "left").withColumn("cited", F.coalesce(F.transform("c", lambda x: x["chunk_id"]), F.array().cast("array<string>"))).cache()
        if s.use_cache:
            fresh = full.where(F.col("context").isNotNull()).select(F.lit(rid).alias("repository_id"), "query", F.col("vector").alias("query_embedding"), F.size("vector").alias("embedding_dimension"), F.col("answer").alias("response"), F.col("cited").alias("retrieved_chunk_ids"), F.current_timestamp().alias("created_at"))
            self.store.upsert("semantic_cache", fresh, F.col("created_at").desc())
        out = full.select("query_id", "answer", text.alias("context"), F.coalesce("total_tokens", F.lit(0).cast("bigint")).alias("total_tokens"), F.coalesce("truncated", F.lit(False)).alias("truncated"), "cited", F.lit(False).alias("from_cache"))
        return out.unionByName(hits) if hits is not None else out

    def register_views(self) -> list[str]:
        """The stored tables as temporary views, for SQL; returns their names."""
        for name in LAYOUTS:
            self.store.read(name).createOrReplaceTempView(name)
        return list(LAYOUTS)

    def context_at(self, rid: str, file_path: str, line: int) -> DataFrame:
        """The chunks around a line, narrowest first."""
        point = self.spark.createDataFrame([(1, file_path, line)], "point_id int, file_id string, line int")
        chunks = self.chunks(rid)
        found = chunking.enclosing(point, chunks.select(F.col("file_path").alias("file_id"), "chunk_id", "start_line", "end_line"))
        return found.select("chunk_id", "rank", "width", F.lit(1.0).alias("score"), F.lit("location").alias("source")).join(chunks.drop("start_line", "end_line"), "chunk_id")

    def graph(self, rid: str, focus: str | None = None, hops: int | None = None) -> DataFrame:
        """The edges of a repository, or those within some hops of a node; an unknown node is an error."""
        edges = self.store.read("graph_edges").where(F.col("repository_id") == rid).select(F.col("source_chunk_id").alias("src"), F.col("target_chunk_id").alias("dst"), "edge_type")
        if focus is None:
            return edges
        known = self.chunks(rid).where(F.col("chunk_id") == focus).limit(1).count() or edges.where((F.col("src") == focus) | (F.col("dst") == focus)).limit(1).count()
        if not known:
            raise KeyError(focus)
        radius = graph.blast_radius(edges, self.spark.createDataFrame([(focus,)], "id string"), self.settings.blast_hops if hops is None else hops)
        return graph.induced(edges, radius.select("id"))

    def status(self, rid: str) -> dict:
        """The state (unknown, pending, indexing, failed, ready), the repository's row, and counts of stored files and chunks."""
        run = self.store.read("index_runs").where(F.col("repository_id") == rid).first()
        repo = self.store.read("repositories").where(F.col("repository_id") == rid).first()
        if run is None and repo is None:
            return {"state": "unknown"}
        state = run.state if run else "pending"
        if state != "ready":
            return {"state": state, "message": run.message if run else None}
        row = self.chunks(rid).agg(F.count_distinct("file_id"), F.count(F.lit(1))).first()
        return {"state": state, "files": row[0], "chunks": row[1], "repository": repo.asDict()}

    def require_ready(self, rid: str) -> None:
        """Raise UnknownRepository or NotReady unless the repository can be asked."""
        state = self.status(rid)["state"]
        if state == "unknown":
            raise UnknownRepository(rid)
        if state != "ready":
            raise NotReady(f"{rid} is {state}")

    def snapshot(self, rid: str) -> None:
        """Store the repository's graph as one document; a repository has one snapshot."""
        nodes = self.chunks(rid).select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("node_kind"), "file_id", "file_path", "language", "chunk_type", "function_name", "class_name", "start_line", "end_line")
        doc = graph_to_json(nodes, self.graph(rid)).select(F.lit(rid).alias("repository_id"), "graph_data", F.current_timestamp().alias("updated_at"))
        self.store.upsert("graph_snapshots", doc)

    # --- review ---

    def review(self, rid: str, diffs: DataFrame) -> DataFrame:
        """The bundle of each diff (diff_id, diff): changed functions with callers, callees and tests."""
        chunks = self.chunks(rid).select("chunk_id", "file_id", "file_path", "chunk_type", "function_name", "start_line", "end_line")
        locations = review.changed_locations(diffs)
        functions = review.changed_functions(locations, chunks)
        edges = self.store.read("graph_edges").where(F.col("repository_id") == rid).select(F.col("source_chunk_id").alias("src"), F.col("target_chunk_id").alias("dst"), "edge_type")
        return review.bundle(functions, edges, chunks)

    def related_tests(self, rid: str, bundled: DataFrame, k: int = 5) -> DataFrame:
        """Tests of the changed functions in ``bundled`` (rows of :meth:`review`): test callers, else what a search for the function's phrase finds."""
        chunks = self.chunks(rid).select("chunk_id", "file_path")
        callers = bundled.where((F.col("role") == "caller") & F.col("is_test")).select("diff_id", "chunk_id", F.col("other").alias("test_id"), F.lit(1).alias("rank"), F.lit("graph").alias("found_via"))
        return callers.unionByName(review.fallback_tests(bundled, sparse.SparseIndex.load(self.spark, f"{self.root}/sparse/{rid}"), chunks, k))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    return keep_first(rows, [key], F.col(order).desc())
