"""Column layouts and keys of the stored tables."""

from __future__ import annotations

REPOSITORIES = "repository_id string, owner string, repository_name string, clone_url string, local_path string, default_branch string, current_commit_hash string, indexed_at timestamp"
SOURCE_FILES = "repository_id string, file_id string, relative_path string, language string, extension string, size_bytes bigint"
CODE_CHUNKS = (
    "repository_id string, chunk_id string, file_id string, parent_chunk_id string, chunk_type string, function_name string, class_name string,"
    " parent_class string, language string, start_line int, end_line int, raw_code string"
)
GRAPH_EDGES = "repository_id string, source_chunk_id string, target_chunk_id string, edge_type string"
EMBEDDINGS = "repository_id string, chunk_id string, model_name string, embedding_dimension int, embedding array<float>, created_at timestamp"
SEMANTIC_CACHE = "repository_id string, query string, query_embedding array<float>, embedding_dimension int, response string, retrieved_chunk_ids array<string>, created_at timestamp"
GRAPH_SNAPSHOTS = "repository_id string, graph_data string, updated_at timestamp"

INDEX_RUNS = "repository_id string, state string, message string, updated_at timestamp"

LAYOUTS = {
    "repositories": REPOSITORIES,
    "source_files": SOURCE_FILES,
    "code_chunks": CODE_CHUNKS,
    "graph_edges": GRAPH_EDGES,
    "embeddings": EMBEDDINGS,
    "semantic_cache": SEMANTIC_CACHE,
    "graph_snapshots": GRAPH_SNAPSHOTS,
    "index_runs": INDEX_RUNS,
}
KEYS = {
    "repositories": ["repository_id"],
    "source_files": ["repository_id", "file_id"],
    "code_chunks": ["repository_id", "chunk_id"],
    "graph_edges": ["repository_id", "source_chunk_id", "target_chunk_id", "edge_type"],
    "embeddings": ["repository_id", "chunk_id", "model_name"],
    "semantic_cache": ["repository_id", "query"],
    "graph_snapshots": ["repository_id"],
    "index_runs": ["repository_id"],
}

# Chunk kinds taken from syntax, and the other two.
SYNTAX_KINDS = ("function", "async_function", "class", "method", "arrow_function")
CHUNK_KINDS = (*SYNTAX_KINDS, "sliding", "parent")
# Edge kinds in the order in which passes insert them.
EDGE_KINDS = ("contains", "inherits", "function_call", "method_call", "references", "imports")
CALL_KINDS = ("function_call", "method_call")
