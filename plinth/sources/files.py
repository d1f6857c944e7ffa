"""Source files and JSON data sets as DataFrames."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.ids import file_id

# Folders that are never entered.
IGNORED = (".git", "node_modules", "dist", "build", "target", "coverage", "__pycache__", ".venv", "venv", "env", ".idea", ".vscode")
# The language of each extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".cs": "c_sharp", ".rb": "ruby", ".php": "php",
}
#: Bytes from the start of a file in which a NUL means that it is binary.
SNIFFED = 8192

def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.get(F.array(table[extension(path)]), F.lit(0))


def is_ignored(path: Column) -> Column:
    return F.arrays_overlap(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED)))


def discover(spark: SparkSession, root: str, max_bytes: int = 2 * 1024 * 1024) -> DataFrame:
    """(relative_path, file_id, language, extension, size_bytes, text) of the supported source files under ``root``.

    Folders that are ignored, files that are too large, unknown or binary are left out; unreadable files are skipped.
    """
    base = root.rstrip("/")
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").option("pathGlobFilter", "*{" + ",".join(LANGUAGES) + "}").load(base)
    clean = base.split("://", 1)[-1].removeprefix("file:")
    relative = F.regexp_replace(F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/"), "^/*" + __import__("re").escape(clean.lstrip("/")) + "/", "")
    files = scan.where(F.col("length") <= max_bytes).withColumn("relative_path", relative)
    known = files.withColumn("language", language(F.col("relative_path"))).where(F.col("language").isNotNull() & ~is_ignored(F.col("relative_path")))
    text = known.where(F.position(F.lit(b"\x00"), F.substring("content", 1, SNIFFED)) == 0)
    return text.select("relative_path", file_id(F.col("relative_path")).alias("file_id"), "language", extension(F.col("relative_path")).alias("extension"), F.col("length").alias("size_bytes"), F.col("content").cast("string").alias("text"))


def parse_repository_url(url: Column) -> Column:
    """struct(owner, name, clone_url) of a valid repository address, else null.

    An address is https, has the host github.com and two segments, and nothing else but a slash at the
    end.  An owner is made of ASCII letters, digits and inner hyphens; a name of those, dots and
    underscores, without its suffix .git.
    """
    u = F.trim(url)
    parts = F.split(F.regexp_replace(u, "/$", ""), "/")
    owner, whole = F.get(parts, F.lit(3)), F.get(parts, F.lit(4))
    name = F.when(whole.endswith(".git") & (F.length(whole) > 4), whole.substr(F.lit(1), F.length(whole) - 4)).otherwise(whole)
    plain = lambda x, more: (F.length(x) > 0) & (F.length(F.translate(x, string.ascii_letters + string.digits + more, "")) == 0)
    fits = (F.size(parts) == 5) & (F.get(parts, F.lit(0)) == "https:") & (F.get(parts, F.lit(1)) == "") & (F.get(parts, F.lit(2)) == "github.com")
    fits = fits & plain(owner, "-") & ~owner.startswith("-") & ~owner.endswith("-") & plain(name, "._-") & ~name.isin(".", "..")
    made = F.struct(owner.alias("owner"), name.alias("name"), F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name, F.lit(".git")).alias("clone_url"))
    return F.when(F.coalesce(fits, F.lit(False)), made)


def json_rows(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """The rows of a JSON array; a malformed file or a missing required field is an error."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    for name in required:
        rows = rows.withColumn(name, F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit(f"missing field {name}"))))
    return rows


EVAL_SCHEMA = "repository_id string, query string, expected_answer string, expected_source_files array<string>, expected_functions array<string>"


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, EVAL_SCHEMA, [x.split()[0] for x in EVAL_SCHEMA.split(", ")])


CASE_SCHEMA = (
    "case_id string, ground_truth_buggy boolean, ground_truth_rationale string, sandbox_language string, diff string, diff_file string,"
    " target_file_relative_path string, target_file_content string, is_real_repo_case boolean, repo string,"
    " repo_copy_source string, repo_copy_dest_relative string, sandbox_stubs map<string,string>,"
    " context_bundle struct<changed_functions:array<struct<file_path:string,function_name:string,class_name:string,start_line:int,end_line:int>>,"
    "callers:array<struct<node_kind:string,file_path:string,function_name:string,class_name:string>>,callees:array<struct<node_kind:string,file_path:string,function_name:string,class_name:string>>,"
    "related_tests:array<struct<file_path:string,function_name:string,found_via:string>>>"
)


def review_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Cases of a folder, by file name; a diff that stands in a side file is read from there."""
    rows = spark.read.schema(CASE_SCHEMA).option("multiLine", "true").json(f"{folder.rstrip('/')}/*.json").withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    sides = spark.read.format("binaryFile").option("pathGlobFilter", "*.diff").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("diff_file"), F.col("content").cast("string").alias("_diff"))
    return rows.join(sides, "diff_file", "left").withColumn("diff", F.coalesce("diff", "_diff")).drop("_diff").orderBy("file_name")


def graph_from_json(raw: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of node-link documents; a malformed document is an error."""
    schema = "struct<nodes:array<struct<id:string,node_kind:string,file_id:string,file_path:string,language:string,chunk_type:string,function_name:string,class_name:string,start_line:int,end_line:int>>,links:array<struct<source:string,target:string,edge_type:string>>>"
    doc = raw.select(F.from_json(column, schema).alias("g")).withColumn("g", F.when(F.col("g.nodes").isNotNull() & F.col("g.links").isNotNull(), F.col("g")).otherwise(F.raise_error(F.lit("malformed graph"))))
    return doc.select(F.inline("g.nodes")), doc.select(F.inline("g.links")).withColumnsRenamed({"source": "src", "target": "dst"})


def graph_to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One node-link document of a repository's graph."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "edge_type"))).alias("links"))
    return n.crossJoin(e).select(F.to_json(F.struct(F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), "nodes", "links")).alias("graph_data"))  # one row each
