"""Name resolution: containment, inheritance, calls, bare names, imports.

Symbols are chunks (id, file_id, kind, name, class_name, ordinal); the ordinal is the order of parsing,
and "first" always means the least one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators.ranking import keep_first

FUNCTION_KINDS = ("function", "async_function", "arrow_function")
# What may follow a relative specifier, in the order of trial.
SCRIPT_SUFFIXES = ("", ".js", ".jsx", ".mjs", "/index.js")


def _named(symbols: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return symbols.where(F.col("kind").isin(*kinds))


def containment(symbols: DataFrame) -> DataFrame:
    """(src, dst): each method's class in the same file; of classes with one name the first."""
    classes = keep_first(_named(symbols, ("class",)), ["file_id", "name"], F.col("ordinal")).select("file_id", F.col("name").alias("class_name"), F.col("id").alias("src"))
    return _named(symbols, ("method",)).select("file_id", "class_name", F.col("id").alias("dst")).join(classes, ["file_id", "class_name"]).select("src", "dst")


def _first(symbols: DataFrame, keys: dict[str, str], out: str) -> DataFrame:
    """The symbol with the least ordinal for each key (names in ``symbols`` to names in the result), as struct ``out`` (ordinal, id)."""
    rows = symbols.select(*(F.col(k).alias(v) for k, v in keys.items()), F.struct("ordinal", "id").alias(out))
    return rows.groupBy(*keys.values()).agg(F.min(out).alias(out))


def inheritance(bases: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst) from (src, file_id, base names separated by commas): a class of the same file, else the first anywhere.

    Symbols are reduced to the first of each name (and file) before the joins, so a frequent name is one row.
    """
    wanted = bases.select("src", "file_id", F.posexplode(F.split("bases", ",")).alias("pos", "base")).select("src", "file_id", "pos", F.trim("base").alias("base")).where("base <> ''")
    classes = _named(symbols, ("class",))
    here = _first(classes, {"name": "base", "file_id": "file_id"}, "_here")
    there = _first(classes, {"name": "base"}, "_there")
    found = wanted.join(there, "base").join(here, ["base", "file_id"], "left")
    return found.select("src", F.coalesce("_here", "_there")["id"].alias("dst"), F.col("pos").alias("ordinal"))


def calls(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Resolve call sites (site_id, src, file_id, caller_class, callee, is_self, qualifier).

    In this order: a method of the caller's own class for self calls; a method of the class that
    qualifies the call; a function of that name, or if there is none a method, in the same file
    before any other.  Result: site_id, src, dst, edge_type; unresolved sites are left out.  Symbols
    are reduced to the first of each name (and class, or file) before the joins, so a site is never
    joined with all symbols of a frequent name.
    """
    methods, functions = _named(symbols, ("method",)), _named(symbols, FUNCTION_KINDS)
    own = _first(methods, {"name": "callee", "class_name": "caller_class"}, "_own")
    of_qualifier = _first(methods, {"name": "callee", "class_name": "qualifier"}, "_qualified")
    out = sites.join(own, ["callee", "caller_class"], "left").join(of_qualifier, ["callee", "qualifier"], "left")
    out = out.withColumn("_own", F.when(F.col("is_self"), F.col("_own")))
    for name, pool in (("_function", functions), ("_method", methods)):
        out = out.join(_first(pool, {"name": "callee", "file_id": "file_id"}, f"{name}_here"), ["callee", "file_id"], "left").join(_first(pool, {"name": "callee"}, f"{name}_there"), ["callee"], "left")
    method = F.coalesce("_own", "_qualified")
    function = F.coalesce("_function_here", "_function_there")
    other = F.coalesce("_method_here", "_method_there")
    is_function = method.isNull() & function.isNotNull()
    best = out.withColumn("_best", F.coalesce(method, function, other)).where(F.col("_best").isNotNull())
    return best.select("site_id", "src", F.col("_best")["id"].alias("dst"), F.when(is_function, "function_call").otherwise("method_call").alias("edge_type"))


def bare_names(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Resolve (site_id, src, file_id, callee) of module scope: functions, else methods; the same file first."""
    full = sites.withColumns({"caller_class": F.lit(None).cast("string"), "is_self": F.lit(False), "qualifier": F.lit(None).cast("string")})
    return calls(full, symbols)


def unresolved(sites: DataFrame, edges: DataFrame, by: str = "file_id") -> DataFrame:
    """(``by``, n_sites, n_unresolved): sites (site_id, ...) without an edge."""
    found = sites.select("site_id", by).join(edges.select("site_id", F.lit(True).alias("_met")).distinct(), "site_id", "left")
    return found.groupBy(by).agg(F.count(F.lit(1)).alias("n_sites"), F.count_if(F.col("_met").isNull()).alias("n_unresolved"))


def import_candidates(module: Column, level: Column, directory: Column, language: Column) -> Column:
    """The paths that an import may mean, in the order of trial."""
    dotted = F.replace(module, F.lit("."), F.lit("/"))
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    up = F.greatest(F.size(parts) - F.greatest(level - 1, F.lit(0)), F.lit(0))
    base = F.array_join(F.slice(parts, F.lit(1), up), "/")
    relative = F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(dotted, F.lit("")))
    stem = F.when(level > 0, relative).otherwise(dotted)
    python = F.when((level > 0) & (module == ""), F.array(F.concat_ws("/", F.nullif(base, F.lit("")), F.lit("__init__")))).otherwise(F.array(stem, F.concat(stem, F.lit("/__init__"))))
    whole = F.when(module.startswith("/"), module).otherwise(F.concat_ws("/", F.nullif(directory, F.lit("")), module))
    # a/./b/../c -> a/c, one segment after the other
    clean = F.aggregate(
        F.split(whole, "/"),
        F.array().cast("array<string>"),
        lambda path, x: F.when((x == "") | (x == "."), path).when(x == "..", F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(F.concat(path, F.array(x))),
    )
    target = F.array_join(clean, "/")
    script = F.when(module.rlike(r"^[./]"), F.array(*(F.concat(target, F.lit(s)) for s in SCRIPT_SUFFIXES))).otherwise(F.array().cast("array<string>"))
    return F.when(language == "python", python).otherwise(script)


def path_index(files: DataFrame) -> DataFrame:
    """(path, file_id, language): every path, and for Python files the path without extension; the first file wins."""
    whole = files.select(F.col("relative_path").alias("path"), "file_id", "language", F.lit(0).alias("_kind"))
    bare = files.where("language = 'python'").select(F.regexp_replace("relative_path", r"\.[^./]+$", "").alias("path"), "file_id", "language", F.lit(1).alias("_kind"))
    return keep_first(whole.unionByName(bare), ["path"], F.col("_kind"), F.col("file_id")).drop("_kind")


def imports(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) of files from (file_id, directory, language, module, level): the first candidate that is a file; self-imports are dropped."""
    tried = refs.select("file_id", "module", "level", F.posexplode(import_candidates(F.col("module"), F.col("level"), F.col("directory"), F.col("language"))).alias("pos", "path"))
    found = tried.join(path_index(files).select("path", F.col("file_id").alias("dst")), "path")
    return keep_first(found, ["file_id", "module", "level"], F.col("pos")).where("file_id <> dst").select(F.col("file_id").alias("src"), "dst").distinct()
