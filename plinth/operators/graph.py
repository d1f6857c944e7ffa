"""Graph operators over edges (src, dst, edge_type) and nodes (id, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators.ranking import keep_first, ranked
from plinth.schemas import CALL_KINDS, EDGE_KINDS
from plinth.session import checkpointed

#: A place holds the hop above so many bits and a row number, which is a 32-bit integer, below.
PLACE_BITS = 32
#: Ids of a frontier that are broadcast at most; more are joined by a shuffle of the edges.
BROADCAST_IDS = 500_000


def phase(edge_type: Column) -> Column:
    """The pass that inserts an edge kind."""
    out = F.lit(len(EDGE_KINDS))
    for i, kind in enumerate(EDGE_KINDS):
        out = F.when(edge_type == kind, i).otherwise(out)
    return out


def first_wins(edges: DataFrame, *order: Column) -> DataFrame:
    """At most one edge for each ordered pair: the one that was inserted first."""
    return keep_first(edges, ["src", "dst"], *order)


def callers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, caller) for the ids in ``nodes``."""
    calls = edges.where(F.col("edge_type").isin(*CALL_KINDS))
    return calls.join(nodes.select(F.col("id").alias("dst")), "dst").select(F.col("dst").alias("id"), F.col("src").alias("caller")).distinct()


def callees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    calls = edges.where(F.col("edge_type").isin(*CALL_KINDS))
    return calls.join(nodes.select(F.col("id").alias("src")), "src").select(F.col("src").alias("id"), F.col("dst").alias("callee")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other) for each edge from either end."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"))).distinct()


def neighbors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, neighbor) over edges of any kind and direction."""
    return both_ways(edges).join(nodes.select("id"), "id").select("id", F.col("other").alias("neighbor"))


def parent_class(edges: DataFrame, order: Column) -> DataFrame:
    """(id, parent): the first base of each class."""
    return keep_first(edges.where("edge_type = 'inherits'"), ["src"], order).select(F.col("src").alias("id"), F.col("dst").alias("parent"))


def child_methods(edges: DataFrame) -> DataFrame:
    return edges.where("edge_type = 'contains'").select(F.col("src").alias("id"), F.col("dst").alias("child"))


def missing_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges that are no node."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.join(ends, "id", "left_anti")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among ``nodes``."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def blast_radius(edges: DataFrame, focus: DataFrame, hops: int) -> DataFrame:
    """(focus, id, hop) of every node within ``hops`` undirected steps of each focus (id); hop is the least.

    One join for each hop, from the last hop's new nodes alone; the visited set is taken off by an
    anti join.  From the second hop on each round is checkpointed, so the plan stays as it is.
    """
    if hops < 0:
        raise ValueError("hops must not be negative")
    steps = both_ways(edges)
    visited = frontier = focus.select(F.col("id").alias("focus"), "id", F.lit(0).alias("hop")).distinct()
    for hop in range(1, hops + 1):
        frontier = frontier.join(steps, "id").select("focus", F.col("other").alias("id"), F.lit(hop).alias("hop")).distinct().join(visited, ["focus", "id"], "left_anti")
        if 1 < hop < hops:
            frontier = checkpointed(frontier)
            if frontier.isEmpty():
                break
        visited = visited.unionByName(frontier)
    return visited


def hop_tiers(radius: DataFrame) -> DataFrame:
    return radius.groupBy("focus", "hop").agg(F.count(F.lit(1)).alias("n_nodes"))


def fan_out(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, edge_type, side): where expansion goes from a chunk: in-edges, out-edges, then the chunks of files that its file imports.

    ``nodes``: id, node_kind ('file' or 'chunk'), file_id.
    """
    into = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", F.lit(0).alias("side"))
    out = edges.select("src", "dst", "edge_type", F.lit(1).alias("side"))
    chunks = nodes.where("node_kind = 'chunk'").select("id", "file_id")
    imports = edges.where("edge_type = 'imports'").select(F.col("src").alias("file_id"), F.col("dst").alias("target"))
    far = chunks.join(imports, "file_id").select(F.col("id").alias("src"), "target")
    far = far.join(chunks.select(F.col("id").alias("dst"), F.col("file_id").alias("target")), "target").select("src", "dst", F.lit("imports").alias("edge_type"), F.lit(2).alias("side"))
    return into.unionByName(out).unionByName(far)


def fan_out_from(edges: DataFrame, nodes: DataFrame, ids: DataFrame, *order: Column) -> DataFrame:
    """The rows of :func:`fan_out` that begin at ``ids`` (id), over ``edges`` of which the first of each pair counts; others may follow.

    Only edges at these ids, or from the files of these chunks, are reduced to the first of their pair:
    all edges of a pair have the same ends, so none of them is left out.
    """
    near = F.broadcast if ids.count() <= BROADCAST_IDS else (lambda df: df)
    ends = ids.select("id").union(nodes.join(near(ids.select("id")), "id", "left_semi").select("file_id").where("file_id IS NOT NULL").select(F.col("file_id").alias("id"))).distinct()
    out = edges.join(near(ends.withColumnRenamed("id", "src")), "src", "left_semi")
    into = edges.join(near(ends.withColumnRenamed("id", "dst")), "dst", "left_semi")
    return fan_out(first_wins(out.unionByName(into), *order).select("src", "dst", "edge_type"), nodes)


def expand(seeds: DataFrame, steps: DataFrame | Callable[[DataFrame], DataFrame], hops: int = 1, decay: float = 0.5) -> DataFrame:
    """Expand ranked seeds (query_id, id, score, rank) over ``steps`` (src, dst, edge_type, side).

    A neighbour has its parent's score times ``decay``.  Seeds are never replaced.  A node is kept
    with its best score, of equal ones the first met (parent's place in the frontier, side, id);
    only a strictly better path replaces an earlier one, and a node that was improved is expanded
    again.  Result: query_id, id, score, distance, origin, edge_type, place (the order of discovery:
    by hop, then by parent's place, side and id).  ``steps`` may be a function that gives them for
    the ids of a frontier, and then is asked before each hop.  Between hops the frontier and what is kept are
    checkpointed, so the plan of each hop has the same size.
    """
    if hops <= 0:
        raise ValueError("hops must be positive")
    if not 0 < decay < 1:
        raise ValueError("decay must lie between 0 and 1")
    kept = seeds.select("query_id", "id", F.col("score").cast("double").alias("score"), F.lit(0).alias("distance"), F.lit(None).cast(seeds.schema["id"].dataType).alias("origin"), F.lit(None).cast("string").alias("edge_type"), F.col("rank").cast("bigint").alias("place"))
    frontier, base = kept, kept.select("query_id", F.col("id").alias("_seed"))
    for hop in range(1, hops + 1):
        here = steps(frontier.select("id").distinct()) if callable(steps) else steps
        near = frontier.select("query_id", F.col("id").alias("src"), (F.col("score") * decay).alias("score"), F.col("place").alias("_from")).join(here, "src")
        near = near.join(base, (near["query_id"] == base["query_id"]) & (near["dst"] == base["_seed"]), "left_anti")
        found = keep_first(near, ["query_id", "dst"], F.round("score", 12).desc(), F.col("_from"), F.col("side"), F.col("src"))
        found = ranked(found, ["query_id"], F.col("_from"), F.col("side"), F.col("dst"), name="_n")
        found = found.select("query_id", F.col("dst").alias("id"), "score", F.lit(hop).alias("distance"), F.col("src").alias("origin"), "edge_type", (F.lit(hop << PLACE_BITS) + F.col("_n")).alias("place"))
        old = kept.where("distance > 0").select("query_id", "id", F.col("score").alias("_old"))
        frontier = found.join(old, ["query_id", "id"], "left").where(F.col("_old").isNull() | (F.col("score") > F.col("_old"))).drop("_old")
        stay = kept.join(frontier.select("query_id", "id"), ["query_id", "id"], "left_anti")
        kept = stay.unionByName(frontier)
        if hop < hops:
            frontier, kept = checkpointed(frontier), checkpointed(kept)
    return kept


def expanded_count(expanded: DataFrame) -> DataFrame:
    """(query_id, n_expanded): what expansion added to the seeds, nodes of every kind."""
    return expanded.where("distance > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expanded"))


def expansion_order(expanded: DataFrame) -> DataFrame:
    """Ranks: seeds first, then by score, then in the order of discovery."""
    return ranked(expanded, ["query_id"], F.when(F.col("distance") == 0, 0).otherwise(1), F.round("score", 12).desc(), F.col("place"), F.col("id"))


def classify(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """(focus, other, role): callers and callees among call edges at the focus; self-loops are left out."""
    calls = edges.where(F.col("edge_type").isin(*CALL_KINDS) & (F.col("src") != F.col("dst")))
    into = calls.join(focus.select(F.col("id").alias("dst")), "dst").select(F.col("dst").alias("focus"), F.col("src").alias("other"), F.lit("caller").alias("role"))
    out = calls.join(focus.select(F.col("id").alias("src")), "src").select(F.col("src").alias("focus"), F.col("dst").alias("other"), F.lit("callee").alias("role"))
    return into.unionByName(out).distinct()
