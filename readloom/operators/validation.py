"""References between elements: what a path, a link or an attribute names must exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import GraphSet


def elements(g: GraphSet) -> DataFrame:
    """(file, graph_id, id) of every node, edge id and group."""
    return (
        g.nodes.select("file", "graph_id", F.col("node_id").alias("id"))
        .unionByName(g.edge_aliases.select("file", "graph_id", F.col("edge_id").alias("id")))
        .unionByName(g.groups.select("file", "graph_id", F.col("group_id").alias("id"))).distinct()
    )


def missing_path_elements(g: GraphSet) -> DataFrame:
    """(file, graph_id, group_id, id) that a path names and its graph lacks. Sets and chains are not checked."""
    named = g.groups.where("kind = 'P'").select("file", "graph_id", "group_id", F.explode("elements.id").alias("id"))
    return named.join(elements(g), ["file", "graph_id", "id"], "left_anti").select("file", "graph_id", "group_id", "id")


def missing_link_elements(g: GraphSet) -> DataFrame:
    """(file, graph_id, link_id, id) that a link names and the named graph lacks."""
    sides = [g.links.select("file", F.col(f"{s}_graph").alias("graph_id"), "link_id", F.col(f"{s}_element").alias("id")) for s in ("source", "target")]
    return sides[0].unionByName(sides[1]).join(elements(g), ["file", "graph_id", "id"], "left_anti").select("file", "graph_id", "link_id", "id")


def reference_errors(g: GraphSet, check_links: bool = True) -> DataFrame:
    """(graph_id, message) of every missing reference."""
    out = missing_path_elements(g).select("graph_id", F.concat(F.lit("path "), "group_id", F.lit(" names the missing element "), "id").alias("message"))
    if check_links:
        out = out.unionByName(missing_link_elements(g).select("graph_id", F.concat(F.lit("link "), "link_id", F.lit(" names the missing element "), "id").alias("message")))
    return out


def invalid_paths(paths: DataFrame) -> DataFrame:
    """Traversed paths that don't have one node more than edges."""
    return paths.where(F.size("nodes") != F.size("edges") + 1)
