"""Collection to collection: select graphs by id, split per graph, merge files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_GRAPH
from ..schema import GraphSet

_BY_GRAPH = ("graphs", "nodes", "edges", "edge_aliases", "groups")


def id_list(text: str | None = None, lines: list[str] | None = None) -> list[str]:
    """Ids from a comma-separated list and from lines, trimmed, without empty ones."""
    out = [x.strip() for x in (text or "").split(",")] + [x.strip() for x in lines or []]
    return [x for x in out if x]


def links_for(g: GraphSet, ids: DataFrame) -> DataFrame:
    """The links that touch the graphs of ``ids`` (graph_id), once per matching id: one between two of them comes twice."""
    touched = F.explode(F.array_distinct(F.array("source_graph", "target_graph"))).alias("graph_id")
    return g.links.select("*", touched).join(ids, "graph_id").select(*g.links.columns, F.col("graph_id").alias("for_graph"))


def select_graphs(g: GraphSet, ids: list[str], check: bool = True) -> GraphSet:
    """The graphs of these ids with all headers and their links; an unknown id is an error."""
    spark = g.graphs.sparkSession
    wanted = spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "graph_id string")
    if check and (unknown := wanted.join(g.graphs, "graph_id", "left_anti").limit(5).collect()):
        raise KeyError(f"no graph {', '.join(r[0] for r in unknown)}")
    # a list that a caller passes is held by the driver already; it is broadcast by the planner if it is small
    kept = {n: getattr(g, n).join(wanted, "graph_id", "left_semi") for n in _BY_GRAPH}
    asked = spark.createDataFrame([(i,) for i in ids], "graph_id string")
    return GraphSet(headers=g.headers, links=links_for(g, asked).drop("for_graph"), **kept)


def split_links(g: GraphSet) -> DataFrame:
    """The links of each graph's own file: (for_graph, link columns)."""
    return links_for(g, g.graphs.select("graph_id").distinct())


def merge(g: GraphSet) -> GraphSet:
    """One collection from several files.

    Equal headers (tag and value) are kept once, the first. A graph id that an earlier file has, and any default graph,
    becomes ``<id>_<file number>``, numbered from 0; where that clashes again the later graph wins. Links are copied as
    they are, to the old names.
    """
    first = Window.partitionBy("tag", "value").orderBy("file", "ord")
    headers = g.headers.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    order = Window.partitionBy("graph_id").orderBy("file")
    clash = (F.row_number().over(order) > 1) | (F.col("graph_id") == DEFAULT_GRAPH)
    named = g.graphs.select("file", "graph_id").distinct().withColumn("new_id", F.when(clash, F.concat_ws("_", "graph_id", F.col("file").cast("string"))).otherwise(F.col("graph_id")))
    named = named.withColumn("n", F.row_number().over(Window.partitionBy("new_id").orderBy(F.desc("file"), F.desc("graph_id")))).where("n = 1").drop("n")

    def rename(name: str) -> DataFrame:
        t = getattr(g, name)
        return t.join(named, ["file", "graph_id"]).withColumn("graph_id", F.col("new_id")).select(*t.columns)

    return GraphSet(headers=headers, links=g.links, **{n: rename(n) for n in _BY_GRAPH})
