"""The tables of a collection of graphs."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

ATTRIBUTES = "map<string,struct<type:string,value:string>>"
SCHEMAS = {
    "headers": "file int, ord bigint, tag string, value string",
    "graphs": f"file int, graph_id string, ord bigint, attributes {ATTRIBUTES}",
    "nodes": "file int, graph_id string, node_id string, ord bigint, reference_id string, strand string, "
    "exons array<struct<start:bigint,end:bigint>>, reads array<struct<id:string,identity:string>>, sequence string, "
    f"attributes {ATTRIBUTES}, is_placeholder boolean",
    "edges": "file int, graph_id string, edge_id string, ord bigint, source_id string, sink_id string, "
    "sv struct<reference_name1:string,reference_name2:string,breakpoint1:bigint,breakpoint2:bigint,sv_type:string>, "
    f"attributes {ATTRIBUTES}",
    "edge_aliases": "file int, graph_id string, edge_id string, source_id string, sink_id string",
    "groups": "file int, graph_id string, group_id string, kind string, ord bigint, "
    f"elements array<struct<id:string,orientation:string>>, attributes {ATTRIBUTES}",
    "links": "file int, ord bigint, link_id string, source_graph string, source_element string, target_graph string, "
    f"target_element string, link_type string, attributes {ATTRIBUTES}",
}


@dataclass(frozen=True)
class GraphSet:
    """A collection of graphs as tables keyed by graph_id; ``ord`` columns hold the order of the text."""

    headers: DataFrame
    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame
    edge_aliases: DataFrame
    groups: DataFrame
    links: DataFrame

    def map(self, f) -> GraphSet:
        """``f(name, table)`` of every table."""
        return GraphSet(**{x.name: f(x.name, getattr(self, x.name)) for x in fields(self)})

    def with_tables(self, **tables: DataFrame) -> GraphSet:
        return replace(self, **tables)


def empty(spark: SparkSession) -> GraphSet:
    return GraphSet(**{k: spark.createDataFrame([], v) for k, v in SCHEMAS.items()})
