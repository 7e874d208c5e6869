"""Graphs derived from an events table: a graph per day and user class, a read per user.

A node is an event type in a six-hour bucket; a user visits the node of the first event in each bucket, and an edge joins
the consecutive visits of a user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SCHEMAS, GraphSet
from ..storage import materialise

CLASSES = 50
_ATTRIBUTE = "struct<type:string,value:string>"


def visits(events: DataFrame, bucketed: bool = True) -> DataFrame:
    """A row per user, day and bucket; ``bucketed`` false names nodes by the event type alone, which makes cycles."""
    day, bucket = F.col("ts").cast("date"), F.floor(F.hour("ts") / 6).cast("int")
    ev = events.select(day.alias("d"), "user_id", (F.col("user_id") % CLASSES).alias("k"), "event_type", "event_id", "ts", bucket.alias("b"))
    ev = ev.withColumn("rn", F.row_number().over(Window.partitionBy("d", "user_id", "b").orderBy("ts", "event_id"))).where("rn = 1")
    user = Window.partitionBy("d", "user_id")
    name = F.concat_ws("_", "event_type", F.col("b").cast("string")) if bucketed else F.col("event_type")
    return ev.select(
        F.concat(F.lit("G"), F.regexp_replace(F.col("d").cast("string"), "-", ""), F.lit("_"), F.col("k").cast("string")).alias("graph_id"),
        name.alias("node_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("read_id"), "d", "k", "user_id", "event_type", "event_id", "b",
        F.row_number().over(user.orderBy("b")).alias("pos"), F.count(F.lit(1)).over(user).alias("n"))


def derive(events: DataFrame, bucketed: bool = True, stored: bool = False) -> GraphSet:
    """The graphs; with ``stored``, visits, nodes and edges are tables, for callers that read them several times."""
    spark = events.sparkSession
    keep = materialise if stored else lambda t, _: t
    v = keep(visits(events, bucketed), "visits")
    zero = F.lit(0).alias("file")
    identity = F.when(F.col("pos") == 1, "SO").when(F.col("pos") == F.col("n"), "SI").otherwise("IN")
    start = F.col("event_id") * 10
    exon = F.struct(start.alias("start"), (start + 1 + F.col("event_id") % 9).alias("end"))
    grouped = v.groupBy("graph_id", "node_id").agg(
        F.min("event_type").alias("reference_id"), F.min("b").alias("b"), F.array_sort(F.collect_list(exon)).alias("exons"),
        F.array_sort(F.collect_list(F.struct(F.col("read_id").alias("id"), identity.alias("identity")))).alias("reads"), F.count(F.lit(1)).alias("n_reads"))
    value = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("value"))
    nodes = keep(grouped.select(
        zero, "graph_id", "node_id", F.row_number().over(Window.partitionBy("graph_id").orderBy("b", "reference_id")).cast("bigint").alias("ord"), "reference_id",
        F.when(F.col("b") % 2 == 0, "+").otherwise("-").alias("strand"), "exons", "reads", F.repeat(F.lit("ACGT"), F.col("b") + 1).alias("sequence"),
        F.create_map(F.lit("ptc"), value("i", F.col("n_reads").cast("string")), F.lit("ptf"), value("f", (F.col("n_reads") / 10.0).cast("double").cast("string"))).alias("attributes"),
        F.lit(False).alias("is_placeholder")), "nodes")
    nxt = v.select("graph_id", "d", "user_id", F.col("node_id").alias("sink_id"), (F.col("pos") - 1).alias("pos"))
    pairs = v.select("graph_id", "d", "user_id", F.col("node_id").alias("source_id"), "pos").join(nxt, ["graph_id", "d", "user_id", "pos"]).groupBy("graph_id", "source_id", "sink_id").agg(F.count(F.lit(1)).alias("sr"))
    side = lambda k: nodes.select("graph_id", F.col("node_id").alias(f"{k}_id"), F.col("ord").alias(f"{k}_ord"), F.col("reference_id").alias(f"{k}_ref"),
                                  F.get("exons", F.lit(0))["start"].alias(f"{k}_start"), F.element_at("exons", -1)["end"].alias(f"{k}_end"))
    both = pairs.join(side("source"), ["graph_id", "source_id"]).join(side("sink"), ["graph_id", "sink_id"])
    edges = keep(both.select(
        zero, "graph_id", F.concat(F.lit("E_"), "source_id", F.lit("__"), "sink_id").alias("edge_id"),
        F.row_number().over(Window.partitionBy("graph_id").orderBy("source_ord", "sink_ord")).cast("bigint").alias("ord"), "source_id", "sink_id",
        F.struct(F.col("source_ref").alias("reference_name1"), F.col("sink_ref").alias("reference_name2"), F.col("source_end").alias("breakpoint1"), F.col("sink_start").alias("breakpoint2"),
                 F.when(F.col("source_ref") == F.col("sink_ref"), "splice").otherwise("TRA").alias("sv_type")).alias("sv"),
        F.create_map(F.lit("sr"), value("i", F.col("sr").cast("string"))).alias("attributes")), "edges")
    number = F.regexp_replace(F.col("d").cast("string"), "-", "").cast("bigint") * 1000 + F.col("k")
    graphs = v.select("graph_id", "d", "k").distinct().select(zero, "graph_id", number.alias("ord"), F.expr(f"CAST(map() AS map<string,{_ATTRIBUTE}>)").alias("attributes"))
    ends = v.where("pos = n").select("user_id", F.date_add("d", 1).alias("d"), F.col("graph_id").alias("source_graph"), F.col("node_id").alias("source_element"))
    begins = v.where("pos = 1").select("user_id", "d", F.col("graph_id").alias("target_graph"), F.col("node_id").alias("target_element"))
    touch = ends.join(begins, ["user_id", "d"]).select("source_graph", "source_element", "target_graph", "target_element").distinct()
    link_id = F.concat(F.lit("L_"), "source_graph", F.lit("_"), "source_element", F.lit("__"), "target_graph", F.lit("_"), "target_element")
    links = touch.select(zero, F.xxhash64("source_graph", "source_element", "target_graph", "target_element").alias("ord"), link_id.alias("link_id"), "source_graph", "source_element",
                         "target_graph", "target_element", F.lit("followup").alias("link_type"), F.expr(f"CAST(map() AS map<string,{_ATTRIBUTE}>)").alias("attributes"))
    headers = spark.createDataFrame([(0, 1, "TSG", "1.0"), (0, 2, "reference", "events")], SCHEMAS["headers"])
    groups = v.where("n > 1").groupBy("graph_id", "d", "user_id", "read_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("p")).select(
        zero, "graph_id", F.concat(F.lit("P_"), "read_id").alias("group_id"), F.lit("P").alias("kind"), F.col("user_id").alias("ord"),
        F.transform("p", lambda x: F.struct(x["node_id"].alias("id"), F.lit("+").alias("orientation"))).alias("elements"), F.expr(f"CAST(map() AS map<string,{_ATTRIBUTE}>)").alias("attributes"))
    return GraphSet(headers, graphs, nodes, edges, edges.select("file", "graph_id", "edge_id", "source_id", "sink_id"), groups, links)
