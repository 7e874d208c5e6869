"""From records to tables: typed fields, last-wins upserts, chains, and the checks that make a text invalid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_GRAPH
from ..functions import text as T
from ..schema import ATTRIBUTES, GraphSet
from ..storage import materialise
from .text import parse_records, read_records

_NO_ATTRIBUTES = f"CAST(map() AS {ATTRIBUTES})"
_KEY = ["file", "graph_id"]
#: Errors that are broadcast to the records at most.
MAX_BROADCAST = 100_000


class InvalidGraphs(ValueError):
    """A text that breaks the format's rules; carries the first errors."""


def _tok(i: int):
    return F.get("tokens", F.lit(i))


def _rest(i: int):
    """The tokens from the i-th on (from 0)."""
    return F.slice("tokens", F.lit(i + 1), F.greatest(F.size("tokens") - i, F.lit(0)))


def _error(rows: DataFrame, bad, message: str) -> DataFrame:
    return rows.where(bad).select("file", "line_no", F.lit(message).alias("message"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def tables(records: DataFrame, chains: bool = True) -> tuple[GraphSet, DataFrame]:
    """The tables of all records that are valid, and the errors (file, line_no, message) of the others.

    ``chains`` false says that no record is a chain.

    Rules that depend on order (an attribute needs its element before it, a later node replaces an earlier one and its
    attributes) go by line number. Positions (``ord``) follow first mentions: twice the line number, one more for the
    sink of an edge line.
    """
    errors: list[DataFrame] = []
    of = lambda k: records.where(F.col("kind") == k)
    size = F.size("tokens")

    # headers
    h = of("H")
    errors.append(_error(h, size < 3, "a header needs a tag and a value"))
    headers = h.where(size >= 3).select("file", F.col("line_no").alias("ord"), _tok(1).alias("tag"), _tok(2).alias("value"))

    # graphs; the default graph always exists, and declaring it is no duplicate
    g = of("G").withColumn("items", F.transform(_rest(2), T.attribute))
    errors.append(_error(g, size < 2, "a graph needs an id"))
    bad_items = F.exists("items", lambda a: a.isNull())
    errors.append(_error(g.where(size >= 2), bad_items, "a malformed attribute"))
    first = Window.partitionBy("file", _tok(1)).orderBy("line_no")
    g = g.where((size >= 2) & ~bad_items).withColumn("n", F.row_number().over(first))
    errors.append(_error(g, F.col("n") > 1, "the graph id was declared before"))
    g = g.where("n = 1").select("file", "graph_id", "line_no", "items")

    # nodes
    n = of("N").withColumn("loc", F.split(_tok(2), ":")).withColumn("exons", T.exons(F.get("loc", F.lit(2)))).withColumn(
        "reads", T.reads(_tok(3))).withColumn("strand", T.strand(F.get("loc", F.lit(1))))
    good = (size >= 4) & (F.size("loc") >= 3) & F.col("exons").isNotNull() & F.col("reads").isNotNull() & F.col("strand").isNotNull()
    good = F.coalesce(good, F.lit(False))
    errors.append(_error(n, ~good, "a node needs an id, chrom:strand:exons and reads"))
    n = n.where(good).select(
        *_KEY, "line_no", _tok(1).alias("node_id"), F.get("loc", F.lit(0)).alias("reference_id"), "strand", "exons", "reads", _tok(4).alias("sequence"))

    # edges
    e = of("E").withColumn("sv", T.structural_variant(_tok(4)))
    good = F.coalesce((size >= 5) & F.col("sv").isNotNull(), F.lit(False))
    errors.append(_error(e, ~good, "an edge needs an id, two nodes and five variant fields"))
    e = e.where(good).select(*_KEY, "line_no", _tok(1).alias("edge_id"), _tok(2).alias("source_id"), _tok(3).alias("sink_id"), "sv")

    # groups
    u = of("U").unionByName(of("P")).unionByName(of("C"))
    errors.append(_error(u, size < 3, "a group needs an id and elements"))
    odd = (F.col("kind") != "C") | (size % 2 == 1)
    errors.append(_error(u.where(size >= 3), ~odd, "a chain alternates nodes and edges and ends with a node"))
    u = u.where((size >= 3) & odd).withColumn("n", F.row_number().over(Window.partitionBy(*_KEY, _tok(1)).orderBy("line_no")))
    errors.append(_error(u, F.col("n") > 1, "the group id was used before"))
    plain = lambda x: F.struct(x.alias("id"), F.lit(None).cast("string").alias("orientation"))
    u = u.where("n = 1").select(*_KEY, "line_no", "kind", _tok(1).alias("group_id"), F.when(
        F.col("kind") == "P", F.transform(_rest(2), T.oriented)).otherwise(F.transform(_rest(2), plain)).alias("elements"))

    # chains make structure in graphs without nodes or without edges
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("source_id").alias("node_id")), F.struct(F.lit(1).alias("side"), F.col("sink_id").alias("node_id"))))
    mentioned = n.select(*_KEY, "node_id", (F.col("line_no") * 2).alias("ord")).unionByName(
        e.select(*_KEY, "line_no", ends.alias("x")).select(*_KEY, F.col("x.node_id").alias("node_id"), (F.col("line_no") * 2 + F.col("x.side")).alias("ord")))
    has_both = mentioned.select(*_KEY).distinct().join(e.select(*_KEY).distinct(), _KEY, "left_semi")
    chain = u.where("kind = 'C'").join(has_both, _KEY, "left_anti").select(*_KEY, "line_no", F.posexplode(F.transform("elements", lambda x: x["id"])).alias("pos", "id"), "elements")
    after = F.lit(2**40)  # chains come after every line
    chain_nodes = chain.where("pos % 2 = 0").select(*_KEY, F.col("id").alias("node_id"), (after + F.col("line_no") * 2**20 + F.col("pos")).alias("ord"))
    chain_edges = chain.where("pos % 2 = 1").select(*_KEY, (after + F.col("line_no") * 2**20 + F.col("pos")).alias("line_no"), F.col("id").alias("edge_id"),
        F.get("elements", F.col("pos") - 1)["id"].alias("source_id"), F.get("elements", F.col("pos") + 1)["id"].alias("sink_id"),
        F.expr("named_struct('reference_name1', '', 'reference_name2', '', 'breakpoint1', 0L, 'breakpoint2', 0L, 'sv_type', '')").alias("sv"))
    chain_edges = chain_edges.withColumn("n", F.row_number().over(Window.partitionBy(*_KEY, "edge_id").orderBy("line_no"))).where("n = 1").drop("n")
    chain_edges = chain_edges.join(e.select(*_KEY, "edge_id").distinct(), [*_KEY, "edge_id"], "left_anti")
    every_edge = e.unionByName(chain_edges) if chains else e

    # attributes of elements
    known = _tok(1).isin("N", "E", "U", "P", "C", "G")
    malformed = F.exists(_rest(3), lambda x: ~T.is_attribute(x))
    errors.append(_error(of("A"), (size < 4) | malformed | ~known, "a malformed attribute line"))
    a = of("A").where((size >= 4) & known & ~malformed).select(
        *_KEY, "line_no", "kind", _tok(1).alias("on"), _tok(2).alias("id"), F.transform(_rest(3), T.attribute).alias("items"))
    missing = "the attribute's element is not defined before it"

    first_seen = mentioned.groupBy(*_KEY, "node_id").agg(F.min("ord").alias("ord"))
    last_node = n.groupBy(*_KEY, "node_id").agg(F.max_by(F.struct("reference_id", "strand", "exons", "reads", "sequence"), "line_no").alias("d"), F.max("line_no").alias("set_at"))
    node = first_seen
    if chains:
        node = node.unionByName(chain_nodes.groupBy(*_KEY, "node_id").agg(F.min("ord").alias("ord")).join(first_seen, [*_KEY, "node_id"], "left_anti"))
    node = node.join(last_node, [*_KEY, "node_id"], "left")
    on_node = a.where("`on` = 'N'").withColumnRenamed("id", "node_id").join(first_seen.withColumnRenamed("ord", "seen"), [*_KEY, "node_id"], "left")
    errors.append(_error(on_node, F.col("seen").isNull() | (F.col("seen") > F.col("line_no") * 2), missing))
    node_items = on_node.where(F.col("seen") <= F.col("line_no") * 2).join(last_node.select(*_KEY, "node_id", "set_at"), [*_KEY, "node_id"], "left").where(
        F.coalesce(F.col("line_no") > F.col("set_at"), F.lit(True)))
    nodes = node.join(_maps(node_items, [*_KEY, "node_id"]), [*_KEY, "node_id"], "left").select(
        *_KEY, "node_id", "ord", F.coalesce("d.reference_id", F.lit("")).alias("reference_id"), F.coalesce("d.strand", F.lit("+")).alias("strand"),
        F.coalesce("d.exons", F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")).alias("exons"),
        F.coalesce("d.reads", F.expr("CAST(array() AS array<struct<id:string,identity:string>>)")).alias("reads"), "d.sequence",
        F.coalesce("attributes", F.expr(_NO_ATTRIBUTES)).alias("attributes"), F.col("d").isNull().alias("is_placeholder"))

    # an edge is its pair of nodes: the first line gives its position, the last its id and data
    pair = [*_KEY, "source_id", "sink_id"]
    edge = every_edge.groupBy(*pair).agg(
        F.min("line_no").alias("first_at"), F.max("line_no").alias("set_at"), F.max_by(F.struct("edge_id", "sv"), "line_no").alias("d"))
    events = e.select(*_KEY, F.col("edge_id").alias("id"), "line_no", F.struct("source_id", "sink_id").alias("pair"), F.lit(None).cast("array<struct<tag:string,type:string,value:string>>").alias("items"), F.lit("E").alias("kind"))
    asked = a.where("`on` = 'E'").select(*_KEY, "id", "line_no", F.lit(None).cast("struct<source_id:string,sink_id:string>").alias("pair"), "items", "kind")
    order = Window.partitionBy(*_KEY, "id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    resolved = events.unionByName(asked).withColumn("target", F.last("pair", True).over(order)).where("pair IS NULL")
    errors.append(_error(resolved, F.col("target").isNull(), missing))
    edge_items = resolved.where("target IS NOT NULL").select(*_KEY, "target.*", "line_no", "items").join(edge.select(*pair, "set_at"), pair).where(F.col("line_no") > F.col("set_at"))
    edges = edge.join(_maps(edge_items, pair), pair, "left").select(
        *_KEY, F.col("d.edge_id").alias("edge_id"), F.col("first_at").alias("ord"), "source_id", "sink_id", "d.sv",
        F.coalesce("attributes", F.expr(_NO_ATTRIBUTES)).alias("attributes"))
    aliases = every_edge.groupBy(*_KEY, "edge_id").agg(F.max_by(F.struct("source_id", "sink_id"), "line_no").alias("d")).select(*_KEY, "edge_id", "d.*")

    on_group = a.where(F.col("on").isin("U", "P", "C")).withColumnRenamed("id", "group_id").join(
        u.select(*_KEY, "group_id", F.col("line_no").alias("seen")), [*_KEY, "group_id"], "left")
    late = F.coalesce(F.col("seen") > F.col("line_no"), F.lit(True))
    errors.append(_error(on_group, late, missing))
    groups = u.join(_maps(on_group.where(~late), [*_KEY, "group_id"]), [*_KEY, "group_id"], "left").select(
        *_KEY, "group_id", "kind", F.col("line_no").alias("ord"), "elements", F.coalesce("attributes", F.expr(_NO_ATTRIBUTES)).alias("attributes"))

    # graphs: declared ones, and the default one where it has nodes
    default = nodes.where(F.col("graph_id") == DEFAULT_GRAPH).select("file").distinct().select("file", F.lit(DEFAULT_GRAPH).alias("graph_id"), F.lit(0).cast("bigint").alias("line_no"))
    ids = g.select(*_KEY, "line_no").where(F.col("graph_id") != DEFAULT_GRAPH).unionByName(default)
    on_graph = a.where("`on` = 'G'").select("file", F.col("id").alias("graph_id"), "line_no", "kind", "items").join(
        g.select(*_KEY, F.col("line_no").alias("seen")), _KEY, "left")
    late = F.coalesce(F.col("seen") > F.col("line_no"), F.col("graph_id") != DEFAULT_GRAPH)
    errors.append(_error(on_graph, late, missing))
    graph_items = g.select(*_KEY, "line_no", "items").unionByName(on_graph.where(~late).select(*_KEY, "line_no", "items"))
    graphs = ids.join(_maps(graph_items, _KEY), _KEY, "left").select(
        *_KEY, F.col("line_no").alias("ord"), F.coalesce("attributes", F.expr(_NO_ATTRIBUTES)).alias("attributes"))

    # links
    ref = lambda i, k: F.get(F.split(_tok(i), ":", 2), F.lit(k))
    k = of("L").withColumn("items", F.transform(_rest(5), T.attribute))
    good = F.coalesce((size >= 5) & ref(2, 1).isNotNull() & ref(3, 1).isNotNull() & ~F.exists("items", lambda x: x.isNull()), F.lit(False))
    errors.append(_error(k, ~good, "a link needs an id, two graph:element references and a type"))
    k = k.where(good).select("file", "line_no", "kind", _tok(1).alias("link_id"), ref(2, 0).alias("source_graph"), ref(2, 1).alias("source_element"),
                             ref(3, 0).alias("target_graph"), ref(3, 1).alias("target_element"), _tok(4).alias("link_type"), "items")
    declared = g.select("file", F.col("graph_id").alias("gid"), F.col("line_no").alias("seen"))
    for side in ("source_graph", "target_graph"):
        found = k.select("file", "line_no", "kind", F.col(side).alias("gid")).where(F.col("gid") != DEFAULT_GRAPH).join(declared, ["file", "gid"], "left")
        errors.append(_error(found, F.coalesce(F.col("seen") > F.col("line_no"), F.lit(True)), f"the link's {side.replace('_', ' ')} is not declared before it"))
    links = k.select("file", F.col("line_no").alias("ord"), "link_id", "source_graph", "source_element", "target_graph", "target_element", "link_type",
                     F.when(F.size("items") > 0, T.attribute_map(F.col("items"))).otherwise(F.expr(_NO_ATTRIBUTES)).alias("attributes"))
    return GraphSet(headers, graphs, nodes, edges, aliases, groups, links), _union(errors)


def _maps(rows: DataFrame, key: list[str]) -> DataFrame:
    """The attribute map of each key; of equal tags the last line's wins, and within a line the last."""
    # dealt by the key, the rows need no further exchange for the tags, the maps and the join that follows
    flat = rows.select(*key, "line_no", "items").repartition(*key).select(*key, "line_no", F.posexplode("items").alias("pos", "a")).groupBy(*key, "a.tag").agg(
        F.max_by(F.struct("a.type", "a.value"), F.struct("line_no", "pos")).alias("v"))
    return flat.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "v")))).alias("attributes"))


def _made(records: DataFrame, links: str) -> tuple[GraphSet, DataFrame]:
    """The tables, as plans over the stored records, and the stored errors with their records."""
    records = materialise(records, "records", by=("kind",))
    made, errors = tables(records, chains=bool(records.where("kind = 'C'").take(1)))
    if links == "permissive":
        errors = errors.where(~F.col("message").startswith("the link's"))
    errors = materialise(errors, "errors")
    few = errors.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    text = records.select("file", "line_no", "kind", F.array_join("tokens", " ").alias("record"))
    return made, text.join(F.broadcast(errors) if few else errors, ["file", "line_no"]).select("file", "line_no", "kind", "record", "message")


def _stored(made: GraphSet) -> GraphSet:
    return made.map(lambda name, t: materialise(t, name))


def _finish(records: DataFrame, mode: str, links: str) -> GraphSet:
    from ..operators.validation import reference_errors

    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError("mode is FAILFAST or PERMISSIVE")
    made, errors = _made(records, links)
    first = errors.orderBy("file", "line_no", "message").limit(5).collect() if mode == "FAILFAST" else []
    if not first:
        made = _stored(made)
        if mode == "FAILFAST":
            first = reference_errors(made, check_links=links != "permissive").limit(5).collect()
    if first:
        raise InvalidGraphs("; ".join(" ".join(str(v) for v in r) for r in first))
    return made


def load(spark: SparkSession, paths: str | list[str], mode: str = "FAILFAST", links: str = "strict") -> GraphSet:
    """Read files. ``mode`` FAILFAST raises on any malformed record or reference, PERMISSIVE leaves such records out.

    ``links`` = permissive accepts links to graphs that aren't there, as selecting and splitting write them.
    """
    return _finish(read_records(spark, paths), mode, links)


def read(spark: SparkSession, paths: str | list[str], links: str = "strict", stored: bool = True) -> tuple[GraphSet, DataFrame]:
    """Read files as :func:`load` does in mode PERMISSIVE, with a row (file, line_no, kind, record, message) for each record left out.

    Without ``stored`` the tables are made from the stored records as they are asked for, for callers that want the errors or few tables.
    """
    made, errors = _made(read_records(spark, paths), links)
    return (_stored(made) if stored else made), errors


def loads(spark: SparkSession, text: str, mode: str = "FAILFAST", links: str = "strict") -> GraphSet:
    """Read a text in memory."""
    return _finish(parse_records(spark, text), mode, links)
