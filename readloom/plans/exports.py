"""Exchange formats as tables of text lines.

Each function returns ``line`` with the columns that order it (``file_ord``, ``graph_ord``, ``row_ord``: an array of
longs, compared from the left). Attribute order, which has no meaning, is by tag, and shared reads are sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_GRAPH, GTF_SOURCE, PROGRAM_HEADER, SUMMARY_COLUMNS, VCF_ALT, VCF_COLUMNS, VCF_INFO, VCF_VERSION
from ..functions import text as T
from ..functions.intervals import read_ids, reference_end, reference_start
from ..operators.lookups import numbered
from ..schema import GraphSet

ORDER = ["graph_ord", "row_ord"]
#: Header lines in a chunk, about, and chunks that are broadcast at most, when a collection is split.
HEADERS_AT_ONCE, HEADER_CHUNKS = 1000, 64
_TAB = "\t"


def _key(*parts) -> Column:
    return F.array(*[F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("bigint"), F.lit(0).cast("bigint")) for p in parts])


def _tabs(*parts) -> Column:
    return F.concat_ws(_TAB, *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _stack(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _placed(t: DataFrame, g: GraphSet) -> DataFrame:
    """``t`` with its graph's place among the graphs."""
    return t.join(g.graphs.select("graph_id", graph_order(g).alias("graph_ord")), "graph_id")


def graph_order(g: GraphSet) -> Column:
    """A sortable place of a graph: its file, then its line."""
    return F.col("file").cast("bigint") * 2**40 + F.col("ord")


# --- lines of single elements --------------------------------------------------------------------------------------


def header_line() -> Column:
    return _tabs("H", F.col("tag"), F.col("value"))


def node_line() -> Column:
    """An empty sequence leaves a trailing tab."""
    return F.concat(F.lit("N\t"), F.col("node_id"), F.lit(_TAB), F.concat_ws(":", "reference_id", "strand", T.exons_text(F.col("exons"))), F.lit(_TAB),
                    F.array_join(T.read_texts(F.col("reads")), ","), F.lit(_TAB), F.coalesce("sequence", F.lit("")))


def edge_line() -> Column:
    return _tabs("E", F.col("edge_id"), F.col("source_id"), F.col("sink_id"), T.sv_text(F.col("sv")))


def group_line() -> Column:
    """Elements are joined by a space."""
    return _tabs(F.col("kind"), F.col("group_id"), F.array_join(F.transform("elements", T.element_text), " "))


def path_line() -> Column:
    """A traversed path with its nodes and edges in turn, all forward."""
    n = F.size("nodes")
    parts = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(
        i < n - 1, F.array(F.get("nodes", i), F.get("edges", i))).otherwise(F.array(F.get("nodes", i)))))
    return _tabs("P", F.col("path_id"), F.array_join(F.transform(parts, lambda x: F.concat(x, F.lit("+"))), _TAB))


def link_line() -> Column:
    base = _tabs("L", F.col("link_id"), F.concat_ws(":", "source_graph", "source_element"), F.concat_ws(":", "target_graph", "target_element"), F.col("link_type"))
    return F.concat_ws(_TAB, base, T.attribute_texts(F.col("attributes")))


# --- whole collections ---------------------------------------------------------------------------------------------


def text_lines(g: GraphSet) -> DataFrame:
    """The native text: graph_id (null outside graphs), graph_ord, row_ord, line."""
    spark = g.graphs.sparkSession
    none = F.lit(None).cast("string").alias("graph_id")
    fixed = lambda at, rows: spark.createDataFrame([(at, [0, i], x) for i, x in rows], "graph_ord bigint, row_ord array<bigint>, line string").select(none, "graph_ord", "row_ord", "line")
    head = _stack(
        fixed(-1, [(0, "# Global header")]),
        g.headers.select(none, F.lit(-1).cast("bigint").alias("graph_ord"), _key(1, F.col("file").cast("bigint") * 2**40 + F.col("ord")).alias("row_ord"), header_line().alias("line")),
        spark.createDataFrame([(-1, [2, 0], _TAB.join(("H", *PROGRAM_HEADER)))], "graph_ord bigint, row_ord array<bigint>, line string").select(none, "graph_ord", "row_ord", "line"),
    )
    shown = g.graphs.join(g.nodes.where(F.col("graph_id") == DEFAULT_GRAPH).select("graph_id").distinct().withColumn("full", F.lit(True)), "graph_id", "left").where(
        (F.col("graph_id") != DEFAULT_GRAPH) | F.col("full")).withColumn("graph_ord", graph_order(g))
    attrs = F.transform(T.sorted_attributes(F.col("attributes")), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"]))
    titles = shown.select("graph_id", "graph_ord", F.explode(F.array(
        F.struct(_key(0, 0).alias("k"), F.lit("").alias("t")), F.struct(_key(0, 1).alias("k"), F.concat(F.lit("# Graph: "), "graph_id").alias("t")),
        F.struct(_key(0, 2).alias("k"), F.concat_ws(_TAB, F.lit("G"), F.col("graph_id"), attrs).alias("t")),
        *[F.struct(_key(i, 0).alias("k"), F.lit(f"# {t}").alias("t")) for i, t in ((1, "Nodes"), (3, "Edges"), (5, "Groups"), (7, "Attributes"))])).alias("x")).select(
        "graph_id", "graph_ord", F.col("x.k").alias("row_ord"), F.col("x.t").alias("line"))
    place = shown.select("graph_id", "graph_ord")
    body = [titles]
    for at, table, line in ((2, g.nodes, node_line()), (4, g.edges, edge_line()), (6, g.groups, group_line())):
        body.append(table.join(place, "graph_id").select("graph_id", "graph_ord", _key(at, F.col("ord")).alias("row_ord"), line.alias("line")))
    for at, table, kind, name in ((8, g.nodes, F.lit("N"), "node_id"), (9, g.edges, F.lit("E"), "edge_id"), (10, g.groups, F.col("kind"), "group_id")):
        body.append(table.join(place, "graph_id").select("graph_id", "graph_ord", "ord", kind.alias("k"), F.col(name).alias("i"), F.posexplode(T.attribute_texts(F.col("attributes"))).alias("p", "a")).select(
            "graph_id", "graph_ord", _key(at, F.col("ord"), F.col("p")).alias("row_ord"), _tabs("A", F.col("k"), F.col("i"), F.col("a")).alias("line")))
    last = F.lit(2**62).alias("graph_ord")
    links = g.links.select(none, last, _key(2, F.col("file").cast("bigint") * 2**40 + F.col("ord")).alias("row_ord"), link_line().alias("line"))
    title = g.links.limit(1).select(none, last, F.explode(F.array(F.struct(_key(0, 0).alias("k"), F.lit("").alias("t")), F.struct(_key(1, 0).alias("k"), F.lit("# Inter-graph links").alias("t")))).alias("x")).select(
        "graph_id", "graph_ord", F.col("x.k").alias("row_ord"), F.col("x.t").alias("line"))
    return _stack(head, *body, title, links)


def header_lines(g: GraphSet) -> DataFrame:
    return g.headers.select(F.lit(0).cast("bigint").alias("graph_ord"), _key(F.col("file"), F.col("ord")).alias("row_ord"), header_line().alias("line"))


def path_lines(g: GraphSet, paths: DataFrame, text: bool = True) -> DataFrame:
    """A line per path: its id, or with ``text`` its elements too."""
    return _placed(paths, g).select("graph_id", "graph_ord", _key(F.col("path_ord")).alias("row_ord"), (path_line() if text else F.col("path_id")).alias("line"))


def summary_lines(g: GraphSet, summary: DataFrame) -> DataFrame:
    spark = g.graphs.sparkSession
    head = spark.createDataFrame([(-1, [0], ",".join(SUMMARY_COLUMNS))], "graph_ord bigint, row_ord array<bigint>, line string")
    rows = _placed(summary.withColumnRenamed("gid", "graph_id"), g)
    return head.unionByName(rows.select("graph_ord", _key(0).alias("row_ord"), F.concat_ws(",", "graph_id", *[F.col(c).cast("string") for c in SUMMARY_COLUMNS[1:]]).alias("line")))


def _gtf_attributes(attributes: Column) -> Column:
    return F.array_join(F.transform(T.sorted_attributes(attributes), lambda e: F.concat(e["key"], F.lit(' "'), e["value"]["value"], F.lit('"; '))), "")


def _shared_gtf() -> Column:
    return F.concat(F.lit('transcript_id "'), "path_id", F.lit('"; gene_id "'), "graph_id", F.lit('"; '))


def gtf_lines(g: GraphSet, paths: DataFrame) -> DataFrame:
    """A transcript line per path and a line per exon of its nodes; exon numbers restart at each node."""
    placed = _placed(paths, g)
    transcripts = placed.select("graph_id", "graph_ord", _key(F.col("path_ord"), -1, 0).alias("row_ord"), F.concat(_tabs(".", GTF_SOURCE, "transcript", ".", ".", ".", ".", ".", ""), _shared_gtf()).alias("line"))
    steps = placed.select("graph_id", "graph_ord", "path_ord", "path_id", F.posexplode("nodes").alias("pos", "node_id"))
    nodes = g.nodes.select("graph_id", "node_id", "reference_id", "strand", "exons", _gtf_attributes(F.col("attributes")).alias("own"))
    exons = steps.join(nodes, ["graph_id", "node_id"]).select("*", F.posexplode("exons").alias("i", "exon"))
    line = F.concat(_tabs(F.col("reference_id"), GTF_SOURCE, "exon", F.col("exon.start").cast("string"), F.col("exon.end").cast("string"), ".", F.col("strand"), ".", ""),
                    F.format_string('exon_id "%03d"; ', F.col("i") + 1), "own", _shared_gtf())
    return transcripts.unionByName(exons.select("graph_id", "graph_ord", _key(F.col("path_ord"), F.col("pos"), F.col("i")).alias("row_ord"), line.alias("line")))


def vcf_header() -> list[str]:
    out = [f"##fileformat={VCF_VERSION}", f"##source={GTF_SOURCE}"]
    out += [f'##INFO=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in VCF_INFO]
    out.append('##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">')
    out += [f'##ALT=<ID={i},Description="{d}">' for i, d in VCF_ALT]
    return [*out, _TAB.join(VCF_COLUMNS)]


def vcf_lines(g: GraphSet, paths: DataFrame) -> DataFrame:
    """The header, and a line per edge of each path; the shared reads are those of the edge's two nodes."""
    spark = g.graphs.sparkSession
    head = spark.createDataFrame([(None, -1, [i], x) for i, x in enumerate(vcf_header())], "graph_id string, graph_ord bigint, row_ord array<bigint>, line string")
    placed = _placed(paths, g)
    single = placed.where(F.size("edges") == 0).select("graph_id", "graph_ord", _key(F.col("path_ord"), 0).alias("row_ord"), F.lit("").alias("line"))
    steps = placed.select("graph_id", "graph_ord", "path_ord", "path_id", "nodes", F.posexplode("edges").alias("pos", "edge_id")).withColumns(
        {"source_id": F.get("nodes", F.col("pos")), "sink_id": F.get("nodes", F.col("pos") + 1)})
    facts = g.edges.select("graph_id", "source_id", "sink_id", "sv", "attributes")
    side = lambda k: g.nodes.select("graph_id", F.col("node_id").alias(f"{k}_id"), F.col("strand").alias(f"{k}_strand"), read_ids(F.col("reads")).alias(f"{k}_reads"))
    rows = steps.join(facts, ["graph_id", "source_id", "sink_id"]).join(side("source"), ["graph_id", "source_id"]).join(side("sink"), ["graph_id", "sink_id"])
    own = F.array_join(F.transform(T.sorted_attributes(F.col("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"], F.lit(";"))), "")
    info = F.concat(
        F.lit("SVTYPE="), "sv.sv_type", F.lit(";CHR2="), "sv.reference_name2", F.lit(";SVEND="), F.col("sv.breakpoint2").cast("string"), F.lit(";"), own,
        F.lit("SEGMENT1="), "source_id", F.lit(";SEGMENT2="), "sink_id", F.lit(";STRAND1="), "source_strand", F.lit(";STRAND2="), "sink_strand",
        F.lit(";SR_ID="), F.array_join(F.array_sort(F.array_intersect("source_reads", "sink_reads")), ","), F.lit(";transcript_id="), "path_id", F.lit(";gene_id="), "graph_id", F.lit(";"))
    line = _tabs(F.col("sv.reference_name1"), F.col("sv.breakpoint1").cast("string"), F.col("edge_id"), ".", F.concat(F.lit("<"), "sv.sv_type", F.lit(">")), ".", ".", info, "GT", "0/1")
    return _stack(head, single, rows.select("graph_id", "graph_ord", _key(F.col("path_ord"), F.col("pos")).alias("row_ord"), line.alias("line")))


def path_sequences(g: GraphSet, paths: DataFrame) -> DataFrame:
    """(graph_id, path_ord, path_id, sequence): the nodes' sequences in path order; null where one is missing."""
    steps = paths.select("graph_id", "path_ord", "path_id", F.posexplode("nodes").alias("pos", "node_id")).join(g.nodes.select("graph_id", "node_id", "sequence"), ["graph_id", "node_id"])
    parts = steps.groupBy("graph_id", "path_ord", "path_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("sequence", F.lit("")).alias("s")))).alias("p"), F.count_if(F.col("sequence").isNull()).alias("missing"))
    return parts.select("graph_id", "path_ord", "path_id", F.when(F.col("missing") == 0, F.array_join(F.transform("p", lambda x: x["s"]), "")).alias("sequence"))


def fasta_lines(g: GraphSet, paths: DataFrame) -> DataFrame:
    """Two lines per path; a missing sequence is an error when the lines are made."""
    seq = F.coalesce("sequence", F.raise_error(F.concat(F.lit("path without a whole sequence: "), "path_id")).cast("string"))
    return _placed(path_sequences(g, paths), g).select("graph_id", "graph_ord", "path_ord", F.posexplode(F.array(F.concat(F.lit(">"), "path_id"), seq)).alias("i", "line")).select(
        "graph_id", "graph_ord", _key(F.col("path_ord"), F.col("i")).alias("row_ord"), "line")


def dot_lines(g: GraphSet, node_index: bool = True, edge_index: bool = True) -> DataFrame:
    """Each graph in DOT; nodes and edges are labelled by their index, or by their id."""
    nodes, edges = numbered(g.nodes), numbered(g.edges)
    label = lambda by, i, name: F.concat(F.lit(' [ label = "'), i.cast("string") if by else F.col(name), F.lit('" ]'))
    index = lambda k: nodes.select("graph_id", F.col("node_id").alias(f"{k}_id"), F.col("idx").alias(f"{k}_idx"))
    frame = g.graphs.select("graph_id", F.explode(F.array(F.struct(_key(0, 0).alias("k"), F.lit("digraph {").alias("t")), F.struct(_key(3, 0).alias("k"), F.lit("}").alias("t")))).alias("x"))
    n = nodes.select("graph_id", _key(1, F.col("idx")).alias("row_ord"), F.concat(F.lit("    "), F.col("idx").cast("string"), label(node_index, F.col("idx"), "node_id")).alias("line"))
    e = edges.join(index("source"), ["graph_id", "source_id"]).join(index("sink"), ["graph_id", "sink_id"]).select(
        "graph_id", _key(2, F.col("idx")).alias("row_ord"), F.concat(F.lit("    "), F.col("source_idx").cast("string"), F.lit(" -> "), F.col("sink_idx").cast("string"), label(edge_index, F.col("idx"), "edge_id")).alias("line"))
    return _placed(_stack(frame.select("graph_id", F.col("x.k").alias("row_ord"), F.col("x.t").alias("line")), n, e), g).select("graph_id", "graph_ord", "row_ord", "line")


# --- JSON ----------------------------------------------------------------------------------------------------------


def _quoted(x: Column) -> Column:
    """A JSON string literal."""
    inner = F.to_json(F.array(x))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def _object(entries: Column) -> Column:
    """A JSON object of an array of (key, text of value), by key."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["text"])), ","), F.lit("}"))


def _entry(key: str, text: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), text.alias("text"))


def json_nodes(g: GraphSet) -> DataFrame:
    """(graph_id, ord, node_id, json) of each node. Attributes join the fields and may replace them; a node with a
    malformed number among them is left out. A node without exons has null coordinates, and numbers that JSON lacks
    (infinities, NaN) are null."""
    number = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    real = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), "null").otherwise(x.cast("string"))
    attrs = F.map_entries("attributes")
    value = lambda v: F.when(v["type"] == "i", v["value"].try_cast("bigint").cast("string")).when(
        v["type"] == "f", real(v["value"].try_cast("float").cast("double"))).otherwise(_quoted(v["value"]))
    extra = F.transform(attrs, lambda e: F.struct(e["key"].alias("key"), value(e["value"]).alias("text")))
    base = F.array(
        _entry("chrom", _quoted(F.col("reference_id"))), _entry("ref_start", number(reference_start(F.col("exons")))), _entry("ref_end", number(reference_end(F.col("exons")))),
        _entry("strand", _quoted(F.col("strand"))), _entry("exons", _quoted(F.concat(F.lit("["), T.exons_text(F.col("exons")), F.lit("]")))),
        _entry("reads", F.to_json(T.read_texts(F.col("reads")))), _entry("id", _quoted(F.col("node_id"))))
    kept = F.filter(base, lambda b: ~F.array_contains(F.map_keys("attributes"), b["key"]))
    whole = ~F.exists(extra, lambda e: e["text"].isNull())
    return g.nodes.where(whole).select("graph_id", "ord", "node_id", _object(F.concat(kept, extra)).alias("json"))


def edge_weights(g: GraphSet) -> DataFrame:
    """Edges with ``weight``, the number of reads that both ends have."""
    side = lambda k: g.nodes.select("graph_id", F.col("node_id").alias(f"{k}_id"), read_ids(F.col("reads")).alias(f"{k}_reads"))
    return g.edges.join(side("source"), ["graph_id", "source_id"]).join(side("sink"), ["graph_id", "sink_id"]).withColumn(
        "weight", F.size(F.array_intersect("source_reads", "sink_reads")).cast("bigint")).drop("source_reads", "sink_reads")


def json_edges(g: GraphSet) -> DataFrame:
    """(graph_id, ord, edge_id, json) of each edge; edge attributes are not exported."""
    entries = F.array(_entry("id", _quoted(F.col("edge_id"))), _entry("source", _quoted(F.col("source_id"))), _entry("target", _quoted(F.col("sink_id"))),
                      _entry("weight", F.col("weight").cast("string")), _entry("breakpoints", _quoted(T.sv_text(F.col("sv")))))
    return edge_weights(g).select("graph_id", "ord", "edge_id", _object(entries).alias("json"))


def json_lines(g: GraphSet) -> DataFrame:
    """One JSON document per graph."""
    def listed(t: DataFrame, name: str) -> DataFrame:
        return t.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("ord", "json"))).alias("x")).select(
            "graph_id", F.array_join(F.transform("x", lambda r: F.concat(F.lit('{"data":'), r["json"], F.lit("}"))), ",").alias(name))

    blank = lambda c: F.coalesce(c, F.lit(""))
    rows = _placed(g.graphs.select("graph_id"), g).join(listed(json_nodes(g), "n"), "graph_id", "left").join(listed(json_edges(g), "e"), "graph_id", "left")
    line = F.concat(F.lit('{"directed":true,"elements":{"edges":['), blank("e"), F.lit('],"nodes":['), blank("n"), F.lit(']},"multigraph":true}'))
    return rows.select("graph_id", "graph_ord", _key(0).alias("row_ord"), line.alias("line"))


# --- split ---------------------------------------------------------------------------------------------------------


def split_lines(g: GraphSet) -> DataFrame:
    """The native text of each graph as a collection of its own: all headers, the graph, and the links that touch it."""
    from ..operators.datasets import split_links

    own = text_lines(g.with_tables(links=g.links.limit(0)))
    # every file repeats the headers: they go in chunks of bounded size, which graphs are joined with by number
    heads = own.where("graph_id IS NULL")
    chunks = -(-heads.count() // HEADERS_AT_ONCE)
    dealt = heads.groupBy(F.pmod(F.xxhash64("row_ord", "line"), F.lit(chunks)).alias("k")).agg(F.collect_list(F.struct("graph_ord", "row_ord", "line")).alias("h"))
    each = g.graphs.select("graph_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))))
    shared = each.join(F.broadcast(dealt) if chunks <= HEADER_CHUNKS else dealt, "k").select("graph_id", F.inline("h"))
    links = split_links(g).withColumnRenamed("for_graph", "graph_id")
    last = F.lit(2**62).alias("graph_ord")
    title = links.select("graph_id").distinct().select("graph_id", last, F.explode(F.array(F.struct(_key(0, 0).alias("k"), F.lit("").alias("t")), F.struct(_key(1, 0).alias("k"), F.lit("# Inter-graph links").alias("t")))).alias("x")).select(
        "graph_id", "graph_ord", F.col("x.k").alias("row_ord"), F.col("x.t").alias("line"))
    rows = links.select("graph_id", last, _key(2, F.col("file").cast("bigint") * 2**40 + F.col("ord")).alias("row_ord"), link_line().alias("line"))
    return _stack(own.where("graph_id IS NOT NULL"), shared.select("graph_id", "graph_ord", "row_ord", "line"), title, rows)
