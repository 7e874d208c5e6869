"""Queries over the text format itself: the derived graphs are written as text with every awkwardness, read back and compared.

Each graph's section declares every node twice (the second replaces the first), every edge twice under two ids, an edge
to a node that is never declared, groups of all kinds, and attributes before and after what replaces them. Fields are
separated by tabs or blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import datasets, lookups, traversal, validation
from .plans import exports
from .queries import _BASE, _PATHS, LOOKUP, SELECTED, _chains, graphs_of, query
from .schema import SCHEMAS, GraphSet, empty
from .sources.build import loads, read, tables
from .sources.fasta import annotate, read_fasta
from .sources.text import read_records
from .storage import materialise, new_dir

GHOST = "ghost"


def _lines(rows: DataFrame, at: int, line: Column, order: Column | str = "ord") -> DataFrame:
    return rows.select("graph_id", F.lit(at).alias("part"), (F.col(order) if isinstance(order, str) else order).cast("bigint").alias("o"), line.alias("line"))


def awkward_lines(g: GraphSet, links: bool = True) -> DataFrame:
    """(graph_ord, part, o, line) of a text that leads to the graphs of ``g``."""
    sep = lambda *p: F.concat_ws(" ", *[x if isinstance(x, Column) else F.lit(x) for x in p])
    first = F.col("node_id") == F.first("node_id").over(exports.Window.partitionBy("graph_id").orderBy("ord"))
    nodes = g.nodes.withColumn("first", first)
    place = F.concat_ws(":", "reference_id", "strand", T.exons_text(F.col("exons")))
    reads = F.array_join(T.read_texts(F.col("reads")), ",")
    chains = _chains(g).groups
    parts = [
        _lines(g.graphs, 0, F.concat(F.lit("  G\t"), "graph_id", F.lit(" made:Z:of:events  day:i:"), F.substring("graph_id", 2, 8))),
        _lines(g.nodes, 1, sep("N", F.col("node_id"), "old:-:5-6,7-8", "nobody:SO", "TT")),
        _lines(g.nodes, 2, sep("A", "N", F.col("node_id"), "lost:i:1")),
        _lines(g.edges, 3, sep("E", F.concat(F.lit("old_"), "edge_id"), F.col("source_id"), F.col("sink_id"), "a,b,1,2,none")),
        _lines(g.edges, 4, F.concat_ws("\t", F.lit(" E"), F.col("edge_id"), F.col("source_id"), F.col("sink_id"), T.sv_text(F.col("sv")))),
        _lines(nodes.where("first"), 5, sep("E", F.concat(F.lit("to_"), F.lit(GHOST)), F.col("node_id"), GHOST, "x,y,3,4,far")),
        _lines(g.nodes, 6, F.concat_ws("\t", F.lit("N"), F.col("node_id"), place, reads, F.col("sequence"))),
        _lines(g.nodes, 7, F.concat(F.lit("A N "), "node_id", F.lit(" ptc:i:0 ptf:f:"), F.col("attributes")["ptf"]["value"])),
        _lines(g.nodes, 8, sep("A", "N", F.col("node_id"), F.concat(F.lit("ptc:i:"), F.col("attributes")["ptc"]["value"]))),
        _lines(g.edges, 9, sep("A", "E", F.concat(F.lit("old_"), "edge_id"), F.concat(F.lit("sr:i:"), F.col("attributes")["sr"]["value"]))),
        _lines(g.groups, 10, F.concat(F.lit("P "), "group_id", F.lit(" "), F.array_join(F.transform("elements", T.element_text), "  "))),
        _lines(chains, 11, F.concat(F.lit("C c"), "group_id", F.lit("\t"), F.array_join(F.transform("elements", lambda x: x["id"]), "\t"))),
        _lines(nodes.where("first"), 12, F.concat(F.lit("U all "), "node_id", F.lit(" undeclared"))),
        _lines(nodes.where("first"), 13, F.lit("A U all n:i:2 n:i:3")),
    ]
    body = exports._stack(*parts).join(g.graphs.select("graph_id", exports.graph_order(g).alias("graph_ord")), "graph_id")
    spark = g.graphs.sparkSession
    head = spark.createDataFrame([(-1, 0, i, x) for i, x in enumerate(["# a comment", "H\tTSG\t1.0", "", "H  reference   events ", "X unknown record"])], "graph_ord bigint, part int, o bigint, line string")
    out = head.unionByName(body.select("graph_ord", "part", "o", "line"))
    if links:
        out = out.unionByName(g.links.select(F.lit(2**62).alias("graph_ord"), F.lit(0).alias("part"), F.col("ord").alias("o"), F.concat(exports.link_line(), F.lit(" w:f:1.5")).alias("line")))
    return out


def written(spark: SparkSession, sf_dir: str, extra: list[str] | None = None) -> str:
    """The path of the text of all graphs, a directory of part files, and of ``extra`` lines after them."""
    lines, path = awkward_lines(graphs_of(spark, sf_dir, stored=True)), new_dir(spark, "text")
    if extra:
        lines = lines.unionByName(spark.createDataFrame([(2**62 + 1, 0, i, x) for i, x in enumerate(extra)], "graph_ord bigint, part int, o bigint, line string"))
    lines.orderBy("graph_ord", "part", "o").select("line").write.text(path)
    return path


def _loaded(spark: SparkSession, sf_dir: str) -> GraphSet:
    """The tables of the text, made as they are asked for."""
    return tables(materialise(read_records(spark, written(spark, sf_dir)), "records"))[0]


def _long(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


@query("load_headers", "SELECT unnest(['TSG', 'reference']) AS tag, unnest(['1.0', 'events']) AS value")
def load_headers(spark, sf_dir):
    return _loaded(spark, sf_dir).headers.select("tag", "value")


@query("load_graphs", "SELECT DISTINCT graph_id, 'day:i:' || substr(graph_id, 2, 8) || ';made:Z:of:events' AS attributes FROM nodes")
def load_graphs(spark, sf_dir):
    return _loaded(spark, sf_dir).graphs.select("graph_id", F.array_join(T.attribute_texts(F.col("attributes")), ";").alias("attributes"))


_GHOSTS = f"""(SELECT graph_id, '{GHOST}' AS node_id, MAX(ord) + 1 AS ord FROM nodes GROUP BY graph_id)"""


@query("load_nodes", f"""SELECT graph_id, node_id, CAST(ord - 1 AS BIGINT) AS idx, reference_id, strand, exons, array_to_string(read_texts, ',') AS reads, sequence,
       'ptc:i:' || n_reads || ';ptf:f:' || CAST(n_reads / 10.0 AS DOUBLE) AS attributes, FALSE AS is_placeholder FROM nodes
       UNION ALL SELECT graph_id, node_id, CAST(ord - 1 AS BIGINT), '', '+', '', '', NULL, '', TRUE FROM {_GHOSTS}""")
def load_nodes(spark, sf_dir):
    """Declared twice, in the order of first mentions; the undeclared end of an edge comes last."""
    n = lookups.numbered(_loaded(spark, sf_dir).nodes)
    return n.select("graph_id", "node_id", *_long("idx"), "reference_id", "strand", T.exons_text(F.col("exons")).alias("exons"), F.array_join(T.read_texts(F.col("reads")), ",").alias("reads"), "sequence",
                    F.array_join(T.attribute_texts(F.col("attributes")), ";").alias("attributes"), "is_placeholder")


_FIRSTS = "(SELECT graph_id, node_id FROM nodes WHERE ord = 1)"


@query("load_edges", f"""SELECT e.graph_id, e.edge_id, CAST(e.ord - 1 AS BIGINT) AS idx, e.source_id, e.sink_id, e.sv, 'sr:i:' || e.sr AS attributes FROM edges e UNION ALL
       SELECT f.graph_id, 'to_{GHOST}', CAST((SELECT COUNT(*) FROM edges e WHERE e.graph_id = f.graph_id) AS BIGINT), f.node_id, '{GHOST}', 'x,y,3,4,far', '' FROM {_FIRSTS} f""")
def load_edges(spark, sf_dir):
    """Of two parallel edges the last one's id and data, with attributes that were given to the first one's id."""
    e = lookups.numbered(_loaded(spark, sf_dir).edges)
    return e.select("graph_id", "edge_id", *_long("idx"), "source_id", "sink_id", T.sv_text(F.col("sv")).alias("sv"), F.array_join(T.attribute_texts(F.col("attributes")), ";").alias("attributes"))


@query("load_aliases", f"SELECT unnest([edge_id, 'old_' || edge_id]) AS asked, edge_id AS kept, source_id, sink_id FROM edges WHERE graph_id = '{LOOKUP}' UNION ALL SELECT 'to_{GHOST}', 'to_{GHOST}', node_id, '{GHOST}' FROM {_FIRSTS} WHERE graph_id = '{LOOKUP}'")
def load_aliases(spark, sf_dir):
    """Every edge id of a graph with the edge that it leads to."""
    return lookups.edges(_loaded(spark, sf_dir), LOOKUP).select(F.col("edge_id").alias("asked"), F.col("_kept").alias("kept"), "source_id", "sink_id")


@query("edge_by_alias", f"SELECT edge_id, source_id, sink_id FROM edges WHERE graph_id = '{LOOKUP}' AND ord = 1")
def edge_by_alias(spark, sf_dir):
    """The edge that an overwritten id leads to: of the first edge of a graph."""
    g = graphs_of(spark, sf_dir)
    first = lookups.edge_by_index(g, LOOKUP, 0).select("edge_id").first()
    return lookups.edge(_loaded(spark, sf_dir), LOOKUP, f"old_{first[0]}" if first else "").select("edge_id", "source_id", "sink_id")


@query("node_by_id", f"SELECT node_id, reference_id, strand FROM nodes WHERE graph_id = '{LOOKUP}'")
def node_by_id(spark, sf_dir):
    """Each node of a graph, asked for by its id."""
    g = graphs_of(spark, sf_dir)
    ids = [r[0] for r in lookups.nodes(g, LOOKUP).select("node_id").collect()]  # at most an event type and bucket each
    found = [lookups.node(g, LOOKUP, i) for i in [*ids, "nowhere"]]
    return exports._stack(*found).select("node_id", "reference_id", "strand")


@query("load_groups", """SELECT graph_id, group_id, 'P' AS kind, array_to_string(list_transform(elements, lambda x: x || '+'), ' ') AS elements, '' AS attributes FROM user_paths UNION ALL
       SELECT graph_id, 'c' || group_id, 'C', array_to_string(list_transform(range(1, 2 * len(elements)), lambda i: CASE WHEN i % 2 = 1 THEN elements[CAST((i + 1) // 2 AS INT)]
       ELSE 'E_' || elements[CAST(i // 2 AS INT)] || '__' || elements[CAST(i // 2 + 1 AS INT)] END), ' '), '' FROM user_paths UNION ALL
       SELECT graph_id, 'all', 'U', node_id || ' undeclared', 'n:i:3' FROM nodes WHERE ord = 1""")
def load_groups(spark, sf_dir):
    return _loaded(spark, sf_dir).groups.select(
        "graph_id", "group_id", "kind", F.array_join(F.transform("elements", T.element_text), " ").alias("elements"), F.array_join(T.attribute_texts(F.col("attributes")), ";").alias("attributes"))


@query("load_links", """SELECT 'L_' || source_graph || '_' || source_element || '__' || target_graph || '_' || target_element AS link_id, source_graph, source_element, target_graph, target_element,
       'followup' AS link_type, 'w:f:1.5' AS attributes FROM links""")
def load_links(spark, sf_dir):
    return _loaded(spark, sf_dir).links.select("link_id", "source_graph", "source_element", "target_graph", "target_element", "link_type", F.array_join(T.attribute_texts(F.col("attributes")), ";").alias("attributes"))


def _few_lines(spark, sf_dir) -> list[tuple[str, str]]:
    """(graph, line) of the graph that lookups ask for: a text of a few lines."""
    g = lookups.graph(graphs_of(spark, sf_dir), LOOKUP)
    own = awkward_lines(g, links=False).where("graph_ord >= 0")
    return [(LOOKUP, r[0]) for r in own.orderBy("graph_ord", "part", "o").select("line").collect()]


@query("load_string", f"SELECT node_id, reference_id, exons FROM nodes WHERE graph_id = '{LOOKUP}' UNION ALL SELECT '{GHOST}', '', '' FROM {_FIRSTS} WHERE graph_id = '{LOOKUP}'")
def load_string(spark, sf_dir):
    """A text in memory, checked as a whole."""
    g = loads(spark, "\n".join(x for _, x in _few_lines(spark, sf_dir)))
    return g.nodes.select("node_id", "reference_id", T.exons_text(F.col("exons")).alias("exons"))


@query("default_graph", f"SELECT 'TSG_DEFAULT_GRAPH' AS graph_id, node_id, strand FROM nodes WHERE graph_id = '{LOOKUP}' UNION ALL SELECT 'TSG_DEFAULT_GRAPH', '{GHOST}', '+' FROM {_FIRSTS} WHERE graph_id = '{LOOKUP}'")
def default_graph(spark, sf_dir):
    """The same text without its graph line."""
    g = loads(spark, "\n".join(x for _, x in _few_lines(spark, sf_dir) if not x.lstrip().startswith("G")))
    return lookups.default_graph(g).nodes.select("graph_id", "node_id", "strand")


@query("round_trip", "SELECT graph_id, 'N' AS kind, node_id AS id, 'ptc:i:' || n_reads || ';ptf:f:' || CAST(n_reads / 10.0 AS DOUBLE) AS attributes FROM nodes UNION ALL SELECT graph_id, 'E', edge_id, 'sr:i:' || sr FROM edges UNION ALL SELECT graph_id, 'P', group_id, '' FROM user_paths")
def round_trip(spark, sf_dir):
    """Written by the native writer, loaded with all checks."""
    from .sources.build import load

    path = new_dir(spark, "native")
    exports_dir = exports.text_lines(graphs_of(spark, sf_dir, stored=True))
    exports_dir.orderBy(*exports.ORDER).select("line").write.text(path)
    g = load(spark, path)
    own = lambda t, kind, name: t.select("graph_id", kind.alias("kind"), F.col(name).alias("id"), F.array_join(T.attribute_texts(F.col("attributes")), ";").alias("attributes"))
    return own(g.nodes, F.lit("N"), "node_id").unionByName(own(g.edges, F.lit("E"), "edge_id")).unionByName(own(g.groups, F.col("kind"), "group_id"))


_BAD = ["H onlytag", "G bad", "N a c:+:1-2 r:XX", "N b c:*:1-2 r:SO", "E e a b c,c,1,2", "U u", "C c a e", "A N nowhere k:i:1", "L l bad:a nowhere:b t", "N fine c:+:1-2 r:SO", "G bad"]
_SAID = [
    ("H onlytag", "a header needs a tag and a value"), ("N a c:+:1-2 r:XX", "a node needs an id, chrom:strand:exons and reads"), ("N b c:*:1-2 r:SO", "a node needs an id, chrom:strand:exons and reads"),
    ("E e a b c,c,1,2", "an edge needs an id, two nodes and five variant fields"), ("U u", "a group needs an id and elements"), ("C c a e", "a chain alternates nodes and edges and ends with a node"),
    ("A N nowhere k:i:1", "the attribute's element is not defined before it"), ("L l bad:a nowhere:b t", "the link's target graph is not declared before it"), ("G bad", "the graph id was declared before"),
]


@query("load_errors", "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in _SAID) + ") v(record, message)")
def load_errors(spark, sf_dir):
    """Malformed lines after all graphs: each an error row, and nothing else."""
    _, errors = read(spark, written(spark, sf_dir, _BAD), stored=False)
    return errors.select("record", "message")


@query("built_rows", "SELECT * FROM (VALUES ('g', 'a,b', 'r'), ('g', 'a,c', 'r,s')) v(graph_id, nodes, reads)")
def built_rows(spark, sf_dir):
    """A graph made from rows, without a text; and none from empty tables."""
    node = lambda name, at, *reads: (0, "g", name, at, "c", "+", [(1, 2)], [(r, "IN") for r in reads], None, {}, False)
    edge = lambda name, at, a, b: (0, "g", name, at, a, b, ("c", "c", 1, 2, "x"), {})
    none = empty(spark)
    g = none.with_tables(
        graphs=spark.createDataFrame([(0, "g", 0, {})], SCHEMAS["graphs"]),
        nodes=spark.createDataFrame([node("a", 1, "r", "s"), node("b", 2, "r"), node("c", 3, "s", "r")], SCHEMAS["nodes"]),
        edges=spark.createDataFrame([edge("x", 1, "a", "b"), edge("y", 2, "a", "c")], SCHEMAS["edges"]))
    paths = traversal.traverse(g).unionByName(traversal.traverse(none))
    return paths.select("graph_id", F.array_join("nodes", ",").alias("nodes"), F.array_join(F.array_sort("reads"), ",").alias("reads"))


@query("field_tokens", "SELECT graph_id, node_id, 'N|' || node_id || '|' || reference_id || '|' || strand AS tokens, 4 AS n FROM nodes")
def field_tokens(spark, sf_dir):
    """White space of any kind and length separates."""
    line = F.concat(F.lit(" \t N\t\t"), "node_id", F.lit("  \t"), "reference_id", F.lit("  "), "strand", F.lit(" \t"))
    return graphs_of(spark, sf_dir).nodes.select("graph_id", "node_id", T.tokens(line).alias("t")).select("graph_id", "node_id", F.array_join("t", "|").alias("tokens"), F.size("t").alias("n"))


@query("id_lists", "SELECT unnest([0, 1, 2, 3]) AS place, unnest(['a', 'b c', 'd', 'e']) AS id")
def id_lists(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(datasets.id_list(" a,b c ,,", ["d ", "", "  ", " e"]))), "place int, id string")


@query("json_attribute", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, FALSE AS bad FROM events", base="none AS (SELECT 1)")
def json_attribute(spark, sf_dir):
    """Events' properties as JSON attributes; a text that isn't JSON, or of another type, has no value."""
    made = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    m = F.create_map(F.lit("p"), made("J", F.col("props")), F.lit("cut"), made("J", F.substring("props", 1, 3)), F.lit("z"), made("Z", F.col("props")))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", m.alias("m"))
    return rows.select("event_id", F.variant_get(T.as_json(F.col("m"), "p"), "$.k", "bigint").alias("k"), (T.as_json(F.col("m"), "cut").isNotNull() | T.as_json(F.col("m"), "z").isNotNull()).alias("bad"))


@query("fasta_lookup", """SELECT graph_id, node_id, reference_end - greatest(reference_start - 1, 1) + 1 AS n_bases,
       md5(substr(repeat('ACGT', CAST((reference_end - greatest(reference_start - 1, 1)) // 4 + 3 AS INT)),
           CAST((greatest(reference_start - 1, 1) - 1 + length(reference_id)) % 4 + 1 AS INT), CAST(reference_end - greatest(reference_start - 1, 1) + 1 AS INT))) AS bases FROM nodes""")
def fasta_lookup(spark, sf_dir):
    """Sequences from a FASTA file: ACGT over and over, for each event type from another base on."""
    g = graphs_of(spark, sf_dir, stored=True)
    path, width = new_dir(spark, "fasta"), 80
    most = g.nodes.agg(F.max(F.element_at("exons", -1)["end"])).first()[0]
    refs = g.nodes.select("reference_id").distinct()
    title = refs.select("reference_id", F.lit(-1).cast("bigint").alias("i"), F.concat(F.lit(">"), "reference_id", F.lit(" made up")).alias("line"))
    bases = F.substring(F.repeat(F.lit("ACGT"), width // 4 + 1), F.length("reference_id") % 4 + 1, F.lit(width))
    body = refs.select("reference_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(most // width).cast("bigint"))).alias("i"), bases.alias("line"))
    title.unionByName(body).orderBy("reference_id", "i").select("line").write.text(path)
    bare = g.with_tables(nodes=g.nodes.withColumn("sequence", F.lit(None).cast("string")))
    return annotate(bare, read_fasta(spark, path)).nodes.select("graph_id", "node_id", F.length("sequence").cast("bigint").alias("n_bases"), F.md5(F.col("sequence").cast("binary")).alias("bases"))


@query("validate_links", "SELECT target_graph AS graph_id, target_element || '?' AS id FROM links")
def validate_links(spark, sf_dir):
    """Links to elements that no graph has."""
    g = graphs_of(spark, sf_dir)
    return validation.missing_link_elements(g.with_tables(links=g.links.withColumn("target_element", F.concat("target_element", F.lit("?"))))).select("graph_id", "id")


@query("validate_traversal", "SELECT graph_id, array_to_string(nodes, ',') AS nodes FROM paths WHERE path_ord % 2 = 1", _PATHS)
def validate_traversal(spark, sf_dir):
    """Every second path without its last node; those alone are invalid."""
    g = graphs_of(spark, sf_dir, stored=True)
    cut = traversal.traverse(g).withColumn("whole", F.array_join("nodes", ",")).withColumn("nodes", F.when(F.col("path_ord") % 2 == 1, F.slice("nodes", F.lit(1), F.size("nodes") - 1)).otherwise(F.col("nodes")))
    return validation.invalid_paths(cut).select("graph_id", F.col("whole").alias("nodes"))


@query("merge_all", """SELECT 'graph' AS what, graph_id || unnest(['', '_1']) AS a, '' AS b FROM (SELECT DISTINCT graph_id FROM nodes)
       UNION ALL SELECT 'edge', graph_id || unnest(['', '_1']), edge_id FROM edges UNION ALL SELECT 'alias', graph_id || unnest(['', '_1']), edge_id FROM edges
       UNION ALL SELECT 'group', graph_id || unnest(['', '_1']), group_id FROM user_paths UNION ALL SELECT 'link', source_graph, target_graph || unnest(['', '']) FROM links
       UNION ALL SELECT 'header', unnest(['TSG', 'reference']), unnest(['1.0', 'events'])""")
def merge_all(spark, sf_dir):
    """A collection merged with itself: all tables but the nodes."""
    g = graphs_of(spark, sf_dir, stored=True)
    m = datasets.merge(g.map(lambda _, t: t.unionByName(t.withColumn("file", F.lit(1)))))
    row = lambda t, what, a, b: t.select(F.lit(what).alias("what"), F.col(a).alias("a"), (F.col(b) if b else F.lit("")).alias("b"))
    return exports._stack(row(m.graphs, "graph", "graph_id", ""), row(m.edges, "edge", "graph_id", "edge_id"), row(m.edge_aliases, "alias", "graph_id", "edge_id"), row(m.groups, "group", "graph_id", "group_id"),
                          row(m.links, "link", "source_graph", "target_graph"), row(m.headers, "header", "tag", "value"))


_CHOSEN = "(VALUES " + ", ".join(f"('{i}')" for i in SELECTED) + ") v(id)"


@query("query_tables", f"""SELECT 'graph' AS what, id AS a, '' AS b FROM {_CHOSEN} JOIN (SELECT DISTINCT graph_id FROM nodes) n ON n.graph_id = v.id UNION ALL
       SELECT 'edge', graph_id, edge_id FROM edges JOIN {_CHOSEN} ON id = graph_id UNION ALL SELECT 'group', graph_id, group_id FROM user_paths JOIN {_CHOSEN} ON id = graph_id UNION ALL
       SELECT 'header', unnest(['TSG', 'reference']), unnest(['1.0', 'events'])""")
def query_tables(spark, sf_dir):
    """Graphs selected by ids: their tables, and all headers; an id that no graph has is an error."""
    g = graphs_of(spark, sf_dir, stored=True)
    known = [r[0] for r in g.graphs.where(F.col("graph_id").isin(SELECTED)).select("graph_id").collect()]
    try:
        datasets.select_graphs(g, [*known, "no such graph"])
        raise AssertionError("an unknown id went through")
    except KeyError:
        s = datasets.select_graphs(g, known)
    row = lambda t, what, a, b: t.select(F.lit(what).alias("what"), F.col(a).alias("a"), (F.col(b) if b else F.lit("")).alias("b"))
    return exports._stack(row(s.graphs, "graph", "graph_id", ""), row(s.edges, "edge", "graph_id", "edge_id"), row(s.groups, "group", "graph_id", "group_id"), row(s.headers, "header", "tag", "value"))


@query("split_text", """SELECT graph_id, kind, CAST(COUNT(*) AS BIGINT) AS n FROM (
         SELECT graph_id, unnest(['H', 'H', 'H', 'G']) AS kind FROM (SELECT DISTINCT graph_id FROM nodes) UNION ALL SELECT graph_id, unnest(['N', 'A', 'A']) FROM nodes
         UNION ALL SELECT graph_id, unnest(['E', 'A']) FROM edges UNION ALL SELECT graph_id, 'P' FROM user_paths
         UNION ALL SELECT source_graph, 'L' FROM links UNION ALL SELECT target_graph, 'L' FROM links WHERE target_graph <> source_graph) GROUP BY graph_id, kind""")
def split_text(spark, sf_dir):
    """The records of each graph's own text."""
    lines = exports.split_lines(graphs_of(spark, sf_dir, stored=True)).where(F.col("line").rlike("^[HGNEPAL]\t"))
    return lines.groupBy("graph_id", F.substring("line", 1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
