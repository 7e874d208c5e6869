"""The queries of the graph engine over graphs derived from the events table, and the SQL of the same results.

Arrays are returned as text, so that values compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import identifiers, intervals
from .functions import text as T
from .operators import analytics, datasets, lookups, traversal, validation
from .plans import exports
from .schema import GraphSet
from .sources.events import derive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def graphs_of(spark: SparkSession, sf_dir: str, bucketed: bool = True, stored: bool = False) -> GraphSet:
    """The graphs of the events table; ``stored`` where a query reads their tables several times."""
    return derive(spark.read.parquet(f"{sf_dir}/events.parquet"), bucketed, stored)


_BASE = """
ev AS (
  SELECT CAST(ts AS DATE) AS d, user_id, user_id % 50 AS k, event_type, event_id, CAST(FLOOR(EXTRACT(HOUR FROM ts) / 6) AS INT) AS b,
         ROW_NUMBER() OVER (PARTITION BY CAST(ts AS DATE), user_id, FLOOR(EXTRACT(HOUR FROM ts) / 6) ORDER BY ts, event_id) AS rn
  FROM events),
visits AS (
  SELECT CONCAT('G', REPLACE(CAST(d AS VARCHAR), '-', ''), '_', CAST(k AS VARCHAR)) AS graph_id,
         CONCAT(event_type, '_', CAST(b AS VARCHAR)) AS node_id, CONCAT('u', CAST(user_id AS VARCHAR)) AS read_id,
         d, k, user_id, event_type, event_id, b, event_id * 10 AS exon_start, event_id * 10 + 1 + event_id % 9 AS exon_end,
         ROW_NUMBER() OVER (PARTITION BY d, user_id ORDER BY b) AS pos, COUNT(*) OVER (PARTITION BY d, user_id) AS n
  FROM ev WHERE rn = 1),
reads AS (
  SELECT graph_id, node_id, read_id, CASE WHEN pos = 1 THEN 'SO' WHEN pos = n THEN 'SI' ELSE 'IN' END AS identity FROM visits),
nodes AS (
  SELECT graph_id, node_id, event_type AS reference_id, CASE WHEN b % 2 = 0 THEN '+' ELSE '-' END AS strand, b,
         ROW_NUMBER() OVER (PARTITION BY graph_id ORDER BY b, event_type) AS ord, COUNT(*) AS n_reads,
         MIN(exon_start) AS reference_start, MAX(exon_end) AS reference_end, REPEAT('ACGT', b + 1) AS sequence,
         STRING_AGG(exon_start || '-' || exon_end, ',' ORDER BY exon_start) AS exons,
         SUM(exon_end - exon_start) AS span,
         LIST(read_id ORDER BY read_id) AS ids,
         LIST(read_id || ':' || CASE WHEN pos = 1 THEN 'SO' WHEN pos = n THEN 'SI' ELSE 'IN' END ORDER BY read_id) AS read_texts
  FROM visits GROUP BY graph_id, node_id, event_type, b),
pairs AS (
  SELECT s.graph_id, s.node_id AS source_id, t.node_id AS sink_id, COUNT(*) AS sr
  FROM visits s JOIN visits t ON s.graph_id = t.graph_id AND s.user_id = t.user_id AND s.d = t.d AND t.pos = s.pos + 1 GROUP BY ALL),
edges AS (
  SELECT p.graph_id, CONCAT('E_', p.source_id, '__', p.sink_id) AS edge_id, p.source_id, p.sink_id, p.sr,
         ROW_NUMBER() OVER (PARTITION BY p.graph_id ORDER BY a.ord, z.ord) AS ord,
         CONCAT_WS(',', a.reference_id, z.reference_id, CAST(a.reference_end AS VARCHAR), CAST(z.reference_start AS VARCHAR),
                   CASE WHEN a.reference_id = z.reference_id THEN 'splice' ELSE 'TRA' END) AS sv,
         a.reference_id AS ref1, z.reference_id AS ref2, a.reference_end AS bp1, z.reference_start AS bp2,
         CASE WHEN a.reference_id = z.reference_id THEN 'splice' ELSE 'TRA' END AS sv_type,
         a.strand AS strand1, z.strand AS strand2, list_sort(list_intersect(a.ids, z.ids)) AS shared
  FROM pairs p JOIN nodes a ON a.graph_id = p.graph_id AND a.node_id = p.source_id JOIN nodes z ON z.graph_id = p.graph_id AND z.node_id = p.sink_id),
ends AS (
  SELECT n.*, NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.sink_id = n.node_id) AS is_source,
         NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.source_id = n.node_id) AS is_sink FROM nodes n),
links AS (
  SELECT DISTINCT s.graph_id AS source_graph, s.node_id AS source_element, t.graph_id AS target_graph, t.node_id AS target_element
  FROM visits s JOIN visits t ON s.user_id = t.user_id AND t.d = s.d + INTERVAL 1 DAY AND s.pos = s.n AND t.pos = 1),
user_paths AS (
  SELECT graph_id, CONCAT('P_', read_id) AS group_id, LIST(node_id ORDER BY pos) AS elements FROM visits WHERE n > 1 GROUP BY ALL)"""

_PATHS = (
    _BASE
    + """,
walks AS (
  SELECT graph_id, node_id, is_sink, ord AS source_ord, [node_id] AS nodes, CAST([] AS VARCHAR[]) AS edges, CAST([] AS BIGINT[]) AS ords, ids AS reads
  FROM ends WHERE is_source
  UNION ALL
  SELECT w.graph_id, e.sink_id, z.is_sink, w.source_ord, list_append(w.nodes, e.sink_id), list_append(w.edges, e.edge_id), list_append(w.ords, -e.ord), list_intersect(w.reads, z.ids)
  FROM walks w JOIN edges e ON e.graph_id = w.graph_id AND e.source_id = w.node_id JOIN ends z ON z.graph_id = e.graph_id AND z.node_id = e.sink_id
  WHERE len(list_intersect(w.reads, z.ids)) > 0),
ids AS (
  SELECT *, array_to_string(nodes, '-') AS joined FROM walks WHERE is_sink),
paths AS (
  SELECT graph_id, nodes, edges, reads, ROW_NUMBER() OVER (PARTITION BY graph_id ORDER BY source_ord, len(nodes), ords) - 1 AS path_ord,
         'TSP' || substr(array_to_string(list_transform(range(0, 4), lambda i: lpad(CAST(CAST('0x' || substr(sha256(joined), CAST(i * 2 + 1 AS INT), 2) AS INTEGER) AS VARCHAR), 3, '0')), ''), 1, 10) AS path_id
  FROM ids)"""
)
_CYCLIC_BASE = (
    _BASE.replace("CONCAT(event_type, '_', CAST(b AS VARCHAR)) AS node_id", "event_type AS node_id")
    .replace("WHEN b % 2 = 0 THEN '+' ELSE '-' END AS strand, b,", "WHEN MIN(b) % 2 = 0 THEN '+' ELSE '-' END AS strand, MIN(b) AS b,")
    .replace("ORDER BY b, event_type) AS ord", "ORDER BY MIN(b), event_type) AS ord").replace("REPEAT('ACGT', b + 1)", "REPEAT('ACGT', MIN(b) + 1)")
    .replace("GROUP BY graph_id, node_id, event_type, b)", "GROUP BY graph_id, node_id, event_type)")
)
#: The id that point lookups ask for, and the ids that a selection asks for.
LOOKUP = "G20240101_7"
SELECTED = [f"G20240101_{k}" for k in (3, 7, 9)] + ["G20240102_7", "G20240102_9"]


def query(name: str, sql: str | None = None, base: str = _BASE):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"WITH RECURSIVE {base.strip()} {sql}"
        return f

    return add


def _long(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# --- tables and expressions ----------------------------------------------------------------------------------------


@query("node_table", """SELECT graph_id, node_id, CAST(ord AS BIGINT) AS ord, reference_id, strand, exons, array_to_string(read_texts, ',') AS reads, sequence,
       'ptc:i:' || n_reads || ';ptf:f:' || CAST(n_reads / 10.0 AS DOUBLE) AS attributes FROM nodes""")
def node_table(spark, sf_dir):
    return graphs_of(spark, sf_dir).nodes.select(
        "graph_id", "node_id", "ord", "reference_id", "strand", T.exons_text(F.col("exons")).alias("exons"), F.array_join(T.read_texts(F.col("reads")), ",").alias("reads"), "sequence",
        F.array_join(T.attribute_texts(F.col("attributes")), ";").alias("attributes"))


@query("edge_table", "SELECT graph_id, edge_id, CAST(ord AS BIGINT) AS ord, source_id, sink_id, sv, 'sr:i:' || sr AS attributes FROM edges")
def edge_table(spark, sf_dir):
    return graphs_of(spark, sf_dir).edges.select("graph_id", "edge_id", "ord", "source_id", "sink_id", T.sv_text(F.col("sv")).alias("sv"), F.array_join(T.attribute_texts(F.col("attributes")), ";").alias("attributes"))


@query("read_support", "SELECT graph_id, node_id, read_id, identity FROM reads")
def read_support(spark, sf_dir):
    return graphs_of(spark, sf_dir).nodes.select("graph_id", "node_id", F.explode("reads").alias("r")).select("graph_id", "node_id", F.col("r.id").alias("read_id"), F.col("r.identity").alias("identity"))


@query("edge_weight", "SELECT graph_id, edge_id, CAST(len(shared) AS BIGINT) AS weight FROM edges")
def edge_weight(spark, sf_dir):
    return exports.edge_weights(graphs_of(spark, sf_dir)).select("graph_id", "edge_id", "weight")


@query("degrees", """SELECT n.graph_id, n.node_id, (SELECT COUNT(*) FROM edges e WHERE e.graph_id = n.graph_id AND e.sink_id = n.node_id) AS in_degree,
       (SELECT COUNT(*) FROM edges e WHERE e.graph_id = n.graph_id AND e.source_id = n.node_id) AS out_degree FROM nodes n""")
def degrees(spark, sf_dir):
    return analytics.degrees(graphs_of(spark, sf_dir)).select("graph_id", "node_id", *_long("in_degree", "out_degree"))


@query("sources", "SELECT graph_id, node_id FROM ends WHERE is_source")
def sources(spark, sf_dir):
    return traversal.ends(graphs_of(spark, sf_dir)).where("is_source").select("graph_id", "node_id")


@query("sinks", "SELECT graph_id, node_id FROM ends WHERE is_sink")
def sinks(spark, sf_dir):
    return traversal.ends(graphs_of(spark, sf_dir)).where("is_sink").select("graph_id", "node_id")


@query("source_sink_counts", "SELECT graph_id, CAST(COUNT(*) FILTER (is_source) AS BIGINT) AS sources, CAST(COUNT(*) FILTER (is_sink) AS BIGINT) AS sinks FROM ends GROUP BY graph_id")
def source_sink_counts(spark, sf_dir):
    return analytics.source_sink_counts(graphs_of(spark, sf_dir)).select("graph_id", *_long("sources", "sinks"))


@query("exon_span", "SELECT graph_id, node_id, CAST(n_reads AS BIGINT) AS n_exons, CAST(span AS BIGINT) AS span FROM nodes")
def exon_span(spark, sf_dir):
    return graphs_of(spark, sf_dir).nodes.select("graph_id", "node_id", F.size("exons").cast("bigint").alias("n_exons"), intervals.span(F.col("exons")).alias("span"))


@query("introns", """SELECT graph_id, node_id, STRING_AGG((exon_end + 1) || '-' || nxt, ',' ORDER BY exon_start) AS introns FROM (
       SELECT *, LEAD(exon_start) OVER (PARTITION BY graph_id, node_id ORDER BY exon_start) AS nxt FROM visits) WHERE nxt IS NOT NULL GROUP BY graph_id, node_id""")
def introns(spark, sf_dir):
    return graphs_of(spark, sf_dir).nodes.where(F.size("exons") > 1).select("graph_id", "node_id", T.exons_text(intervals.introns(F.col("exons"))).alias("introns"))


@query("reference_bounds", "SELECT graph_id, node_id, reference_start, reference_end FROM nodes")
def reference_bounds(spark, sf_dir):
    e = F.col("exons")
    return graphs_of(spark, sf_dir).nodes.select("graph_id", "node_id", intervals.reference_start(e).alias("reference_start"), intervals.reference_end(e).alias("reference_end"))


@query("attr_typed_access", "SELECT graph_id, node_id, CAST(n_reads AS BIGINT) AS ptc, CAST(CAST(CAST(n_reads / 10.0 AS DOUBLE) AS FLOAT) AS DOUBLE) AS ptf, CAST(NULL AS BIGINT) AS ptf_as_int, FALSE AS has_text FROM nodes")
def attr_typed_access(spark, sf_dir):
    a = F.col("attributes")
    return graphs_of(spark, sf_dir).nodes.select(
        "graph_id", "node_id", T.as_int(a, "ptc").alias("ptc"), T.as_float(a, "ptf").cast("double").alias("ptf"), T.as_int(a, "ptf").alias("ptf_as_int"), T.as_string(a, "ptc").isNotNull().alias("has_text"))


@query("hash_identifier", "SELECT DISTINCT node_id, regexp_replace(substr(sha256(node_id), 1, 16), '^[0-9]', 'a') AS id16, regexp_replace(sha256(node_id), '^[0-9]', 'a') AS id64 FROM nodes")
def hash_identifier(spark, sf_dir):
    n = F.col("node_id")
    return graphs_of(spark, sf_dir).nodes.select("node_id").distinct().select("node_id", identifiers.hash_identifier(n, 16).alias("id16"), identifiers.hash_identifier(n).alias("id64"))


_DIGITS = "array_to_string(list_transform(range(0, 32), lambda i: lpad(CAST(CAST('0x' || substr(sha256(node_id), CAST(i * 2 + 1 AS INT), 2) AS INTEGER) AS VARCHAR), 3, '0')), '')"


@query("numeric_identifier", f"SELECT DISTINCT node_id, substr({_DIGITS}, 1, 10) AS id10, substr({_DIGITS}, 1, 64) AS id64 FROM nodes")
def numeric_identifier(spark, sf_dir):
    n = F.col("node_id")
    return graphs_of(spark, sf_dir).nodes.select("node_id").distinct().select("node_id", identifiers.numeric_identifier(n, 10).alias("id10"), identifiers.numeric_identifier(n).alias("id64"))


@query("parse_fields", """SELECT graph_id, node_id, strand, CAST(n_reads AS BIGINT) AS n_exons, reference_start AS first_start, reference_end AS last_end, CAST(n_reads AS BIGINT) AS n_reads,
       CAST(NULL AS VARCHAR) AS bad_strand FROM nodes""")
def parse_fields(spark, sf_dir):
    """Fields displayed and parsed again."""
    n = graphs_of(spark, sf_dir).nodes.select("graph_id", "node_id", F.split(F.concat_ws(":", "reference_id", "strand", T.exons_text(F.col("exons"))), ":").alias("loc"), F.array_join(T.read_texts(F.col("reads")), ",").alias("r"))
    e = T.exons(F.get("loc", F.lit(2)))
    return n.select("graph_id", "node_id", T.strand(F.get("loc", F.lit(1))).alias("strand"), F.size(e).cast("bigint").alias("n_exons"), intervals.reference_start(e).alias("first_start"),
                    intervals.reference_end(e).alias("last_end"), F.size(T.reads(F.col("r"))).cast("bigint").alias("n_reads"), T.strand(F.col("node_id")).alias("bad_strand"))


@query("parse_variants", "SELECT graph_id, edge_id, ref1, ref2, bp1, bp2, sv_type FROM edges")
def parse_variants(spark, sf_dir):
    x = T.structural_variant(T.sv_text(F.col("sv")))
    return graphs_of(spark, sf_dir).edges.select("graph_id", "edge_id", x.alias("x")).select(
        "graph_id", "edge_id", F.col("x.reference_name1").alias("ref1"), F.col("x.reference_name2").alias("ref2"), F.col("x.breakpoint1").alias("bp1"), F.col("x.breakpoint2").alias("bp2"), F.col("x.sv_type").alias("sv_type"))


@query("parse_attributes", "SELECT graph_id, node_id, 'ptf' AS tag, 'f' AS type, CAST(CAST(n_reads / 10.0 AS DOUBLE) AS VARCHAR) AS value FROM nodes UNION ALL SELECT graph_id, node_id, 'ptc', 'i', CAST(n_reads AS VARCHAR) FROM nodes")
def parse_attributes(spark, sf_dir):
    n = graphs_of(spark, sf_dir).nodes.select("graph_id", "node_id", F.explode(T.attribute_texts(F.col("attributes"))).alias("t"))
    return n.select("graph_id", "node_id", T.attribute(F.col("t")).alias("a")).select("graph_id", "node_id", "a.*")


@query("oriented_elements", "SELECT graph_id, group_id, unnest(elements) AS id, '+' AS orientation FROM user_paths")
def oriented_elements(spark, sf_dir):
    g = graphs_of(spark, sf_dir).groups.select("graph_id", "group_id", F.explode(F.transform("elements", T.element_text)).alias("t"))
    return g.select("graph_id", "group_id", T.oriented(F.col("t")).alias("e")).select("graph_id", "group_id", "e.*")


# --- lookups -------------------------------------------------------------------------------------------------------


@query("graph_lookup", f"SELECT node_id, CAST(ord - 1 AS BIGINT) AS idx FROM nodes WHERE graph_id = '{LOOKUP}'")
def graph_lookup(spark, sf_dir):
    return lookups.numbered(lookups.nodes(graphs_of(spark, sf_dir), LOOKUP)).select("node_id", *_long("idx"))


@query("node_lookup", f"SELECT graph_id, node_id, reference_id FROM nodes WHERE graph_id = '{LOOKUP}' AND ord = 1")
def node_lookup(spark, sf_dir):
    return lookups.node_by_index(graphs_of(spark, sf_dir), LOOKUP, 0).select("graph_id", "node_id", "reference_id")


@query("edge_lookup", f"SELECT graph_id, edge_id, source_id, sink_id FROM edges WHERE graph_id = '{LOOKUP}'")
def edge_lookup(spark, sf_dir):
    return lookups.edges(graphs_of(spark, sf_dir), LOOKUP).select("graph_id", "edge_id", "source_id", "sink_id")


@query("node_indices", "SELECT graph_id, CAST(ord - 1 AS BIGINT) AS idx, node_id FROM nodes")
def node_indices(spark, sf_dir):
    return lookups.node_indices(graphs_of(spark, sf_dir)).select("graph_id", *_long("idx"), "node_id")


@query("edge_indices", "SELECT graph_id, CAST(ord - 1 AS BIGINT) AS idx, edge_id FROM edges")
def edge_indices(spark, sf_dir):
    return lookups.edge_indices(graphs_of(spark, sf_dir)).select("graph_id", *_long("idx"), "edge_id")


def _chains(g: GraphSet) -> GraphSet:
    """The user paths as chains: nodes and the edges between them in turn."""
    n = F.size("elements")
    plain = lambda x: F.struct(x.alias("id"), F.lit(None).cast("string").alias("orientation"))
    step = lambda i: F.concat(F.lit("E_"), F.get("elements", i)["id"], F.lit("__"), F.get("elements", i + 1)["id"])
    parts = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < n - 1, F.array(plain(F.get("elements", i)["id"]), plain(step(i)))).otherwise(F.array(plain(F.get("elements", i)["id"])))))
    return g.with_tables(groups=g.groups.withColumns({"elements": parts, "kind": F.lit("C")}))


@query("chain_nodes", "SELECT graph_id, group_id, array_to_string(elements, ',') AS ids FROM user_paths")
def chain_nodes(spark, sf_dir):
    return lookups.chain_nodes(_chains(graphs_of(spark, sf_dir))).select("graph_id", "group_id", F.array_join("ids", ",").alias("ids"))


@query("chain_edges", "SELECT graph_id, group_id, array_to_string(list_transform(range(1, len(elements)), lambda i: 'E_' || elements[i] || '__' || elements[i + 1]), ',') AS ids FROM user_paths")
def chain_edges(spark, sf_dir):
    return lookups.chain_edges(_chains(graphs_of(spark, sf_dir))).select("graph_id", "group_id", F.array_join("ids", ",").alias("ids"))


# --- traversal -----------------------------------------------------------------------------------------------------


def _walked(spark, sf_dir):
    g = graphs_of(spark, sf_dir, stored=True)
    return g, traversal.traverse(g)


@query("traverse_paths", "SELECT graph_id, CAST(path_ord AS BIGINT) AS path_ord, array_to_string(nodes, ',') AS nodes, array_to_string(edges, ',') AS edges, array_to_string(list_sort(reads), ',') AS reads FROM paths", _PATHS)
def traverse_paths(spark, sf_dir):
    return _walked(spark, sf_dir)[1].select("graph_id", "path_ord", *[F.array_join(F.array_sort(c) if c == "reads" else c, ",").alias(c) for c in ("nodes", "edges", "reads")])


@query("traverse_by_id", f"SELECT CAST(path_ord AS BIGINT) AS path_ord, path_id FROM paths WHERE graph_id = '{LOOKUP}'", _PATHS)
def traverse_by_id(spark, sf_dir):
    return traversal.traverse_by_id(graphs_of(spark, sf_dir), LOOKUP).select("path_ord", "path_id")


@query("path_ids", "SELECT graph_id, path_id, CAST(len(nodes) AS BIGINT) AS len FROM paths", _PATHS)
def path_ids(spark, sf_dir):
    return _walked(spark, sf_dir)[1].select("graph_id", "path_id", F.size("nodes").cast("bigint").alias("len"))


@query("path_text", """SELECT graph_id, 'P' || chr(9) || path_id || chr(9) || array_to_string(list_transform(range(1, 2 * len(nodes)), lambda i: CASE WHEN i % 2 = 1 THEN nodes[CAST((i + 1) // 2 AS INT)]
       ELSE edges[CAST(i // 2 AS INT)] END || '+'), chr(9)) AS line FROM paths""", _PATHS)
def path_text(spark, sf_dir):
    g, paths = _walked(spark, sf_dir)
    return exports.path_lines(g, paths).select("graph_id", "line")


@query("path_count_maxlen", """SELECT g.graph_id, CAST(COUNT(p.graph_id) AS BIGINT) AS paths, CAST(COALESCE(MAX(len(p.nodes)), 0) AS BIGINT) AS max_path_len, COALESCE(BOOL_OR(len(p.nodes) >= 2), FALSE) AS super_path
       FROM (SELECT DISTINCT graph_id FROM nodes) g LEFT JOIN paths p ON p.graph_id = g.graph_id GROUP BY g.graph_id""", _PATHS)
def path_count_maxlen(spark, sf_dir):
    return analytics.path_stats(*_walked(spark, sf_dir))


@query("super_paths", "SELECT graph_id, path_id, len(nodes) >= 2 AS is_super FROM paths", _PATHS)
def super_paths(spark, sf_dir):
    """By the reads of the path's nodes, not by its length."""
    g, paths = _walked(spark, sf_dir)
    steps = paths.select("graph_id", "path_ord", "path_id", F.posexplode("nodes").alias("pos", "node_id")).join(g.nodes.select("graph_id", "node_id", intervals.read_ids(F.col("reads")).alias("ids")), ["graph_id", "node_id"])
    held = steps.groupBy("graph_id", "path_ord", "path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"]).alias("r"))
    return held.select("graph_id", "path_id", traversal.shares_read(F.col("r")).alias("is_super"))


@query("read_first_paths", "SELECT graph_id, array_to_string(nodes, ',') AS nodes, CAST(len(reads) AS BIGINT) AS n_reads FROM paths", _PATHS)
def read_first_paths(spark, sf_dir):
    return traversal.read_first_paths(graphs_of(spark, sf_dir, stored=True)).select("graph_id", F.array_join("nodes", ",").alias("nodes"), "n_reads")


# --- analytics -----------------------------------------------------------------------------------------------------

_CONNECTED = """,
reach(graph_id, a, z) AS (
  SELECT graph_id, node_id, node_id FROM nodes
  UNION
  SELECT r.graph_id, r.a, CASE WHEN e.source_id = r.z THEN e.sink_id ELSE e.source_id END FROM reach r JOIN edges e ON e.graph_id = r.graph_id AND (e.source_id = r.z OR e.sink_id = r.z)),
connected AS (
  SELECT graph_id, COUNT(*) = COUNT(DISTINCT a) * COUNT(DISTINCT a) AS is_connected FROM reach GROUP BY graph_id)"""


@query("is_connected", "SELECT graph_id, is_connected FROM connected", _BASE + _CONNECTED)
def is_connected(spark, sf_dir):
    return analytics.is_connected(graphs_of(spark, sf_dir, stored=True))


_CYCLE = """,
onward(graph_id, a, z) AS (
  SELECT graph_id, source_id, sink_id FROM edges
  UNION
  SELECT r.graph_id, r.a, e.sink_id FROM onward r JOIN edges e ON e.graph_id = r.graph_id AND e.source_id = r.z),
cyclic AS (
  SELECT g.graph_id, EXISTS (SELECT 1 FROM onward o WHERE o.graph_id = g.graph_id AND o.a = o.z) AS is_cyclic FROM (SELECT DISTINCT graph_id FROM nodes) g)"""


@query("is_cyclic", "SELECT graph_id, is_cyclic FROM cyclic", _BASE + _CYCLE)
def is_cyclic(spark, sf_dir):
    return analytics.is_cyclic(graphs_of(spark, sf_dir, stored=True))


@query("is_cyclic_unbucketed", "SELECT graph_id, is_cyclic FROM cyclic", _CYCLIC_BASE + _CYCLE)
def is_cyclic_unbucketed(spark, sf_dir):
    """Over graphs with cycles: nodes are event types, whatever the hour."""
    return analytics.is_cyclic(graphs_of(spark, sf_dir, bucketed=False))


@query("is_dag", "SELECT graph_id, is_connected AND NOT is_cyclic AS is_dag FROM connected JOIN cyclic USING (graph_id)", _BASE + _CONNECTED + _CYCLE)
def is_dag(spark, sf_dir):
    return analytics.is_dag(graphs_of(spark, sf_dir, stored=True))


@query("is_simple", "SELECT g.graph_id, COALESCE(MAX(len(p.nodes)), 0) = 2 AS is_simple FROM (SELECT DISTINCT graph_id FROM nodes) g LEFT JOIN paths p ON p.graph_id = g.graph_id GROUP BY g.graph_id", _PATHS)
def is_simple(spark, sf_dir):
    return analytics.is_simple(*_walked(spark, sf_dir))


_FACTS = """,
counts AS (
  SELECT n.graph_id, COUNT(*) FILTER (n.is_source) AS sources, COUNT(*) FILTER (n.is_sink) AS sinks FROM ends n GROUP BY n.graph_id),
lens AS (
  SELECT c.*, COALESCE((SELECT MAX(len(p.nodes)) FROM paths p WHERE p.graph_id = c.graph_id), 0) AS longest FROM counts c)"""
#: Bubbles of graphs of four layers at most, which buckets are: a search has taken all it can after two levels.
_BUBBLES = """,
kids AS (SELECT graph_id, source_id AS p, sink_id AS c, ROW_NUMBER() OVER (PARTITION BY graph_id, source_id ORDER BY ord DESC) AS k FROM edges),
forks AS (SELECT graph_id, p AS s, c AS f, k FROM kids k1 WHERE EXISTS (SELECT 1 FROM kids k2 WHERE k2.graph_id = k1.graph_id AND k2.p = k1.p AND k2.k = 2)),
starts AS (SELECT DISTINCT graph_id, f FROM forks),
level1 AS (SELECT s.graph_id, s.f, k.c AS n, k.k AS r FROM starts s JOIN kids k ON k.graph_id = s.graph_id AND k.p = s.f),
level2 AS (
  SELECT * FROM (
    SELECT a.graph_id, a.f, k.c AS n, a.n AS via, a.r AS vr, k.k, ROW_NUMBER() OVER (PARTITION BY a.graph_id, a.f, k.c ORDER BY a.r, k.k) AS pick
    FROM level1 a JOIN kids k ON k.graph_id = a.graph_id AND k.p = a.n
    WHERE NOT EXISTS (SELECT 1 FROM level1 b WHERE b.graph_id = a.graph_id AND b.f = a.f AND b.n = k.c)) WHERE pick = 1),
taken AS (
  SELECT graph_id, f, f AS n, 0 AS r, 0 AS known, [f] AS walk FROM starts
  UNION ALL SELECT graph_id, f, n, r, 1, [f, n] FROM level1
  UNION ALL SELECT graph_id, f, n, (SELECT COUNT(*) FROM level1 b WHERE b.graph_id = a.graph_id AND b.f = a.f) + ROW_NUMBER() OVER (PARTITION BY graph_id, f ORDER BY vr, k), vr + 1, [f, via, n] FROM level2 a),
duels AS (SELECT a.graph_id, a.s, a.f AS x, b.f AS y FROM forks a JOIN forks b ON a.graph_id = b.graph_id AND a.s = b.s AND a.k < b.k),
shared AS (
  SELECT d.*, t.n, t.r AS rx, u.r AS ry, t.known AS kx, u.known AS ky, list_prepend(d.s, t.walk) AS path1, list_prepend(d.s, u.walk) AS path2
  FROM duels d JOIN taken t ON t.graph_id = d.graph_id AND t.f = d.x JOIN taken u ON u.graph_id = d.graph_id AND u.f = d.y AND u.n = t.n),
ends_at AS (
  SELECT graph_id, s, x, y, MIN(CASE WHEN ky <= rx THEN rx END) AS first_x, MIN(CASE WHEN kx <= ry + 1 THEN ry END) AS first_y FROM shared GROUP BY ALL),
met AS (
  SELECT DISTINCT h.graph_id, h.path1, h.path2 FROM shared h JOIN ends_at e USING (graph_id, s, x, y)
  WHERE least(coalesce(e.first_x, 1000), coalesce(e.first_y, 1000)) < 100 AND len(h.path1) > 2 AND len(h.path2) > 2 AND (
        (h.rx = e.first_x AND h.ky <= h.rx AND coalesce(e.first_y, 1000) >= e.first_x)
     OR (h.ry = e.first_y AND h.kx <= h.ry + 1 AND coalesce(e.first_x, 1000) > e.first_y)
     OR (h.ry = e.first_x AND h.kx <= h.ry AND coalesce(e.first_y, 1000) >= e.first_x))),
around AS (
  SELECT t.graph_id, [t.s, t.f] AS path1, [t.s, u.f, t.f] AS path2 FROM forks t JOIN forks u ON u.graph_id = t.graph_id AND u.s = t.s AND u.f <> t.f JOIN kids k ON k.graph_id = u.graph_id AND k.p = u.f AND k.c = t.f
  UNION ALL
  SELECT t.graph_id, [t.s, t.f], [t.s, u.f, k.c, t.f] FROM forks t JOIN forks u ON u.graph_id = t.graph_id AND u.s = t.s AND u.f <> t.f JOIN kids k ON k.graph_id = u.graph_id AND k.p = u.f
  JOIN kids m ON m.graph_id = k.graph_id AND m.p = k.c AND m.c = t.f WHERE NOT EXISTS (SELECT 1 FROM forks w WHERE w.graph_id = t.graph_id AND w.s = t.s AND w.f = k.c)),
bubbles AS (SELECT * FROM met UNION ALL SELECT * FROM around)"""
_CLASS = """CASE WHEN longest = 2 THEN CASE WHEN sinks = 1 AND sources > 1 THEN 'FadeIn' WHEN sources = 1 AND sinks > 1 THEN 'FadeOut' WHEN sources > 1 AND sinks > 1 THEN 'Bipartite' ELSE 'NotDefined' END
       WHEN sources = 1 AND sinks = 1 THEN 'UniquePath' WHEN NOT EXISTS (SELECT 1 FROM bubbles b WHERE b.graph_id = l.graph_id) THEN 'NotDefined'
       WHEN EXISTS (SELECT 1 FROM bubbles b WHERE b.graph_id = l.graph_id AND len(b.path1) <> len(b.path2)) THEN 'HeteroPath' ELSE 'EquiPath' END"""


@query("bubbles", "SELECT graph_id, array_to_string(path1, ',') AS path1, array_to_string(path2, ',') AS path2 FROM bubbles", _BASE + _BUBBLES)
def bubbles(spark, sf_dir):
    return analytics.bubbles(graphs_of(spark, sf_dir, stored=True)).select("graph_id", F.array_join("path1", ",").alias("path1"), F.array_join("path2", ",").alias("path2"))


@query("is_bubble", "SELECT graph_id, EXISTS (SELECT 1 FROM bubbles b WHERE b.graph_id = n.graph_id) AS is_bubble FROM (SELECT DISTINCT graph_id FROM nodes) n", _BASE + _BUBBLES)
def is_bubble(spark, sf_dir):
    return analytics.is_bubble(graphs_of(spark, sf_dir, stored=True))


@query("topology", f"SELECT graph_id, {_CLASS} AS topology FROM lens l", _PATHS + _FACTS + _BUBBLES)
def topology(spark, sf_dir):
    return analytics.topology(*_walked(spark, sf_dir))


@query("topology_simple", """SELECT graph_id, CASE WHEN longest = 2 THEN CASE WHEN sinks = 1 AND sources > 1 THEN 'FadeIn' WHEN sources = 1 AND sinks > 1 THEN 'FadeOut'
       WHEN sources > 1 AND sinks > 1 THEN 'Bipartite' ELSE 'NotDefined' END WHEN sources = 1 AND sinks = 1 THEN 'UniquePath' ELSE 'ByBubbles' END AS class FROM lens""", _PATHS + _FACTS)
def topology_simple(spark, sf_dir):
    """The topology where bubbles don't decide it."""
    g, paths = _walked(spark, sf_dir)
    facts = analytics.path_stats(g, paths).join(analytics.source_sink_counts(g), "graph_id").join(analytics.topology(g, paths), "graph_id")
    decided = (F.col("max_path_len") == 2) | ((F.col("sources") == 1) & (F.col("sinks") == 1))
    return facts.select("graph_id", F.when(decided, F.col("topology")).otherwise("ByBubbles").alias("class"))


@query("is_fade_in", "SELECT graph_id, longest = 2 AND sinks = 1 AND sources > 1 AS matches FROM lens", _PATHS + _FACTS)
def is_fade_in(spark, sf_dir):
    return analytics.has_topology(analytics.topology(*_walked(spark, sf_dir)), "FadeIn")


@query("is_fade_out", "SELECT graph_id, longest = 2 AND sources = 1 AND sinks > 1 AS matches FROM lens", _PATHS + _FACTS)
def is_fade_out(spark, sf_dir):
    return analytics.has_topology(analytics.topology(*_walked(spark, sf_dir)), "FadeOut")


@query("is_bipartite", "SELECT graph_id, longest = 2 AND sources > 1 AND sinks > 1 AS matches FROM lens", _PATHS + _FACTS)
def is_bipartite(spark, sf_dir):
    return analytics.has_topology(analytics.topology(*_walked(spark, sf_dir)), "Bipartite")


@query("is_unique_path", "SELECT graph_id, longest <> 2 AND sources = 1 AND sinks = 1 AS matches FROM lens", _PATHS + _FACTS)
def is_unique_path(spark, sf_dir):
    return analytics.has_topology(analytics.topology(*_walked(spark, sf_dir)), "UniquePath")


@query("is_equi_path", f"SELECT graph_id, {_CLASS} = 'EquiPath' AS matches FROM lens l", _PATHS + _FACTS + _BUBBLES)
def is_equi_path(spark, sf_dir):
    return analytics.has_topology(analytics.topology(*_walked(spark, sf_dir)), "EquiPath")


@query("is_hetero_path", f"SELECT graph_id, {_CLASS} = 'HeteroPath' AS matches FROM lens l", _PATHS + _FACTS + _BUBBLES)
def is_hetero_path(spark, sf_dir):
    return analytics.has_topology(analytics.topology(*_walked(spark, sf_dir)), "HeteroPath")


@query("summary_core", """SELECT c.graph_id AS gid, (SELECT COUNT(*) FROM nodes n WHERE n.graph_id = c.graph_id) AS nodes, (SELECT COUNT(*) FROM edges e WHERE e.graph_id = c.graph_id) AS edges,
       (SELECT COUNT(*) FROM paths p WHERE p.graph_id = c.graph_id) AS paths, CAST(longest AS BIGINT) AS max_path_len, longest >= 2 AS super_path, is_cyclic, is_connected
       FROM lens c JOIN cyclic USING (graph_id) JOIN connected USING (graph_id)""", _PATHS + _FACTS + _CYCLE + _CONNECTED)
def summary_core(spark, sf_dir):
    """The summary without the class that bubbles decide."""
    return analytics.summary(graphs_of(spark, sf_dir, stored=True)).drop("topology")


_SUMMARY = f"""SELECT l.graph_id AS gid, (SELECT COUNT(*) FROM nodes n WHERE n.graph_id = l.graph_id) AS nodes, (SELECT COUNT(*) FROM edges e WHERE e.graph_id = l.graph_id) AS edges,
       (SELECT COUNT(*) FROM paths p WHERE p.graph_id = l.graph_id) AS paths, CAST(longest AS BIGINT) AS max_path_len, longest >= 2 AS super_path, is_cyclic, is_connected, {_CLASS} AS topology
       FROM lens l JOIN cyclic USING (graph_id) JOIN connected USING (graph_id)"""
_SUMMARY_BASE = _PATHS + _FACTS + _CYCLE + _CONNECTED + _BUBBLES


@query("summary", _SUMMARY, _SUMMARY_BASE)
def summary(spark, sf_dir):
    return analytics.summary(graphs_of(spark, sf_dir, stored=True))


@query("summary_lines", f"""SELECT 'gid,nodes,edges,paths,max_path_len,super_path,is_cyclic,is_connected,topology' AS line UNION ALL
       SELECT concat_ws(',', gid, nodes, edges, paths, max_path_len, super_path, is_cyclic, is_connected, topology) FROM ({_SUMMARY})""", _SUMMARY_BASE)
def summary_lines(spark, sf_dir):
    g = graphs_of(spark, sf_dir, stored=True)
    return exports.summary_lines(g, analytics.summary(g)).select("line")


# --- exports -------------------------------------------------------------------------------------------------------


@query("node_lines", "SELECT graph_id, 'N' || chr(9) || node_id || chr(9) || reference_id || ':' || strand || ':' || exons || chr(9) || array_to_string(read_texts, ',') || chr(9) || sequence AS line FROM nodes")
def node_lines(spark, sf_dir):
    return graphs_of(spark, sf_dir).nodes.select("graph_id", exports.node_line().alias("line"))


@query("edge_lines", "SELECT graph_id, 'E' || chr(9) || edge_id || chr(9) || source_id || chr(9) || sink_id || chr(9) || sv AS line FROM edges")
def edge_lines(spark, sf_dir):
    return graphs_of(spark, sf_dir).edges.select("graph_id", exports.edge_line().alias("line"))


@query("group_lines", "SELECT graph_id, 'P' || chr(9) || group_id || chr(9) || array_to_string(list_transform(elements, lambda x: x || '+'), ' ') AS line FROM user_paths")
def group_lines(spark, sf_dir):
    return graphs_of(spark, sf_dir).groups.select("graph_id", exports.group_line().alias("line"))


@query("attribute_lines", """SELECT graph_id, 'A' || chr(9) || 'N' || chr(9) || node_id || chr(9) || unnest(['ptc:i:' || n_reads, 'ptf:f:' || CAST(n_reads / 10.0 AS DOUBLE)]) AS line FROM nodes
       UNION ALL SELECT graph_id, 'A' || chr(9) || 'E' || chr(9) || edge_id || chr(9) || 'sr:i:' || sr FROM edges""")
def attribute_lines(spark, sf_dir):
    return exports.text_lines(graphs_of(spark, sf_dir, stored=True)).where(F.col("line").startswith("A\t")).select("graph_id", "line")


@query("link_lines", """SELECT 'L' || chr(9) || 'L_' || source_graph || '_' || source_element || '__' || target_graph || '_' || target_element || chr(9) || source_graph || ':' || source_element || chr(9)
       || target_graph || ':' || target_element || chr(9) || 'followup' AS line FROM links""")
def link_lines(spark, sf_dir):
    return graphs_of(spark, sf_dir).links.select(exports.link_line().alias("line"))


@query("text_lines", """SELECT line, CAST(COUNT(*) AS BIGINT) AS n FROM (
         SELECT '# Global header' AS line UNION ALL SELECT unnest(['H' || chr(9) || 'TSG' || chr(9) || '1.0', 'H' || chr(9) || 'reference' || chr(9) || 'events', 'H' || chr(9) || 'PG' || chr(9) || 'tsg'])
         UNION ALL SELECT unnest(['', '# Inter-graph links']) WHERE EXISTS (SELECT 1 FROM links)
         UNION ALL SELECT unnest(['', '# Graph: ' || graph_id, 'G' || chr(9) || graph_id, '# Nodes', '# Edges', '# Groups', '# Attributes']) FROM (SELECT DISTINCT graph_id FROM nodes)) GROUP BY line""")
def text_lines(spark, sf_dir):
    """The frame of the native text; element lines have queries of their own."""
    lines = exports.text_lines(graphs_of(spark, sf_dir, stored=True))
    return lines.where(~F.col("line").rlike("^[NEPAL]\t")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("header_dedup", "SELECT unnest(['TSG', 'reference']) AS tag, unnest(['1.0', 'events']) AS value")
def header_dedup(spark, sf_dir):
    """Two files with equal headers."""
    g = graphs_of(spark, sf_dir)
    return datasets.merge(g.with_tables(headers=g.headers.unionByName(g.headers.withColumn("file", F.lit(1))))).headers.select("tag", "value")


@query("header_lines", "SELECT unnest(['H' || chr(9) || 'TSG' || chr(9) || '1.0', 'H' || chr(9) || 'reference' || chr(9) || 'events']) AS line")
def header_lines(spark, sf_dir):
    return exports.header_lines(graphs_of(spark, sf_dir)).select("line")


_SHARED = "'transcript_id \"' || p.path_id || '\"; gene_id \"' || p.graph_id || '\"; '"


@query("gtf_lines", f"""SELECT p.graph_id, array_to_string(['.', 'tsg', 'transcript', '.', '.', '.', '.', '.', ''], chr(9)) || {_SHARED} AS line FROM paths p UNION ALL
       SELECT p.graph_id, array_to_string([n.reference_id, 'tsg', 'exon', CAST(v.exon_start AS VARCHAR), CAST(v.exon_end AS VARCHAR), '.', n.strand, '.', ''], chr(9)) || 'exon_id "' || lpad(CAST(v.i AS VARCHAR), 3, '0')
       || '"; ptc "' || n.n_reads || '"; ptf "' || CAST(n.n_reads / 10.0 AS DOUBLE) || '"; ' || {_SHARED}
       FROM (SELECT graph_id, path_id, path_ord, unnest(nodes) AS node_id FROM paths) p JOIN nodes n ON n.graph_id = p.graph_id AND n.node_id = p.node_id
       JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY graph_id, node_id ORDER BY exon_start) AS i FROM visits) v ON v.graph_id = n.graph_id AND v.node_id = n.node_id""", _PATHS)
def gtf_lines(spark, sf_dir):
    return exports.gtf_lines(*_walked(spark, sf_dir)).select("graph_id", "line")


@query("vcf_lines", """SELECT p.graph_id, array_to_string([e.ref1, CAST(e.bp1 AS VARCHAR), e.edge_id, '.', '<' || e.sv_type || '>', '.', '.', 'SVTYPE=' || e.sv_type || ';CHR2=' || e.ref2 || ';SVEND=' || e.bp2 || ';sr=' || e.sr
       || ';SEGMENT1=' || e.source_id || ';SEGMENT2=' || e.sink_id || ';STRAND1=' || e.strand1 || ';STRAND2=' || e.strand2 || ';SR_ID=' || array_to_string(e.shared, ',') || ';transcript_id=' || p.path_id || ';gene_id=' || p.graph_id || ';',
       'GT', '0/1'], chr(9)) AS line FROM (SELECT graph_id, path_id, unnest(edges) AS edge_id FROM paths) p JOIN edges e ON e.graph_id = p.graph_id AND e.edge_id = p.edge_id
       UNION ALL SELECT graph_id, '' FROM paths WHERE len(edges) = 0""", _PATHS)
def vcf_lines(spark, sf_dir):
    """The records; the header is fixed."""
    return exports.vcf_lines(*_walked(spark, sf_dir)).where("graph_id IS NOT NULL").select("graph_id", "line")


@query("fasta_records", """SELECT p.graph_id, p.path_id, STRING_AGG(n.sequence, '' ORDER BY p.i) AS sequence FROM (SELECT graph_id, path_id, path_ord, unnest(nodes) AS node_id, unnest(range(len(nodes))) AS i FROM paths) p
       JOIN nodes n ON n.graph_id = p.graph_id AND n.node_id = p.node_id GROUP BY p.graph_id, p.path_ord, p.path_id""", _PATHS)
def fasta_records(spark, sf_dir):
    return exports.path_sequences(*_walked(spark, sf_dir)).select("graph_id", "path_id", "sequence")


@query("fasta_lines", "SELECT graph_id, '>' || path_id AS line FROM paths", _PATHS)
def fasta_lines(spark, sf_dir):
    """The title lines; fasta_records has the sequences."""
    return exports.fasta_lines(*_walked(spark, sf_dir)).where(F.col("line").startswith(">")).select("graph_id", "line")


@query("dot_lines", """SELECT graph_id, line FROM (SELECT graph_id, unnest(['digraph {', '}']) AS line FROM (SELECT DISTINCT graph_id FROM nodes)
       UNION ALL SELECT graph_id, '    ' || (ord - 1) || ' [ label = "' || (ord - 1) || '" ]' FROM nodes
       UNION ALL SELECT e.graph_id, '    ' || (a.ord - 1) || ' -> ' || (z.ord - 1) || ' [ label = "' || (e.ord - 1) || '" ]' FROM edges e JOIN nodes a ON a.graph_id = e.graph_id AND a.node_id = e.source_id
       JOIN nodes z ON z.graph_id = e.graph_id AND z.node_id = e.sink_id)""")
def dot_lines(spark, sf_dir):
    return exports.dot_lines(graphs_of(spark, sf_dir)).select("graph_id", "line")


@query("json_nodes", """SELECT graph_id, node_id, '{"chrom":"' || reference_id || '","exons":"[' || exons || ']","id":"' || node_id || '","ptc":' || n_reads || ',"ptf":' || CAST(CAST(CAST(n_reads / 10.0 AS DOUBLE) AS FLOAT) AS DOUBLE)
       || ',"reads":["' || array_to_string(read_texts, '","') || '"],"ref_end":' || reference_end || ',"ref_start":' || reference_start || ',"strand":"' || strand || '"}' AS json FROM nodes""")
def json_nodes(spark, sf_dir):
    return exports.json_nodes(graphs_of(spark, sf_dir)).select("graph_id", "node_id", "json")


@query("json_edges", """SELECT graph_id, edge_id, '{"breakpoints":"' || sv || '","id":"' || edge_id || '","source":"' || source_id || '","target":"' || sink_id || '","weight":' || len(shared) || '}' AS json FROM edges""")
def json_edges(spark, sf_dir):
    return exports.json_edges(graphs_of(spark, sf_dir)).select("graph_id", "edge_id", "json")


@query("json_graphs", """SELECT g.graph_id, '{"directed":true,"elements":{"edges":[' || coalesce((SELECT STRING_AGG('{"data":{"breakpoints":"' || e.sv || '","id":"' || e.edge_id || '","source":"' || e.source_id
       || '","target":"' || e.sink_id || '","weight":' || len(e.shared) || '}}', ',' ORDER BY e.ord) FROM edges e WHERE e.graph_id = g.graph_id), '') || '],"nodes":['
       || (SELECT STRING_AGG('{"data":{"chrom":"' || reference_id || '","exons":"[' || exons || ']","id":"' || node_id || '","ptc":' || n_reads || ',"ptf":' || CAST(CAST(CAST(n_reads / 10.0 AS DOUBLE) AS FLOAT) AS DOUBLE)
       || ',"reads":["' || array_to_string(read_texts, '","') || '"],"ref_end":' || reference_end || ',"ref_start":' || reference_start || ',"strand":"' || strand || '"}}', ',' ORDER BY n.ord) FROM nodes n WHERE n.graph_id = g.graph_id)
       || ']},"multigraph":true}' AS line FROM (SELECT DISTINCT graph_id FROM nodes) g""")
def json_graphs(spark, sf_dir):
    return exports.json_lines(graphs_of(spark, sf_dir, stored=True)).select("graph_id", "line")


# --- collections ---------------------------------------------------------------------------------------------------

_IDS = ", ".join(f"('{i}')" for i in SELECTED)


@query("query_by_ids", f"SELECT graph_id, node_id FROM nodes WHERE graph_id IN (SELECT col0 FROM (VALUES {_IDS}))")
def query_by_ids(spark, sf_dir):
    return datasets.select_graphs(graphs_of(spark, sf_dir), SELECTED, check=False).nodes.select("graph_id", "node_id")


@query("links_for_ids", f"SELECT source_graph, source_element, target_graph, target_element FROM links l JOIN (VALUES {_IDS}) v(id) ON v.id = l.source_graph OR v.id = l.target_graph")
def links_for_ids(spark, sf_dir):
    return datasets.select_graphs(graphs_of(spark, sf_dir), SELECTED, check=False).links.select("source_graph", "source_element", "target_graph", "target_element")


@query("merge_rename", "SELECT graph_id, node_id FROM nodes UNION ALL SELECT graph_id || '_1', node_id FROM nodes")
def merge_rename(spark, sf_dir):
    """A collection merged with itself: each graph of the second file is renamed."""
    g = graphs_of(spark, sf_dir)
    both = g.map(lambda _, t: t.unionByName(t.withColumn("file", F.lit(1))))
    return datasets.merge(both).nodes.select("graph_id", "node_id")


@query("split_counts", """SELECT g.graph_id, CAST((SELECT COUNT(*) FROM nodes n WHERE n.graph_id = g.graph_id) AS BIGINT) AS nodes,
       CAST((SELECT COUNT(*) FROM links l WHERE l.source_graph = g.graph_id OR l.target_graph = g.graph_id) AS BIGINT) AS links FROM (SELECT DISTINCT graph_id FROM nodes) g""")
def split_counts(spark, sf_dir):
    g = graphs_of(spark, sf_dir)
    links = datasets.split_links(g).groupBy(F.col("for_graph").alias("graph_id")).agg(F.count(F.lit(1)).alias("links"))
    nodes = g.nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.join(links, "graph_id", "left").select("graph_id", "nodes", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


@query("validate_paths", """SELECT graph_id, group_id, e AS id FROM (SELECT graph_id, group_id, unnest(list_append(elements, 'missing')) AS e FROM user_paths) u
       WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.graph_id = u.graph_id AND n.node_id = u.e)""")
def validate_paths(spark, sf_dir):
    """Each path with one more element that no graph has."""
    g = graphs_of(spark, sf_dir)
    extra = F.array(F.struct(F.lit("missing").alias("id"), F.lit("+").alias("orientation")))
    g = g.with_tables(groups=g.groups.withColumn("elements", F.concat("elements", extra)))
    return validation.missing_path_elements(g).select("graph_id", "group_id", "id")


@query("chain_build", """SELECT graph_id, 'node' AS kind, node_id AS id, CAST(NULL AS VARCHAR) AS source_id, CAST(NULL AS VARCHAR) AS sink_id FROM (SELECT DISTINCT graph_id, unnest(elements) AS node_id FROM user_paths)
       UNION ALL SELECT graph_id, 'edge', edge_id, source_id, sink_id FROM edges""")
def chain_build(spark, sf_dir):
    """Graphs made from chains alone: written as text records, and built."""
    from .sources.build import tables

    g = _chains(graphs_of(spark, sf_dir))
    place = Window.partitionBy("graph_id").orderBy("ord")
    chains = g.groups.select("file", F.row_number().over(place).cast("bigint").alias("line_no"), "graph_id", F.lit("C").alias("kind"),
                             F.concat(F.array(F.lit("C"), F.col("group_id")), F.transform("elements", lambda x: x["id"])).alias("tokens"))
    heads = g.graphs.select("file", F.lit(0).cast("bigint").alias("line_no"), "graph_id", F.lit("G").alias("kind"), F.array(F.lit("G"), F.col("graph_id")).alias("tokens"))
    made, _ = tables(heads.unionByName(chains))
    none = F.lit(None).cast("string")
    return made.nodes.select("graph_id", F.lit("node").alias("kind"), F.col("node_id").alias("id"), none.alias("source_id"), none.alias("sink_id")).unionByName(
        made.edges.select("graph_id", F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), "source_id", "sink_id"))


from . import format_queries  # noqa: E402, F401 - it adds its queries to these
