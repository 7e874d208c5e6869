import pytest
from pyspark.sql import functions as F

from readloom.functions import text as T
from readloom.operators import lookups, validation
from readloom.sources.build import InvalidGraphs, load, loads, tables
from readloom.sources.text import numbered, read_records

from .graphs import RIVER, TWO_GRAPHS


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_river(spark):
    g = loads(spark, RIVER)
    assert rows(g.headers, "tag", "value") == [("TSG", "1.0"), ("origin", "invented")]
    assert [r[0] for r in g.nodes.orderBy("ord").select("node_id").collect()] == ["spring", "ford", "weir", "delta", "marsh"]
    assert g.edges.count() == 5 and rows(g.graphs, "graph_id") == [("TSG_DEFAULT_GRAPH",)]
    ford = g.nodes.where("node_id = 'ford'").first()
    assert [(e.start, e.end) for e in ford.exons] == [(400, 480), (520, 560)] and ford.sequence == "CCGGT"
    assert {k: tuple(v) for k, v in ford.attributes.items()} == {"depth": ("f", "3.25"), "rank": ("i", "7")}
    assert tuple(g.edges.where("edge_id = 'leak'").first().attributes["why"]) == ("Z", "x:y:z")
    walk = g.groups.where("group_id = 'walk'").first()
    assert [(e.id, e.orientation) for e in walk.elements][3:] == [("leak", "+"), ("marsh", "-")] and tuple(walk.attributes["score"]) == ("f", "0.5")


def test_sections_and_links(spark):
    g = loads(spark, TWO_GRAPHS)
    assert rows(g.nodes.groupBy("graph_id").count(), "graph_id", "count") == [("g1", 2), ("g2", 3)]
    link = g.links.first()
    assert (link.source_graph, link.source_element, link.target_graph, link.target_element, link.link_type) == ("g1", "a", "g2", "b", "same")
    assert rows(lookups.edge(g, "g2", "y"), "source_id", "sink_id") == [("a", "c")]
    assert rows(lookups.node_by_index(g, "g2", 1), "node_id") == [("b",)]


def test_last_wins_upserts(spark):
    g = loads(spark, """N a c:+:1-2 r:SO
A N a k:i:1
E e1 a b c,c,1,2,x
E e2 a b c,c,3,4,y
A E e1 seen:i:7
N a c:-:5-6 s:SI
A N a z:i:2
A N a z:i:3
""")
    a = g.nodes.where("node_id = 'a'").first()
    assert (a.strand, a.ord, {k: v.value for k, v in a.attributes.items()}) == ("-", 2, {"z": "3"})
    b = g.nodes.where("node_id = 'b'").first()
    assert b.is_placeholder and b.exons == [] and b.strand == "+"
    e = g.edges.first()
    assert g.edges.count() == 1 and (e.edge_id, e.sv.breakpoint1, e.ord) == ("e2", 3, 3) and e.attributes["seen"].value == "7"
    assert rows(g.edge_aliases, "edge_id") == [("e1",), ("e2",)]
    assert lookups.edge(g, "TSG_DEFAULT_GRAPH", "e1").first().edge_id == "e2"


def test_chain_builds_structure_only_without_nodes_or_edges(spark):
    g = loads(spark, "G g\nC c1 a e1 b e2 c\nC c2 a e1 b e3 d\n")
    assert rows(g.nodes, "node_id") == [("a",), ("b",), ("c",), ("d",)]
    assert rows(g.edges, "edge_id", "source_id", "sink_id") == [("e1", "a", "b"), ("e2", "b", "c"), ("e3", "b", "d")]
    assert T.sv_text(F.lit(1)) is not None and g.edges.select(T.sv_text(F.col("sv")).alias("x")).first().x == ",,0,0,"
    assert rows(lookups.chain_nodes(g), "group_id") == [("c1",), ("c2",)] and lookups.chain_edges(g).where("group_id = 'c2'").first().ids == ["e1", "e3"]
    built = loads(spark, "N a c:+:1-2 r:SO\nN b c:+:1-2 r:SO\nE e a b c,c,1,2,x\nC ch a e b f q\n")
    assert rows(built.nodes, "node_id") == [("a",), ("b",)]


MALFORMED = [
    "H onlytag", "G", "G g\nG g", "N a c:+:1-2", "N a c:+ r:SO", "N a c:*:1-2 r:SO", "N a c:+:1-x r:SO", "N a c:+:1-2 r:XX", "E e a b c,c,1,2", "E e a b c,c,-1,2,x",
    "U u", "C c a e", "P p a\nU p b", "N a c:+:1-2 r:SO\nA N a k:q:1", "A N a k:i:1", "A E e k:i:1\nE e a b c,c,1,2,x", "G g\nL l g:a h:b t", "G g\nL l ga h:b t",
    "E e id with blanks a b c,c,1,2,x",
]


def test_malformed_texts(spark):
    """Each text is a file of its own; every one has errors, and the tables of the rest are still made."""
    lines = [(i, "", 0, n, line) for i, text in enumerate(MALFORMED) for n, line in enumerate(text.split("\n"))]
    df = spark.createDataFrame(lines, "file int, path string, at long, row long, value string")
    made, errors = tables(numbered(df.select("file", F.struct("path", "at").alias("block"), "row", "value")))
    assert {r.file for r in errors.select("file").distinct().collect()} == set(range(len(MALFORMED)))
    assert rows(made.nodes.where("not is_placeholder"), "file", "node_id") == [(13, "a")]


def test_failfast_and_permissive(spark):
    with pytest.raises(InvalidGraphs, match="colon|reads"):
        loads(spark, "N a c:+:1-2 r:XX")
    with pytest.raises(InvalidGraphs, match="missing element zz"):
        loads(spark, "N a c:+:1-2 r:SO\nP p a+ zz+")
    assert loads(spark, "N a c:+:1-2 r:SO\nN b c:+:1-2 r:XX", mode="PERMISSIVE").nodes.count() == 1


def test_default_graph_can_be_declared_and_links_permissive(spark):
    assert loads(spark, "G TSG_DEFAULT_GRAPH\nN a c:+:1-2 r:SO\n").graphs.count() == 1
    g = loads(spark, "G g\nN a c:+:1-2 r:SO\nL l g:a other:b t\n", links="permissive")
    assert validation.missing_link_elements(g).count() == 1


def test_files_and_small_splits(spark, tmp_path):
    """Line numbers and sections are the same however a file is split."""
    path = tmp_path / "x.tsg"
    path.write_text("".join(f"G g{i}\n" + "".join(f"N n{j} c:+:{j + 1}-{j + 9} r:SO\n" for j in range(40)) for i in range(60)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 3
        got = read_records(spark, str(path)).where("kind = 'N'").select("line_no", "graph_id").orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.line_no, r.graph_id) for r in got] == [(41 * i + j + 2, f"g{i}") for i in range(60) for j in range(40)]
    assert load(spark, str(path)).nodes.count() == 2400


def test_field_parsers(spark):
    df = spark.createDataFrame([("1-2", "a:b:c"), ("1-2-3", "t:i:9"), ("x", "t:Zebra:v:w")], "i string, a string")
    got = df.select(T.interval(F.col("i")).alias("i"), T.attribute(F.col("a")).alias("a"), T.oriented(F.lit("n1-")).alias("o"), T.oriented(F.lit("n1")).alias("p")).collect()
    assert [r.i for r in got] == [(1, 2), None, None]
    assert [r.a for r in got] == [None, ("t", "i", "9"), ("t", "Z", "v:w")]
    assert got[0].o == ("n1", "-") and got[0].p == ("n1", None)
    m = F.create_map(F.lit("k"), F.struct(F.lit("i").alias("type"), F.lit("x").alias("value")))
    assert spark.range(1).select(T.as_int(m, "k").alias("v")).first().v is None
    with pytest.raises(Exception, match="no integer"):
        spark.range(1).select(T.typed(m, "k", strict=True).alias("v")).collect()


def test_read_without_tables(spark, tmp_path, monkeypatch):
    """A caller that wants the errors alone doesn't have all tables written."""
    from readloom.sources import build

    (tmp_path / "a.tsg").write_text("G g\nN a c:+:1-2 r:SO\nA N a k:i:1 n::2\nA N a k:ix:1\nA N b k:i:1\nA X a k:i:1\nA N a k:q:1\nA N a k:i\nU u\n")
    written, real = [], build.materialise
    monkeypatch.setattr(build, "materialise", lambda t, name, **o: written.append(name) or real(t, name, **o))
    g, errors = build.read(spark, str(tmp_path / "a.tsg"), stored=False)
    said = sorted((r.line_no, r.kind, r.record, r.message) for r in errors.collect())
    assert said == [(i, k, x, m) for i, k, x, m in [
        (3, "A", "A N a k:i:1 n::2", "a malformed attribute line"), (5, "A", "A N b k:i:1", "the attribute's element is not defined before it"), (6, "A", "A X a k:i:1", "a malformed attribute line"),
        (7, "A", "A N a k:q:1", "a malformed attribute line"), (8, "A", "A N a k:i", "a malformed attribute line"), (9, "U", "U u", "a group needs an id and elements")]]
    assert written == ["records", "errors"]
    assert [(r.node_id, r.attributes["k"].value) for r in g.nodes.collect()] == [("a", "1")]
    stored, again = build.read(spark, str(tmp_path / "a.tsg"))
    assert again.count() == 6 and [tuple(r) for r in stored.nodes.collect()] == [tuple(r) for r in g.nodes.collect()] and "nodes" in written


def test_load_finds_errors_first(spark, tmp_path, monkeypatch):
    """A text with malformed records ends the loading before a table is written; records have files by their kind."""
    from readloom.sources import build

    written, real = [], build.materialise
    monkeypatch.setattr(build, "materialise", lambda t, name, **o: written.append((name, o)) or real(t, name, **o))
    (tmp_path / "a.tsg").write_text("G g\nN a c:+:1-2 r:SO\nU u\n")
    with pytest.raises(InvalidGraphs, match="a group needs an id and elements"):
        load(spark, str(tmp_path / "a.tsg"))
    assert written == [("records", {"by": ("kind",)}), ("errors", {})]
