import itertools
import random

import pytest
from pyspark.sql import functions as F

from readloom.functions import identifiers, intervals
from readloom.operators import analytics, traversal
from readloom.sources.build import loads

from . import model
from .graphs import DIAMOND, RIVER, TWO_GRAPHS


def paths_of(g):
    return [(r.graph_id, r.path_id, r.nodes, r.edges) for r in traversal.traverse(g).orderBy("graph_id", "path_ord").collect()]


@pytest.mark.parametrize("source", [RIVER, DIAMOND, TWO_GRAPHS])
def test_paths_and_ids(spark, source):
    want = model.read(source)
    assert paths_of(loads(spark, source)) == [(k, model.path_id(n), n, e) for k in want for n, e in model.paths(want[k])]


def test_order_of_paths(spark):
    assert [p[3] for p in paths_of(loads(spark, RIVER))] == [["race", "lock"], ["bend", "leak"], ["bend", "mouth"]]
    assert [len(p[2]) for p in paths_of(loads(spark, DIAMOND))] == [3, 3, 4]


@pytest.mark.parametrize(("text", "n"), [
    ("N a c:+:1-2 r:SO\n", 1),  # one node
    ("N a c:+:1-2 r:SO\nN b c:+:1-2 q:SI\nE e a b c,c,1,2,x\n", 0),  # nothing shared
    ("N a c:+:1-2 r:SO\nN b c:+:1-2 r:IN,q:IN\nN c c:+:1-2 q:SI\nE e a b c,c,1,2,x\nE f b c c,c,1,2,x\n", 0),  # lost half way
    ("N a c:+:1-2 r:SO\nN b c:+:1-2 r:SI\nE e a b c,c,1,2,x\nE f a b c,c,1,2,x\n", 1),  # parallel edges
])
def test_small_cases(spark, text, n):
    g = loads(spark, text)
    assert traversal.traverse(g).count() == n == traversal.read_first_paths(g).count()


def test_supported_cycle(spark):
    g = loads(spark, "N a c:+:1-2 r:SO\nN b c:+:1-2 r:IN\nN c c:+:1-2 r:IN\nE e a b c,c,1,2,x\nE f b c c,c,1,2,x\nE g c b c,c,1,2,x\n")
    with pytest.raises(traversal.SupportedCycle):
        traversal.traverse(g)
    assert traversal.traverse(g, max_depth=5).count() == 0
    assert analytics.is_cyclic(g).first().is_cyclic and analytics.is_connected(g).first().is_connected


def test_bubbles_and_topology(spark):
    g = loads(spark, DIAMOND)
    got = {frozenset((tuple(r.path1), tuple(r.path2))) for r in analytics.bubbles(g).collect()}
    pair = lambda a, b: frozenset(tuple(x.split()) for x in (a, b))
    assert got == {pair("north east south", "north west south"), pair("north east", "north west east"), pair("west south", "west east south")}
    assert tuple(analytics.summary(g).first()) == ("TSG_DEFAULT_GRAPH", 4, 5, 3, 4, True, False, True, "UniquePath")
    g = loads(spark, TWO_GRAPHS)
    kinds = {r.graph_id: r.topology for r in analytics.topology(g, traversal.traverse(g)).collect()}
    assert kinds == {"g1": "NotDefined", "g2": "FadeOut"}


def random_graphs(seed, n, most, share, loops=True):
    rng = random.Random(seed)
    for k in range(n):
        names = [f"n{i}" for i in range(rng.randint(1, most))]
        edges = [e for e in itertools.product(names, names) if rng.random() < share and (loops or e[0] != e[1])]
        rng.shuffle(edges)
        yield f"g{k}", names, edges


def written(graphs):
    return "".join(f"G {k}\n" + "".join(f"N {n} c:+:1-2 r:IN\n" for n in names) + "".join(f"E e{i} {a} {b} c,c,1,2,x\n" for i, (a, b) in enumerate(edges)) for k, names, edges in graphs)


@pytest.mark.parametrize("rounds", [100, 2, None])
def test_bubbles_of_random_graphs_against_a_model(spark, rounds):
    graphs = [*random_graphs(11, 40, 7, 0.3), *((f"x{k}", *r) for k, *r in random_graphs(12, 10, 12, 0.15))]
    want = {}
    for k, names, edges in graphs:
        out = {n: [b for a, b in reversed(edges) if a == n] for n in names}
        if found := model.bubbles({n: v for n, v in out.items() if v}, rounds or 10**6):
            want[k] = found
    got = {}
    for r in analytics.bubbles(loads(spark, written(graphs)), rounds=rounds).collect():
        got.setdefault(r.graph_id, []).append((tuple(r.path1), tuple(r.path2)))
    assert {k: sorted(v) for k, v in got.items()} == want and sum(map(len, want.values())) > 150


@pytest.mark.parametrize("small", [1_000, 0])
def test_shapes_of_random_graphs(spark, small):
    """Settled whole, and by rounds of joins, as graphs of any size are."""
    ring = [f"m{i}" for i in range(40)]
    graphs = [*random_graphs(5, 40, 9, 0.12), ("chain", ring, list(itertools.pairwise(ring))), ("ring", ring, [*itertools.pairwise(ring), (ring[-1], ring[0])]), ("loop", ["a"], [("a", "a")]), ("none", ["a", "b"], [])]
    got = {r.graph_id: (r.is_connected, r.is_cyclic) for r in analytics.shapes(loads(spark, written(graphs)), small).collect()}
    assert got == {k: (model.connected(n, e), model.cyclic(e)) for k, n, e in graphs}


def test_many_graphs_in_small_tables(spark, monkeypatch):
    """Graphs stay whole where a task's rows are solved in several tables."""
    from readloom.operators import wholes

    monkeypatch.setattr(wholes, "GATHER", 7)
    edges = [(f"g{k:02d}", f"n{i}", f"n{i + 1}") for k in range(30) for i in range(k % 9)]
    df = spark.createDataFrame(edges, "graph_id string, source_id string, sink_id string").repartition(5)

    def count(t):
        import pyarrow as pa

        yield pa.RecordBatch.from_pylist([{"graph_id": k, "n": t.column("graph_id").to_pylist().count(k)} for k in sorted(set(t.column("graph_id").to_pylist()))], schema=pa.schema([("graph_id", pa.string()), ("n", pa.int64())]))

    assert {r.graph_id: r.n for r in wholes.solve(df, count, "graph_id string, n long").collect()} == {f"g{k:02d}": k % 9 for k in range(30) if k % 9}
    assert len(wholes.solve(df, count, "graph_id string, n long").collect()) == len({e[0] for e in edges})


def test_equi_and_hetero(spark):
    node = lambda n: f"N {n} c:+:1-2 r:IN\n"
    edge = lambda a, b: f"E {a}{b} {a} {b} c,c,1,2,x\n"
    base = "".join(map(node, "zsabte"))
    equi = base + "".join(edge(a, b) for a, b in ("zs", "es", "sa", "sb", "at", "bt"))
    hetero = equi + edge("s", "t")
    for text, kind in ((equi, "EquiPath"), (hetero, "HeteroPath")):
        g = loads(spark, text)
        assert analytics.topology(g, traversal.traverse(g)).first().topology == kind


def model_paths(nodes, edges):
    """All source-to-sink walks whose nodes share a read."""
    out, into = {}, {b for _, b in edges}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    found = set()

    def walk(path, reads):
        if not reads:
            return
        if path[-1] not in out:
            found.add(tuple(path))
        for b in out.get(path[-1], ()):
            walk([*path, b], reads & nodes[b])

    for n, reads in nodes.items():
        if n not in into:
            walk([n], reads)
    return found


def test_random_dags_against_a_model(spark):
    rng = random.Random(7)
    text, want, connected = [], {}, {}
    for k in range(25):
        names = [f"n{i}" for i in range(rng.randint(1, 8))]
        nodes = {n: {f"r{r}" for r in rng.sample(range(4), rng.randint(1, 4))} for n in names}
        edges = [e for e in itertools.combinations(names, 2) if rng.random() < 0.4]
        text.append(f"G g{k}\n" + "".join(f"N {n} c:+:1-2 {','.join(f'{r}:IN' for r in sorted(rs))}\n" for n, rs in nodes.items())
                    + "".join(f"E e{a}{b} {a} {b} c,c,1,2,x\n" for a, b in edges))
        want[f"g{k}"] = model_paths(nodes, edges)
        seen, todo = set(), [names[0]]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [b for a, b in edges if a == n] + [a for a, b in edges if b == n]
        connected[f"g{k}"] = len(seen) == len(names)
    g = loads(spark, "".join(text))
    got = {k: set() for k in want}
    for r in traversal.traverse(g).collect():
        got[r.graph_id].add(tuple(r.nodes))
    assert got == want
    first = {k: set() for k in want}
    for r in traversal.read_first_paths(g).collect():
        first[r.graph_id].add(tuple(r.nodes))
    assert first == want
    assert {r.graph_id: r.is_connected for r in analytics.is_connected(g).collect()} == connected
    assert not analytics.is_cyclic(g).where("is_cyclic").count()


def test_identifiers_and_intervals(spark):
    one = spark.createDataFrame([("Hello World!",)], "s string")
    r = one.select(identifiers.hash_identifier(F.col("s"), 16).alias("h"), identifiers.hash_identifier(F.col("s")).alias("l"), identifiers.numeric_identifier(F.col("s")).alias("n")).first()
    assert r.h == "af83b1657ff1fc53" and len(r.l) == 64 and len(r.n) == 64
    with pytest.raises(ValueError):
        identifiers.hash_identifier(F.col("s"), 0)
    e = F.from_json(F.lit('[{"start":10,"end":20},{"start":30,"end":45}]'), "array<struct<start:bigint,end:bigint>>")
    r = spark.range(1).select(intervals.span(e).alias("s"), intervals.introns(e).alias("i"), intervals.introns(F.slice(e, 1, 1)).alias("none")).first()
    assert r.s == 25 and [tuple(x) for x in r.i] == [(21, 30)] and r.none == []
