"""A second, plain model of the engine, for small graphs: what the tests hold the results against."""

from __future__ import annotations

import hashlib
import itertools
import json
import struct
from dataclasses import dataclass, field

DEFAULT = "TSG_DEFAULT_GRAPH"


@dataclass
class Node:
    chrom: str = ""
    strand: str = "+"
    exons: list = field(default_factory=list)
    reads: list = field(default_factory=list)  # texts
    sequence: str = ""
    attributes: dict = field(default_factory=dict)

    @property
    def ids(self):
        return {r.split(":")[0] for r in self.reads}


@dataclass
class Graph:
    name: str
    nodes: dict = field(default_factory=dict)
    edges: dict = field(default_factory=dict)  # (source, sink) -> [id, sv fields, attributes]


def read(text):
    """The graphs of a text without upserts: nodes come before edges, edges before attributes."""
    graphs, now = {}, Graph(DEFAULT)
    for line in text.splitlines():
        t = line.split()
        if not t or t[0].startswith("#"):
            continue
        if t[0] == "G":
            now = Graph(t[1])
        graphs.setdefault(now.name, now)
        if t[0] == "N":
            chrom, strand, exons = t[2].split(":")
            now.nodes[t[1]] = Node(chrom, strand, [tuple(map(int, e.split("-"))) for e in exons.split(",")], t[3].split(","), t[4] if len(t) > 4 else "")
        elif t[0] == "E":
            now.edges[t[2], t[3]] = [t[1], t[4].split(","), {}]
        elif t[0] == "A" and t[1] in "NE":
            own = now.nodes[t[2]].attributes if t[1] == "N" else next(e[2] for e in now.edges.values() if e[0] == t[2])
            own |= {k: (kind, v) for k, kind, v in (a.split(":", 2) for a in t[3:])}
    return {k: g for k, g in graphs.items() if g.nodes}


def path_id(nodes):
    return "TSP" + "".join(f"{b:03d}" for b in hashlib.sha256("-".join(nodes).encode()).digest())[:10]


def paths(g):
    """(nodes, edge ids) of the walks from a source to a sink whose nodes share a read, in the engine's order."""
    into, out = {b for _, b in g.edges}, {a for a, _ in g.edges}
    place = {k: i for i, k in enumerate(g.edges)}
    found = []
    for i, s in enumerate(g.nodes):
        todo = [[s]] if s not in into else []
        while todo:
            walk = todo.pop()
            if not set.intersection(*(g.nodes[n].ids for n in walk)):
                continue
            if walk[-1] not in out:
                found.append((i, len(walk), [-place[e] for e in itertools.pairwise(walk)], walk))
            todo += [[*walk, b] for a, b in g.edges if a == walk[-1]]
    return [(w, [g.edges[e][0] for e in itertools.pairwise(w)]) for *_, w in sorted(found)]


def gtf(g):
    for nodes, _ in paths(g):
        tail = f'transcript_id "{path_id(nodes)}"; gene_id "{g.name}"; '
        yield "\t".join([".", "tsg", "transcript", *"....."]) + "\t" + tail
        for n in (g.nodes[x] for x in nodes):
            own = "".join(f'{k} "{v}"; ' for k, (_, v) in sorted(n.attributes.items()))
            for i, (a, b) in enumerate(n.exons, 1):
                yield f'{n.chrom}\ttsg\texon\t{a}\t{b}\t.\t{n.strand}\t.\texon_id "{i:03d}"; {own}{tail}'


def vcf(g):
    """The records, without the header."""
    for nodes, _ in paths(g):
        for a, b in itertools.pairwise(nodes):
            name, (ref1, ref2, bp1, bp2, kind), own = g.edges[a, b]
            info = {"SVTYPE": kind, "CHR2": ref2, "SVEND": bp2, **{k: v for k, (_, v) in sorted(own.items())}, "SEGMENT1": a, "SEGMENT2": b, "STRAND1": g.nodes[a].strand,
                    "STRAND2": g.nodes[b].strand, "SR_ID": ",".join(sorted(g.nodes[a].ids & g.nodes[b].ids)), "transcript_id": path_id(nodes), "gene_id": g.name}
            yield "\t".join([ref1, bp1, name, ".", f"<{kind}>", ".", ".", "".join(f"{k}={v};" for k, v in info.items()), "GT", "0/1"])


def fasta(g):
    for nodes, _ in paths(g):
        yield from (">" + path_id(nodes), "".join(g.nodes[n].sequence for n in nodes))


def document(g):
    """The JSON of a graph, as Python objects."""
    single = lambda v: struct.unpack("f", struct.pack("f", float(v)))[0]
    nodes = []
    for name, n in g.nodes.items():
        own = {k: int(v) if kind == "i" else single(v) if kind == "f" else v for k, (kind, v) in n.attributes.items()}
        nodes.append({"chrom": n.chrom, "ref_start": n.exons[0][0], "ref_end": n.exons[-1][1], "strand": n.strand, "exons": "[" + ",".join(f"{a}-{b}" for a, b in n.exons) + "]",
                      "reads": n.reads, "id": name} | own)
    edges = [{"id": e[0], "source": a, "target": b, "weight": len(g.nodes[a].ids & g.nodes[b].ids), "breakpoints": ",".join(e[1])} for (a, b), e in g.edges.items()]
    return json.loads(json.dumps({"directed": True, "multigraph": True, "elements": {"nodes": [{"data": x} for x in nodes], "edges": [{"data": x} for x in edges]}}))


def reach(edges, start):
    seen = {start}
    while more := {b for a, b in edges if a in seen} - seen:
        seen |= more
    return seen


def connected(nodes, edges):
    return not nodes or reach([*edges, *((b, a) for a, b in edges)], next(iter(nodes))) == set(nodes)


def cyclic(edges):
    return any(a in reach(edges, b) for a, b in edges)


def shortest(successors, start):
    """Of every node reached: the shortest walk to it, of equal ones that by the earlier successors; in order of both."""
    best = {start: ((), (start,))}
    level = [((), (start,))]
    while level:
        longer = sorted(((*key, i), (*walk, n)) for key, walk in level for i, n in enumerate(successors.get(walk[-1], ())))
        level = []
        for key, walk in longer:
            if walk[-1] not in best:
                best[walk[-1]] = key, walk
                level.append((key, walk))
    return [walk for _, walk in sorted(best.values(), key=lambda x: (len(x[0]), x[0]))]


def bubbles(successors, rounds=100):
    """The pairs of :mod:`readloom.operators.bubbles`, as a sorted list of (path, path)."""
    out = []
    for s, forks in successors.items():
        for a, b in itertools.combinations(forks, 2):
            walks = [shortest(successors, n) for n in (a, b)]
            order = [[w[-1] for w in ws] for ws in walks]
            # how many nodes a search has taken when it comes to know a node
            known = [{w[-1]: o.index(w[-2]) + 1 if len(w) > 1 else 0 for w in ws} for ws, o in zip(walks, order, strict=True)]
            for r in range(rounds):
                first = r < len(order[0]) and known[1].get(order[0][r], r + 1) <= r
                then = r < len(order[1]) and known[0].get(order[1][r], r + 2) <= r + (not first)
                met = {order[0][r]} if first else set()
                met |= {order[1][r]} if then else set()
                for n in met:
                    p, q = ((s, *next(w for w in ws if w[-1] == n)) for ws in walks)
                    if min(len(p), len(q)) > 2 and p != q:
                        out.append((p, q))
                if met:
                    break
        for t in forks if len(forks) > 1 else ():
            others = [n for n in forks if n not in (s, t)]
            inner = {k: [x for x in v if x not in forks and x != s] for k, v in successors.items()}
            order = [w[-1] for w in shortest(inner | {None: others}, None)[1:]]
            ways = [[n] for n in others]
            while ways:
                w = ways.pop()
                if t in successors.get(w[-1], ()):
                    out.append(((s, t), (s, *w, t)))
                ways += [[*w, x] for x in inner.get(w[-1], ()) if order.index(x) > order.index(w[-1])]
    return sorted(out)
