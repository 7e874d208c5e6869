import itertools
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from readloom import cli, cli_help
from readloom.operators import datasets, traversal
from readloom.plans import exports
from readloom.sources.build import load, loads
from readloom.sources.fasta import annotate, read_fasta

from . import model
from .graphs import DIAMOND, RIVER, TWO_GRAPHS


def text(lines):
    return [r.line for r in lines.orderBy(*exports.ORDER).collect()]


@pytest.mark.parametrize("source", [RIVER, DIAMOND, TWO_GRAPHS])
def test_path_exports(spark, source):
    g = loads(spark, source)
    want = model.read(source)
    p = traversal.traverse(g)
    each = lambda f: [x for k in want for x in f(want[k])]
    assert text(exports.gtf_lines(g, p)) == each(model.gtf)
    head = exports.vcf_header()
    assert len(head) == 36 and text(exports.vcf_lines(g, p)) == [*head, *each(model.vcf)]
    assert text(exports.fasta_lines(g, p)) == each(model.fasta)
    steps = [(model.path_id(n), [f"{x}+" for pair in itertools.zip_longest(n, e) for x in pair if x]) for k in want for n, e in model.paths(want[k])]
    assert text(exports.path_lines(g, p)) == ["\t".join(["P", i, *s]) for i, s in steps]
    assert text(exports.path_lines(g, p, text=False)) == [i for i, _ in steps]
    plain = [json.loads(x) for x in text(exports.json_lines(g))]
    assert plain == [model.document(want[k]) for k in want]


def test_dot(spark):
    got = text(exports.dot_lines(loads(spark, DIAMOND)))
    assert got[:2] == ["digraph {", '    0 [ label = "0" ]'] and '    2 -> 3 [ label = "4" ]' in got and len(got) == 2 + 4 + 5
    assert '    2 -> 3 [ label = "es" ]' in text(exports.dot_lines(loads(spark, DIAMOND), edge_index=False))


def test_json_of_odd_nodes(spark):
    odd = loads(spark, 'N a c:+:1-2 r:SO\nA N a id:Z:quo"te\nN b c:+:1-2 r:SO\nA N b k:i:x\nE e p q c,c,1,2,t\n')
    nodes = json.loads(text(exports.json_lines(odd))[0])["elements"]["nodes"]
    assert [n["data"]["id"] for n in nodes] == ['quo"te', "p", "q"] and nodes[1]["data"]["ref_start"] is None
    far = loads(spark, "N a c:+:1-2 r:SO\nA N a big:f:1e999 low:f:-inf no:f:NaN x:f:0.1 y:f:1e20\n")
    data = json.loads(text(exports.json_lines(far))[0], parse_constant=pytest.fail)["elements"]["nodes"][0]["data"]
    assert [data[k] for k in ("big", "low", "no")] == [None] * 3 and abs(data["x"] - 0.1) < 1e-7 and abs(data["y"] / 1e20 - 1) < 1e-6


def test_round_trip(spark):
    for source in (TWO_GRAPHS, DIAMOND):
        g = loads(spark, source)
        lines = text(exports.text_lines(g))
        again = loads(spark, "\n".join(lines))
        assert text(exports.text_lines(again)) == [*lines[: lines.index("H\tPG\ttsg") + 1], "H\tPG\ttsg", *lines[lines.index("H\tPG\ttsg") + 1 :]]


def test_select_merge_split(spark, tmp_path):
    g = loads(spark, TWO_GRAPHS)
    one = datasets.select_graphs(g, ["g1"])
    assert one.nodes.count() == 2 and one.links.count() == 1
    assert datasets.select_graphs(g, ["g1", "g2"]).links.count() == 2
    a, b = tmp_path / "a.tsg", tmp_path / "b.tsg"
    a.write_text(TWO_GRAPHS)
    b.write_text(TWO_GRAPHS.replace("G g2", "G other").replace("g2:b", "other:b") + "H TSG 1.0\nH TSG 2.0\n")
    m = datasets.merge(load(spark, [str(a), str(b)]))
    assert sorted(r[0] for r in m.graphs.select("graph_id").collect()) == ["g1", "g1_1", "g2", "other"]
    assert sorted(tuple(r) for r in m.headers.select("tag", "value").collect()) == [("TSG", "1.0"), ("TSG", "2.0")]
    assert m.links.count() == 2 and m.nodes.count() == 10
    default = tmp_path / "c.tsg"
    default.write_text(DIAMOND)
    assert datasets.merge(load(spark, [str(default)])).graphs.first().graph_id == "TSG_DEFAULT_GRAPH_0"


def test_split_repeats_every_header(spark, monkeypatch):
    """However many chunks the headers take, and however those are joined, each graph's file has them all, in order."""
    g = loads(spark, "".join(f"H K{i} v\n" for i in range(23)) + TWO_GRAPHS)
    want = text(exports.split_lines(g).where("graph_id = 'g1'"))
    assert [x.split("\t")[1] for x in want if x.startswith("H")] == [*(f"K{i}" for i in range(23)), "TSG", "PG"]
    monkeypatch.setattr(exports, "HEADERS_AT_ONCE", 3)
    for broadcast in (100, 1):
        monkeypatch.setattr(exports, "HEADER_CHUNKS", broadcast)
        assert text(exports.split_lines(g).where("graph_id = 'g1'")) == want
        assert exports.split_lines(g).where("line LIKE 'H%'").count() == 2 * 25


def test_help(capsys):
    names = {name for name, _, _ in cli_help.commands(cli.parser())}
    assert {"summary", "query", "split", "completions"} <= names
    for shell in cli_help.SHELLS:
        assert cli.main(["completions", shell]) == 0
        out = capsys.readouterr().out
        assert all(name in out for name in names) and "ids-file" in out

    def complete(words, at):
        script = cli_help.bash(cli.parser()) + f'COMP_WORDS=(readloom {words}); COMP_CWORD={at}; _readloom; echo "${{COMPREPLY[@]}}"'
        return subprocess.run(["bash", "--norc", "-c", script], capture_output=True, text=True, check=True, cwd="/").stdout.split()

    assert complete("s", 1) == ["summary", "split"] and "--ids-file" in complete("query --ids", 2)
    assert cli.main(["markdown-help"]) == 0
    page = capsys.readouterr().out
    assert all(f"## `readloom {name}`" in page for name in names) and "`--text-path`" in page


def test_cli(spark, tmp_path, capsys):
    a = tmp_path / "a.tsg"
    a.write_text(TWO_GRAPHS)
    run = lambda *args: (cli.main(list(args), spark), capsys.readouterr().out)[1].splitlines()
    assert run("header", str(a)) == ["H\tTSG\t1.0"]
    assert run("summary", str(a))[1:] == ["g1,2,1,1,2,true,false,true,NotDefined", "g2,3,2,2,2,true,false,true,FadeOut"]
    assert len(run("traverse", str(a))) == 3 and run("traverse", "-t", str(a))[0].endswith("\ta+\tx+\tb+")
    assert run("fa", str(a))[1] == "ACGT"
    run("dot", str(a))
    run("json", "-p", str(a))
    run("split", str(a))
    assert sorted(p.name for p in (tmp_path / "a_dot").iterdir()) == ["g1.dot", "g2.dot"]
    assert json.loads((tmp_path / "a_json" / "g1.json").read_text())["directed"]
    part = (tmp_path / "a_split" / "g1.tsg").read_text()
    assert load(spark, str(tmp_path / "a_split" / "g1.tsg"), links="permissive").nodes.count() == 2 and "# Inter-graph links" in part
    out = tmp_path / "q.tsg"
    run("query", str(a), "-i", "g2", "-o", str(out))
    assert load(spark, str(out), links="permissive").nodes.count() == 3
    run("merge", str(a), str(a), "-o", str(out))
    assert load(spark, str(out)).graphs.count() == 4
    assert len(run("gtf", str(a))) == 3 + 6 and len(run("vcf", str(a))) == 36 + 3


def test_fasta_annotation(spark, tmp_path):
    f = tmp_path / "ref.fa"
    bases = "".join("ACGT"[(i * 7 + i // 5) % 4] for i in range(25_000))
    f.write_text(">c1 about\n" + "\n".join(bases[i : i + 61] for i in range(0, len(bases), 61)) + "\n>c2\n" + "\n".join(bases[::-1][i : i + 50] for i in range(0, 20_000, 50)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        g = annotate(loads(spark, "N a c1:+:10-20,9990-20100 r:SO\nN b c2:+:100-140 r:SO\nN d c9:+:5-6 r:SO AC\n"), read_fasta(spark, str(f)))
        got = {r.node_id: r.sequence for r in g.nodes.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {"a": bases[8:20100], "b": bases[::-1][98:140], "d": "AC"}


def test_fasta_in_part_files(spark, tmp_path):
    """A sequence goes on from one part file to the next, and through one without a title."""
    bases = "".join("ACGT"[(i * 7 + i // 5) % 4] for i in range(3_000))
    lines = [">c1 about", *(bases[i : i + 60] for i in range(0, 3_000, 60)), ">c2", *(bases[::-1][i : i + 60] for i in range(0, 3_000, 60))]
    (tmp_path / "ref").mkdir()
    for k, (a, b) in enumerate([(0, 20), (20, 35), (35, 70), (70, 102)]):
        (tmp_path / "ref" / f"part-{k:05d}.txt").write_text("\n".join(lines[a:b]) + "\n")
    got = read_fasta(spark, str(tmp_path / "ref")).collect()
    want = [("c1", i + 1, bases[i : i + 60]) for i in range(0, 3_000, 60)] + [("c2", i + 1, bases[::-1][i : i + 60]) for i in range(0, 3_000, 60)]
    assert sorted(map(tuple, got)) == want


def test_stream(spark, tmp_path):
    from readloom.streaming.directory import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsg").write_text(TWO_GRAPHS)
    (tmp_path / "in" / "b.tsg").write_text(DIAMOND)
    watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 3 and got.where(F.col("path").endswith("b.tsg")).first().topology == "UniquePath"
