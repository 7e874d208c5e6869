"""Command line: ``python -m readloom.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import contextlib
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import cli_help
from .operators import analytics, datasets, traversal
from .plans import exports, write
from .sources.build import load


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readloom", description="Read-supported path analytics over collections of small graphs.")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, many: bool = False, output: str | None = "output file; standard output if absent"):
        c = commands.add_parser(name, help=about)
        c.add_argument("inputs" if many else "input", nargs="+" if many else None)
        if output:
            c.add_argument("-o", "--output", help=output)
        return c

    command("header", "print the headers", output=None)
    command("summary", "a CSV row per graph")
    command("fa", "path sequences as FASTA")
    command("gtf", "paths as GTF")
    command("vcf", "paths' edges as VCF")
    command("dot", "a DOT file per graph", output="output folder; <stem>_dot beside the input if absent")
    command("json", "a JSON file per graph", output="output folder; <stem>_json beside the input if absent").add_argument("-p", "--pretty", action="store_true")
    command("traverse", "path ids").add_argument("-t", "--text-path", action="store_true", help="with their nodes and edges")
    command("merge", "one collection from several files", many=True)
    command("split", "a file per graph", output="output folder; <stem>_split beside the input if absent")
    q = command("query", "the graphs of some ids")
    q.add_argument("-i", "--ids", required=True, help="ids, separated by commas")
    q.add_argument("--ids-file", help="a file with an id per line")
    shell = commands.add_parser("completions", help="print a completion script for a command named readloom")
    shell.add_argument("shell", choices=sorted(cli_help.SHELLS))
    commands.add_parser("markdown-help", help="print this help as Markdown")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command in ("completions", "markdown-help"):
        sys.stdout.write(cli_help.SHELLS[args.shell](parser()) if args.command == "completions" else cli_help.markdown(parser()))
        return 0
    spark = spark or SparkSession.builder.appName("readloom").getOrCreate()
    if args.command == "merge":
        g = datasets.merge(load(spark, args.inputs))
    else:
        g = load(spark, args.input)

    def emit(lines) -> None:
        with contextlib.ExitStack() as stack:
            out = stack.enter_context(open(args.output, "w", encoding="utf-8")) if getattr(args, "output", None) else sys.stdout
            write.to_stream(lines, out)

    def folder(kind: str) -> str:
        source = Path(args.input)
        return args.output or str(source.parent / f"{source.stem}_{kind}")

    if args.command == "header":
        emit(exports.header_lines(g))
    elif args.command == "summary":
        emit(exports.summary_lines(g, analytics.summary(g)))
    elif args.command in ("fa", "gtf", "vcf"):
        lines = {"fa": exports.fasta_lines, "gtf": exports.gtf_lines, "vcf": exports.vcf_lines}[args.command]
        emit(lines(g, traversal.traverse(g)))
    elif args.command == "traverse":
        emit(exports.path_lines(g, traversal.traverse(g), args.text_path))
    elif args.command == "dot":
        write.per_graph(exports.dot_lines(g), folder("dot"), ".dot")
    elif args.command == "json":
        write.per_graph(exports.json_lines(g), folder("json"), ".json", write.pretty if args.pretty else None)
    elif args.command == "split":
        if not g.graphs.take(1):
            raise SystemExit("there is no graph to split")
        write.per_graph(exports.split_lines(g), folder("split"), ".tsg")
    elif args.command == "merge":
        emit(exports.text_lines(g))
    elif args.command == "query":
        lines = Path(args.ids_file).read_text(encoding="utf-8").splitlines() if args.ids_file else []
        emit(exports.text_lines(datasets.select_graphs(g, datasets.id_list(args.ids, lines))))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
