"""Helpers that the llm operators share; storage is the library's own."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialise, new_dir, put, shared_root, store  # noqa: F401 - the operators take them from here

#: The ASCII white space that separates words.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: A word of a text, as a Spark/Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, most: int) -> DataFrame:
    """``df``, marked for a broadcast if it has ``most`` rows at most; else the planner shuffles. ``df`` is counted up to there."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fresh(names: list[str], base: str) -> str:
    """A column name that is none of ``names``, in any case."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base += "_"
    return base


def filter_rows(df: DataFrame, column: str, keep) -> DataFrame:
    """The rows of ``df``, with all their columns, where ``keep`` (binary values of ``column`` -> booleans) holds.

    Repeated rows are judged alike and each stay or go; nulls are handed over as they are; an empty table gives none.
    """
    at = [n.lower() for n in df.columns].index(column.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                yield part.filter(pa.array(keep(part.column(at).cast(pa.binary()).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def task_ids() -> tuple[int, int]:
    """Partition and attempt of the running task."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return (ctx.partitionId(), ctx.taskAttemptId()) if ctx else (0, 0)


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def flush_rows(schema: pa.Schema, rows: Iterator[tuple], size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch_of(schema, held)
            held = []
    if held:
        yield batch_of(schema, held)


_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)(?::\d+)?(.*)$", re.S)


def surt(url: str | None) -> str:
    """The sort-friendly form of a URL: host labels reversed, joined by commas, then ``)`` and the rest.

    >>> surt("https://m.example.org/a?b")
    'org,example,m)/a?b'
    """
    if not url:
        return ")"
    m = _HOST.match(url)
    if not m:
        return ")" + url
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] or "/")
