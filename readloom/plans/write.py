"""Writing line tables: as a sorted directory, to one stream, or one file per graph."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import TextIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import put, store
from .exports import ORDER


def to_directory(lines: DataFrame, path: str) -> None:
    """Part files in order; their concatenation is the whole text."""
    lines.orderBy(*ORDER).select("line").write.text(path)


def to_stream(lines: DataFrame, out: TextIO) -> None:
    """One text, a partition at a time through the driver."""
    for row in lines.orderBy(*ORDER).select("line").toLocalIterator(prefetchPartitions=True):
        out.write(row[0] + "\n")


def per_graph(lines: DataFrame, directory: str, suffix: str, change: Callable[[str], str] | None = None) -> int:
    """``<directory>/<graph_id><suffix>`` for each graph; returns the number of files.

    Lines are dealt by graph and streamed in order, so a task holds one line at a time. A file is drafted under the
    attempt's name and moved when it is whole.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        fs, root = store(directory)
        fs.create_dir(root, recursive=True)
        now = out = None
        n = 0

        def finish() -> None:
            if out is not None:
                out.close()
                put(fs, f"{root}/.{attempt}.draft", f"{root}/{now}{suffix}")

        for b in batches:
            for gid, line in zip(b.column("graph_id").to_pylist(), b.column("line").to_pylist(), strict=True):
                if gid != now:
                    finish()
                    now, n = gid, n + 1
                    out = fs.open_output_stream(f"{root}/.{attempt}.draft", compression=None)
                out.write(((change(line) if change else line) + "\n").encode())
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    laid = lines.repartition("graph_id").sortWithinPartitions("graph_id", *ORDER).select("graph_id", "line")
    return laid.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def pretty(line: str) -> str:
    return json.dumps(json.loads(line), indent=2, ensure_ascii=False)
