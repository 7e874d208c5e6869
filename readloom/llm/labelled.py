"""The bounded sample of labelled documents that the two models are fitted on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of
from .textstats import FEATURES, statistics

#: Labelled rows that a model is fitted on at most; its memory and time on the driver follow from this bound.
MAX_LABELLED = 20_000


def fold(doc_id):
    """crc32 of the id as text, modulo 3; rows of fold 1 are held out of every fit."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def labelled_sample(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and quality labels of at most ``max_rows`` rows that aren't held out, in an order of their own.

    The rows are those whose ids hash lowest: the same at every partitioning. A document without text counts as
    empty; labels that are null or without a document are left out; of repeated rows the one with the least features
    stands for all, and of repeated labels the greatest. An empty table gives no row. Other columns aren't read.
    """
    ids = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1))
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        .select(F.col("doc_id").alias("_label_id"), F.col("quality").alias("_label"))
    )
    # the right side has max_rows rows of 12 bytes at most, so it can be broadcast
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("_raw")).join(
        F.broadcast(ids), F.col("doc_id") == F.col("_label_id")
    )
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])

    def stats(batches):
        for b in batches:
            yield batch_of(schema, [(i, y, statistics(raw)[1]) for i, y, raw in zip(
                b.column("doc_id").to_pylist(), b.column("_label").to_pylist(), b.column("_raw").to_pylist(), strict=True)])

    # of repeated rows one stands for all; they are brought together before anything reaches the driver, so it takes max_rows rows at most
    got = (
        rows.select("doc_id", "_label", "_raw").mapInArrow(stats, "doc_id long, label int, x array<double>")
        .groupBy("doc_id", "label").agg(F.min("x").alias("x")).collect()
    )
    got.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in got], dtype=np.float64).reshape(-1, len(FEATURES))
    return x, np.array([r["label"] for r in got], dtype=np.float64)
