"""A directory of files as a stream: each new file is parsed and summarised as it arrives (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import analytics
from ..operators.datasets import merge
from ..sources.build import tables
from ..sources.text import numbered
from ..storage import materialise


def watch(spark: SparkSession, directory: str, output: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the summary rows of each new file below ``directory`` to the Parquet table ``output``, with its path.

    A file is one collection. Malformed records are left out. ``trigger`` goes to the stream writer, for example
    availableNow=True. Each batch is written under its own number, so a repeated batch replaces itself.
    """
    texts = spark.readStream.schema("value string").text(directory, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def batch(files: DataFrame, number: int) -> None:
        ids = files.select("path", F.row_number().over(_by_path()).alias("n"), "value")
        files = materialise(ids.select("path", (F.col("n") - 1).cast("int").alias("file"), "value"), "files")
        lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("row", "value"))
        records = numbered(lines.select("file", F.struct(F.lit("").alias("path"), F.lit(0).cast("bigint").alias("at")).alias("block"), F.col("row").cast("bigint").alias("row"), "value"))
        made, _ = tables(materialise(records, "records"))
        named = merge(made.map(lambda name, t: materialise(t, name)))
        rows = analytics.summary(named).join(named.graphs.select(F.col("graph_id").alias("gid"), "file"), "gid").join(files.select("file", "path"), "file").drop("file")
        rows.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _by_path():
    from pyspark.sql import Window

    return Window.orderBy("path")  # one row per file of a batch
