"""The line-based multi-graph format as records, one row per line, with its graph and line number.

Line numbers and graph sections are found in two passes, so a large file is not gathered in one task: within each split
by a window over the split, and across splits by a window over one row per split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_GRAPH
from ..functions import text as T

RECORDS = ("H", "G", "N", "E", "U", "P", "C", "A", "L")


def numbered(lines: DataFrame) -> DataFrame:
    """(file, block, row, value) to records: file, line_no, graph_id, kind, tokens."""
    in_block = Window.partitionBy("file", "block").orderBy("row")
    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    # lines are sorted as they are and cut afterwards; only those of graphs are cut before
    section = F.when(F.col("value").rlike(r"(?U)^\s*G(?:\s|$)"), F.get(T.tokens(F.col("value")), F.lit(1)))
    found = lines.withColumn("section", section)
    local = found.withColumn("n", F.row_number().over(in_block)).withColumn("own", F.last("section", True).over(upto))
    ends = found.groupBy("file", "block").agg(F.count(F.lit(1)).alias("lines"), F.max_by("section", F.when(F.col("section").isNotNull(), F.col("row"))).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "block", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("skip"), F.last("last", True).over(before).alias("carry"))
    cut = local.join(carried, ["file", "block"]).withColumn("tokens", T.tokens(F.col("value"))).withColumn("kind", F.get("tokens", F.lit(0)))
    return cut.select(
        "file", (F.col("skip") + F.col("n")).cast("bigint").alias("line_no"),
        F.coalesce("own", "carry", F.lit(DEFAULT_GRAPH)).alias("graph_id"), "kind", "tokens",
    ).where(F.col("kind").isin(*RECORDS))


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of files; ``file`` is a file's place in ``paths``. Spark's text reader takes compressed files too.

    A path may be a pattern; its files share that place, in order of their names.
    """
    found = []
    for i, path in enumerate([paths] if isinstance(paths, str) else paths):
        raw = spark.read.text(path)
        found.append(raw.select(
            F.lit(i).alias("file"), F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at")).alias("block"),
            F.monotonically_increasing_id().alias("row"), "value"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return numbered(out)


def parse_records(spark: SparkSession, text: str, file: int = 0) -> DataFrame:
    """Records of a text in memory."""
    one = spark.createDataFrame([(file, text)], "file int, text string")
    rows = one.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("row", "value"))
    return numbered(rows.select("file", F.struct(F.lit("").alias("path"), F.lit(0).cast("bigint").alias("at")).alias("block"), F.col("row").cast("bigint").alias("row"), "value"))
