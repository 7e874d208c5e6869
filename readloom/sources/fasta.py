"""Reference sequences from FASTA, and nodes annotated from them by coordinate.

A FASTA file becomes pieces (reference, start, bases), one per line, with starts found in two passes over the splits.
Nodes look up the pieces they cover by fixed bins, so no task holds a whole reference sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.intervals import reference_end, reference_start
from ..schema import GraphSet

BIN = 10_000


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(reference_id, start, bases): the lines of each sequence, with the place of their first base, from 1.

    A path may be a directory or a pattern; its files are read as one text, in order of their names, so a sequence may go
    on from one part file to the next.
    """
    lines = spark.read.text(path).select(
        F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at")).alias("block"), F.monotonically_increasing_id().alias("row"), F.trim("value").alias("value"))
    title = F.when(F.col("value").startswith(">"), F.struct(F.regexp_extract("value", r"^>\s*(\S*)", 1).alias("id"), F.col("row").alias("row")))
    size = F.when(F.col("value").startswith(">"), 0).otherwise(F.length("value"))
    upto = Window.partitionBy("block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    local = lines.withColumn("own", F.last(title, True).over(upto)).withColumn("size", size)
    local = local.withColumn("sum", F.sum("size").over(Window.partitionBy("block", "own").orderBy("row")))
    # per split: the title that is open at its end and the bases since then, and the bases before its first title
    ends = local.groupBy("block").agg(F.max_by("own", "row").alias("last"), F.max_by("sum", "row").alias("tail"), F.max(F.when(F.col("own").isNull(), F.col("sum"))).alias("head"))
    before = Window.partitionBy(F.lit(0)).orderBy("block.path", "block.at")  # a row per split
    runs = ends.withColumn("run", F.count("last").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    # of the splits since the last one with a title: its tail, and the whole of those without
    carried = runs.select(
        "block", F.last("last", True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"),
        (F.coalesce(F.last(F.when(F.col("last").isNotNull(), F.col("tail")), True).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
         + F.coalesce(F.sum(F.when(F.col("last").isNull(), F.col("head"))).over(Window.partitionBy("run").orderBy("block.path", "block.at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("skip"))
    placed = local.join(carried, "block").where((F.col("size") > 0) & F.coalesce("own", "carry").isNotNull())
    start = F.col("sum") - F.col("size") + 1 + F.when(F.col("own").isNull(), F.col("skip")).otherwise(0)
    return placed.select(F.coalesce("own.id", "carry.id").alias("reference_id"), start.cast("bigint").alias("start"), F.col("value").alias("bases"))


def annotate(g: GraphSet, fasta: DataFrame) -> GraphSet:
    """Nodes with ``sequence`` from one base before their first exon's start to their last exon's end, introns included.

    Nodes without exons, or on a reference that isn't there, keep the sequence they have.
    """
    ends = F.col("start") + F.length("bases") - 1
    pieces = fasta.select("reference_id", F.col("start").alias("at"), "bases", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(ends / BIN))).alias("bin"))
    key = ["file", "graph_id", "node_id"]
    want = g.nodes.where(F.size("exons") > 0).select(*key, "reference_id", F.greatest(reference_start(F.col("exons")) - 1, F.lit(1)).alias("lo"), reference_end(F.col("exons")).alias("hi")).where("lo <= hi")
    binned = want.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor(F.col("hi") / BIN))))
    met = binned.join(pieces, ["reference_id", "bin"]).where((F.col("at") <= F.col("hi")) & (F.col("at") + F.length("bases") > F.col("lo")))
    first = F.greatest(F.col("lo") - F.col("at"), F.lit(0)) + 1
    part = F.substring("bases", first, F.least(F.col("hi") - F.col("at") + 1, F.length("bases")) - first + 1)
    found = met.select(*key, F.struct("at", part.alias("s")).alias("p")).distinct().groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["s"]), "").alias("found"))
    nodes = g.nodes.join(found, key, "left").withColumn("sequence", F.coalesce("found", "sequence")).select(*g.nodes.columns)
    return g.with_tables(nodes=nodes)
