"""Expressions over a node's exons (arrays of half-open (start, end))."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span(exons: Column) -> Column:
    """The summed length of the exons."""
    return F.aggregate(exons, F.lit(0).cast("bigint"), lambda a, e: a + (e["end"] - e["start"]))


def introns(exons: Column) -> Column:
    """The gaps between consecutive exons; a gap starts one after the exon's end."""
    n = F.size(exons)
    gaps = F.zip_with(F.slice(exons, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(exons, F.lit(2), F.greatest(n - 1, F.lit(0))),
                      lambda a, b: F.struct((a["end"] + 1).alias("start"), b["start"].alias("end")))
    return F.when(n < 2, F.array().cast("array<struct<start:bigint,end:bigint>>")).otherwise(gaps)


def reference_start(exons: Column) -> Column:
    """The first listed exon's start; null without exons."""
    return F.get(exons, F.lit(0))["start"]


def reference_end(exons: Column) -> Column:
    """The last listed exon's end; null without exons."""
    return F.try_element_at(exons, F.lit(-1))["end"]


def read_ids(reads: Column) -> Column:
    """The distinct ids of a node's reads, sorted."""
    return F.array_sort(F.array_distinct(F.transform(reads, lambda r: r["id"])))
