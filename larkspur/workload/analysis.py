"""Workload evidence from execution events: four aggregations of one events DataFrame.

Counters saturate at the largest unsigned 64-bit number; sums run in 38-digit decimals below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64_MAX = (1 << 64) - 1


def counter(col: Column) -> Column:
    """A saturating sum of a column, 0 if nothing is summed; in long where it fits (it does below 2^63)."""
    total = F.coalesce(F.sum(col.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return F.least(total, F.lit(str(U64_MAX)).cast("decimal(38,0)")).cast("decimal(20,0)")


def _count_if(test: Column) -> Column:
    return counter(F.when(test, 1).otherwise(0))



def _tests() -> tuple[Column, Column, Column]:
    return F.col("succeeded"), F.col("access") == "collection_scan", F.col("access") == "index_scan"


def totals(events: DataFrame) -> DataFrame:
    """One row for the whole workload.  Scan counts include failed events; metrics do not."""
    ok, scan, index = _tests()
    return events.agg(
        counter(F.lit(1)).alias("total_events"),
        _count_if(ok).alias("successful_events"),
        _count_if(~ok).alias("failed_events"),
        _count_if(F.col("access") == "command").alias("command_executions"),
        _count_if(scan).alias("collection_scans"),
        _count_if(index).alias("index_scans"),
        *[counter(F.when(ok, F.col(c))).alias(f"total_{c}") for c in ("examined", "returned", "elapsed_micros")],
    )


def _shape_stats() -> list[Column]:
    ok, scan, index = _tests()
    return [
        _count_if(ok).alias("successful_executions"),
        _count_if(~ok).alias("failed_executions"),
        _count_if(ok & scan).alias("collection_scans"),
        _count_if(ok & index).alias("index_scans"),
        *[counter(F.when(ok, F.col(c))).alias(f"total_{c}") for c in ("examined", "returned", "elapsed_micros")],
    ]


def by_fingerprint(events: DataFrame) -> DataFrame:
    """A row for each collection (or none) and query shape."""
    return events.groupBy("collection", "fingerprint").agg(*_shape_stats())


def by_path(events: DataFrame) -> DataFrame:
    """A row for each collection and predicate path; an event counts in full for each of its paths."""
    each = events.filter("collection is not null").withColumn("path", F.explode(F.array_distinct("predicate_paths")))
    return each.groupBy("collection", "path").agg(*_shape_stats())


def candidates(events: DataFrame) -> DataFrame:
    """A row for each collection and path that an index could serve, with scan and index metrics apart.
    An index scan counts for every candidate path of its query, whichever path the index is on."""
    ok, scan, index = _tests()
    each = events.filter("collection is not null").withColumn("path", F.explode(F.array_distinct("candidate_paths")))
    return each.groupBy("collection", "path").agg(
        _count_if(ok).alias("successful_executions"),
        _count_if(~ok).alias("failed_executions"),
        _count_if(ok & scan).alias("collection_scans"),
        _count_if(ok & index).alias("index_scans"),
        *[counter(F.when(ok & scan, F.col(c))).alias(f"collection_scan_{c}") for c in ("examined", "returned", "elapsed_micros")],
        *[counter(F.when(ok & index, F.col(c))).alias(f"index_scan_{c}") for c in ("examined", "returned", "elapsed_micros")],
    )


def without_explains(events: DataFrame) -> DataFrame:
    """Events of plain explains out: they have an access path but neither examine nor return anything."""
    return events.filter(~((F.col("examined") == 0) & (F.col("returned") == 0) & (F.col("access") != "command") & F.col("succeeded")))
