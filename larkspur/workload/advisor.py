"""Index recommendations from candidate evidence, and what an index changed."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.errors import InvalidArgument
from larkspur.plans.planner import IndexDefinition

#: A hundred percent.
FULL = 10_000


@dataclass(frozen=True)
class Thresholds:
    successful_executions: int = 3
    collection_scans: int = 3
    examined: int = 100
    return_ratio: int = 2_500

    def checked(self) -> Thresholds:
        if min(self.successful_executions, self.collection_scans, self.examined) < 1:
            raise InvalidArgument("advisor counts must be above zero")
        if not 0 <= self.return_ratio <= FULL:
            raise InvalidArgument("the return ratio is at most 10000 basis points")
        return self



def return_ratio(returned: Column, examined: Column) -> Column:
    """Basis points of the examined documents that were returned: rounded down, at most all; all if none."""
    r, e = returned.cast("decimal(24,0)"), examined.cast("decimal(20,0)")
    # remainder-exact: (r * 10000) div e
    q = F.call_function("div", r * F.lit(FULL), e)
    return F.when(examined == 0, F.lit(FULL)).otherwise(F.least(q, F.lit(FULL).cast("bigint"))).cast("int")


def recommend(candidates: DataFrame, existing: Iterable[IndexDefinition] = (), thresholds: Thresholds = Thresholds()) -> DataFrame:
    """collection, path and evidence of every candidate that passes the thresholds and has no index yet."""
    t = thresholds.checked()
    spark = candidates.sparkSession
    have = spark.createDataFrame([(d.collection, d.path_text) for d in existing], "collection string, path string")
    ratio = return_ratio(F.col("collection_scan_returned"), F.col("collection_scan_examined"))
    return (
        candidates.filter(
            (F.col("successful_executions") >= t.successful_executions)
            & (F.col("collection_scans") >= t.collection_scans)
            & (F.col("collection_scan_examined") >= t.examined)
        )
        .withColumn("return_ratio", ratio)
        .filter(F.col("return_ratio") <= t.return_ratio)
        .join(have, ["collection", "path"], "left_anti")
        .select("collection", "path", "successful_executions", "collection_scans", "index_scans", "collection_scan_examined", "collection_scan_returned", "collection_scan_elapsed_micros", "return_ratio")
    )


def _average(total: Column, count: Column) -> Column:
    return F.when(count == 0, F.lit(0)).otherwise(F.call_function("div", total, count)).cast("bigint")


def reduction(before: Column, after: Column) -> Column:
    """Signed basis points by which a number fell: truncated, within 32 bits, 0 from 0."""
    diff = (before.cast("decimal(20,0)") - after.cast("decimal(20,0)")) * F.lit(FULL)
    q = F.call_function("div", diff, before.cast("decimal(20,0)"))
    held = F.least(F.greatest(q, F.lit(-(1 << 31))), F.lit((1 << 31) - 1))
    return F.when(before == 0, F.lit(0)).otherwise(held).cast("int")


def impact(recommended: DataFrame, later: DataFrame, min_index_scans: int = 3) -> DataFrame:
    """What indexes changed: recommendations joined with the candidates of a later window that shows enough
    index scans of the path."""
    if min_index_scans < 1:
        raise InvalidArgument("the number of observations must be above zero")
    seen = later.select("collection", "path", F.col("index_scans").alias("observed_index_scans"), "index_scan_examined", "index_scan_elapsed_micros")
    both = recommended.join(seen, ["collection", "path"]).filter(F.col("observed_index_scans") >= min_index_scans)
    b = both.select(
        "collection",
        "path",
        F.col("collection_scans").alias("baseline_collection_scans"),
        "observed_index_scans",
        _average(F.col("collection_scan_examined"), F.col("collection_scans")).alias("baseline_average_examined"),
        _average(F.col("index_scan_examined"), F.col("observed_index_scans")).alias("observed_average_examined"),
        _average(F.col("collection_scan_elapsed_micros"), F.col("collection_scans")).alias("baseline_average_elapsed_micros"),
        _average(F.col("index_scan_elapsed_micros"), F.col("observed_index_scans")).alias("observed_average_elapsed_micros"),
    )
    return b.withColumns(
        {
            "examined_reduction": reduction(F.col("baseline_average_examined"), F.col("observed_average_examined")),
            "elapsed_reduction": reduction(F.col("baseline_average_elapsed_micros"), F.col("observed_average_elapsed_micros")),
        }
    )
