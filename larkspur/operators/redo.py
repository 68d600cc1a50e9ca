"""Redo recovery of a write log: the last image of every page by a transaction that committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replayed(log: DataFrame) -> DataFrame:
    """All page writes to apply, in log order: log(lsn, txn, op, page_id, image), op one of begin, write,
    commit, abort, checkpoint.  Writes of transactions that committed and did not abort."""
    done = log.filter(F.col("op") == "commit").select("txn").distinct()
    undone = log.filter(F.col("op") == "abort").select("txn").distinct()
    return log.filter(F.col("op") == "write").join(done, "txn", "left_semi").join(undone, "txn", "left_anti").select("lsn", "txn", "page_id", "image")


def recovered(log: DataFrame) -> DataFrame:
    """page_id, lsn, image after recovery.  Applying it again changes nothing."""
    last = F.max(F.struct("lsn", "image"))
    # one partial maximum a task and page: no page's history is gathered
    return replayed(log).groupBy("page_id").agg(last.alias("w")).select("page_id", "w.lsn", "w.image")


def gaps(log: DataFrame) -> DataFrame:
    """lsn values after which the log is not contiguous (from 0 on): where a torn tail begins, or corruption."""
    ids = log.select("lsn", F.floor(F.col("lsn") / 65_536).alias("block"))
    within = F.lead("lsn").over(Window.partitionBy("block").orderBy("lsn"))
    heads = ids.groupBy("block").agg(F.min("lsn").alias("head")).select((F.col("block") - 1).alias("block"), "head")
    nxt = ids.withColumn("next", within).join(heads, "block", "left")
    follow = F.coalesce("next", "head")
    return nxt.filter(follow.isNotNull() & (follow != F.col("lsn") + 1)).select("lsn")
