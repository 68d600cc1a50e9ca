"""Exact-key indexes as side tables (kind, one key column a kind, document id).

Keys order by kind (int, float, string, id), then value.  Missing and null are left out; any other kind
cannot be indexed, and a write that would bring one in is refused before it happens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.errors import InvalidArgument
from larkspur.functions import values as V
from larkspur.operators.frame import ID, Frame
from larkspur.plans.syntax import Literal

# The kinds of keys in their order, and their column types.
KEYS = {"int": "bigint", "float": "double", "string": "string", "id": "binary"}
_RANK = {k: n for n, k in enumerate(KEYS)}


def entries(frame: Frame, path: tuple[str, ...]) -> DataFrame:
    """rank, key_int, key_float, key_string, key_id, _id of every document that has a key."""
    v = frame.read(path)
    banned = [k for k in v.tests if k not in (*KEYS, V.MISSING, V.NULL)]
    fits: Column = F.lit(False)
    for k in banned:
        fits = fits | v.test(k)
    if banned and frame.df.filter(fits).limit(1).count():
        raise InvalidArgument(f"{'.'.join(path)} holds a kind that cannot be indexed")
    rank = F.lit(None).cast("int")
    for k in KEYS:
        if k in v.tests:
            rank = F.when(v.test(k), F.lit(_RANK[k])).otherwise(rank)
    cols = [(F.when(v.test(k), v.cols[k]) if k in v.tests else F.lit(None)).cast(t).alias(f"key_{k}") for k, t in KEYS.items()]
    return frame.df.select(rank.alias("rank"), *cols, F.col(ID)).filter(F.col("rank").isNotNull())


def key_literal(value) -> Literal:
    kind = {bool: None, int: "int", float: "float", str: "string", bytes: "id"}.get(type(value))
    if kind is None:
        raise InvalidArgument(f"{value!r} cannot be an index key")
    return Literal(kind, value)


def _typed(key: Literal) -> Column:
    return F.lit(key.value).cast(KEYS[key.kind])


def exact(side: DataFrame, key: Literal) -> DataFrame:
    """Ids of the documents with the key."""
    return side.filter((F.col("rank") == _RANK[key.kind]) & (F.col(f"key_{key.kind}") == _typed(key))).select(ID)


def between(side: DataFrame, low: Literal, high: Literal) -> DataFrame:
    """Entries from low to high, both included, in key and id order; kinds order before values."""
    a, b = (_RANK[low.kind], low.value), (_RANK[high.kind], high.value)
    if a > b:
        raise InvalidArgument("the range's start is above its end")
    rank = F.col("rank")
    above = (rank > a[0]) | ((rank == a[0]) & (F.col(f"key_{low.kind}") >= _typed(low)))
    below = (rank < b[0]) | ((rank == b[0]) & (F.col(f"key_{high.kind}") <= _typed(high)))
    return side.filter(above & below).orderBy("rank", *[f"key_{k}" for k in KEYS], ID)


def removed(side: DataFrame, pairs: DataFrame) -> DataFrame:
    """The side table without the given (rank, keys, id) entries."""
    cond = [side[c].eqNullSafe(pairs[c]) for c in side.columns]
    return side.join(pairs, cond, "left_anti")


def faults(side: DataFrame, frame: Frame, path: tuple[str, ...]) -> DataFrame:
    """What is wrong with a side table: (fault, entries) rows; none if it agrees with the documents."""
    want = entries(frame, path)
    # one exchange: how often either side has each entry
    both = side.select(*side.columns, F.lit(1).alias("have"), F.lit(0).alias("need")).unionByName(want.select(*side.columns, F.lit(0).alias("have"), F.lit(1).alias("need")))
    told = both.groupBy(*side.columns).agg(F.sum("have").alias("have"), F.sum("need").alias("need"))
    count = lambda when, n: F.coalesce(F.sum(F.when(when, n)), F.lit(0)).cast("long")
    sums = told.agg(
        count(F.col("need") == 0, F.col("have")).alias("entry without a document"),
        count(F.col("have") == 0, F.col("need")).alias("document without an entry"),
        count(F.col("have") > 1, F.lit(1)).alias("repeated entry"),
    )
    return sums.unpivot([], list(sums.columns), "fault", "entries").filter("entries > 0")
