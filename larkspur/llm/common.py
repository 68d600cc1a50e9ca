"""Helpers shared by the text operators: table access, staged tables, hashing and word splitting."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD_RE = r"[^\x20\x09-\x0D]+"

#: Rows of text in one Arrow batch; long texts make a batch heavy, so it is small.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, read by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of text that one Arrow batch holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; in a session without that
    setting (tests on one machine) a folder below the warehouse is used and recorded."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_larkspur_checkpoints"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    A lost executor then costs no recomputation, and later steps see one fixed result."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._larkspur_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_larkspur_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def crc_part(col: str, mod: int):
    """crc32(of the id as text) mod m; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % F.lit(mod)


def byte_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of the text, as UTF-8; bytes.split() knows just the six white-space bytes."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing generator: spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def arrays_of(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


class Adam:
    """Adam updates over a list of numpy arrays, in place."""

    def __init__(self, params: list[np.ndarray], lr: float):
        self.params, self.lr, self.t = params, lr, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        scale = self.lr * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= scale * m / (np.sqrt(v) + 1e-8)


def cached(fn):
    """Remember results by argument, at most 512 of them (unlike functools' caches it travels to executors by value)."""
    held: dict = {}

    def call(*key):
        if key not in held:
            if len(held) >= 512:
                held.clear()
            held[key] = fn(*key)
        return held[key]

    return call


def released(run):
    """run for mapInPandas, after which an idle worker gives the memory that it has used back to the system."""

    def call(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return call


def settle(spark: SparkSession) -> None:
    """Give back what finished steps have left behind.

    Shuffle files and broadcasts go when the driver's garbage is collected, which a driver with room to spare does
    far too seldom for the executors' disks; freed native memory (of the JVM's compilers, mostly) stays with the
    allocator until it is told to return it."""
    import gc

    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.java.lang.System.gc()
    gateway = spark.sparkContext._gateway
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server.invoke(name, "systemTrimNativeHeap", gateway.new_array(jvm.java.lang.Object, 0), gateway.new_array(jvm.java.lang.String, 0))
    except Py4JError:  # not every JVM can
        pass


#: Bits of a Bloom filter for each id that it holds, and the most bits of a filter (32 MB).
_BLOOM_EACH, _BLOOM_BITS = 12, 28


def bloom_test(ids: DataFrame, col: str):
    """A column expression maker: whether an id column's value may be among ids[col] (never wrongly no).

    The filter is sized by the number of ids.  Where 32 MB are too few for them (over some 20 million), every value
    may be among them: rows then meet the ids in the join that follows, as without a filter."""
    spark = ids.sparkSession
    many = ids.count()
    bits_n = max(16, (many * _BLOOM_EACH - 1).bit_length()) if many else 16
    if bits_n > _BLOOM_BITS:
        return lambda name: F.lit(True)
    size = (1 << bits_n) // 8

    def places(h: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            return [((h * np.uint64(m)) >> np.uint64(64 - bits_n)).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

    def fill(batches):
        bits = np.zeros(size, np.uint8)
        for b in batches:
            for p in places(b["h"].to_numpy(np.int64).view(np.uint64)):
                np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
        yield pd.DataFrame({"bits": [bits.tobytes()]})

    # a task's part has the filter's size: few tasks while the ids are few, more as they grow
    parts = ids.select(F.xxhash64(col).alias("h")).coalesce(max(6, many // 1_000_000)).mapInPandas(fill, "bits binary")
    bits = np.zeros(size, np.uint8)
    for r in parts.toLocalIterator():
        bits |= np.frombuffer(r["bits"], np.uint8)
    held = spark.sparkContext.broadcast(bits.tobytes())

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        bits = np.frombuffer(held.value, np.uint8)
        ok = np.ones(len(h), bool)
        for p in places(h.to_numpy(np.int64).view(np.uint64)):
            ok &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(ok)

    return lambda name: maybe(F.xxhash64(name))


def hash_below(share: float, *cols: str):
    """Whether a 64-bit hash of the columns is among the lowest such share of all hashes: fine enough for any table."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1) < F.lit(min(int(share * 2.0**63), 2**63 - 1))


def narrowed(df: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose col is among ids[col], and a few others: a cheap filter before a join, so that rows
    without a partner (and their texts) do not move.  Null ids may go."""
    return df.filter(bloom_test(ids, col)(col))


def without(df: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose col is not among ids[col] (a staged table).  Rows that surely stay are only read; the
    few others meet the ids in a join.  A null in df stays."""
    maybe = bloom_test(ids, col)
    doubtful = df.filter(maybe(col)).join(ids.select(col).distinct(), col, "left_anti").select(df.columns)
    return df.filter(~maybe(col)).unionByName(doubtful)


def summed_vectors(parts: DataFrame, dtype: str, length: int) -> DataFrame:
    """key, vec: the element-wise sums of parts(key int, vec binary), one part a task and key.

    Two levels of groups, so that no group holds more than about the root of the number of tasks."""
    salts = max(1, int(parts.rdd.getNumPartitions() ** 0.5))

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        acc = np.zeros(length, np.float64)
        for v in pdf["vec"]:
            acc += np.frombuffer(v, dtype)
        return pd.DataFrame({"key": [int(key[0])], "vec": [acc.tobytes()]})

    salted = parts.withColumn("salt", F.spark_partition_id() % salts)
    some = salted.groupBy("key", "salt").applyInPandas(add, "key int, vec binary")

    def add_doubles(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        acc = np.zeros(length, np.float64)
        for v in pdf["vec"]:
            acc += np.frombuffer(v, np.float64)
        return pd.DataFrame({"key": [int(key[0])], "vec": [acc.tobytes()]})

    return some.groupBy("key").applyInPandas(add_doubles, "key int, vec binary") if salts > 1 else some
