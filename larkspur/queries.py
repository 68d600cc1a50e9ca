"""The engine's driver queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.engine import Engine
from larkspur.operators import index as ix
from larkspur.operators import redo
from larkspur.plans.planner import IndexDefinition
from larkspur.sources.backend import DocumentApi
from larkspur.workload import advisor, analysis

# The tables' keys; none of their columns is ever null (the tables' declared constraint).
KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id",),
}


def opened(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    """An engine with the tables attached as collections, nothing copied."""
    engine = Engine(spark)
    for t in tables:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        engine.attach(t, df, KEYS[t], non_null=tuple(df.columns))
    return engine


def _get(text: str) -> Callable[[SparkSession, str], DataFrame]:
    table = text.split(".")[0].strip()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return opened(spark, sf_dir, table).execute(text).df

    return run


def _after(*texts: str) -> Callable[[SparkSession, str], DataFrame]:
    """What the last query reads after the others have run."""
    table = texts[0].split(".")[0].strip()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = opened(spark, sf_dir, table)
        for t in texts[:-1]:
            engine.execute(t)
        return engine.execute(texts[-1]).df

    return run


def derived_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic workload: every row of events stands for one execution."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind, user, n = F.col("event_type"), F.col("user_id"), F.col("event_id")
    scan = F.when(n % 10 == 0, "command").when(n % 3 == 0, "index_scan").otherwise("collection_scan")
    return e.select(
        F.concat(F.lit("get:c"), (user % 5).cast("string"), F.when(n % 2 == 0, "|filter").otherwise("|filter|limit")).alias("fingerprint"),
        F.when(n % 10 != 0, F.concat(F.lit("c"), (user % 5).cast("string"))).alias("collection"),
        F.array(kind, F.concat(F.lit("p"), (n % 4).cast("string")), kind).alias("predicate_paths"),
        F.array(kind).alias("candidate_paths"),
        scan.alias("access"),
        F.when(scan == "index_scan", F.lit("ix")).alias("index_name"),
        (n % 1000).alias("examined"),
        (n % 100).alias("returned"),
        F.floor(F.col("value") * 10).cast("long").alias("elapsed_micros"),
        (n % 17 != 0).alias("succeeded"),
    )


_EVENTS = """e AS (SELECT 'get:c' || (user_id % 5) || CASE WHEN event_id % 2 = 0 THEN '|filter' ELSE '|filter|limit' END AS fingerprint,
  CASE WHEN event_id % 10 <> 0 THEN 'c' || (user_id % 5) END AS collection, event_type, 'p' || (event_id % 4) AS p,
  CASE WHEN event_id % 10 = 0 THEN 'command' WHEN event_id % 3 = 0 THEN 'index_scan' ELSE 'collection_scan' END AS access,
  event_id % 1000 AS examined, event_id % 100 AS returned, CAST(floor(value * 10) AS BIGINT) AS elapsed_micros, event_id % 17 <> 0 AS succeeded, event_id, ts FROM events)"""

_SHAPE = """CAST(count(*) FILTER (succeeded) AS BIGINT) AS successful_executions, CAST(count(*) FILTER (NOT succeeded) AS BIGINT) AS failed_executions,
  CAST(count(*) FILTER (succeeded AND access = 'collection_scan') AS BIGINT) AS collection_scans, CAST(count(*) FILTER (succeeded AND access = 'index_scan') AS BIGINT) AS index_scans,
  CAST(coalesce(sum(examined) FILTER (succeeded), 0) AS BIGINT) AS total_examined, CAST(coalesce(sum(returned) FILTER (succeeded), 0) AS BIGINT) AS total_returned,
  CAST(coalesce(sum(elapsed_micros) FILTER (succeeded), 0) AS BIGINT) AS total_elapsed_micros"""

_SPLIT = """CAST(count(*) FILTER (succeeded) AS BIGINT) AS successful_executions, CAST(count(*) FILTER (NOT succeeded) AS BIGINT) AS failed_executions,
  CAST(count(*) FILTER (succeeded AND access = 'collection_scan') AS BIGINT) AS collection_scans, CAST(count(*) FILTER (succeeded AND access = 'index_scan') AS BIGINT) AS index_scans,
""" + ",\n".join(
    f"  CAST(coalesce(sum({c}) FILTER (succeeded AND access = '{a}'), 0) AS BIGINT) AS {a}_{c}" for a in ("collection_scan", "index_scan") for c in ("examined", "returned", "elapsed_micros")
)

_CANDIDATES = f"{_EVENTS}, c AS (SELECT collection, event_type AS path, {_SPLIT} FROM e WHERE collection IS NOT NULL GROUP BY 1, 2)"
_RATIO = "CASE WHEN collection_scan_examined = 0 THEN 10000 ELSE least(collection_scan_returned * 10000 // collection_scan_examined, 10000) END"


def _longs(df: DataFrame) -> DataFrame:
    """Counters as long: what these inputs give fits."""
    return df.select(*[F.col(n).cast("long") if t.startswith("decimal") else F.col(n) for n, t in df.dtypes])


def _recommended(spark, sf_dir: str, events: DataFrame | None = None, ratio: int = 1_000) -> DataFrame:
    evidence = analysis.candidates(events if events is not None else derived_events(spark, sf_dir))
    have = [IndexDefinition("ix", "c0", ("click",)), IndexDefinition("iy", "c3", ("view",))]
    return advisor.recommend(evidence, have, advisor.Thresholds(examined=1, return_ratio=ratio))


def _impact(spark, sf_dir: str) -> DataFrame:
    events = derived_events(spark, sf_dir)
    first = _recommended(spark, sf_dir, events.filter(F.col("examined") < 500), 5_000)
    return advisor.impact(first, analysis.candidates(events.filter(F.col("examined") >= 500)))


_WINDOW = "(SELECT collection, event_type AS path, {split} FROM e WHERE collection IS NOT NULL AND {when} GROUP BY 1, 2)"
_IMPACT = f"""WITH {_EVENTS}, a AS {_WINDOW.format(split=_SPLIT, when="examined < 500")}, b AS {_WINDOW.format(split=_SPLIT, when="examined >= 500")},
r AS (SELECT * FROM a WHERE successful_executions >= 3 AND collection_scans >= 3 AND collection_scan_examined >= 1 AND {_RATIO} <= 5000
  AND (collection, path) NOT IN (('c0', 'click'), ('c3', 'view'))),
j AS (SELECT r.collection, r.path, r.collection_scans AS baseline_collection_scans, b.index_scans AS observed_index_scans,
  r.collection_scan_examined // r.collection_scans AS baseline_average_examined, b.index_scan_examined // b.index_scans AS observed_average_examined,
  r.collection_scan_elapsed_micros // r.collection_scans AS baseline_average_elapsed_micros, b.index_scan_elapsed_micros // b.index_scans AS observed_average_elapsed_micros
  FROM r JOIN b USING (collection, path) WHERE b.index_scans >= 3)
SELECT *, CAST(CASE WHEN baseline_average_examined = 0 THEN 0 ELSE trunc((baseline_average_examined - observed_average_examined) * 10000.0::DOUBLE / baseline_average_examined) END AS INTEGER) AS examined_reduction,
  CAST(CASE WHEN baseline_average_elapsed_micros = 0 THEN 0 ELSE trunc((baseline_average_elapsed_micros - observed_average_elapsed_micros) * 10000.0::DOUBLE / baseline_average_elapsed_micros) END AS INTEGER) AS elapsed_reduction FROM j"""


def _log(spark, sf_dir: str) -> DataFrame:
    """A write log from events: eight records a transaction, the last ends some of them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    op = F.when(n % 8 == 0, "begin").when(n % 8 != 7, "write").when(F.floor(n / 8) % 5 == 0, "abort").when(F.floor(n / 8) % 7 == 0, "write").otherwise("commit")
    return e.select(n.alias("lsn"), F.floor(n / 8).alias("txn"), op.alias("op"), (F.col("user_id") % 20).alias("page_id"), F.concat_ws(":", "event_type", n.cast("string")).alias("image"))


_LOG = """log AS (SELECT event_id AS lsn, event_id // 8 AS txn, CASE WHEN event_id % 8 = 0 THEN 'begin' WHEN event_id % 8 <> 7 THEN 'write'
  WHEN event_id // 8 % 5 = 0 THEN 'abort' WHEN event_id // 8 % 7 = 0 THEN 'write' ELSE 'commit' END AS op, user_id % 20 AS page_id, event_type || ':' || event_id AS image FROM events)"""


def _index(text: str, read: Callable[[Engine], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    table = text.split(" on ")[1].split("(")[0].strip()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = opened(spark, sf_dir, table)
        engine.execute(text)
        return read(engine)

    return run


def _tagged(spark: SparkSession, sf_dir: str) -> Engine:
    """Events by user with the set of their types as an array, and a nested object, and nulls."""
    engine = Engine(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = e.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("tags"), F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    users = users.withColumn("stats", F.struct(F.col("n").alias("count"), F.when(F.col("n") % 2 == 0, F.col("last")).alias("even_last")))
    users = users.withColumn("note", F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))))
    engine.attach("users", users.select("user_id", "tags", "stats", "note"), ("user_id",))
    return engine


_USERS = "u AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS tags, count(*) AS n, max(event_id) AS last, CASE WHEN user_id % 3 = 0 THEN 'u' || user_id END AS note FROM events GROUP BY user_id)"


def _users(text: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df):
    return lambda spark, sf_dir: shape(_tagged(spark, sf_dir).execute(text).df)


def _placed(engine: Engine, text: str) -> DataFrame:
    """All documents of the result with their place in its order, from 0.

    Each range of the sorted rows counts its own; only one number a range is added to them."""
    rows = engine.execute(text).ordered().select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")).cache()
    counts = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("range", (before - F.col("first")).alias("base"))
    return rows.join(bases, "range").withColumn("place", F.col("at") + F.col("base")).drop("range", "at", "base")


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("props", F.from_json("props", "k long"))
    engine.attach("events", e, ("event_id",))
    return engine.execute("events.get { props.k == 9 } | project event_id, props.k").df.select("event_id", F.col("props.k").alias("k"))


def _planted_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries taken out of an index, put in twice and made up."""
    engine = opened(spark, sf_dir, "orders")
    engine.execute("create index by_customer on orders (o_custkey)")
    side = engine.side_table("by_customer")
    key = F.col("key_int")
    left = side.filter(key % 5 != 0)
    broken = left.unionByName(left.filter(key % 7 == 1)).unionByName(side.filter(key % 11 == 2).withColumn("key_int", key + 1_000_000_000))
    return ix.faults(broken, engine.frame("orders"), ("o_custkey",))


#: What replaced documents hold.
_MARKED = "CASE WHEN o_orderkey % 4 = 1 THEN 'replaced' ELSE o_orderpriority END AS o_orderpriority"


def _by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents replaced and a quarter deleted, by their ids."""
    engine = opened(spark, sf_dir, "orders")
    api = DocumentApi(engine)
    rows = engine.frame("orders").df
    api.replace("orders", rows.filter("o_orderkey % 4 = 1").withColumn("o_orderpriority", F.lit("replaced")))
    api.delete("orders", rows.filter("o_orderkey % 4 = 2"))
    return engine.execute(f"orders.get {{}} | project {_ORDERS}").df


def _dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection dropped with its index and created anew knows nothing of its former self."""
    engine = Engine(spark)
    for text in ("create collection c", 'c.insert { name: "first", n: 1 }', "create index by_n on c (n)", "drop index by_n", "create index by_n on c (n)", "drop collection c", "create collection c", 'c.insert { name: "again", n: 2 }'):
        engine.execute(text)
    return engine.execute("c.get { n >= 1 }").df


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = opened(spark, sf_dir, "orders")
    engine.execute("create index by_key on orders (o_orderkey)")
    texts = ["orders.get { o_orderkey == 7 and o_totalprice > 5.0 } | sort o_orderkey | limit 3", "orders.get { o_orderkey > 7 }", "orders.delete { o_orderkey == 1.5 }", "drop collection orders"]
    return spark.createDataFrame([(n, engine.execute("explain " + t).text) for n, t in enumerate(texts)], "n int, plan string")


_DISCOUNTED = "l_extendedprice * (1.0 - l_discount) > 30000.0"
_LI = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount"
_LI_SQL = "l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice, l_discount"
_NATION = "CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey"
_CUSTOMER = "c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment"
_PART = "p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice"
_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"

#: name -> (query, SQL)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "top_errors": (
        _get('events.get { event_type == "error" and value > 50.0 } | sort value desc, event_id | skip 5 | limit 10 | project event_id, user_id, value'),
        "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND value > 50 ORDER BY value DESC, event_id LIMIT 10 OFFSET 5",
    ),
    "scan_all": (_get("region.get {}"), "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region"),
    "filter_eq_str": (_get('customer.get { c_mktsegment == "BUILDING" }'), f"SELECT {_CUSTOMER} FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_single_equal_sign": (_get(f'orders.get {{ o_orderstatus = "F" }} | project {_ORDERS}'), f"SELECT {_ORDERS} FROM orders WHERE o_orderstatus = 'F'"),
    "filter_ne": (_get("nation.get { n_regionkey != 1 }"), f"SELECT {_NATION} FROM nation WHERE n_regionkey <> 1"),
    "filter_lt": (_get(f"lineitem.get {{ l_quantity < 10.0 }} | project {_LI}"), f"SELECT {_LI_SQL} FROM lineitem WHERE l_quantity < 10"),
    "filter_le": (_get(f"lineitem.get {{ l_quantity <= 3.0 }} | project {_LI}"), f"SELECT {_LI_SQL} FROM lineitem WHERE l_quantity <= 3"),
    "filter_gt": (_get("customer.get { c_acctbal > 9000.0 }"), f"SELECT {_CUSTOMER} FROM customer WHERE c_acctbal > 9000"),
    "filter_ge": (_get("part.get { p_size >= 45 }"), f"SELECT {_PART} FROM part WHERE p_size >= 45"),
    "filter_and_or_not": (
        _get(f'orders.get {{ o_orderstatus == "F" and not (o_totalprice < 100000.0 or o_custkey < 500) }} | project {_ORDERS}'),
        f"SELECT {_ORDERS} FROM orders WHERE o_orderstatus = 'F' AND NOT (o_totalprice < 100000 OR o_custkey < 500)",
    ),
    "precedence_mix": (
        _get("part.get { p_size == 1 or p_size > 40 and p_retailprice < 1200.0 }"),
        f"SELECT {_PART} FROM part WHERE p_size = 1 OR (p_size > 40 AND p_retailprice < 1200)",
    ),
    "contains_literal_list": (_get("part.get { [1, 5, 9] contains p_size }"), f"SELECT {_PART} FROM part WHERE p_size IN (1, 5, 9)"),
    "contains_array_column": (
        _users('users.get { tags contains "signup" } | project user_id, tags', lambda df: df.select("user_id", F.array_join("tags", ",").alias("tags"))),
        f"WITH {_USERS} SELECT user_id, array_to_string(tags, ',') AS tags FROM u WHERE list_contains(tags, 'signup')",
    ),
    "arith_add_sub_mul": (
        _get(f"lineitem.get {{ {_DISCOUNTED} }} | project {_LI}"),
        f"SELECT {_LI_SQL} FROM lineitem WHERE l_extendedprice * (1.0::DOUBLE - l_discount) > 30000.0::DOUBLE",
    ),
    "arith_int_div": (_get(f"orders.get {{ o_orderkey / 1000 == 4 }} | project {_ORDERS}"), f"SELECT {_ORDERS} FROM orders WHERE o_orderkey // 1000 = 4"),
    "arith_int_rem": (
        _get(f"orders.get {{ o_orderkey % 7 == 3 }} | project {_ORDERS}"),
        f"SELECT {_ORDERS} FROM orders WHERE o_orderkey % 7 = 3",
    ),
    "arith_add_values": (_get(f"orders.get {{ o_orderkey + o_custkey > 1200 }} | project {_ORDERS}"), f"SELECT {_ORDERS} FROM orders WHERE o_orderkey + o_custkey > 1200"),
    "arith_add_floats": (
        _get("lineitem.get { l_discount + l_tax > 0.125 } | project l_orderkey, l_linenumber, l_discount, l_tax"),
        "SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount + l_tax > 0.125::DOUBLE",
    ),
    "arith_float_div_rem": (
        _get("events.get { value / 3.0 > 10.0 and value % 7.0 < 2.5 } | project event_id, value"),
        "SELECT event_id, value FROM events WHERE value / 3.0::DOUBLE > 10 AND value % 7.0::DOUBLE < 2.5",
    ),
    "arith_negative_operands": (
        _get("customer.get { -c_custkey / 7 < -3 and -c_custkey % 7 < -2 and c_acctbal % 100.0 < -10.0 } | project c_custkey, c_acctbal"),
        "SELECT c_custkey, c_acctbal FROM customer WHERE -c_custkey // 7 < -3 AND -c_custkey % 7 < -2 AND c_acctbal % 100.0::DOUBLE < -10",
    ),
    "object_literal_equality": (
        _after('orders.update {} | set tag = { rest: o_orderkey % 5, kind: "x" }', 'orders.get { tag == { rest: 3, kind: "x" } and tag != { rest: 3, kind: "y" } and tag != { rest: 3 } } | project o_orderkey'),
        "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 3",
    ),
    "unary_minus_plus": (_get("customer.get { -c_acctbal > +100.0 }"), f"SELECT {_CUSTOMER} FROM customer WHERE -c_acctbal > 100"),
    "cross_kind_equal_is_false": (_get("part.get { p_size == 1.0 }"), f"SELECT {_PART} FROM part WHERE false"),
    "null_equality": (_users("users.get { note == null } | project user_id, note"), f"WITH {_USERS} SELECT user_id, note FROM u WHERE note IS NULL"),
    "not_null": (_users("users.get { note != null } | project user_id, note"), f"WITH {_USERS} SELECT user_id, note FROM u WHERE note IS NOT NULL"),
    "object_equality": (
        _users("users.get { stats.count > 60 and stats.even_last != null } | project user_id, stats.count", lambda df: df.select("user_id", F.col("stats.count").alias("n"))),
        f"WITH {_USERS} SELECT user_id, n FROM u WHERE n > 60 AND n % 2 = 0",
    ),
    "project_flat": (_get("events.get {} | project event_id, event_type"), "SELECT event_id, event_type FROM events"),
    "project_nested": (_props, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 9"),
    "project_missing_path": (_get("region.get {} | project r_name, nothing.here"), "SELECT r_name FROM region"),
    "sort_multi": (
        lambda s, d: _placed(opened(s, d, "customer"), "customer.get {} | sort c_mktsegment, c_acctbal desc, c_custkey"),
        f"SELECT {_CUSTOMER}, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) - 1 AS place FROM customer",
    ),
    "sort_desc_nulls": (
        lambda s, d: _placed(_tagged(s, d), "users.get {} | sort note desc, user_id | project user_id, note"),
        f"WITH {_USERS} SELECT user_id, note, row_number() OVER (ORDER BY note DESC NULLS LAST, user_id) - 1 AS place FROM u",
    ),
    "sort_then_sort_stable": (
        lambda s, d: _placed(opened(s, d, "customer"), "customer.get {} | sort c_acctbal | sort c_mktsegment"),
        f"SELECT {_CUSTOMER}, row_number() OVER (ORDER BY c_mktsegment, c_acctbal, c_custkey) - 1 AS place FROM customer",
    ),
    "skip_then_limit": (_get("part.get {} | skip 20 | limit 15"), f"SELECT {_PART} FROM part ORDER BY p_partkey LIMIT 15 OFFSET 20"),
    "limit_then_skip": (_get("part.get {} | limit 15 | skip 10"), f"SELECT * FROM (SELECT {_PART} FROM part ORDER BY p_partkey LIMIT 15) ORDER BY p_partkey OFFSET 10"),
    "project_before_sort_noop": (
        lambda s, d: _placed(opened(s, d, "part"), "part.get {} | project p_partkey, p_name | sort p_size desc"),
        "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part",
    ),
    "update_set_result": (
        _after(f'orders.update {{ o_orderstatus == "F" and o_totalprice > 1000.0 }} | set o_totalprice = o_totalprice * 1.5, flag = o_custkey % 10', f"orders.get {{ flag == 3 }} | project {_ORDERS}, flag"),
        f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 1.5::DOUBLE AS o_totalprice, o_orderpriority, o_custkey % 10 AS flag FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 AND o_custkey % 10 = 3",
    ),
    "update_limit": (
        _after('part.update { p_size < 10 } | sort p_retailprice desc, p_partkey | limit 25 | set p_brand = "TOP"', 'part.get { p_size < 10 }'),
        f"WITH top AS (SELECT p_partkey FROM part WHERE p_size < 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 25) SELECT p_partkey, p_name, CASE WHEN p_partkey IN (SELECT p_partkey FROM top) THEN 'TOP' ELSE p_brand END AS p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part WHERE p_size < 10",
    ),
    "delete_result": (_after("customer.delete { c_acctbal < 0.0 }", "customer.get {}"), f"SELECT {_CUSTOMER} FROM customer WHERE NOT (c_acctbal < 0)"),
    "delete_limit": (_after("part.delete {} | sort p_partkey | limit 100", "part.get {}"), f"SELECT {_PART} FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 100)"),
    "insert_result": (
        _after('region.insert { r_regionkey: 99, r_name: "ATLANTIS" }', "region.get {}"),
        "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region UNION ALL SELECT 99, 'ATLANTIS'",
    ),
    "index_scan": (
        _index("create index by_segment on customer (c_mktsegment)", lambda e: e.execute('customer.get { c_mktsegment == "MACHINERY" and c_acctbal > 0.0 }').df),
        f"SELECT {_CUSTOMER} FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0",
    ),
    "index_lookup": (
        _index("create index by_nation on supplier (s_nationkey)", lambda e: e.frame("supplier").df.join(e.lookup("by_nation", 7), "_id", "left_semi").select("s_suppkey", "s_name")),
        "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7",
    ),
    "index_range": (
        _index("create index by_total on orders (o_totalprice)", lambda e: e.lookup_range("by_total", 1000.0, 20000.0).select(F.col("key_float").alias("o_totalprice"))),
        "SELECT o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000",
    ),
    "index_verify": (
        _index("create index by_total on orders (o_totalprice)", lambda e: e.verify_index("by_total")),
        "SELECT 'x' AS fault, CAST(0 AS BIGINT) AS entries WHERE false",
    ),
    "index_faults": (
        _planted_faults,
        """SELECT 'document without an entry' AS fault, count(*) AS entries FROM orders WHERE o_custkey % 5 = 0
UNION ALL SELECT 'repeated entry', count(*) FROM orders WHERE o_custkey % 5 <> 0 AND o_custkey % 7 = 1
UNION ALL SELECT 'entry without a document', count(*) FROM orders WHERE o_custkey % 11 = 2""",
    ),
    "replace_delete_by_id": (
        _by_id,
        f"SELECT {_ORDERS.replace('o_orderpriority', _MARKED)} FROM orders WHERE o_orderkey % 4 <> 2",
    ),
    "drop_and_create": (_dropped, "SELECT 'again' AS name, 2::BIGINT AS n"),
    "explain_text": (
        _explained,
        "SELECT * FROM (VALUES (0::INTEGER, 'IndexScan(orders, by_key, Int64(7)) -> Filter -> Sort -> Limit'), (1, 'CollectionScan(orders) -> Filter'), (2, 'IndexScan(orders, by_key, Float64(OrderedF64(4609434218613702656))) -> Filter'), (3, 'Command')) t(n, plan)",
    ),
    "workload_global": (
        lambda s, d: _longs(analysis.totals(derived_events(s, d))),
        f"WITH {_EVENTS} SELECT count(*) AS total_events, count(*) FILTER (succeeded) AS successful_events, count(*) FILTER (NOT succeeded) AS failed_events, count(*) FILTER (access = 'command') AS command_executions, count(*) FILTER (access = 'collection_scan') AS collection_scans, count(*) FILTER (access = 'index_scan') AS index_scans, CAST(sum(examined) FILTER (succeeded) AS BIGINT) AS total_examined, CAST(sum(returned) FILTER (succeeded) AS BIGINT) AS total_returned, CAST(sum(elapsed_micros) FILTER (succeeded) AS BIGINT) AS total_elapsed_micros FROM e",
    ),
    "workload_by_fingerprint": (lambda s, d: _longs(analysis.by_fingerprint(derived_events(s, d))), f"WITH {_EVENTS} SELECT collection, fingerprint, {_SHAPE} FROM e GROUP BY 1, 2"),
    "workload_by_path": (
        lambda s, d: _longs(analysis.by_path(derived_events(s, d))),
        f"WITH {_EVENTS} SELECT collection, path, {_SHAPE} FROM (SELECT *, unnest([event_type, p]) AS path FROM e WHERE collection IS NOT NULL) GROUP BY 1, 2",
    ),
    "workload_candidates": (lambda s, d: _longs(analysis.candidates(derived_events(s, d))), f"WITH {_CANDIDATES} SELECT * FROM c"),
    "advisor_recommendations": (
        lambda s, d: _longs(_recommended(s, d)),
        f"WITH {_CANDIDATES} SELECT collection, path, successful_executions, collection_scans, index_scans, collection_scan_examined, collection_scan_returned, collection_scan_elapsed_micros, CAST({_RATIO} AS INTEGER) AS return_ratio FROM c WHERE successful_executions >= 3 AND collection_scans >= 3 AND collection_scan_examined >= 1 AND {_RATIO} <= 1000 AND (collection, path) NOT IN (('c0', 'click'), ('c3', 'view'))",
    ),
    "impact_evaluation": (lambda s, d: _longs(_impact(s, d)), _IMPACT),
    "recovery_redo": (
        lambda s, d: redo.recovered(_log(s, d)),
        f"WITH {_LOG} SELECT page_id, max(lsn) AS lsn, arg_max(image, lsn) AS image FROM log WHERE op = 'write' AND txn IN (SELECT txn FROM log WHERE op = 'commit') AND txn NOT IN (SELECT txn FROM log WHERE op = 'abort') GROUP BY page_id",
    ),
}

FLAGSHIP = "top_errors"



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q for n, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in QUERIES.items()}
