"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

The mix has as many words as all documents.  It is cut into slots of equal size; slot s takes the van der
Corput point of s (its bits reversed), and the point falls into one source's stretch of the cumulative
targets.  The slots of a source are ranked in schedule order; its k-th slot takes block k of the source's
stream: its documents in a hashed order, again in another order for every further epoch.  A document's
share is what the blocks taken cut out of it.

Every source gets its target within one block, whatever prefix of the schedule is looked at stays near
the weights, and no document is taken more than three times.  Ranks and prefix sums go by chunks, so a
source with a third of all rows is never in one task.

Defined results: null and wordless texts have size 0 and are never taken; a null source is a source of
its own, the last; repeated rows are documents of their own; without any words all targets are 0; an empty
table gives an empty result; only the id, text and source columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, staged, table

#: Words of a block (and slot).
BLOCK = 64
#: A document is taken so many times at most.
EPOCHS = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: Slots are counted in chunks of so many; shuffled documents in ranges of their hash's first hex digits.
_CHUNK = 4096
_DIGITS = 3
#: The unit interval is cut into so many cells, where slots meet the sources' stretches by an equi-join.
_CELLS = 1024


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) of every row."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, sid (its rank), source_size, weight, target: weights share all words; what a source cannot take
    (three times its size) the others share by weight, until none is above.

    With sources by rising capacity a weight unit, the capped ones are a prefix: prefix sums find the level at
    which the rest is full.  One row a source is ordered, never one a document."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(x) for x in WEIGHTS])
    ranked = by.withColumn("sid", F.row_number().over(order) - 1).withColumn("weight", F.element_at(w, (F.col("sid") % len(WEIGHTS) + 1).cast("int")))
    cap = (EPOCHS * F.col("source_size")).cast("long")
    up = Window.orderBy(F.col("source_size") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = (
        ranked.withColumn("cap", cap)
        .withColumn("all_words", F.sum("source_size").over(whole))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("cap_below", F.coalesce(F.sum("cap").over(up), F.lit(0)))
        .withColumn("weight_below", F.coalesce(F.sum("weight").over(up), F.lit(0)))
        .withColumn("level", (F.col("all_words") - F.col("cap_below")).cast("double") / (F.col("all_weight") - F.col("weight_below")))
        .withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
    )
    # the level of the first source that is not capped holds for all that are not
    level = F.min(F.when(~F.col("capped"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), "sid", "level"))).over(whole)["level"]
    return x.select("source", "sid", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight")).alias("target"))


def _bit_reversed(n: Column, bits: Column) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(n), bits, F.lit("0"))), 2, 10).cast("long")


def schedule(goals: DataFrame) -> DataFrame:
    """slot (its place in the mix), sid, rank: which source's which block each slot takes.

    Of the smallest power of two that has room, those points are used whose bit-reversed number is below
    the number of slots: in [0, slots) every grid point comes once, in van der Corput order."""
    spark = goals.sparkSession
    # one row comes to the driver: the number of words in the mix
    words = int(goals.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    slots = -(-words // BLOCK)
    bits = max(1, (slots - 1).bit_length()) if slots else 1
    grid = spark.range(0, (1 << bits) if slots else 0).select(F.col("id").alias("slot"), _bit_reversed(F.col("id"), F.lit(bits)).alias("g")).filter(F.col("g") < slots)
    points = grid.select("slot", ((F.col("g") + 0.5) / max(slots, 1)).alias("u"))
    run = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = goals.filter("target > 0").withColumn("hi", F.sum("target").over(run) / F.sum("target").over(total))
    share = share.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0)))
    # the last stretch reaches over the end, whatever rounding has left
    share = share.withColumn("hi", F.when(F.lead("sid").over(Window.orderBy("sid")).isNull(), F.lit(1.5)).otherwise(F.col("hi")))
    cell = lambda c: F.floor(c * _CELLS).cast("int")
    cells = share.select("sid", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), F.least(cell(F.col("hi")), F.lit(_CELLS)))).alias("cell"))
    hit = points.withColumn("cell", cell(F.col("u"))).join(cells, "cell").filter("u >= lo and u < hi").select("slot", "sid")
    hit = hit.withColumn("chunk", F.floor(F.col("slot") / _CHUNK))
    counts = hit.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    return hit.withColumn("k", within).join(before, ["sid", "chunk"]).select("slot", "sid", (F.col("before") + F.col("k")).alias("rank"))


def streams(rows: DataFrame) -> DataFrame:
    """rid, sid, lo, hi: where each document (sid, rid, name, size, source_size, epochs) stands in its source's stream,
    once an epoch; an epoch has an order of its own."""
    e = rows.filter("size > 0 and epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    e = e.withColumn("h", F.md5(F.concat_ws(":", "name", "epoch"))).withColumn("range", F.substring("h", 1, _DIGITS))
    sums = e.groupBy("sid", "epoch", "range").agg(F.sum("size").alias("n"))
    up = Window.partitionBy("sid", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0))).drop("n")
    inside = F.sum("size").over(Window.partitionBy("sid", "epoch", "range").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    placed = e.withColumn("inside", inside).join(sums, ["sid", "epoch", "range"])
    hi = F.col("epoch") * F.col("source_size") + F.col("before") + F.col("inside")
    return placed.select("rid", "sid", (hi - F.col("size")).alias("lo"), hi.alias("hi"))


def mixed(sizes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with rid, goals and size; schedule; rid, slot, first, words of every cut) of a staged table of
    doc_id, source, size, rid."""
    # repeated runs must agree, however rows are dealt: the id names a row, its number among equal ids the rest
    same = Window.partitionBy("doc_id", "source", "size").orderBy("rid")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sizes = sizes.withColumn("name", F.concat_ws(":", text("doc_id"), text("source"), text("size"), F.row_number().over(same).cast("string")))
    goals = staged(targets(sizes), "targets")
    rows = sizes.join(goals, sizes.source.eqNullSafe(goals.source)).select("doc_id", "rid", "name", "size", "sid", "source_size", "target")
    rows = staged(rows.withColumn("epochs", F.least(F.lit(EPOCHS), F.ceil((F.col("target") + 2 * BLOCK) / F.greatest("source_size", F.lit(1))).cast("int"))), "rows")
    plan = schedule(goals)
    first = F.floor(F.col("lo") / BLOCK)
    last = F.floor((F.col("hi") - 1) / BLOCK)
    pieces = streams(rows).withColumn("rank", F.explode(F.sequence(first, last)))
    begin = F.greatest("lo", F.col("rank") * BLOCK)
    part = F.least("hi", (F.col("rank") + 1) * BLOCK) - begin
    got = pieces.join(plan, ["sid", "rank"]).select("rid", "slot", (begin - F.col("lo")).alias("first"), part.alias("words"))
    return rows, plan, got


def _taken(rows: DataFrame, got: DataFrame) -> DataFrame:
    taken = got.groupBy("rid").agg(F.sum("words").alias("taken"))
    out = rows.join(taken, "rid", "left")
    return out.select("rid", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted) of every row."""
    rows, _, got = mixed(staged(sized(docs).withColumn("rid", F.monotonically_increasing_id()), "sizes"))
    return _taken(rows, got).drop("rid")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """What a trainer reads: doc_id, source, text, size, source_size, target, taken and blocks of every row.

    blocks tells which words of the text each slot of the mix takes: struct<slot, first, words>, by slot and first
    word; putting all blocks in the order of their slots gives the mix.  A row that the mix leaves out has none."""
    numbered = staged(docs.select("doc_id", "source", "text").withColumn("rid", F.monotonically_increasing_id()), "mix-texts")
    count = F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")
    rows, _, got = mixed(staged(numbered.select("doc_id", "source", count.alias("size"), "rid"), "sizes"))
    # a document has a bounded number of blocks: thrice its size in words
    blocks = got.groupBy("rid").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("slot", "first", "words"))).alias("blocks"))
    out = rows.select("rid", "size", "source_size", "target").join(blocks, "rid", "left").join(numbered, "rid")
    none = F.array().cast(dict(blocks.dtypes)["blocks"])
    return out.select("doc_id", "source", "text", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("blocks", none).alias("blocks"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract query: how much of every document the mix takes."""
    return mixed_rows(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The contract query in DuckDB SQL: the same targets, grid points and hashed orders; what a source's slots
    take is the beginning of its stream."""
    weights = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    return f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD_RE}')) AS BIGINT) AS size FROM documents),
r AS (SELECT *, concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(source, ''), CAST(size AS VARCHAR), CAST(row_number() OVER (PARTITION BY doc_id, source, size) AS VARCHAR)) AS name FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, {weights}[sid % {len(WEIGHTS)} + 1] AS weight, {EPOCHS} * source_size AS cap FROM s),
x AS (SELECT *, sum(source_size) OVER () AS all_words, sum(weight) OVER () AS all_weight,
  coalesce(sum(cap) OVER below, 0) AS cap_below, coalesce(sum(weight) OVER below, 0) AS weight_below FROM w
  WINDOW below AS (ORDER BY CAST(source_size AS DOUBLE) / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, CAST(all_words - cap_below AS DOUBLE) / CAST(all_weight - weight_below AS DOUBLE) AS level FROM x),
z AS (SELECT *, level * weight > cap AS capped FROM y),
l AS (SELECT arg_min(level, (CAST(source_size AS DOUBLE) / weight, sid)) FILTER (NOT capped) AS level FROM z),
t AS (SELECT sid, source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE l.level * weight END AS target FROM z, l),
c AS (SELECT *, sum(target) OVER (ORDER BY sid) / sum(target) OVER () AS hi, row_number() OVER (ORDER BY sid DESC) = 1 AS last FROM t WHERE target > 0),
b AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY sid), 0) AS lo, CASE WHEN last THEN 1.5 ELSE hi END AS up FROM c),
m AS (SELECT CAST(ceil(coalesce(sum(source_size), 0) / {BLOCK}.0) AS BIGINT) AS slots FROM s),
g AS (SELECT (range + 0.5::DOUBLE) / slots AS u FROM m, range(0, (SELECT slots FROM m))),
k AS (SELECT b.sid, count(*) * {BLOCK} AS words FROM g JOIN b ON g.u >= b.lo AND g.u < b.up GROUP BY b.sid),
e AS (SELECT r.*, t.sid, t.source_size, t.target, epoch, md5(r.name || ':' || epoch) AS h FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source, range(0, {EPOCHS}) q(epoch)),
p AS (SELECT *, epoch * source_size + sum(size) OVER (PARTITION BY sid, epoch ORDER BY h) AS hi FROM e)
SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(hi, coalesce(words, 0)) - (hi - size))) AS BIGINT) AS taken
FROM p LEFT JOIN k USING (sid) GROUP BY name, doc_id, size, source_size, target"""


ORACLE = _oracle()
