"""Near-duplicate documents by SetSketch registers.

A document's set holds the hashes of its distinct five-word shingles.  Register i keeps the minimum of an
exponential variable over the set, rounded down to a power of the base and truncated to two bytes: sketches
of parts merge by taking minima, and equal registers grow likelier with the Jaccard similarity.  The base is
close to 1, so that registers of unlike sets are hardly ever equal (one in 800).  Four
registers make a band; documents that share a band are candidates.  The similarity of a candidate pair is
first estimated jointly (with the known set sizes) by maximum likelihood from the registers that are
smaller, equal and larger; what survives is verified on the full sets.

No large bucket is expanded into all its pairs.  Equal sets are one node.  In each bucket every member is
first held against the bucket's first member; verified links give components.  Members of buckets that are
still in different components get a second, finer sketch with longer bands, which unlike texts hardly ever
share but linked ones do.  They are compared within those bands, in arrays: first each member gives its
likeliest partners, then, with what those have linked, all pairs that are left and not surely unlinked.
Buckets too large for that are divided by further bands first; members that then still share such a bucket with
another component are joined exactly, by the rare ends of their sets.

Defined results: a text without words (or null) has the empty set, is linked with nothing and is its own
component; a row without an id has no component id and is kept; rows that share an id are separate rows
that get the component of their own text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, arrays_of, byte_words, cached, discard, mix64, narrowed, released, settle, staged, without

WIDTH = 5
BASE = 1.005
#: Registers are floors of -log_BASE of minima between 1e-14 and 54; two bytes hold them.
_LOW = -800


@dataclass(frozen=True)
class Config:
    bands: int = 24
    rows: int = 4
    #: Least similarity, in hundredths of intersection over union.
    percent: int = 75
    #: Candidates whose estimate is lower are not verified: the threshold less four standard errors.
    floor: float = 0.55

    @property
    def registers(self) -> int:
        return self.bands * self.rows


#: The finer sketch: one in ten pairs at the threshold share a given band; 88 bands miss one pair in ten thousand.
FINE = Config(bands=88, rows=8)
#: So many of its registers are carried along to compare members; their estimate's standard error is 0.019.
CARRIED = 528
#: Below this estimate a pair of members is not linked, above the other it surely is (four standard errors).
NOT_LINKED, SURELY = 0.675, 0.825
#: Members of a bucket that are compared in one place; larger buckets are compared chunk by chunk.
CHUNK = 1024
#: Buckets with more members are divided by further bands, what is left of them is joined by shingles.
LARGE = 64 * CHUNK


def _hash_words() -> object:
    import xxhash

    class Words(dict):
        def __missing__(self, w: bytes) -> int:
            if len(self) > 120_000:
                self.clear()
            h = self[w] = xxhash.xxh3_64_intdigest(w)
            return h

    return Words()


def shingle_set(text: str | None, hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; of the whole sequence if it is shorter."""
    words = byte_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    n = max(len(h) - WIDTH + 1, 1)
    acc = np.zeros(n, np.uint64)
    used = min(len(h), WIDTH)
    for k in range(used):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(mix64(acc + np.uint64(used)))


@cached
def _register_seeds(n: int) -> np.ndarray:
    return arrays_of(0xBEEF, n) | np.uint64(1)


def registers(s: np.ndarray, n: int) -> np.ndarray:
    """n two-byte registers of a non-empty set.

    Minima of uniform hashes u give minima of the exponential -log(1-u), which grow with u."""
    seeds = _register_seeds(n)
    low = np.empty(n, np.uint64)
    step = max(64, 65_536 // n)  # a block of hashes stays in the cache
    for k in range(0, len(s), step):
        part = s[k : k + step]
        # odd multipliers permute the 64-bit words; the fold brings low bits into the order
        m = (part ^ (part >> np.uint64(29)))[None, :] * seeds[:, None]
        m ^= m >> np.uint64(32)
        m *= np.uint64(0xD6E8FEB86659FD93)
        top = m.min(axis=1)
        low = top if not k else np.minimum(low, top)
    e = -np.log1p(-np.minimum((low.astype(np.float64) + 0.5) / 2.0**64, 1 - 1e-16))
    k = np.floor(-np.log(np.maximum(e, 1e-14)) / np.log(BASE))
    return np.clip(k - _LOW, 0, 65_535).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


_GRID = np.linspace(0, 1, 201)


def likely_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs (rows of registers), given the sizes of the sets."""
    bigger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - bigger - smaller
    u = na / (na + nb)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    top = np.minimum(u / v, v / u)
    j = _GRID[None, :] * top[:, None]
    # a's register exceeds b's if its minimum comes from a alone, and so on
    pa = np.clip(p(u[:, None] - v[:, None] * j), 1e-9, 1)
    pb = np.clip(p(v[:, None] - u[:, None] * j), 1e-9, 1)
    pe = np.clip(1 - pa - pb, 1e-9, 1)
    best = (bigger[:, None] * np.log(pa) + smaller[:, None] * np.log(pb) + equal[:, None] * np.log(pe)).argmax(axis=1)
    return np.take_along_axis(j, best[:, None], 1)[:, 0]


def _signature(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def sketches(docs: DataFrame, cfg: Config = Config(), with_sets: bool = False) -> DataFrame:
    """doc_id, n_shingles, sig (of the set; null if empty), regs and keys (a hash of each band) of every row,
    and the set itself if asked for."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    kind = docs.schema["doc_id"].dataType.simpleString()
    nr, rows = cfg.registers, cfg.rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _hash_words()
        mult = arrays_of(0xFACE, rows)
        salt = arrays_of(0xF00D, nr // rows)
        for b in batches:
            n, sig, regs, keys, sets = [], [], [], [], []
            for text in b["text"]:
                s = shingle_set(text, hashes)
                n.append(len(s))
                sets.append(s.tobytes() if with_sets else None)
                if not len(s):
                    sig.append(None), regs.append(None), keys.append([])
                    continue
                r = registers(s, nr)
                sig.append(_signature(s))
                regs.append(r.tobytes())
                k = mix64((r.reshape(-1, rows).astype(np.uint64) * mult).sum(axis=1, dtype=np.uint64) + salt)
                keys.append(k.view(np.int64))
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_shingles": n, "sig": sig, "regs": regs, "keys": keys, **({"items": sets} if with_sets else {})})

    schema = f"doc_id {kind}, n_shingles long, sig binary, regs binary, keys array<long>" + (", items binary" if with_sets else "")
    return docs.select("doc_id", "text").mapInPandas(released(run), schema)


def _estimated(pairs: DataFrame, nodes: DataFrame, cfg: Config) -> DataFrame:
    """The pairs (a, b) of nodes whose likely similarity reaches the floor."""
    nr, floor = cfg.registers, cfg.floor

    @F.pandas_udf("boolean")
    def likely(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(ra):
            return pd.Series([], dtype=bool)
        x = np.frombuffer(b"".join(ra), np.uint16).reshape(-1, nr)
        y = np.frombuffer(b"".join(rb), np.uint16).reshape(-1, nr)
        return pd.Series(likely_jaccard(x, y, na.to_numpy(float), nb.to_numpy(float)) >= floor)

    left = nodes.select(F.col("sig").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na"))
    right = nodes.select(F.col("sig").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(likely("ra", "rb", "na", "nb")).select("a", "b")


def _texts_of(docs: DataFrame, nodes: DataFrame, needed: DataFrame) -> DataFrame:
    """sig and text of the needed nodes' first rows (rows that share an id may bring other texts along)."""
    wanted = needed.join(nodes.select("sig", "first_id"), "sig").select("sig", F.col("first_id").alias("doc_id"))
    wanted = staged(wanted, "wanted")
    return narrowed(docs.select("doc_id", "text"), "doc_id", wanted).join(wanted, "doc_id").select("sig", "text")


def _full_sets(docs: DataFrame, nodes: DataFrame, needed: DataFrame) -> DataFrame:
    """sig and full set of every needed node, computed again from the text of its first row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _hash_words()
        for b in batches:
            sets = [shingle_set(t, hashes) for t in b["text"]]
            sigs = [_signature(s) for s in sets]
            out = pd.DataFrame({"sig": sigs, "items": [s.tobytes() for s in sets]})
            # rows that share an id may have other texts
            yield out[[x == y for x, y in zip(sigs, b["sig"], strict=True)]]

    return _texts_of(docs, nodes, needed).mapInPandas(released(run), "sig binary, items binary").groupBy("sig").agg(F.first("items").alias("items"))


def _verified(pairs: DataFrame, sets: DataFrame, cfg: Config) -> DataFrame:
    """The pairs that are linked by their full sets (sig, items)."""
    percent = cfg.percent

    @F.pandas_udf("boolean")
    def linked(sa: pd.Series, sb: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(sa, sb, strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    left, right = (sets.select(F.col("sig").alias(c), F.col("items").alias(f"s{c}")) for c in "ab")
    return staged(pairs.join(left, "a").join(right, "b").filter(linked("sa", "sb")).select("a", "b"), "links")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (u, v) -> for each batch of them, every node's edge to the smallest node that the batch connects it with."""
    for b in batches:
        up: dict = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in zip(b["u"], b["v"], strict=True):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        rows = [(x, r) for x in up if (r := find(x)) != x]
        yield pd.DataFrame(rows, columns=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for every node of links(a, b).

    Alternating stars: each node's larger neighbours are hung on its smallest one, then its smaller ones,
    until nothing changes; batches of edges are made stars where they are, first.  A node of any degree is met by
    aggregation and an equi-join only."""
    first = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    edges = staged(first.mapInPandas(_forest, first.schema).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first: a join of two tables can be split where a node has very many neighbours
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        # large star: larger neighbours to the smallest of node and neighbours
        large = staged(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        # small star: the node and its smaller neighbours to the smallest of those
        low2 = staged(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        multi = low2.filter("n > 1").select("u", "m")
        moved = large.join(multi, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = staged(low2.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), "edges")
        # a star forest: every node has one neighbour, which has none above it
        twice = nxt.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u").limit(1)
        chained = nxt.select("v").join(nxt.select(F.col("u").alias("v")), "v", "left_semi").limit(1)
        again = twice.unionByName(chained.toDF("u")).limit(1).count()
        discard(edges, large, low, low2)
        edges = nxt
        if not again:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def _buckets(finer: DataFrame, large: int) -> tuple[DataFrame, DataFrame | None]:
    """sig, comp, key, path (the bands of the key), size of every member of a fine bucket that mixes components;
    and sig, key of the members of buckets of more than large, if there are any.

    Those are divided by every later band that their members share, and so on.  Two texts that share the band and
    no other do not meet there: _rest_pairs is for them."""
    kept = crowds = None
    rows = finer.select("sig", "comp", F.posexplode("keys").alias("band", "key")).select("sig", "comp", "key", F.array("band").alias("path"))
    while True:
        # a bucket can only tell what it has in common with another component
        sizes = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi").select("key", "size")
        sizes = staged(sizes, "bucket-sizes")
        some = rows.join(sizes, "key")
        small = some.filter(F.col("size") <= large)
        kept = small if kept is None else kept.unionByName(small)
        if not sizes.filter(F.col("size") > large).limit(1).count():
            return kept, crowds
        if crowds is None:
            crowds = staged(some.filter(F.col("size") > large).select("sig", "key"), "crowds")
        last = F.element_at("path", -1)
        more = some.filter(F.col("size") > large).select("sig", "comp", "key", "path").withColumnRenamed("key", "k0").join(finer.select("sig", "keys"), "sig")
        later = more.select("sig", "comp", "k0", "path", last.alias("last"), F.posexplode("keys").alias("band", "k")).filter("band > last")
        rows = staged(later.select("sig", "comp", F.xxhash64("k0", "k").alias("key"), F.concat("path", F.array("band")).alias("path")), "sub-buckets")


def _crowd_pairs(buckets: DataFrame, finer: DataFrame, cfg: Config, best: bool, trust: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Pairs (a, b, sure) of finer(sig, n, comp, keys, regs) worth verifying: members of a finer band (of _buckets)
    that are in different components and likely linked; if best, just each member's likeliest partner in the bucket.

    Each bucket is compared where it is, in arrays; only pairs come out, and of surely linked ones (if these are
    trusted) only what joins components, so a bucket gives about as many pairs as it has members."""
    rows = buckets.join(finer.select("sig", "n", "regs"), "sig")
    # a large bucket's members meet chunk by chunk: (i, j) with i <= j
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    own = F.pmod(F.xxhash64("sig"), chunks).cast("int")
    others = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    dealt = rows.withColumn("own", own).withColumn("cell", F.explode(others)).select("key", "path", "cell.i", "cell.j", "own", "sig", "comp", "n", "regs")
    order = ["key", "i", "j", "sig"]
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions(*order)
    percent = cfg.percent

    def compare(b: pd.DataFrame) -> list[tuple[bytes, bytes, bool]]:
        r = np.frombuffer(b"".join(b["regs"]), np.uint16).reshape(len(b), -1)
        n = b["n"].to_numpy(float)
        sig = list(b["sig"])
        comp = pd.factorize(b["comp"])[0]
        part = b["own"].to_numpy()
        apart = b["i"].iloc[0] != b["j"].iloc[0]
        path = [int(x) for x in b["path"].iloc[0]]
        earlier = [k for k in range(min(path[-1], r.shape[1] // FINE.rows)) if k not in path]
        bands = r.reshape(len(b), -1, FINE.rows)[:, earlier]
        hits = []
        least = (NOT_LINKED - 0.02) * r.shape[1]
        for x in range(len(b) - 1):
            ys = x + 1 + np.flatnonzero((comp[x + 1 :] != comp[x]) & (100 * np.minimum(n[x + 1 :], n[x]) >= percent * np.maximum(n[x + 1 :], n[x])))
            if apart:
                ys = ys[part[ys] != part[x]]
            if len(ys):
                ys = ys[(r[ys] == r[x]).sum(axis=1) >= least]
            if len(ys) and earlier:
                # a pair that shares an earlier band has met there
                ys = ys[~(bands[ys] == bands[x]).all(axis=2).any(axis=1)]
            if len(ys):
                j = likely_jaccard(np.broadcast_to(r[x], (len(ys), r.shape[1])), r[ys], np.full(len(ys), n[x]), n[ys])
                hits += [(-q, x, y) for q, y in zip(j.tolist(), ys.tolist(), strict=True) if q >= NOT_LINKED]
        if best:
            top: dict[int, tuple] = {}
            for h in hits:
                for z in h[1:]:
                    if z not in top or h < top[z]:
                        top[z] = h
            hits = set(top.values())
        root = list(range(int(comp.max()) + 1))

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for q, x, y in sorted(hits):
            u, v = find(comp[x]), find(comp[y])
            if u == v:
                continue
            sure = -q >= SURELY
            out.append((min(sig[x], sig[y]), max(sig[x], sig[y]), sure))
            if sure and trust:
                root[u] = v
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        at = None

        def close() -> pd.DataFrame:
            group = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            return pd.DataFrame(compare(group), columns=["a", "b", "sure"])

        for b in batches:
            b = b.reset_index(drop=True)
            new = np.flatnonzero((b[["key", "i", "j"]] != b[["key", "i", "j"]].shift()).any(axis=1))
            for lo, hi in zip(new, [*new[1:], len(b)], strict=True):
                part = b.iloc[lo:hi]
                key = (part["key"].iloc[0], part["i"].iloc[0], part["j"].iloc[0])
                if at is not None and key != at:
                    yield close()
                    held = []
                at = key
                held.append(part)
        if held:
            yield close()

    return dealt.mapInPandas(released(run), "a binary, b binary, sure boolean")


def _rest_pairs(crowds: DataFrame, members: DataFrame, sets: DataFrame, cfg: Config, chunk: int = CHUNK) -> DataFrame:
    """Pairs (a, b) of members(sig, n, comp) that may be linked, are in different components and in buckets that
    still mix components, of crowds(sig, key).  No linked pair is left out.

    All sets are put in one order, rare shingles first.  What two sets share is at or after their first common
    shingle, so both have as many shingles from there on as a link needs: they meet in the bin of that shingle, which
    is one of the rare ones of either.  Common shingles, of which large buckets are made, open no bin."""
    percent = cfg.percent

    @F.pandas_udf("array<long>")
    def shingles(items: pd.Series) -> pd.Series:
        return items.map(lambda x: np.frombuffer(x, np.int64))

    inside = crowds.join(members, "sig")
    mixed = inside.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    some = staged(inside.join(mixed, "key", "left_semi").select("sig", "n", "comp").distinct(), "rest")
    words = staged(some.join(sets, "sig").select("sig", "n", "comp", F.explode(shingles("items")).alias("shingle")), "shingles")
    often = words.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    # a shingle of one set alone comes before all others and is never shared: only the others are counted, from the end
    order = Window.partitionBy("sig").orderBy(F.desc("often"), F.desc("shingle"))
    placed = words.join(often, "shingle").withColumn("left", F.row_number().over(order).cast("long"))
    # the first common shingle leaves that much in a set whose partner is no smaller, or smaller (of the larger set)
    placed = staged(placed.filter(F.col("left") * 100 >= F.col("n") * percent).withColumn("leads", F.col("left") * (100 + percent) >= F.col("n") * (2 * percent)), "prefixes")
    bins = placed.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), F.max("leads").alias("leads"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    bins = bins.filter("leads and lo <> hi").select("shingle", F.ceil(F.col("size") / chunk).cast("int").alias("cells"))
    met = staged(placed.join(bins, "shingle"), "bins")
    # a large bin's leading sets are spread over cells, its others come to each
    x = met.filter("leads").select("shingle", F.pmod(F.xxhash64("sig"), "cells").cast("int").alias("cell"), *(F.col(c).alias(f"x_{c}") for c in ("sig", "n", "comp", "left")))
    y = met.select("shingle", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), *(F.col(c).alias(f"y_{c}") for c in ("sig", "n", "comp", "left")))
    both = x.join(y, ["shingle", "cell"]).filter("x_comp <> y_comp and (x_n < y_n or x_n = y_n and x_sig < y_sig)")
    both = both.filter(F.least("x_left", "y_left") * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent)
    pairs = staged(both.select(F.least("x_sig", "y_sig").alias("a"), F.greatest("x_sig", "y_sig").alias("b")).distinct(), "rest-pairs")
    discard(some, words, placed, met)
    return pairs


def _joined_comps(members: DataFrame, comp: DataFrame) -> DataFrame:
    """members(sig, ..) with their component, comp; a member without links is its own."""
    return members.join(comp.toDF("sig", "comp"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))


def near_duplicates(docs: DataFrame, cfg: Config = Config(), chunk: int = CHUNK, large: int = LARGE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    full = staged(sketches(docs, cfg), "sketches")
    nodes = staged(
        full.filter("sig is not null").groupBy("sig").agg(F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.first("keys").alias("keys"), F.min("doc_id").alias("first_id")),
        "nodes",
    )
    rows = staged(full.select("doc_id", "n_shingles", "sig"), "rows")
    discard(full)
    banded = nodes.select("sig", "n", F.posexplode("keys").alias("band", "key")).select("sig", "n", "key")
    # one member's struct a bucket: the smallest signature leads; buckets of one go
    tops = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("sig", "n")).alias("lead")).filter("size > 1").drop("size")
    shared = staged(banded.join(tops, "key"), "buckets")
    settle(spark)
    ratio = lambda x, y: (F.least(x, y) * 100) >= (F.greatest(x, y) * cfg.percent)
    star = shared.filter((F.col("sig") != F.col("lead.sig")) & ratio(F.col("n"), F.col("lead.n"))).select(F.col("lead.sig").alias("a"), F.col("sig").alias("b")).distinct()
    candidates = staged(_estimated(star, nodes, cfg), "candidates")
    slim = staged(nodes.select("sig", "first_id"), "node-ids")
    discard(nodes)
    sets = staged(_full_sets(docs, slim, _ends(candidates)), "sets")
    links = _verified(candidates, sets, cfg)
    discard(sets)
    settle(spark)
    comp = staged(components(links), "components")
    placed = staged(_joined_comps(shared.select("key", "sig", "n"), comp), "placed")
    discard(shared)
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    apart = staged(placed.join(mixed, "key").groupBy("sig").agg(F.first("n").alias("n"), F.first("comp").alias("comp")), "apart")
    discard(placed)
    settle(spark)
    fine = sketches(_texts_of(docs, slim, apart.select("sig")).withColumnRenamed("sig", "doc_id"), FINE, with_sets=True).filter("doc_id = sig")
    fine = staged(fine.select("sig", "keys", F.substring("regs", 1, 2 * CARRIED).alias("regs"), "items").dropDuplicates(["sig"]), "fine")
    tried = candidates.withColumn("sure", F.lit(False))
    crowds = None
    for best, trust in ((True, True), (False, True), (False, False)):
        finer = fine.select("sig", "keys", "regs").join(apart, "sig")
        if not trust:
            # an estimate that seemed sure joined what its full sets do not: its buckets are compared without such trust
            refused = staged(_ends(tried.filter("sure").join(links, ["a", "b"], "left_anti")), "refused")
            if not refused.limit(1).count():
                break
            keys = fine.join(refused, "sig", "left_semi").select(F.explode("keys").alias("key")).distinct()
            near = finer.select("sig", F.explode("keys").alias("key")).join(keys, "key", "left_semi").select("sig").distinct()
            finer = finer.join(near, "sig", "left_semi")
        buckets, divided = _buckets(finer, large)
        crowds = divided if crowds is None else crowds
        found = _crowd_pairs(buckets, finer, cfg, best, trust, chunk).groupBy("a", "b").agg(F.max("sure").alias("sure"))
        pairs = staged(found.join(tried, ["a", "b"], "left_anti"), "pairs")
        more = _verified(pairs.select("a", "b"), fine, cfg)
        settle(spark)
        tried = tried.unionByName(pairs)
        if more.limit(1).count():
            links = links.unionByName(more)
            old, comp = comp, staged(components(links), "components")
            discard(old)
            apart = staged(_joined_comps(apart.drop("comp"), comp), "apart")
    if crowds is not None:
        pairs = _rest_pairs(crowds, apart, fine.select("sig", "items"), cfg, chunk)
        more = _verified(pairs.join(tried, ["a", "b"], "left_anti"), fine, cfg)
        discard(pairs, crowds)
        settle(spark)
        if more.limit(1).count():
            links = links.unionByName(more)
            old, comp = comp, staged(components(links), "components")
            discard(old)
    discard(fine)
    # a component's name is the smallest id of any of its rows
    named = staged(_joined_comps(slim, comp), "named")
    ids = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    names = staged(named.join(ids, "comp").select("sig", "component_id"), "names")
    discard(named, comp, slim, links, candidates)
    settle(spark)
    found = rows.join(names, "sig", "left")
    component = F.when(F.col("sig").isNull(), F.col("doc_id")).when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_neardup(spark, sf_dir: str) -> DataFrame:
    """Contract query: each document's component of near duplicates."""
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Pipeline decision: one document of each group stays, the one with the smallest id; repeated rows of that
    id stay once, rows without an id all stay.  Only documents that go or are repeated are moved."""
    by_id = near_duplicates(docs, cfg).filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    special = staged(by_id.filter("not kept or n > 1"), "special")
    repeated = special.filter("kept").select("doc_id")
    once = narrowed(docs, "doc_id", repeated).join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return without(docs, "doc_id", special).unionByName(once)


#: The contract query in DuckDB SQL: all pairs that share a shingle, and the closure of their links.
ORACLE = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_RE}') AS w FROM documents),
g AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + {WIDTH - 1}], ' ') for i in generate_series(1, len(w) - {WIDTH - 1})]) END AS g FROM d),
n AS (SELECT rid, doc_id, len(g) AS n FROM g),
s AS (SELECT rid, unnest(g) AS s FROM g),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON p.x = a.rid JOIN n b ON p.y = b.rid WHERE 100 * c >= {Config().percent} * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x AS rid, min(doc_id) AS low FROM r JOIN n ON r.y = n.rid GROUP BY x)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept FROM n LEFT JOIN m USING (rid)"""
