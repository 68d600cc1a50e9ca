"""Document fingerprints by a randomised edit embedding.

A walk reads the text from the left: at step j it writes the character under it and moves on or stays, as
a random bit of (j, character) says.  All texts share these bits, so two texts at a small edit distance
walk together again soon after each edit, and the edit distance shows as the Hamming distance of what the
walks wrote.  A fingerprint keeps two things of a walk.  Samples: what was written at fixed steps, all of the
first 64, then so many of each doubling stretch; banding takes fixed runs of them as keys.  Counters: in every
longer stretch each single step adds +1 or -1 to one of 32 counters, by a hash of the step and the character; the
squared distance of two such rows of counters estimates on how many steps of the stretch the walks differ, and a
single differing step shows (a checksum of the text tells what the counters miss).  A fingerprint grows with the logarithm of the length, is comparable for texts of any
lengths, and equal for equal texts.  Candidates are verified by the exact edit distance.

Defined results: null counts as the empty text; the empty text's fingerprint is the empty string, alike
(1.0) to another empty one and unlike (0.0) to any other; repeated rows give repeated fingerprints; an
empty table gives an empty result; ids may have any type that has an order; other columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrays_of, cached, hash_below, mix64, released, staged

#: Steps kept of each stretch [2^k, 2^(k+1)) of the walk, k >= 6; shorter stretches are kept whole.
SAMPLES = 64
#: Counters of each stretch that is not kept whole, from the first such level on.
COUNTERS, FIRST = 32, 7
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
_SEED = 0x5EED
#: The random bits repeat after so many steps.
PERIOD = 1 << 16
_CLASSES = 30
#: Bands, and the places of the samples that a band takes.
BANDS, WIDTH = 24, 6
#: Edits a character within which texts are near.
MAX_EDITS = 0.02
#: Characters that are walked at a stretch: even at the longest stay they take less than a period.
_CHUNK = 2048


@cached
def _steps(level: int) -> np.ndarray:
    """The kept steps of stretch level, ascending; level 0 is step 1."""
    lo, n = 1 << level, 1 << level
    if n <= SAMPLES:
        return np.arange(lo, lo + n)
    # one step in each of SAMPLES equal parts of the stretch
    part = n // SAMPLES
    return lo + np.arange(SAMPLES) * part + (arrays_of(_SEED + level, SAMPLES) % np.uint64(part)).astype(np.int64)


@cached
def _stays() -> list[bytes]:
    """For each of 30 classes of characters: how many steps a walk stays at one that it has reached at step j
    (modulo the period; two periods in a row)."""
    bits = mix64(np.arange(PERIOD, dtype=np.uint64) + np.uint64(0xC0FFEE)) >> np.uint64(34)
    out = []
    for c in range(_CLASSES):
        moves = np.flatnonzero(np.tile((bits >> np.uint64(c)) & np.uint64(1), 3))
        j = np.arange(2 * PERIOD)
        stay = moves[np.searchsorted(moves, j)] - j + 1
        out.append(np.minimum(stay, PERIOD // _CHUNK - 1).astype(np.uint8).tobytes())
    return out


@cached
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: its class for the moves, the nibble that is written for it, and 32 random bits."""
    mixed = mix64(np.arange(0x110000, dtype=np.uint64) + np.uint64(77))
    return (mixed % np.uint64(_CLASSES)).astype(np.uint8), ((mixed >> np.uint64(32)) & np.uint64(15)).astype(np.uint8), (mixed >> np.uint64(8)).astype(np.uint32)


@cached
def _step_bits() -> np.ndarray:
    return (mix64(np.arange(PERIOD, dtype=np.uint64) + np.uint64(0xFADE)) >> np.uint64(16)).astype(np.uint32)


def walk(codes: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """The step after which the walk leaves each character (code points); known: these steps of the first ones."""
    rows = _stays()
    b = _classes()[0][codes].tobytes()
    known = np.zeros(0, np.int64) if known is None else known
    at = int(known[-1]) if len(known) else 0
    out = [known]
    for lo in range(len(known), len(b), _CHUNK):
        j = first = at % PERIOD
        got = array("q", [j := j + row[j] for row in map(rows.__getitem__, b[lo : lo + _CHUNK])])
        out.append(np.frombuffer(got, np.int64) + (at - first))
        at += j - first
    return np.concatenate(out)


def _digits(level: int) -> int:
    """Hex digits of a counter: enough for what the counters of like texts differ by (they are kept modulo 16^digits)."""
    return 2 if level < 14 else 3 if level < 20 else 4


@cached
def _kept(level: int) -> np.ndarray:
    """All kept steps before stretch level."""
    return np.concatenate([np.zeros(1, np.int64), *(_steps(k) for k in range(level))])


@cached
def _hex_words(width: int) -> np.ndarray:
    return np.array([f"{v:0{width}x}" for v in range(16**width)])


def print_of(codes: np.ndarray, ends: np.ndarray) -> str:
    """The fingerprint of a text from its walk: samples, each longer stretch's counters and a checksum, by dots."""
    if not len(codes):
        return ""
    _, nibble, bits = _classes()
    total = int(ends[-1])
    kept = _kept((total - 1).bit_length())
    kept = kept[: np.searchsorted(kept, total)]
    parts = [_HEX[nibble[codes[np.searchsorted(ends, kept, side="right")]]].tobytes().decode(), "."]
    acc: dict[int, np.ndarray] = {}
    stays = np.diff(ends, prepend=0) if total > 1 << FIRST else None
    char_bits, step_bits = bits[codes], _step_bits()
    for at in range(1 << FIRST, total, PERIOD):  # so much at once, however long the text
        to = min(at + PERIOD, total)
        first, last = np.searchsorted(ends, [at, to - 1], side="right")
        many = stays[first : last + 1].copy()
        many[-1] = to - (int(ends[last - 1]) if last else 0)
        many[0] = min(int(ends[first]), to) - at
        h = np.repeat(char_bits[first : last + 1], many)
        shift = at % PERIOD
        h ^= step_bits[shift : shift + len(h)] if shift + len(h) <= PERIOD else np.concatenate([step_bits[shift:], step_bits[: shift + len(h) - PERIOD]])
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        h >>= np.uint32(26)
        while at < to:
            level = at.bit_length() - 1
            end = min(2 << level, to)
            n = np.bincount(h[: end - at], minlength=2 * COUNTERS)
            acc[level] = acc.get(level, 0) + n[:COUNTERS] - n[COUNTERS:]
            h, at = h[end - at :], end
    for level, v in acc.items():
        width = _digits(level)
        parts += _hex_words(width)[v % 16**width].tolist() if width < 4 else [f"{x:04x}" for x in (v % 16**4).tolist()]
    return "".join(parts) + f".{zlib.crc32(codes.tobytes()):08x}"


def samples_of(fp: str) -> str:
    return fp.partition(".")[0]


def _counters(fp: str) -> dict[int, np.ndarray]:
    """The counters of each level."""
    raw = fp.split(".")[1] if fp else ""
    digits = np.frombuffer(raw.encode(), np.uint8).astype(np.int32)
    digits -= np.where(digits >= 97, 87, 48)
    at, level, got = 0, FIRST, {}
    while at < len(digits):
        width = _digits(level)
        rows = digits[at : at + COUNTERS * width].reshape(COUNTERS, width)
        value = rows[:, 0]
        for k in range(1, width):
            value = value * 16 + rows[:, k]
        got[level] = value
        at, level = at + COUNTERS * width, level + 1
    return got


@cached
def _weights(n: int) -> np.ndarray:
    """How many steps of the walk each of the first n kept steps stands for."""
    w = [np.ones(1)]
    level, have = 0, 1
    while have < n:
        s = len(_steps(level))
        w.append(np.full(s, (1 << level) / s))
        have += s
        level += 1
    return np.concatenate(w)[:n]


@cached
def _first_of(level: int) -> int:
    """How many kept steps come before a stretch."""
    return 1 + sum(len(_steps(k)) for k in range(level))


def likeness(a: str, b: str) -> float:
    """Share of the longer walk on which both wrote the same, freed of chance hits of 1 in 16.

    Stretches that are kept whole are counted; of the others the samples tell the share with the error of their
    number, the counters with an error in proportion to the difference: both are weighed by that."""
    if a == b:
        return 1.0
    s, t = samples_of(a), samples_of(b)
    n, m = max(len(s), len(t)), min(len(s), len(t))
    if not m:
        return 0.0
    w = _weights(n)
    differ = np.ones(n)
    differ[:m] = np.frombuffer(s[:m].encode(), np.uint8) != np.frombuffer(t[:m].encode(), np.uint8)
    lost = w * differ
    whole = _first_of(FIRST)
    off = float(lost[:whole].sum())
    ca, cb = _counters(a), _counters(b)
    level = FIRST
    while _first_of(level) < n:
        part = slice(_first_of(level), _first_of(level + 1))
        steps = float(w[part].sum())
        share = float(lost[part].sum()) / steps
        if level in ca and level in cb:
            ring = 16 ** _digits(level)
            d = (ca[level] - cb[level] + ring // 2) % ring - ring // 2
            counted = min(1.0, float((d * d).sum()) / 2 / steps)
            mean = (share + counted) / 2
            share = (counted * (1 - mean) + share * 2 * mean) / (1 + mean)
        off += share * steps
        level += 1
    same = 1 - off / float(w.sum())
    return min(max(0.0, (same - 1 / 16) / (15 / 16)), 1 - 1e-12)


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) if text else np.zeros(0, np.uint32)


def fingerprint_of(texts: list[str | None]) -> list[str]:
    codes = [code_points(t) for t in texts]
    return [print_of(c, walk(c)) for c in codes]


def _sized_batches(batches: Iterator[pd.DataFrame], col: str, chars: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Cut batches so that each holds about so many characters at most (or a single row)."""
    for b in batches:
        size = b[col].map(lambda t: len(t) if t else 0).cumsum() // chars
        for _, part in b.groupby(size, sort=False):
            yield part


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, fingerprint of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _sized_batches(batches, text_col):
            texts = list(b[text_col])
            yield pd.DataFrame({id_col: b[id_col].values, "n_chars": [len(t or "") for t in texts], "fingerprint": fingerprint_of(texts)})

    return docs.select(id_col, text_col).mapInPandas(released(run), f"{id_col} {kind}, n_chars long, fingerprint string")


def band_keys(fp: str, bands: int = BANDS, width: int = WIDTH) -> list[str]:
    """Keys of fixed bit samples: each takes so many places of the samples, drawn below 64, 256 and the largest power
    of two that fits (and below half of that, where texts a little shorter or longer have the same places).

    An edit sets the walks apart for a while, so the first places agree the longest."""
    fp = samples_of(fp)
    got = []
    for room in _rooms(len(fp)):
        for k, picks in enumerate(_picks(room, bands, width)):
            got.append(f"{room}:{k}:" + "".join(map(fp.__getitem__, picks)))
    return got


@cached
def _picks(room: int, bands: int, width: int) -> list[list[int]]:
    """The places of each band, below 2^room."""
    return [sorted(int(x) for x in arrays_of(1000 + k, width) % np.uint64(1 << room)) for k in range(bands)]


def _rooms(n: int) -> set[int]:
    top = n.bit_length() - 1
    return {min(top, 6), min(top, 8), max(top, 0), max(top - 1, 0)} if n else set()


def share_a_band(a: str, b: str, bands: int = BANDS, width: int = WIDTH) -> bool:
    """Whether two fingerprints have a band key in common."""
    x, y = (np.frombuffer(samples_of(f).encode(), np.uint8) for f in (a, b))
    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    return any(same[np.array(_picks(room, bands, width))].all(axis=1).any() for room in _rooms(len(x)) & _rooms(len(y)))


def edit_distance(a: str, b: str, limit: int) -> int:
    """Levenshtein distance if at most limit, else limit + 1.

    What both begin and end with is left out.  The columns of the table of distances are kept as the bits of two
    long integers (where a column rises and where it falls), so a character of b costs a few operations on them."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    x, y = code_points(a), code_points(b)
    n = min(len(x), len(y))
    lead = int((x[:n] != y[:n]).argmax()) if n and (x[:n] != y[:n]).any() else n
    x, y = x[lead:], y[lead:]
    n = min(len(x), len(y))
    tail = x[len(x) - n :][::-1] != y[len(y) - n :][::-1]
    trail = int(tail.argmax()) if tail.any() else n
    x, y = x[: len(x) - trail], y[: len(y) - trail]
    if not len(x) or not len(y):
        return min(len(x) + len(y), limit + 1)
    # an edit changes four pairs of neighbours at most
    pairs = [np.bincount((t[1:] * np.uint32(31) + t[:-1]) & np.uint32(1023), minlength=1024) for t in (x, y)]
    if np.abs(pairs[0] - pairs[1]).sum() > 4 * limit:
        return limit + 1
    x, y = x.tolist(), y.tolist()
    if len(x) > len(y):
        x, y = y, x
    spots: dict[int, bytearray] = {}
    for i, c in enumerate(x):
        if c not in spots:
            spots[c] = bytearray(len(x) // 8 + 1)
        spots[c][i >> 3] |= 1 << (i & 7)
    where = {c: int.from_bytes(v, "little") for c, v in spots.items()}
    full, top = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down, dist = full, 0, len(x)

    def above(up: int, down: int, mask: int, k: int) -> int:
        """The distance of the first characters of x, as many as mask has bits, and the first k of y."""
        return k + (up & mask).bit_count() - (down & mask).bit_count()

    for k, c in enumerate(y):
        if not k & 63:
            # a path within the limit stays within limit of the diagonal, where the distance is twice the limit at most
            if above(up, down, (1 << min(k, len(x))) - 1, k) > 2 * limit or dist - (len(y) - k) > limit:
                return limit + 1
        eq = where.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        rise = down | (full & ~(across | up))
        fall = up & across
        dist += bool(rise & top) - bool(fall & top)
        rise = (rise << 1 | 1) & full
        fall = fall << 1 & full
        diagonal = eq | down
        up = fall | (full & ~(diagonal | rise))
        down = rise & diagonal
    return dist if dist <= limit else limit + 1


def text_classes(docs: DataFrame) -> DataFrame:
    """doc_id, h (the text's hash), name (its class's smallest id) of every row whose text is not empty."""
    rows = docs.select("doc_id", F.sha2("text", 256).alias("h")).filter(F.length("text") > 0)
    return rows.join(rows.groupBy("h").agg(F.min("doc_id").alias("name")), "h").select("doc_id", "h", "name")


def _across(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Pairs of texts (h, fingerprint, comp, side) in different components, alike by least; side 0 meets side 1,
    side 2 itself."""
    fps = [np.frombuffer(samples_of(f).encode(), np.uint8) for f in pdf["fingerprint"]]
    lens = np.array([len(f) for f in fps])
    grid = np.zeros((len(fps), int(lens.max())), np.uint8)  # 0 is no digit
    for r, f in enumerate(fps):
        grid[r, : len(f)] = f
    w = _weights(grid.shape[1])
    upto = np.concatenate([[0.0], np.cumsum(w)])
    h, comp, side = pdf["h"].to_numpy(), pdf["comp"].to_numpy(), pdf["side"].to_numpy()
    got = []
    for r in np.flatnonzero(side != 1):
        other = np.flatnonzero((side == 1 if side[r] == 0 else np.arange(len(side)) > r) & (comp != comp[r]))
        if len(other):
            same = ((grid[other, : lens[r]] == grid[r, : lens[r]]) @ w[: lens[r]]) / upto[np.maximum(lens[other], lens[r])]
            # a wide filter by the samples: like() has the last word
            got += [(h[r], h[o]) for o in other[(same - 1 / 16) / (15 / 16) >= least - 0.05]]
    return pd.DataFrame([(min(p), max(p)) for p in got], columns=["a", "b"])


def near_texts(docs: DataFrame, max_edits: float = MAX_EDITS, least: float = 0.1, chunk: int = 1024) -> DataFrame:
    """Pairs (a, b) of different texts within max_edits edits a character, with their distance.

    The embedding stretches k edits to as many as the square of k steps, so bands tell near texts at few edits in
    a hundred characters only: at two, texts of 200 to 20,000 characters share one in nine of ten cases or more.
    Equal texts are one class, named by its smallest id (a null id never names one if there is another;
    text_classes tells the members); pairs are between classes, which may share a name.  In a bucket of a band
    each text is first paired with the bucket's first one.  Where that leaves a bucket in several components,
    its members of different components are all compared, by pairs of chunks: near texts that share a bucket
    are always linked.  The second way's work grows with the square of such a bucket."""
    from .neardup import components

    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") > 0)
    firsts = staged(base.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text")), "edit-texts")
    fps = staged(fingerprints(firsts, "h"), "edit-prints")

    @F.pandas_udf("array<string>")
    def keys(fp: pd.Series) -> pd.Series:
        return fp.map(band_keys)

    @F.pandas_udf("double")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lim = [int(max_edits * max(len(s), len(t))) for s, t in zip(b["ta"], b["tb"], strict=True)]
            d = [edit_distance(s, t, x) for s, t, x in zip(b["ta"], b["tb"], lim, strict=True)]
            ok = np.array([x <= y for x, y in zip(d, lim, strict=True)], bool)
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "edits": d})[ok]

    def verified(pairs: DataFrame) -> DataFrame:
        fa, fb = (fps.select(F.col("h").alias(c), F.col("fingerprint").alias(f"f{c}")) for c in "ab")
        close = pairs.join(fa, "a").join(fb, "b").filter(like("fa", "fb") >= least).select("a", "b")
        ta, tb = (firsts.select(F.col("h").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        return close.join(ta, "a").join(tb, "b").mapInPandas(released(verify), "a string, b string, edits int")

    banded = staged(fps.select("h", F.explode(F.array_distinct(keys("fingerprint"))).alias("key")), "edit-bands")
    lead = banded.groupBy("key").agg(F.min("h").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = banded.join(lead, "key").filter("h <> lead").select(F.col("lead").alias("a"), F.col("h").alias("b")).distinct()
    linked = staged(verified(pairs), "edit-linked")

    comp = components(linked.select("a", "b")).select(F.col("node").alias("h"), "comp")
    told = staged(banded.join(comp, "h", "left").withColumn("comp", F.coalesce("comp", "h")), "edit-comps")
    apart = told.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi")
    apart = apart.select("key", F.ceil(F.col("n") / chunk).cast("int").alias("c"))
    mine = told.join(apart, "key").withColumn("i", F.pmod(F.xxhash64("h"), F.col("c")).cast("int"))
    # each member meets every chunk of its bucket: as the first of the two, as the second, or in its own
    dealt = mine.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).select(
        "h", "key", "comp", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"),
        F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1).alias("side"),
    )
    sets = dealt.join(fps.select("h", "fingerprint"), "h").groupBy("key", "lo", "hi")
    more = sets.applyInPandas(lambda pdf: _across(pdf, least), "a string, b string").distinct()
    links = linked.unionByName(verified(more.join(linked, ["a", "b"], "left_anti")))

    na, nb = (firsts.select(F.col("h").alias(c), F.col("doc_id").alias(f"n{c}")) for c in "ab")
    named = links.join(na, "a").join(nb, "b")
    lower = F.col("nb").isNull() | (F.col("na") <= F.col("nb"))
    return named.select(F.when(lower, F.col("na")).otherwise(F.col("nb")).alias("a"), F.when(lower, F.col("nb")).otherwise(F.col("na")).alias("b"), "edits")


def edited(text: str, follower: str) -> str:
    """The last quarter of the text replaced by as many first characters of the next one, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + follower[:n]


#: Characters of a range of ids, about, and the most ranges.
_RANGE_CHARS, _RANGES = 8_000_000, 50_000


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt by ranges of doc_id (part), so that the next row by ascending id is in the same part: every
    part also gets a copy (ahead = 1) of the row after its last; after the table's last row comes its first.

    The texts move once and no range knows more than its own rows.  How many ranges there are follows from the
    table's characters, where they end from a bounded sample of ids.  Rows of one id are ordered by text; they are
    one range."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    many = rows.agg(F.count("doc_id").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2, many["chars"] // _RANGE_CHARS), _RANGES)
    some = 20 * parts
    picked = rows.select("doc_id").filter("doc_id is not null").filter(hash_below(1.2 * some / max(many["n"], 1), "doc_id"))
    sample = sorted({r["doc_id"] for r in picked.limit(2 * some).collect()})
    cuts = np.array([sample[len(sample) * k // parts] for k in range(1, parts)] if sample else [])
    cuts = np.unique(cuts) if len(cuts) else cuts

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        out = np.zeros(len(ids), np.int32)
        there = ids.notna().to_numpy()
        if len(cuts) and there.any():
            out[there] = np.searchsorted(cuts, ids[there].to_numpy().astype(cuts.dtype), side="right")
        return pd.Series(out)

    dealt = rows.withColumn("part", part_of("doc_id"))
    # one small row a range comes to the driver: its first id
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), F.col("doc_id").alias("d")))
    heads = sorted((r["part"], r["head"]["d"]) for r in dealt.groupBy("part").agg(first.alias("head")).collect())
    if not heads:
        return rows.select("doc_id", "text", F.lit(0).alias("part"), F.lit(0).alias("ahead"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # as many rows as there are ranges: the range, its first id, and the range before it
    table = [(heads[k][0], heads[k][1], heads[k - 1][0]) for k in range(len(heads))]
    ends = F.broadcast(spark.createDataFrame(table, f"part int, head {kind}, before int"))
    ahead = (
        dealt.join(ends, "part")
        .filter(F.col("head").eqNullSafe(F.col("doc_id")))
        .groupBy("part", "doc_id", "before")
        .agg(F.min("text").alias("text"))
        .select("doc_id", "text", F.col("before").alias("part"), F.lit(1).alias("ahead"))
    )
    return dealt.select("doc_id", "text", "part", F.lit(0).alias("ahead")).unionByName(ahead).repartition(parts, "part")


def verified_edits(a: str, b: str, fa: str, fb: str, max_edits: float = MAX_EDITS) -> int | None:
    """The exact number of edits between two texts, where their fingerprints share a band and it is within max_edits
    edits a character; else None."""
    if not a or not b or not share_a_band(fa, fb):
        return None
    limit = int(max_edits * max(len(a), len(b)))
    edits = edit_distance(a, b, limit)
    return edits if edits <= limit else None


def op1_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Contract query: fingerprints of every text and of its edited text, and their likeness; edited_edits and
    next_edits are the verified edits to the edited text and to the next document, where banding brings the two
    together (null where it does not, or where they are further apart than MAX_EDITS a character)."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    both = with_next(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = both.sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "text")
    cols = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_edits", "next_edits"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # the row whose next has not come yet, with its walk and fingerprint

        def walked(doc, text, ahead):
            codes = code_points(text)
            ends = walk(codes)
            return doc, text, ahead, codes, ends, print_of(codes, ends)

        for b in _sized_batches(batches, "text", 1_200_000):
            out = []
            for doc, text, ahead in zip(b["doc_id"], b["text"], b["ahead"], strict=True):
                new = walked(doc, text, ahead)
                if last is not None and not last[2]:
                    d, t, _, codes, ends, f = last
                    cut = len(t) - len(t) // 4
                    other = edited(t, text)
                    mixed = np.concatenate([codes[:cut], new[3][: len(t) // 4]])
                    g = print_of(mixed, walk(mixed, ends[:cut]))
                    out.append((d, len(t), hashlib.sha256(other.encode("utf-8", "replace")).hexdigest(), f, g, likeness(f, g), likeness(f, new[5]), verified_edits(t, other, f, g), verified_edits(t, text, f, new[5])))
                last = new
            if out:
                rows = pd.DataFrame(out, columns=cols)
                yield rows.astype({"edited_edits": "Int32", "next_edits": "Int32"})

    return dealt.mapInPandas(released(run), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_edits int, next_edits int")
