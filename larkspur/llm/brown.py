"""Language-model scores by a class-based bigram model (Brown classes).

The probability of a token is that of its class after the last token's class, times that of the word in
its class.  Word counts cover all training texts and all words.  Classes come from exchange clustering:
clustered units are the most frequent words one by one, and all other words by their form (a hash of their
ending), so every word has a class; each unit in turn moves to the class that raises the likelihood of the
bigrams most, until sweeps change little.  The count matrix of units has a fixed size; the word counts grow
with the corpus and stay distributed.

Texts are scored where they are with the counts of the most frequent words (a table of a fixed size); the
other words of each text meet their counts in an equi-join.  Words are told apart by a 64-bit hash.

Defined results: a null or empty text is its end token alone; repeated rows are scored (and learnt from)
each; a null id counts as the empty text for the fold; without training texts every probability is 1; an
empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_words, crc_part, released, staged, table

#: The end token; no word holds white space.
END = b"\n"


@dataclass(frozen=True)
class Config:
    head: int = 2048
    forms: int = 1024
    classes: int = 48
    sweeps: int = 8
    #: So many words' counts are sent to all executors; the others are joined.
    common: int = 1 << 18
    #: Weight of the class frequencies in the transitions.
    prior: float = 8.0

    @property
    def units(self) -> int:
        return self.head + self.forms


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.array([h(w) for w in words], np.uint64).view(np.int64)


class Forms(dict):
    """ending (the last three bytes) -> form."""

    def __init__(self, forms: int):
        super().__init__()
        self.forms = forms

    def __missing__(self, ending: bytes) -> int:
        import zlib

        f = self[ending] = zlib.crc32(ending) % self.forms
        return f

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.array([self[w[-3:]] for w in words], np.int64)


def word_counts(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """h, form, n of every distinct token of docs(text), end tokens included."""
    forms = cfg.forms

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        form = Forms(forms)

        def out() -> pd.DataFrame:
            words = list(held)
            return pd.DataFrame({"h": word_hashes(words), "form": form.of(words), "n": list(held.values())})

        for b in batches:
            for text in b["text"]:
                held.update(byte_words(text))
            held[END] += len(b)
            if len(held) > 200_000:
                yield out()
                held.clear()
        if held:
            yield out()

    parts = docs.select("text").mapInPandas(released(run), "h long, form int, n long")
    return parts.groupBy("h").agg(F.min("form").alias("form"), F.sum("n").alias("n"))


class Places(dict):
    """word -> its number, by first appearance; new holds the words that have come since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self)
        self.new.append(w)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each h in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def unit_bigrams(docs: DataFrame, head: np.ndarray, cfg: Config) -> np.ndarray:
    """How often unit j follows unit i (a fixed-size matrix); texts begin and end with the end token."""
    u, forms, n_head = cfg.units, cfg.forms, cfg.head
    order = np.argsort(head)
    keys, number = head[order], order.astype(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look, form = Places(), Forms(forms)
        unit = np.zeros(0, np.int64)
        acc = np.zeros(u * u, np.int32)
        for b in batches:
            stream = [END]
            for text in b["text"]:
                stream += byte_words(text)
                stream.append(END)
            if len(look) > 300_000:
                look, unit = Places(), np.zeros(0, np.int64)
            at = look.of(stream)
            if look.new:
                f = _find(keys, word_hashes(look.new))
                unit = np.concatenate([unit, np.where(f >= 0, number[f] if len(number) else 0, n_head + form.of(look.new))])
                look.new.clear()
            s = unit[at]
            pair, n = np.unique(s[:-1] * u + s[1:], return_counts=True)
            acc[pair] += n.astype(np.int32)
        yield from sparse_rows(acc.reshape(u, u))

    def sparse_rows(full: np.ndarray) -> Iterator[pd.DataFrame]:
        for lo in range(0, u, 256):
            rows = []
            for i in range(lo, min(lo + 256, u)):
                j = np.flatnonzero(full[i])
                if len(j):
                    rows.append((i, j.astype(np.int16).tobytes(), full[i, j].astype(np.int64).tobytes()))
            if rows:
                yield pd.DataFrame(rows, columns=["i", "j", "n"])

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        row = np.zeros(u, np.int64)
        for j, n in zip(pdf["j"], pdf["n"], strict=True):
            row[np.frombuffer(j, np.int16)] += np.frombuffer(n, np.int64)
        j = np.flatnonzero(row)
        return pd.DataFrame({"i": [int(key[0])], "j": [j.astype(np.int16).tobytes()], "n": [row[j].tobytes()]})

    schema = "i int, j binary, n binary"
    parts = docs.select("text").mapInPandas(released(run), schema)
    # two levels of groups: none holds more than about the root of the number of tasks
    salts = max(1, int(parts.rdd.getNumPartitions() ** 0.5))
    some = parts.withColumn("salt", F.spark_partition_id() % salts).groupBy("i", "salt").applyInPandas(add, schema)
    out = np.zeros((u, u), np.float32)
    # u rows of at most u counts, whatever the size of the corpus
    for r in some.groupBy("i").applyInPandas(add, schema).toLocalIterator():
        out[r["i"], np.frombuffer(r["j"], np.int16)] = np.frombuffer(r["n"], np.int64)
    return out


def exchange(m: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of every unit: each moves in turn to the class that gains most bigram likelihood."""
    u = len(m)
    weight = m.sum(axis=0, dtype=np.float64) + m.sum(axis=1, dtype=np.float64)
    order = np.argsort(-weight, kind="stable")
    cls = np.zeros(u, np.int64)
    cls[order] = np.arange(u) % classes
    order = order[weight[order] > 0]
    hot = np.zeros((u, classes), np.float32)
    hot[np.arange(u), cls] = 1
    after = (m @ hot).astype(np.float64)  # unit, then class
    mt = np.ascontiguousarray(m.T)
    before = (mt @ hot).astype(np.float64)  # class, then unit (row: unit)
    big = hot.T.astype(np.float64) @ after  # class, class

    def f(x):
        return x * np.log(np.maximum(x, 1))

    eye = np.eye(classes, dtype=bool)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a = cls[w]
            own = float(m[w, w])
            lc, rc = before[w].copy(), after[w].copy()
            big[:, a] -= lc
            big[a, :] -= rc
            big[a, a] += own
            np.maximum(big, 0, out=big)
            lc[a] -= own
            rc[a] -= own
            # gains for every class at once; the diagonal takes both sides and the word after itself
            col = f(big + lc[:, None]) - f(big)
            row = f(big + rc[None, :]) - f(big)
            gain = np.where(eye, 0, col).sum(axis=0) + np.where(eye, 0, row).sum(axis=1)
            d = np.diagonal(big)
            gain += f(d + lc + rc + own) - f(d)
            out_n, in_n = big.sum(axis=1), big.sum(axis=0)
            gain -= f(out_n + rc.sum() + own) - f(out_n) + f(in_n + lc.sum() + own) - f(in_n)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            big[:, b] += lc
            big[b, :] += rc
            big[b, b] += own
            if b != a:
                moved += 1
                cls[w] = b
                after[:, a] -= mt[w]
                after[:, b] += mt[w]
                before[:, a] -= m[w]
                before[:, b] += m[w]
        if moved < max(1, u // 200):
            break
    return cls


@dataclass
class Model:
    head: np.ndarray  # hashes of the units that are words
    unit_class: np.ndarray
    step: np.ndarray  # log10 of class transitions
    room: np.ndarray  # log10 of each class's tokens and types
    common_h: np.ndarray  # sorted
    common_n: np.ndarray
    total: int
    types: int
    forms: int


def train(docs: DataFrame, counts: DataFrame, cfg: Config = Config()) -> Model:
    """The model of training texts docs(text); counts are their word_counts (a staged table)."""
    n_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, types = int(n_all[0]), int(n_all[1])
    # how many words are how frequent, by eighths of doublings (a few hundred rows): where the table must end
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r["level"], r["v"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("v")).collect()), reverse=True)
    room, least = cfg.common, 1 << 30
    for lv, v in sizes:
        if v > room:
            break
        room, least = room - v, lv
    top = counts.filter(level >= least).select("h", "form", "n").toArrow()
    top_h, top_form, top_n = (top.column(c).to_numpy() for c in ("h", "form", "n"))
    order = np.lexsort((top_h, -top_n))[: cfg.head]
    head = top_h[order]
    if total:
        m = unit_bigrams(docs, head, cfg)
        cls = exchange(m, cfg.classes, cfg.sweeps)
        classes = cfg.classes
    else:
        m, cls, classes = np.zeros((cfg.units, cfg.units), np.float32), np.zeros(cfg.units, np.int64), 1
    # tokens and distinct words of each class: the words that are units, and the other words by form
    n_class, v_class = np.zeros(classes), np.zeros(classes)
    np.add.at(n_class, cls[: len(head)], top_n[order].astype(float))
    np.add.at(v_class, cls[: len(head)], 1)
    rest = counts.groupBy("form").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
    n_form, v_form = np.zeros(cfg.forms), np.zeros(cfg.forms)
    n_form[rest["form"]], v_form[rest["form"]] = rest["n"], rest["v"]
    # the units that are words leave their forms
    np.subtract.at(n_form, top_form[order], top_n[order].astype(float))
    np.subtract.at(v_form, top_form[order], 1)
    np.add.at(n_class, cls[cfg.head :], n_form)
    np.add.at(v_class, cls[cfg.head :], v_form)
    hot = np.zeros((cfg.units, classes))
    hot[np.arange(cfg.units), cls] = 1
    big = sum(hot[k : k + 256].T @ (m[k : k + 256].astype(np.float64) @ hot) for k in range(0, cfg.units, 256))
    share = (n_class + 1) / (n_class.sum() + classes)
    step = np.log10((big + cfg.prior * share) / (big.sum(axis=1, keepdims=True) + cfg.prior))
    by_h = np.argsort(top_h)
    return Model(head, cls, step, np.log10(n_class + v_class + 1), top_h[by_h], top_n[by_h], total, types, cfg.forms)


def score_texts(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    held = spark.sparkContext.broadcast(vars(model))  # of fixed size: common words, classes
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(**held.value)
        n_head = len(m.unit_class) - m.forms
        order = np.argsort(m.head)
        keys = m.head[order]

        form = Forms(m.forms)

        def fresh():
            return Places(), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

        look, cls, known, hashes = fresh()
        end_class = m.unit_class[_unit_of_end(m, keys, order, n_head)]
        for b in batches:
            if len(look) > 300_000:
                look, cls, known, hashes = fresh()
            stream, ends = [], []
            for text in b["text"]:
                stream += byte_words(text)
                stream.append(END)
                ends.append(len(stream))
            at = look.of(stream)
            if look.new:
                h = word_hashes(look.new)
                f = _find(keys, h)
                cls = np.concatenate([cls, m.unit_class[np.where(f >= 0, order[f] if len(order) else 0, n_head + form.of(look.new))]])
                c = _find(m.common_h, h)
                # log10(count + 1) of common words, NaN for those that the join will tell
                known = np.concatenate([known, np.where(c >= 0, np.log10((m.common_n[c] if len(m.common_n) else np.zeros(len(c))) + 1.0), np.nan)])
                hashes = np.concatenate([hashes, h])
                look.new.clear()
            k = cls[at]
            starts = np.concatenate([[0], ends[:-1]]).astype(int)
            last = np.empty_like(k)
            last[1:] = k[:-1]
            last[starts] = end_class
            value = known[at]
            rare = np.isnan(value)
            move = m.step[last, k] - m.room[k]
            size = np.array(ends) - starts
            rows = {
                "n_tokens": size,
                "common": np.add.reduceat((~rare).astype(np.int64), starts),
                "logs": np.add.reduceat(np.where(rare, 0, value), starts),
                "moves": np.add.reduceat(move, starts),
            }
            hs, tf = [], []
            for s, e in zip(starts, ends, strict=True):
                p, n = np.unique(at[s:e][rare[s:e]], return_counts=True)
                hs.append(hashes[p]), tf.append(n.astype(np.int32))
            yield pd.DataFrame({"doc_id": b["doc_id"], **rows, "h": hs, "tf": tf})

    local = docs.select("doc_id", "text").mapInPandas(released(run), f"doc_id {kind}, n_tokens long, common long, logs double, moves double, h array<long>, tf array<int>")
    local = staged(local.withColumn("rid", F.monotonically_increasing_id()), "lm-local")
    rare = local.select("rid", F.explode(F.arrays_zip("h", "tf")).alias("x")).select("rid", "x.h", "x.tf")
    met = rare.join(counts.select("h", "n"), "h")
    far = met.groupBy("rid").agg(F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("far"), F.sum("tf").alias("far_known"))
    n = local.drop("h", "tf").join(far, "rid", "left")
    logs = F.col("logs") + F.coalesce("far", F.lit(0.0))
    every = float(np.log10(model.total + model.types + 1))
    return n.select(
        "doc_id",
        "n_tokens",
        (F.col("common") + F.coalesce("far_known", F.lit(0))).cast("long").alias("n_known"),
        (logs - F.col("n_tokens") * F.lit(every)).alias("base_score"),
        (logs + F.col("moves")).alias("score"),
    )


def _unit_of_end(m: Model, keys: np.ndarray, order: np.ndarray, n_head: int) -> int:
    f = int(_find(keys, word_hashes([END]))[0])
    return int(order[f]) if f >= 0 else n_head + int(Forms(m.forms).of([END])[0])


def op7_perplexity(spark, sf_dir: str) -> DataFrame:
    """Contract query: unigram and class-bigram scores of every document, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    train_rows = docs.filter(crc_part("doc_id", 7) != 2)
    counts = staged(word_counts(train_rows), "lm-counts")
    model = train(train_rows, counts)
    out = score_texts(docs, counts, model)
    return out.select("doc_id", (crc_part("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
