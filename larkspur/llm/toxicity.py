"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of embeddings hashed from the word and from its first bytes, so that inflected
forms share weight.  Filters of one, two and three words slide over the text.  Each keeps its maximum in
each of eight interleaved parts of the text (word places modulo 8) and over all; a logistic layer reads the
sum over the parts, which tells several hits from one, and the maximum.  One filter starts from the word's log-odds in the training rows; all are
then trained in numpy.  Thresholds are calibrated by language: the language is guessed from the words
alone, and the logit is shifted so that 0.5 is that language's best threshold on calibration rows.

Defined results: null, empty and letterless texts get the score of a text without words; repeated rows are
scored alike; an empty table gives an empty result; without labelled rows of both classes every text gets
the share of the label.  Nothing but the text is an input of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Adam, crc_part, discard, hash_below, narrowed, released, small_batches, staged

#: Everything that is not an ASCII letter or a byte of a longer character separates words.
_SPLIT = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PREFIXES = (4, 5, 6, 7)
#: Interleaved parts of a text that are pooled apart.
PARTS = 8


@dataclass(frozen=True)
class Config:
    buckets: int = 1 << 16
    embed: int = 6
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 6
    epochs: int = 4
    lr: float = 8e-3
    #: The bound of the training sample: so many texts of either label.
    texts_per_label: int = 2500
    #: So many further clean texts are scored to set the thresholds, but not trained on.
    clean_for_cuts: int = 4000
    #: A language has a threshold of its own from so many calibration texts of either label on.
    least: int = 10
    seed: int = 5


def words_in(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_SPLIT).split() if text else []


def features(word: bytes, buckets: int) -> tuple[int, ...]:
    """Buckets of the word itself and of its beginnings (shorter words repeat their own)."""
    return (zlib.crc32(word) % buckets, *(zlib.crc32(b"%d:" % n + word[:n]) % buckets for n in _PREFIXES))


@dataclass
class ToxicNet:
    table: np.ndarray  # buckets -> all taps of all filters, and one column for each language
    widths: tuple[int, ...]
    filters: int
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shift: np.ndarray  # by language; the last is for texts of no known language
    constant: float | None = None

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated logit of each whole text; words run through in blocks, maxima are merged."""
        n_lang = len(self.shift) - 1
        top = np.full((len(texts), PARTS, self.filters * len(self.widths)), -np.inf, np.float32)
        lang = np.zeros((len(texts), n_lang))
        reach = max(self.widths) - 1
        cols = self.table.shape[1]
        rows = np.zeros((1024, cols), np.float32)  # row 0: padding
        index: dict[bytes, int] = {}
        ids: list[int] = []
        starts: list[int] = []
        owner: list[int] = []

        def flush() -> None:
            if not starts:
                return
            r = rows[np.array(ids + [0] * reach)]
            n = len(ids)
            at = np.array(starts)
            col = 0
            parts = at // PARTS
            for k, w in enumerate(self.widths):
                z = r[:n, col : col + self.filters].copy()
                for j in range(1, w):
                    z += r[j : n + j, col + j * self.filters : col + (j + 1) * self.filters]
                col += w * self.filters
                # texts begin at multiples of PARTS, so a row holds one place of each part
                most = np.maximum.reduceat(z.reshape(-1, PARTS, self.filters), parts, axis=0)
                np.maximum.at(top[:, :, k * self.filters : (k + 1) * self.filters], owner, most)
            if n_lang:
                np.add.at(lang, owner, np.add.reduceat(r[:n, col:], at, axis=0))
            ids.clear(), starts.clear(), owner.clear()

        def number(word: bytes) -> int:
            nonlocal rows
            i = len(index) + 1
            if i >= len(rows):
                rows = np.concatenate([rows, np.zeros_like(rows)])
            rows[i] = self.table[list(features(word, len(self.table)))].sum(axis=0)
            index[word] = i
            return i

        for t, text in enumerate(texts):
            words = words_in(text)
            for at in range(0, max(len(words), 1), 20_000):
                # a block carries the words that its last windows reach into
                block = words[at : at + 20_000 + reach]
                starts.append(len(ids))
                owner.append(t)
                ids += [index.get(w) or number(w) for w in block]
                ids += [0] * (reach + -(len(ids) + reach) % PARTS)
                if len(ids) > 60_000:
                    flush()
                    if len(index) > 150_000:
                        index.clear()
        flush()
        h = np.maximum(top + self.bias, 0)
        z = np.concatenate([h.sum(axis=1), h.max(axis=1)], axis=1) @ self.out + self.out_bias
        known = np.abs(lang).sum(axis=1) > 0
        guess = np.where(known, lang.argmax(axis=1) if n_lang else 0, n_lang)
        return z - self.shift[guess]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30)))


def _forward(e, convs, bias, widths):
    """Word vectors (n + reach, embed; n a multiple of PARTS) of one text -> for each part the maxima with
    bias, and where they are."""
    n = len(e) - max(widths) + 1
    best, arg = [], []
    for w, c, b in zip(widths, convs, bias, strict=True):
        z = e[:n] @ c[0]
        for k in range(1, w):
            z = z + e[k : n + k] @ c[k]
        z = z.reshape(-1, PARTS, z.shape[1])
        a = z.argmax(axis=0)
        arg.append(a * PARTS + np.arange(PARTS)[:, None])
        best.append(np.take_along_axis(z, a[None], 0)[0] + b)
    return np.concatenate(best, axis=1), arg


def train_network(texts: list[str | None], labels: list[int], langs: list[str | None], cfg: Config = Config()) -> ToxicNet:
    """Fit on labelled texts; langs help to calibrate only.  The same input gives the same network."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return ToxicNet(np.zeros((1, 1), np.float32), cfg.widths, cfg.filters, np.zeros(1), np.zeros(1), 0.0, np.zeros(1), constant=float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(cfg.seed)
    cache: dict[bytes, tuple[int, ...]] = {}

    def encode(words):
        for w in words:
            if w not in cache:
                cache[w] = features(w, cfg.buckets)
        return np.array([cache[w] for w in words], np.int32).reshape(-1, 1 + len(_PREFIXES))

    # Log-odds of each hashed feature by the number of texts that hold it: where one filter starts.
    # A word counts up to four times a text: the label may want more than one hit.
    spare = np.cumsum(y == 0) > cfg.texts_per_label
    spare &= y == 0
    held = [np.zeros(cfg.buckets), np.zeros(cfg.buckets)]
    names = sorted({x for x in langs if x is not None})
    by_lang = np.ones((cfg.buckets, len(names)))
    enc = []
    for text, lab, lang, out_of in zip(texts, labels, langs, spare, strict=True):
        if out_of:
            enc.append(None)
            continue
        f = encode(words_in(text))
        enc.append(f)
        present, times = np.unique(f, return_counts=True)
        held[int(lab)][present] += np.minimum(times, 4)
        if lang is not None:
            by_lang[present, names.index(lang)] += 1
    tot = [max(((y == 0) & ~spare).sum(), 1), max((y == 1).sum(), 1)]
    odds = np.log((held[1] + 0.3) / (tot[1] + 0.6)) - np.log((held[0] + 0.3) / (tot[0] + 0.6))
    # few texts say little: what a handful of copies share is no evidence
    seen = held[0] + held[1]
    odds *= seen / (seen + 6)
    lang_cols = np.log(by_lang / by_lang.sum(axis=0))
    lang_cols -= lang_cols.mean(axis=1, keepdims=True)

    emb = rng.normal(0, 0.02, (cfg.buckets, cfg.embed)).astype(np.float32)
    emb[:, 0] = odds / (1 + len(_PREFIXES))
    convs = [rng.normal(0, 0.3, (w, cfg.embed, cfg.filters)).astype(np.float32) for w in cfg.widths]
    convs[0][0, :, 0] = 0
    convs[0][0, 0, 0] = 1
    bias = [np.zeros(cfg.filters, np.float32) for _ in cfg.widths]
    bias[0][0] = -1
    width = cfg.filters * len(cfg.widths)
    out = rng.normal(0, 0.05, 2 * width).astype(np.float32)
    out[0] = out[width] = 0.6
    ob = np.full(1, -2.0, np.float32)
    opt = Adam([*convs, *bias, out, ob], cfg.lr)
    # An eighth of the sample is not trained on: it sets the thresholds, with the rest behind it.
    fold = np.where(spare, 0, rng.integers(0, 8, len(y)))
    reach = max(cfg.widths) - 1
    train = np.flatnonzero(fold > 0)
    share = tot[1] / (tot[0] + tot[1])
    weight = np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
    for epoch in range(cfg.epochs):
        opt.lr = cfg.lr * (1 - epoch / cfg.epochs)
        rng.shuffle(train)
        for s in range(0, len(train), 32):
            grads = [np.zeros_like(p) for p in opt.params]
            pick = train[s : s + 32]
            for i in pick:
                f = enc[i]
                # at least one place after the words, then up to a multiple of PARTS
                e = np.zeros(((len(f) + reach + PARTS) // PARTS * PARTS + reach, cfg.embed), np.float32)
                if len(f):
                    e[: len(f)] = emb[f].sum(axis=1)
                pre, arg = _forward(e, convs, bias, cfg.widths)
                h = np.maximum(pre, 0)
                most = h.argmax(axis=0)
                read = np.concatenate([h.sum(axis=0), h.max(axis=0)])
                p = 1 / (1 + np.exp(-np.clip(read @ out + ob[0], -30, 30)))
                g = (p - y[i]) * weight[i] / len(pick)
                grads[-2] += g * read
                grads[-1] += g
                gh = np.repeat(g * out[None, :width], PARTS, axis=0)
                gh[most, np.arange(width)] += g * out[width:]
                gh *= pre > 0
                for k, w in enumerate(cfg.widths):
                    gk = gh[:, k * cfg.filters : (k + 1) * cfg.filters]
                    grads[len(convs) + k] += gk.sum(axis=0)
                    for j in range(w):
                        x = e[arg[k] + j]  # part, filter, embed
                        grads[k][j] += np.einsum("pfe,pf->ef", x, gk)
                        for q, r in zip(*np.nonzero(gk), strict=True):
                            at = arg[k][q, r] + j
                            if at < len(f):
                                emb[f[at]] -= opt.lr * gk[q, r] * convs[k][j][:, r]
            grads[-2] += 1e-4 * out
            opt.step(grads)
    table = np.concatenate([emb @ c[j] for c in convs for j in range(c.shape[0])] + [lang_cols], axis=1).astype(np.float32)
    net = ToxicNet(table, cfg.widths, cfg.filters, np.concatenate(bias), out, float(ob[0]), np.zeros(len(names) + 1))
    z = net.logits(texts)
    net.shift = _thresholds(z, y, langs, names, fold == 0, cfg.least)
    return net


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1; among equals within the widest gap, and there nearer to the class of which more
    texts are known (an extreme is as uncertain as the root of their number is small)."""
    order = np.argsort(z)
    zs, ys = z[order], y[order]
    tp = ys[::-1].cumsum()[::-1]
    fp = (1 - ys)[::-1].cumsum()[::-1]
    f1 = 2 * tp / np.maximum(tp + fp + ys.sum(), 1)
    gap = np.diff(zs, prepend=zs[0] - 1)
    ok = (gap > 0) & (f1 >= f1[gap > 0].max() - 1e-9)
    i = np.flatnonzero(ok)[gap[ok].argmax()]
    near = (len(y) - y.sum()) ** -0.5 if y.sum() < len(y) else 1.0
    far = y.sum() ** -0.5 if y.sum() else 1.0
    return float(zs[i - 1] + (zs[i] - zs[i - 1]) * near / (near + far)) if i else float(zs[0] - 0.5)


def _thresholds(z, y, langs, names, calib, least) -> np.ndarray:
    """One cut a language, from its calibration rows; where those are few, from all of its rows, else from everything."""
    lang = np.array([names.index(x) if x is not None else len(names) for x in langs])
    whole = _best_cut(z[calib], y[calib]) if len(set(y[calib])) == 2 else _best_cut(z, y)
    shift = np.full(len(names) + 1, whole)
    for k in range(len(names)):
        for rows in ((lang == k) & calib, lang == k):
            if min((y[rows] == 0).sum(), (y[rows] == 1).sum()) >= least:
                shift[k] = _best_cut(z[rows], y[rows])
                break
    return shift


def training_sample(docs: DataFrame, labels: DataFrame, cfg: Config = Config()):
    """At most cfg.texts_per_label labelled texts of either label (and cfg.clean_for_cuts further clean ones)
    whose id's crc32 mod 5 is not 0, by a hash of the id.  Texts are whole: only the number of rows is bounded."""
    room = {0: cfg.texts_per_label + cfg.clean_for_cuts, 1: cfg.texts_per_label}
    lab = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_part("doc_id", 5) != 0))
    counts = {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for k, n in counts.items():
        keep = keep | ((F.col("toxic") == k) & hash_below(1.2 * room[k] / n, "doc_id"))
    # the sample is bounded at any size: about 1.2 times the room; should the hashes fall otherwise, nothing is broadcast
    most = 2 * sum(room.values())
    picked = staged(lab.filter(keep).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labelled")
    told = docs.select("doc_id", "text", "lang")
    met = told.join(F.broadcast(picked), "doc_id") if picked.count() <= most else narrowed(told, "doc_id", picked).join(picked, "doc_id")
    rows = met.select("doc_id", "toxic", "lang", "text")
    # a bound for tables that repeat an id very often, too
    rows = rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(most).collect()
    discard(picked)
    seen = {0: 0, 1: 0}
    out = []
    for r in sorted(rows, key=lambda r: (r["toxic"], zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"] or "")):
        if seen[r["toxic"]] < room[r["toxic"]]:
            seen[r["toxic"]] += 1
            out.append(r)
    return [r["text"] for r in out], [r["toxic"] for r in out], [r["lang"] for r in out]


def score_texts(docs: DataFrame, net: ToxicNet) -> DataFrame:
    """doc_id and score of every row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(net))  # of fixed size: buckets x filters
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = ToxicNet(**shared.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": held.scores(list(b["text"])).astype(float)})

    return docs.select("doc_id", "text").mapInPandas(released(run), f"doc_id {kind}, score double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: the score of every document, learnt outside the held-out fold."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    net = train_network(*training_sample(docs, table(spark, sf_dir, "labels")))
    out = score_texts(docs, net)
    return out.select("doc_id", (crc_part("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
