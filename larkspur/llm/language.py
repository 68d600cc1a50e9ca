"""Language identification by a byte convolutional network.

Filters of several widths slide over byte embeddings, each filter keeps its maximum over a fixed-length
window, and a softmax reads the maxima.  The network is trained in numpy on a bounded sample of labelled
texts; prediction covers every window of every text and adds the windows' log-probabilities.

Defined results: null or letterless text gives ``und`` with score 0; repeated rows are scored alike; an
empty table gives an empty result; without one labelled training row everything is ``und``.  Columns other
than the id, the text and (for training) the label are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Adam, crc_part, hash_below, released, small_batches

UNKNOWN = "und"


@dataclass(frozen=True)
class Config:
    window: int = 192
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    embed: int = 8
    steps: int = 700
    batch: int = 96
    lr: float = 6e-3
    #: The bound of the training sample: so many texts of each language, so many windows of each text.
    texts_per_language: int = 600
    windows_per_text: int = 3
    seed: int = 11


@dataclass
class ByteNet:
    """langs, and the weights of prediction: per width, a byte table for every tap of the filters."""

    langs: list[str]
    taps: list[list[np.ndarray]]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    window: int

    def windows(self, data: np.ndarray) -> np.ndarray:
        """(n, window) bytes of concatenated windows -> (n, languages) log-probabilities."""
        flat = data.reshape(-1)
        pooled = []
        for taps, bias in zip(self.taps, self.bias, strict=True):
            w = len(taps)
            acc = np.take(taps[0], flat, axis=0)
            for k in range(1, w):
                acc[:-k] += np.take(taps[k], flat[k:], axis=0)
            acc = acc.reshape(len(data), self.window, -1)[:, : self.window - w + 1]
            pooled.append(np.maximum(acc.max(axis=1) + bias, 0))
        z = np.concatenate(pooled, axis=1) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; blocks of windows keep memory even for very long texts."""
        total = np.zeros((len(texts), len(self.langs)))
        count = np.zeros(len(texts))
        held: list[np.ndarray] = []
        owner: list[int] = []
        rows = 0

        def flush() -> None:
            nonlocal rows
            if held:
                logp = self.windows(np.concatenate(held))
                np.add.at(total, np.repeat(owner, [len(h) for h in held]), logp)
                held.clear(), owner.clear()
                rows = 0

        step = 1024
        for i, text in enumerate(texts):
            if not text or not self.langs or not any(map(str.isalpha, text)):
                continue
            raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            n = -(-len(raw) // self.window)
            padded = np.full(n * self.window, 32, np.uint8)
            padded[: len(raw)] = raw
            count[i] = n
            grid = padded.reshape(n, self.window)
            for at in range(0, n, step):
                held.append(grid[at : at + step])
                owner.append(i)
                rows += len(held[-1])
                if rows >= step:
                    flush()
        flush()
        langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        seen = np.flatnonzero(count)
        if len(seen):
            # windows of one text are far from independent, so their evidence counts by its root
            z = total[seen] / np.sqrt(count[seen])[:, None]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for k, i in enumerate(seen):
                langs[i], score[i] = self.langs[best[k]], float(p[k, best[k]])
        return langs, score


def _windows_of(raw: bytes, size: int, rng: np.random.Generator) -> list[bytes]:
    if len(raw) < size:
        return [raw]
    # short pieces too, so that one-word texts are not strange to the network
    return [raw[:size], raw[: int(rng.integers(8, size))]] if rng.random() < 0.4 else [raw[:size]]


def train_network(texts: list[str], labels: list[str], cfg: Config = Config()) -> ByteNet:
    """Fit on labelled windows (of about cfg.window characters); the same input gives the same network."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(cfg.seed)
    xs, ys = [], []
    for text, lab in zip(texts, labels, strict=True):
        if not text or not any(map(str.isalpha, text)):
            continue
        for piece in _windows_of(text.encode("utf-8", "replace"), cfg.window, rng):
            xs.append(np.frombuffer(piece.ljust(cfg.window), np.uint8))
            ys.append(langs.index(lab))
    if not xs:
        return ByteNet([], [], [], np.zeros((0, 0)), np.zeros(0), cfg.window)
    x, y = np.stack(xs), np.array(ys)
    by_lang = [np.flatnonzero(y == k) for k in range(len(langs))]
    by_lang = [b for b in by_lang if len(b)]
    emb = rng.normal(0, 0.3, (256, cfg.embed)).astype(np.float32)
    convs = [rng.normal(0, (2 / (w * cfg.embed)) ** 0.5, (w * cfg.embed, cfg.filters)).astype(np.float32) for w in cfg.widths]
    bias = [np.zeros(cfg.filters, np.float32) for _ in cfg.widths]
    width = cfg.filters * len(cfg.widths)
    out = rng.normal(0, (1 / width) ** 0.5, (width, len(langs))).astype(np.float32)
    out_b = np.zeros(len(langs), np.float32)
    opt = Adam([emb, *convs, *bias, out, out_b], cfg.lr)
    for step in range(cfg.steps):
        opt.lr = cfg.lr * (1 - 0.9 * step / cfg.steps)
        pick = np.concatenate([rng.choice(b, -(-cfg.batch // len(by_lang))) for b in by_lang])
        bx, by = x[pick], y[pick]
        e = emb[bx]
        pooled, at = [], []
        for w, c, b in zip(cfg.widths, convs, bias, strict=True):
            span = cfg.window - w + 1
            z = e[:, :span] @ c[: cfg.embed]
            for k in range(1, w):
                z += e[:, k : k + span] @ c[k * cfg.embed : (k + 1) * cfg.embed]
            arg = z.argmax(axis=1)
            pooled.append(np.take_along_axis(z, arg[:, None], 1)[:, 0] + b)
            at.append(arg)
        pre = np.concatenate(pooled, axis=1)
        h = np.maximum(pre, 0)
        z = h @ out + out_b
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(by)), by] -= 1
        p /= len(by)
        gh = (p @ out.T) * (pre > 0)
        g_emb = np.zeros_like(emb)
        g_convs, g_bias = [], []
        for k, (w, c) in enumerate(zip(cfg.widths, convs, strict=True)):
            g = gh[:, k * cfg.filters : (k + 1) * cfg.filters]
            pos = at[k][:, :, None] + np.arange(w)  # batch, filter, tap
            seen = bx[np.arange(len(bx))[:, None, None], pos]
            ee = emb[seen]  # batch, filter, tap, embed
            g_convs.append(np.einsum("bf,bfte->tef", g, ee).reshape(w * cfg.embed, cfg.filters))
            cc = c.reshape(w, cfg.embed, cfg.filters)
            np.add.at(g_emb, seen.reshape(-1), np.einsum("bf,tef->bfte", g, cc).reshape(-1, cfg.embed))
            g_bias.append(g.sum(axis=0))
        opt.step([g_emb, *g_convs, *g_bias, h.T @ p + 1e-4 * out, p.sum(axis=0)])
    taps = [[np.ascontiguousarray(emb @ c[k * cfg.embed : (k + 1) * cfg.embed]) for k in range(w)] for w, c in zip(cfg.widths, convs, strict=True)]
    return ByteNet(langs, taps, bias, out, out_b, cfg.window)


def training_sample(docs: DataFrame, cfg: Config = Config()) -> tuple[list[str], list[str]]:
    """Windows of at most cfg.texts_per_language labelled texts of each language whose id's crc32 mod 5 is not 0.

    Which texts is decided by a 64-bit hash; every language has its own share, so none is missed.  A text gives
    windows from hashed places all over it (a text no longer than a window gives itself), the driver gets no more."""
    ok = docs.select("doc_id", "text", "lang").filter((crc_part("doc_id", 5) != 0) & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["n"] for r in ok.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    keep = F.lit(False)
    for lang, n in sorted(counts.items()):
        keep = keep | ((F.col("lang") == lang) & hash_below(1.3 * cfg.texts_per_language / n, "doc_id", "text"))
    # a window has cfg.window bytes, which are as many characters at most
    room = F.greatest(F.length("text") - F.lit(cfg.window - 1), F.lit(1))
    pieces = F.transform(F.sequence(F.lit(1), F.lit(cfg.windows_per_text)), lambda k: F.substr("text", (F.pmod(F.xxhash64("doc_id", k), room) + 1).cast("int"), F.lit(cfg.window)))
    pieces = F.when(F.length("text") <= cfg.window, F.array("text")).otherwise(pieces)
    picked = ok.filter(keep).select("lang", F.xxhash64("doc_id", "text").alias("h"), pieces.alias("pieces"))
    # a bound for tables whose rows are nearly all the same, too
    rows = picked.orderBy("h", "lang").limit(2 * cfg.texts_per_language * len(counts)).collect()
    taken: dict[str, int] = {}
    texts, labels = [], []
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        if taken.get(r["lang"], 0) < cfg.texts_per_language:
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            texts += r["pieces"]
            labels += [r["lang"]] * len(r["pieces"])
    return texts, labels


def identify(docs: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            langs, score = net.predict(list(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": langs, "score": score})

    return docs.select("doc_id", "text").mapInPandas(released(run), f"doc_id {kind}, lang_pred string, score double")


def op9_language(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document's language, learnt outside the held-out fold."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    net = train_network(*training_sample(docs))
    out = identify(docs, net)
    return out.select("doc_id", (crc_part("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, net: ByteNet, margin: float = 0.0) -> DataFrame:
    """Pipeline decision, by the network's answer: a document stays if the network's best language scores so far above
    an even guess (0: as an even guess, 1: certain), and its name is written to lang where that is null.  Texts that
    show no language (null, or without a letter) have no answer and go.  A network that has learnt nothing decides
    nothing: then all documents stay."""
    if not net.langs:
        return docs
    small_batches(docs.sparkSession)
    names = docs.columns
    even = 1 / len(net.langs)
    least = even + margin * (1 - even) - 1e-9

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            langs, score = net.predict(list(b["text"]))
            told = pd.Series(langs, index=b.index, dtype=object)
            if "lang" in b:
                b = b.assign(lang=b["lang"].where(b["lang"].notna(), told))
            yield b[(told != UNKNOWN) & (score >= least)]

    return docs.select(names).mapInPandas(released(run), docs.schema)
