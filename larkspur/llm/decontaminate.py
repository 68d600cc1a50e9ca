"""Benchmark decontamination by latent semantic retrieval.

Passages make a TF-IDF matrix over the words of the benchmark (other words cannot add to a similarity with
an item); document frequencies count all passages of all documents.  A distributed randomised SVD gives the
latent space: every task multiplies its passages with a random matrix and back, the products are summed, and
the sum's directions are ordered by what the random matrix tells of the spectrum.  The space is fitted on all
passages of all documents and on the items.  Its leading directions (function words, languages) are left out:
they are alike in everything.  Windows of every document and the items are folded into the space.  A candidate
holds enough of the item's words (a bound that loses nothing) and has at least a low cosine with it; it is
checked by the longest common subsequence of words between the item and the text around the window; what is
less than a copy must also hold the item's answer (its last sentence).

Items are taken in blocks of a fixed size, so memory does not depend on how many there are.

Defined results: null and wordless texts match nothing; an item without words matches nothing; a document
is reported once for each item that it holds, rows that share an id together; repeated rows count once;
empty tables give an empty result; only ids and texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches, summed_vectors, table

#: Words are runs of ASCII letters (in lower case), digits and bytes of longer characters.
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
#: Words of a block: windows begin at blocks.
BLOCK = 8
#: Windows in blocks, for items of so many words at most (a window holds the item wherever it begins).
WINDOWS = (3, 4, 6, 9)
#: Words of a passage of the matrix.
PASSAGE = 32


@dataclass(frozen=True)
class Config:
    rank: int = 72
    #: Leading directions that are left out, and further ones that only make the others exact.
    skip: int = 16
    oversample: int = 16
    #: Least cosine of a candidate.
    cosine: float = 0.1
    #: Least share of the item's words in common order: a copy; a paraphrase that holds the answer.
    copy: float = 0.75
    paraphrase: float = 0.6
    answer: float = 0.7
    #: Items of one pass over the documents, and words at which a block of items ends earlier.
    items: int = 2000
    words: int = 60_000
    seed: int = 23


def words_in(text: str | None) -> list[bytes]:
    if not text:
        return []
    return (text if text.isascii() else text.lower()).encode("utf-8", "replace").translate(_SPLIT).split()


def answer_of(text: str) -> list[bytes]:
    """Words of the item's last line or sentence, if there is something before it."""
    parts = [p for p in re.split(r"[.!?\n]+\s*", text) if words_in(p)]
    return words_in(parts[-1]) if len(parts) > 1 else []


class Vocabulary(dict):
    """word -> number; unknown words have the number after the last."""

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.get, words, repeat(len(self))), np.int32, len(words))


def _term_blocks(x: np.ndarray, size: int = 256) -> pd.DataFrame:
    rows = [(k, np.ascontiguousarray(x[k * size : (k + 1) * size]).tobytes()) for k in range(-(-len(x) // size))]
    return pd.DataFrame(rows, columns=["key", "vec"])


def _gathered(docs: DataFrame, run, rows: int, cols: int) -> np.ndarray:
    """The sum over tasks of a (rows, cols) array of doubles that run(batches) yields in blocks of 256 rows."""
    size = 256
    pad = -(-rows // size) * size
    out = np.zeros((pad, cols))
    # rows x cols doubles come to the driver, whatever the number of documents
    for r in summed_vectors(docs.select("text").mapInPandas(released(run), "key int, vec binary"), "float64", size * cols).toLocalIterator():
        out[r["key"] * size : (r["key"] + 1) * size] = np.frombuffer(r["vec"]).reshape(size, cols)
    return out[:rows]


def passage_frequencies(docs: DataFrame, vocab: dict) -> tuple[np.ndarray, int]:
    """In how many passages each word of the vocabulary is, and how many passages there are."""
    d = len(vocab)
    pad = -(-(d + 1) // 256) * 256

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Vocabulary(vocab)
        acc = np.zeros(pad)
        for b in batches:
            for at in range(0, len(b), 100):
                rows = []
                for text in b["text"].iloc[at : at + 100]:
                    n = words.numbers(words_in(text))
                    # the last passage is filled up with the number of unknown words
                    rows.append(np.pad(n, (0, -len(n) % PASSAGE), constant_values=d))
                grid = np.concatenate(rows).reshape(-1, PASSAGE)
                grid.sort(axis=1)
                first = np.ones(grid.shape, bool)
                first[:, 1:] = grid[:, 1:] != grid[:, :-1]
                acc[:d] += np.bincount(grid[first], minlength=d + 1)[:d]
                acc[d] += len(grid)  # the last place counts passages
        yield _term_blocks(acc[:, None])

    got = _gathered(docs, run, d + 1, 1)[:, 0]
    return got[:d], int(got[d])


def _passage_rows(numbers: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Word, passage and unit-length TF-IDF weight of every (passage, word) of texts given as word numbers."""
    d = len(idf)
    key, base = [], 0
    for n in numbers:
        p = np.arange(len(n)) // PASSAGE + base
        known = n < d
        key.append(p[known].astype(np.int64) * d + n[known])
        base += -(-len(n) // PASSAGE)
    pair, tf = np.unique(np.concatenate(key) if key else np.zeros(0, np.int64), return_counts=True)
    passage, word = pair // d, pair % d
    w = tf * idf[word]
    norm = np.sqrt(np.bincount(passage, w * w, base))
    return word, passage, (w / np.maximum(norm[passage], 1e-12)).astype(np.float32), base


def _gram(word: np.ndarray, passage: np.ndarray, w: np.ndarray, n: int, om: np.ndarray, into: np.ndarray) -> None:
    """Adds A' (A om) to into, for the passages' matrix A given by its entries (as of _passage_rows)."""
    if not len(word):
        return
    size = 1024  # a block of entries stays in the cache
    held = np.empty((size, om.shape[1]), np.float32)

    def add(rows: np.ndarray, of: np.ndarray, by: np.ndarray, w: np.ndarray, into: np.ndarray) -> None:
        """Adds w times the rows of an array to those of into that by names, in order of by."""
        for k in range(0, len(w), size):
            at = by[k : k + size]
            part = held[: len(at)]
            np.take(rows, of[k : k + size], axis=0, out=part, mode="clip")
            part *= w[k : k + size, None]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            into[at[first]] += np.add.reduceat(part, first, axis=0)

    # entries come by passage: sum each passage's words, then each word's passages
    p = np.zeros((n, om.shape[1]), np.float32)
    add(om, word, passage, w, p)
    order = np.argsort(word, kind="stable")
    add(p, passage[order], word[order], w[order], into)


def _product(docs: DataFrame, vocab: dict, idf: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """A' (A omega) for the passage matrix A, summed over all tasks."""
    d, k = omega.shape
    pad = -(-d // 256) * 256
    om = omega.astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Vocabulary(vocab)
        acc = np.zeros((pad, k))
        for b in batches:
            for at in range(0, len(b), 100):
                _gram(*_passage_rows([words.numbers(words_in(t)) for t in b["text"].iloc[at : at + 100]], idf), om, acc)
        yield _term_blocks(acc)

    return _gathered(docs, run, d, k)


def latent_space(docs: DataFrame, vocab: dict, items: list[np.ndarray], cfg: Config = Config()) -> tuple[np.ndarray, np.ndarray]:
    """(weights of words, directions): squared idf, and right singular vectors of the passages' matrix."""
    d = len(vocab)
    df, n = passage_frequencies(docs, vocab)
    own = np.zeros(d)
    for x in items:
        own[np.unique(x)] += 1
    weight = np.log((n + len(items) + 1) / (df + own + 0.5)) ** 2
    k = min(cfg.skip + cfg.rank + cfg.oversample, d)
    omega = np.random.default_rng(cfg.seed).normal(0, 1, (d, k))
    y = _product(docs, vocab, weight, omega)
    _gram(*_passage_rows(items, weight), omega.astype(np.float32), y)
    # the sketch's product with its random matrix tells how much of the spectrum each direction holds
    c = omega.T @ y
    vals, vecs = np.linalg.eigh((c + c.T) / 2)
    good = vals > vals.max() * 1e-9
    u, _, _ = np.linalg.svd(y @ (vecs[:, good] / np.sqrt(vals[good])), full_matrices=False)
    # small vocabularies keep what there is
    skip = cfg.skip if u.shape[1] >= 4 * cfg.skip else 0
    return weight, u[:, skip : skip + cfg.rank]


def places_of(a: list[bytes]) -> dict[bytes, int]:
    """word -> the bits of its places in a."""
    where: dict[bytes, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    return where


def lcs(a: list[bytes], b: list[bytes], where: dict[bytes, int] | None = None) -> int:
    """Length of the longest common subsequence, by the bits of long integers; where: places_of(a), if known."""
    where = places_of(a) if where is None else where
    full = (1 << len(a)) - 1
    v = full
    for u in map(where.get, b):
        if u:
            u &= v
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Query:
    """One passage of an item, ready to be searched."""

    item: object
    words: list[bytes]
    answer: list[bytes]
    offset: int  # of the passage in the item
    size: int  # of the passage, in words
    window: int  # in blocks


def queries_of(items: list[tuple[object, str | None]]) -> list[Query]:
    out = []
    longest = WINDOWS[-1] * BLOCK - BLOCK + 1
    for key, text in items:
        w = words_in(text)
        if not w:
            continue
        starts = range(0, max(len(w) - longest // 2, 1), longest // 2) if len(w) > longest else [0]
        for s in starts:
            n = min(longest, len(w) - s)
            window = next(k for k in WINDOWS if n + BLOCK - 1 <= k * BLOCK or k == WINDOWS[-1])
            out.append(Query(key, w, answer_of(text), s, n, window))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc_id, item_id, cosine, overlap, start (word): every document that holds an item, once an item."""
    spark = docs.sparkSession
    small_batches(spark, 400)
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, overlap double, start int"
    found = None
    block: list = []
    words = 0
    # items come to the driver a block at a time
    rows = benchmark.select("item_id", "text").filter("text is not null").distinct().orderBy("item_id", "text").toLocalIterator()
    for r in rows:
        block.append((r["item_id"], r["text"]))
        words += len(words_in(r["text"]))
        if len(block) == cfg.items or words >= cfg.words:
            part = _search(docs, queries_of(block), schema, cfg)
            found, block, words = part if found is None else found.unionByName(part), [], 0
    if block or found is None:
        part = _search(docs, queries_of(block), schema, cfg)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("overlap", "cosine", (-F.col("start")).alias("start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.cosine").alias("cosine"), F.col("b.overlap").alias("overlap"), (-F.col("b.start")).alias("start"))


class Searcher:
    """Looks for the passages of items in batches of whole texts.

    A text that shares the needed part of a passage's words in order shares that many words at all, and so one at
    least of the passage's rarest ones (as many as may be missing, and one more).  Only windows around such a word
    are folded into the space: the bound loses nothing and spares most windows their cosine."""

    def __init__(self, vocab: dict, fold: np.ndarray, folded: np.ndarray, rarity: np.ndarray, queries: list[Query], cfg: Config):
        self.words, self.fold, self.folded, self.queries, self.cfg = Vocabulary(vocab), fold, folded, queries, cfg
        self.window = np.array([q.window for q in queries])
        self.needs = np.array([int(np.ceil(cfg.paraphrase * q.size - 1e-9)) for q in queries])
        self.where = [places_of(q.words) for q in queries]
        self.answers = [places_of(q.answer) for q in queries]
        holds: list[list[int]] = [[] for _ in range(len(vocab) + 1)]
        has = np.zeros((len(queries), len(vocab) + 1), np.uint8)
        for i, q in enumerate(queries):
            own = self.words.numbers(q.words[q.offset : q.offset + q.size])
            rare = own[np.argsort(-rarity[own], kind="stable")][: q.size - self.needs[i] + 1]
            for w in np.unique(rare):
                holds[w].append(i)
            has[i, self.words.numbers(q.words)] = 1
        self.many = np.array([len(h) for h in holds])
        self.begin = np.concatenate([[0], np.cumsum(self.many)])
        self.listed = np.array([i for h in holds for i in h], np.int64)
        # a bit for each query and word: a block of items has a bounded number of either
        self.has = np.packbits(has, axis=1, bitorder="little")

    def _shared(self, q: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """How many words of each block (rows of blocks of numbers) its query has."""
        return ((self.has[q[:, None, None], blocks >> 3] >> (blocks & 7).astype(np.uint8)) & 1).sum(axis=2, dtype=np.int32)

    def search(self, texts: list[str | None]) -> list[tuple[int, object, float, float, int]]:
        """(number of the text, item, cosine, overlap, first word) of every item that a text holds, once an item."""
        out = []
        held: list[tuple[int, list[bytes], np.ndarray]] = []
        total = 0
        for t, text in enumerate(texts):
            w = words_in(text)
            if w:
                held.append((t, w, self.words.numbers(w)))
                total += len(w)
            if total > 100_000:
                out += self._some(held)
                held, total = [], 0
        return out + (self._some(held) if held else [])

    def _some(self, held: list) -> list:
        unknown = len(self.words)
        widest = int(self.window.max())
        # texts stand one after another, each followed by so many unknown words that no window holds two texts
        parts, firsts, at = [np.full(BLOCK, unknown, np.int32)], [], BLOCK
        for _, _, n in held:
            gap = -len(n) % BLOCK + (widest + 1) * BLOCK
            parts += [n, np.full(gap, unknown, np.int32)]
            firsts.append(at)
            at += len(n) + gap
        firsts = np.array(firsts)
        flat = np.concatenate([*parts, np.full((widest + 1) * BLOCK, unknown, np.int32)])
        grid = flat.reshape(-1, BLOCK)
        hit = np.flatnonzero(self.many[flat])
        if not len(hit):
            return []
        times = self.many[flat[hit]]
        where = np.repeat(hit // BLOCK, times)
        # places in the list of queries, run by run
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        q = self.listed[np.repeat(self.begin[flat[hit]], times) + step]
        key = np.unique(q * len(grid) + where)
        q, where = key // len(grid), key % len(grid)
        found: dict[tuple[int, object], tuple[float, float, int]] = {}
        for k in np.unique(self.window[q]):
            mine = self.window[q] == k
            qs, ws = q[mine], where[mine]
            # every window that may hold the word, with a block of slack on either side
            key = []
            for lo in range(0, len(qs), 4096):
                i, b = qs[lo : lo + 4096], ws[lo : lo + 4096]
                around = np.clip(b[:, None] + np.arange(-k - 1, k + 2), 0, len(grid) - 1)
                upto = np.zeros((len(i), 2 * k + 4), np.int32)
                np.cumsum(self._shared(i, grid[around]), axis=1, out=upto[:, 1:])
                row, col = np.nonzero(upto[:, k + 2 :] - upto[:, : k + 2] >= self.needs[i][:, None])
                key.append(i[row] * len(grid) + b[row] - k + col)
            key = np.unique(np.concatenate(key))
            qs, start = key // len(grid), key % len(grid)
            ok = (start >= firsts[0] // BLOCK) & (start + k + 1 <= len(grid))
            qs, start = qs[ok], start[ok]
            for lo in range(0, len(qs), 8192):
                i, s = qs[lo : lo + 8192], start[lo : lo + 8192]
                wide = grid[s[:, None] + np.arange(0, k)].reshape(len(s), -1)
                for at in range(0, len(i), 512):
                    v = self.fold[wide[at : at + 512]].sum(axis=1)
                    sim = np.einsum("ij,ij->i", v, self.folded[i[at : at + 512]]) / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-6)
                    for x in np.flatnonzero(sim >= self.cfg.cosine):
                        place = int(s[at + x]) * BLOCK
                        text = int(np.searchsorted(firsts, place, side="right")) - 1
                        self._check(found, held[text], int(i[at + x]), float(sim[x]), place - int(firsts[text]))
        return [(t, item, h[1], h[0], h[2]) for (t, item), h in found.items()]

    def _check(self, found: dict, text: tuple, i: int, cos: float, at: int) -> None:
        q, c = self.queries[i], self.cfg
        lo = max(0, at - q.offset - BLOCK)
        near = text[1][lo : at + (q.window + 1) * BLOCK + len(q.words) - q.offset - q.size]
        share = lcs(q.words, near, self.where[i]) / len(q.words)
        if share < c.paraphrase:
            return
        if share < c.copy and (not q.answer or lcs(q.answer, near, self.answers[i]) < c.answer * len(q.answer)):
            return
        old = found.get((text[0], q.item))
        if old is None or (share, cos) > old[:2]:
            found[text[0], q.item] = (share, cos, lo)


def searcher_of(docs: DataFrame, queries: list[Query], cfg: Config) -> tuple:
    """The parts of a Searcher: the space is fitted on docs and the queries."""
    vocab = {w: k for k, w in enumerate(sorted({w for q in queries for w in q.words}))}
    known = Vocabulary(vocab)
    parts = [known.numbers(q.words[q.offset : q.offset + q.size]) for q in queries]
    weight, space = latent_space(docs, vocab, parts, cfg)
    fold = np.zeros((len(vocab) + 1, space.shape[1]), np.float32)
    fold[:-1] = weight[:, None] * space
    folded = np.stack([fold[p].sum(axis=0) for p in parts])
    folded /= np.maximum(np.linalg.norm(folded, axis=1, keepdims=True), 1e-12)
    return vocab, fold, folded, weight


def _search(docs: DataFrame, queries: list[Query], schema: str, cfg: Config) -> DataFrame:
    spark = docs.sparkSession
    if not queries:
        return spark.createDataFrame([], schema)
    # of fixed size: the words, directions and items of one block
    held = spark.sparkContext.broadcast((*searcher_of(docs, queries, cfg), [vars(q) for q in queries]))
    conf = vars(cfg)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        *parts, raw = held.value
        s = Searcher(*parts, [Query(**r) for r in raw], Config(**conf))
        for b in batches:
            got = s.search(list(b["text"]))
            if got:
                ids = b["doc_id"].iloc[[g[0] for g in got]]
                yield pd.DataFrame({"doc_id": ids.values, **{c: [g[k + 1] for g in got] for k, c in enumerate(("item_id", "cosine", "overlap", "start"))}})

    return docs.select("doc_id", "text").mapInPandas(released(run), schema)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Query: every document that holds a benchmark item, with the item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Pipeline decision: documents that hold an item go, by id; of rows without an id all go if any holds one."""
    from .common import staged, without

    bad = staged(leaks(docs, benchmark, cfg).select("doc_id").distinct(), "leaks")
    kept = without(docs, "doc_id", bad)
    return kept.filter("doc_id is not null") if bad.filter("doc_id is null").limit(1).count() else kept
