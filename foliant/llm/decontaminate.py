"""Operator 3: benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages of two strides. TF-IDF counts run
over the benchmark's words (alphanumeric runs, A-Z lower-cased) and word pairs, terms in
more than ``MOST_DF`` of the segments being dropped unless they are among an
item's ``KEEP_TERMS`` rarest. A randomised SVD of the passages' matrix A needs
sums Z = A'A Omega, summed by Spark; the Nystrom form of it
(Halko, Martinsson, Tropp 2011) gives the leading right singular vectors. The
next pass projects every passage, takes as candidates the items at a cosine of
``LEAST_COSINE``, and confirms them by the longest common subsequence of words
and by the answer (what follows an ``answer:`` mark, else the last quarter).
Items of more than three strides are cut into passages of two strides, too, each
with its vector; the confirmation is on the whole item. Items that leak often weigh little and may leave the basis, so a passage that
holds ``LEAST_PAIRS`` of an item passage's distinct word pairs (of a single word: the
word) is a candidate too, whatever the frequencies.

What is broadcast depends on the benchmark alone, which is handled in blocks of
``ITEMS_AT_ONCE`` item passages; documents are streamed three times for a block: for
frequencies, for the weighted terms, which are written and few, and for the search. The inverse document
frequency is c / (df + c), without the logarithm: with it, common words take all
leading singular directions, and items that leaked a few times none. The rank
exceeds the block's item passages by ``OVERSAMPLE``, so each can have its direction.

Defined cases: null or empty texts match nothing; items without words, null
items and repeated items are ignored; rows with one id are judged together;
tables may be empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .common import Scratch, bounded, python_batches, table

STRIDE, ITEMS_AT_ONCE, OVERSAMPLE, SEED = 24, 1024, 64, 7
POWER = 1
MOST_DF, KEEP_TERMS, DF_FLOOR, LEAST_FLOOR = 1e-3, 8, 2e-5, 16
LEAST_COSINE, LEAST_SHARE, SURE_SHARE, LEAST_ANSWER = 0.35, 0.7, 0.9, 0.5
LEAST_PAIRS = 0.25


def lcs(words, masks: dict) -> int:
    """Length of the longest common subsequence with the item whose word positions ``masks`` holds (bit-parallel)."""
    row = 0
    for w in words:
        m = masks.get(w)
        if m:
            x = row | m
            row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


def positions(words) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | (1 << i)
    return out


def pairs(words):
    """Hashes of neighbouring words; one fewer than the words."""
    return ts.mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else words[:0]


def _words(text: str):
    words, _ = ts.scan(*ts.buffers(pa.array([text])), punct=True)
    return words


def cuts(n):
    """Starts and ends of the passages of an item of n words."""
    if n <= 3 * STRIDE:
        return [(0, n)]
    return [(min(at, n - 2 * STRIDE), min(at + 2 * STRIDE, n)) for at in range(0, n - STRIDE, STRIDE)]


class Items:
    """A block of item passages (item id, text, start, end), by item, and its vocabulary."""

    def __init__(self, rows):
        whole = list(dict.fromkeys((i, t) for i, t, _, _ in rows))
        self.ids = [i for i, _ in whole]
        self.words = [_words(t) for _, t in whole]
        of = {i: k for k, i in enumerate(self.ids)}
        #: the item of each passage
        self.item = np.array([of[i] for i, _, _, _ in rows], np.int64)
        cut = [self.words[k][a:b] for k, (_, _, a, b) in zip(self.item, rows, strict=True)]
        tails = [re.split(r"(?i)\banswer\s*:", t)[1:] for _, t in whole]
        self.answers = [_words(t[-1]) if t and len(_words(t[-1])) else w[-max(3, len(w) // 4) :] for t, w in zip(tails, self.words, strict=True)]
        self.grams = [np.concatenate([w, pairs(w)]) for w in cut]
        self.vocab = np.unique(np.concatenate(self.grams)) if rows else np.zeros(0, np.uint64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.vocab >> np.uint64(44)).astype(np.int64)] = True
        self.weights = np.ones(len(self.vocab), np.float32)
        # which passages hold a pair (of a single word: the word), in order of terms
        own = [np.unique(np.searchsorted(self.vocab, pairs(w) if len(w) > 1 else w)) for w in cut]
        held = np.concatenate(own) if rows else np.zeros(0, np.int64)
        order = np.argsort(held, kind="stable")
        self.holders = np.repeat(np.arange(len(own)), [len(o) for o in own])[order]
        self.held_from = np.searchsorted(held[order], np.arange(len(self.vocab) + 1))
        self.least = np.maximum(1, np.ceil(LEAST_PAIRS * np.array([len(o) for o in own]))).astype(np.int64)
        self.test = self.basis = self.vectors = None

    def plain(self, *names) -> dict:
        """The named attributes; arrays, lists and strings only, so executors need no module of ours to read them."""
        return {n: getattr(self, n) for n in names}

    @classmethod
    def of(cls, plain: dict) -> Items:
        out = object.__new__(cls)
        out.__dict__.update(plain)
        return out

    def terms(self, words):
        """(positions of the words that the items have, their terms)."""
        at = np.flatnonzero(self.bits[(words >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.vocab):
            return at[:0], at[:0]
        term = np.minimum(np.searchsorted(self.vocab, words[at]), len(self.vocab) - 1)
        ok = self.vocab[term] == words[at]
        return at[ok], term[ok]

    def weigh(self, df, n):
        floor = max(LEAST_FLOOR, DF_FLOOR * n)
        self.weights = (floor / (df + floor)).astype(np.float32)
        keep = df <= MOST_DF * n
        for w in self.grams:
            t = np.unique(np.searchsorted(self.vocab, w))
            keep[t[np.argsort(df[t], kind="stable")[:KEEP_TERMS]]] = True
        self.weights[~keep] = 0

    def draw(self):
        self.test = np.random.default_rng(SEED).standard_normal((len(self.vocab), min(len(self.item) + OVERSAMPLE, len(self.vocab)))).astype(np.float32)

    def project(self, z):
        omega = self.test.astype(np.float64)
        shift = 1e-9 * max(np.linalg.norm(z), 1e-12)
        z = z + shift * omega
        b = omega.T @ z
        low = np.linalg.cholesky((b + b.T) / 2 + 1e-12 * np.trace(b) / len(b) * np.eye(len(b)))
        u, s, _ = np.linalg.svd(np.linalg.solve(low, z.T).T, full_matrices=False)
        self.latent(u[:, s > 1e-6 * max(s[0], 1e-30)].astype(np.float32))

    def latent(self, basis):
        self.basis = basis
        self.test = None
        vectors = []
        for w in self.grams:
            v = np.zeros(len(self.vocab), np.float32)
            np.add.at(v, np.searchsorted(self.vocab, w), 1)
            v *= self.weights
            own = v @ self.basis
            vectors.append(own / max(np.linalg.norm(own), 1e-30))
        self.vectors = np.stack(vectors)


def occurrences(items: Items, words, first):
    """(segment numbers of each row's start, segment, term) of all terms, in order."""
    per = -(-np.diff(first) // STRIDE)
    base = np.concatenate([[0], np.cumsum(per)])
    at, term = items.terms(words)
    at2, term2 = items.terms(pairs(words))
    inside = np.searchsorted(first, at2, "right") == np.searchsorted(first, at2 + 1, "right")
    at, term = np.concatenate([at, at2[inside]]), np.concatenate([term, term2[inside]])
    order = np.argsort(at, kind="stable")
    at, term = at[order], term[order]
    row = np.searchsorted(first, at, "right") - 1
    return base, base[row] + (at - first[row]) // STRIDE, term


def segments(items: Items, words, first):
    """As occurrences(), of the weighted terms."""
    base, seg, term = occurrences(items, words, first)
    used = items.weights[term] > 0
    return base, seg[used], term[used]


def sharing(items: Items, base, seg, term):
    """(passage, item passage) where a passage holds enough of the other's distinct pairs; all occurrences are given."""
    n = np.diff(items.held_from)[term]
    at = np.repeat(np.arange(len(term)), n)
    item = items.holders[np.repeat(items.held_from[term], n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]
    seg, term = seg[at], term[at]
    before = seg > base[np.searchsorted(base, seg, "right") - 1]
    seg, item, term = (np.concatenate([x, x[before]]) for x in (seg, item, term))
    seg[len(before) :] -= 1
    key = seg * len(items.least) + item
    some, place, count = np.unique(key, return_inverse=True, return_counts=True)
    # repeats of a pair count once
    enough = (count >= items.least[some % len(items.least)])[place]
    some, count = np.unique(np.unique(np.stack([key[enough], term[enough]]), axis=1)[0], return_counts=True)
    some = some[count >= items.least[some % len(items.least)]]
    return some // len(items.least), some % len(items.least)


def by_segment(seg, rows):
    """(segments that occur, sums of their rows); ``seg`` is sorted."""
    heads = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    return seg[heads], np.add.reduceat(rows, heads, axis=0)


def passages(some, sums, base):
    """(passages that hold a term, their sums).

    Passage s is segment s and the next of its row, so a segment counts in its
    own passage and in the one before.
    """
    row = np.searchsorted(base, some, "right") - 1
    before = some > base[row]
    out = np.union1d(some, some[before] - 1)
    total = np.zeros((len(out), sums.shape[1]), sums.dtype)
    total[np.searchsorted(out, some)] += sums
    total[np.searchsorted(out, some[before] - 1)] += sums[before]
    return out, total


def _df(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items.of(shared.value)
        df, n = np.zeros(len(items.vocab), np.int64), 0
        for batch in batches:
            for _, data, offsets in ts.slices(batch.column("text")):
                base, seg, term = occurrences(items, *ts.scan(data, offsets, punct=True))
                n += int(base[-1])
                pairs = np.unique(seg * len(df) + term) if len(seg) else seg
                df += np.bincount(pairs % max(len(df), 1), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(df[some], n), pa.int64())], names=["term", "n"])

    return run


def _used(shared):
    """A row for each slice of texts: where each text's segments start, and the weighted terms by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items.of(shared.value)
        for batch in batches:
            for _, data, offsets in ts.slices(batch.column("text")):
                found = segments(items, *ts.scan(data, offsets, punct=True))
                if len(found[1]):
                    yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in found], names=["base", "seg", "term"])

    return run


def _range(shared):
    """Rows (term, its row of A'A Omega) over what _used() left of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, test = (shared.value[k] for k in ("weights", "test"))
        omega = test * weights[:, None]
        z = np.zeros(omega.shape, np.float64)
        for batch in batches:
            for k in range(batch.num_rows):
                base, seg, term = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("base", "seg", "term"))
                some, sums = by_segment(seg, omega[term])
                at, y = passages(some, sums, base)
                # back: a segment takes from its own passage and the one before
                back = y[np.searchsorted(at, some)]
                later = some > base[np.searchsorted(base, some, "right") - 1]
                back[later] += y[np.searchsorted(at, some[later] - 1)]
                order = np.argsort(term, kind="stable")
                hit, sums = by_segment(term[order], back[np.searchsorted(some, seg[order])])
                z[hit] += sums * weights[hit, None]
        some = np.flatnonzero(np.abs(z).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(list(z[some]), pa.list_(pa.float64()))], names=["term", "v"])

    return run


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items.of(shared.value)
        basis = items.basis * items.weights[:, None]
        squares = (items.weights**2)[:, None]
        masks = [positions(w.tolist()) for w in items.words]
        tails = [positions(w.tolist()) for w in items.answers]
        for batch in batches:
            ids = batch.column("doc_id")
            for start, data, offsets in ts.slices(batch.column("text")):
                words, first = ts.scan(data, offsets, punct=True)
                base, seg, term = occurrences(items, words, first)
                close = {(int(i), int(k)): 0.0 for i, k in zip(*sharing(items, base, seg, term), strict=True)}
                used = items.weights[term] > 0
                seg, term = seg[used], term[used]
                best: dict = {}
                if len(seg):
                    some, y = passages(*by_segment(seg, basis[term]), base)
                    norm = np.sqrt(passages(*by_segment(seg, squares[term]), base)[1])
                    cos = (y @ items.vectors.T) / norm
                    for i, k in close:
                        at = int(np.searchsorted(some, i))
                        if at < len(some) and some[at] == i:
                            close[i, k] = float(cos[at, k])
                    close |= {(int(some[i]), int(k)): float(cos[i, k]) for i, k in np.argwhere(cos >= LEAST_COSINE)}
                found_by: dict = {}
                for (i, k), cosine in close.items():
                    key = i, int(items.item[k])
                    found_by[key] = max(found_by.get(key, cosine), cosine)
                for (i, k), cosine in found_by.items():
                    row, size = int(np.searchsorted(base, i, "right")) - 1, len(items.words[k])
                    lo = first[row] + (i - base[row]) * STRIDE
                    near = words[max(first[row], lo - size) : min(first[row + 1], lo + 2 * STRIDE + size)].tolist()
                    share = lcs(near, masks[k]) / size
                    if share >= LEAST_SHARE:
                        answer = lcs(near, tails[k]) / len(items.answers[k])
                        if answer >= LEAST_ANSWER or share >= SURE_SHARE:
                            best[row, k] = max(best.get((row, k), (0, 0, -1)), (share, answer, cosine))
                found = sorted(best)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([start + int(r) for r, _ in found], pa.int64())),
                        pa.array([items.ids[k] for _, k in found], pa.int64()),
                        *(pa.array([round(min(best[f][j], 1.0), 3) for f in found], pa.float64()) for j in range(3)),
                    ],
                    names=["doc_id", "item_id", "share", "answer", "cosine"],
                )

    return run


FOUND = "doc_id long, item_id long, share double, answer double, cosine double"


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, lcs_share, answer_share, cosine) of documents that hold a benchmark item."""
    python_batches(spark)
    scratch = Scratch(spark, "leaks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = benchmark.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text")).orderBy("item_id")
    block, found = [], []
    for r in rows.toLocalIterator():
        n = len(_words(r["text"]))
        for a, b in cuts(n) if n else ():
            block.append((r["item_id"], r["text"], a, b))
            if len(block) == ITEMS_AT_ONCE:
                found.append(_search_block(spark, texts, Items(block), scratch))
                block = []
    if block:
        found.append(_search_block(spark, texts, Items(block), scratch))
    out = spark.createDataFrame([], FOUND)
    for b in found:
        out = out.union(b)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "answer", "cosine")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.share").alias("lcs_share"), F.col("b.answer").alias("answer_share"), F.round("b.cosine", 2).alias("cosine"))


def _search_block(spark: SparkSession, texts: DataFrame, items: Items, scratch: Scratch) -> DataFrame:
    """What the texts hold of one block of items, written; three passes over the texts, none after it."""
    sc = spark.sparkContext

    def share(*names):
        return sc.broadcast(items.plain(*names))

    # sums over all tasks: a row for each term of the block at most
    shared = share("vocab", "bits")
    df, n = np.zeros(len(items.vocab), np.int64), 0
    for r in texts.select("text").mapInArrow(_df(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] < 0:
            n = r["n"]
        else:
            df[r["term"]] = r["n"]
    shared.destroy()
    items.weigh(df, n)
    shared = share("vocab", "bits", "weights")
    kept = scratch.keep(texts.select("text").mapInArrow(_used(shared), "base array<int>, seg array<int>, term array<int>"), "used")
    shared.destroy()
    # each task sums a matrix of its own, so their number follows the cluster and not the texts
    used = kept.coalesce(2 * sc.defaultParallelism)
    items.draw()
    for step in range(1 + POWER):
        shared = share("weights", "test")
        sums = used.mapInArrow(_range(shared), "term long, v array<double>").groupBy("term").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
        z = np.zeros(items.test.shape)
        for r in sums.toLocalIterator():
            z[r["term"]] = r["v"].toArray()
        shared.destroy()
        if not z.any():
            # no weighted term occurs; word pairs may
            items.latent(np.zeros((len(items.vocab), 1), np.float32))
            break
        if step < POWER:
            items.test = np.linalg.qr(z)[0].astype(np.float32)
        else:
            items.project(z)
    shared = share("vocab", "bits", "weights", "words", "answers", "ids", "item", "holders", "held_from", "least", "basis", "vectors")
    found = scratch.keep(texts.mapInArrow(_search(shared), FOUND), "found")
    shared.destroy()
    scratch.drop(kept)
    return found


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item.

    Rows are judged by their text alone (its hash stands for the id), so repeated and
    null ids make no difference. A row goes along as one struct: no column's name can clash.
    """
    texts = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("text").cast("string")).alias("doc_id"))
    bad = leaks(spark, texts.select("doc_id", "row.text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    bad = bounded(Scratch(spark, "leaking").keep(bad, "bad"))
    return texts.join(bad, "doc_id", "left_anti").select("row.*")
