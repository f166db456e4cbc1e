"""Toxicity: bags of subword embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams (3 to 5 characters with end marks, and the whole word), each
hashed to a bucket, so a misspelling shares most of its vectors with the word it stands for. A window of 8 words is the mean
of its words; the softmax reads that mean. Labels are of whole documents, so training goes in two steps: first every window
has its document's label, then the windows of a toxic document that look cleanest are left out and the model is fitted on.
A document's score is calibrated from the softmax's logits for its most toxic window and for the bags of its most toxic words, so
it does not fade with the document's length. The calibration is fitted on rows held back from the fit.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, read, slices, small_batches, texts
from .training import remainder, sample

BITS, DIM, WINDOW = 16, 12, 8
BUCKETS = 1 << BITS
#: Bounds of the sample that the model is fitted on: labelled rows and bytes of text for each class.
TRAIN_ROWS, TRAIN_BYTES = 2000, 8_000_000
EPOCHS, RATE, DECAY = (2, 2, 2), 0.3, 2e-3
#: An n-gram counts if this many documents of the sample have it.
LEAST_DOCS = 4
#: One in so many sampled documents is held back for the calibration, if that gives ENOUGH of each class.
HOLD, ENOUGH = 4, 10
_CACHE, _PART = 300_000, 20_000
_PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "\u00a1\u00bf\u00ab\u00bb\u2018\u2019\u201c\u201d\u2026"


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character n-grams (each word's own bucket among them), and how many each word has.

    A word is lower-cased, stripped of punctuation at its ends and put between end marks.
    """
    marked = [f"<{w.decode('utf-8', 'replace').lower().strip(_PUNCTUATION)}>" for w in words]
    c = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    end = np.cumsum(size)
    word = np.repeat(np.arange(size.size), size)
    left = end[word] - np.arange(c.size)  # characters of the word from here on
    owners = [np.arange(size.size)]
    hashes = [np.fromiter((zlib.crc32(w.encode()) for w in marked), np.uint64, size.size) * np.uint64(0x9E3779B97F4A7C15)]
    h = np.zeros(c.size, np.uint64)
    for n in range(1, 6):
        h = h[: c.size - n + 1] * np.uint64(1_000_003) + c[n - 1 :] if c.size >= n else h[:0]
        if n >= 3:
            fits = left[: h.size] >= n
            owners.append(word[: h.size][fits])
            hashes.append((h[fits] ^ np.uint64(n << 56)) * np.uint64(0xC2B2AE3D27D4EB4F))
    owner = np.concatenate(owners)
    bucket = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=size.size)


def _windows(n: int) -> list[tuple[int, int]]:
    """Windows side by side over n words; the last one may be shorter."""
    return [(s, min(n, s + WINDOW)) for s in range(0, n, WINDOW)]


class Model:
    """``gain``: per bucket the difference of the two logits; ``scale`` and ``shift`` calibrate what ``peaks`` returns."""

    def __init__(self, gain: np.ndarray, bias: float = 0.0, scale=(0.0, 0.0, 0.0), shift: float = 0.0):
        self.gain, self.bias, self.scale, self.shift = gain, bias, np.asarray(scale, float), shift

    def peaks(self, batch: list[bytes | None], cache: dict[bytes, float]) -> np.ndarray:
        """Per text the logit of its most toxic window, and of the bags of its 3 and 8 most toxic words; NaN without words."""
        if len(cache) > _CACHE:
            cache.clear()
        out = np.full((len(batch), 3), np.nan)
        gain = self.gain
        split = [t.split() if t else [] for t in batch]
        new = list(set().union(*split) - cache.keys())
        for s in range(0, len(new), _PART):
            part = new[s : s + _PART]
            bucket, n = grams(part)
            cache.update(zip(part, (np.add.reduceat(gain[bucket], np.cumsum(n) - n) / n).tolist()))
        for i, words in enumerate(split):
            if not words:
                continue
            v = np.fromiter(map(cache.__getitem__, words), float, len(words))
            if v.size > WINDOW:
                c = np.concatenate([[0.0], np.cumsum(v)])
                window = (c[WINDOW:] - c[:-WINDOW]).max() / WINDOW
                top = np.sort(np.partition(v, -WINDOW)[-WINDOW:])
            else:
                window, top = v.mean(), np.concatenate([np.zeros(WINDOW - v.size), np.sort(v)])
            out[i] = window, top[-3:].mean(), top.mean()
        return out + self.bias

    def score(self, peaks: np.ndarray) -> np.ndarray:
        """Probability of label 1; 0 without words."""
        x = np.nan_to_num(peaks) @ self.scale + self.shift
        return np.where(np.isnan(peaks[:, 0]), 0.0, 0.5 * (1 + np.tanh(0.5 * x)))


class _Trainer:
    def __init__(self, rows: list[tuple[int, bytes]], seed: int):
        self.rng = np.random.default_rng(seed)
        index: dict[bytes, int] = {}
        spans, y, doc = [], [], []
        flat: list[np.ndarray] = []
        at = 0
        for k, (label, text) in enumerate(rows):
            words = text.split()
            flat.append(np.array([index.setdefault(w, len(index)) for w in words], np.int32))
            for s, e in _windows(len(words)):
                spans.append((at + s, at + e))
                y.append(label)
                doc.append(k)
            at += len(words)
        self.words = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        self.spans, self.y, self.doc = np.array(spans, np.int64).reshape(-1, 2), np.array(y), np.array(doc)
        vocab = list(index)
        made = [grams(vocab[s : s + _PART]) for s in range(0, len(vocab), _PART)]
        self.parts = np.concatenate([m[0] for m in made]) if made else np.zeros(0, np.int64)
        sizes = np.concatenate([m[1] for m in made]) if made else np.zeros(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        docs = np.zeros(BUCKETS, np.int64)
        for words in flat:
            w = np.unique(words)
            m = self.at[w + 1] - self.at[w]
            seen = np.zeros(BUCKETS, bool)
            seen[self.parts[np.repeat(self.at[w] - np.cumsum(m) + m, m) + np.arange(m.sum())]] = True
            docs += seen
        self.common = docs >= LEAST_DOCS
        self.emb = self.rng.normal(0, 0.1, (BUCKETS, DIM))
        self.out = np.zeros((DIM, 2))
        self.out[:, 1] = self.rng.normal(0, 0.1, DIM)
        self.b = np.zeros(2)
        self.g_emb, self.g_out = np.full(BUCKETS, 1e-2), 1e-2

    def bags(self, win: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, bucket, weight) of every n-gram of the windows."""
        n = self.spans[win, 1] - self.spans[win, 0]
        owner = np.repeat(np.arange(win.size), n)
        word = self.words[np.repeat(self.spans[win, 0], n) + np.arange(owner.size) - np.repeat(np.cumsum(n) - n, n)]
        m = self.at[word + 1] - self.at[word]
        row = np.repeat(owner, m)
        bucket = self.parts[np.repeat(self.at[word], m) + np.arange(row.size) - np.repeat(np.cumsum(m) - m, m)]
        return row, bucket, np.repeat(1.0 / (m * n[owner]), m) * self.common[bucket]

    def epoch(self, win: np.ndarray, batch: int = 512) -> None:
        """AdaGrad steps on the mean log-loss, embeddings and softmax together; both classes weigh alike."""
        share = np.clip(self.y[win].mean(), 1e-6, 1 - 1e-6)
        weight = np.array([0.5 / (1 - share), 0.5 / share])
        for k in range(0, win.size, batch):
            part = win[k : k + batch]
            row, bucket, w = self.bags(part)
            x = np.add.reduceat(self.emb[bucket] * w[:, None], np.flatnonzero(np.diff(row, prepend=-1)))
            logit = x @ self.out + self.b
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(part.size), self.y[part]] -= 1
            p *= weight[self.y[part]][:, None]
            gx = p @ self.out.T
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            used = bucket[order][first]
            ge = np.add.reduceat((gx[row] * w[:, None])[order], first)
            go = x.T @ p
            self.g_emb[used] += (ge**2).mean(1)
            self.g_out += float((go**2).mean())
            self.emb[used] = self.emb[used] * (1 - DECAY) - RATE * ge / np.sqrt(self.g_emb[used])[:, None]
            self.out -= RATE * 0.5 * go / np.sqrt(self.g_out)
            self.b -= 0.01 * p.mean(0)

    def gain(self) -> tuple[np.ndarray, float]:
        d = self.out[:, 1] - self.out[:, 0]
        return np.where(self.common, self.emb @ d, 0.0), float(self.b[1] - self.b[0])

    def logits(self) -> np.ndarray:
        gain, bias = self.gain()
        sums = np.add.reduceat(gain[self.parts], self.at[:-1]) / np.diff(self.at)
        c = np.concatenate([[0.0], np.cumsum(sums[self.words])])
        return (c[self.spans[:, 1]] - c[self.spans[:, 0]]) / (self.spans[:, 1] - self.spans[:, 0]) + bias


def fit(rows: list[tuple[int, bytes]], seed: int = 7) -> Model:
    """Model from (label 0/1, text) rows. Without both classes every score is the rows' share of label 1 (0.5 without rows)."""
    y = np.array([r[0] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(BUCKETS), shift=float(np.log(share / (1 - share))))
    held = np.array([zlib.crc32(text) % HOLD == 0 for _, text in rows])
    if min((y[held] == 0).sum(), (y[held] == 1).sum(), (y[~held] == 0).sum(), (y[~held] == 1).sum()) < ENOUGH:
        held = np.zeros(len(y), bool)
    every_row, rows = rows, [r for r, h in zip(rows, held) if not h]
    t = _Trainer(rows, seed)
    every = np.arange(t.y.size)
    for step, epochs in enumerate(EPOCHS):
        use = every
        if step:
            # of a toxic document the windows that stand out from nearly all windows of clean ones, and always the first of them
            logit = t.logits()
            top = np.full(len(rows), -np.inf)
            np.maximum.at(top, t.doc, logit)
            bar = np.quantile(logit[t.y == 0], 0.999)
            use = every[(t.y == 0) | (logit >= np.minimum(bar, top[t.doc]))]
        for _ in range(epochs):
            t.epoch(t.rng.permutation(use))
    gain, bias = t.gain()
    model = Model(gain.astype(np.float32).astype(float), bias)
    known = [k for k, h in enumerate(held) if h] or range(len(every_row))
    model.scale, model.shift = _calibrate(model.peaks([every_row[k][1] for k in known], {}), y[list(known)])
    return model


def _calibrate(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression of the label on the peaks, slightly shrunk, by Newton steps."""
    ok = ~np.isnan(m[:, 0])
    m, y = m[ok], y[ok]
    mean, sd = m.mean(0), m.std(0) + 1e-9
    x = np.column_stack([(m - mean) / sd, np.ones(len(m))])
    shrink = np.append(np.full(m.shape[1], 0.3), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 0.5 * (1 + np.tanh(0.5 * (x @ w)))
        h = x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + np.diag(shrink)
        step = np.linalg.solve(h, x.T @ (p - y) + shrink * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] * mean / sd).sum())


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on a bounded sample of ``labels(doc_id, y)``; see ``training.sample``."""
    got = sample(docs, labels, rows, most_bytes).collect()
    return fit([(r.y, r.text.encode()) for r in sorted(got, key=lambda r: (str(r.doc_id), r.y, r.text))])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): probability of label 1 for every row of ``docs``. A text that is null or has no word: 0."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2^16 numbers

    def run(batches):
        kept("toxicity", int)
        m, cache = shared.value, {}
        for b in batches:
            t = texts(b.column(1))
            peaks = np.concatenate([m.peaks(t[s:e], cache) for s, e in slices([len(x or b"") for x in t])] or [np.zeros((0, 3))])
            yield pa.record_batch([b.column(0), pa.array(m.score(peaks))], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def learnable(labels: DataFrame) -> DataFrame:
    """Labels that a toxicity model may learn from: crc32 of the id mod 5 is not 0."""
    return labels.where(remainder("doc_id", 5) != 0).select("doc_id", F.col("toxic").cast("int").alias("y")).where("y in (0, 1)")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    got = score(docs, train(docs, learnable(read(spark, sf_dir, "labels"))))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
