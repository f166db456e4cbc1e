"""Quality classifier: hashed word n-gram logistic regression fitted with FTRL updates, scored as sparse dot products.

A document's n-grams are its words, word pairs, word shapes (letters as a or A, digits as 0, runs as two), shape pairs, and a
mark for a word that repeats the one before. Each is hashed to one of 2^18 features; a feature's value is its share of the
document's words. Case, punctuation and repetition thus count in languages and words that no labelled row has shown.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, kept, pieces, read, slices, small_batches, texts
from .ftrl import Ftrl, probabilities
from .training import remainder, sample

BITS = 18
#: Bounds of the sample that the weights are fitted on: labelled rows and bytes of text for each class.
TRAIN_ROWS, TRAIN_BYTES = 1500, 16_000_000
EPOCHS = 4
_SCALE = 10.0
_CACHE = 200_000
_SHAPE = bytes(ord("a") if 97 <= c < 123 or c >= 128 else ord("A") if 65 <= c < 91 else ord("0") if 48 <= c < 58 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


class Words:
    """Words of texts as pairs of hashes (word, shape), remembered in a bounded cache."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def code(self, word: bytes) -> int:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            shape = _RUN.sub(rb"\1\1", word.translate(_SHAPE))
            got = self.cache[word] = zlib.crc32(word.lower()) << 31 | zlib.crc32(shape) >> 1
        return got

    def features(self, batch: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature) of every n-gram of every text, and the words of each row."""
        split = [t.split() if t else [] for t in batch]
        n = np.array([len(w) for w in split], np.int64)
        return *self.grams(self.codes([w for words in split for w in words]), np.repeat(np.arange(len(batch)), n)), n

    def codes(self, words: list[bytes]) -> np.ndarray:
        get, code = self.cache.get, self.code
        return np.fromiter((get(w) or code(w) for w in words), np.int64, len(words))

    def tally(self, text: bytes) -> tuple[np.ndarray, int]:
        """How often a text of any length has each feature, and its words; a piece of the text at a time."""
        count, n, last = np.zeros(1 << BITS, np.int64), 0, np.zeros(0, np.int64)
        for piece in pieces(text):
            both = self.codes(piece.split())
            if not both.size:
                continue
            # the last word of the piece before, for the pair across the cut
            for part, sign in ((np.concatenate([last, both]), 1), (last, -1)):
                count += sign * np.bincount(self.grams(part, np.zeros(part.size, np.int64))[1], minlength=1 << BITS)
            n, last = n + both.size, both[-1:]
        return count, n

    @staticmethod
    def grams(both: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of every n-gram of words that follow each other in a row."""
        word, shape = both >> 31, both & 0x7FFFFFFF
        inner = row[1:] == row[:-1]
        r2 = row[1:][inner]
        w1, w2, s1, s2 = word[:-1][inner], word[1:][inner], shape[:-1][inner], shape[1:][inner]
        again = w1 == w2
        parts = [(row, _mix(word, 1)), (row, _mix(shape, 2)), (r2, _mix(w1 * 31 + w2, 3)), (r2, _mix(s1 * 31 + s2, 4)), (r2[again], _mix(np.zeros(again.sum(), np.int64), 5))]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _mix(h: np.ndarray, channel: int) -> np.ndarray:
    x = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(channel << 40 | channel)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def fit(rows: list[tuple[int, bytes]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias) from (label 0/1, text) rows. Without both classes the bias alone is the log odds of the rows' share."""
    y = [int(r[0]) for r in rows]
    if len(set(y)) < 2:
        share = (sum(y) + 1) / (len(y) + 2)
        return np.zeros(1 << BITS), float(np.log(share / (1 - share)))
    words, x = Words(), []
    for _, text in rows:
        count, n = words.tally(text)
        at = np.flatnonzero(count)
        x.append((np.append(at, 1 << BITS).astype(np.int32), np.append(count[at] * (_SCALE / max(1, n)), 1.0).astype(np.float32)))
    model = Ftrl((1 << BITS) + 1, 1, alpha=0.3, l1=2e-2, l2=1e-2).fit(x, y, epochs)
    w = model.weights()[:, 0]
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES):
    """Fit on a bounded sample of ``labels(doc_id, y)``; see ``training.sample``."""
    got = sample(docs, labels, rows, most_bytes).collect()
    return fit([(r.y, r.text.encode()) for r in sorted(got, key=lambda r: (str(r.doc_id), r.y, r.text))])


def _scores(shared, batches, at: int):
    """(batch, scores) of Arrow batches whose column ``at`` has the texts."""
    w, bias = shared.value
    words = kept("quality", Words)
    for b in batches:
        t = texts(b.column(at))
        out = np.zeros(len(t))
        for s, e in slices([len(x or b"") for x in t], PIECE):
            if e - s == 1 and t[s] and len(t[s]) > PIECE:
                count, n = words.tally(t[s])
                dot, n = np.array([count @ w.astype(float)]), np.array([n])
            else:
                row, feature, n = words.features(t[s:e])
                dot = np.bincount(row, weights=w[feature], minlength=e - s)
            dot = dot * (_SCALE / np.maximum(n, 1)) + bias
            out[s:e] = np.where(n > 0, probabilities(dot[:, None])[:, 0], 0.0)
        yield b, out


def _share(docs: DataFrame, model):
    small_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # 2^18 weights


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score): probability of label 1 for every row of ``docs``. A text that is null or has no word: 0."""
    shared = _share(docs, model)

    def run(batches):
        for b, out in _scores(shared, batches, 1):
            yield pa.record_batch([b.column(0), pa.array(out)], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def accepted(docs: DataFrame, model) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least 0.5."""
    shared, at = _share(docs, model), docs.columns.index("text")

    def run(batches):
        for b, out in _scores(shared, batches, at):
            yield b.filter(pa.array(out >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def learnable(labels: DataFrame) -> DataFrame:
    """Labels that a quality model may learn from: crc32 of the id mod 3 is not 1."""
    return labels.where(remainder("doc_id", 3) != 1).select("doc_id", F.col("quality").cast("int").alias("y")).where("y in (0, 1)")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, learnable(read(spark, sf_dir, "labels")))
    got = score(docs, model)
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score at least 0.5), with the columns of ``docs``.

    The model is fitted on the labelled rows among ``docs``; a document's own row decides, repeated ids included.
    """
    model = train(docs, learnable(read(spark, sf_dir, "labels")))
    return accepted(docs, model)
