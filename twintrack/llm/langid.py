"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, fitted with FTRL and elastic-net penalties,
then temperature-calibrated on rows held back from the fit.

Features are the 1- to 3-character n-grams of the lower-cased text, hashed to 2^16 buckets; a bucket's value is its share of the
text's n-grams times its inverse document frequency. Document frequencies are counted over every document that may be learned
from; the weights are fitted on a bounded sample of them. A score is a sum of table entries over all n-grams of the whole text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, slices, small_batches, texts
from .ftrl import Ftrl, probabilities, temperature
from .training import remainder, sample

BITS = 16
SIZE = 1 << BITS
#: Bounds of the sample that the weights are fitted on: documents and bytes of text for each language.
TRAIN_ROWS, TRAIN_BYTES = 500, 3_000_000
EPOCHS = 3
#: One in so many sampled documents is held back for the temperature.
HOLD = 5
_SCALE = 10.0
_STEP = 1_000_000


def ngrams(text: bytes):
    """Hash buckets of the text's 1- to 3-character n-grams, in pieces of a bounded size (pieces overlap by two characters)."""
    c = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    for at in range(0, max(c.size, 1), _STEP):
        x = c[at : at + _STEP + 2]
        own = min(_STEP, c.size - at)
        a = x * np.uint32(0x9E3779B1)
        b = (a[:-1] ^ (x[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        t = (b[:-1] ^ (x[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        yield np.concatenate([a[:own] >> np.uint32(32 - BITS), b[:own] >> np.uint32(32 - BITS), t[:own] >> np.uint32(32 - BITS)])


def has_letter(text: bytes | None) -> bool:
    return bool(text) and any(map(str.isalpha, text.decode("utf-8", "replace")))


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that have each bucket, documents) over all rows of ``docs(text)``; null texts count as documents without n-grams."""

    def run(batches):
        df, n = np.zeros(SIZE + 1, np.int64), 0
        for b in batches:
            for t in texts(b.column(0)):
                n += 1
                if t:
                    seen = np.zeros(SIZE, bool)
                    for g in ngrams(t):
                        seen[g] = True
                    df[:-1] += seen
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at), pa.array(df[at])], ["k", "n"])

    small_batches(docs.sparkSession)
    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    out = np.zeros(SIZE + 1, np.int64)
    for r in counts.collect():  # 2^16 + 1 rows at most
        out[r.k] = r.n
    return out[:-1], int(out[-1])


def inverse(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1


#: Rows of the table that are looked up at once.
_LOOKUPS = 8192


class Model:
    """``table``: per bucket the logit shares of the languages (idf times weight), ``bias``: theirs, ``t``: the temperature."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, t: float):
        self.langs, self.table, self.bias, self.t = langs, table, bias, t

    def logits(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for g in ngrams(text):
            n += g.size
            if g.size <= _LOOKUPS:
                # a table lookup for each n-gram, summed for each language
                total += self.table[g].sum(0, dtype=np.float64)
                continue
            # of many, each bucket once, times its count; a few rows of the table at a time
            count = np.bincount(g, minlength=SIZE)
            at = np.flatnonzero(count)
            for s in range(0, at.size, _LOOKUPS):
                total += count[at[s : s + _LOOKUPS]] @ self.table[at[s : s + _LOOKUPS]].astype(np.float64)
        return total * (_SCALE / max(1, n)) + self.bias

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not has_letter(text) or not self.langs:
            return "und", 0.0
        p = probabilities(self.logits(text) / self.t) if len(self.langs) > 1 else np.ones(1)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def fit(rows: list[tuple[str, bytes]], idf: np.ndarray) -> Model:
    """Model from (language, text) rows. One language: it is always predicted. None: nothing is."""
    langs = sorted({r[0] for r in rows})
    if len(langs) < 2:
        return Model(langs, np.zeros((SIZE, len(langs)), np.float32), np.zeros(len(langs)), 1.0)
    x, y, hold = [], [], []
    for lang, text in rows:
        count = np.zeros(SIZE, np.int64)
        for g in ngrams(text):
            count += np.bincount(g, minlength=SIZE)
        at = np.flatnonzero(count)
        value = count[at] * idf[at] * (_SCALE / max(1, count.sum()))
        x.append((np.append(at, SIZE).astype(np.int32), np.append(value, 1.0).astype(np.float32)))
        y.append(langs.index(lang))
        hold.append(zlib.crc32(text) % HOLD == 0)
    learn = [k for k, h in enumerate(hold) if not h]
    if len({y[k] for k in learn}) < len(langs):
        learn = list(range(len(rows)))
    model = Ftrl(SIZE + 1, len(langs), alpha=0.5, l1=1e-3, l2=1e-3).fit([x[k] for k in learn], [y[k] for k in learn], EPOCHS)
    w = model.weights()
    held = [k for k, h in enumerate(hold) if h]
    z = np.array([x[k][1] @ w[x[k][0]] for k in held]).reshape(-1, len(langs))
    t = temperature(z, np.array([y[k] for k in held], np.int64))
    return Model(langs, (w[:-1] * idf[:, None]).astype(np.float32), w[-1], t)


def learnable(docs: DataFrame) -> DataFrame:
    """Documents that a language model may learn from: a known language, and crc32 of the id mod 4 is not 2."""
    return docs.where((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull())


def train(docs: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on ``docs(doc_id, text, lang)``: document frequencies over all of them, weights on a bounded sample of them."""
    idf = inverse(*document_frequency(docs))
    labels = docs.where("text is not null").select("doc_id", F.col("lang").alias("y"))
    got = sample(docs, labels, rows, most_bytes).collect()
    return fit([(r.y, r.text.encode()) for r in sorted(got, key=lambda r: (str(r.doc_id), r.y, r.text))], idf)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``. A text that is null or has no letter: ``und`` with score 0."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2^16 numbers for each language

    def run(batches):
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in texts(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    got = predict(docs, train(learnable(docs)))
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score")
