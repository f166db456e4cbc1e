"""Samples and scores of the classifiers against plain versions."""

import math
import zlib

import numpy as np
import pytest
from test_operators import ROWS, labelled, sentence  # noqa: F401

from twintrack.llm import ftrl, langid, quality, toxicity, training


@pytest.mark.parametrize("rows", [3, 40])
def test_sample_has_the_rows_that_come_first(spark, rows):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, "a" if k % 50 else "b") for k in range(600)] + [(3, "b"), (None, "a"), (700, "a")], "doc_id long, y string")
    got = training.sample(docs, labels, rows, 10**6).collect()
    hashes = dict(spark.range(600).selectExpr("id", "xxhash64(cast(id as string)) h").collect())
    for y in "ab":
        mine = sorted((k for k in range(600) if k != 3 and (y == "a") == bool(k % 50)), key=hashes.get)[:rows]
        own = {r.doc_id for r in got if r.y == y}
        assert own <= set(mine) and len(own) >= min(rows, len(mine)) - 1  # 700 has no text
    few = training.sample(docs, labels, 40, 30).collect()
    assert sum(len(r.text) for r in few if r.y == "a") <= 30


def plain_step(z, n, alpha, l1, l2, row, y):
    """One FTRL update of a logistic model, number by number."""
    w = {k: 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((1 + math.sqrt(n[k])) / alpha + l2) for k, _ in row}
    p = 1 / (1 + math.exp(-sum(w[k] * x for k, x in row)))
    for k, x in row:
        g = (p - y) * x
        s = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha
        z[k] += g - s * w[k]
        n[k] += g * g


def test_ftrl_is_the_plain_update():
    r = np.random.default_rng(3)
    model, z, n = ftrl.Ftrl(30, 1, alpha=0.3, l1=0.05, l2=0.1), [0.0] * 30, [0.0] * 30
    for _ in range(200):
        at = np.sort(r.choice(30, 5, replace=False))
        x, y = r.normal(size=5), int(r.random() < 0.4)
        model.step(at, x, y)
        plain_step(z, n, 0.3, 0.05, 0.1, list(zip(at.tolist(), x.tolist())), y)
    assert model.z[:, 0] == pytest.approx(z) and model.n[:, 0] == pytest.approx(n)


def test_quality_scores_are_sums_over_features(spark, labelled):  # noqa: F811
    docs, labels = labelled
    w, bias = quality.train(docs, quality.learnable(labels))
    got = {r.doc_id: r.score for r in quality.score(docs, (w, bias)).collect()}
    words = quality.Words()
    for k, text, _ in docs.limit(50).collect():
        weights = w.astype(np.float32)
        feature = words.features([text.encode()])[1].tolist()
        dot = sum(float(weights[f]) for f in feature) * 10 / len(text.split()) + bias
        assert got[k] == pytest.approx(1 / (1 + math.exp(-dot)), abs=1e-6)


def test_language_scores_are_sums_over_ngrams(spark, labelled):  # noqa: F811
    docs, _ = labelled
    model = langid.train(langid.learnable(docs))
    for k, text, _ in docs.limit(20).collect():
        low, z, n = text.lower(), np.zeros(len(model.langs)), 0
        for at in range(len(low)):
            for size in (1, 2, 3):
                if at + size <= len(low):
                    # the bucket of one n-gram is the last of its own text's
                    bucket = np.concatenate(list(langid.ngrams(low[at : at + size].encode())))[-1]
                    z += model.table[bucket]
                    n += 1
        z = (z * 10 / n + model.bias) / model.t
        p = np.exp(z - z.max())
        assert model.predict(text.encode()) == (model.langs[int(z.argmax())], pytest.approx((p / p.sum()).max(), abs=1e-5))


def test_toxicity_scores_are_means_over_bags(labelled):  # noqa: F811
    docs, labels = labelled
    model = toxicity.train(docs, toxicity.learnable(labels))
    for _, text, _ in docs.limit(30).collect():
        words = text.encode().split()
        value = [model.gain[toxicity.grams([w])[0]].mean() for w in words]
        spans = range(max(1, len(value) - 7))
        worst = max(np.mean(value[s : s + 8]) for s in spans)
        top = sorted(value + [0.0] * (8 - len(value)))[-8:]
        z = np.array([worst, np.mean(top[-3:]), np.mean(top)]) + model.bias
        want = 1 / (1 + math.exp(-(z @ model.scale + model.shift)))
        assert model.score(model.peaks([text.encode()], {}))[0] == pytest.approx(want, abs=1e-9)


def test_toxicity_is_calibrated_on_rows_held_back(labelled, monkeypatch):  # noqa: F811
    docs, labels = labelled
    y = dict(labels.select("doc_id", "toxic").collect())
    rows = [(y[r.doc_id], r.text.encode()) for r in docs.collect()]
    fitted, seen = toxicity._Trainer, []
    monkeypatch.setattr(toxicity, "_Trainer", lambda r, seed: seen.append(r) or fitted(r, seed))
    toxicity.fit(rows)
    assert seen[0] == [r for r in rows if zlib.crc32(r[1]) % toxicity.HOLD]
