"""Many languages and a very long text: the same logits from counted buckets, in little memory."""

import tracemalloc

import numpy as np

from twintrack.llm import langid


def wide(langs):
    r = np.random.default_rng(1)
    return langid.Model([f"l{k}" for k in range(langs)], r.normal(size=(langid.SIZE, langs)).astype(np.float32), np.zeros(langs), 1.0)


def test_counted_buckets_give_the_same_logits(monkeypatch):
    model = wide(5)
    text = " ".join(f"mot{k % 977} \u00e9t\u00e9 {k}" for k in range(20_000)).encode()
    counted = model.logits(text)
    monkeypatch.setattr(langid, "_LOOKUPS", 1 << 40)
    np.testing.assert_allclose(counted, model.logits(text), rtol=1e-9, atol=1e-9)


def test_memory_does_not_grow_with_text_and_languages():
    model = wide(200)
    text = b" ".join(b"word%d" % (k % 5003) for k in range(2_400_000))
    assert len(text) > 20_000_000
    tracemalloc.start()
    model.predict(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
