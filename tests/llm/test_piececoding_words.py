"""Words of a byte-pair model solved side by side: the ids of one word after the other, and of the library."""

import itertools
import random

import pytest

from twintrack.llm import piececoding as pc


@pytest.fixture(scope="module")
def vocabulary():
    with open(pc.default_model(), "rb") as f:
        return pc.Vocabulary.load(f.read())


def _texts(vocabulary) -> list[str]:
    rng, some = random.Random(4), list(vocabulary.ids)
    words = ["".join(rng.choice("aeinst") for _ in range(rng.randint(1, 70))) for _ in range(400)]
    words += ["".join(rng.choice(some) for _ in range(rng.randint(1, 3))).replace(pc.MARK, " ") for _ in range(400)]
    words += ["a" * k for k in range(1, 70)] + ["x\ny", "\U0001f600", "ok\U0001f600\n\nok", "\x00", "  two", " "]
    rng.shuffle(words)
    return [None, "", *(" ".join(words[k : k + 25]) for k in range(0, len(words), 25))]


def test_words_side_by_side_are_the_librarys(vocabulary):
    import numpy as np
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pc.default_model())
    texts = _texts(vocabulary)
    got = pc.Coder(vocabulary).encode_all(texts)
    assert got == [None if t is None else pc.Coder(vocabulary).encode(t) for t in texts]
    assert [np.frombuffer(g, "<i4").tolist() for g in got[1:]] == [library.encode(t) for t in texts[1:]]


def test_short_words_are_not_searched_one_by_one(vocabulary, monkeypatch):
    texts = [t and " ".join(w for w in t.split(" ") if len(w) < 50) for t in _texts(vocabulary)]
    want = [None if t is None else pc.Coder(vocabulary).encode(t) for t in texts]
    monkeypatch.setattr(pc.Coder, "_word_of_pairs", lambda *_: pytest.fail("a word was searched on its own"))
    assert pc.Coder(vocabulary).encode_all(texts) == want
    coder = pc.Coder(vocabulary)
    text = coder.marked(" ".join(t for t in texts if t))
    assert coder.path(text, 0, len(text), (0, -1), (0, -1)) == pc.Coder(vocabulary).encode_all([" ".join(t for t in texts if t)])[0]


def test_equal_scores_merge_from_the_left():
    pieces = [("<unk>", 0.0, "unknown"), *[(c, -9.0, "normal") for c in "abc" + pc.MARK], ("ab", -1.0, "normal"), ("bc", -1.0, "normal"), ("ca", -1.0, "normal"), ("bca", -2.0, "normal")]
    words = ["".join(w) for n in range(1, 7) for w in itertools.product("abc", repeat=n)]
    together, alone = pc.Coder(pc.Vocabulary(pieces, pc.BPE)), pc.Coder(pc.Vocabulary(pieces, pc.BPE))
    together.learn(words)
    assert len(together.memo) == len(words) and all(together.memo[w] == alone._word_of_pairs(w) for w in words)
