"""Texts of many megabytes: the same results as at once, in bounded memory."""

import subprocess
import sys

import numpy as np

from twintrack.llm import common, quality, simhash
from twintrack.llm.common import PIECE

from test_operators import plain_fingerprint, sentence

LONG = "\n".join(sentence(k % 500, 60) + f" end{k}" for k in range(9000))


def test_pieces_are_the_text_and_cut_no_word():
    text = LONG.encode()
    got = list(common.pieces(text))
    assert len(got) > 2 and b"".join(got) == text and [w for p in got for w in p.split()] == text.split()
    assert list(common.pieces(b"x" * (3 * PIECE))) == [b"x" * (3 * PIECE)] and list(common.pieces(b"")) == [b""]


def test_features_of_a_long_text_are_those_at_once():
    text = LONG.encode()
    words = quality.Words()
    count, n = words.tally(text)
    _, feature, sizes = words.features([text])
    assert n == sizes[0] and np.array_equal(count, np.bincount(feature, minlength=1 << quality.BITS))


def test_fingerprint_of_a_long_text():
    assert simhash.fingerprint(LONG.encode()) == plain_fingerprint(LONG)
    for text in ("x" * (2 * PIECE), "x" * PIECE + " " * PIECE + "Y", " " * (2 * PIECE), "a b c" + " " * (2 * PIECE)):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


CODE = """
import resource, sys
import numpy as np
from twintrack.llm import quality
text = (" ".join(f"word{k}" for k in range(20000)) + "\\n").encode()
text = text * (50_000_000 // len(text))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
w = np.ones(1 << quality.BITS, np.float32)
class Shared: value = (w, 0.0)
import pyarrow as pa
batch = pa.record_batch([pa.array([text])], ["text"])
list(quality._scores(Shared, [batch], 0))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_a_text_of_50_mb_is_scored_in_little_memory():
    got = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, check=True, cwd=__file__.split("/tests/")[0])
    assert int(got.stdout) < 300
