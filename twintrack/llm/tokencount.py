"""Edit-aware token counts with pre-token segment trees.

A document's tree has a leaf for each run of LEAF pre-tokens, with its characters and its tokens, and above them the sums of
subtrees. An edit finds its leaf by descending the character sums, re-encodes the leaves it touches, with boundary context on the
left and on to where the new pre-tokens meet an old leaf boundary again on the right, and updates the sums on the way up. The rest
is not looked at. Pre-tokens split the text by the tokenizer's pattern from left to right, without looking back, so splitting
agrees for good once a boundary is met; byte-pair merges never cross a pre-token.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, small_batches, texts

LEAF = 32
_CACHE = 300_000
#: How far the pattern looks ahead of a pre-token's end, white space aside.
_AHEAD = 3
_PIECE = 4096


def default_vocabulary() -> tuple[str, str]:
    """(path of a ranks file, split pattern) of the installed public byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Counter:
    """Tokens of pre-tokens, remembered in a bounded cache."""

    def __init__(self, ranks_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.cache: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        cache = self.cache
        try:
            return [cache[p] for p in parts]
        except KeyError:
            if len(cache) > _CACHE:
                cache.clear()
            for p in parts:
                if p not in cache:
                    cache[p] = len(self.encoding.encode_ordinary(p))
            return [cache[p] for p in parts]


class Tree:
    """Segment tree of one document: leaves in order, ``sums[k]`` of node k over its children 2k and 2k + 1; column 0 characters, 1 tokens."""

    def __init__(self, counter: Counter, text: str, leaves: np.ndarray | None = None):
        self.counter, self.text = counter, text
        #: characters that edits have split again
        self.again = 0
        self._grow(self._leaves(counter.split.findall(text)) if leaves is None else leaves)

    def _leaves(self, parts: list[str]) -> np.ndarray:
        if not parts:
            return np.zeros((0, 2), np.int64)
        at = np.arange(0, len(parts), LEAF)
        chars = np.fromiter(map(len, parts), np.int64, len(parts))
        tokens = np.array(self.counter.counts(parts), np.int64)
        return np.column_stack([np.add.reduceat(chars, at), np.add.reduceat(tokens, at)])

    def _grow(self, leaves: np.ndarray) -> None:
        self.width = 1 << max(0, int(len(leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(leaves)] = leaves
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaves(self) -> np.ndarray:
        got = self.sums[self.width :]
        return got[got[:, 0] > 0]

    def find(self, char: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a character; the last non-empty one for the end of the text."""
        char = min(char, len(self.text) - 1)
        k, start = 1, 0
        while k < self.width:
            left = int(self.sums[2 * k, 0])
            k, start = (2 * k, start) if char - start < left else (2 * k + 1, start + left)
        return k - self.width, start

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters [start, stop) by ``new``. Positions outside the text are moved to its ends."""
        n = len(self.text)
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        old = self.text
        self.text = old[:start] + new + old[stop:]
        if not old or not self.text:
            self._grow(self._leaves(self.counter.split.findall(self.text)))
            self.again += len(self.text)
            return
        # context: a leaf boundary whose left neighbours can't see the edit
        first, at = self.find(start)
        while first > 0 and (at + _AHEAD > start or not old[at:start].strip()):
            first, at = self.find(at - 1)
        last, end = self.find(max(stop - 1, start))
        end += int(self.sums[self.width + last, 0])
        delta = len(self.text) - n
        parts, reach, size, met = [], at, _PIECE, -1
        stops = {end + delta: last}
        while met < 0 and reach < len(self.text):
            # a piece ends anywhere, so its last pre-tokens may be cut and are split again with the next, longer one
            upto = min(len(self.text), reach + size)
            size *= 2
            for m in self.counter.split.finditer(self.text, reach, upto):
                if upto < len(self.text) and m.end() > upto - _AHEAD - 1:
                    break
                parts.append(m.group())
                reach = m.end()
                while end + delta < reach and last + 1 < self.width:
                    last += 1
                    end += int(self.sums[self.width + last, 0])
                    stops[end + delta] = last
                if reach in stops and reach >= start + len(new):
                    met = stops[reach]
                    break
        last = met if met >= 0 else self.width - 1
        self.again += reach - at
        self._replace(first, last, self._leaves(parts))

    def _replace(self, first: int, last: int, leaves: np.ndarray) -> None:
        room = last - first + 1
        base = self.width
        if len(leaves) > room:
            now = np.concatenate([self.sums[base : base + first], leaves, self.sums[base + last + 1 :]])
            self._grow(now[now[:, 0] > 0])
            return
        self.sums[base + first : base + last + 1] = 0
        self.sums[base + first : base + first + len(leaves)] = leaves
        lo, hi = (base + first) // 2, (base + last) // 2
        while lo:
            self.sums[lo : hi + 1] = self.sums[2 * lo : 2 * hi + 2 : 2] + self.sums[2 * lo + 1 : 2 * hi + 2 : 2]
            lo, hi = lo // 2, hi // 2


def _share(docs: DataFrame, vocabulary):
    path, pattern = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast((f.read(), pattern))  # one vocabulary file


def trees(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """``docs(doc_id, text)`` with ``n_tokens`` and the leaves of each tree (``leaf_chars``, ``leaf_tokens``), to keep beside the text."""
    shared = _share(docs, vocabulary)

    def run(batches):
        counter = Counter(*shared.value)
        for b in batches:
            made = [Tree(counter, (t or b"").decode("utf-8", "replace")) for t in texts(b.column(1))]
            sums = [m.leaves() for m in made]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([m.tokens for m in made], pa.int64()), pa.array([s[:, 0] for s in sums], pa.list_(pa.int32())), pa.array([s[:, 1] for s in sums], pa.list_(pa.int32()))], ["doc_id", "text", "n_tokens", "leaf_chars", "leaf_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, text string, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>")


def attach(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with the ``edits(doc_id, seq, start, stop, new)`` of each document as an array in order of seq."""
    some = edits.groupBy(F.col("doc_id").alias("__tt_id")).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "new"))).alias("edits"))
    return docs.drop("edits").join(some, F.col("doc_id").eqNullSafe(F.col("__tt_id")), "left").drop("__tt_id")


def recount(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_edited, n_chars_edited, n_chars_again) of ``docs(doc_id, text, edits)``.

    ``edits`` is an array of structs (start, stop, new, and others), each relative to the text that the ones before have left,
    in characters; null is no edit, null fields are 0, start, and the empty text. If ``docs`` has the columns of ``trees``, the
    leaves are taken from them and only what the edits touch is encoded; else each text is encoded once first. n_chars_again
    counts the characters that the edits made the tree split again. A null text has no tokens, and edits apply to an empty one.
    One row per row of ``docs``; an empty table gives no rows.
    """
    shared = _share(docs, vocabulary)
    kept = {"leaf_chars", "leaf_tokens"} <= set(docs.columns)
    e = F.col("edits")
    field = lambda n, t: F.transform(F.coalesce(e, F.array()), lambda x: x[n].cast(t)).alias(n)
    cols = ["doc_id", F.col("text").cast("string"), field("start", "long"), field("stop", "long"), field("new", "string")] + ["leaf_chars", "leaf_tokens"] * kept

    def run(batches):
        counter = Counter(*shared.value)
        for b in batches:
            starts, ends, news = (b.column(k).to_pylist() for k in (2, 3, 4))
            saved = [np.column_stack([b.column(5)[i].as_py(), b.column(6)[i].as_py()]).astype(np.int64).reshape(-1, 2) for i in range(b.num_rows)] if kept else [None] * b.num_rows
            out = []
            for i, t in enumerate(texts(b.column(1))):
                tree = Tree(counter, (t or b"").decode("utf-8", "replace"), saved[i])
                before = tree.tokens
                for s, p, new in zip(starts[i], ends[i], news[i]):
                    tree.edit(s or 0, p if p is not None else s or 0, new or "")
                out.append((before, tree.tokens, len(tree.text), tree.again))
            yield pa.record_batch([b.column(0), *[pa.array([o[k] for o in out], pa.int64()) for k in range(4)]], ["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_again"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select(*cols).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_tokens_edited long, n_chars_edited long, n_chars_again long")


def query(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and after three edits of each: an insertion in the middle, a deletion, a replacement."""
    docs = read(spark, sf_dir, "documents")
    n = F.length("text")
    edit = lambda start, size, new: F.struct(start.cast("long").alias("start"), (start + size).cast("long").alias("stop"), F.lit(new).alias("new"))
    edits = F.array(edit(n / 2, 0, " inserted words, 42 of them\n"), edit(n / 4, 24, ""), edit(n * 3 / 4, 12, "re-written naïve 日本"))
    return recount(docs.select("doc_id", "text", F.when(n.isNotNull(), edits).alias("edits")))
