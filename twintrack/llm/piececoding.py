"""SentencePiece encoding and decoding by a max-plus scan over chunks.

A text's encoding is the best path through the lattice of vocabulary pieces. A unigram model weighs a path by the sum of its
pieces' scores. A byte-pair model allows exactly the paths whose neighbouring pieces would be left apart if the two were merged on
their own (weight 0, others minus infinity); there is one such path, the one that merging by score gives, which a plain sum of
scores would miss. A chunk's transfer matrix has the best weight from each state at its start to each state at its end. A state is
how many characters the last piece reaches over the boundary, and for byte-pair models which piece that is. The matrices of a
document are multiplied in max-plus algebra, which is associative: neighbours in rounds, until one is left. Down the same tree the best
state between two neighbours follows from the states at their outer ends, and then each chunk is traced back on its own.

In the lattice a piece can't pass the start of a word (a space mark after another character) if no piece of the vocabulary has one
inside, so there all states meet in one, and words are solved once and remembered. Documents of at most CHUNK characters are a
single chunk. Characters without a piece become byte pieces, or the unknown piece in a vocabulary without them.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, settle, slices, small_batches

#: Characters of a chunk.
CHUNK = 32_768
_CACHE, _PAIRS = 300_000, 300_000
#: Most characters of a word that is merged side by side with others, fewest such words, and characters of texts whose words are looked at together.
_SIDE, _FEW, _TOGETHER = 63, 16, 1 << 20
MARK = "▁"
_NONE, _INF = float("-inf"), float("inf")
UNIGRAM, BPE = 1, 2


def default_model() -> str:
    """Path of the installed public model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _newer_half(cache: dict) -> dict:
    """What was remembered last."""
    return dict(itertools.islice(cache.items(), len(cache) // 2, None))


class Vocabulary:
    """Pieces of a model: ``ids`` and ``scores`` of ordinary ones, byte pieces, and the settings that encoding needs."""

    def __init__(self, pieces: list[tuple[str, float, str]], kind: int, dummy_prefix: bool = True, escape: bool = True):
        """pieces: (text, score, type) by id; type is normal, byte, unknown or other."""
        self.kind, self.dummy_prefix, self.escape = kind, dummy_prefix, escape
        self.text = [p[0] for p in pieces]
        self.ids = {p[0]: i for i, p in enumerate(pieces) if p[2] == "normal"}
        self.scores = [p[1] for p in pieces]
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == "byte"}
        self.types = [p[2] for p in pieces]
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == "unknown"), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        #: pieces by text, and -1 for what only begins pieces
        self.known = {p: self.ids.get(p, -1) for p in self.prefixes}
        self.words = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.lowest = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0

    @functools.cached_property
    def merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id by code point, and what two pieces merge into: sorted pairs, left << 32 | right, and rank of the score << 32 | piece of each.

        A character of no piece has an id beyond all pieces and merges with nothing; one that only longer pieces have has -1.
        """
        char = len(self.text) + np.arange(0x110000)
        char[[ord(c) for c in set().union(*self.ids)]] = -1
        rank = {x: k for k, x in enumerate(sorted({self.scores[i] for i in self.ids.values()}))}
        pairs = {}
        for text, i in self.ids.items():
            if len(text) == 1:
                char[ord(text)] = i
            for k in range(1, len(text)):
                a, b = self.ids.get(text[:k]), self.ids.get(text[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank[self.scores[i]] << 32 | i
        keys = np.array(sorted(pairs) or [-1], np.int64)
        return char, keys, np.array([pairs.get(k, -1) for k in keys.tolist()], np.int64)

    @classmethod
    def load(cls, model: bytes) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto.FromString(model)
        n = m.normalizer_spec
        if m.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are supported")
        if n.precompiled_charsmap or n.remove_extra_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        names = {1: "normal", 2: "unknown", 6: "byte"}
        return cls([(p.piece, p.score, names.get(p.type, "other")) for p in m.pieces], m.trainer_spec.model_type, n.add_dummy_prefix, n.escape_whitespaces)


class Coder:
    """Encoding and decoding with one vocabulary. A path's piece is its id, or the complement of a code point for a character without one."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.memo: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.spines: dict[int, tuple[list, list]] = {}
        self.pieces = np.array([self._spelled(i) for i in range(len(vocabulary.text))], object)
        self.special = np.array([t in ("byte", "unknown", "other") for t in vocabulary.types])
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    # -- text and ids

    def marked(self, text: str) -> str:
        """The text as the lattice sees it."""
        if not text:
            return ""
        return (MARK if self.v.dummy_prefix else "") + (text.replace(" ", MARK) if self.v.escape else text)

    def _spelled(self, i: int) -> str:
        v = self.v
        return {"normal": v.text[i], "unknown": " ⁇ ", "byte": v.text[i]}.get(v.types[i], "")

    def emit(self, path: list[int]) -> bytes:
        """Ids of a path as little-endian 32-bit integers."""
        out: list[int] = []
        for t in path:
            if t >= 0:
                out.append(t)
            elif self.v.bytes:
                out.extend(self.v.bytes[b] for b in chr(~t).encode("utf-8", "replace"))
            else:
                out.append(self.v.unknown)
        return np.array(out, "<i4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; byte pieces are read as UTF-8, what isn't UTF-8 becomes U+FFFD, ids outside the vocabulary are skipped."""
        v = self.v
        ids = ids[(ids >= 0) & (ids < len(v.text))]
        if not self.special[ids].any():
            text = "".join(self.pieces[ids].tolist())
        else:
            parts, held = [], bytearray()
            for i in ids.tolist():
                if v.types[i] == "byte":
                    held.append(int(v.text[i][3:5], 16))
                    continue
                if held:
                    parts.append(held.decode("utf-8", "replace"))
                    held.clear()
                parts.append(self.pieces[i])
            parts.append(held.decode("utf-8", "replace"))
            text = "".join(parts)
        if v.escape:
            text = text.replace(MARK, " ")
        return text[1:] if v.dummy_prefix and text[:1] == " " else text

    # -- lattice

    def apart(self, a: int, b: int) -> bool:
        """Byte-pair models: whether merging the two pieces' characters on their own leaves these two pieces."""
        if a < 0 or b < 0:
            return True
        key = a << 24 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs = _newer_half(self.pairs)
            got = self.pairs[key] = self._apart(a, b)
        return got

    def _edges_of(self, a: int) -> tuple[list, list]:
        """How merging builds a piece: what stands at its right and at its left end, as (text, when it is there, until when).

        Time falls from plus infinity; a merge happens at its score, or with its later part if that is lower.
        """
        got = self.spines.get(a)
        if got is None:
            text, ids, scores = self.v.text[a], self.v.ids, self.v.scores
            parts = [(c, _INF) for c in text]
            right, left = [[parts[-1][0], _INF, _NONE]], [[parts[0][0], _INF, _NONE]]
            while len(parts) > 1:
                at = max((k for k in range(len(parts) - 1) if parts[k][0] + parts[k + 1][0] in ids), key=lambda k: (scores[ids[parts[k][0] + parts[k + 1][0]]], -k), default=-1)
                if at < 0:
                    break
                new = parts[at][0] + parts[at + 1][0]
                when = min(scores[ids[new]], parts[at][1], parts[at + 1][1])
                if at == len(parts) - 2:
                    right[-1][2] = when
                    right.append([new, when, _NONE])
                if at == 0:
                    left[-1][2] = when
                    left.append([new, when, _NONE])
                parts[at : at + 2] = [(new, when)]
            got = self.spines[a] = (tuple(map(tuple, right)), tuple(map(tuple, left))) if len(parts) == 1 else ((), ())
        return got

    def _apart(self, a: int, b: int) -> bool:
        right, left = self._edges_of(a)[0], self._edges_of(b)[1]
        if not right or not left:
            return self._merged(self.v.text[a], self.v.text[b])
        known, scores, longest = self.v.known, self.v.scores, self.v.longest
        for r, since, until in right:
            for t, since2, until2 in left:
                i = known.get(r + t, -1) if len(r) + len(t) <= longest else -1
                if i < 0:
                    continue
                when, end = min(scores[i], since, since2), max(until, until2)
                if when > end:
                    return False  # a merge across the two comes first
                if when == end:
                    return self._merged(self.v.text[a], self.v.text[b])
        return True

    def _merged(self, a: str, b: str) -> bool:
        """The same by merging step by step."""
        ids, scores = self.v.ids, self.v.scores
        parts, cut = list(a + b), len(a)
        while len(parts) > 1:
            best, at = _NONE, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (at < 0 or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            end = 0
            for p in parts:
                end += len(p)
                if end >= cut:
                    break
            if end > cut:
                return False  # a merge across the two
        return len(parts) == 2

    def starts(self, text: str, q: int):
        """(length, piece) of the pieces that start at q."""
        ids, prefixes = self.v.ids, self.v.prefixes
        one = text[q]
        i = ids.get(one)
        yield 1, (~ord(one) if i is None else i)
        for n in range(2, min(self.v.longest, len(text) - q) + 1):
            sub = text[q : q + n]
            if sub not in prefixes:
                return
            i = ids.get(sub)
            if i is not None:
                yield n, i

    def walk(self, text: str, start: int, stop: int, last: int | None):
        """Best paths from ``start`` (after piece ``last``) over the pieces that start before ``stop``.

        Returns, by position, (weight, piece, its length) of the best path that ends there, the start without a piece.
        """
        best: dict[int, tuple[float, int | None, int]] = {start: (0.0, last, 0)}
        bpe, scores = self.v.kind == BPE, self.v.scores
        for q in range(start, stop):
            here = best.get(q)
            if here is None:
                continue
            w0, prev, _ = here
            for n, piece in self.starts(text, q):
                if bpe:
                    if (q + n) in best and best[q + n][0] >= w0:
                        continue
                    if prev is not None and not self.apart(prev, piece):
                        continue
                    best[q + n] = (w0, piece, n)
                else:
                    w = w0 + (scores[piece] if piece >= 0 else self.v.lowest)
                    old = best.get(q + n)
                    if old is None or w > old[0]:
                        best[q + n] = (w, piece, n)
        return best

    @staticmethod
    def trace(best: dict, end: int) -> list[int]:
        path = []
        while best[end][2]:
            path.append(best[end][1])
            end -= best[end][2]
        return path[::-1]

    def word(self, text: str) -> bytes:
        """Ids of a piece of text between two starts of words."""
        got = self.memo.get(text)
        if got is None:
            if len(self.memo) >= _CACHE:
                self.memo = _newer_half(self.memo)
            if self.v.kind == BPE:
                got = self._word_of_pairs(text)
            else:
                got = self.emit(self.trace(self.walk(text, 0, len(text), None), len(text)))
            if len(text) < 64:
                self.memo[text] = got
        return got

    def _word_of_pairs(self, text: str) -> bytes:
        """The one path of a whole word of a byte-pair model, searched from the left with the longest pieces first."""
        n, pairs, apart = len(text), self.pairs, self.apart
        path: list[int] = []
        open_ = [self._from(text, 0)]
        prev, at, dead = -1, [0], set()
        while True:
            here = open_[-1]
            if not here:
                # no piece leads on from here after this one
                open_.pop()
                dead.add((at.pop(), path.pop()))
                prev = path[-1] if path else -1
                continue
            end, i = here.pop(), here.pop()
            if dead and (end, i) in dead:
                continue
            if prev >= 0 and i >= 0:
                ok = pairs.get(prev << 24 | i)
                if ok is False or ok is None and not apart(prev, i):
                    continue
            path.append(i)
            if end == n:
                break
            open_.append(self._from(text, end))
            at.append(end)
            prev = i
        return struct.pack(f"<{len(path)}i", *path) if min(path) >= 0 else self.emit(path)

    def learn(self, words) -> None:
        """Remember the ids of many words of a byte-pair model. Short ones are merged side by side."""
        if len(self.memo) > _CACHE // 2:  # room for what the next words add
            self.memo = _newer_half(self.memo)
        new = [w for w in words if len(w) <= _SIDE and w not in self.memo]
        if len(new) < _FEW:
            return
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        starts = np.cumsum(sizes) - sizes
        ids = self.v.merges[0][np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)]
        plain = np.minimum.reduceat(ids, starts) >= 0
        for k, got in self._merged_all(ids, starts, sizes, plain):
            self.memo[new[k]] = got

    def _merged_all(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, plain: np.ndarray):
        """(number, ids) of the ``plain`` words. A merge makes a word one piece shorter, so all words of as many pieces take a step at once."""
        most = int(sizes.max())
        rows, parts, best = np.empty(0, np.int64), np.empty((0, most), np.int64), np.empty((0, most - 1), np.int64)
        for n in range(most, 0, -1):
            more = np.flatnonzero(plain & (sizes == n))
            now = ids[starts[more][:, None] + np.arange(n)]
            rows, parts = np.concatenate([rows, more]), np.concatenate([parts, now])
            best = np.concatenate([best, self._merge(now[:, :-1], now[:, 1:])])
            # the best score, the leftmost of equal ones
            at = (best >> 32).argmax(1) if n > 1 else np.zeros(rows.size, np.int64)
            new = best[np.arange(rows.size), at] if n > 1 else np.full(rows.size, -1)
            done = new < 0
            flat = parts[done].astype("<i4").tobytes()
            size = len(self.v.text)
            strange = (parts[done] >= size).any(1).tolist()
            for j, k in enumerate(rows[done].tolist()):
                got = flat[j * 4 * n : (j + 1) * 4 * n]
                yield k, self.emit([i if i < size else ~(i - size) for i in struct.unpack(f"<{n}i", got)]) if strange[j] else got
            rows, parts, best, at, new = rows[~done], parts[~done], best[~done], at[~done], new[~done]
            if n == 1:
                return
            every, cols = np.arange(rows.size), np.arange(n - 1)
            parts = parts[every[:, None], cols + (cols > at[:, None])]
            parts[every, at] = new & 0xFFFFFFFF
            cols = cols[:-1]
            best = best[every[:, None], cols + (cols >= at[:, None])]
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
            best[left, at[left] - 1] = self._merge(parts[left, at[left] - 1], parts[left, at[left]])
            best[right, at[right]] = self._merge(parts[right, at[right]], parts[right, at[right] + 1])

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and piece of what neighbours merge into, -1 for nothing."""
        _, keys, values = self.v.merges
        want = a << 32 | b
        k = np.minimum(np.searchsorted(keys, want), keys.size - 1)
        return np.where(keys[k] == want, values[k], -1)

    def _from(self, text: str, q: int) -> list[int]:
        """Piece and end, one after the other, of the pieces that start at q, the longest last."""
        known, out = self.v.known, []
        for end in range(q + 1, min(len(text), q + self.v.longest) + 1):
            i = known.get(text[q:end])
            if i is None:
                break
            if i >= 0:
                out += i, end
        if not out or out[1] > q + 1:
            out[:0] = ~ord(text[q]), q + 1
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as one chunk."""
        t = self.marked(text)
        if not self.v.words:
            return self.emit(self.trace(self.walk(t, 0, len(t), None), len(t))) if t else b""
        return self._joined(self.split.findall(t))

    def _joined(self, words: list[str]) -> bytes:
        get, word = self.memo.get, self.word  # if the memory is renewed meanwhile, word() looks in the new one
        return b"".join([get(w) or word(w) for w in words])

    def encode_all(self, texts: list[str | None]) -> list[bytes | None]:
        """``encode`` of many texts; their new words are solved together."""
        if not self.v.words or self.v.kind != BPE:
            return [None if t is None else self.encode(t) for t in texts]
        out: list[bytes | None] = []
        for s, e in slices([len(t or "") for t in texts], _TOGETHER):
            words = [None if t is None else self.split.findall(self.marked(t)) for t in texts[s:e]]
            self.learn(set(itertools.chain.from_iterable(w for w in words if w)))
            out += [None if w is None else self._joined(w) for w in words]
        return out

    # -- chunks

    def _edges(self, text: str, a: int, b: int) -> tuple[int, int]:
        """First and last start of a word in [a, b]; (-1, -1) if there is none."""
        if not self.v.words:
            return -1, -1
        first = next((p for p in range(max(a, 1), b + 1) if p < len(text) and text[p] == MARK and text[p - 1] != MARK), -1)
        if first < 0:
            return -1, -1
        last = next(p for p in range(b, first - 1, -1) if p < len(text) and text[p] == MARK and text[p - 1] != MARK)
        return first, last

    def states(self, text: str, a: int) -> list[tuple[int, int]]:
        """Every (overreach, piece) that a path can have at ``a``; unigram models don't need the piece (-1)."""
        if a == 0:
            return [(0, -1)]
        out = set()
        for q in range(max(0, a - self.v.longest), a):
            for n, piece in self.starts(text, q):
                if q + n >= a:
                    out.add((q + n - a, piece if self.v.kind == BPE else -1))
        return sorted(out)

    def _ends(self, best: dict, b: int, n: int) -> dict[tuple[int, int], float]:
        return {(p - b, x[1] if self.v.kind == BPE else -1): x[0] for p, x in best.items() if b <= p <= n and (x[2] or p == b)}

    def transfer(self, text: str, a: int, b: int) -> dict[tuple[int, int], dict[tuple[int, int], float]]:
        """Transfer matrix of the chunk [a, b) of ``text``, which goes on before and after it by the longest piece at least."""
        first, last = self._edges(text, a, b)
        out: dict = {}
        tail, mid = None, 0.0
        if first >= 0:
            tail = self._ends(self.walk(text, last, b, None), b, len(text)) if last < b else {(0, None): 0.0}
            if self.v.kind == UNIGRAM:
                mid = self.walk(text, first, last, None)[last][0] if last > first else 0.0
                tail = {(s, -1): w for (s, _), w in tail.items()}
        for s, piece in self.states(text, a):
            prev = piece if self.v.kind == BPE and a > 0 else None
            if first < 0:
                out[s, piece] = {(a + s - b, piece): 0.0} if a + s >= b else self._ends(self.walk(text, a + s, b, prev), b, len(text))
            elif a + s <= first:
                head = self.walk(text, a + s, first, prev).get(first)
                if head is not None:
                    out[s, piece] = {k: head[0] + mid + w for k, w in tail.items()}
        if first >= 0 and last == b and self.v.kind == BPE:
            # the pieces that end at the start of a word don't matter to what follows
            out = {i: {(0, -1): w for w in row.values()} for i, row in out.items()}
        return out

    def path(self, text: str, a: int, b: int, enter: tuple[int, int], leave: tuple[int, int]) -> bytes:
        """Ids of the pieces that start in [a, b) on the best path between two states."""
        begin, end = a + enter[0], b + leave[0]
        prev = enter[1] if self.v.kind == BPE and a > 0 and enter[1] != -1 else None
        first, last = self._edges(text, a, b)
        if first < 0 or begin > first:
            return self.emit(self.trace(self.walk(text, begin, b, prev), end)) if begin < b else b""
        head = self.emit(self.trace(self.walk(text, begin, first, prev), first))
        tail = self.emit(self.trace(self.walk(text, last, b, None), end)) if last < b else b""
        words = self.split.findall(text[first:last])
        if self.v.kind == BPE:
            self.learn(set(words))
        return head + self._joined(words) + tail


def product(a: dict, b: dict) -> dict:
    """Max-plus product of two transfer matrices. A state whose piece doesn't matter (-1) fits every piece at that place."""
    out: dict = {}
    for i, row in a.items():
        made: dict = {}
        for j, w in row.items():
            for k, x in _row(b, j).items():
                if w + x > made.get(k, _NONE):
                    made[k] = w + x
        if made:
            out[i] = made
    return out


def _row(matrix: dict, state: tuple[int, int]) -> dict:
    got = matrix.get(state)
    if got is not None or state[1] != -1:
        return got or {}
    # at the start of a word: all pieces that end there lead on alike
    return next((r for s, r in matrix.items() if s[0] == state[0]), {})


def ends(matrix: dict) -> tuple[tuple[int, int], tuple[int, int]]:
    """(enter, leave) of a whole text on the best path."""
    start = next(iter(matrix))
    return start, max((s for s in matrix[start] if s[0] == 0), key=matrix[start].get)


def midway(a: dict, b: dict, enter: tuple[int, int], leave: tuple[int, int]) -> tuple[int, int]:
    """The state between two neighbours on the best path from ``enter`` to ``leave``."""
    row = _row(a, enter)
    return max((m for m in row if leave in _row(b, m)), key=lambda m: row[m] + _row(b, m)[leave])


def boundaries(matrices: list[dict]) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """(enter, leave) of each chunk on the best path, up and down the tree of products."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        m = levels[-1]
        levels.append([product(m[k], m[k + 1]) if k + 1 < len(m) else m[k] for k in range(0, len(m), 2)])
    ways = [ends(levels[-1][0])]
    for below in levels[-2::-1]:
        down = []
        for k, (enter, leave) in enumerate(ways):
            if 2 * k + 1 < len(below):
                m = midway(below[2 * k], below[2 * k + 1], enter, leave)
                down += [(enter, m), (m, leave)]
            else:
                down.append((enter, leave))
        ways = down
    return ways


def coder_of(model: bytes) -> Coder:
    """The coder of a model in this worker process; what it has remembered serves the next tasks too."""
    return kept(hashlib.sha256(model).digest(), lambda: Coder(Vocabulary.load(model)))


def scan(coder: Coder, text: str, chunk: int) -> bytes:
    """Ids of a text by the chunked scan, in one process."""
    t = coder.marked(text)
    cuts = [(a, min(a + chunk, len(t))) for a in range(0, len(t), chunk)]
    if not cuts:
        return b""
    ways = boundaries([coder.transfer(t, a, b) for a, b in cuts])
    return b"".join(coder.path(t, a, b, *w) for (a, b), w in zip(cuts, ways))


# -- DataFrames


def _share(docs: DataFrame, model: str | None):
    small_batches(docs.sparkSession)
    with open(model or default_model(), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())  # one model file


def _lists(parts: list[bytes | None]) -> pa.Array:
    """array<int> column from ids as bytes."""
    sizes = np.array([len(p or b"") // 4 for p in parts], np.int64)
    flat = pa.array(np.frombuffer(b"".join(p or b"" for p in parts), "<i4"))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, flat, mask=pa.array([p is None for p in parts]))


_MATRIX = ["i0", "i1", "j0", "j1", "w"]
_MATRICES = "__tt_giant long, c int, i0 array<int>, i1 array<int>, j0 array<int>, j1 array<int>, w array<double>"
_WAYS = ["__tt_giant", "c", "e0", "e1", "l0", "l1"]


def _packed(key: int, c: int, m: dict) -> pa.RecordBatch:
    """A matrix as a row."""
    flat = [(*i, *j, w) for i, row in m.items() for j, w in row.items()]
    cols = list(zip(*flat)) if flat else [[]] * 5
    return pa.record_batch([pa.array([key], pa.int64()), pa.array([c], pa.int32()), *[pa.array([list(x)], pa.list_(pa.int32())) for x in cols[:4]], pa.array([list(cols[4])], pa.list_(pa.float64()))], ["__tt_giant", "c", *_MATRIX])


def _unpacked(row: dict, side: str = "") -> dict | None:
    """The matrix of a row; null is none."""
    if row[f"{side}w"] is None:
        return None
    m: dict = {}
    for i0, i1, j0, j1, w in zip(*(row[f"{side}{c}"] for c in _MATRIX)):
        m.setdefault((i0, i1), {})[j0, j1] = w
    return m


def _ways(level: DataFrame) -> DataFrame:
    """(__tt_giant, c, e0, e1, l0, l1): states at the ends of each chunk, from the matrices of the chunks, a table.

    Neighbours are joined and multiplied, round after round; then the ways go down the tables of neighbours. The rounds are the
    logarithm of the chunks of the longest document, and a task never has more than a few matrices at once.
    """

    def multiply(batches):
        for b in batches:
            for r in b.to_pylist():
                m, right = _unpacked(r, "a_"), _unpacked(r, "b_")
                yield _packed(r["__tt_giant"], r["c"], m if right is None else product(m, right))

    def rows(made):
        return pa.record_batch([pa.array(x, kind) for x, kind in zip(list(zip(*made)) or [[]] * 6, (pa.int64(), *[pa.int32()] * 5))], _WAYS)

    def root(batches):
        for b in batches:
            yield rows([(r["__tt_giant"], 0, *e, *x) for r in b.to_pylist() for e, x in [ends(_unpacked(r))]])

    def descend(batches):
        for b in batches:
            made = []
            for r in b.to_pylist():
                key, c, enter, leave, right = r["__tt_giant"], 2 * r["c"], (r["e0"], r["e1"]), (r["l0"], r["l1"]), _unpacked(r, "b_")
                if right is None:
                    made.append((key, c, *enter, *leave))
                else:
                    m = midway(_unpacked(r, "a_"), right, enter, leave)
                    made += [(key, c, *enter, *m), (key, c + 1, *m, *leave)]
            yield rows(made)

    half = lambda odd, side: level.where(F.col("c") % 2 == odd).select("__tt_giant", F.expr("cast(c div 2 as int)").alias("c"), *[F.col(x).alias(f"{side}{x}") for x in _MATRIX])
    neighbours = []
    while (level.agg(F.max("c")).first()[0] or 0) > 0:
        neighbours.append(settle(half(0, "a_").join(half(1, "b_"), ["__tt_giant", "c"], "left")))
        level = settle(neighbours[-1].mapInArrow(multiply, _MATRICES))
    schema = "__tt_giant long, c int, e0 int, e1 int, l0 int, l1 int"
    ways = level.mapInArrow(root, schema)
    for pair in neighbours[::-1]:
        ways = settle(pair.join(ways, ["__tt_giant", "c"]).mapInArrow(descend, schema))
    return ways


def encode(docs: DataFrame, model: str | None = None, chunk: int = CHUNK, decoded: str | None = None) -> DataFrame:
    """``docs``, all columns, with ``ids``, the piece ids of ``text``. A null text has null ids, an empty text none.

    A text of more than ``chunk`` characters is cut into chunks that are dealt out as rows of their own. A literal U+2581 in a
    text is the space mark to the model. A column of ``docs`` named ``ids`` is replaced. Rows keep their number. With ``decoded``
    a column of that name has the text that the ids decode to, without another pass over the short texts.
    """
    docs = docs.drop("ids", *([decoded] if decoded else []))
    shared = _share(docs, model)
    names = [f"`{c}`" for c in docs.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index("text")
    short = docs.where(F.col("text").isNull() | (F.length("text") <= chunk))

    def whole(batches):
        coder = coder_of(shared.value)
        for b in batches:
            ids = coder.encode_all(b.column(at).to_pylist())
            back = [pa.array([None if x is None else coder.decode(np.frombuffer(x, "<i4")) for x in ids], pa.string())] if decoded else []
            yield pa.record_batch([*b.columns, _lists(ids), *back], [*b.schema.names, "ids", *([decoded] if decoded else [])])

    done = short.mapInArrow(whole, f"{schema}, ids array<int>" + (f", `{decoded}` string" if decoded else ""))
    giants = settle(docs.where(F.length("text") > chunk).withColumn("__tt_giant", F.monotonically_increasing_id()))
    if giants.isEmpty():
        return done

    def cut(batches):
        coder = coder_of(shared.value)
        k = coder.v.longest
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = coder.marked(text)
                # with what pieces can reach on either side, and a character more to see where words start
                rows = [(key, c, t[max(0, a - k - 1) : a + chunk + k + 1], min(a, k + 1), min(chunk, len(t) - a)) for c, a in enumerate(range(0, len(t), chunk))]
                for s in range(0, len(rows), 64):
                    cols = zip(zip(*rows[s : s + 64]), (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()))
                    yield pa.record_batch([pa.array(x, kind) for x, kind in cols], ["__tt_giant", "c", "part", "a", "n"])

    chunks = settle(giants.select("__tt_giant", "text").mapInArrow(cut, "__tt_giant long, c int, part string, a int, n int").repartition("__tt_giant", "c"))

    def matrices(batches):
        coder = coder_of(shared.value)
        for b in batches:
            for key, c, part, a, n in zip(*(x.to_pylist() for x in b.columns)):
                yield _packed(key, c, coder.transfer(part, a, a + n))

    ways = _ways(settle(chunks.mapInArrow(matrices, _MATRICES)))

    def traced(batches):
        coder = coder_of(shared.value)
        for b in batches:
            col = {n: b.column(k).to_pylist() for k, n in enumerate(b.schema.names)}
            ids = [coder.path(p, a, a + n, (e0, e1), (l0, l1)) for p, a, n, e0, e1, l0, l1 in zip(*(col[x] for x in ("part", "a", "n", "e0", "e1", "l0", "l1")))]
            yield pa.record_batch([pa.array(col["__tt_giant"], pa.int64()), pa.array(col["c"], pa.int32()), _lists(ids)], ["__tt_giant", "c", "ids"])

    parts = settle(chunks.join(ways, ["__tt_giant", "c"]).mapInArrow(traced, "__tt_giant long, c int, ids array<int>"))
    joined = parts.groupBy("__tt_giant").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("c", "ids"))), lambda x: x["ids"])).alias("ids"))
    long = giants.join(joined, "__tt_giant").select(*names, "ids")
    return done.unionByName(decode(long, model, decoded) if decoded else long)


def decode(coded: DataFrame, model: str | None = None, to: str = "decoded") -> DataFrame:
    """``coded``, all columns, with the text of ``ids`` as column ``to``. Null ids give null."""
    coded = coded.drop(to)
    shared = _share(coded, model)
    at = coded.columns.index("ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)

    def run(batches):
        coder = coder_of(shared.value)
        for b in batches:
            ids = b.column(at)
            flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            null = ids.is_null().to_pylist()
            out = [None if null[i] else coder.decode(flat[offsets[i] : offsets[i + 1]]) for i in range(len(ids))]
            yield pa.record_batch([*b.columns, pa.array(out, pa.string())], [*b.schema.names, to])

    return coded.mapInArrow(run, f"{schema}, `{to}` string")


def query(spark, sf_dir: str) -> DataFrame:
    """Of every document the number of pieces, a digest of the ids, a digest of the decoded text, and whether that is the text."""
    from .common import read

    coded = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    digest = F.xxhash64("ids")
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), digest.alias("ids_xxhash64"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of a pipeline: the columns of ``docs`` but the text, with piece ids and the round trip checked."""
    coded = encode(docs, decoded="__tt_decoded")
    rest = [f"`{c}`" for c in docs.columns if c not in ("text", "ids", "n_pieces", "round_trip")]
    return coded.select(*rest, "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.col("__tt_decoded").eqNullSafe(F.col("text")).alias("round_trip"))
