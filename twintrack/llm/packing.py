"""Packing of token sequences: a mix of windows by non-negative least squares, the rest packed greedily.

Documents are cut into pieces of WINDOW tokens and a remainder. The histogram of piece lengths, at most WINDOW numbers, is all that the driver sees.
Combinations of at most DEPTH lengths that fill a window exactly are enumerated, and the times that each is to be used are the
non-negative least-squares solution against the histogram, rounded and held to the pieces that there are. Pieces are ranked among
those of their length, and a rank's place in the mix is looked up in a table bounded by the histogram. The pieces that the mix
leaves follow each other in one stream that is cut at window borders only, at places known from length and rank. The end of the
stream is cut into powers of two, so no sequence needs padding.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from itertools import compress
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, scratch, settle, slices, small_batches, texts

#: Tokens of a sequence, lengths in a combination, the id that ends a document.
WINDOW, DEPTH, END = 2048, 3, 1
#: Rounds in which combinations join the fit, and its steps in each.
ROUNDS, STEPS = 8, 150
#: Bytes encoded at once; longest unit that is remembered; units remembered.
_SPAN, _SHORT, _KEEP = 1 << 22, 48, 200_000
#: White space as the tokenizer's pattern has it (fixed values).
_W = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# the last byte but one of white space of more than one byte
_TAILS = np.isin(np.arange(256), [w.encode()[-2] for w in re.findall(f"[{_W}]", "".join(map(chr, range(128, 0x3001))))])
#: Where a long text may be cut.
_CUT = re.compile(rb"(?<=[!-~]) ")


def default_tokenizer() -> tuple[str, str | None, str | None]:
    """(definition, the same vocabulary as a ranks file, its pattern) of the installed public byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Encoder:
    """Little-endian 32-bit ids of texts, found once for each distinct unit of a batch and remembered in a table of two generations.

    A unit begins at a space that follows other characters than white space; no token and no rule of the pattern reaches over such a
    place. Given a ranks file of the same vocabulary, units are merged by that, many at once, which is faster and gives the same ids;
    units with an added token in them are left to the tokenizer's own rules.
    """

    def __init__(self, definition: str, ranks: bytes | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        added = [t["content"] for t in json.loads(definition).get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = None
        if ranks is not None:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
            self.fast = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.width = np.zeros(max(table.values()) + 1, np.int64)
            self.width[list(table.values())] = list(map(len, table))

    def _new(self, units: list[bytes]) -> list[bytes]:
        """Ids of units that aren't remembered."""
        out: list = [None] * len(units)
        plain = [u[0] == 32 < u[-1] and (u[-1] < 128 or len(u) > 1 and not _TAILS[u[-2]]) for u in units] if self.fast else [False] * len(units)
        text = b"".join(compress(units, plain)).decode("utf-8", "replace")
        if "\ufffd" in text or self.added and self.added.search(text):
            plain = [p and "\ufffd" not in (t := u.decode("utf-8", "replace")) and not (self.added and self.added.search(t)) for p, u in zip(plain, units)]
            text = b"".join(compress(units, plain)).decode("utf-8")
        if text:
            ids = np.array(self.fast.encode_ordinary(text), "<u4")
            sizes = np.fromiter(map(len, units), np.int64, len(units))[plain]
            stops = 4 * np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes)) + 4
            flat, at = ids.tobytes(), np.flatnonzero(plain).tolist()
            for i, a, b in zip(at, np.append(0, stops[:-1]).tolist(), stops.tolist()):
                out[i] = flat[a:b]
        for i in np.flatnonzero(~np.array(plain, bool)).tolist():
            ids = self.tokenizer.encode(units[i].decode("utf-8", "replace"), add_special_tokens=False).ids
            out[i] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _of(self, units: list[bytes]) -> list[bytes]:
        known, old = self.known, self.old
        got = list(map(known.get, units))
        missing = [i for i, g in enumerate(got) if g is None]
        if missing and old:
            for i in missing:
                g = got[i] = old.get(units[i])
                if g is not None:
                    known[units[i]] = g
            missing = [i for i in missing if got[i] is None]
        for i, ids in zip(missing, self._new([units[i] for i in missing])):
            got[i] = ids
            if len(units[i]) <= _SHORT:
                known[units[i]] = ids
        if len(known) > _KEEP:
            self.old, self.known = known, {}
        return got

    def _span(self, parts: list[bytes]) -> list[bytes]:
        """Ids of texts of a few megabytes."""
        starts = np.cumsum([0, *map(len, parts)])
        data = np.frombuffer(b"".join(parts), np.uint8)
        if not data.size:
            return [b""] * len(parts)
        space = np.flatnonzero(data[1:] == 32) + 1
        last, second = data[space - 1], data[np.maximum(space - 2, 0)]
        begins = np.zeros(data.size + 1, bool)
        begins[space] = (last > 32) & ((last < 128) | ~_TAILS[second])
        begins[starts] = True
        begins[-1] = False
        at = np.flatnonzero(begins)
        units = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, data.size).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        ids = self._of(units.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        which = units.indices.to_numpy()
        n = size[which]
        ends = np.cumsum(n)
        tokens = np.frombuffer(b"".join(ids), "<u4")[np.arange(ends[-1]) + np.repeat((np.cumsum(size) - size)[which] - (ends - n), n)]
        upto = np.append(0, ends)[np.searchsorted(at, starts)]
        return [tokens[a:b].tobytes() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]

    def ids(self, batch: list[bytes]) -> list[bytes]:
        """Ids of each text; a long one is encoded a span at a time."""
        out: list[bytes] = []
        for a, b in slices(list(map(len, batch)), _SPAN):
            if b - a > 1 or len(batch[a]) <= _SPAN:
                out += self._span(batch[a:b])
                continue
            text, parts, at = batch[a], [], 0
            while at < len(text):
                m = _CUT.search(text, at + _SPAN)
                stop = m.start() if m else len(text)
                parts += self._span([text[at:stop]])
                at = stop
            out.append(b"".join(parts))
        return out


def _spans(batches):
    """(ids, texts) of batches joined to a span."""
    held: list = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= _SPAN:
            yield tuple(pa.Table.from_batches(held).combine_chunks().column(k).combine_chunks() for k in (0, 1))
            held = []
    if held:
        yield tuple(pa.Table.from_batches(held).combine_chunks().column(k).combine_chunks() for k in (0, 1))


def pieces(docs: DataFrame, tokenizer: tuple[str, str | None, str | None] | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """(uid, doc_id, start, length, doc_tokens, crc, ids) of every piece of ``docs(doc_id, text)``; written in the shared folder.

    A document's tokens are those of its text and ``end``; it is cut after every ``window`` of them. ids holds little-endian unsigned
    32-bit numbers and crc their CRC-32. uid names a piece by its task and place. ``tokenizer``: see ``default_tokenizer``; without a
    ranks file the definition alone is used.
    """
    small_batches(docs.sparkSession)
    definition, ranks, pattern = tokenizer or default_tokenizer()
    given = (Path(definition).read_text(encoding="utf-8"), Path(ranks).read_bytes() if ranks else None, pattern)
    shared = docs.sparkSession.sparkContext.broadcast(given)  # one vocabulary
    names = ["uid", "doc_id", "start", "length", "doc_tokens", "crc", "ids"]

    def run(batches):
        encoder, last = Encoder(*shared.value), np.array([end], "<u4").tobytes()
        uid = TaskContext.get().partitionId() << 40
        for ids_of, table in _spans(batches):
            owner, start, whole, parts, held = [], [], [], [], 0

            def batch():
                nonlocal uid
                n = len(parts)
                cols = [pa.array(range(uid, uid + n), pa.int64()), ids_of.take(pa.array(owner, pa.int32())), pa.array(start, pa.int64()), pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array(whole, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())]
                uid += n
                for x in (owner, start, whole, parts):
                    x.clear()
                return pa.record_batch(cols, names)

            for i, ids in enumerate(encoder.ids([t or b"" for t in texts(table)])):
                ids += last
                for s in range(0, len(ids), 4 * window):
                    owner.append(i)
                    start.append(s // 4)
                    whole.append(len(ids) // 4)
                    parts.append(ids[s : s + 4 * window])
                held += len(ids)
                if held > 8_000_000:
                    held = 0
                    yield batch()
            if parts:
                yield batch()

    kind = dict(docs.dtypes)["doc_id"]
    made = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"uid long, doc_id {kind}, start long, length long, doc_tokens long, crc long, ids binary")
    path = scratch(docs.sparkSession)
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def combinations(there: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> np.ndarray:
    """Rows of ``depth`` lengths, 0 for none, in falling order, that sum to ``window``; ``there[l]`` tells the lengths to use."""
    found, open_ = [], np.zeros((1, 0), np.int64)
    lengths = np.flatnonzero(there)
    lengths = lengths[lengths > 0]
    for d in range(depth):
        left = window - open_.sum(1)
        most = open_[:, -1] if d else np.full(len(open_), window)
        done = (left <= most) & there[np.minimum(left, window)] & (left > 0)
        found.append(np.column_stack([open_[done], left[done], np.zeros((done.sum(), depth - d - 1), np.int64)]))
        if d + 1 < depth:
            # a further length leaves at least 1 for the last one, and no more than the rest can fill
            low = np.searchsorted(lengths, -(-left // (depth - d)))
            high = np.searchsorted(lengths, np.minimum(most, left - 1), side="right")
            n = np.maximum(high - low, 0)
            rows = np.repeat(np.arange(len(open_)), n)
            at = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(low, n)
            open_ = np.column_stack([open_[rows], lengths[at]])
    return np.concatenate(found) if found else np.zeros((0, depth), np.int64)


def repeats(columns: np.ndarray, hist: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``columns``, times): a sparse non-negative least-squares solution of the histogram, in tokens.

    Combinations join the fit for the length that they serve best by the gradient, in a few rounds; in between, accelerated
    projected-gradient steps settle the times of those that are in.
    """
    weight = np.arange(len(hist), dtype=float)
    target = hist * weight
    chosen = np.zeros(0, np.int64)
    x = np.zeros(0)
    rest = target.copy()
    for _ in range(rounds):
        rate = (rest * weight)[columns].sum(1)
        best = np.zeros(len(hist), np.int64)
        order = np.argsort(rate, kind="stable")
        for k in range(columns.shape[1]):
            best[columns[order, k]] = order  # the last written is the steepest
        new = np.setdiff1d(np.unique(best[np.unique(columns)]), chosen)
        new = new[rate[new] > 0]
        chosen, x = np.concatenate([chosen, new]), np.concatenate([x, np.zeros(new.size)])
        if not chosen.size:
            break
        c = columns[chosen]
        forth = lambda v: np.bincount(c.ravel(), np.repeat(v, c.shape[1]), len(hist)) * weight
        back = lambda r: (r * weight)[c].sum(1)
        v = np.ones(chosen.size)
        for _ in range(12):
            v = back(forth(v))
            size = np.linalg.norm(v)
            v /= size
        step, y, t = 1 / (1.1 * size), x, 1.0
        for _ in range(steps):
            up = np.maximum(0.0, y - step * back(forth(y) - target))
            t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
            y, x = up + (was - 1) / t * (up - x), up
        rest = target - forth(x)
    return chosen, x


class Mix:
    """Places by length and rank: ``slots`` for the pieces in combinations, and the stream of the others."""

    def __init__(self, hist: np.ndarray, window: int = WINDOW, depth: int = DEPTH):
        self.window, self.hist = window, hist.astype(np.int64)
        columns = combinations(self.hist > 0, window, depth)
        times = []
        if len(columns):
            chosen, x = repeats(columns, self.hist)
            order = np.argsort(-x, kind="stable")
            times = list(zip(columns[chosen[order]].tolist(), np.floor(x[order] + 0.5).astype(np.int64).tolist()))
        used = np.zeros(window + 1, np.int64)
        slots, self.windows = [], 0
        for combination, n in times:
            need = {v: combination.count(v) for v in combination if v}
            n = min([n, *(int(self.hist[v] - used[v]) // k for v, k in need.items())])
            if n <= 0:
                continue
            offset = 0
            for v in filter(None, combination):
                slots.append((v, used[v], self.windows, offset))
                used[v] += n
                offset += v
            self.windows += n
        got = np.array(sorted(slots), np.int64).reshape(-1, 4)
        self.key, self.first, self.base, self.offset = (got[:, 0] << 44) + got[:, 1], got[:, 1], got[:, 2], got[:, 3]
        self.used = used
        self.before = np.concatenate([[0], np.cumsum(self.hist)[:-1]])
        rest = (self.hist - used) * np.arange(window + 1)
        self.stream = np.concatenate([[0], np.cumsum(rest)[:-1]])
        total = int(rest.sum())
        self.full = total // window
        tail = [1 << k for k in range(window.bit_length() - 1, -1, -1) if (total % window) >> k & 1]
        #: where the sequences of the stream's end begin
        self.tail = self.full * window + np.concatenate([[0], np.cumsum(tail)[:-1]]).astype(np.int64) if tail else np.zeros(0, np.int64)

    def place(self, length: np.ndarray, rank: np.ndarray):
        """(row, cut, size, sequence, offset) of the parts of pieces: ``cut`` is where a part begins in its piece."""
        rows, cuts, sizes, seqs, offs = [], [], [], [], []
        inside = rank < self.used[length]
        i = np.flatnonzero(inside)
        if i.size:
            at = np.searchsorted(self.key, (length[i] << 44) + rank[i], side="right") - 1
            rows, cuts, sizes = [i], [np.zeros(i.size, np.int64)], [length[i]]
            seqs, offs = [self.base[at] + rank[i] - self.first[at]], [self.offset[at]]
        i = np.flatnonzero(~inside)
        if i.size:
            begin = self.stream[length[i]] + (rank[i] - self.used[length[i]]) * length[i]
            stop = begin + length[i]
            at = begin
            while i.size:
                tail = np.searchsorted(self.tail, at, side="right")
                ending = tail > 0
                border = np.where(ending, np.append(self.tail, np.iinfo(np.int64).max)[np.minimum(tail, self.tail.size)], (at // self.window + 1) * self.window)
                upto = np.minimum(stop, border)
                rows.append(i)
                cuts.append(at - begin)
                sizes.append(upto - at)
                seqs.append(self.windows + np.where(ending, self.full + tail - 1, at // self.window))
                offs.append(at - np.where(ending, np.append(self.tail, 0)[tail - 1], at // self.window * self.window))
                more = upto < stop
                i, begin, stop, at = i[more], begin[more], stop[more], upto[more]
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        return tuple(map(join, (rows, cuts, sizes, seqs, offs)))


def pack(cut: DataFrame, window: int = WINDOW, depth: int = DEPTH) -> DataFrame:
    """(uid, length, cut, size, sequence_id, offset): the parts of ``pieces`` and their places in sequences, each token in one part.

    Sequences are numbered from 0 and filled without gaps; all hold ``window`` tokens but some at the end, which hold smaller powers
    of two. ``window`` is a power of two. Only lengths and uids are moved; no pieces give no rows.
    """
    hist = np.zeros(window + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``window`` rows
        hist[r.length] = r.n
    mix = Mix(hist, window, depth)
    light = cut.select("uid", "length")
    # in order of lengths over all partitions: a rank is a place less the pieces that are shorter, however many share a length
    ranged = light.repartitionByRange("length", "uid").sortWithinPartitions("length", "uid")
    ranged = settle(ranged.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = {r.p: r.n for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a count for each partition
    starts = np.zeros(max(sizes, default=0) + 2, np.int64)
    for p, n in sizes.items():
        starts[p + 1] = n
    starts = np.cumsum(starts)
    shared = light.sparkSession.sparkContext.broadcast((mix, starts))  # bounded by the lengths, and a number for each partition

    def run(batches):
        mix, starts = shared.value
        for b in batches:
            uid, length, at = (b.column(k).to_numpy() for k in range(3))
            rank = starts[at >> 33] + (at & ((1 << 33) - 1)) - mix.before[length]
            row, begin, size, seq, off = mix.place(length, rank)
            yield pa.record_batch([pa.array(x) for x in (uid[row], length[row], begin, size, seq, off)], ["uid", "length", "cut", "size", "sequence_id", "offset"])

    return ranged.mapInArrow(run, "uid long, length long, cut long, size long, sequence_id long, offset long")


def sequences(cut: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` with the tokens: (sequence_id, offset, doc_id, start, length, doc_tokens, ids), ids as in ``pieces``."""
    both = cut.join(parts.select("uid", "cut", "size", "sequence_id", "offset"), "uid")
    ids = F.expr("substring(ids, cast(cut * 4 + 1 as int), cast(size * 4 as int))")
    return both.select("sequence_id", "offset", "doc_id", (F.col("start") + F.col("cut")).alias("start"), F.col("size").alias("length"), "doc_tokens", ids.alias("ids"))


def packed(docs: DataFrame, tokenizer: tuple[str, str | None, str | None] | None = None, window: int = WINDOW, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(pieces, parts) of ``docs(doc_id, text)``: see ``pieces``, ``pack`` and ``sequences``, which joins them.

    A null text is empty; an empty one is its end token alone. Null and repeated ids are carried, each row is a document of its own.
    Other columns are not read. An empty table gives no rows. Long texts are encoded a megabyte at a time.
    """
    cut = pieces(docs, tokenizer, window)
    return cut, settle(pack(cut, window, depth))


def query(spark, sf_dir: str) -> DataFrame:
    """Every part of every document; the tokens themselves only as their CRC-32. Whole pieces have it already, so only cut ones move."""
    cut, parts = packed(read(spark, sf_dir, "documents"))
    whole = parts.where("size = length").join(cut.drop("ids"), ["uid", "length"])
    whole = whole.select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    some = sequences(cut, parts.where("size < length"))
    return whole.unionByName(some.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"))
