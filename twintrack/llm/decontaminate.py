"""Benchmark decontamination by winnowing.

The word sequence of every text is fingerprinted: of the k-gram hashes in each window of words the smallest is kept. A window that
a document shares with a benchmark item has the same fingerprint in both, so with k-grams and windows of k + w - 1 words every shared
window is found. Benchmark items shorter than a window are one window each, with k-grams of their own length.

Documents are read once. Their windows whose fingerprint may be one of the benchmark's, by a bitmap of bounded size that all
executors get, become rows; these are joined with the benchmark's windows by fingerprint and extended to the whole window, compared
word by word. Hits go back to documents by 128 bits of hash of the text, as equal texts have equal hits. Neither the benchmark nor the
documents are held by the driver or by one executor.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, kept, pieces, read, settle, slices, small_batches, texts

#: Window length in words, and the k of the k-gram hashes.
SPAN, K = 10, 5
#: Most bits of the bitmap of fingerprints, as a power of 2. A larger benchmark lets more rows through to the join.
BITS = 26
#: Most bytes of a table that is sent to all executors.
BROADCAST_BYTES = 64 << 20
_ROWS = 20_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return _WORD.findall(text.lower()) if text else []


def gram_hashes(words, n: int, k: int) -> np.ndarray:
    """63-bit hashes of the k words from each position of a sequence of n words."""
    x = np.fromiter(map(zlib.crc32, words), np.uint64, n)
    m = n - k + 1
    h = np.zeros(max(0, m), np.uint64)
    for i in range(k if m > 0 else 0):
        h = (h ^ x[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h >> np.uint64(1)


def smallest(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest hash (rightmost of ties) of each window of w hashes."""
    n = h.size - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = h[:n].copy(), np.arange(n)
    for i in range(1, w):
        nxt = h[i : i + n]
        lower = nxt <= best
        best = np.where(lower, nxt, best)
        at = np.where(lower, np.arange(i, i + n), at)
    return at


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions kept: the smallest hash of each window of w hashes; fewer hashes are one window."""
    return np.unique(smallest(h, min(w, h.size))) if h.size else np.zeros(0, np.int64)


def rule(length: int, span: int, k: int) -> tuple[int, int]:
    """(k, w) for windows of that length, k + w - 1 = length."""
    return (min(k, span), span - min(k, span) + 1) if length == span else (length, 1)


def fingerprints(words, n: int, length: int, span: int, k: int) -> np.ndarray:
    """Fingerprint of the window of ``length`` words from each position of a sequence of n words."""
    k, w = rule(length, span, k)
    h = gram_hashes(words, n, k)
    return h[smallest(h, w)]


def _place(fp: np.ndarray, length: int, bits: int) -> np.ndarray:
    """Bit of the bitmap of fingerprints of windows of that length."""
    return ((fp ^ np.uint64(length)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)


def benchmark_windows(benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """(length, fp, win, item), distinct: every window of ``benchmark(item_id, text)`` as its words, and the id as text."""

    def run(batches):
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                words = words_of(text)
                length = min(span, len(words))
                fp = fingerprints(words, len(words), length, span, k) if words else []
                for s in range(0, len(fp), _ROWS):
                    part = [b" ".join(words[i : i + length]) for i in range(s, min(len(fp), s + _ROWS))]
                    yield pa.record_batch([pa.array([length] * len(part), pa.int32()), pa.array(fp[s : s + _ROWS].astype(np.int64)), pa.array(part).cast(pa.string()), pa.array([item] * len(part), pa.string())], ["length", "fp", "win", "item"])

    small_batches(benchmark.sparkSession)
    some = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null").distinct()
    return some.mapInArrow(run, "length int, fp long, win string, item string").distinct()


def bitmap(windows: DataFrame, most: int = BITS) -> tuple[np.ndarray, list[int]]:
    """(bitmap of the fingerprints of ``benchmark_windows``, lengths of windows); about 1,000 bits for each, 2^most at most."""
    known = windows.select("length", "fp").distinct()
    n = known.count()
    bits = int(np.clip(np.ceil(np.log2(max(1, n) * 1000)), 6, max(6, most)))

    def run(batches):
        for b in batches:
            length, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            at = np.concatenate([_place(fp[length == x], x, bits) for x in np.unique(length).tolist()] or [np.zeros(0, np.uint64)])
            yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["k", "v"])

    words = known.mapInArrow(run, "k long, v long").groupBy("k").agg(F.bit_or("v").alias("v")).collect()  # 2^(most - 6) rows at most
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in words:
        out[r.k] = r.v
    return out.view(np.uint64), sorted(r.length for r in windows.select("length").distinct().collect())  # span values at most


class Finder:
    """Windows of texts whose fingerprints may be the benchmark's."""

    def __init__(self, filled: np.ndarray, lengths: list[int], span: int, k: int):
        self.filled, self.lengths, self.span, self.k = filled, lengths, span, k
        self.bits = int(filled.size).bit_length() + 5

    def maybe(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, fp) of such windows in a sequence of words."""
        out = []
        for length in self.lengths:
            if length > len(words):
                continue
            fp = fingerprints(words, len(words), length, self.span, self.k)
            at = _place(fp, length, self.bits)
            s = np.flatnonzero((self.filled[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
            out.append((s, np.full(s.size, length), fp[s]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def texts(self, rows: list[bytes | None]):
        """(words of each text, (row, start, length, fp, words) of its windows) of texts of about PIECE bytes together."""
        found = [words_of(t) for t in rows]
        n = np.array([len(f) for f in found], np.int64)
        flat = list(chain.from_iterable(found))
        end = np.cumsum(n)
        start, length, fp = self.maybe(flat)
        row = np.searchsorted(end, start, "right")
        own = start + length <= end[row] if start.size else np.zeros(0, bool)  # not from one text into the next
        hits = [(r, s - end[r] + n[r], z, f, b" ".join(flat[s : s + z])) for r, s, z, f in zip(row[own].tolist(), start[own].tolist(), length[own].tolist(), fp[own].tolist())]
        return n.tolist(), hits

    def long(self, text: bytes):
        """The same for one text of any length, a piece at a time: (words so far, windows)."""
        carry, total = [], 0
        for piece in pieces(text):
            words = carry + words_of(piece)
            base = total - len(carry)
            total = base + len(words)
            start, length, fp = self.maybe(words)
            for s in range(0, max(1, start.size), _ROWS):
                part = zip(start[s : s + _ROWS].tolist(), length[s : s + _ROWS].tolist(), fp[s : s + _ROWS].tolist())
                yield total, [(0, base + a, z, f, b" ".join(words[a : a + z])) for a, z, f in part]
            carry = words[max(0, len(words) - self.span + 1) :] if self.span > 1 else []


def _candidates(docs: DataFrame, finder: Finder) -> DataFrame:
    """A row (doc_id, t1, t2, n_words) for each row of ``docs``, and rows (t1, t2, start, length, fp, win) of its windows that may be the benchmark's."""
    shared = docs.sparkSession.sparkContext.broadcast(finder)  # a bitmap of 2^BITS bits at most
    names = ["doc_id", "t1", "t2", "n_words", "start", "length", "fp", "win"]

    def run(batches):
        kept("decontaminate", int)
        find = shared.value
        for b in batches:
            doc, t1, t2, text = b.column(0), b.column(1), b.column(2), texts(b.column(3))

            def rows(at, n_words, hits=()):
                """One batch; without hits the rows of the documents."""
                at = pa.array(at, pa.int64())
                ids = pa.nulls(len(at), doc.type) if n_words is None else doc.take(at)
                n = pa.nulls(len(at), pa.int64()) if n_words is None else pa.array(n_words, pa.int64())
                more = list(zip(*hits)) or [[None] * len(at)] * 4
                kinds = (pa.int64(), pa.int32(), pa.int64())
                return pa.record_batch([ids, t1.take(at), t2.take(at), n, *[pa.array(x, kind) for x, kind in zip(more, kinds)], pa.array(more[3], pa.binary()).cast(pa.string())], names)

            for s, e in slices([len(x or b"") for x in text], PIECE):
                if e - s == 1 and len(text[s] or b"") > PIECE:
                    n = 0
                    for n, hits in find.long(text[s]):
                        if hits:
                            yield rows([s] * len(hits), None, [h[1:] for h in hits])
                    yield rows([s], [n])
                    continue
                n, hits = find.texts(text[s:e])
                yield rows(range(s, e), n)
                for k in range(0, len(hits), _ROWS):
                    yield rows([s + h[0] for h in hits[k : k + _ROWS]], None, [h[1:] for h in hits[k : k + _ROWS]])

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    text = F.col("text").cast("string")
    some = docs.select("doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), text.alias("text"))
    return some.mapInArrow(run, f"doc_id {kind}, t1 long, t2 long, n_words long, start long, length int, fp long, win string")


def _sent(df: DataFrame, *sizes) -> DataFrame:
    """``df``, a table read back, with a broadcast hint if its counted bytes are within the bound; ``sizes``: bytes of a row's texts."""
    got = df.agg(F.count("*").alias("n"), *[F.sum(x) for x in sizes]).first()
    return F.broadcast(df) if got.n * 16 * len(df.columns) + sum(x or 0 for x in got[1:]) <= BROADCAST_BYTES else df


def hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, bits: int = BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: (doc_id, t1, t2, n_words) of each row of ``docs(doc_id, text)``; (t1, t2, start, length, win), the hit windows of each text;
    (win, item), the ids of the items with a window.

    ``benchmark(item_id, text)``: an item with words but fewer than ``span`` is one window. Items without words or text hit
    nothing; an item with a null id hits words but is not listed; rows with one id are one item. Null and wordless documents
    have no words. An empty benchmark hits nothing. t1 and t2 are hashes of the text.
    """
    known = settle(benchmark_windows(benchmark, span, k))
    found = settle(_candidates(docs, Finder(*bitmap(known, bits), span, k)))
    windows = known.select("length", "fp", "win").distinct()
    windows = _sent(settle(windows), F.octet_length("win"))
    real = settle(found.where("start is not null").drop("doc_id", "n_words").join(windows, ["fp", "length", "win"], "left_semi").select("t1", "t2", "start", "length", "win").distinct())
    return found.where("start is null").select("doc_id", "t1", "t2", "n_words"), real, known.where("item is not null").select("win", "item").distinct()


def _covered(spans):
    """Words that an array of (start, end) covers."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, p: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), p["e"] - F.greatest(p["s"], acc["end"]))).alias("n"), F.greatest(acc["end"], p["e"]).alias("end"))
    return F.aggregate(F.sort_array(spans), zero, step)["n"]


def report(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, bits: int = BITS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of ``docs``; see ``hits``.

    Repeated rows stay; columns other than doc_id and text are not read; an empty table gives no rows.
    """
    rows, real, owners = hits(docs.select("doc_id", "text"), benchmark, span, k, bits)
    spans = real.groupBy("t1", "t2").agg(_covered(F.collect_set(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("length")).alias("e")))).alias("n_hit"))
    items = real.select("t1", "t2", "win").join(owners, "win").select("t1", "t2", "item").distinct()
    items = items.groupBy("t1", "t2").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    got = rows.join(_sent(settle(spans.join(items, ["t1", "t2"], "left")), F.lit(64)), ["t1", "t2"], "left")
    none = F.lit(0).cast("long")
    return got.select("doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"))


def query(spark, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """The rows of ``docs``, all columns, without a window of a benchmark item; see ``hits``."""
    _, real, _ = hits(docs.select("doc_id", "text"), benchmark, span, k)
    bad = settle(real.select(F.col("t1").alias("__tt_1"), F.col("t2").alias("__tt_2")).distinct())
    text = F.col("text").cast("string")
    same = (F.xxhash64(text) == F.col("__tt_1")) & (F.xxhash64(F.lit(7), text) == F.col("__tt_2"))
    return docs.join(_sent(bad), same, "left_anti")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item, with the columns of ``docs``."""
    return clean(docs, read(spark, sf_dir, "benchmark"))


ORACLE = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents),
bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark),
bench as (
  select distinct item_id, least(10, len(w)) n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') win
  from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) i from bw where len(w) > 0)),
lens as (select distinct n from bench),
docwin as (
  select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') win
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i from dw join lens on len(w) >= n)),
hits as (select doc_id, i, docwin.n, item_id from docwin join bench using (n, win)),
covered as (
  select doc_id, count(distinct p) n_hit
  from (select doc_id, unnest(generate_series(i, i + n - 1)) p from (select distinct doc_id, i, n from hits)) group by 1),
items as (
  select doc_id, count(*) n_items, string_agg(item, ',' order by item) ids
  from (select distinct doc_id, cast(item_id as varchar) item from hits) group by 1)
select dw.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join covered using (doc_id) left join items using (doc_id)
"""
