"""SimHash near-duplicate detection: 3-word shingle fingerprints and a self-join of the binary trie of fingerprints.

The trie is traversed in pairs of nodes from the root. A pair carries the number of bits in which its two paths differ so far,
and it is dropped once that exceeds the budget. The upper levels are dealt out as Spark groups: a node at depth d meets only
the nodes whose path differs in at most ``budget`` bits. Below that depth each group walks its two subtries as ranges of sorted
arrays. Only a spanning forest of the links leaves a group, so large groups of copies give as many rows as they have members.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations, islice, tee

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, connected_components, fold, kept, pieces, settle, small_batches, texts

#: Most fingerprints of one block of a trie node; a fuller node is split into blocks that meet pairwise.
BLOCK = 65_536
#: Most rows (two numbers) of the table of nodes that is sent to all executors.
BROADCAST_ROWS = 2_000_000
#: Node pairs expanded at once, and the product of sizes at which a node pair is compared directly.
FRONTIER, LEAF = 200_000, 48
SHINGLE = 3
_STEP = 65_536


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash of one text: A-Z lower-cased, words split on space and 0x09-0x0D, 3-word shingles with repeats."""
    if text and len(text) > PIECE:
        # words as they come; a list of all would be far larger than the text
        a, b, c = tee((w for part in pieces(text) for w in part.lower().split()), 3)
        grams = map(b" ".join, zip(a, islice(b, 1, None), islice(c, 2, None)))
    else:
        words = text.lower().split() if text else []
        grams = map(b" ".join, zip(words, words[1:], words[2:]))
    hashes = map(partial(xxhash.xxh64_intdigest, seed=42), grams)
    ones, n = np.zeros(64, np.int64), 0
    while True:
        h = np.fromiter(islice(hashes, _STEP), np.uint64)
        if not h.size:
            break
        n += h.size
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    if not n and text and (words := text.lower().split()):  # a word or two
        return xxhash.xxh64_intdigest(b" ".join(words), seed=42)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null or empty text: zero. One row per input row."""

    def run(batches):
        kept("simhash", int)
        for b in batches:
            fp = np.array([fingerprint(t) for t in texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def trie_links(a: np.ndarray, b: np.ndarray | None, budget: int):
    """Yield index arrays (i, j) of all pairs within ``budget`` bits: a against b, or (b None) pairs i < j of a. Inputs sorted, unsigned.

    Depth-first over blocks of node pairs; a node is a range of the array, a child the half whose next bit is 0 or 1.
    """
    same, b = b is None, a if b is None else b
    if not a.size or not b.size:
        return
    one = np.array([0], np.int64)
    stack = [(one, one + a.size, one, one + b.size, one, 63)]
    while stack:
        la, ha, lb, hb, err, bit = stack.pop()
        if la.size > FRONTIER:
            half = la.size // 2
            stack += [tuple(x[s] for x in (la, ha, lb, hb, err)) + (bit,) for s in (slice(0, half), slice(half, None))]
            continue
        sizes = (ha - la) * (hb - lb)
        leaf = sizes <= LEAF if bit >= 0 else np.ones(la.size, bool)
        if leaf.any():
            n = sizes[leaf]
            for s, e in _runs(n):
                k = np.repeat(np.arange(s, e), n[s:e])
                off = np.arange(k.size) - np.repeat(np.cumsum(n[s:e]) - n[s:e], n[s:e])
                width = (hb - lb)[leaf][k]
                i, j = la[leaf][k] + off // width, lb[leaf][k] + off % width
                near = np.bitwise_count(a[i] ^ b[j]) <= budget
                if same:
                    near &= i < j
                if near.any():
                    yield i[near], j[near]
        rest = ~leaf
        if not rest.any():
            continue
        la, ha, lb, hb, err = (x[rest] for x in (la, ha, lb, hb, err))
        ma, mb = _split(a, la, ha, bit), _split(b, lb, hb, bit)
        twin = (la == lb) & (ha == hb) if same else np.zeros(la.size, bool)
        parts = []
        for x, y in ((0, 0), (0, 1), (1, 0), (1, 1)):
            al, ah = (la, ma) if x == 0 else (ma, ha)
            bl, bh = (lb, mb) if y == 0 else (mb, hb)
            e = err + (x ^ y)
            keep = (al < ah) & (bl < bh) & (e <= budget)
            if x > y:
                keep &= ~twin
            parts.append((al[keep], ah[keep], bl[keep], bh[keep], e[keep]))
        nxt = tuple(np.concatenate(p) for p in zip(*parts))
        if nxt[0].size:
            stack.append((*nxt, bit - 1))


def _runs(n: np.ndarray, most: int = 2_000_000):
    """Ranges of rows whose sizes add up to about ``most``."""
    ends = np.cumsum(n)
    s = 0
    while s < n.size:
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most, "right")))
        yield s, e
        s = e


def _split(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Per node the position of its first value whose ``bit`` is set."""
    top = ((v[lo] >> np.uint64(bit)) | np.uint64(1)) << np.uint64(bit)
    return np.clip(np.searchsorted(v, top), lo, hi)


def link_forest(fps: DataFrame, budget: int, block: int = BLOCK) -> DataFrame:
    """(a, b): a spanning forest of the links among the distinct longs ``fps(fp)`` at ``budget`` or fewer differing bits."""
    spark = fps.sparkSession
    depth = int(np.clip(np.ceil(np.log2(max(fps.count(), 1) / block)) + 3, 3, 60))
    path = F.shiftrightunsigned("fp", 64 - depth)
    nodes = settle(fps.groupBy(path.alias("p")).agg(F.ceil(F.count("*") / block).cast("int").alias("w")))
    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes
    masks = [sum(1 << k for k in c) for w in range(budget + 1) for c in combinations(range(depth), w)]
    rows = fps.withColumn("p", path).join(nodes, "p").withColumn("s", F.expr("pmod(xxhash64(fp), w)").cast("int"))
    rows = rows.withColumn("q", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("p").bitwiseXOR(m))))
    # the nodes that there are
    rows = rows.join(nodes.select(F.col("p").alias("q"), F.col("w").alias("v")), "q")
    # own (node, block) and the other's; the pair's smaller one comes first
    rows = rows.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("v") - 1)))
    mine, other = F.struct("p", "s"), F.struct(F.col("q").alias("p"), F.col("r").alias("s"))
    rows = rows.select("fp", F.least(mine, other).alias("k1"), F.greatest(mine, other).alias("k2"), (mine > other).alias("side"))

    def walk(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        side = table.column("side").to_numpy(zero_copy_only=False).astype(bool)
        a, b = np.sort(fp[~side]), np.sort(fp[side])
        twin = table.column("k1")[0].as_py() == table.column("k2")[0].as_py()
        every = a if twin else np.concatenate([a, b])
        parent, keep, held = np.arange(every.size), [], 0
        for i, j in trie_links(a, None if twin else b, budget):
            keep.append((i, j if twin else j + a.size))
            held += i.size
            if held > 4_000_000:
                fold(parent, *(np.concatenate(x) for x in zip(*keep)))
                keep, held = [], 0
        if keep:
            fold(parent, *(np.concatenate(x) for x in zip(*keep)))
        moved = np.flatnonzero(parent != np.arange(every.size))
        out = every.view(np.int64)
        return pa.table({"a": pa.array(out[moved]), "b": pa.array(out[parent[moved]])})

    return rows.groupBy("k1", "k2").applyInArrow(walk, "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = 2, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs(doc_id, text)``; other columns are not read.

    Fingerprints link at ``budget`` or fewer differing bits; component_id is the smallest doc_id reachable. Null or wordless
    text has fingerprint zero and links like any other. A null doc_id is carried and never the smallest. Equal rows stay
    separate. An empty table gives no rows.
    """
    fp = settle(fingerprints(docs))
    groups = settle(fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = connected_components(link_forest(groups.select("fp"), budget, block))
    named = groups.join(root, groups.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = settle(named)
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(best, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fp.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return near_duplicates(read(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each near-duplicate group (all of its rows if the id repeats)."""
    small = near_duplicates(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("__tt_id")).distinct()
    return docs.join(small, F.col("doc_id").eqNullSafe(F.col("__tt_id")), "left_semi")
