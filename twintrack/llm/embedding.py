"""Embedding near-duplicates: exact cosine-threshold links by a dual traversal of cover trees.

Unit vectors at cosine c are sqrt(2 - 2c) apart, so a pair of nodes whose centres are farther apart than their covering radii
and that distance together holds no link and is dropped. The upper levels of the tree are Spark tables: a cell with more than
CELL vectors is dealt to the nearest of a few pivots, level after level; pairs of cells are expanded from the label down, and
dropped by the same bound. Each pair of lowest cells is a Spark group that builds nested covers with halving radii over its
vectors and traverses them together. A cell that pivots can't divide (very close vectors) is cut into blocks that meet pairwise.
Equal vectors of a label are one point with a count; of the links only each point's number and a spanning forest leave a group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fold, read, settle

THRESHOLD = 0.98
#: Most vectors of a cell, most pivots of a level, and levels of cells.
CELL, FAN, LEVELS = 4096, 16, 8
#: Most members of a leaf that still has a radius to halve.
LEAF = 48
_EPS = 1e-9


class Cover:
    """Nested covers of unit vectors. ``order`` lists the points so that each node is a range of it."""

    def __init__(self, u: np.ndarray, stop: float):
        self.u, self.stop = u, stop
        self.order = np.zeros(len(u), np.int64)
        self.filled = 0
        #: per node: centre point, covering radius, range in order, range of children (ids), by list position
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[np.ndarray] = []
        self._node(np.arange(len(u)), 0, 1.0)
        self.centre_a, self.radius_a = np.array(self.centre), np.array(self.radius)

    def _node(self, members: np.ndarray, centre: int, r: float) -> int:
        me = len(self.centre)
        self.centre.append(int(centre))
        far = np.sqrt(np.maximum(0.0, 2 - 2 * (self.u[members] @ self.u[centre])).max()) if members.size > 1 else 0.0
        self.radius.append(float(far) + (_EPS if members.size > 1 else 0.0))
        self.span.append((self.filled, self.filled + members.size))
        self.children.append(np.zeros(0, np.int64))
        if members.size <= LEAF or r < self.stop or far <= self.stop:
            self.order[self.filled : self.filled + members.size] = members
            self.filled += members.size
            return me
        kids = [self._node(m, c, r / 2) for c, m in self._cover(members, r)]
        self.children[me] = np.array(kids)
        return me

    def _cover(self, members: np.ndarray, r: float):
        """(centre, members within r of it): centres are farther than r from each other, members go to the first that covers them."""
        left = members
        while left.size:
            some = left[:128]
            d2 = 2 - 2 * (self.u[some] @ self.u[left].T)
            near = d2 <= r * r
            near[np.arange(some.size), np.arange(some.size)] = True
            taken = np.full(left.size, -1)
            for k in range(some.size):
                if taken[k] < 0:
                    taken[(taken < 0) & near[k]] = k
            for k in np.unique(taken[taken >= 0]):
                yield int(some[k]), left[taken == k]
            left = left[taken < 0]


def close(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Cosine of two vectors, summed exactly, against the threshold."""
    dot = math.fsum((a * b).tolist())
    return dot >= threshold * math.sqrt(math.fsum((a * a).tolist())) * math.sqrt(math.fsum((b * b).tolist()))


def links(x: np.ndarray, y: np.ndarray | None, threshold: float):
    """Yield index arrays (i, j) of all pairs with cosine at least ``threshold``: x against y, or (y None) pairs i < j of x."""
    same = y is None
    y = x if same else y
    if not len(x) or not len(y):
        return
    ux = x / np.linalg.norm(x, axis=1, keepdims=True)
    uy = ux if same else y / np.linalg.norm(y, axis=1, keepdims=True)
    t = math.sqrt(max(0.0, 2 - 2 * threshold))
    a = Cover(ux, t / 4)
    b = a if same else Cover(uy, t / 4)
    stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        na, nb = stack.pop()
        for i, j in zip(na.tolist(), nb.tolist()):
            own = same and i == j
            ka, kb = a.children[i], b.children[j]
            if not ka.size and not kb.size:
                p, q = a.order[slice(*a.span[i])], b.order[slice(*b.span[j])]
                dot = ux[p] @ uy[q].T
                hit = dot >= threshold - _EPS
                if own:
                    hit &= p[:, None] < q[None, :]
                r, c = np.nonzero(hit)
                if r.size:
                    yield from _settled(x, y, p[r], q[c], dot[r, c], threshold)
                continue
            if ka.size and (own or not kb.size or a.radius[i] >= b.radius[j]):
                left, right = ka, (kb if own else np.array([j]))
            else:
                left, right = np.array([i]), kb
            cb, rb = uy[b.centre_a[right]], b.radius_a[right]
            for s in range(0, left.size, 2048):
                part = left[s : s + 2048]
                d = np.sqrt(np.maximum(0.0, 2 - 2 * (ux[a.centre_a[part]] @ cb.T)))
                keep = d <= a.radius_a[part][:, None] + rb[None, :] + (t + 1e-7)
                if own:
                    keep &= part[:, None] <= right[None, :]
                r, c = np.nonzero(keep)
                if r.size:
                    stack.append((part[r], right[c]))


def _settled(x, y, i, j, dot, threshold):
    """Pairs as they are, but those within rounding of the threshold by an exact sum; the order of a self-pair is kept."""
    edge = np.abs(dot - threshold) <= _EPS
    if edge.any():
        ok = ~edge
        for k in np.flatnonzero(edge).tolist():
            ok[k] = close(x[i[k]], y[j[k]], threshold)
        i, j = i[ok], j[ok]
    if i.size:
        yield i, j


def _matrix(column) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)


def usable():
    """Vectors that can link: label and vector not null, all components finite, not all zero."""
    e = F.col("embedding")
    fine = F.forall(e, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce(F.col("label").isNotNull() & e.isNotNull() & fine & F.exists(e, lambda v: v != 0), F.lit(False))


def _assign(rows: DataFrame) -> DataFrame:
    """Add ``k``: position of the nearest of the row's ``pivots`` (the first of ties), and ``d`` its distance."""

    def run(batches):
        for b in batches:
            v, piv = b.column(b.schema.get_field_index("embedding")), b.column(b.schema.get_field_index("pivots"))
            names = b.column(b.schema.get_field_index("cell")).to_numpy()
            k, d = np.zeros(len(v), np.int64), np.zeros(len(v))
            for cell in np.unique(names).tolist():  # one length of vectors in a cell
                at = np.flatnonzero(names == cell)
                m = np.array([q["v"] for q in piv[int(at[0])].as_py()], float)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                u = _matrix(v.take(pa.array(at)))
                far = np.sqrt(np.maximum(0.0, 2 - 2 * ((u / np.linalg.norm(u, axis=1, keepdims=True)) @ m.T)))
                k[at] = far.argmin(1)
                d[at] = far[np.arange(at.size), k[at]]
            keep = [n for n in b.schema.names if n != "pivots"]
            yield pa.record_batch([*[b.column(b.schema.get_field_index(n)) for n in keep], pa.array(k), pa.array(d)], [*keep, "k", "d"])

    kept = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "pivots")
    return rows.mapInArrow(run, f"{kept}, k long, d double")


def cells(points: DataFrame, threshold: float = THRESHOLD, cell: int = CELL):
    """Deal ``points(uid, cell, embedding, ...)`` into cells of about ``cell`` vectors at most by nested levels of pivots.

    Returns the points with their lowest ``cell``, and the pairs (a, b), a <= b, of lowest cells that may hold a link.
    """
    nodes = settle(points.groupBy("cell").agg(F.count("*").alias("n")).withColumn("level", F.lit(0)))
    pairs = nodes.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    bound = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    for level in range(LEVELS):
        big = nodes.where((F.col("n") > cell) & (F.col("level") == level))
        if big.isEmpty():
            break
        fan = F.least(F.lit(FAN), F.ceil(F.col("n") * 2 / cell))
        at = points.join(big.select("cell", "n"), "cell")
        chosen = at.where(F.pmod(F.xxhash64("uid", F.lit(level)), F.col("n")) < fan)
        chosen = chosen.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("uid", F.col("embedding").alias("v")))).alias("pivots"))
        chosen = settle(chosen.where("size(pivots) > 1"))  # about FAN vectors for each cell
        dealt = _assign(points.join(chosen, "cell")).withColumn("to", F.xxhash64("cell", "k", F.lit(level)))
        dealt = settle(dealt)
        kids = dealt.groupBy("cell", "k", "to").agg(F.count("*").alias("n"), F.max("d").alias("radius"))
        kids = settle(kids.join(chosen, "cell").select("cell", "to", "n", "radius", F.get("pivots", F.col("k").cast("int"))["v"].alias("centre")))
        rest = points.join(chosen.select("cell"), "cell", "left_anti")
        points = settle(rest.unionByName(dealt.withColumn("cell", F.col("to")).select(*rest.columns)))
        nodes = settle(nodes.join(chosen.select("cell"), "cell", "left_anti").select("cell", "n", F.lit(level + 1).alias("level")).unionByName(kids.select(F.col("to").alias("cell"), "n", F.lit(level + 1).alias("level"))))
        # each pair to the pairs of its cells' children; a cell without children stands for itself, without a bound
        child = lambda side, to: kids.select(F.col("cell").alias(side), F.col("to").alias(to), F.col("centre").alias(f"{to}_c"), F.col("radius").alias(f"{to}_r"))
        wide = pairs.join(child("a", "x"), "a", "left").join(child("b", "y"), "b", "left")
        unit = lambda v: F.transform(v, lambda e: e.cast("double") / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, w: s + w.cast("double") * w.cast("double"))))
        dot = F.aggregate(F.zip_with(unit(F.col("x_c")), unit(F.col("y_c")), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        near = F.coalesce(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)) <= F.col("x_r") + F.col("y_r") + bound, F.lit(True))
        wide = wide.where(near).select(F.coalesce("x", "a").alias("p"), F.coalesce("y", "b").alias("q"))
        pairs = settle(wide.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    return points, pairs, nodes


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors(vec_id, embedding, label)``; other columns are not read.

    Vectors link if their labels are equal and their cosine, in double precision, is at least ``threshold``. A null label, a
    null or zero vector, or a null or non-finite component: no link. Vectors of different lengths don't link. Equal rows are
    vectors of their own. A null vec_id is carried, counts as a link of others and names no component. Empty table: no rows.
    """
    v = vectors.select("vec_id", "embedding", "label")
    fine = v.where(usable())
    points = fine.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"))
    points = settle(points.withColumn("uid", F.monotonically_increasing_id()))
    base = points.withColumn("cell", F.xxhash64("label", F.size("embedding")))
    placed, pairs, nodes = cells(base.select("uid", "cell", "embedding", "mult"), threshold, cell)
    ways = nodes.select("cell", F.ceil(F.col("n") / (2 * cell)).cast("int").alias("w"))
    placed = placed.join(ways, "cell").withColumn("s", F.expr("cast(pmod(xxhash64(uid), w) as int)"))
    both = pairs.join(ways.withColumnsRenamed({"cell": "a", "w": "wa"}), "a").join(ways.withColumnsRenamed({"cell": "b", "w": "wb"}), "b")
    both = both.withColumn("i", F.explode(F.expr("sequence(0, wa - 1)"))).withColumn("j", F.explode(F.expr("sequence(0, wb - 1)"))).where("a <> b or i <= j")
    both = settle(both.withColumn("pair", F.monotonically_increasing_id()).select("pair", "a", "b", "i", "j"))
    first = both.select("pair", F.lit(False).alias("side"), F.col("a").alias("cell"), F.col("i").alias("s"), F.expr("a = b and i = j").alias("own"))
    other = both.where("a <> b or i <> j").select("pair", F.lit(True).alias("side"), F.col("b").alias("cell"), F.col("j").alias("s"), F.lit(False).alias("own"))
    rows = placed.join(first.unionByName(other), ["cell", "s"]).select("pair", "side", "own", "uid", "mult", "embedding")

    def walk(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy(zero_copy_only=False).astype(bool)
        own = bool(np.asarray(table.column("own").to_numpy(zero_copy_only=False)).any())
        x = _matrix(table.column("embedding"))
        uid, mult = table.column("uid").to_numpy(), table.column("mult").to_numpy()
        pa_, pb_ = np.flatnonzero(~side), np.flatnonzero(side)
        count, parent = np.zeros(len(x), np.int64), np.arange(len(x))
        keep, held = [], 0
        for i, j in links(x[pa_], None if own else x[pb_], threshold):
            i, j = pa_[i], (pa_ if own else pb_)[j]
            np.add.at(count, i, mult[j])
            np.add.at(count, j, mult[i])
            keep.append((i, j))
            held += i.size
            if held > 2_000_000:
                fold(parent, *(np.concatenate(k) for k in zip(*keep)))
                keep, held = [], 0
        if keep:
            fold(parent, *(np.concatenate(k) for k in zip(*keep)))
        moved, some = np.flatnonzero(parent != np.arange(len(x))), np.flatnonzero(count)
        a = np.concatenate([uid[moved], uid[some]])
        b = pa.array(np.concatenate([uid[parent[moved]], np.zeros(some.size, np.int64)]), mask=np.arange(a.size) >= moved.size)
        return pa.table({"a": pa.array(a), "b": b, "n": pa.array(np.concatenate([np.zeros(moved.size, np.int64), count[some]]))})

    found = settle(rows.groupBy("pair").applyInArrow(walk, "a long, b long, n long"))
    direct = found.groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "uid")
    root = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "uid")
    named = points.join(direct, "uid", "left").join(root, "uid", "left")
    named = settle(named.select("label", "embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("root", "uid").alias("root")))
    best = named.groupBy("root").agg(F.min("least").alias("best"))
    named = named.join(best, "root").select("label", "embedding", "links", "best")
    linked = fine.join(named, ["label", "embedding"]).select("vec_id", F.col("links").alias("n_links"), F.col("best").alias("component_id"))
    alone = v.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


#: Components by repeated hooking to the smallest neighbour; the longest shortest path is within the recursion's reach.
ORACLE = r"""
with recursive v as (
  select vec_id, label, cast(embedding as double[]) e from embeddings
  where label is not null and embedding is not null and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)
    and list_aggregate(list_transform(embedding, lambda x: abs(cast(x as double))), 'sum') > 0),
links as materialized (
  select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.98),
reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
n as (select a, count(*) n from links group by 1),
c as (select a, min(b) c from reach group by 1)
select vec_id, cast(coalesce(n.n, 0) as bigint) n_links, least(vec_id, coalesce(c.c, vec_id)) component_id, vec_id = least(vec_id, coalesce(c.c, vec_id)) kept
from embeddings left join n on vec_id = n.a left join c on vec_id = c.a
"""
