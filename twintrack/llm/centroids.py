"""Centroid clustering: Lloyd rounds over whole numbers, each vector searched by exponion bounds.

A vector carries its centroid, an upper bound of the distance to it and a lower bound of the distance to any other. When centroids
move, the bounds move by as much. While the upper bound lies below the lower one, or below half the way to the nearest other
centroid, nothing can be nearer or as near, and the vector is left. Otherwise only the centroids inside a ball around its own are
scanned, a prefix of that centroid's sorted list of neighbours; the radius, twice the upper bound and the way to the nearest
neighbour, is inclusive, so that ties stay in. Distances are whole numbers, so results don't depend on the order of sums.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, settle

#: Parts of one unit of a component, components, centroids, rounds, and the prefix of an id whose hash orders the first centroids.
GRID, SIZE, CENTROIDS, ROUNDS, SALT = 64, 64, 16, 3, "1:"
#: Largest component, in parts: up to here squared distances fit a long; up to EXACT they are exact as doubles too.
LARGEST, EXACT = 1 << 27, 1 << 22
#: Relative room for the rounding of bounds.
_ROOM = 1e-9


class Ball:
    """Centroids with their neighbours in order of distance."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids.astype(np.int64)
        between = np.sqrt(squared(self.c, self.c).astype(float))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.far = np.take_along_axis(between, self.order, 1)
        # a centroid's own place is first among those at distance 0
        self.next = np.sort(between + np.diag(np.full(len(between), np.inf)), axis=1)[:, 0] if len(between) > 1 else np.full(len(between), np.inf)

    def all(self, x: np.ndarray):
        """(nearest centroid, squared distance, distance of the second nearest), every centroid scanned."""
        return _best(squared(x, self.c), np.arange(len(self.c)))

    def search(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """(cluster, upper, lower, vectors scanned, centroids scanned) of vectors whose bounds hold for these centroids."""
        cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
        bound = np.maximum(lower, self.next[cluster] / 2) * (1 - _ROOM)
        left = np.flatnonzero(~(upper < bound))
        if left.size:  # the bound itself may be loose
            at = x[left] - self.c[cluster[left]]
            upper[left] = np.sqrt((at * at).sum(1).astype(float)) * (1 + _ROOM)
            left = left[~(upper[left] < bound[left])]
        work = 0
        for k in np.unique(cluster[left]).tolist():
            mine = left[cluster[left] == k]
            reach = np.searchsorted(self.far[k], (2 * upper[mine] + (self.next[k] if np.isfinite(self.next[k]) else 0.0)) * (1 + _ROOM) + _ROOM, side="right")
            # lists are scanned as far as the next power of two, so that few lengths occur
            reach = np.minimum(1 << np.ceil(np.log2(np.maximum(reach, 1))).astype(np.int64), len(self.c))
            for n in np.unique(reach).tolist():
                some = mine[reach == n]
                names = np.sort(self.order[k, :n])
                best, d2, second = _best(squared(x[some], self.c[names]), names)
                cluster[some], upper[some], lower[some] = best, np.sqrt(d2.astype(float)), second
                work += some.size * n
        return cluster, upper, lower, left.size, work


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of whole numbers, exact."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for k in range(len(c)):
        at = x - c[k]
        out[:, k] = (at * at).sum(1)
    return out


def _best(d2: np.ndarray, names: np.ndarray):
    """Nearest of ``names`` (ascending, so the first of ties is the smallest), its squared distance, and the second's distance."""
    at = d2.argmin(1)
    rows = np.arange(len(d2))
    least = d2[rows, at]
    if d2.shape[1] == 1:
        return names[at], least, np.full(len(d2), np.inf)
    rest = d2.copy()
    rest[rows, at] = np.iinfo(np.int64).max
    return names[at], least, np.sqrt(rest.min(1).astype(float)) * (1 - _ROOM)


def points(vectors: DataFrame) -> DataFrame:
    """(vec_id, q) of the vectors with exactly SIZE components, none null or non-finite; q holds the components in parts, rounded down."""
    e = F.col("embedding")
    fine = (F.size(e) == SIZE) & F.forall(e, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    q = F.transform(e, lambda v: F.floor(F.lit(float(GRID)) * v.cast("double")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", q.alias("q"))


def _matrix(column) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(c), -1)


def assign(rows: DataFrame, centroids: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """``rows(vec_id, q, cluster, upper, lower)`` with cluster and bounds for ``centroids``; ``moved``: how far each has moved since, None at first."""
    ball = Ball(centroids)

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1))
            if moved is None:
                cluster, d2, lower = ball.all(x)
                upper = np.sqrt(d2.astype(float))
            else:
                cluster = b.column(2).to_numpy().astype(np.int64)
                others = np.array([np.delete(moved, k).max(initial=0.0) for k in range(len(moved))])
                upper = (b.column(3).to_numpy() + moved[cluster]) * (1 + _ROOM)
                lower = b.column(4).to_numpy() - others[cluster] * (1 + _ROOM)
                cluster, upper, lower, *_ = ball.search(x, cluster, upper, lower)
            at = x - ball.c[cluster]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array((at * at).sum(1))], ["vec_id", "q", "cluster", "upper", "lower", "distance"])

    kind = dict(rows.dtypes)["vec_id"]
    return rows.select("vec_id", "q", "cluster", "upper", "lower").mapInArrow(run, f"vec_id {kind}, q array<bigint>, cluster int, upper double, lower double, distance bigint")


def first_centroids(rows: DataFrame, count: int, salt: str = SALT) -> np.ndarray:
    """The vectors of the ``count`` smallest hex SHA-256 of salt and id, in that order; null ids come last, equal ids go by their vectors."""
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    got = rows.select("q", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "q").limit(count).collect()  # count rows
    return np.array([r.q for r in got], np.int64).reshape(len(got), SIZE)


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, q, cluster, distance), final centroids) after ``rounds`` rounds and a last assignment of ``vectors(vec_id, embedding)``.

    Ties go to the smaller centroid; an empty centroid stays where it is. Fewer vectors than centroids give as many centroids.
    Repeated rows are vectors of their own; null ids are carried; vectors of another size, null ones and those with a null or
    non-finite component are left out; other columns are not read. No vectors give no rows. A component beyond LARGEST parts is a
    ValueError, as distances would not fit a long. Each round writes the vectors with their bounds in the shared folder; the driver
    sees sums and counts of each centroid only.
    """
    rows = settle(points(vectors).select("vec_id", "q", F.lit(0).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("distance")))
    if not rows.where(F.exists("q", lambda v: (v > LARGEST) | (v < -LARGEST))).isEmpty():
        raise ValueError(f"components beyond {LARGEST // GRID} can't be clustered exactly")
    c = first_centroids(rows, count, salt)
    if not len(c):
        return rows.select("vec_id", "q", "cluster", "distance"), c
    moved = None
    for _ in range(rounds):
        rows = settle(assign(rows, c, moved))
        sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("q", i)).alias(f"s{i}") for i in range(c.shape[1])]).collect()  # a row for each centroid
        before, c = c, c.copy()
        for r in sums:
            c[r.cluster] = [r[f"s{i}"] // r.n for i in range(c.shape[1])]
        moved = np.sqrt(((c - before) ** 2).sum(1).astype(float)) * (1 + _ROOM)
    return settle(assign(rows, c, moved)).select("vec_id", "q", "cluster", "distance"), c


def query(spark, sf_dir: str) -> DataFrame:
    rows, c = cluster(read(spark, sf_dir, "embeddings"))
    names = spark.createDataFrame([(k, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for k, v in enumerate(c.tolist())], "cluster int, centroid_sha256 string")
    per = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # a row for each centroid
    total = per.agg(F.sum("cluster_inertia").alias("inertia"))
    known = per.join(F.broadcast(names), "cluster").crossJoin(F.broadcast(total))  # one row
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_ROUND = """
a{n} as materialized (
  select rid, k from (select rid, k, row_number() over (partition by rid order by list_inner_product(q, q) - 2 * list_inner_product(q, c) + list_inner_product(c, c), k) r from v, c{n}) where r = 1),
m{n} as (
  select k, i, floor(sum(q[i]) / count(*)) m from (select k, q, unnest(range(1, 65)) i from v join a{n} using (rid)) group by k, i),
c{next} as materialized (
  select k, coalesce(m, c) c from c{n} left join (select k, list(m order by i) m from m{n} group by k) using (k)),"""

#: The rounds written out; components are whole numbers below 2^22, so doubles are exact.
ORACLE = (
    r"""
with v as materialized (
  select row_number() over () rid, vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) q from embeddings
  where embedding is not null and len(embedding) = 64 and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)),
c0 as materialized (
  select k - 1 k, q c from (select q, row_number() over (order by sha256('1:' || cast(vec_id as varchar)), q) k from v) where k <= 16),"""
    + "".join(_ROUND.format(n=n, next=n + 1) for n in range(ROUNDS))
    + """
last as materialized (
  select vec_id, k, c, d from (select vec_id, k, c, d, row_number() over (partition by rid order by d, k) r from (
    select rid, vec_id, k, c, list_inner_product(q, q) - 2 * list_inner_product(q, c) + list_inner_product(c, c) d from v, c3)) where r = 1)
select vec_id, cast(k as integer) "cluster", cast(d as bigint) distance, cast(sum(d) over (partition by k) as bigint) cluster_inertia,
  cast(sum(d) over () as bigint) inertia, sha256(array_to_string(list_transform(c, lambda x: cast(cast(x as bigint) as varchar)), ',')) centroid_sha256
from last"""
)
