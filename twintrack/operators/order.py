"""Order statistics, ranks and products of many columns at once, exact and in bounded memory.

Equal values are counted first, with map-side combine, so that a value that fills a column is one row. The distinct values of all
columns are then range partitioned together and sorted; each carries how many values of its column lie before it in its partition, and
one number for each partition and column is all that the driver sees. A position, or a rank, is that number and the row's own.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Columns whose products are taken in one pass, and partial sums that are added in one task.
MOST, FAN = 400, 64


class Sorted:
    """The distinct values of ``cells(pos, value)`` in order: ``rows(part, pos, value, before, n)``, ``offsets[(part, pos)]``, ``counts[pos]``. Nulls are left out."""

    def __init__(self, cells: DataFrame):
        some = cells.where("value is not null").select("pos", (F.col("value") + 0.0).alias("value")).groupBy("pos", "value").agg(F.count("*").alias("n"))

        def run(batches):
            part, last, held = TaskContext.get().partitionId(), None, 0
            for b in batches:
                pos, n = b.column(0).to_numpy(), b.column(2).to_numpy()
                if not len(pos):
                    continue
                total = np.cumsum(n) - n
                first = np.flatnonzero(np.append(True, pos[1:] != pos[:-1]))
                start = np.repeat(total[first], np.diff(np.append(first, len(pos))))
                before = total - start + np.where(pos == last, held, 0) if last is not None else total - start
                last, held = pos[-1], int(before[-1] + n[-1])
                yield pa.record_batch([pa.array(np.full(len(pos), part, np.int32)), b.column(0), b.column(1), pa.array(before), b.column(2)], ["part", "pos", "value", "before", "n"])

        ordered = some.repartitionByRange("pos", "value").sortWithinPartitions("pos", "value")
        self.rows = written(ordered.mapInArrow(run, "part int, pos int, value double, before long, n long"), "part")
        self.offsets: dict[tuple[int, int], int] = {}
        self.counts: dict[int, int] = defaultdict(int)
        # a partition holds whole columns but for two, so this is a row for each partition and column
        for r in self.rows.groupBy("pos", "part").agg(F.sum("n").alias("n")).orderBy("pos", "part").collect():
            self.offsets[r.part, r.pos] = self.counts[r.pos]
            self.counts[r.pos] += r.n

    def at(self, wanted: dict[int, list[int]]) -> dict[tuple[int, int], float]:
        """Values by (pos, place), places from 0; only partitions that hold one are read."""
        parts = defaultdict(list)
        for (part, pos), offset in self.offsets.items():
            parts[pos].append((offset, part))
        seek = {(parts[pos][i][1], pos, k - parts[pos][i][0]): k for pos, ks in wanted.items() for k in ks if parts[pos] and 0 <= k < self.counts[pos] for i in [np.searchsorted([o for o, _ in parts[pos]], k, side="right") - 1]}
        if not seek:
            return {}
        spark = self.rows.sparkSession
        look = spark.createDataFrame([tuple(map(int, s)) for s in seek], "part int, pos int, k long")
        rows = self.rows.where(F.col("part").isin(sorted({int(s[0]) for s in seek})))
        hit = rows.join(F.broadcast(look), ["part", "pos"]).where((F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("n")))
        return {(r.pos, seek[r.part, r.pos, r.k]): r.value for r in hit.select("part", "pos", "k", "value").collect()}  # as many rows as were asked for

    def quantiles(self, probabilities: list[float]) -> dict[tuple[int, float], float]:
        """Mid-point quantiles by (pos, probability): place n*p + 1/2 held in 1..n, linear between neighbours."""
        places = {(pos, p): min(max(n * p + 0.5, 1.0), float(n)) for pos, n in self.counts.items() for p in probabilities}
        wanted = defaultdict(list)
        for (pos, _), h in places.items():
            wanted[pos] += [int(np.floor(h)) - 1, int(np.ceil(h)) - 1]
        got = self.at({pos: sorted(set(ks)) for pos, ks in wanted.items()})
        out = {}
        for (pos, p), h in places.items():
            low, high = got[pos, int(np.floor(h)) - 1], got[pos, int(np.ceil(h)) - 1]
            out[pos, p] = low + (h - np.floor(h)) * (high - low)
        return out

    def ranks(self, cells: DataFrame) -> DataFrame:
        """``cells(id, pos, value)`` as (id, pos, rank): mean-tie ranks less their mean, (n + 1) / 2."""
        if not self.offsets:
            return cells.sparkSession.createDataFrame([], "id long, pos int, rank double")
        known = [(part, pos, float(offset) - self.counts[pos] / 2) for (part, pos), offset in self.offsets.items()]
        known = cells.sparkSession.createDataFrame(known, "part int, pos int, _offset double")
        spots = self.rows.join(F.broadcast(known), ["part", "pos"]).select("pos", "value", (F.col("_offset") + F.col("before") + F.col("n") / 2).alias("rank"))
        return cells.where("value is not null").select("id", "pos", (F.col("value") + 0.0).alias("value")).join(spots, ["pos", "value"]).select("id", "pos", "rank")


def cells(table: DataFrame, columns: list, *keys: str) -> DataFrame:
    """(keys, pos, value), a row for each value of ``columns``, which are numbered from 0."""
    made = [F.struct(F.lit(i).alias("pos"), c.cast("double").alias("value")) for i, c in enumerate(columns)]
    return table.select(*keys, F.explode(F.array(*made)).alias("c")).select(*keys, "c.pos", "c.value").where("value is not null")


def _added(rows: DataFrame) -> DataFrame:
    """Sum of the arrays of ``rows(i, part, row)`` by i: within FAN groups of partitions first, then over these."""

    def run(table: pa.Table) -> pa.Table:
        x = table.column("row").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        return pa.table({"i": table.column("i").slice(0, 1), "part": table.column("part").slice(0, 1), "row": pa.array([x.sum(0)], pa.list_(pa.float64()))})

    kind = "i int, part int, row array<double>"
    some = rows.withColumn("part", F.col("part") % FAN).groupBy("i", "part").applyInArrow(run, kind)
    return some.withColumn("part", F.lit(0)).groupBy("i", "part").applyInArrow(run, kind)


def products(matrix: DataFrame, width: int, dense) -> np.ndarray:
    """X^T X of the rows of ``matrix``: ``dense`` makes a numpy matrix of ``width`` columns from a batch. Partial products of each task, summed by a tree; width^2 numbers reach the driver."""

    def run(batches):
        total, part = np.zeros((width, width)), TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows:
                x = dense(b)
                total += x.T @ x
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array([part] * width, pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "part", "row"])

    out = np.zeros((width, width))
    for r in _added(matrix.mapInArrow(run, "i int, part int, row array<double>")).select("i", "row").collect():
        out[r.i] = r.row
    return out


def plain(b: pa.RecordBatch) -> np.ndarray:
    """The columns of a batch as a matrix, null as NaN."""
    return np.column_stack([c.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in b.columns])


def shared(table: DataFrame, names: list[str]) -> np.ndarray:
    """How many rows have both of two columns, for all pairs of ``names``."""
    there = table.select(*[F.col(n).isNotNull().cast("double").alias(n) for n in names])
    return products(there, len(names), plain).astype(np.int64)


def spearman(table: DataFrame, names: list[str], pairs: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, float | None]]:
    """{pair: (rows with both, correlation of mean-tie ranks on these, None if one is constant)} of pairs of columns by place.

    Ranks of a column are made once for all partners that lack no more rows, and anew only for other sets of rows. Every
    cell is sorted once, and all pairs come from one matrix product over rows, not from rows for each pair.
    """
    if not pairs:
        return {}
    base = written(table.select(F.monotonically_increasing_id().alias("id"), *[F.col(n).cast("double").alias(f"c{i}") for i, n in enumerate(names)]))
    both = shared(base, [f"c{i}" for i in range(len(names))])
    alike = [min(j for j in range(len(names)) if both[i, j] == both[i, i] == both[j, j]) for i in range(len(names))]
    groups: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for a, b in pairs:
        rows = (alike[a],) if both[a, b] == both[a, a] else (alike[b],) if both[a, b] == both[b, b] else tuple(sorted((alike[a], alike[b])))
        groups[rows].append((a, b))
    out: dict = {}
    todo = list(groups.items())
    while todo:
        # as many sets of rows as fit into one product
        made: dict[tuple, int] = {}
        some = []
        while todo and (not some or len(made) + len({(x, todo[0][0]) for p in todo[0][1] for x in p}) <= MOST):
            rows, mine = todo.pop(0)
            some.append((rows, mine))
            for p in mine:
                for x in p:
                    made.setdefault((x, rows), len(made))
        columns = [F.when(F.expr(" and ".join(f"c{j} is not null" for j in rows)), F.col(f"c{x}")) for x, rows in made]
        long = cells(base, columns, "id")
        ranks = Sorted(long).ranks(long).groupBy("id").agg(F.collect_list(F.struct("pos", "rank")).alias("r"))  # one item for each column
        width = len(made)

        def dense(b, width=width):
            lists = b.column(b.schema.get_field_index("r"))
            flat = lists.flatten()
            x = np.zeros((b.num_rows, width))
            x[np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy())), flat.field("pos").to_numpy()] = flat.field("rank").to_numpy()
            return x

        g = products(ranks.select("r"), width, dense)
        for rows, mine in some:
            for a, b in mine:
                i, j = made[a, rows], made[b, rows]
                size = np.sqrt(g[i, i]) * np.sqrt(g[j, j])
                out[a, b] = (int(both[a, b]), float(np.clip(g[i, j] / size, -1, 1)) if size > 0 else None)
    return out
