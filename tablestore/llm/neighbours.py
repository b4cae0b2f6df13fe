"""Approximate nearest neighbours on shifted space-filling curves.

Unit vectors are projected on a few random directions, shifted at random, and ordered along a Hilbert curve; several
such orderings differ in directions and shift. Each ordering is cut into ranges of about equal size at quantiles
that Spark computes. A query searches, on every curve, its own range and the ranges next to it; what the curves
find is merged and ranked by the exact cosine of the original vectors. The window is a share of the rows, so
that recall does not fall as tables grow: vectors without clusters need wide windows. Vectors of each length have curves
of their own.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablestore.llm.common import checkpoint, quoted

CURVES = 16
DIRECTIONS = 4
LEVELS = 8
#: A window is the query's own range and so many ranges to either side that it holds `REACH` of all ranges at least.
RANGES = 32
REACH = 3 / 32
#: Vectors of a range, about, at most and at least: the number of ranges grows with the table in steps of RANGES.
RANGE_ROWS = 20_000
MIN_ROWS = 64
SEED = 7


def hilbert(cells: np.ndarray, levels: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells, whole numbers below 2 ** levels.

    From the highest bit down, the cube is turned so that the curve of each half meets the next (Skilling's
    transposition); the bits are then read crosswise.
    """
    x = [c.astype(np.int64) for c in cells.T]
    for level in range(levels - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            turned = (x[i] & bit) != 0
            swapped = np.where(turned, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(turned, x[0] ^ below, x[0] ^ swapped)
            if i:
                x[i] = x[i] ^ swapped
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(levels - 1, 0, -1):
        flip = np.where((x[-1] >> level) & 1, flip ^ ((1 << level) - 1), flip)
    place = np.zeros_like(x[0])
    for level in range(levels - 1, -1, -1):
        for c in x:
            place = (place << 1) | (((c ^ flip) >> level) & 1)
    return place


class Curves:
    """The orderings: directions and shifts drawn once from a seed."""

    def __init__(self, size: int, curves: int = CURVES, directions: int = DIRECTIONS, levels: int = LEVELS, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.levels, n = levels, min(directions, size)
        self.axes = [np.linalg.qr(draw.standard_normal((size, n)))[0] for _ in range(curves)]
        self.shifts = [draw.uniform(-0.5, 0.5, n) for _ in range(curves)]
        self.spread = 8 / np.sqrt(size)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """A key for each vector and curve; the low bits tell directions in one cell apart at random."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        side = 1 << self.levels
        salt = _salt(unit)
        out = []
        for axes, shift in zip(self.axes, self.shifts):
            at = (unit @ axes) / self.spread + 0.5 + shift / 4
            cells = np.clip((at * side).astype(np.int64), 0, side - 1)
            out.append((hilbert(cells, self.levels) << 20) | salt)
        return np.stack(out, 1)


def _salt(unit: np.ndarray) -> np.ndarray:
    """A hash of the direction to some digits, so that parallel vectors stay together."""
    digits = np.rint(unit * 1e6).astype(np.int64).view(np.uint64)
    mixed = (digits * np.arange(1, 2 * digits.shape[1], 2, dtype=np.uint64)).sum(1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(44)).astype(np.int64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, id, vector): the rows that take part, with a number for each.

    Null ids, null or empty vectors, zero vectors and those that hold null or non-finite components take no part.
    """
    v = F.col("vector")
    kind = vectors.schema[vector].dataType.elementType
    whole = quoted(vector) if isinstance(kind, (T.FloatType, T.DoubleType)) else quoted(vector).cast("array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), quoted(id).alias("id"), whole.alias("vector")).where(F.col("id").isNotNull() & v.isNotNull())
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(finite & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False))))


class _Space:
    """The vectors of one length: their curves, and where each is cut."""

    def __init__(self, size: int, n: int, curves: int, reach: float):
        # ranges of a few rows would leave windows empty; their number grows with the table in steps of RANGES
        self.ranges = min(RANGES * max(1, -(-n // (RANGES * RANGE_ROWS))), max(1, n // MIN_ROWS))
        self.window = max(0, ceil((reach * self.ranges - 1) / 2))
        self.size, self.curves = size, Curves(size, curves)
        self.cuts = [np.zeros(0, np.int64)] * curves

    def cut(self, vectors: DataFrame) -> None:
        """Quantiles of the keys on each curve, which Spark computes."""
        if self.ranges < 2:
            return
        order, n = self.curves, len(self.cuts)

        def keyed(batches):
            for b in batches:
                if b.num_rows:
                    keys = order.keys(_matrix(b.column("vector")))
                    yield pa.RecordBatch.from_pydict({f"k{i}": keys[:, i] for i in range(n)})

        shares = [i / self.ranges for i in range(1, self.ranges)]
        found = vectors.where(F.size("vector") == self.size).select("vector").mapInArrow(keyed, ", ".join(f"k{i} long" for i in range(n)))
        got = found.agg(*(F.percentile_approx(f"k{i}", shares, max(10_000, 20 * self.ranges)) for i in range(n))).first()
        self.cuts = [np.array(c, np.int64) for c in got]

    def cells(self, batch: pa.RecordBatch, around: int) -> pa.Table:
        """Each row with the number of each cell it goes to: its range on each curve, and `around` to both sides."""
        keys = self.curves.keys(_matrix(batch.column("vector")))
        row, cell = [], []
        for i, cuts in enumerate(self.cuts):
            own = np.searchsorted(cuts, keys[:, i], side="left")
            for d in range(-around, around + 1):
                real = np.flatnonzero((own + d >= 0) & (own + d < self.ranges))
                row.append(real)
                cell.append(i * self.ranges + own[real] + d)
        out = pa.Table.from_batches([batch]).take(pa.array(np.concatenate(row)))
        return out.append_column("cell", pa.array((self.size << 32) + np.concatenate(cell), pa.int64()))


def _spread(spaces: dict[int, _Space], queries: bool):
    """Rows to their cells: a query's windows, a candidate's ranges."""
    def run(batches):
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column("vector")))
            for size in np.unique(sizes).tolist():
                space = spaces[size]
                part = batch.filter(pa.array(sizes == size))
                for start in range(0, part.num_rows, 1000):
                    yield from space.cells(part.slice(start, 1000), space.window if queries else 0).to_batches()
    return run


def _exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in extended precision, rounded once: parallel vectors get equal ones."""
    v, q = vectors.astype(np.longdouble), query.astype(np.longdouble)
    return ((v * q).sum(1) / np.sqrt((v * v).sum(1) * (q * q).sum())).astype(np.float64)


def _search(k: int):
    def search(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        out = {"query": [], "query_id": [], "row": [], "id": [], "score": []}
        if q.num_rows and c.num_rows:
            vectors, who = _matrix(c["vector"]), c["who"].to_pylist()
            unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
            number, name = q["row"].to_pylist(), q["id"].to_pylist()
            # all that may reach the score of the k-th candidate, the query's own vector not counted
            several = min(len(vectors), k + 1)
            for start in range(0, q.num_rows, 256):
                wanted = _matrix(q["vector"].slice(start, 256))
                near = (wanted / np.linalg.norm(wanted, axis=1)[:, None]) @ unit.T
                least = np.partition(near, -several, axis=1)[:, -several] - 1e-9
                for a in range(len(wanted)):
                    at = np.flatnonzero(near[a] >= least[a])
                    found = [(-s, x["id"], x["row"]) for s, j in zip(_exact(vectors[at], wanted[a]).tolist(), at.tolist()) for x in who[j] if x["row"] != number[start + a]]
                    for score, id, row in sorted(found)[:k]:
                        for column, x in zip(out.values(), (number[start + a], name[start + a], row, id, -score)):
                            column.append(x)
        kind = q.schema.field("id").type
        return pa.table({"query": pa.array(out["query"], pa.int64()), "query_id": pa.array(out["query_id"], kind), "row": pa.array(out["row"], pa.int64()), "id": pa.array(out["id"], kind), "score": pa.array(out["score"], pa.float64())})
    return search


def _prepared(vectors: DataFrame, k: int, id: str, vector: str, curves: int, reach: float) -> tuple[DataFrame, DataFrame, dict[int, _Space]]:
    """The rows, their distinct vectors with the k + 1 least of the rows that have them, and the spaces by length."""
    rows = checkpoint(usable(vectors, id, vector))
    # row numbers limited to k + 1 are cut before the shuffle, so equal vectors don't gather
    least = F.row_number().over(Window.partitionBy("vector").orderBy("id", "row"))
    distinct = rows.withColumn("n", least).where(F.col("n") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("who"))
    distinct = checkpoint(distinct)
    spaces = {r["size"]: _Space(r["size"], r["n"], curves, reach) for r in distinct.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    for space in spaces.values():
        space.cut(distinct)
    return rows, distinct, spaces


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding",
            curves: int = CURVES, reach: float = REACH) -> DataFrame:
    """query_id, rank, id, score: for each usable row where `queries` holds (a condition on the id column), the k
    nearest found by cosine, ties to the smaller id; all candidates if there are fewer.

    Rows are queries and candidates of their own, also if they repeat an id or a vector: a query's candidates are all
    rows but itself, of its length. Equal vectors are found as one, and the k + 1 least of their rows stand for all: no more
    can be among k nearest. Whatever ties with the k-th of a window is compared, scaled copies of a vector among it. An
    empty table gives no rows. The lengths that occur are taken one after the other: they should be few.
    """
    rows, distinct, spaces = _prepared(vectors, k, id, vector, curves, reach)
    kind, array = dict(rows.dtypes)["id"], dict(rows.dtypes)["vector"]
    if not spaces:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id), F.lit(0.0).alias("score"))
    asking = rows.select("row", F.col("id").alias(id), "vector").where(queries).select("row", F.col(id).alias("id"), "vector")
    asked = asking.mapInArrow(_spread(spaces, True), f"row long, id {kind}, vector {array}, cell long")
    stored = distinct.select("who", "vector").mapInArrow(_spread(spaces, False), f"who array<struct<id:{kind},row:bigint>>, vector {array}, cell long")
    hits = asked.groupBy("cell").cogroup(stored.groupBy("cell")).applyInArrow(_search(k), f"query long, query_id {kind}, row long, id {kind}, score double")
    merged = hits.groupBy("query", "query_id", "row", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "row"))
    out = merged.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(id), "score")


def scanned(vectors: DataFrame, queries: Column, id: str = "vec_id", vector: str = "embedding", curves: int = CURVES, reach: float = REACH) -> tuple[float, float]:
    """What share of the distinct vectors a query meets on average, and how many times a vector is compared for a query.

    For measurements: it counts pairs of queries and cells' vectors, which takes the work of a brute-force search.
    """
    rows, distinct, spaces = _prepared(vectors, 1, id, vector, curves, reach)
    asking = rows.select("row", F.col("id").alias(id), "vector").where(queries).select("row", "vector")
    asked = asking.mapInArrow(_spread(spaces, True), f"row long, vector {dict(rows.dtypes)['vector']}, cell long").select("row", "cell")
    stored = distinct.select(F.xxhash64("vector").alias("of"), "vector").mapInArrow(_spread(spaces, False), f"of long, vector {dict(rows.dtypes)['vector']}, cell long").select("of", "cell")
    pairs = asked.join(stored, "cell").groupBy("row", "of").agg(F.count(F.lit(1)).alias("n"))
    met, compared = pairs.agg(F.count(F.lit(1)), F.sum("n")).first()
    every = asking.count() * distinct.count()
    return met / every, compared / every
