"""Embedding near-dedup by the epsilon grid order join.

Unit vectors at cosine >= c lie within eps = sqrt(2 - 2c). They are projected on leading
principal directions (an orthonormal projection never lengthens a distance), put on a grid
of side eps, and sorted by cell: the epsilon grid order. The order is cut into strips of bounded
size at quantiles; a vector goes to the pairs of its strip with each strip whose box, in all directions kept, lies
within eps of it, so that it is copied as often as there are such strips (the root of the number of tasks, until a
strip would outgrow its bytes). Within a pair, intervals of the order are skipped if their boxes are provably
distant, else halved, and small ones are compared by a matrix product: in single precision to tell
what can't reach the threshold, in double for the rest. Equal vectors collapse first and count by
their number, and a pair of strips emits counts and a spanning forest, never pairs of vectors.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import dropped, written
from foliospark.llm.components import connected_components
from foliospark.llm.simhash import _roots

#: Principal directions kept for boxes, and those of them that order the strips.
DIRECTIONS, ORDERING = 16, 4
#: Bytes of a strip's vectors in double precision; vectors that a strip holds at least before parallelism makes more of them.
STRIP_BYTES, LEAST_STRIP = 32 << 20, 4096
#: Vectors of an interval that is compared outright, and of a part of the second strip that a task holds.
LEAF, TILE = 512, 4096
#: Within this distance of the threshold a cosine is computed anew, alone.
BORDER = 1e-9
#: The grid is no finer than this, so that cells are numbered exactly.
LEAST_SIDE = 1 / 64


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows or vanishes."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of packed numbers."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _sums(width: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                x = _unit(_vectors(b.column(0).slice(at, 4096), kind))
                n, total, square = n + len(x), total + x.sum(0), square + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([n] * (width + 1), pa.int64()), pa.array([total.tolist(), *square.tolist()], pa.list_(pa.float64()))], ["i", "n", "row"])

    return run


def directions(vectors: DataFrame, width: int, kind: str = "<f8", k: int = DIRECTIONS) -> np.ndarray:
    """width x k: leading principal directions of all unit vectors (one column, packed); width + 1 sums of rows reach the driver."""
    sums = vectors.mapInArrow(_sums(width, kind), "i int, n bigint, row array<double>")
    added = sums.select("i", "n", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    total, square, n = np.zeros(width), np.zeros((width, width)), 1
    for r in added:
        n = max(n, r.n)
        if r.i < 0:
            total[r.j] = r.x
        else:
            square[r.i, r.j] = r.x
    cov = square / n - np.outer(total, total) / n**2
    return np.linalg.eigh((cov + cov.T) / 2)[1][:, ::-1][:, : min(k, width)]


class Grid:
    """The directions, the grid, and the numbers that order cells."""

    def __init__(self, basis: np.ndarray, eps: float):
        self.basis, self.eps, self.side = basis, eps, max(eps, LEAST_SIDE)
        self.base = math.ceil(2 / self.side) + 3

    def place(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.basis

    def code(self, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The cell's number in grid order, and a fraction by a hash of the id, which parts a cell of any size."""
        cell = np.zeros(len(at))
        for k in range(min(ORDERING, at.shape[1])):
            cell = cell * self.base + np.clip(np.floor(at[:, k] / self.side) + self.base // 2, 0, self.base - 1)
        mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return cell + ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(40)).astype(np.float64) / 2**24

    def order(self, at: np.ndarray) -> np.ndarray:
        """Positions in grid order over all directions kept."""
        return np.lexsort(np.floor(at / self.side).T[::-1])


def _coded(grid: Grid, kind: str):
    """(id, vec) to codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(grid.code(grid.place(_unit(_vectors(b.column(1), kind))), ids))], ["code"])

    return run


def _boxed(grid: Grid, bounds: np.ndarray, kind: str):
    """(id, vec) to the box of each strip within the task: strip, direction, low, high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = grid.basis.shape[1]
        low, high = np.full((len(bounds) + 1, k), np.inf), np.full((len(bounds) + 1, k), -np.inf)
        for b in batches:
            if b.num_rows:
                at = grid.place(_unit(_vectors(b.column(1), kind)))
                strip = np.searchsorted(bounds, grid.code(at, b.column(0).to_numpy(zero_copy_only=False)), "right")
                np.minimum.at(low, strip, at)
                np.maximum.at(high, strip, at)
        s, d = np.nonzero(low <= high)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(d, pa.int32()), pa.array(low[s, d]), pa.array(high[s, d])], ["strip", "direction", "low", "high"])

    return run


def _sent(grid: Grid, bounds: np.ndarray, low: np.ndarray, high: np.ndarray, kind: str):
    """(id, vec, mult) to a row for each pair of strips in which the vector may have a partner: pair, side, id, mult, vec."""
    reach = grid.eps**2 * (1 + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, 1024):
                part = b.slice(begin, 1024)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                at = grid.place(_unit(_vectors(part.column(1), kind)))
                own = np.searchsorted(bounds, grid.code(at, ids), "right")
                gap = np.zeros((len(ids), len(low)))
                for k in range(at.shape[1]):
                    x = at[:, k, None]
                    away = np.maximum(0, np.maximum(low[:, k] - x, x - high[:, k]))
                    gap += away * away
                row, other = np.nonzero((gap <= reach) | (np.arange(len(low)) == own[:, None]))
                a, c = np.minimum(own[row], other).astype(np.int64), np.maximum(own[row], other).astype(np.int64)
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c * (c + 1) // 2 + a), pa.array((own[row] != a).astype(np.int32)), part.column(0).take(taken), part.column(2).take(taken), part.column(1).take(taken)], ["pair", "side", "id", "mult", "vec"]
                )

    return run


class _Side:
    """Vectors of a strip, or of a part of one, in grid order."""

    def __init__(self, ids: np.ndarray, mults: np.ndarray, raw: np.ndarray, grid: Grid):
        unit = _unit(raw)
        at = grid.place(unit)
        order = grid.order(at)
        self.ids, self.mults, self.raw, self.at = ids[order], mults[order], raw[order], at[order]
        self.single = unit[order].astype(np.float32)

    def box(self, a: int, b: int):
        return self.at[a:b].min(0), self.at[a:b].max(0)


def _distant(low_a, high_a, low_b, high_b, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float((gap * gap).sum()) > eps * eps * (1 + 1e-9)


def join_intervals(x: _Side, y: _Side, same: bool, least: float, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in x, in y) of linked vectors; of one side with itself, each pair once."""
    if not len(x.ids) or not len(y.ids):
        return
    margin = 1e-5 + 1e-6 * x.raw.shape[1]  # what single precision may be wrong by
    work = [(0, len(x.ids), 0, len(y.ids))]
    while work:
        a, b, c, d = work.pop()
        if a == b or c == d or (same and d <= a) or _distant(*x.box(a, b), *y.box(c, d), eps):
            continue
        if b - a <= LEAF and d - c <= LEAF:
            if float((x.single[a:b] @ y.single[c:d].T).max()) < least - margin:
                continue
            u, v = _unit(x.raw[a:b]), _unit(y.raw[c:d])
            cos = u @ v.T
            near = cos >= least
            for i, j in np.argwhere(np.abs(cos - least) < BORDER):
                p, q = u[i], v[j]
                near[i, j] = float(p @ q) / (math.sqrt(float(p @ p)) * math.sqrt(float(q @ q))) >= least
            i, j = np.nonzero(near)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            yield i, j
        elif b - a >= d - c:
            m = (a + b) // 2
            work += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            work += [(a, b, c, m), (a, b, m, d)]


def _joined(grid: Grid, least: float, kind: str):
    """Rows (pair, side, id, mult, vec) in order of pair and side: counts and forest links of each pair of strips."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for b in batches:
            pair, side = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            cuts = [0, *(np.flatnonzero((np.diff(pair) != 0) | (np.diff(side) != 0)) + 1).tolist(), b.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                for at in range(begin, end, TILE):
                    yield int(pair[at]), int(side[at]), b.slice(at, min(TILE, end - at))

    def side_of(rows: list[pa.RecordBatch]) -> _Side:
        number = lambda k: np.concatenate([r.column(k).to_numpy(zero_copy_only=False) for r in rows])
        return _Side(number(2), number(3), np.concatenate([_vectors(r.column(4), kind) for r in rows]), grid)

    def tiles(rows: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, n = [], 0
        for r in rows:
            held.append(r)
            n += r.num_rows
            if n >= TILE:
                yield held
                held, n = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, of_pair in itertools.groupby(parts(batches), key=lambda p: p[0]):
            diagonal = math.isqrt(8 * pair + 9) ** 2 == 8 * pair + 9  # of a strip with itself: pair = c (c + 3) / 2
            x = ids = counts = label = None

            def hook(i: np.ndarray, j: np.ndarray) -> None:
                nonlocal label
                u, v = label[i], label[j]  # the roots of what is linked so far: links never pile up
                new = u != v
                if new.any():
                    label = _roots(len(label), np.concatenate([np.arange(len(label)), u[new]]), np.concatenate([label, v[new]]))

            for side, rows in itertools.groupby(of_pair, key=lambda p: p[1]):
                batches_of = (r for _, _, r in rows)
                if side == 0:
                    x = side_of(list(batches_of))
                    ids, counts, label = x.ids, np.zeros(len(x.ids), np.int64), np.arange(len(x.ids))
                    if diagonal:
                        for i, j in join_intervals(x, x, True, least, grid.eps):
                            np.add.at(counts, i, x.mults[j])
                            np.add.at(counts, j, x.mults[i])
                            hook(i, j)
                    continue
                if x is None:
                    continue
                for tile in tiles(batches_of):
                    y, n = side_of(tile), len(ids)
                    ids, counts, label = np.concatenate([ids, y.ids]), np.concatenate([counts, np.zeros(len(y.ids), np.int64)]), np.concatenate([label, np.arange(n, n + len(y.ids))])
                    for i, j in join_intervals(x, y, False, least, grid.eps):
                        np.add.at(counts, i, y.mults[j])
                        np.add.at(counts, j + n, x.mults[i])
                        hook(i, j + n)
            if ids is not None and (hit := np.flatnonzero(counts)).size:
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[label[hit]]), pa.array(counts[hit])], ["id", "root", "n"])

    return run


def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """A row per row of df: vec_id, n_links (other vectors at cosine >= least), component_id (smallest vec_id reachable), kept (vec_id = component_id).

    Vectors link with those of their own length; those that are null, zero, or hold a null or
    non-finite component link with nothing. Repeated rows are vectors of their own: they link,
    and kept is true for each with the smallest id. Rows with a null vec_id keep a null
    component_id if all vectors in reach lack an id. Other columns are ignored.
    """
    element = df.schema[vector].dataType.elementType
    single = isinstance(element, T.FloatType)
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("vec"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", finite) & F.exists("vec", lambda x: x != 0.0)
    # Zero has two signs; equal vectors must be equal as keys.
    zero = F.lit(0.0).cast("float" if single else "double")
    good = rows.where(usable).withColumn("vec", F.transform("vec", lambda x: x + zero)).withColumn("width", F.size("vec"))
    out = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    for [width] in good.select("width").distinct().orderBy("width").collect():
        out = _of_one_width(good.where(F.col("width") == width), width, least, single).unionByName(out)
    return out.select("vec_id", "n_links", F.col("component_id").cast(df.schema[vec_id].dataType).alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _packed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.asarray(x, kind).tobytes() for x in rows], pa.binary()), b.column(1)], ["id", "vec", "mult"])

    return run


def _of_one_width(good: DataFrame, width: int, least: float, single: bool) -> DataFrame:
    """vec_id, n_links, component_id of the vectors of one length; good: vec_id, vec."""
    spark, kind = good.sparkSession, "<f4" if single else "<f8"
    eps = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    same: Column = F.unhex(F.sha2(F.to_json("vec").cast("binary"), 256)).alias("same")
    keyed = written(good.select("vec_id", same), "ids")
    # An id for each class of equal vectors: the smallest vec_id, or a hash above all ids if none has one.
    top = int(keyed.agg(F.max("vec_id")).first()[0] or 0)
    named = F.coalesce(F.min("vec_id").cast("long"), F.lit(top + 1) + F.shiftrightunsigned(F.xxhash64(F.first("same")), 2)).alias("id")
    nodes = written(keyed.groupBy("same").agg(named, F.count("*").alias("mult")), "nodes")
    classes = good.select("vec_id", same, "vec").groupBy("same").agg(named, F.count("*").alias("mult"), F.first("vec").alias("vec")).select("id", "mult", "vec")
    vectors = written(classes.mapInArrow(_packed(kind), "id bigint, vec binary, mult bigint"), "vectors")
    n = vectors.count()
    grid = Grid(directions(vectors.select("vec"), width, kind), eps)
    strips = max(1, -(-n * 8 * width // STRIP_BYTES), min(-(-n // LEAST_STRIP), math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism))))
    pairs = strips * (strips + 1) // 2
    bounds = np.zeros(0)
    if strips > 1:
        codes = vectors.select("id", "vec").mapInArrow(_coded(grid, kind), "code double")
        bounds = np.array(codes.approxQuantile("code", [k / strips for k in range(1, strips)], 0.05 / strips))
    low, high = np.full((strips, grid.basis.shape[1]), np.inf), np.full((strips, grid.basis.shape[1]), -np.inf)
    boxes = vectors.select("id", "vec").mapInArrow(_boxed(grid, bounds, kind), "strip int, direction int, low double, high double")
    for r in boxes.groupBy("strip", "direction").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low[r.strip, r.direction], high[r.strip, r.direction] = r.low, r.high
    sent = vectors.mapInArrow(_sent(grid, bounds, low, high, kind), "pair bigint, side int, id bigint, mult bigint, vec binary")
    tasks = min(pairs, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
    dealt = sent.repartitionById(tasks, (F.col("pair") % tasks).cast("int")).sortWithinPartitions("pair", "side")
    linked = written(dealt.mapInArrow(_joined(grid, least, kind), "id bigint, root bigint, n bigint"), "linked")
    dropped(vectors)
    counts = linked.groupBy("id").agg(F.sum("n").alias("n"))
    parts = connected_components(linked.select(F.col("id").alias("u"), F.col("root").alias("v")))
    reached = F.coalesce(F.col("component"), F.col("id"))
    by_class = (
        nodes.join(counts.hint("merge"), "id", "left")
        .join(parts.hint("merge"), F.col("id") == F.col("node"), "left")
        .select("same", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.when(reached <= top, reached).alias("component_id"))
    )
    return keyed.join(by_class.hint("merge"), "same").select("vec_id", "n_links", "component_id")
