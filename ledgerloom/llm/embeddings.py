"""Near-duplicate vectors: a pigeonhole join over rotated low-dimensional blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.tables import aside, join_small, runs_of
from ledgerloom.session import stage

BLOCK = 8
#: Vectors of a cell compared in one task; larger cells are cut into tiles.
_TILE = 2048
#: Added to every squared-distance budget for the rounding of double arithmetic.
_SLACK = 1e-9
_CELL = ["label", "block", "cell"]


def rotation(dim: int, seed: int) -> np.ndarray:
    """A seeded random orthogonal matrix; distances survive it, axes do not."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def grid_dims(largest: int) -> int:
    """Dimensions of a block laid out in cells: more for larger groups of vectors.

    A ball touches about half of what an axis holds, so each further dimension
    halves the vectors met; four at most, as each also doubles the cells touched.
    """
    return min(4, max(2, 2 + ceil(log(max(largest, 1) / 20_000, 2))))


class _Space:
    """Unit vectors, their rotation, and the budget of each block."""

    def __init__(self, dim: int, kind: str, cosine: float, grid: int, seed: int) -> None:
        self.dim, self.kind, self.cosine, self.grid = dim, kind, cosine, grid
        self.turn = rotation(dim, seed)
        self.blocks = [(i, min(i + BLOCK, dim)) for i in range(0, dim, BLOCK)]
        # |u - v|^2 = 2 (1 - cos): if all blocks exceeded their part, the sum would.
        budget = 2 * (1 - cosine)
        self.limits = [budget * (hi - lo) / dim + _SLACK for lo, hi in self.blocks]

    def unit(self, blobs) -> np.ndarray:
        rows = np.frombuffer(b"".join(blobs.to_pylist()), self.kind).reshape(-1, self.dim)
        rows = rows.astype(np.float64)
        return rows / np.sqrt((rows * rows).sum(1, keepdims=True))

    def within(self, turned: np.ndarray, x: np.ndarray, y: np.ndarray, b: int) -> np.ndarray:
        lo, hi = self.blocks[b]
        return ((turned[x, lo:hi] - turned[y, lo:hi]) ** 2).sum(1) <= self.limits[b]


def _code(cell: np.ndarray) -> np.ndarray:
    """One integer for a cell; coordinates are small, as unit vectors have small parts."""
    code = np.zeros(len(cell), np.int64)
    for d in range(cell.shape[1]):
        code = code * 65536 + cell[:, d] + 32768
    return code


def _cells(space: _Space):
    """Vectors to cells: the own cell of each block (home), and those behind it in
    cell order that a ball of the block's budget touches."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            turned = space.unit(batch.column("vector")) @ space.turn
            for b, (lo, hi) in enumerate(space.blocks):
                # Cells are as wide as a ball, which so touches two of an axis.
                at = turned[:, lo : min(lo + space.grid, hi)] / (2 * np.sqrt(space.limits[b]))
                own = np.floor(at).astype(np.int64)
                sides = (
                    np.floor(at - 0.5 - _SLACK).astype(np.int64), own,
                    np.floor(at + 0.5 + _SLACK).astype(np.int64),
                )
                for picks in product((0, 1, 2), repeat=own.shape[1]):
                    cell = np.stack([sides[p][:, d] for d, p in enumerate(picks)], 1)
                    home = all(p == 1 for p in picks)
                    moved = [cell[:, d] != own[:, d] for d, p in enumerate(picks) if p != 1]
                    take = np.all(moved, axis=0) & (_code(cell) > _code(own)) if moved else None
                    rows = np.flatnonzero(take) if moved else np.arange(len(cell))
                    yield pa.RecordBatch.from_pydict({
                        **{c: batch.column(c).take(pa.array(rows))
                           for c in ("node", "label", "weight", "vector")},
                        "block": pa.array(np.full(len(rows), b), pa.int32()),
                        "cell": _code(cell[rows]),
                        "home": pa.array(np.full(len(rows), home)),
                    })

    return read


def _compare(space: _Space):
    """Tiles of cells to (a, b, n): the links of a (b null), and edges (n 0).

    A pair within the budgets of several blocks counts in the first of them only.
    Edges are a spanning forest of the links of the tile.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs_of(batches, [*_CELL, "i", "j"]):
            block, i, j = (tile.column(c)[0].as_py() for c in ("block", "i", "j"))
            node, weight, home, side = (
                tile.column(c).to_numpy() for c in ("node", "weight", "home", "side")
            )
            unit = space.unit(tile.column("vector"))
            x, y = _linked(space, unit, unit @ space.turn, node, home,
                           np.flatnonzero(side == i), np.flatnonzero(side == j), block, i == j)
            if not len(x):
                continue
            count = np.zeros(len(node), np.int64)
            np.add.at(count, x, weight[y])
            np.add.at(count, y, weight[x])
            some = np.flatnonzero(count)
            root = _forest(len(node), x, y)
            hooked = np.flatnonzero(root != np.arange(len(node)))
            counts = np.arange(len(some) + len(hooked)) < len(some)
            yield pa.RecordBatch.from_pydict({
                "a": node[np.concatenate([some, hooked])],
                "b": pa.array(node[np.concatenate([some, root[hooked]])], mask=counts),
                "n": np.concatenate([count[some], np.zeros(len(hooked), np.int64)]),
            })

    return read


def _linked(space, unit, turned, node, home, left, right, block, own):
    lo, hi = space.blocks[block]
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    flat = turned[right, lo:hi]
    for part in np.array_split(left, len(left) // 512 + 1):
        rows = turned[part, lo:hi]
        square = (rows**2).sum(1)[:, None] + (flat**2).sum(1) - 2 * rows @ flat.T
        # A first look with room for rounding; the exact test is the one of `within`.
        near = (square <= 1.001 * space.limits[block]) & (home[part][:, None] | home[right])
        if own:
            near &= node[right] > node[part][:, None]
        p, q = np.nonzero(near)
        x, y = part[p], right[q]
        keep = space.within(turned, x, y, block)
        for earlier in range(block):
            keep &= ~space.within(turned, x, y, earlier)
        x, y = x[keep], y[keep]
        link = (unit[x] * unit[y]).sum(1) >= space.cosine
        xs.append(x[link])
        ys.append(y[link])
    return np.concatenate(xs), np.concatenate(ys)


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least row reachable from each row."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _packed(dim: int, kind: str):
    """Lists to packed vectors, padded with zeros to the longest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, dim), kind)
            for r, v in enumerate(batch.column("embedding")):
                v = v.values.to_numpy(zero_copy_only=False)
                rows[r, : len(v)] = v
            blobs = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("node", "label", "weight")}, "vector": blobs,
            })

    return read


def _usable(vector: Column) -> Column:
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    seed: int = 1,
) -> DataFrame:
    """Link vectors of one label whose cosine is at least ``cosine``.

    Adds ``n_links`` (other vectors linked directly), ``component_id`` (the smallest
    id reachable) and ``kept``.

    Equal vectors of a label are one node with a weight.  Unit vectors are rotated
    and split into blocks of eight dimensions; a linked pair lies within its share
    of the squared-distance budget in at least one block, so a range join of each
    block finds it.  The range join goes by grid cells on the first dimensions of a
    block; a cell's vectors meet in one task, in tiles of bounded size if there are
    many.  The first block that holds a pair checks its cosine in double precision,
    so each link counts once, and passes on counts and a spanning forest of the
    links, never all pairs.

    Null or unusable vectors (zero, null or non-finite parts), and those without a
    label, link with nothing.  Vectors of different length never link.  Rows with a
    null id count as links, but name no component unless all its ids are null; then
    all its rows are kept.  An empty table gives no rows.  Input columns with the
    names of results are replaced.
    """
    vectors, back = aside(
        vectors, ["n_links", "component_id", "kept"], ["_node", "_root", "_w", "_links", "_least"],
        [id_col, vector_col, label_col],
    )
    vector, label = F.col(vector_col), F.col(label_col)
    usable = _usable(vector) & label.isNotNull()
    marked = vectors.withColumn("_node", F.when(usable, F.xxhash64(label, F.size(vector), vector)))
    known = marked.where("_node is not null")
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    classes = stage(
        known.groupBy(F.col("_node").alias("node")).agg(
            F.first(F.xxhash64(label, F.size(vector))).alias("label"),
            F.count("*").alias("weight"), F.first(vector).alias("embedding"),
        ),
        "vectors",
    )
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    dim = classes.agg(F.max(F.size("embedding"))).first()[0]
    space = _Space(dim or 1, kind, cosine, grid_dims(largest or 0), seed)
    schema = "node long, label long, weight long, vector binary"
    packed = stage(classes.mapInArrow(_packed(space.dim, kind), schema), "packed")

    cells = packed.mapInArrow(_cells(space), f"{schema}, block int, cell long, home boolean")
    crowd = cells.groupBy(*_CELL).agg(F.count("*").alias("_n")).where(F.col("_n") > _TILE)
    crowd = stage(crowd, "crowds")
    tiles = F.coalesce(F.ceil(F.col("_n") / _TILE), F.lit(1)).cast("int")
    tiled = (
        join_small(cells, crowd, _CELL)
        .withColumn("side", F.pmod(F.xxhash64("node"), tiles).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .withColumn("i", F.least("side", "_other"))
        .withColumn("j", F.greatest("side", "_other"))
        .drop("_other", "_n")
    )
    keys = [*_CELL, "i", "j"]
    found = stage(
        tiled.repartition(*keys).sortWithinPartitions(*keys)
        .mapInArrow(_compare(space), "a long, b long, n long"),
        "links",
    )
    counts = found.where("b is null").groupBy(F.col("a").alias("_node")).agg(
        F.sum("n").alias("_links")
    )
    labels = components(found.where("b is not null").select("a", "b"))
    nodes = stage(
        classes.select(F.col("node").alias("_node"), F.col("weight").alias("_w"))
        .join(counts, "_node", "left")
        .join(labels.toDF("_node", "_root"), "_node", "left")
        .select("_node", "_w", F.coalesce("_links", F.lit(0)).alias("_links"),
                F.coalesce("_root", "_node").alias("_root")),
        "nodes",
    )
    named = join_small(marked, nodes, "_node")
    least = stage(
        named.where("_root is not null").groupBy("_root").agg(F.min(id_col).alias("_least")),
        "smallest",
    )
    component = F.when(F.col("_root").isNull(), F.col(id_col)).otherwise(F.col("_least"))
    return join_small(named, least, "_root").select(
        *back,
        F.coalesce(F.col("_w") - 1 + F.col("_links"), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col(id_col).eqNullSafe(component).alias("kept"),
    )
