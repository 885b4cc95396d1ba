"""Exact top-k search by inner product: norm buckets with pruning, then products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.tables import KEY, join_small, runs_of, with_key
from ledgerloom.session import stage

#: Norms of a level differ by this factor at most; levels start at its whole powers.
#: There are at most 8 * 1024 of them: whole numbers have norms of 1 to 2 ** 1024, or 0.
LEVEL = 2 ** (1 / 8)
#: Vectors of a bucket and queries of a block, compared in one task.
_BUCKET, _BLOCK = 8192, 2048
#: Of the longest vectors, about so many are looked at first.
_SEEDS = 1024
#: Coordinates looked at by coordinate pruning.
_FOCUS = 3
#: From this cosine on, intervals of single coordinates rule out more than they cost.
_COORDINATE_COSINE = 0.7
#: Whole numbers are exact in doubles up to here.
_EXACT = 2.0**53
_LIMIT = (1 << 63) - 1
#: Stands for a null id, behind all others.
_NO_ID = _LIMIT
#: Room for the rounding of thresholds, norms and cosines.
_SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Vectors without null and non-finite components."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vector.isNotNull() & finite


def _scaled(scale: float):
    """Vectors to packed floors of their scaled components, with norm and level."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            width = vectors.value_lengths().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                flat = scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
            flat = np.floor(np.nan_to_num(flat)) + 0.0
            begin = np.cumsum(width) - width
            for w in np.unique(width):
                of = np.flatnonzero(width == w)
                rows = flat[begin[of][:, None] + np.arange(w)]
                top = np.maximum(np.abs(rows).max(1, initial=0), 1)
                with np.errstate(over="ignore"):
                    norm = top * np.sqrt(((rows / top[:, None]) ** 2).sum(1))
                norm = np.minimum(norm, np.finfo(float).max)
                whole = top < 1 << 31
                blobs = [
                    (r.astype("<i4") if fits else r).tobytes()
                    for r, fits in zip(rows, whole, strict=True)
                ]
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("id").take(pa.array(of)),
                    "is_query": batch.column("is_query").take(pa.array(of)),
                    "width": pa.array(np.full(len(of), w), pa.int32()),
                    "norm": norm,
                    "level": pa.array(np.log(np.maximum(norm, 1)) // np.log(LEVEL), pa.int32()),
                    "vector": pa.array(blobs, pa.binary()),
                })

    return read


def _matrix(column, width: int) -> np.ndarray:
    """Packed vectors as rows of doubles; four bytes a component where those hold it."""
    blobs = column.to_pylist()
    if all(len(b) == 4 * width for b in blobs):
        return np.frombuffer(b"".join(blobs), "<i4").reshape(len(blobs), width).astype(float)
    kinds = ["<i4" if len(b) == 4 * width else "<f8" for b in blobs]
    return np.array([np.frombuffer(b, k) for b, k in zip(blobs, kinds, strict=True)], float)


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: doubles where they fit, else integers."""
    bound = (
        np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(queries.shape[1], 1)
    )
    if bound < _EXACT:
        return queries @ vectors.T
    exact = np.array([[int(x) for x in row] for row in queries], object)
    return exact.reshape(queries.shape) @ np.array(
        [[int(x) for x in row] for row in vectors], object).reshape(vectors.shape).T


class Bucket:
    """Vectors of like norm, longest first, and two ways to rule some of them out."""

    def __init__(self, vectors: np.ndarray, norms: np.ndarray) -> None:
        self.order = np.argsort(-norms, kind="stable")
        self.vectors, self.norms = vectors[self.order], norms[self.order]
        self.longest = self.norms[0] if len(norms) else 0.0
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_length(self, least: float, norm: float) -> int:
        """How many of the longest vectors may reach a product of ``least``."""
        if least <= 0 or norm == 0:
            return len(self.norms)
        short = least / norm * (1 - _SLACK)
        return int(np.searchsorted(-self.norms, -short, side="right"))

    def _along(self, axis: int) -> tuple[np.ndarray, np.ndarray]:
        if axis not in self._sorted:
            part = self.vectors[:, axis] / np.maximum(self.norms, 1e-300)
            order = np.argsort(part, kind="stable")
            self._sorted[axis] = part[order], order
        return self._sorted[axis]

    def by_coordinates(self, query: np.ndarray, norm: float, cosine: float) -> np.ndarray:
        """Vectors whose largest coordinates of the query allow the cosine.

        A unit vector within an angle of the query has its coordinate within
        ``cosine q +- sqrt((1 - cosine^2) (1 - q^2))``; on the side on which the
        query itself lies the bound is the angle's, so 1 where it reaches the pole.
        """
        unit = query / norm
        kept = None
        for axis in np.argsort(-np.abs(unit), kind="stable")[:_FOCUS]:
            q = unit[axis]
            wide = np.sqrt(max(0.0, (1 - cosine**2) * (1 - q * q)))
            low = -1.0 if -q >= cosine else cosine * q - wide
            high = 1.0 if q >= cosine else cosine * q + wide
            value, order = self._along(axis)
            a, b = np.searchsorted(value, [low - _SLACK, high + _SLACK])
            if kept is None:
                kept = order[a:b]
            else:
                of = self.vectors[kept, axis] / np.maximum(self.norms[kept], 1e-300)
                kept = kept[(of >= low - _SLACK) & (of <= high + _SLACK)]
        return kept


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the k highest scores are, ties to smaller ids."""
    if len(scores) > 4 * k and scores.dtype != object:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    order = sorted(some, key=lambda i: (-scores[i], ids[i]))
    return np.array(order[:k], np.int64)


def _search(k: int):
    """Tiles of one bucket and one block of queries to (query, node, low, score).

    Rows with ``side`` 0 are queries with the least score that counts, those with 1
    vectors.  A query gets its k + 1 best of the tile, as one of them may be its own row.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs_of(batches, ["width", "bucket", "block"]):
            side = tile.column("side").to_numpy()
            asked, given = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(asked) or not len(given):
                continue
            rows = _matrix(tile.column("vector"), tile.column("width")[0].as_py())
            node, norm, least, low = (
                tile.column(c).to_numpy() for c in ("node", "norm", "least", "low")
            )
            bucket = Bucket(rows[given], norm[given])
            given = given[bucket.order]
            out = [
                _best(query, scores, given[at], low, least, k + 1)
                for query, scores, at in _candidates(bucket, rows, norm, least, asked)
            ]
            query, found, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [[]] * 3
            if not len(query):
                continue
            score = [max(-_LIMIT, min(_LIMIT, int(x))) for x in score]
            yield pa.RecordBatch.from_pydict({
                "query": node[query], "node": node[found], "low": low[found],
                "score": pa.array(score, pa.int64()),
            })

    return read


def _candidates(bucket: Bucket, rows, norm, least, asked):
    """(query, scores, positions in the bucket) of all that may reach its least score."""
    longest = norm[asked] * bucket.longest
    local = np.where(longest > 0, np.maximum(least[asked], 0) / np.maximum(longest, 1e-300), 0)
    local *= 1 - _SLACK
    narrow = (local >= _COORDINATE_COSINE) & (local <= 1)
    for query, cosine in zip(asked[narrow], local[narrow], strict=True):
        at = bucket.by_coordinates(rows[query], norm[query], cosine)
        if len(at):
            yield query, _products(rows[query][None, :], bucket.vectors[at])[0], at
    wide = asked[local < _COORDINATE_COSINE]
    for part in np.array_split(wide, len(wide) // 256 + 1):
        reach = [bucket.by_length(least[q], norm[q]) for q in part]
        if len(part) and max(reach):
            products = _products(rows[part], bucket.vectors[: max(reach)])
            for query, scores, n in zip(part, products, reach, strict=True):
                if n:
                    yield query, scores[:n], np.arange(n)


def _best(query, scores, at, low, least, k):
    """The k best candidates that reach the least score, ties to smaller ids."""
    some = np.flatnonzero(scores >= least[query])
    if len(some) > k:
        edge = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= edge]
    some = some[np.lexsort((low[at[some]], -scores[some]))][:k]
    return np.full(len(some), query), at[some], scores[some]


_TILE = {
    "width": "int", "bucket": "long", "block": "long", "side": "int", "node": "long",
    "norm": "double", "least": "double", "low": "long", "vector": "binary",
}


def _found(asked: DataFrame, given: DataFrame, k: int) -> DataFrame:
    """The best of each query in each tile (width, bucket, block): query, node, low, score."""
    both = asked.withColumn("side", F.lit(0)).select(*_TILE).unionAll(
        given.withColumns({"side": F.lit(1), "least": F.lit(0.0)}).select(*_TILE)
    )
    keys = ["width", "bucket", "block"]
    return both.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        _search(k), "query long, node long, low long, score long"
    )


def _leading(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "low", "node")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def _split(level: str, among: Column) -> Column:
    """One number for a level and one of the parts that hash deals its rows to."""
    return F.col(level).cast("long") * (1 << 32) + F.pmod(F.xxhash64("node"), among)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
) -> DataFrame:
    """The ``k`` rows of highest inner product with each row that ``is_query`` marks.

    Components are scaled and floored to whole numbers, so products are exact; those
    beyond 64 bits count as the nearest long.  Returns ``query_id``, ``rank`` (from 1),
    ``vec_id`` and ``score``, ties to the smaller id, null ids last; a query has fewer
    rows if the table has.

    Equal vectors are one node with its ``k + 1`` smallest ids: no other of its rows
    can be among the best.  Nodes are grouped into levels of like norm, each dealt to
    buckets of bounded size.  A first look at the longest vectors gives each query a
    score it will reach; levels too short for it are skipped, queries that skip the same
    levels share blocks, and each block meets each bucket it needs in one task.  There
    the least score, divided by both norms, is the local cosine.  Where it is high, the
    query's largest coordinates bound those of its matches (coordinate pruning); where
    it is low, vectors are taken longest first as long as their norm allows (length
    pruning).  What is left is multiplied out.

    Vectors that are null or hold null or non-finite parts take no part; those of other
    length than the query are not compared with it; without parts, or all zeros, the
    score is 0.  A repeated row is a row of its own: with an id that is a query, each
    copy asks, and finds the others.  Null ids are no queries unless ``is_query`` says
    so.  An empty table gives no rows.  Other columns are not read.
    """
    given = vectors.where(usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(vector_col).alias("vector"),
    )
    scaled = given.mapInArrow(
        _scaled(scale),
        "id long, is_query boolean, width int, norm double, level int, vector binary",
    )
    rows = stage(with_key(scaled, "width", "vector"), "scaled")
    smallest = Window.partitionBy(*KEY).orderBy(F.asc_nulls_last("id"))
    first = rows.withColumn("_r", F.row_number().over(smallest)).where(F.col("_r") <= k + 1)
    copies = stage(
        first.groupBy(*KEY).agg(
            F.sort_array(F.collect_list(F.coalesce("id", F.lit(_NO_ID)))).alias("ids")
        ).withColumn("node", F.monotonically_increasing_id()),
        "copies",
    )
    asking = rows.where("is_query").select("id", *KEY)
    nodes = stage(
        first.where("_r = 1").select(*KEY, "width", "norm", "level", "vector")
        .join(copies.select(*KEY, "node", F.element_at("ids", 1).alias("low")), KEY)
        .join(asking.groupBy(*KEY).agg(F.lit(True).alias("asks")), KEY, "left").drop(*KEY),
        "nodes",
    )
    floor = _floors(nodes, k)
    order = ["width", "level"]
    asked = stage(
        nodes.where("asks").join(floor.withColumnRenamed("query", "node"), "node", "left")
        .withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        .withColumn("level", _reach(F.col("least"), F.col("norm"))),
        "queries",
    )
    blocks = asked.groupBy(*order).agg(F.ceil(F.count("*") / _BLOCK).alias("blocks"))
    buckets = nodes.groupBy(*order).agg(F.ceil(F.count("*") / _BUCKET).alias("buckets"))
    pairs = stage(
        blocks.withColumnRenamed("level", "least_level")
        .join(buckets, "width").where("level >= least_level"), "pairs",
    )
    of_bucket = pairs.groupBy(*order).agg(
        F.first("buckets").alias("buckets"), F.collect_list(F.struct("least_level", "blocks")).alias("needs"),
    )
    of_block = pairs.groupBy("width", "least_level").agg(
        F.first("blocks").alias("blocks"), F.collect_list(F.struct("level", "buckets")).alias("needs"),
    ).withColumnRenamed("least_level", "level")
    found = _found(
        _dealt(asked, of_block, "block", "blocks", "bucket", "level", "buckets"),
        _dealt(nodes, of_bucket, "bucket", "buckets", "block", "least_level", "blocks"), k,
    )
    best = _leading(stage(found, "found"), k + 1)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "node")
    lists = (
        best.join(copies.select("node", "ids"), "node")
        .select("query", "score", "node", F.explode("ids").alias("id"))
        .withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
        .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("at", "node", "id", "score"))).alias("list"))
    )
    named = asking.join(copies.select(*KEY, F.col("node").alias("query")), KEY).select("query", "id")
    return named.join(lists, "query").withColumn("list", _without_own()).select(
        F.col("id").alias("query_id"), F.posexplode(F.slice("list", 1, k)).alias("rank", "best"),
    ).select(
        "query_id", (F.col("rank") + 1).alias("rank"),
        F.when(F.col("best.id") != _NO_ID, F.col("best.id")).alias("vec_id"), "best.score",
    )


def _without_own() -> Column:
    """The list of a query without one entry of its own id and node."""
    own = F.coalesce("id", F.lit(_NO_ID))
    places = F.transform("list", lambda x, i: F.when((x["node"] == F.col("query")) & (x["id"] == own), i))
    place = F.array_min(F.filter(places, lambda i: i.isNotNull()))
    return F.filter("list", lambda x, i: place.isNull() | (i != place))


def _reach(least: Column, norm: Column) -> Column:
    """The lowest level whose vectors may reach a score with a query."""
    short = F.greatest(least / norm * (1 - _SLACK), F.lit(1.0))
    return F.when((least > 0) & (norm > 0), F.floor(F.log(short) / np.log(LEVEL) - _SLACK)).otherwise(
        F.lit(0)
    ).cast("int")


def _dealt(side, needs, own, parts, other, level, other_parts) -> DataFrame:
    """Each row once for every tile it meets: its own part of its level, all parts of the other."""
    met = F.explode("needs").alias("need")
    dealt = join_small(side, needs, ["width", "level"], "inner").select(
        "*", _split("level", F.col(parts)).alias(own), met
    )
    every = F.explode(F.sequence(F.lit(0), F.col(f"need.{other_parts}") - 1)).alias("part")
    return dealt.select("*", every).withColumn(
        other, F.col(f"need.{level}").cast("long") * (1 << 32) + F.col("part")
    )


def _floors(nodes: DataFrame, k: int) -> DataFrame:
    """A score that each query reaches with k + 1 of the longest vectors: (query, least)."""
    sizes = nodes.groupBy("width", "level").agg(F.count("*").alias("n"))
    above = Window.partitionBy("width").orderBy(F.desc("level")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    seeding = stage(
        sizes.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
        .where(F.col("above") < _SEEDS)
        .select("width", "level", F.ceil(F.col("n") / _SEEDS).alias("share")), "seeds",
    )
    blocks = stage(
        nodes.where("asks").groupBy("width").agg(F.ceil(F.count("*") / _BLOCK).alias("blocks")), "blocks"
    )
    hashed = F.xxhash64(F.lit(1), "node")
    asked = join_small(nodes.where("asks"), blocks, "width", "inner").withColumns({
        "bucket": F.lit(0).cast("long"), "block": F.pmod(hashed, F.col("blocks")),
        "least": F.lit(float("-inf")),
    })
    given = (
        join_small(join_small(nodes, seeding, ["width", "level"], "inner"), blocks, "width", "inner")
        .where(F.pmod(hashed, F.col("share")) == 0)
        .withColumn("bucket", F.lit(0).cast("long"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    )
    score = F.min("score").cast("double")
    return _leading(_found(asked, given, k), k + 1).groupBy("query").agg(
        (score - F.abs(score) * F.lit(1e-12)).alias("least"), F.count("*").alias("_n")
    ).where(F.col("_n") > k).drop("_n")
