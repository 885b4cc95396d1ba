"""Near-duplicate texts: banded MinHash, Bayesian pruning and exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import text as T
from ledgerloom.llm.components import components
from ledgerloom.llm.tables import KEY, given_back, join_small, row_key, runs_of
from ledgerloom.session import bound_batches, stage

#: Hashes in a band.
ROWS = 5
#: The chance at most that a pair just similar enough shares no band.
BAND_MISS = 5e-7
#: Hashes compared between two looks at the posterior.
BATCH = 25
#: Members of a bucket compared in one task; larger buckets are cut into tiles.
_TILE = 1024
#: The bits of a set's hash that make its node.
_NODE_BITS = (1 << 64) - 1
#: Added to hashes of shingles for the second hash of a set.
_SECOND = 0xD1B54A32D192ED03
_KEYS = ", ".join(f"{k} long" for k in KEY)


def bands_for(percent: int) -> int:
    """Bands that miss a pair of the threshold with ``BAND_MISS`` at most: 25 at 85, 37 at 80."""
    kept = 1 - (percent / 100) ** ROWS
    return ceil(log(BAND_MISS) / log(kept)) if kept else 1


def _seeds(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of so many hashes; those of fewer are the first of them."""
    seeds = np.random.default_rng(4).integers(0, 1 << 63, (hashes, 2), dtype=np.uint64)
    return seeds[:, 0] * np.uint64(2) + np.uint64(1), seeds[:, 1]


def least_matches(percent: int, miss: float, hashes: int) -> list[int]:
    """For each number of compared hashes, the matches below which a pair is dropped.

    With a uniform prior, the posterior chance that the similarity is at least t
    after a of m hashes agreed is the chance that a binomial of m + 1 trials of t is
    at most a.  A pair is dropped where that is below ``miss``.
    """
    t, out = percent / 100, []
    for m in range(BATCH, hashes + 1, BATCH):
        total, a = 0.0, 0
        while True:
            ways = lgamma(m + 2) - lgamma(a + 1) - lgamma(m + 2 - a)
            total += exp(ways + a * log(t) + (m + 1 - a) * log(1 - t))
            if total >= miss:
                break
            a += 1
        out.append(a)
    return out


def shingle_sets(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text, and their offsets."""
    hashes, _, _, offsets = T.words(*T.raw(column), T.BLANKS)
    return T.sorted_sets(*T.ngrams(hashes, offsets, n))


def _blobs(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    width = flat.dtype.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer((offsets * width).astype(np.int64)), pa.py_buffer(flat.tobytes())],
    ).cast(pa.binary())


def _sign(n: int, hashes: int):
    """Texts to (key, id, node, check, n_shingles, signature).

    ``check`` is a second hash of the set beside its node.
    """
    factor, shift = _seeds(hashes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given_back(batches):
            for part in T.slices(batch, "text"):
                sets, offsets = shingle_sets(part.column("text"), n)
                size = np.diff(offsets)
                some = np.flatnonzero(size)
                starts = offsets[:-1][some]
                node, check = np.zeros((2, len(size)), np.uint64)
                signed = np.zeros((len(some), hashes), "<u4")
                if len(some):
                    count = size[some].astype(np.uint64)
                    first = T.mix(np.add.reduceat(T.mix(sets), starts) + count)
                    node[some] = first & np.uint64(_NODE_BITS)
                    again = T.mix(sets + np.uint64(_SECOND))
                    check[some] = T.mix(np.add.reduceat(again, starts) ^ count)
                    for k in range(hashes):
                        value = (sets * factor[k] + shift[k]) >> np.uint64(32)
                        signed[:, k] = np.minimum.reduceat(value, starts)
                blobs = _blobs(signed.reshape(-1), np.arange(len(some) + 1) * hashes)
                at = np.full(len(size), -1)
                at[some] = np.arange(len(some))
                at = pa.array(at, mask=at < 0)
                yield pa.RecordBatch.from_pydict({
                    **{k: part.column(k) for k in [*KEY, "id"]},
                    "node": pa.array(node.view(np.int64), mask=size == 0),
                    "check": pa.array(check.view(np.int64), mask=size == 0),
                    "n_shingles": pa.array(size, pa.int64()),
                    "signature": blobs.take(at),
                })

    return read


def _sets(n: int):
    """Texts to (node, set), the set as packed 64-bit hashes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given_back(batches):
            for part in T.slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({
                    "node": part.column("node"),
                    "set": _blobs(*shingle_sets(part.column("text"), n)),
                })

    return read


def _signatures(column) -> np.ndarray:
    """One row for each signature; all are of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), -1)


def _likely(least: list[int]):
    """Keep pairs that no batch of signature hashes rules out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given_back(batches):
            if not batch.num_rows:
                continue
            a, b = _signatures(batch.column("sa")), _signatures(batch.column("sb"))
            alive, agreed = np.arange(len(a)), np.zeros(len(a), int)
            for i, need in enumerate(least):
                part = slice(i * BATCH, (i + 1) * BATCH)
                agreed = agreed + (a[alive, part] == b[alive, part]).sum(1)
                keep = agreed >= need
                alive, agreed = alive[keep], agreed[keep]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return read


def _across(least: list[int], percent: int):
    """Links between different components, tile by tile of a bucket: a forest of them.

    A pair is compared in the first band it shares only, batch by batch of the
    signature, and what is left by full sets.  Members that links found so far
    connect are not compared any more.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs_of(given_back(batches), ["bucket", "i", "j"]):
            node, root, side = (tile.column(c).to_numpy() for c in ("node", "root", "side"))
            i, j, band = (tile.column(c)[0].as_py() for c in ("i", "j", "band"))
            signature = _signatures(tile.column("signature"))
            sets = [np.frombuffer(x.as_buffer(), "<u8") for x in tile.column("set")]
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
            root, found = root.copy(), []
            for x in left:
                alive = right[(root[right] != root[x]) & ((node[right] > node[x]) if i == j else True)]
                if not len(alive):
                    continue
                same = signature[alive] == signature[x]
                shared = same.reshape(len(alive), -1, ROWS).all(2)
                keep = ~shared[:, :band].any(1)
                for at, need in enumerate(least, start=1):
                    keep &= same[:, : at * BATCH].sum(1) >= need
                alive = alive[keep]
                if not len(alive):
                    continue
                size = np.array([len(sets[y]) for y in alive])
                flat = np.concatenate([sets[y] for y in alive])
                place = np.minimum(np.searchsorted(sets[x], flat), len(sets[x]) - 1)
                both = np.add.reduceat(sets[x][place] == flat, np.cumsum(size) - size, dtype=np.int64)
                for y in alive[100 * both >= percent * (size + len(sets[x]) - both)]:
                    if root[y] != root[x]:
                        found.append((min(node[x], node[y]), max(node[x], node[y])))
                        root[root == root[y]] = root[x]
            if found:
                a, b = (np.array(c, np.int64) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return read


def _linked(percent: int):
    """Keep pairs whose full sets are similar enough."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given_back(batches):
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("xa"), batch.column("xb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return read


class _Search:
    """One search: the classes of equal sets, and how pairs of them are confirmed."""

    def __init__(self, docs: DataFrame, n: int, percent: int, miss: float, id_col: str, text_col: str):
        bound_batches(docs.sparkSession)
        self.n, self.percent, self.bands = n, percent, bands_for(percent)
        self.least = least_matches(percent, miss, self.bands * ROWS)
        self.texts = docs.select(
            *row_key(id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).alias("text")
        )
        kind = self.texts.schema["id"].dataType.simpleString()
        self.rows = stage(
            self.texts.mapInArrow(
                _sign(n, self.bands * ROWS),
                f"{_KEYS}, id {kind}, node long, check long, n_shingles long, signature binary",
            ),
            "signatures",
        )
        stands = self._stands()
        unlike = stage(stands.where("differ").select("node", "differ"), "unlike")
        if unlike.take(1):
            # Different sets under one hash: both hashes name their nodes.
            both = F.when(F.col("differ"), F.xxhash64("node", "check")).otherwise(F.col("node"))
            rows = join_small(self.rows, unlike, "node").withColumn("node", both)
            self.rows = stage(rows.drop("differ"), "signatures")
            stands = self._stands()
        known = self.rows.where("node is not null")
        self.classes = stage(
            known.join(stands.drop("differ"), ["node", *KEY])
            .select("node", *KEY, "signature").dropDuplicates(["node"]),
            "classes",
        )

    def _stands(self) -> DataFrame:
        """(node, key, differ): the row that stands for all of equal sets."""
        return stage(
            self.rows.where("node is not null").groupBy("node")
            .agg(F.min(F.struct(*KEY)).alias("_k"), F.min("check").alias("_l"), F.max("check").alias("_h"))
            .select("node", *(F.col(f"_k.{k}").alias(k) for k in KEY), F.expr("_l <> _h").alias("differ")),
            "stands",
        )

    def buckets(self) -> DataFrame:
        """(bucket, band, node, center, members) of all buckets with several nodes."""
        band = F.explode(F.sequence(F.lit(0), F.lit(self.bands - 1)))
        width = 4 * ROWS
        piece = F.substring(F.col("signature"), F.col("band") * width + 1, F.lit(width))
        members = self.classes.select("node", "signature", band.alias("band")).select(
            F.xxhash64("band", piece).alias("bucket"), "band", "node"
        )
        shared = members.groupBy("bucket").agg(
            F.min("node").alias("center"), F.max("node").alias("_last"),
            F.count("*").alias("members"),
        ).where("center < _last").drop("_last")
        return stage(members.join(shared, "bucket"), "buckets")

    def likely(self, pairs: DataFrame) -> DataFrame:
        signed = self.classes.select("node", "signature")
        return (
            pairs.join(signed.toDF("a", "sa"), "a").join(signed.toDF("b", "sb"), "b")
            .mapInArrow(_likely(self.least), "a long, b long")
        )

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, set) of the given nodes."""
        needed = stage(
            self.classes.join(nodes.distinct(), "node", "left_semi").drop("signature"), "needed"
        )
        texts = join_small(self.texts.drop("id"), needed, KEY, "inner").select("node", "text")
        sets = stage(texts.mapInArrow(_sets(self.n), "node long, set binary"), "sets")
        # Repeated rows have one key; any of them will do.
        return sets.dropDuplicates(["node"]) if self._repeats(needed, sets) else sets

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs that full sets confirm."""
        pairs = stage(pairs, "likely")
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        return stage(
            pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
            .mapInArrow(_linked(self.percent), "a long, b long"),
            "links",
        )

    @staticmethod
    def _repeats(needed: DataFrame, sets: DataFrame) -> bool:
        return needed.count() < sets.count()


def _with_roots(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not yet in one component."""
    a, b = labels.toDF("a", "ra"), labels.toDF("b", "rb")
    return (
        join_small(join_small(pairs, a, "a"), b, "b")
        .where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
        .select("a", "b")
    )


def _tiles(open_rows: DataFrame) -> DataFrame:
    """(bucket, i, j, side, band, node, root): members beside those they may link to.

    Members outside a bucket's largest component meet one another and that component,
    whose members do not meet: a few outsiders cost a few copies of the bucket.
    """
    parts = open_rows.groupBy("bucket", "root").agg(F.count("*").alias("_n"))
    largest = stage(
        parts.groupBy("bucket").agg(F.max(F.struct("_n", "root")).alias("_m"), F.sum("_n").alias("_all"))
        .select(
            "bucket", F.col("_m.root").alias("_main"),
            F.ceil(F.col("_m._n") / _TILE).cast("int").alias("_inside"),
            F.ceil((F.col("_all") - F.col("_m._n")) / _TILE).cast("int").alias("_outside"),
        ),
        "largest",
    )
    is_main, hashed = F.col("root") == F.col("_main"), F.xxhash64("node")
    inside, outside = F.col("_inside"), F.col("_outside")
    side = F.when(is_main, outside + F.pmod(hashed, inside)).otherwise(F.pmod(hashed, outside))
    last = F.when(is_main, outside - 1).otherwise(outside + inside - 1)
    return (
        join_small(open_rows, largest, "bucket", "inner")
        .withColumn("side", side.cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
        .select("bucket", F.least("side", "_other").alias("i"), F.greatest("side", "_other").alias("j"),
                "side", "band", "node", "root")
    )


def groups(
    docs: DataFrame,
    n: int = 5,
    percent: int = 85,
    miss: float = 1e-6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The groups of ``near_duplicates`` by a name that ids have no part in.

    Returns one row for each input row: its key, ``id``, ``node``, ``n_shingles`` and
    ``root``, which the rows of a group share and which is null without shingles.
    """
    search = _Search(docs, n, percent, miss, id_col, text_col)
    buckets = search.buckets()
    stars = (
        buckets.where("node <> center")
        .groupBy(F.col("center").alias("a"), F.col("node").alias("b"))
        .agg(F.count("*").alias("bands"))
    )
    best = F.max(F.struct("bands", "a")).alias("_m")
    stars = stage(stars, "stars")
    first = stars.groupBy("b").agg(best).select(F.col("_m.a").alias("a"), "b")
    links = search.linked(search.likely(first))
    labels = components(links)
    rest = search.likely(_with_roots(stars.select("a", "b"), labels))
    links = stage(links.union(search.linked(rest)), "links")
    labels = components(links)

    # Two nodes of a bucket were compared above: its centre and the other.
    rooted = join_small(buckets.where("members > 2"), labels, "node").withColumn(
        "root", F.coalesce("root", "node")
    )
    split = (
        rooted.groupBy("bucket").agg(F.min("root").alias("_l"), F.max("root").alias("_h"))
        .where("_l < _h").select("bucket")
    )
    open_rows = stage(rooted.join(split, "bucket").select("bucket", "band", "node", "root"), "open")
    if open_rows.take(1):
        full = search.classes.select("node", "signature").join(
            search.sets(open_rows.select("node")), "node"
        )
        across = (
            _tiles(open_rows).join(full, "node")
            .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
            .mapInArrow(_across(search.least, percent), "a long, b long")
        )
        links = stage(links.union(across), "links")
        labels = components(links)

    return join_small(search.rows.drop("check", "signature"), labels, "node").withColumn(
        "root", F.coalesce("root", "node")
    )


def near_duplicates(
    docs: DataFrame,
    n: int = 5,
    percent: int = 85,
    miss: float = 1e-6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Group texts whose sets of word n-grams have a Jaccard similarity of ``percent``.

    Returns one row for each input row: its key, the id, ``n_shingles``,
    ``component_id`` (the smallest id of its group) and ``kept``.

    Texts with equal sets are one node.  Nodes meet in buckets of banded MinHash
    signatures.  In each bucket, every node is compared with one centre, so a bucket
    gives one pair a node, not all pairs.  Pairs that batches of the signature make
    improbable (posterior below ``miss``) are dropped; full sets confirm the rest.
    Then only buckets whose nodes are still in several components are searched
    between the components, tile by tile and with the same two tests, and give a
    forest of links, never pairs; members of a bucket's largest component meet only
    those outside it.  Nothing is capped.  Each node first tries the centre
    it shares most bands with; pairs that are by then connected need no more proof.
    The number of bands follows ``percent``, so that the chance of a missed pair is as
    small at each (``BAND_MISS`` and ``miss``).

    Texts without words, null ones included, have no shingles and link with nothing;
    each is kept as its own group.  Rows with a null id group like others, but never
    name a group; if a group has no other ids, its ``component_id`` is null and all
    its rows are kept.  Rows that repeat an id and text share their fate.  An empty
    table gives no rows.  Sets are told apart by two 64-bit hashes.
    """
    named = groups(docs, n, percent, miss, id_col, text_col)
    smallest = named.where("root is not null").groupBy("root").agg(F.min("id").alias("_least"))
    smallest = stage(smallest, "smallest")
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("_least"))
    return join_small(named, smallest, "root").select(
        *KEY, F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
