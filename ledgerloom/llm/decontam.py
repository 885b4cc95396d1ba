"""Find benchmark passages in a corpus with a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import text as T
from ledgerloom.llm.tables import KEY, aside, join_small, known_bytes, row_key
from ledgerloom.session import stage

#: Up to this many test terms are handed to the tasks, 8 bytes each, to drop other
#: terms at the source; beyond it, a join drops them.
_HANDED_TERMS = 1 << 20
#: The words of texts in either case.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _windows_of(n: int):
    """Benchmark texts to windows: (item, window, length, offset, term)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                hashes, _, _, offsets = T.words(*T.raw(part.column("text")), T.ALNUM)
                count = np.diff(offsets)
                grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
                length = np.minimum(count, n)
                owner = np.repeat(np.arange(len(count)), grams)
                first = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams)
                size = length[owner]
                row = np.repeat(np.arange(len(owner)), size)
                at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                whole, _ = T.ngrams(hashes, offsets, n)
                yield pa.RecordBatch.from_pydict({
                    "item": part.column("item").take(pa.array(owner[row])),
                    "window": _signed(whole[row]),
                    "length": pa.array(size[row], pa.int32()),
                    "offset": pa.array(at, pa.int32()),
                    "term": _signed(hashes[offsets[owner[row]] + first[row] + at]),
                })

    return read


def _terms_of(handed: np.ndarray | None):
    """Corpus texts to (term, n): how often each test term occurs, summed by slice."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                hashes = T.words(*T.raw(part.column("text")), T.ALNUM)[0].view(np.int64)
                if handed is not None:
                    hashes = hashes[_among(hashes, handed)]
                terms, counts = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_pydict({"term": terms, "n": counts})

    return read


def _postings_of(handed: np.ndarray | None, rarest: np.ndarray | None, reach: int):
    """Corpus texts to postings (key, term, position, context).

    The context, for the rarest terms of windows only, holds the hashes of the words
    up to ``reach`` - 1 away on both sides, with zeros beyond the text, so that a
    phrase can be confirmed in full.
    """
    around = np.arange(1 - reach, reach)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                hashes, _, _, offsets = T.words(*T.raw(part.column("text")), T.ALNUM)
                signed = hashes.view(np.int64)
                kept = np.arange(len(hashes))
                if handed is not None:
                    kept = np.flatnonzero(_among(signed, handed))
                for kept in np.array_split(kept, len(kept) // 100_000 + 1):
                    owner = np.searchsorted(offsets, kept, side="right") - 1
                    near = kept[:, None] + around
                    known = (near >= offsets[owner, None]) & (near < offsets[owner + 1, None])
                    near = np.where(known, hashes[np.where(known, near, 0)] if len(hashes) else 0, 0)
                    width = 8 * len(around)
                    blob = pa.Array.from_buffers(
                        pa.binary(), len(kept),
                        [None, pa.py_buffer(np.arange(len(kept) + 1, dtype=np.int32) * width),
                         pa.py_buffer(near.astype("<u8").tobytes())],
                    )
                    if rarest is not None:
                        first = _among(signed[kept], rarest)
                        at = pa.array(np.arange(len(kept)), mask=~first)
                        blob = blob.take(at)
                    rows = pa.array(owner)
                    yield pa.RecordBatch.from_pydict({
                        **{k: part.column(k).take(rows) for k in KEY},
                        "term": signed[kept],
                        "position": pa.array(kept - offsets[owner], pa.int32()),
                        "context": blob,
                    })

    return read


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _confirmed(reach: int):
    """Keep the candidates whose words are the window's, hash by hash."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = np.frombuffer(
                b"".join(batch.column("context").to_pylist()), "<u8"
            ).reshape(batch.num_rows, 2 * reach - 1)
            length = batch.column("length").to_numpy()
            first = reach - 1 - batch.column("offset").to_numpy().astype(np.int64)
            window = batch.column("window").to_numpy().view(np.uint64)
            same = np.zeros(batch.num_rows, bool)
            for size in np.unique(length):
                of = np.flatnonzero(length == size)
                flat = words[of[:, None], first[of, None] + np.arange(size)].reshape(-1)
                found = T.run_hashes(flat, np.arange(len(of)) * size, int(size))
                same[of] = found == window[of]
            yield batch.filter(pa.array(same)).select([*KEY, "window", "length", "start"])

    return read


def _handed(spark: SparkSession, terms: DataFrame):
    """The test terms for the tasks, if there are few enough; else None."""
    if known_bytes(terms) > 16 * _HANDED_TERMS or terms.count() > _HANDED_TERMS:
        return None
    return np.sort(np.array([r[0] for r in terms.collect()], np.int64))


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    slop: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Exact and near occurrences of benchmark windows in a corpus.

    A window is a run of ``n`` item words (an item of fewer is one window).  Of each
    window, the two terms rarest in the corpus are indexed: postings name the text,
    the term and its position, and for the rarest also the words around.  The lists
    are shifted by the terms' offsets in the window and intersected.  Where they
    agree exactly, the words around confirm the phrase; where they agree within
    ``slop`` words without being a phrase, it is a proximity match.

    Returns ``(exact, near)`` with the key of the text, ``window`` and ``start`` (in
    words); ``exact`` also has ``length`` and ``item``, once for each item.  Null and empty texts and items
    have no words; equal windows and repeated rows count once.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    kind = items.schema["item"].dataType.simpleString()
    words = stage(
        items.mapInArrow(
            _windows_of(n), f"item {kind}, window long, length int, offset int, term long"
        ),
        "windows",
    )
    vocabulary = stage(words.select("term").distinct(), "vocabulary")
    handed = _handed(spark, vocabulary)
    corpus = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    counted = corpus.select("text").mapInArrow(_terms_of(handed), "term long, n long")
    if handed is None:
        counted = counted.join(vocabulary, "term", "left_semi")
    frequency = stage(counted.groupBy("term").agg(F.sum("n").alias("n")), "frequency")

    # Windows with a term that the corpus lacks cannot occur.
    rarity = Window.partitionBy("window").orderBy("n", "term", "offset")
    ranked = stage(
        words.drop("item").distinct()
        .join(frequency, "term", "left")
        .withColumn("_unknown", F.max(F.col("n").isNull()).over(Window.partitionBy("window")))
        .where(~F.col("_unknown"))
        .withColumn("rank", F.row_number().over(rarity))
        .where("rank <= 2")
        .select("window", "length", "offset", "term", "rank"),
        "rarest",
    )
    chosen = stage(
        ranked.groupBy("term").agg((F.min("rank") == 1).alias("rarest")), "terms"
    )
    listed = _handed(spark, chosen.select("term"))
    rarest = _handed(spark, chosen.where("rarest").select("term"))
    posted = corpus.mapInArrow(
        _postings_of(listed, rarest, n),
        f"{', '.join(f'{k} long' for k in KEY)}, term long, position int, context binary",
    )
    if listed is None:
        posted = posted.join(chosen.select("term"), "term", "left_semi")
    index = stage(posted, "postings")

    # Bins wide next to the slop, so that few starts need a second one.
    width = 16 * (slop + 1)
    start = (F.col("position") - F.col("offset")).alias("start")
    first = join_small(
        index.select(*KEY, "term", "position"), ranked.where("rank = 1"), "term", "inner"
    ).select(*KEY, "window", start).where("start >= 0").distinct()
    second = join_small(
        index.select(*KEY, "term", "position"), ranked.where("rank = 2"), "term", "inner"
    ).select(*KEY, "window", start).withColumnRenamed("start", "_other").distinct()
    bins = F.array_distinct(F.array(
        *(F.floor((F.col("start") + side) / width) for side in (-slop, slop))
    ))
    met = stage(
        first.withColumn("_bin", F.explode(bins))
        .join(second.withColumn("_bin", F.floor(F.col("_other") / width)), [*KEY, "window", "_bin"])
        .where(F.abs(F.col("start") - F.col("_other")) <= slop)
        .groupBy(*KEY, "window", "start")
        .agg(F.bool_or(F.col("start") == F.col("_other")).alias("aligned")),
        "met",
    )
    # A window of one word has one list.
    alone = ranked.groupBy("window").agg(F.max("rank").alias("_lists")).where("_lists = 1")
    aligned = met.where("aligned").drop("aligned").union(
        join_small(first, stage(alone.select("window"), "alone"), "window", "left_semi")
        .select(*KEY, "window", "start")
    )
    aligned = stage(aligned, "aligned")
    placed = join_small(
        index.where("context is not null"), ranked.where("rank = 1"), "term", "inner"
    ).select(*KEY, "window", "length", "offset", "context", start)
    exact = stage(
        join_small(placed, aligned, [*KEY, "window", "start"], "inner")
        .mapInArrow(
            _confirmed(n), f"{', '.join(f'{k} long' for k in KEY)}, window long, length int, start int"
        )
        .distinct(),
        "exact",
    )
    near = met.select(*KEY, "window", "start").join(
        exact.select(*KEY, "window", "start"), [*KEY, "window", "start"], "left_anti"
    )
    owners = stage(words.select("window", "item").distinct(), "owners")
    return join_small(exact, owners, "window", "inner"), near


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Add what the benchmark covers of each text.

    ``n_words``; ``n_hit`` words inside an occurrence of a window; ``items``, the
    sorted ids, as strings, of the items with one; ``n_near`` proximity matches;
    ``contaminated``.  Texts without words, null ones included, are clean; rows
    alike in id and text have the same result; an empty benchmark hits nothing.
    Input columns with these names are replaced.
    """
    docs, back = aside(
        docs, ["n_words", "n_hit", "items", "n_near", "contaminated"], KEY, [id_col, text_col]
    )
    exact, near = find_passages(docs, benchmark, n, id_col=id_col, text_col=text_col,
                                item_col=item_col, item_text_col=item_text_col)
    places = exact.select(*KEY, "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    # Words inside overlapping runs count once: each run adds what lies behind the
    # furthest end so far.
    so_far = Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(
        Window.unboundedPreceding, -1
    )
    fresh = F.greatest(
        F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(so_far), F.lit(0))),
        F.lit(0),
    )
    hit = places.withColumn("_fresh", fresh).groupBy(*KEY).agg(F.sum("_fresh").alias("n_hit"))
    named = exact.where("item is not null").groupBy(*KEY).agg(
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")
    )
    close = near.groupBy(*KEY).agg(F.count("*").alias("n_near"))
    result = stage(hit.join(named, KEY, "full").join(close, KEY, "full"), "hits")
    counted = F.coalesce(F.regexp_count(text_col, F.lit(_WORD)), F.lit(0)).cast("long")
    keyed = docs.select("*", *row_key(id_col, text_col), counted.alias("n_words"))
    return join_small(keyed, result, KEY).select(
        *back, "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
