"""Remove byte strings that occur more than once in a corpus.

README says why this goes by content-chosen anchors and not by merged
Burrows-Wheeler transforms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import text as T
from ledgerloom.llm.tables import KEY, aside, join_small, row_key, runs_of
from ledgerloom.session import stage

#: Bytes of the gram that stands for a window.
GRAM = 64
#: Window starts worked on at once.
_SEGMENT = 1 << 21
#: Bytes of texts worked on at once; a byte takes some 200 while it is.
_SLICE_BYTES = 1 << 18
#: Rows of families compared at once; a family with more meets in no task.
_FAMILY_ROWS = 4000
#: Bits of a position inside a segment; the rest orders grams by hash.
_PLACE_BITS = 24
_KEYS = ", ".join(f"{k} long" for k in KEY)
_U = np.uint64


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, from running minima of blocks."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(_U).max, _U)
    padded[: len(values)] = values
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of windows with the same anchor: (text, gram, context, start, windows, at).

    The anchor of a window of ``length`` bytes is its gram of least hash, the first
    of equals: a matter of the window's bytes alone, so equal windows agree in it
    and in where it lies.  ``context`` hashes all bytes of the run's windows and
    the anchor's place among them; ``at`` is that place.
    """
    out = []
    values = T.BYTE[data]
    for begin in range(0, max(1, len(data) - length + 1), _SEGMENT):
        piece = values[begin : begin + _SEGMENT + length - 1]
        if len(piece) < length:
            break
        first = np.arange(len(piece) - GRAM + 1)
        grams = T.span_hashes(piece, first, first + GRAM)
        ordered = (grams & ~_U((1 << _PLACE_BITS) - 1)) | first.astype(_U)
        least = _sliding_min(ordered, length - GRAM + 1) & _U((1 << _PLACE_BITS) - 1)
        window = np.arange(len(least)) + begin
        owner = np.searchsorted(offsets, window, side="right") - 1
        inside = window + length <= offsets[owner + 1]
        window, owner, anchor = window[inside], owner[inside], least[inside].astype(np.int64)
        new = np.ones(len(window), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(new)
        count = np.diff(np.append(heads, len(window)))
        start, owner, anchor = window[heads], owner[heads], anchor[heads]
        at = anchor + begin - start
        context = T.span_hashes(piece, start - begin, start - begin + count + length - 1)
        context = T.mix(context ^ at.astype(_U))
        out.append((owner, grams[anchor], context, start - offsets[owner], count, at))
    if not out:
        return [np.zeros(0, np.int64)] * 6
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _occurrences(length: int):
    """Texts to runs of windows, one row for each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", _SLICE_BYTES):
                owner, gram, context, start, count, at = _anchors(*T.raw(part.column("text")), length)
                rows = pa.array(owner)
                yield pa.RecordBatch.from_pydict({
                    **{k: part.column(k).take(rows) for k in KEY},
                    "gram": gram.view(np.int64), "context": context.view(np.int64),
                    "start": pa.array(start, pa.int32()), "windows": pa.array(count, pa.int32()),
                    "at": pa.array(at, pa.int32()),
                })

    return read


def _families(length: int, names_only: bool = False):
    """Texts with wanted runs to the bytes of their windows, by what is next to the anchor.

    A window has at least ``half`` bytes on one side of its anchor.  Windows with
    as many on the left go by those bytes, the others by as many on the right, so
    that only runs that agree around the anchor meet.  ``names_only`` gives each
    row's family alone.
    """
    half = (length - GRAM) // 2

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", _SLICE_BYTES):
                data, offsets = T.raw(part.column("text"))
                runs = part.column("runs")
                per = runs.value_lengths().to_numpy(zero_copy_only=False)
                run = runs.flatten()
                owner = np.repeat(np.arange(part.num_rows), per)
                gram, start, windows, at = (
                    run.field(c).to_numpy(zero_copy_only=False)
                    for c in ("gram", "start", "windows", "at")
                )
                begin = offsets[owner] + start
                anchor = begin + at
                left = np.minimum(windows, at - half + 1)
                for low, high, side in ((0 * at, left, anchor - half),
                                        (np.maximum(left, 0), windows, anchor + GRAM)):
                    some = np.flatnonzero(high > low)
                    if not len(some):
                        continue
                    near = T.span_hashes(T.BYTE[data], side[some], side[some] + half)
                    family = T.mix(near ^ gram[some].astype(np.int64).view(_U)).view(np.int64)
                    if names_only:
                        yield pa.RecordBatch.from_pydict({"family": family})
                        continue
                    rows = pa.array(owner[some])
                    blobs = [
                        data[a:b].tobytes()
                        for a, b in zip(begin[some] + low[some],
                                        begin[some] + high[some] + length - 1, strict=True)
                    ]
                    yield pa.RecordBatch.from_pydict({
                        "family": family,
                        **{k: part.column(k).take(rows) for k in KEY},
                        "start": pa.array(start[some] + low[some], pa.int32()),
                        "bytes": pa.array(blobs, pa.binary()),
                    })

    return read


def _windows(column, length: int):
    """Run, place in the run and hash of each window of the given runs."""
    data, offsets = T.raw(column)
    count = np.diff(offsets) - length + 1
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[owner] + place
    return owner, place, T.span_hashes(T.BYTE[data], at, at + length)


def _window_rows(length: int):
    """Runs of families to their windows, one row for each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "bytes", _SLICE_BYTES):
                owner, place, hashes = _windows(part.column("bytes"), length)
                rows = pa.array(owner)
                start = part.column("start").take(rows)
                yield pa.RecordBatch.from_pydict({
                    **{k: part.column(k).take(rows) for k in ("family", *KEY)},
                    "window": hashes.view(np.int64), "start": start,
                    "low": pa.array(start.to_numpy() + place, pa.int32()),
                })

    return read


def _repeated(length: int):
    """Families of runs to the byte runs that windows with equals cover."""

    def cover(table: pa.Table) -> pa.RecordBatch:
        owner, place, hashes = _windows(
            table.column("bytes").combine_chunks().cast(pa.large_binary()), length
        )
        hashes = T.mix(hashes ^ table.column("family").to_numpy().view(_U)[owner])
        _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(times[which] > 1)
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
        first = hit[new]
        last = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1] if len(hit) else first
        begin = table.column("start").to_numpy()[owner[first]]
        rows = pa.array(owner[first])
        return pa.RecordBatch.from_pydict({
            **{k: table.column(k).combine_chunks().take(rows) for k in KEY},
            "low": pa.array(begin + place[first], pa.int32()),
            "high": pa.array(begin + place[last] + length, pa.int32()),
        })

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole families, several at a time.
        held, size = [], 0
        for family in runs_of(batches, ["family"]):
            if family.num_rows < 2:
                continue
            if held and size + family.num_rows > _FAMILY_ROWS:
                yield cover(pa.concat_tables(held))
                held, size = [], 0
            held.append(family)
            size += family.num_rows
        if held:
            yield cover(pa.concat_tables(held))

    return read


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching runs of each text to maximal ones."""
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = batch.column("runs")
        per = runs.value_lengths().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(batch.num_rows), per)
        low, high = (runs.flatten().field(c).to_numpy().astype(np.int64) for c in ("low", "high"))
        order = np.lexsort((low, owner))
        low, high = low[order], high[order]
        # Texts are laid out one behind the other, apart, so one pass serves all.
        shift = owner * (1 << 33)
        reach = np.maximum.accumulate(high + shift)
        new = np.ones(len(low), bool)
        new[1:] = low[1:] + shift[1:] > reach[:-1]
        heads = np.flatnonzero(new)
        ends = reach[np.append(heads[1:], len(low)) - 1] - shift[heads]
        counts = np.bincount(owner[heads], minlength=batch.num_rows)
        pairs = pa.StructArray.from_arrays(
            [pa.array(low[heads], pa.int32()), pa.array(ends, pa.int32())], ["low", "high"]
        )
        bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        yield pa.RecordBatch.from_pydict({
            **{k: batch.column(k) for k in KEY},
            "runs": pa.ListArray.from_arrays(bounds, pairs),
        })


def _kept(content: Column, runs: Column) -> Column:
    """What lies between the removed runs."""
    n = F.octet_length(content)
    begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["high"]))
    ends = F.concat(F.transform(runs, lambda r: r["low"]), F.array(n))
    gaps = F.arrays_zip(begins.alias("a"), ends.alias("b"))
    return F.aggregate(
        gaps, F.lit(bytearray()),
        lambda kept, g: F.concat(kept, F.substring(content, g["a"] + 1, g["b"] - g["a"])),
    )


def remove_repeats(
    docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Remove every byte that a repeated string of ``length`` bytes covers.

    Adds ``n_bytes``; ``removed``, the maximal removed runs as (low, high) byte
    offsets, end exclusive; ``n_removed``; and ``kept``, the remaining bytes.

    Texts that occur twice are covered whole if long enough, and one of each stands
    for all from there on.  Every window of ``length`` bytes has an anchor, the gram
    of least hash in it, so equal windows share an anchor; runs of windows with the
    same anchor are one row, about one in sixty bytes.  Anchors that occur once are
    done with.  Runs whose bytes are all equal are repeated as wholes; map-side
    counts find them, so a passage that a third of all texts shares is no hot group.
    Of runs that share an anchor but differ, one of each kind is read again and its
    windows compared by 128 bits of hash (family and window).  A family of more than
    ``_FAMILY_ROWS`` runs, as at the edges of a passage in many texts, never meets in
    one task: its windows are rows, which map-side counts and a join compare.

    Null texts are empty.  Texts shorter than ``length`` lose nothing.  Repeated
    rows repeat each other's text.  An empty table gives no rows.  Input columns with
    the names of results are replaced.
    """
    docs, back = aside(
        docs, ["n_bytes", "removed", "n_removed", "kept"], [*KEY, "_runs", "_all"], [id_col, text_col]
    )
    keyed = docs.select("*", *row_key(text_col))
    long_enough = F.octet_length(text_col) >= length
    texts = keyed.where(long_enough).select(*KEY, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    copied = stage(
        texts.groupBy(*KEY).agg(F.count("*").alias("_n"), F.min("id").alias("_least"))
        .where("_n > 1"),
        "copied",
    )
    # Rows that repeat both id and text pass together: harmless, as both are covered.
    single = (
        join_small(texts, copied, KEY)
        .where("_n is null or id <=> _least").select(*KEY, "text")
    )
    runs = stage(
        single.mapInArrow(
            _occurrences(length),
            f"{_KEYS}, gram long, context long, start int, windows int, at int",
        ),
        "runs",
    )
    classes = (
        runs.groupBy("gram")
        .agg(F.count("*").alias("_n"), F.min("context").alias("_lo"), F.max("context").alias("_hi"))
        .where("_n > 1").select("gram", (F.col("_lo") != F.col("_hi")).alias("mixed"))
    )
    shared = stage(runs.join(classes, "gram"), "shared")
    mixed = shared.where("mixed").drop("mixed")
    place = F.struct(*KEY, "start", "windows", "at")
    kinds = stage(
        mixed.groupBy("gram", "context").agg(F.count("*").alias("_n"), F.min(place).alias("_p")),
        "kinds",
    )
    alike = kinds.where("_n > 1").select("gram", "context")
    whole = shared.where("not mixed").drop("mixed").unionByName(
        mixed.join(alike, ["gram", "context"], "left_semi")
    )
    covered = whole.select(
        *KEY, F.col("start").alias("low"),
        (F.col("start") + F.col("windows") + length - 1).alias("high"),
    )

    def read_again(kinds: DataFrame) -> DataFrame:
        wanted = stage(
            kinds.select(*(F.col(f"_p.{c}").alias(c) for c in (*KEY, "start", "windows", "at")), "gram")
            .groupBy(*KEY).agg(F.collect_list(F.struct("gram", "start", "windows", "at")).alias("runs")),
            "wanted",
        )
        named = stage(wanted.select(*KEY), "named")
        return join_small(single, named, KEY, "left_semi").join(wanted, KEY)

    family_rows = f"family long, {_KEYS}, start int, bytes binary"
    again = read_again(kinds)
    families = again.mapInArrow(_families(length), family_rows)
    # A kind has at most two rows in a family, so few grams can have a large one.
    crowded = stage(
        kinds.groupBy("gram").agg(F.count("*").alias("_n"))
        .where(F.col("_n") > _FAMILY_ROWS // 2).select("gram"),
        "crowded",
    )
    if crowded.take(1):
        there = read_again(join_small(kinds, crowded, "gram", "left_semi"))
        hot = stage(
            there.mapInArrow(_families(length, names_only=True), "family long")
            .groupBy("family").agg(F.count("*").alias("_n"))
            .where(F.col("_n") > _FAMILY_ROWS).select("family"),
            "hot",
        )
        if hot.take(1):
            windows = stage(
                join_small(there.mapInArrow(_families(length), family_rows), hot, "family", "left_semi")
                .mapInArrow(
                    _window_rows(length), f"family long, {_KEYS}, window long, start int, low int"
                ),
                "windows",
            )
            alike = stage(
                windows.groupBy("family", "window").agg(F.count("*").alias("_n"))
                .where("_n > 1").select("family", "window"),
                "alike",
            )
            # A run has few windows; those of it that are repeated become one row or two.
            equal = (
                join_small(windows, alike, ["family", "window"], "left_semi")
                .groupBy(*KEY, "start")
                .agg(F.collect_list(F.struct("low", (F.col("low") + length).alias("high"))).alias("runs"))
                .select(*KEY, "runs")
                .mapInArrow(_merged, f"{_KEYS}, runs array<struct<low:int,high:int>>")
            )
            covered = covered.union(equal.select(*KEY, F.inline("runs")))
            families = join_small(families, hot, "family", "left_anti")
    partly = (
        families.repartition("family").sortWithinPartitions("family")
        .mapInArrow(_repeated(length), f"{_KEYS}, low int, high int")
    )
    removed = stage(
        covered.union(partly)
        .groupBy(*KEY).agg(F.collect_list(F.struct("low", "high")).alias("runs"))
        .mapInArrow(_merged, f"{_KEYS}, runs array<struct<low:int,high:int>>")
        .withColumnRenamed("runs", "_runs"),
        "removed",
    )
    content = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    size = F.octet_length(content)
    everything = F.array(F.struct(F.lit(0).alias("low"), size.alias("high")))
    nothing = F.array().cast("array<struct<low:int,high:int>>")
    marked = join_small(
        join_small(keyed, removed, KEY),
        stage(copied.select(*KEY, F.lit(True).alias("_all")), "whole"), KEY,
    ).withColumn(
        "removed", F.when(F.col("_all"), everything).otherwise(F.coalesce("_runs", nothing))
    )
    total = F.aggregate("removed", F.lit(0), lambda s, r: s + r["high"] - r["low"])
    return marked.select(
        *back, size.cast("long").alias("n_bytes"), "removed",
        total.cast("long").alias("n_removed"),
        F.when(F.size("removed") == 0, content).otherwise(_kept(content, F.col("removed"))).alias("kept"),
    )
