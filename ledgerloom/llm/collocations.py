"""Phrase collocations by prefix-free parsing: count inside distinct chunks, weighted."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import text as T
from ledgerloom.llm.tables import join_small
from ledgerloom.session import stage

_U = np.uint64
_SPACE, _BREAK = 0x20, 0x0A
_FOLD = T.BLANKS.fold
#: What ends a piece, and what stands between words within one.
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK = _ENDS.copy()
_BLANK[list(b" \t")] = True


class Sizes(NamedTuple):
    """How texts are parsed; results do not depend on it."""

    part: int = 1 << 21  # bytes of a text read at once, about
    period: int = 32  # one window of words in so many ends a chunk
    most: int = 1024  # words a chunk has at most before its last window


#: The table of frequent phrases that tasks get has at most this many bits.
_FILTER_BITS = 1 << 27
#: Phrase occurrences counted at once in a task.
_COUNTED = 1 << 21


def _words(data: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(blank[data], prepend=True, append=True)
    at = np.flatnonzero(edge)
    return at[::2], at[1::2]


def _parts(text: bytes, overlap: int, part: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """A text in parts that share ``overlap`` words: bytes, word starts and ends, is last."""
    start, size = 0, part
    while True:
        data = np.frombuffer(text, np.uint8, min(size, len(text) - start), start)
        first, behind = _words(data, _BLANK)
        if start + len(data) == len(text):
            yield data, first, behind, True
            return
        if len(first) <= 2 * overlap + 1:
            size *= 2  # words of many bytes
            continue
        # The last word may go on behind the part.
        first, behind = first[:-1], behind[:-1]
        yield data[: behind[-1]], first, behind, False
        start, size = start + int(first[len(first) - overlap]), part


def _chunks_of_part(data, first, behind, last, longest, sizes):
    """Chunks of a part as texts, and how many words at their front they count.

    Words are joined by a blank within a piece and by a line feed between pieces.
    A chunk ends in the window of words that begins the next one, so it holds each
    phrase that starts before that window whole; behind a border nothing is needed.
    """
    overlap, count = longest - 1, len(first)
    if not count:
        return [], np.zeros(0, np.int64)
    folded = _FOLD[data]
    hashes = T.word_hashes(folded, first, behind)
    ending = np.concatenate([[0], np.cumsum(_ENDS[data])])
    border = np.ones(count + 1, bool)
    border[1:count] = ending[first[1:]] > ending[behind[:-1]]
    own = count if last else count - overlap
    windows = np.arange(max(0, min(own, count - overlap + 1)))
    ends = T.run_hashes(hashes, windows, overlap) % _U(sizes.period) == 0
    begin = np.union1d([0], np.flatnonzero(ends))
    # Where no window ends a chunk for long, it is cut by its length.
    gaps = np.diff(begin, append=own)
    cuts = (gaps - 1) // sizes.most
    if cuts.any():
        more = np.repeat(begin, cuts) + sizes.most * (
            np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts) + 1
        )
        begin = np.sort(np.concatenate([begin, more]))
    until = np.append(begin[1:], own)
    # The first border at or behind the end of what is counted ends the chunk too.
    edges = np.flatnonzero(border)
    end = np.minimum(np.minimum(until + overlap, count), edges[np.searchsorted(edges, until)])
    # A text with one byte between words.
    inside = np.zeros(len(data) + 1, np.int8)
    inside[first] += 1
    inside[behind] -= 1
    keep = np.cumsum(inside[:-1]).astype(bool)
    joint = behind[:-1]
    keep[joint] = True
    flat = folded.copy()
    flat[joint] = np.where(border[1:count], _BREAK, _SPACE)
    place = np.cumsum(keep) - 1
    flat, head = flat[keep].tobytes(), place[first]
    tail = head + (behind - first)
    texts = [flat[a:b] for a, b in zip(head[begin], tail[end - 1], strict=True)]
    return texts, until - begin


def _parse(longest: int, sizes: Sizes):
    """Texts to chunks: (group, chunk, own), own words at the front being counted."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, owns, rows, held = [], [], [], 0
            for row, value in enumerate(batch.column("text").cast(pa.large_binary())):
                for piece in _parts(value.as_py(), longest - 1, sizes.part):
                    found, own = _chunks_of_part(*piece, longest, sizes)
                    texts += found
                    owns.append(own)
                    rows.append(np.full(len(found), row))
                    held += len(piece[0])
                    if held >= sizes.part:
                        yield _chunk_rows(batch, rows, texts, owns)
                        texts, owns, rows, held = [], [], [], 0
            if texts:
                yield _chunk_rows(batch, rows, texts, owns)

    return read


def _chunk_rows(batch, rows, texts, owns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "group": batch.column("group").take(pa.array(np.concatenate(rows))),
        "chunk": pa.array(texts, pa.binary()).cast(pa.string()),
        "own": pa.array(np.concatenate(owns), pa.int32()),
    })


class _Phrases:
    """All places in a slice of chunks where a phrase may start."""

    def __init__(self, part: pa.RecordBatch) -> None:
        data, offsets = T.raw(part.column("chunk"))
        self.data = data
        hashes, self.first, self.behind, words = T.words(data, offsets, _CHUNK_WORDS)
        self.count = len(hashes)
        row = np.repeat(np.arange(len(words) - 1), np.diff(words))
        own = part.column("own").to_numpy()
        self.counted = np.arange(self.count) - words[row] < own[row]
        self.weight = part.column("n").to_numpy()[row]
        groups = part.column("group").dictionary_encode()
        self.groups = groups.dictionary
        self.group = groups.indices.to_numpy()[row]
        self.seed = np.array([_seed(g) for g in self.groups.to_pylist()], _U)[self.group]
        self.hashes = hashes
        # Words up to the next border, this one included.
        ends = np.zeros(self.count + 1, bool)
        ends[-1] = True
        ends[words[:-1][np.diff(words) > 0]] = True
        broken = np.flatnonzero(data[self.first[1:] - 1] == _BREAK) + 1
        ends[broken] = True
        edges = np.flatnonzero(ends)
        at = np.arange(self.count)
        self.reach = edges[np.searchsorted(edges, at, side="right")] - at

    def starts(self, n: int) -> np.ndarray:
        """Where phrases of n words start, counted here or not."""
        return np.flatnonzero(self.reach >= n)

    def keys(self, at: np.ndarray, n: int) -> np.ndarray:
        return T.mix(T.run_hashes(self.hashes, at, n) ^ self.seed[at])


_CHUNK_WORDS = T.Alphabet(bytes([_SPACE, _BREAK]))


def _seed(group: str) -> int:
    data = np.frombuffer(group.encode(), np.uint8)
    return int(T.word_hashes(data, np.array([0]), np.array([len(data)]))[0])


class _Filter:
    """Bits of the keys of frequent phrases; a key without its bit is not frequent."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.mask = _U(len(bits) * 64 - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & self.mask
        return (self.bits[slot >> _U(6)] >> (slot & _U(63))) & _U(1) == 1


def _likely(phrases: _Phrases, sizes: tuple[int, ...], longest: int, below: _Filter | None):
    """Starts of phrases of each size all of whose parts of ``longest`` words pass."""
    passed = None
    if below is not None:
        passed = np.zeros(phrases.count, bool)
        at = phrases.starts(longest)
        passed[at] = below(phrases.keys(at, longest))
    for n in sizes:
        at = phrases.starts(n)
        at = at[phrases.counted[at]]
        for k in range(n - longest + 1 if passed is not None else 0):
            at = at[passed[at + k]]
        yield n, at


def _count_keys(sizes: tuple[int, ...], below_size: int, below):
    """Chunks to (key, count) of their phrases."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Filter(below.value) if below is not None else None
        for batch in batches:
            for part in T.slices(batch, "chunk", _COUNTED):
                phrases = _Phrases(part)
                for n, at in _likely(phrases, sizes, below_size, known):
                    keys, where = np.unique(phrases.keys(at, n), return_inverse=True)
                    count = np.zeros(len(keys), np.int64)
                    np.add.at(count, where, phrases.weight[at])
                    yield pa.RecordBatch.from_pydict({
                        "key": keys.view(np.int64), "count": count,
                    })

    return read


def _count_texts(longest: int, filters: list):
    """Chunks to (group, n, phrase, count), for phrases that every filter passes.

    Size 0 has all words of the group.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(s, _Filter(b.value)) for s, b in filters]
        for batch in batches:
            for part in T.slices(batch, "chunk", _COUNTED):
                phrases = _Phrases(part)
                words = np.zeros(len(phrases.groups), np.int64)
                np.add.at(words, phrases.group[phrases.counted], phrases.weight[phrases.counted])
                yield pa.RecordBatch.from_pydict({
                    "group": phrases.groups, "n": pa.array(np.zeros(len(words)), pa.int32()),
                    "phrase": pa.array([""] * len(words)), "count": words,
                })
                for n in range(1, longest + 1):
                    at = phrases.starts(n)
                    at = at[phrases.counted[at]]
                    of_size = next(f for sizes, f in known if n in sizes)
                    keys = phrases.keys(at, n)
                    at, keys = at[of_size(keys)], keys[of_size(keys)]
                    # Two hashes of a slice tell its phrases apart; they meet others by text.
                    other = T.run_hashes(T.mix(phrases.hashes ^ _U(n)), at, n)
                    order = np.lexsort((other, keys))
                    at, keys, other = at[order], keys[order], other[order]
                    new = np.ones(len(at), bool)
                    new[1:] = (keys[1:] != keys[:-1]) | (other[1:] != other[:-1])
                    lead = at[new]
                    count = np.add.reduceat(phrases.weight[at], np.flatnonzero(new)) if len(at) else lead
                    begin, end = phrases.first[lead], phrases.behind[lead + n - 1]
                    yield pa.RecordBatch.from_pydict({
                        "group": phrases.groups.take(pa.array(phrases.group[lead])),
                        "n": pa.array(np.full(len(lead), n), pa.int32()),
                        "phrase": _spans(phrases.data, begin, end),
                        "count": count.astype(np.int64),
                    })

    return read


def _spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - begin
    offsets = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)
    return pa.Array.from_buffers(
        pa.large_string(), len(size),
        [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[index].tobytes())],
    ).cast(pa.string())


def _filter(frequent: DataFrame):
    """A table of bits for ``frequent(key)``, of a size bound to their number, for tasks.

    Spark sets the bits; at most ``_FILTER_BITS`` reach the driver.
    """
    spark = frequent.sparkSession
    slots = 1 << 16
    while slots < min(16 * frequent.count(), _FILTER_BITS):
        slots *= 2
    slot = F.col("key").bitwiseAND(F.lit(slots - 1))
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    words = (
        frequent.groupBy(F.shiftright(slot, 6).cast("int").alias("at"))
        .agg(F.bit_or(bit).alias("word")).toArrow()
    )
    bits = np.zeros(slots // 64, np.int64)
    bits[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return spark.sparkContext.broadcast(bits.view(_U))


def phrase_counts(
    docs: DataFrame, text_col: str, group: Column, longest: int, least: int, sizes: Sizes
) -> DataFrame:
    """How often each phrase of 1 to ``longest`` words occurs, if ``least`` times or more.

    Columns ``group``, ``n`` (words), ``phrase`` and ``count``; of size 0 is the
    number of all words of the group.  See :func:`collocations`.
    """
    given = docs.select(group.alias("group"), F.col(text_col).alias("text"))
    chunks = given.where("text is not null").mapInArrow(
        _parse(longest, sizes), "group string, chunk string, own int"
    )
    parsed = stage(chunks.groupBy("group", "chunk", "own").agg(F.count("*").alias("n")), "chunks")
    steps = [(1,), (2,), tuple(range(3, longest + 1))]
    filters, size = [], 0
    for sizes in steps[:longest]:
        below = filters[-1][1] if filters else None
        keys = parsed.mapInArrow(_count_keys(sizes, size, below), "key long, count long")
        frequent = keys.groupBy("key").agg(F.sum("count").alias("count")).where(F.col("count") >= least)
        filters.append((sizes, _filter(stage(frequent.select("key"), "frequent"))))
        size = sizes[0]
    texts = parsed.mapInArrow(
        _count_texts(longest, filters), "group string, n int, phrase string, count long"
    )
    counted = texts.groupBy("group", "n", "phrase").agg(F.sum("count").alias("count"))
    return stage(counted.where((F.col("count") >= least) | (F.col("n") == 0)), "phrases")


def _inside(skipped: Column, words: Column) -> Column:
    """The words of ``phrase`` behind the ``skipped`` first ones, as a phrase."""
    return F.array_join(F.slice(F.split("phrase", " "), skipped + 1, words), " ")


def score() -> Column:
    """The floor of 1000 ``a`` ``total`` / (``l`` ``r``), in integers of 38 digits."""
    a, total, left, right = (f"cast({c} as decimal(19,0))" for c in ("1000 * a", "total", "l", "r"))
    return F.expr(f"{a} * {total} div ({left} * {right})")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    group_col: str | None = "lang",
    no_group: str = "und",
    longest: int = 5,
    least: int = 100,
    absorbed: int = 100,
    first: int = 2000,
    sizes: Sizes = Sizes(),
) -> DataFrame:
    """The phrases of 2 to ``longest`` words whose words keep company most, by group.

    Texts are lower-cased (A-Z) and cut at ``.,;:!?`` and line ends into pieces, those
    at blanks and tabs into words.  A phrase that occurs ``a`` times (``least`` or more;
    overlaps count) is scored by the worst of its cuts: the floor of
    ``1000 a n / (l r)``, where ``n`` is the words of the group and ``l``, ``r`` count
    both parts; of equal cuts the first is shown.  A phrase inside a longer one that
    occurs at least ``absorbed`` per cent as often is dropped.  Returns each group's
    ``first`` phrases by score, count and text: ``lang`` (or ``group_col``), ``rank``,
    ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A text is parsed into chunks: a window of ``longest - 1`` words whose hash says so
    ends one chunk and begins the next, so copies of a passage give equal chunks
    wherever they stand.  Distinct chunks are counted once; phrases are counted inside
    them, weighted, each in the one chunk in which it starts before the window that
    ends it.  Rare phrases never reach a shuffle by text: a phrase is frequent only if
    its parts are, so keys are counted for words, then pairs of frequent words, then
    phrases of frequent pairs, and tasks get each step's frequent keys as a table of
    bits of bounded size.  Keys only filter, and too many pass if they collide; the
    counts returned are by text.

    Null texts hold nothing, texts of blanks neither; a null group is ``no_group``,
    and with ``group_col`` None all texts are one group (column ``lang`` null).
    Repeated rows count again.  An empty table gives no rows.  Other columns are not
    read, whatever their names.
    """
    group = F.lit(no_group)
    if group_col:
        group = F.coalesce(F.col(group_col).cast("string"), group)
    counts = phrase_counts(docs, text_col, group, longest, least, sizes)
    totals = stage(counts.where("n = 0").select("group", F.col("count").alias("total")), "totals")
    known = counts.where("n > 0").select("group", "phrase", "count")
    candidates = counts.where("n > 1").select(
        "group", F.col("n").alias("size"), "phrase", F.col("count").alias("a")
    )
    longer = (
        candidates.where("size > 2")
        .select("group", "size", "phrase", F.col("a").alias("of_longer"),
                F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("inner"))
        .select("group", "size", "of_longer", "inner", "phrase",
                F.explode(F.sequence(F.lit(0), F.col("size") - F.col("inner"))).alias("skip"))
        .select("group", "of_longer", _inside(F.col("skip"), F.col("inner")).alias("phrase"))
        .groupBy("group", "phrase").agg(F.max("of_longer").alias("of_longer"))
    )
    kept = (
        candidates.join(longer, ["group", "phrase"], "left")
        .where(F.col("of_longer").isNull() | (100 * F.col("of_longer") < absorbed * F.col("a")))
        .drop("of_longer")
    )
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({
        "left": _inside(F.lit(0), F.col("k")),
        "right": _inside(F.col("k"), F.col("size") - F.col("k")),
    })
    left = known.toDF("group", "left", "l")
    right = known.toDF("group", "right", "r")
    scored = (
        join_small(cuts.join(left, ["group", "left"]).join(right, ["group", "right"]), totals, "group")
        .withColumn("score", score())
    )
    worst = (
        scored.groupBy("group", "phrase", "a", F.col("total").alias("n"))
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("group", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )
    order = Window.partitionBy("group").orderBy(F.desc("score"), F.desc("a"), "phrase")
    named = group_col or "lang"
    return (
        worst.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
        .select((F.col("group") if group_col else F.lit(None).cast("string")).alias(named),
                F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
