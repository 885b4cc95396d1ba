"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerloom.llm import text as T
from ledgerloom.llm.tables import aside, given_back

#: Labelled documents a model is fitted on at most.
SAMPLE = 3000
#: Cells (documents by lines) of one padded table of the chain.
_CELLS = 1 << 20

_CLASSES = np.full(256, 7)
for _i, _bytes in enumerate((
    range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), (0x20, *range(9, 14)),
    b".,;:?'\"()-", b"!", (c for c in range(0x80, 0x100)),
)):
    _CLASSES[list(_bytes)] = _i
_FEATURES = 8 + 7


@dataclass(frozen=True)
class Model:
    """Weights of state "good" on standardised features, and of each pair of states."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray


def line_features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte lengths of all lines, and the line offsets of each text.

    A text has one line more than line breaks; an empty one has one empty line.
    Features are shares of kinds of bytes, word lengths, words that repeat the one
    or two before, and whether the line occurs again in the text.
    """
    data, offsets = T.raw(column)
    breaks = np.flatnonzero(data == 0x0A)
    # Lines begin at each text and behind each break; a text that ends with a
    # break ends with an empty line, listed before the next text's first.
    owner = np.searchsorted(offsets, breaks, side="right") - 1
    texts = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    of = np.concatenate([np.arange(texts), owner])
    order = np.lexsort((starts, of))
    starts, of = starts[order], of[order]
    line_offsets = np.searchsorted(of, np.arange(texts + 1))
    ends = np.append(starts[1:] - 1, 0)
    last = line_offsets[1:] - 1
    ends[last] = offsets[1:]
    length = ends - starts

    out = np.zeros((len(starts), _FEATURES))
    kinds = _CLASSES[data]
    for k in range(8):
        running = np.concatenate([[0], np.cumsum(kinds == k)])
        out[:, k] = (running[ends] - running[starts]) / np.maximum(length, 1)
    hashes, first, behind, _ = T.words(data, offsets, T.BLANKS)
    if len(first):
        # An empty line can share its start with the next text's first line.
        nonempty = np.flatnonzero(length > 0)
        line = nonempty[np.searchsorted(starts[nonempty], first, side="right") - 1]
        words = np.bincount(line, minlength=len(starts))
        least = np.maximum(words, 1)
        once = np.zeros(len(first), bool)
        twice = once.copy()
        once[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
        twice[2:] = (hashes[2:] == hashes[:-2]) & (line[2:] == line[:-2])
        size = behind - first
        out[:, 8] = np.bincount(line[once], minlength=len(starts)) / least
        out[:, 9] = np.bincount(line[twice], minlength=len(starts)) / least
        out[:, 10] = np.bincount(line, weights=size, minlength=len(starts)) / least
        out[:, 11] = np.bincount(line[size == 1], minlength=len(starts)) / least
        # Words that end in a symbol, not in a letter or the usual stops.
        odd = np.isin(kinds[behind - 1], (5, 7))
        out[:, 12] = np.bincount(line[odd], minlength=len(starts)) / least
        out[:, 13] = np.log1p(words)
    value = T.span_hashes(T.BYTE[data], starts, ends)
    order = np.lexsort((value, of))
    same = (value[order][1:] == value[order][:-1]) & (of[order][1:] == of[order][:-1])
    again = np.zeros(len(starts), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    out[:, 14] = again
    return out, length, line_offsets


def _neighbours(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each line's features with those of the lines before and behind, and a bias."""
    before, behind = np.zeros_like(x), np.zeros_like(x)
    before[1:], behind[:-1] = x[:-1], x[1:]
    head, tail = np.zeros(len(x)), np.zeros(len(x))
    head[offsets[:-1]] = tail[offsets[1:] - 1] = 1
    before[head == 1], behind[tail == 1] = 0, 0
    return np.column_stack([x, before, behind, head, tail, np.ones(len(x))])


def _tables(counts: np.ndarray) -> Iterator[np.ndarray]:
    """Texts, longest first, in groups whose padded tables stay small."""
    order = np.argsort(-counts, kind="stable")
    at = 0
    while at < len(order):
        take = max(1, _CELLS // max(1, int(counts[order[at]])))
        yield order[at : at + take]
        at += take


def _chain(unary: np.ndarray, counts: np.ndarray, moves: np.ndarray):
    """Forward-backward on one table, texts sorted by falling line count.

    Returns the chance of "good" at each line, the log partition of each text, and
    the expected count of each pair of states.
    """
    n, width = unary.shape
    live = np.searchsorted(-counts, -np.arange(1, width + 1), side="right")
    ahead, back = np.zeros((2, n, width)), np.zeros((2, n, width))
    ahead[1, :, 0] = unary[:, 0]
    for t in range(1, width):
        k = live[t]
        a, b = ahead[0, :k, t - 1], ahead[1, :k, t - 1]
        ahead[0, :k, t] = np.logaddexp(a + moves[0, 0], b + moves[1, 0])
        ahead[1, :k, t] = np.logaddexp(a + moves[0, 1], b + moves[1, 1]) + unary[:k, t]
    for t in range(width - 2, -1, -1):
        k = live[t + 1]
        a, b = back[0, :k, t + 1], back[1, :k, t + 1] + unary[:k, t + 1]
        back[0, :k, t] = np.logaddexp(a + moves[0, 0], b + moves[0, 1])
        back[1, :k, t] = np.logaddexp(a + moves[1, 0], b + moves[1, 1])
    end = (np.arange(n), counts - 1)
    total = np.logaddexp(ahead[0][end], ahead[1][end])
    good = np.exp(ahead[1] + back[1] - total[:, None])
    pairs = np.zeros((2, 2))
    if width > 1:
        inside = np.arange(1, width) < counts[:, None]
        for i in range(2):
            for j in range(2):
                step = ahead[i, :, :-1] + moves[i, j] + back[j, :, 1:] + j * unary[:, 1:]
                pairs[i, j] = np.exp(step - total[:, None])[inside].sum()
    return good, total, pairs


def _padded(values: np.ndarray, offsets: np.ndarray, group: np.ndarray):
    counts = np.diff(offsets)[group]
    place = offsets[group][:, None] + np.arange(counts[0])
    inside = np.arange(counts[0]) < counts[:, None]
    return np.where(inside, values[np.where(inside, place, 0)], 0.0), counts, place, inside


def fit_chain(features, offsets, labels, rounds: int = 60, decay: float = 1e-4) -> Model:
    """Maximise the likelihood of lines that all carry the label of their text."""
    mean, scale = features.mean(0), features.std(0) + 1e-6
    x = _neighbours(np.clip((features - mean) / scale, -5, 5), offsets)
    counts = np.diff(offsets)
    y = np.repeat(labels, counts).astype(float)
    lines = len(x)
    wanted = np.zeros((2, 2))
    for label in (0, 1):
        wanted[label, label] = (counts[labels == label] - 1).sum()
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    groups = list(_tables(counts))
    for step in range(1, rounds + 1):
        weights, moves = theta[:-4], theta[-4:].reshape(2, 2)
        unary, good, pairs = x @ weights, np.zeros(lines), np.zeros((2, 2))
        for group in groups:
            table, sizes, place, inside = _padded(unary, offsets, group)
            chance, _, moved = _chain(table, sizes, moves)
            good[place[inside]] = chance[inside]
            pairs += moved
        slope = np.concatenate([x.T @ (y - good), (wanted - pairs).ravel()]) / lines
        slope -= decay * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def chain_scores(model: Model, column) -> np.ndarray:
    """The share of each text, by length, in lines labelled good."""
    features, length, offsets = line_features(column)
    x = _neighbours(np.clip((features - model.mean) / model.scale, -5, 5), offsets)
    unary = x @ model.weights
    good = np.zeros(len(unary))
    for group in _tables(np.diff(offsets)):
        table, counts, place, inside = _padded(unary, offsets, group)
        chance, _, _ = _chain(table, counts, model.moves)
        good[place[inside]] = chance[inside]
    weight = length + 1.0
    share = np.add.reduceat(weight * good, offsets[:-1]) / np.add.reduceat(weight, offsets[:-1])
    return np.clip(share, 0.0, 1.0)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in given_back(batches):
        for part in T.slices(batch, "text"):
            features, _, offsets = line_features(part.column("text"))
            blobs = [features[a:b].astype("<f4").tobytes()
                     for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({
                "id": part.column("id"), "label": part.column("label"),
                "features": pa.array(blobs, pa.binary()),
            })


def is_held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    seed: int = 7,
) -> Model | None:
    """Fit on at most ``sample`` labelled documents that are not held out.

    They are the first by a seeded hash of the id; ids with contrary labels are left
    out, and of rows that repeat an id one text is taken.  Their line features are
    computed by tasks and collected, nothing else.  Without labels, no model.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & ~is_held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).alias("label"), F.max(label_col).alias("_high"))
        .where("label = _high").drop("_high")
        .orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(sample)
    )
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = (
        # At most ``sample`` rows, hence the broadcast.
        texts.join(F.broadcast(known), "id")
        .select("id", "text", F.col("label").cast("int").alias("label"))
        .mapInArrow(_sampled, f"id {kind}, label int, features binary")
        .groupBy("id", "label").agg(F.min("features").alias("features"))
        .orderBy("id").collect()
    )
    if not rows:
        return None
    parts = [np.frombuffer(r["features"], "<f4").reshape(-1, _FEATURES) for r in rows]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    labels_of = np.array([r["label"] for r in rows])
    return fit_chain(np.concatenate(parts).astype(float), offsets, labels_of)


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Add ``score``, 0 to 1: the length-weighted chance that a text's lines are good.

    Null and empty texts have one empty line and so a score as well; without a model
    every score is 0.5.  Rows with the same text have the same score.  An input column
    of that name is replaced.
    """
    docs, back = aside(docs, ["score"], used=[text_col])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given_back(batches):
            for part in T.slices(batch, text_col):
                value = (
                    np.full(part.num_rows, 0.5) if model is None
                    else chain_scores(model, part.column(text_col))
                )
                columns = [*part.columns, pa.array(value)]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "score"])

    scored = docs.mapInArrow(
        read, StructType([*docs.schema.fields, StructField("score", DoubleType())])
    )
    return scored.select(*back, "score")
