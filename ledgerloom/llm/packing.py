"""Tokenise documents and pack them into rows of equal length as binary matrices."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ledgerloom.llm import text as T
from ledgerloom.llm.tables import given_back

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut before pairs merge.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Tokens packed together at least, unless a task has fewer.
GROUP_TOKENS = 1 << 21
#: Words whose ids a worker remembers.
_REMEMBERED = 300_000


class Tokenizer:
    """Ids of texts as packed integers, with a bounded memory for words.

    A blank between two characters that are not blank always begins a token, so a
    text can be cut there and each word looked up; other texts are encoded whole.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.end = max(ranks.values()) + 1
        self.kind = "<u2" if self.end < 1 << 16 else "<u4"
        self.coder = tiktoken.Encoding(
            "packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.known: dict[str, bytes] = {}

    def _pack(self, piece: str) -> bytes:
        return np.array(self.coder.encode_ordinary(piece), self.kind).tobytes()

    def encode(self, text: str) -> np.ndarray:
        known, words = self.known, text.split(" ")
        if all(w and not w[0].isspace() and not w[-1].isspace() for w in words):
            words = [words[0], *[" " + w for w in words[1:]]]
            try:
                packed = b"".join([known[w] for w in words])
            except KeyError:
                if len(known) > _REMEMBERED:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = self._pack(w)
                packed = b"".join([known[w] for w in words])
        else:
            packed = self._pack(text)
        return np.frombuffer(packed, self.kind)


def read_vocabulary(path: str) -> dict[bytes, int]:
    lines = Path(path).read_bytes().split(b"\n")
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


class _Capacities:
    """A segment tree over capacities: the least one not below a size with a bin left."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: dict[int, list[int]] = {}

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, which: int) -> None:
        self.bins.setdefault(capacity, []).append(which)
        self._add(capacity, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """A bin of the least capacity that holds ``size``, removed; None if none does."""
        node, count = self.leaves + size, self.count
        if not count[node]:
            # Climb until a subtree to the right has bins, then go down its left edge.
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Pieces in each row: longest first, each into the fullest row that holds it."""
    rows: list[list[int]] = []
    left = _Capacities(length)
    for piece in np.argsort(-sizes, kind="stable"):
        size = int(sizes[piece])
        found = left.take(size) if size < length else None
        if found is None:
            rows.append([])
            found = (length, len(rows) - 1)
        capacity, row = found
        rows[row].append(int(piece))
        if capacity > size:
            left.put(capacity - size, row)
    return rows


def pack_group(tokens: list[np.ndarray], ids: list, length: int, end: int, kind: str, id_type,
               group: int) -> pa.RecordBatch:
    """Pack the token runs of some documents into rows."""
    doc, start, size = [], [], []
    for d, run in enumerate(tokens):
        for s in range(0, len(run), length):
            doc.append(d)
            start.append(s)
            size.append(min(length, len(run) - s))
    rows = best_fit_decreasing(np.array(size, np.int64), length)
    matrix = np.full((len(rows), length), end, kind)
    places = np.zeros((len(rows), length), "<u4" if length > 1 << 16 else "<u2")
    steps = np.arange(length, dtype=places.dtype)
    bounds, docs, parts, ordinals = [], [], [], []
    for r, pieces in enumerate(rows):
        at, bound = 0, [0]
        for p in pieces:
            matrix[r, at : at + size[p]] = tokens[doc[p]][start[p] : start[p] + size[p]]
            places[r, at : at + size[p]] = steps[: size[p]]
            at += size[p]
            bound.append(at)
        bounds.append(bound)
        docs.append([ids[doc[p]] for p in pieces])
        parts.append([start[p] // length for p in pieces])
        ordinals.append([doc[p] for p in pieces])
    return pa.RecordBatch.from_pydict({
        "pack_group": pa.array(np.full(len(rows), group)),
        "pack_row": pa.array(np.arange(len(rows)), pa.int32()),
        "n_tokens": pa.array([b[-1] for b in bounds], pa.int32()),
        "doc_ids": pa.array(docs, pa.list_(id_type)),
        "ordinals": pa.array(ordinals, pa.list_(pa.int32())),
        "parts": pa.array(parts, pa.list_(pa.int32())),
        "cu_seqlens": pa.array(bounds, pa.list_(pa.int32())),
        "input_ids": pa.array([r.tobytes() for r in matrix], pa.binary()),
        "position_ids": pa.array([r.tobytes() for r in places], pa.binary()),
    })


def pack(
    docs: DataFrame,
    length: int = 2048,
    vocabulary: str = VOCABULARY,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """Token rows of exactly ``length`` ids, each holding whole documents or parts.

    Every document becomes its ids and an end token.  What is longer than a row is
    split into parts of a row each and a rest, losslessly.  Parts are packed by best
    fit decreasing, with a segment tree over free capacities, among about
    ``group_tokens`` tokens of the same task: nothing is shuffled, and a task holds
    one group at a time.

    A result row has ``pack_group`` and ``pack_row``; for each segment ``doc_ids``,
    ``ordinals`` (which document of the group, where ids are null or repeat) and
    ``parts``; ``cu_seqlens``, the cumulative segment lengths; ``input_ids`` and
    ``position_ids``, little-endian matrices rows of ``length`` numbers, positions
    starting anew with each segment.  The end token fills what is left.

    Null and empty texts are an end token alone, so every input row has a segment;
    repeated rows each have one.  An empty table gives no rows; other columns are
    ignored.  The vocabulary's file is read by the driver and sent to the tasks.
    """
    ranks = read_vocabulary(vocabulary)
    keep = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = keep.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Tokenizer(ranks)
        end = np.array([coder.end], coder.kind)
        tokens, ids, held, id_type = [], [], 0, None
        group = TaskContext.get().partitionId() << 32
        for batch in given_back(batches):
            id_type = batch.column("id").type
            for part in T.slices(batch, "text"):
                for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(),
                                   strict=True):
                    run = np.concatenate([coder.encode(text), end]) if text else end
                    tokens.append(run)
                    ids.append(i)
                    held += len(run)
                    if held >= group_tokens:
                        yield pack_group(tokens, ids, length, coder.end, coder.kind, id_type, group)
                        tokens, ids, held, group = [], [], 0, group + 1
        if tokens:
            yield pack_group(tokens, ids, length, coder.end, coder.kind, id_type, group)

    return keep.mapInArrow(
        read,
        f"pack_group long, pack_row int, n_tokens int, doc_ids array<{kind}>, "
        "ordinals array<int>, parts array<int>, cu_seqlens array<int>, "
        "input_ids binary, position_ids binary",
    )
