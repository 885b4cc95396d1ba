"""Repair of conversation structure: a grammar of role and fault sequences, min-plus
matrices of its rules, and the cheapest edits of each conversation."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tables import join_small
from ledgerloom.session import stage

#: Rows of a conversation in one block; longer ones are several blocks.
_BLOCK_BITS = 12
#: Rules added in one round of pairing, and rounds; what repeats beyond is multiplied anew.
_RULES, _ROUNDS = 64, 10
#: A pair becomes a rule if it occurs so often.
_LEAST = 8
_DELETE, _REROLE, _INSERT, _TRUNCATED = 4, 3, 3, 3
_BLANKS = " \t\n\x0b\x0c\r"

#: Symbols of rows: role initial (s, u, a or o for any other) by fault.
_ROLES, _FAULTS = "suao", ("sound", "truncated", "dropped")
#: What has been said before a row: nothing, system, user, assistant.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
STATES = 4
#: After which states each role may speak, and the state then.
_SPEAKS = {"s": ((_START,), _SYSTEM), "u": ((_START, _SYSTEM, _ASSISTANT), _USER), "a": ((_USER,), _ASSISTANT)}
_NEXT = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_SPEAKER = {_USER: "user", _ASSISTANT: "assistant"}
_NEVER = 1 << 60


def symbol(role: int, fault: int) -> int:
    return 3 * role + fault


_PRIME = (1 << 127) - 1
_BASE = 0x2545F4914F6CDD1D9E3779B97F4A7C15


class Rope:
    """Audit text as a tree whose parts are shared between rules, compared by hashes."""

    __slots__ = ("size", "hash", "power", "text", "parts")

    def __init__(self, text: str = "", parts: tuple[Rope, Rope] | None = None) -> None:
        if parts and parts[0].size + parts[1].size <= 64:
            text, parts = str(parts[0]) + str(parts[1]), None
        self.text, self.parts = text, parts
        if parts:
            left, right = parts
            self.size = left.size + right.size
            self.hash = (left.hash * right.power + right.hash) % _PRIME
            self.power = left.power * right.power % _PRIME
        else:
            self.size, self.hash = len(text), 0
            for c in text:
                self.hash = (self.hash * _BASE + ord(c)) % _PRIME
            self.power = pow(_BASE, len(text), _PRIME)

    def __str__(self) -> str:
        out, rest = [], [self]
        while rest:
            rope = rest.pop()
            if rope.parts:
                rest += reversed(rope.parts)
            else:
                out.append(rope.text)
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        """By ASCII.  Neither is ever a prefix of the other, see :func:`compose`."""
        left, right = [self], [other]
        while left and right:
            a, b = left.pop(), right.pop()
            if a.size == b.size and a.hash == b.hash:
                continue
            if a.parts and (a.size >= b.size or not b.parts):
                left += reversed(a.parts)
                right.append(b)
            elif b.parts:
                left.append(a)
                right += reversed(b.parts)
            else:
                n = min(a.size, b.size)
                if a.text[:n] != b.text[:n]:
                    return a.text < b.text
                if a.size > n:
                    left.append(Rope(a.text[n:]))
                if b.size > n:
                    right.append(Rope(b.text[n:]))
        return bool(right)


#: cost and audit for each pair of states (before, after); None where there is no way.
Matrix = list[list[tuple[int, Rope] | None]]


def row_matrix(code: int) -> Matrix:
    """The edits of one row: inserts before it, then what becomes of it.

    More inserts than lead to another state cost without use.  All ways end with the
    letter of the row, so of two ways over the same rows none begins with the other.
    """
    role, fault = _ROLES[code // 3], _FAULTS[code % 3]
    extra = _TRUNCATED if fault == "truncated" else 0
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for before in range(STATES):
        state, inserted, seen = before, 0, set()
        while state not in seen:
            seen.add(state)
            cost, audit = _INSERT * inserted, "I" * inserted
            ways = [(state, _DELETE, "D")]
            if fault != "dropped":
                if role in _SPEAKS and state in _SPEAKS[role][0]:
                    ways.append((_SPEAKS[role][1], extra, "K"))
                ways.append((_NEXT[state], _REROLE + extra, "R"))
            for after, more, letter in ways:
                way, best = (cost + more, audit + letter), out[before][after]
                if best is None or way < (best[0], best[1].text):
                    out[before][after] = way[0], Rope(way[1])
            state, inserted = _NEXT[state], inserted + 1
    return out


def compose(left: Matrix, right: Matrix) -> Matrix:
    """Min-plus product: cheapest, then ASCII-least audit of one after the other.

    Letters of equal rows decide, so the least of a whole is made of least parts.
    """
    out: Matrix = []
    for row in left:
        line: list[tuple[int, Rope] | None] = []
        for after in range(STATES):
            best = None
            ways = [(a[0] + b[after][0], a[1], b[after][1])
                    for a, b in zip(row, right, strict=True) if a and b[after]]
            least = min((w[0] for w in ways), default=0)
            for cost, one, two in ways:
                if cost == least:
                    rope = Rope(parts=(one, two))
                    if best is None or rope < best[1]:
                        best = cost, rope
            line.append(best)
        out.append(line)
    return out


#: Inserts after the last row, by state.
_END = [(0, ""), (2 * _INSERT, "II"), (_INSERT, "I"), (0, "")]


class Grammar:
    """Re-Pair rules over row symbols: rule i stands for the pair ``rules[i]``."""

    def __init__(self, rules: tuple[tuple[int, int], ...] = ()) -> None:
        self.rules = rules
        self.terminals = 3 * len(_ROLES)

    def more(self, pairs: list[tuple[int, int]]) -> Grammar:
        return Grammar(self.rules + tuple(pairs))

    def replace(self, flat: np.ndarray, owner: np.ndarray, rules: range):
        """Put rules for pairs within each sequence, from the left, in their order."""
        for i in rules:
            a, b = self.rules[i]
            hit = (flat[:-1] == a) & (flat[1:] == b) & (owner[:-1] == owner[1:])
            at = np.flatnonzero(hit)
            if a == b and len(at):
                # In a run of one symbol every other pair overlaps the one before.
                run = np.concatenate([[0], np.flatnonzero(np.diff(at) > 1) + 1])
                lead = np.repeat(at[run], np.diff(np.append(run, len(at))))
                at = at[(at - lead) % 2 == 0]
            if len(at):
                flat = flat.copy()
                flat[at] = self.terminals + i
                keep = np.ones(len(flat), bool)
                keep[at + 1] = False
                flat, owner = flat[keep], owner[keep]
        return flat, owner

    def matrices(self) -> list[Matrix]:
        out = [row_matrix(code) for code in range(self.terminals)]
        for a, b in self.rules:
            out.append(compose(out[a], out[b]))
        return out


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat, np.repeat(np.arange(len(sizes)), sizes)


def _lists(flat: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    offsets = np.searchsorted(owner, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def _rewritten(grammar: Grammar, rules: range):
    """Sequences with the rules of a round put in."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, owner = grammar.replace(*_flat(batch.column("symbols")), rules)
            yield pa.RecordBatch.from_pydict({
                "sequence": batch.column("sequence"),
                "symbols": _lists(flat, owner, batch.num_rows),
            })

    return read


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent symbols and how often they stand so, without overlaps in runs."""
    for batch in batches:
        flat, owner = _flat(batch.column("symbols"))
        if len(flat) < 2:
            continue
        hit = owner[:-1] == owner[1:]
        same = hit & (flat[:-1] == flat[1:])
        # Of a run of equal pairs every other one counts.
        at = np.arange(len(same))
        start = np.maximum.accumulate(np.where(same, -1, at))
        hit &= ~same | ((at - start) % 2 == 1)
        pair = (flat[:-1][hit].astype(np.int64) << 32) | flat[1:][hit]
        pairs, n = np.unique(pair, return_counts=True)
        yield pa.RecordBatch.from_pydict({"pair": pairs, "n": n.astype(np.int64)})


def _chosen(counted: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The most frequent pairs, each of symbols that no pair before it touches."""
    used: set[int] = set()
    out = []
    for pair, _ in counted:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        if a not in used and b not in used:
            out.append((a, b))
            used |= {a, b}
    return out


def pair_up(sequences: DataFrame) -> tuple[Grammar, DataFrame]:
    """A grammar of ``sequences(sequence, symbols)``, and these written in it.

    Each round counts adjacent symbols over all sequences in Spark; the most frequent
    pairs that do not compete become rules.  So the driver holds rules alone, at most
    ``_RULES`` for each of ``_ROUNDS`` rounds, whatever the sequences.
    """
    grammar, written = Grammar(), sequences
    for _ in range(_ROUNDS):
        counted = (
            written.mapInArrow(_pairs, "pair long, n long")
            .groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= _LEAST)
            .orderBy(F.desc("n"), "pair").limit(_RULES).collect()
        )
        if not counted:
            break
        known = len(grammar.rules)
        grammar = grammar.more(_chosen([tuple(r) for r in counted]))
        rules = range(known, len(grammar.rules))
        written = stage(
            written.mapInArrow(_rewritten(grammar, rules), "sequence string, symbols array<int>"),
            "paired",
        )
    return grammar, written


_SEQUENCE = (
    "sequence string, costs array<long>, orders array<int>, audits array<string>, "
    "alone_cost long, alone_audit string, first string, last string, illegal long"
)
_LEGAL = ("su", "ua", "au")


def _product(matrices: list[Matrix]) -> Matrix:
    """The product of a chain, halved until it is one, so ropes stay shallow."""
    while len(matrices) > 1:
        paired = [compose(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)]
        matrices = paired + matrices[2 * len(paired) :]
    return matrices[0]


def _evaluated(matrices):
    """Sequences to the costs, audits and order of audits between all states.

    For conversations of one block, also the cheapest edits from start to end.
    """

    def one(sequence: str, symbols: list[int]) -> tuple:
        rows = _product([matrices.value[s] for s in symbols])
        ways = [way or (_NEVER, None) for row in rows for way in row]
        audits = [None if rope is None else str(rope) for _, rope in ways]
        orders = []
        for before in range(STATES):
            texts = audits[STATES * before : STATES * (before + 1)]
            ordered = sorted(t for t in texts if t is not None)
            orders += [STATES if t is None else ordered.index(t) for t in texts]
        alone = min(
            (cost + more, audits[after] + end)
            for after, ((cost, rope), (more, end)) in enumerate(zip(ways, _END, strict=False))
            if rope is not None
        )
        roles = "".join(_ROLES[(ord(c) - 65) // 3] for c in sequence)
        illegal = sum(a + b not in _LEGAL for a, b in zip(roles, roles[1:], strict=False))
        return (sequence, [cost for cost, _ in ways], orders, audits, *alone, roles[0], roles[-1], illegal)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("sequence", "symbols")), strict=True)
            columns = list(zip(*(one(*row) for row in rows), strict=True))
            if columns:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA
                )

    return read


_SCHEMA = pa.schema([
    ("sequence", pa.string()), ("costs", pa.list_(pa.int64())), ("orders", pa.list_(pa.int32())),
    ("audits", pa.list_(pa.string())), ("alone_cost", pa.int64()), ("alone_audit", pa.string()),
    ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()),
])


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of conversations in order to the cell each takes; the first has the cost.

    From the last block back, the cost still to come from each state; then forward, the
    cheapest way on, ties to the block's least audit.  A block is some forty numbers.
    """

    def rows():
        names = ("conv", "block", "sequence", "costs", "orders", "first", "last", "illegal")
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)

    for conv, blocks in groupby(rows(), key=lambda r: r[0]):
        _, block, sequence, costs, orders, first, last, illegal = zip(*blocks, strict=True)
        n = len(block)
        costs = np.array(costs, np.int64).reshape(n, STATES, STATES)
        to_go = np.zeros((n + 1, STATES), np.int64)
        to_go[n] = [cost for cost, _ in _END]
        for i in range(n - 1, -1, -1):
            to_go[i] = np.minimum((costs[i] + to_go[i + 1]).min(1), _NEVER)
        state, cells = _START, []
        for i in range(n):
            ways = costs[i, state] + to_go[i + 1]
            best = np.flatnonzero(ways == ways.min())
            after = int(min(best, key=lambda j: orders[i][STATES * state + j]))
            cells.append(STATES * state + after)
            state = after
        borders = sum(a + b not in _LEGAL for a, b in zip(last, first[1:], strict=False))
        rest = [0] * (n - 1)
        yield pa.RecordBatch.from_pydict({
            "conv": pa.array([conv] * n, pa.string()), "block": pa.array(block, pa.int64()),
            "sequence": pa.array(sequence, pa.string()), "cell": pa.array(cells, pa.int32()),
            "cost": pa.array([int(to_go[0, _START]), *rest], pa.int64()),
            "illegal": pa.array([sum(illegal) + borders, *rest], pa.int64()),
            "end": pa.array([""] * (n - 1) + [_END[state][1]], pa.string()),
        })


class _Repaired:
    """The hash of a conversation as its audit leaves it, row by row."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, _START
        self.hash, self.said = sha256(), False

    def _say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.said else "") + f"{role}:{text}").encode())
        self.said = True

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._turn(None, "")

    def _turn(self, role: str | None, text: str) -> None:
        self.state = _NEXT[self.state] if role is None else _SPEAKS[role[0]][1]
        self._say(role if role is not None else _SPEAKER[self.state], text)

    def row(self, role: str, text: str) -> None:
        self._insert()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            self._turn(role if letter == "K" else None, text)

    def hexdigest(self) -> str:
        self._insert()
        return self.hash.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations in order, each led by its audit, to the repaired hash.

    A stream: the audit and the hash so far are all that is held of a conversation.
    """
    conv = digest = None
    for batch in batches:
        done: list[tuple[str, str]] = []
        columns = (batch.column(c).to_pylist() for c in ("conv", "role", "text", "audit"))
        for name, role, text, audit in zip(*columns, strict=True):
            if audit is not None:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = name, _Repaired(audit)
            else:
                digest.row(role, text)
        yield _named(done)
    if digest is not None:
        yield _named([(conv, digest.hexdigest())])


def _named(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "conv": pa.array([p[0] for p in pairs], pa.string()),
        "repaired_sha256": pa.array([p[1] for p in pairs], pa.string()),
    })


def damage(rows: DataFrame) -> DataFrame:
    """Damage ``rows(conv_id, turn, role, text)`` by a checksum of id and turn.

    Of twenty remainders, 0 drops the row, 1 empties its text, 2 removes its final
    marks, 3 repeats it, 4 gives it the role user.  A null counts as one blank.
    """
    plain = rows.select(
        "conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    )
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    dealt = plain.withColumn("_d", F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20)
    return dealt.where("_d <> 0").select(
        "conv_id", "turn",
        F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_d") == 1, "")
        .when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_n"),
    ).drop("_n")


_SAID = ["said1", "said2"]


def _in_order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), *(F.asc(c) for c in _SAID)]


def _keyed(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows with a key of the conversation that is never null, and one of what is said."""
    blank = F.lit(" ")
    given = rows.select(
        _conv(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), blank).alias("role"), F.coalesce(F.col(text_col), blank).alias("text"),
    )
    return given.select(
        "*", *(F.xxhash64(F.lit(seed), "role", "text").alias(c) for seed, c in zip((5, 77), _SAID, strict=True))
    )


def _conv(conv_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("null"))


def _faults(keyed: DataFrame) -> DataFrame:
    """Every row without its text: conv, turn, fault and symbol, numbered in order.

    Equal rows are counted map-side before they are dealt out again, and the first of
    each role and text is a minimum, so rows that repeat by the million meet in no task.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(_BLANKS))
    alike = ["conv", "turn", "role", *_SAID]
    light = keyed.select(
        *alike, (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    light = stage(
        light.groupBy(*alike, "blank", "truncated").agg(F.count("*").alias("copies")), "said"
    )
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first")
    repeated = stage(
        light.groupBy("conv", *_SAID).agg(first, F.count("*").alias("turns")).where("turns > 1")
        .select("conv", *_SAID, F.lit(True).alias("again"), F.col("first.turn").alias("first_turn")),
        "repeated",
    )
    later = F.coalesce("again", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    rows = join_small(light, repeated, ["conv", *_SAID]).select("*", later.alias("later"), copy)
    initial = F.substring("role", 1, 1)
    role = F.coalesce(
        *(F.when(initial == r, i) for i, r in enumerate(_ROLES[:-1])), F.lit(len(_ROLES) - 1)
    )
    fault = F.when(F.col("blank"), "blank").when(F.col("later") | (F.col("copy") > 1), "duplicate").when(
        F.col("truncated"), "truncated")
    code = F.when(fault.isNull(), 0).when(fault == "truncated", 1).otherwise(2)
    ordered = rows.select(*alike, "copy", fault.alias("fault"), (3 * role + code).alias("symbol"))
    order = [F.asc("conv"), *_in_order(), F.asc("copy")]
    return stage(
        ordered.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv", "turn", "fault", "symbol", F.monotonically_increasing_id().alias("at")),
        "faults",
    )


def _blocks(faults: DataFrame) -> DataFrame:
    """Runs of rows of a conversation as sequences of symbols, in bounded blocks."""
    symbols = F.array_sort(F.collect_list(F.struct("at", F.chr(F.col("symbol") + 65).alias("c"))))
    return faults.groupBy("conv", F.shiftright("at", _BLOCK_BITS).alias("block")).agg(
        F.array_join(F.transform(symbols, lambda x: x["c"]), "").alias("sequence")
    )


def _evaluate(blocks: DataFrame) -> DataFrame:
    """Each distinct sequence once, through a grammar that all share."""
    symbols = F.transform(F.split("sequence", ""), lambda c: F.ascii(c) - 65)
    sequences = stage(blocks.select("sequence").distinct().select("sequence", symbols.alias("symbols")), "sequences")
    grammar, written = pair_up(sequences)
    matrices = blocks.sparkSession.sparkContext.broadcast(grammar.matrices())
    return stage(written.mapInArrow(_evaluated(matrices), _SEQUENCE), "evaluated")


def repair(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """The cheapest edits that give each conversation the form ``(s?(ua)+)?``.

    One row per conversation: ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``.  Rows go by turn, nulls
    first, then by role and a hash of role and text.  A row is blank, else a duplicate
    (role and text stood before), else truncated (its last character is no ``.!?``).
    Keep costs 0, a new role 3, Delete 4 (a must for blank and duplicate rows), an
    inserted empty row 3, and a truncated row that stays 3 more.  ``audit`` has the
    initials of the edits in order, of the cheapest ones the ASCII-least; the repaired
    rows, as lines ``role:text``, are hashed.

    A row becomes a symbol of role and fault, a conversation one sequence (a long one
    several, of bounded size).  Distinct sequences are compressed by one grammar of
    repeated pairs, found by counting in Spark.  Each rule has a matrix of the cheapest
    way between any two states and its audit, a rope shared by the rules above; they
    are made bottom-up once and handed to all tasks, where a sequence is the product of
    few of them.  Blocks of long conversations meet as numbers only.  Texts move once,
    for the hash, which is a chain by nature: it runs as a stream through one task per
    conversation and holds none of it but the audit.

    Null roles and texts are one blank, null conversations are one; null turns are no
    turns for ``gaps``.  An empty table gives no rows.  Other columns are not read.
    """
    keyed = _keyed(rows, conv_col, turn_col, role_col, text_col)
    faults = _faults(keyed)
    block = F.shiftright("at", _BLOCK_BITS)
    counts = stage(
        faults.groupBy("conv").agg(
            *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
            (F.min(block) < F.max(block)).alias("split"),
        ), "counts",
    )
    blocks = stage(_blocks(faults), "blocks")
    evaluated = _evaluate(blocks)
    parts = blocks.join(counts.select("conv", "split"), "conv")
    whole = join_small(
        parts.where("not split").select("conv", "sequence"),
        evaluated.select("sequence", "alone_cost", "illegal", "alone_audit"), "sequence", "inner",
    ).select("conv", F.col("alone_cost").alias("cost"), "illegal", F.col("alone_audit").alias("audit"))
    routed = stage(
        join_small(
            parts.where("split").drop("split"),
            evaluated.drop("audits", "alone_cost", "alone_audit"), "sequence", "inner",
        ).repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(
            _routes,
            "conv string, block long, sequence string, cell int, cost long, illegal long, end string",
        ), "routes",
    )
    piece = F.concat(F.element_at("audits", F.col("cell") + 1), F.col("end"))
    pieces = F.array_sort(F.collect_list(F.struct("block", piece.alias("audit"))))
    joined = join_small(routed, evaluated.select("sequence", "audits"), "sequence", "inner").groupBy("conv").agg(
        F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"),
        F.array_join(F.transform(pieces, lambda x: x["audit"]), "").alias("audit"),
    )
    edits = stage(whole.unionAll(joined), "edits")
    none = F.lit(None).cast("string")
    lines = keyed.select("conv", "turn", "role", *_SAID, "text", none.alias("audit")).unionAll(
        edits.select(
            "conv", F.lit(None).cast("long"), none, *(F.lit(None).cast("long") for _ in _SAID), none, "audit"
        )
    )
    digests = lines.repartition("conv").sortWithinPartitions(
        "conv", F.col("audit").isNull(), *_in_order()
    ).select("conv", "role", "text", "audit").mapInArrow(_digests, "conv string, repaired_sha256 string")
    return counts.drop("split").join(edits, "conv").join(digests, "conv")


def with_absent(found: DataFrame, conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``found`` for every conversation, also those that have no rows left."""
    named = conversations.select(F.col(conv_col)).distinct().withColumn("conv", _conv(conv_col))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in
            ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return named.join(found, "conv", "left").select(
        conv_col, *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
