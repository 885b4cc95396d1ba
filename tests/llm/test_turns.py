"""Conversation repair against all possible edits, and its grammar against plain products."""

from __future__ import annotations

import random
import re
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")
NAMES = {1: "user", 2: "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if x is None else x for x in (role, text))
        dealt = zlib.crc32(key.encode()) % 20
        if dealt == 1:
            text = ""
        if dealt == 2:
            text = re.sub("[.!?]", "", text)
        if dealt == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(dealt, 1)
    return out


def step(state, role):
    """0 nothing said, 1 system, 2 user, 3 assistant; None where the form forbids it."""
    if role == "s":
        return 1 if state == 0 else None
    if role == "u":
        return 2 if state != 2 else None
    return 3 if role == "a" and state == 2 else None


def cheapest(roles, faults):
    """Every row in turn, with the best (cost, audit) of each state; inserts are free to go on."""
    ways = {0: (0, "")}

    def inserted(ways):
        ways = dict(ways)
        for _ in range(4):
            for state, (cost, audit) in list(ways.items()):
                for role in "ua":
                    to = step(state, role)
                    if to is not None:
                        new = cost + 3, audit + "I"
                        ways[to] = min(ways.get(to, new), new)
        return ways

    for role, fault in zip(roles, faults, strict=True):
        after = {}
        for state, (cost, audit) in inserted(ways).items():
            more = 3 if fault == "truncated" else 0
            options = [(state, 4, "D")]
            if fault not in ("blank", "duplicate"):
                options += [(step(state, role[:1]), more, "K")]
                options += [(step(state, r), 3 + more, "R") for r in "ua"]
            for to, extra, letter in options:
                if to is not None:
                    new = cost + extra, audit + letter
                    after[to] = min(after.get(to, new), new)
        ways = after
    ways = inserted(ways)
    return min(ways[s] for s in (0, 3) if s in ways)


def repaired(rows, audit):
    out, state, rows = [], 0, iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = step(state, row[2][:1])
            out.append(f"{row[2]}:{row[3]}")
        else:
            state = 3 if state == 2 else 2
            out.append(f"{'assistant' if state == 3 else 'user'}:{row[3] if row else ''}")
    return "\n".join(out)


def brute(given, order):
    result = []
    rows = damaged(given)
    for conv in {r[0] for r in given}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], order[r[2], r[3]]))
        seen, faults = set(), []
        for _, _, role, text in own:
            if not BLANK.search(text):
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            else:
                faults.append(None if BLANK.findall(text)[-1] in ".!?" else "truncated")
            seen.add((role, text))
        roles = [r[2] for r in own]
        known = [r[1] for r in own if r[1] is not None]
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        cost, audit = cheapest(roles, faults)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in repaired(own, audit).split("\n") if ":" in x)) or "\n" in "".join(r[3] for r in own)
        result.append((
            conv, max(known) - min(known) + 1 - len(set(known)) if known else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            sha256(repaired(own, audit).encode()).hexdigest(),
        ))
    return sorted(result, key=repr)


def order_of(spark, given):
    said = {(r[2], r[3]) for r in damaged(given)}
    df = spark.createDataFrame(sorted(said), "role string, text string")
    hashed = df.select("role", "text", *(F.xxhash64(F.lit(s), "role", "text") for s in (5, 77)))
    return {(r[0], r[1]): (r[2], r[3]) for r in hashed.collect()}


def conversations(seed, n, longest):
    rng = random.Random(seed)
    texts = ["Well.", "No!", "why", "so (", " ", "", None, "Yes?  ", "a\nb.", "é…", "Right. \n"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "usher", "User"]
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(roles) if rng.random() < 0.3 else roles[turn % 2]
            out.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role,
                        rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    return out


def found(spark, given):
    df = spark.createDataFrame(given, SCHEMA).withColumn("conv", F.lit(1)).withColumn("audit", F.lit("x"))
    result = turns.with_absent(turns.repair(turns.damage(df)), df)
    return sorted((tuple(r) for r in result.collect()), key=repr)


CASES = [
    *conversations(1, 60, 9),
    (None, 1, "user", "Hello."), (None, 2, "assistant", "Hi."), (None, None, None, None),
    *[(1000, t, "user", "again and again.") for t in range(40)],
    *[(1001, 7, "assistant", "one turn.")] * 30,
    *[(1002, None, "user", "no turn.")] * 3,
    (1003, 1, "system", "be kind"), (1004, 5, "user", "x" * 5000),
    *[(1005, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(300)],
]


@pytest.mark.parametrize("bits", [12, 2])
def test_repair(spark, monkeypatch, bits):
    monkeypatch.setattr(turns, "_BLOCK_BITS", bits)
    assert found(spark, CASES) == brute(CASES, order_of(spark, CASES))


def test_no_conversations(spark):
    assert found(spark, CASES[:0] or []) == []


def test_rules_give_the_products_of_their_symbols():
    rng = random.Random(5)
    symbols = [rng.choice([0, 3, 6, 3, 6, 4, 8, 9]) for _ in range(400)]
    plain = turns._product([turns.row_matrix(s) for s in symbols])
    step_by_step = turns.row_matrix(symbols[0])
    for s in symbols[1:]:
        step_by_step = turns.compose(step_by_step, turns.row_matrix(s))
    for a, b in zip(plain, step_by_step, strict=True):
        assert [(w[0], str(w[1])) if w else None for w in a] == [(w[0], str(w[1])) if w else None for w in b]


def test_grammar_is_lossless(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ADGAD") for _ in range(rng.randint(1, 30))) for _ in range(200)] + ["A" * 77]
    df = spark.createDataFrame(
        [(t, [ord(c) - 65 for c in t]) for t in texts], "sequence string, symbols array<int>"
    )
    grammar, written = turns.pair_up(df)
    assert grammar.rules

    def spelled(symbol):
        if symbol < grammar.terminals:
            return chr(65 + symbol)
        return "".join(map(spelled, grammar.rules[symbol - grammar.terminals]))

    rows = written.collect()
    assert sorted(r.sequence for r in rows) == sorted(texts)
    assert all("".join(map(spelled, r.symbols)) == r.sequence for r in rows)
    assert sum(len(r.symbols) for r in rows) < sum(map(len, texts)) / 2
