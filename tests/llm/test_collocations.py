"""Phrase collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import collocations
from ledgerloom.llm.collocations import Sizes

FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows, longest=5, least=100, first=2000):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    many = {k: a for k, a in counts.items() if a >= least}
    inner = {}
    for (lang, words), a in many.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                key = lang, words[i : i + n]
                inner[key] = max(inner.get(key, 0), a)
    found = {}
    for (lang, words), a in many.items():
        if len(words) < 2 or inner.get((lang, words), 0) >= a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words), left, right))
    return sorted(
        (lang, rank, phrase, -a, left, right, total[lang], -score)
        for lang, rows in found.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows, key=lambda r: (*r[:2], r[2].encode()))[:first], 1)
    )


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "a", "é", "ß", "İ", "x" * 40, "y" * 300, "-", "it's", "\x01", "z"]
    passage = "in the beginning there was New York, and it was of a kind; so it was"
    out = []
    for _ in range(150):
        text = "".join(
            rng.choice(words) + rng.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", "!?"])
            for _ in range(rng.randint(0, 120))
        )
        out.append((rng.choice(["en", "en", "de", None]), text))
    out += [("en", f"{passage}. {rng.choice(words)}") for _ in range(120)]
    out += [("en", None), (None, None), ("en", ""), ("de", " .,"), ("fr", "again " * 3000), ("fr", "one two")]
    return out + out[:3]


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "lang string, text string")
    df = df.withColumns({"group": F.lit(1), "n": F.lit("x"), "chunk": F.lit(0.5)})
    result = collocations.collocations(df, **more)
    assert result.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in result.collect())


@pytest.mark.parametrize(("seed", "sizes"), [(1, Sizes()), (2, Sizes(part=64, period=3, most=4))])
def test_collocations(spark, seed, sizes):
    rows = corpus(seed)
    assert found(spark, rows, sizes=sizes) == brute(rows)


def test_other_bounds(spark):
    rows = corpus(3)
    assert found(spark, rows, longest=3, least=20, first=7) == brute(rows, 3, 20, 7)
    assert found(spark, rows, longest=2, least=5) == brute(rows, 2, 5)
    assert found(spark, []) == []


def test_scores_beyond_64_bits(spark):
    """Exact quotients of products that no long holds."""
    a, n, parts = 3_000_000_007, 9_000_000_000_000_011, (4_000_000_009, 5_000_000_029)
    row = spark.range(1).select(
        F.lit(a).alias("a"), F.lit(n).alias("total"), F.lit(parts[0]).alias("l"), F.lit(parts[1]).alias("r")
    ).select(collocations.score().alias("s")).first()
    assert row.s == 1000 * a * n // (parts[0] * parts[1])


def test_each_phrase_starts_in_one_chunk():
    rng = random.Random(9)
    words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(5000)]
    text = "".join(w + (". " if rng.random() < 0.1 else " ") for w in words).encode()
    for sizes in (Sizes(), Sizes(part=500, period=5, most=6)):
        counted = Counter()
        for piece in collocations._parts(text, 4, sizes.part):
            chunks, own = collocations._chunks_of_part(*piece, 5, sizes)
            for chunk, n in zip(chunks, own, strict=True):
                marked = re.findall(rb"[^ \n]+|\n", chunk)
                at = 0
                for i, w in enumerate(marked):
                    if w != b"\n" and at < n:
                        run = marked[i : i + 5]
                        counted[b" ".join(run[: run.index(b"\n")] if b"\n" in run else run)] += 1
                    at += w != b"\n"
        want = Counter()
        for sentence in text.split(b"."):
            run = sentence.split()
            want.update(b" ".join(run[i : i + 5]) for i in range(len(run)))
        assert counted == want
    assert np.all(own >= 1)
