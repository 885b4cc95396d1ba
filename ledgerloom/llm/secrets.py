"""Find secrets with a trigram inverted index, then verify candidates by regex."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tables import KEY, aside, join_small, row_key
from ledgerloom.session import stage

#: At most this many strings are kept while a regex is read; beyond it the part
#: read so far turns into its trigrams.
_MAX_STRINGS = 64
_TREE = re._parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and how long a group of the match must be."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base rules of the contract.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
)

#: Published forms of access tokens and keys.
MORE_RULES = (
    Rule("hub", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


# A query is True (no demand), a trigram, or ("and" | "or", parts).


def _both(kind: str, parts):
    parts = list(dict.fromkeys(parts))
    if kind == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif True in parts:
        return True
    else:
        # What asks for more than another part adds nothing to a choice.
        asks = {p: frozenset(p[1]) if p[0] == "and" else frozenset([p]) for p in parts}
        parts = [p for p in parts if not any(asks[o] < asks[p] for o in parts)]
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _demand(strings) -> object:
    """What a text must hold if it holds one of ``strings``."""
    return _both("or", [
        _both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)
    ])


def _read(tokens) -> tuple[set[str] | None, object]:
    """The exact strings a pattern matches (None if unknown) and its demand."""
    strings, demand = {""}, True
    tokens = list(tokens)
    for i, (op, value) in enumerate(tokens):
        part, need = _read_one(str(op), value)
        demand = _both("and", [demand, need])
        if part is None or len(strings) * len(part) > _MAX_STRINGS:
            rest, more = _read(tokens[i + 1 :])
            known = [s for s in (strings, part, rest) if s is not None]
            return None, _both("and", [demand, more, *map(_demand, known)])
        strings = {a + b for a, b in product(strings, part)}
    return strings, demand


def _read_one(op: str, value) -> tuple[set[str] | None, object]:
    if op == "LITERAL":
        return {chr(value).lower()}, True
    if op == "IN":
        if all(str(o) == "LITERAL" for o, _ in value):
            return {chr(v).lower() for _, v in value}, True
        return None, True
    if op == "SUBPATTERN":
        return _read(value[3])
    if op == "BRANCH":
        read = [_read(branch) for branch in value[1]]
        if all(s is not None for s, _ in read):
            return set().union(*(s for s, _ in read)), True
        needs = [_both("and", [d, _demand(s) if s is not None else True]) for s, d in read]
        return None, _both("or", needs)
    if op == "MAX_REPEAT" and value[:2] == (0, 1):
        strings, _ = _read(value[2])
        return (strings | {""} if strings is not None else None), True
    if op == "MAX_REPEAT" and value[0] >= 1:
        strings, demand = _read(value[2])
        return None, _both("and", [demand, _demand(strings) if strings is not None else True])
    return None, True


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query every text with a match of ``pattern`` satisfies.

    Trigrams are of the lower-cased text, so that letter case asks for no more
    strings.  ``True`` means that the pattern demands none, as when it begins with
    an unbounded class: such a rule has to scan all texts.
    """
    strings, demand = _read(_TREE.parse(pattern))
    return _both("and", [demand, _demand(strings) if strings is not None else True])


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*(trigrams(p) for p in query[1]))


def build_index(docs: DataFrame, wanted: Sequence[str], text_col: str, key: Sequence[str]) -> DataFrame:
    """Postings ``(trigram, key...)`` of the wanted trigrams in whole lower-cased texts.

    Only trigrams some rule asks for are posted; a list may name every text, and
    stays rows, never an array.
    """
    held = F.filter(
        F.array(*map(F.lit, sorted(wanted))), lambda t: F.contains(F.col("_lower"), t)
    )
    return (
        docs.withColumn("_lower", F.lower(text_col))
        .select(*key, F.explode(held).alias("trigram"))
        .distinct()
    )


def intersect(index: DataFrame, queries: dict[str, object], key: Sequence[str]) -> DataFrame:
    """Evaluate Boolean queries on postings: ``key...`` and one flag for each query.

    Lists are intersected by grouping the postings of a text, which combines
    map-side; texts that satisfy no query give no row.
    """
    leaves = sorted(set().union(*(trigrams(q) for q in queries.values())))
    names = {t: f"_t{i}" for i, t in enumerate(leaves)}

    def holds(query) -> Column:
        if isinstance(query, str):
            return F.col(names[query])
        parts = [holds(p) for p in query[1]]
        return reduce(lambda a, b: a & b if query[0] == "and" else a | b, parts)

    found = index.groupBy(*key).agg(
        *(F.bool_or(F.col("trigram") == t).alias(n) for t, n in names.items())
    )
    flags = found.select(*key, *(holds(q).alias(k) for k, q in queries.items()))
    return flags.where(reduce(lambda a, b: a | b, (F.col(k) for k in queries)))


def _spans(text: Column, rule: Rule) -> Column:
    """All (start, end) of a rule in code points, leftmost and without overlap.

    The pieces between matches and the matches themselves come from the same
    scan order, so running lengths of both give the places.
    """
    pattern = F.lit(rule.pattern)
    pairs = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, 0), F.length).alias("length"),
        F.transform(F.regexp_extract_all(text, pattern, rule.group), F.length).alias("size"),
    )
    empty = F.array().cast("array<struct<start:int,end:int,size:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(state, pair):
        begin = state["at"] + pair["gap"]
        end = begin + F.coalesce(pair["length"], F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"), pair["size"].alias("size"))
        # The last piece has no match behind it.
        grown = F.when(
            pair["length"].isNotNull() & (pair["size"] >= rule.least),
            F.concat(state["spans"], F.array(span)),
        ).otherwise(state["spans"])
        return F.struct(end.alias("at"), grown.alias("spans"))

    return F.aggregate(pairs, start, step, lambda s: s["spans"])


def _named(number: int, kind: str):
    return lambda s: F.struct(
        s["start"].alias("start"), F.lit(number).alias("rule"),
        F.lit(kind).alias("kind"), s["end"].alias("end"),
    )


def of_kinds(secrets: Column, kinds: Sequence[str]) -> Column:
    return F.filter(secrets, lambda s: s["kind"].isin(list(kinds)))


def _quick(rule: Rule, text: Column) -> Column:
    """Whether a text can hold a match, for rules that scan all texts."""
    return F.regexp_like(text, F.lit(f"{rule.pattern.removesuffix('+')}{{{rule.least}}}")) if (
        rule.group == 0 and rule.pattern.endswith("]+") and rule.pattern.startswith("[")
    ) else F.lit(True)


def find_secrets(
    docs: DataFrame,
    rules: Sequence[Rule] = BASE_RULES + MORE_RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Add ``secrets``: an array of (start, rule, kind, end), sorted by start, then rule.

    Trigram queries are derived from the rules; texts that satisfy a rule's query
    are its candidates, and only those meet its regex.  A rule whose query demands
    nothing scans all texts.  Rows with the same id and text have the same result.
    Null and empty texts have no secrets; an empty table gives no rows.  An input
    column named ``secrets`` is replaced.
    """
    inner = [*KEY, "_lower", *(f"_has_{r.kind}" for r in rules)]
    docs, back = aside(docs, ["secrets"], inner, [id_col, text_col])
    keyed = docs.select("*", *row_key(id_col, text_col))
    queries = {f"_has_{r.kind}": trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    wanted = set().union(*(trigrams(q) for q in indexed.values())) if indexed else set()
    if indexed:
        index = build_index(keyed, wanted, text_col, KEY)
        candidates = stage(intersect(index, indexed, KEY), "candidates")
        keyed = join_small(keyed, candidates, KEY)
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,size:int>>")
    found = []
    for number, rule in enumerate(rules):
        may = F.col(f"_has_{rule.kind}") if f"_has_{rule.kind}" in indexed else _quick(rule, text)
        spans = F.when(may, _spans(text, rule)).otherwise(none)
        found.append(F.transform(spans, _named(number, rule.kind)))
    return keyed.select(*back, F.array_sort(F.concat(*found)).alias("secrets"))


def joined(secrets: Column) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    return F.array_join(
        F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
