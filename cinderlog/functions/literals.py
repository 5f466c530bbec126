"""One pass over a text tells which patterns can match it at all.

A pattern that matches contains one of a few literals; these are read off its syntax tree. An
Aho-Corasick automaton over the literals of many patterns finds all of them in one pass over
a text and gives a bitmap with a bit for each pattern, which gates the pattern: where the bit is not set,
the pattern isn't tried. Where one is found, the alternatives of the pattern are looked at more closely: one of them must
have all its literals, those at a line's start after a newline. A gate is a necessary condition, so results don't change.

Literals are compared without case. For patterns that ignore case, the four other characters whose
case folds to an ASCII letter count as that letter, as they do for java.util.regex.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce
from operator import or_
from re import _constants as op
from re import _parser as syntax

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that equal an ASCII letter when case is ignored.
_FOLDED = str.maketrans({"ſ": "s", "K": "k", "İ": "i", "ı": "i"})
_BITS = 62
_REPEATS = tuple(getattr(op, x) for x in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"))
_ZERO_WIDTH = (op.AT, op.ASSERT, op.ASSERT_NOT)


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLDED).lower()


def _char(code: int) -> str | None:
    """A literal's character; none where folding it isn't as simple as for ASCII."""
    c = chr(code)
    return folded(c) if code < 128 or c in "ſKİı" else c if c.lower() == c.upper() else None


def _good(literals: frozenset[str] | None) -> bool:
    return bool(literals) and all(len(x) > 1 or x > "\x7f" for x in literals)


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets of which each suffices, the one whose shortest literal is longer, then the smaller one."""
    if not _good(a) or not _good(b):
        return a if _good(a) else b if _good(b) else None
    rank = lambda x: (min(map(len, x)), -len(x))
    return a if rank(a) >= rank(b) else b


def _of_sequence(items: Sequence) -> frozenset[str] | None:
    best: frozenset[str] | None = None
    run = ""

    def end() -> None:
        nonlocal best, run
        best, run = _better(best, frozenset([run]) if run else None), ""

    def walk(items: Sequence) -> None:
        nonlocal best, run
        for kind, value in items:
            inner = None
            if kind is op.LITERAL and (c := _char(value)) is not None:
                run += c
            elif kind is op.IN and len(c := {_char(v) if k is op.LITERAL else None for k, v in value}) == 1 and None not in c:
                run += c.pop()
            elif kind is op.SUBPATTERN:
                walk(value[3])
            elif kind is op.ATOMIC_GROUP:
                walk(value)
            elif kind not in _ZERO_WIDTH:
                end()
                if kind is op.BRANCH:
                    parts = [_of_sequence(x) for x in value[1]]
                    inner = frozenset().union(*parts) if all(map(_good, parts)) else None
                elif kind in _REPEATS and value[0] > 0:
                    inner = _of_sequence(value[2])
                best = _better(best, inner)

    walk(items)
    end()
    return best


def required(pattern: str) -> frozenset[str] | None:
    """Lower-case literals of which every match contains one; none if the pattern has no such set."""
    try:
        return _of_sequence(syntax.parse(pattern.replace(r"\z", r"\Z"), re.IGNORECASE | re.MULTILINE))
    except re.error:
        return None


def _candidates(items: Sequence, lead: str = "") -> list[frozenset[str]]:
    """Sets of each of which a match has a literal; a line's start counts as a newline before it, lead as what comes right before."""
    found: list[frozenset[str]] = []
    run = lead

    def walk(items: Sequence) -> None:
        nonlocal run
        for kind, value in items:
            if kind is op.AT and value is op.AT_BEGINNING:
                run = run or "\n"
            elif kind is op.LITERAL and (c := _char(value)) is not None:
                run += c
            elif kind is op.IN and len(c := {_char(v) if k is op.LITERAL else None for k, v in value}) == 1 and None not in c:
                run += c.pop()
            elif kind is op.SUBPATTERN:
                walk(value[3])
            elif kind is op.ATOMIC_GROUP:
                walk(value)
            elif kind not in _ZERO_WIDTH:
                before, run = run, ""
                found.append(frozenset([before]))
                if kind is op.BRANCH:
                    parts = [reduce(_better, _candidates(x, before), None) for x in value[1]]
                    found.append(frozenset().union(*parts) if all(map(_good, parts)) else frozenset())
                elif kind in _REPEATS and value[0] > 0:
                    found.extend(_candidates(value[2]))

    walk(items)
    return [x for x in [*found, frozenset([run])] if _good(x)]


class Literals(frozenset):
    """A set of literals with the pattern's alternatives: of each the sets that a match by it has a literal of."""

    branches: tuple[tuple[frozenset[str], ...], ...] = ()


def literals(pattern: str) -> Literals | None:
    """required(), with the alternatives where each has a set."""
    found = required(pattern)
    if found is None:
        return None
    items, out = syntax.parse(pattern.replace(r"\z", r"\Z"), re.IGNORECASE | re.MULTILINE), Literals(found)
    branches = items[0][1][1] if len(items) == 1 and items[0][0] is op.BRANCH else [items]
    sets = tuple(tuple(_candidates(x)) for x in branches)
    out.branches = sets if all(sets) else ()
    return out


def whole(pattern: str) -> frozenset[str]:
    """The alternatives of a pattern that are nothing but ASCII, in lower case: a text with one has a match, if case is ignored."""
    try:
        items = syntax.parse(pattern.replace(r"\z", r"\Z"), re.IGNORECASE | re.MULTILINE)
    except re.error:
        return frozenset()
    branches = items[0][1][1] if len(items) == 1 and items[0][0] is op.BRANCH else [items]
    plain = [x for x in branches if len(x) and all(kind is op.LITERAL and value < 128 for kind, value in x)]
    return frozenset(folded("".join(chr(value) for _, value in x)) for x in plain)


class Prefilter:
    """Bitmaps of which of several literal sets a text has a literal of; a set of none counts as met.

    In a set's place may be a compiled pattern of one class of characters: whether the text has a match.
    """

    def __init__(self, sets: Sequence[frozenset[str] | re.Pattern | None], fold: bool = True) -> None:
        self.sets, self.fold = list(sets), fold

    @classmethod
    def of_patterns(cls, patterns: Sequence[str]) -> Prefilter:
        return cls([literals(x) for x in patterns])

    def column(self, text: Column) -> Column:
        """The bitmap of a text, null for null.

        Declared non-deterministic, so that Spark neither runs it again for each gate nor moves filters
        on what the gates lead to below it, where all that comes before it would run twice.
        """
        sets, fold, words = self.sets, self.fold, -(-len(self.sets) // _BITS)

        @F.arrow_udf("array<bigint>")
        def bits(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            find = scanner(sets, fold)
            for part in parts:
                yield pa.array([None if x is None else find(x, words) for x in part.to_pylist()], pa.list_(pa.int64()))

        return bits.asNondeterministic()(text)

    @staticmethod
    def columns(wanted: Sequence[tuple[Prefilter, Column]]) -> Column:
        """The bitmaps of two texts or more as an array, each by its own prefilter, in one pass: Spark would give each column() workers of its own."""
        each = [(x.sets, x.fold, -(-len(x.sets) // _BITS)) for x, _ in wanted]

        @F.arrow_udf("array<array<bigint>>")
        def bits(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            find = [(scanner(sets, fold), words) for sets, fold, words in each]
            for texts in parts:
                rows = zip(*(x.to_pylist() for x in texts), strict=True)
                yield pa.array([[None if x is None else f(x, n) for x, (f, n) in zip(row, find, strict=True)] for row in rows], pa.list_(pa.list_(pa.int64())))

        return bits.asNondeterministic()(*(text for _, text in wanted))

    def some(self, bits: Column) -> Column:
        """Whether any gate is open."""
        return F.lit(True) if None in self.sets else F.exists(bits, lambda x: x != 0)

    def gates(self, bits: Column) -> list[Column]:
        """A condition for each set: whether a text with this bitmap has a literal of it."""
        return [F.lit(True) if x is None else F.get(bits, F.lit(i // _BITS)).bitwiseAND(F.lit(1 << i % _BITS).cast("long")) != 0 for i, x in enumerate(self.sets)]


def scanner(sets: Sequence[frozenset[str] | re.Pattern | None], fold: bool) -> Callable[[str, int], list[int]]:
    """A function that gives a text's bitmap, from an automaton built once."""
    import ahocorasick

    bits: dict[str, int] = {}
    for literals in sets:
        if not isinstance(literals, re.Pattern):
            for x in (*(literals or ()), *(x for branch in getattr(literals, "branches", ()) for of in branch for x in of)):
                bits.setdefault(x, 1 << len(bits))
    # the text's start is a line's start, too
    starts = {x: 1 << len(bits) + i for i, x in enumerate(x for x in bits if x[:1] == "\n")}
    tests = [(1 << i, x.search) for i, x in enumerate(sets) if isinstance(x, re.Pattern)]
    automaton = ahocorasick.Automaton()
    for x, bit in bits.items():
        # a literal that contains another one is found with it
        automaton.add_word(x, bit)
    if bits:
        automaton.make_automaton()
    low = (1 << _BITS) - 1

    def mask(of: frozenset[str], at_start: bool) -> int:
        return reduce(or_, (bits[x] | (starts.get(x, 0) if at_start else 0) for x in of), 0)

    gates = [
        (1 << i, mask(x, False), [[mask(of, True) for of in branch] for branch in getattr(x, "branches", ())])
        for i, x in enumerate(sets) if x is not None and not isinstance(x, re.Pattern)
    ]

    @lru_cache(maxsize=1 << 12)
    def opened(found: int) -> int:
        """The gates that the literals found open; texts with the same literals are many."""
        # one literal was found; a match has one of every set of an alternative
        return reduce(or_, (gate for gate, some, branches in gates if found & some and (not branches or any(all(found & of for of in branch) for branch in branches))), 0)

    at_start = [(x[1:], bit) for x, bit in starts.items()]

    def find(text: str, words: int) -> list[int]:
        found = 0
        if fold:
            text = folded(text)
        if bits:
            for _, bit in automaton.iter(text):
                found |= bit
        for x, bit in at_start:
            if text.startswith(x):
                found |= bit
        found = opened(found)
        for gate, search in tests:
            if search(text):
                found |= gate
        return [found >> _BITS * i & low for i in range(words)]

    return find
