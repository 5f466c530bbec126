"""Regular expressions on columns with Unicode classes and newline-only line ends.

Spark's functions compile patterns for Java, whose defaults differ from what the rules
mean: U makes \\w, \\s, \\b and case Unicode-aware, d makes the newline the only line end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Private-use characters that mark matches; logs don't have them.
MARK = "\ue000"


def rx(pattern: str, flags: str = "") -> str:
    return f"(?dU{flags})" + pattern


def replace(text: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    return F.regexp_replace(text, F.lit(rx(pattern, flags)), F.lit(replacement))


def count(text: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(text, F.lit(rx(pattern, flags)))


def matches(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(rx(pattern, flags))


#: What \\s matches under U: Unicode's White_Space.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Text without white space at its ends, newlines and Unicode spaces included."""
    return F.btrim(text, F.lit(SPACES))


def split_matches(text: Column, pattern: str, flags: str = "") -> Column:
    """The text's parts: those with odd index are the matches, the others what lies between."""
    return F.split(replace(text, pattern, f"{MARK}$0{MARK}", flags), MARK, -1)


def hit_lines(text: Column, pattern: str, flags: str = "") -> Column:
    """Zero-based numbers of the lines in which matches start, ascending."""
    lines = F.split(replace(text, pattern, f"{MARK}$0", flags), "\n", -1)
    numbered = F.transform(lines, lambda x, i: F.when(F.contains(x, F.lit(MARK)), i))
    return F.filter(numbered, lambda x: x.isNotNull())


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value named once, however often f uses it.

    A chain of such steps is one expression that grows by addition, and one projection: a projection for
    each step would let the optimiser's inferred constraints double at each of them under a filter.
    """
    return F.element_at(F.transform(F.array(value), f), 1)


def nonempty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def last_lines(lines: Column, n: int) -> Column:
    return F.slice(lines, F.greatest(F.lit(1), F.size(lines) - (n - 1)), F.lit(n))
