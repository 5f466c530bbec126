"""Noise removal and the first error that explains a failure."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog import rules
from cinderlog.functions import regex
from cinderlog.functions.literals import Prefilter
from cinderlog.functions.numbers import rounded
from cinderlog.settings import DEFAULTS, Settings


def _cleaner(pattern: str, flags: str, replacement: str) -> Callable[[Column], Column]:
    literal = rules.CLEANER_LITERALS.get(pattern)

    def one(x: Column) -> Column:
        done = regex.replace(x, pattern, replacement, flags)
        return done if literal is None else F.when(F.contains(x, F.lit(literal)), done).otherwise(x)

    return one


def cleaned(text: Column) -> Column:
    """The text without runner decoration: each substitution on what those before it left, where its literal occurs."""
    for cleaner in rules.CLEANERS:
        text = regex.let(text, _cleaner(*cleaner))
    return regex.strip(text)


def clean(df: DataFrame, column: str, out: str = "cleaned") -> DataFrame:
    """Adds `out`: the text without runner decoration."""
    return df.withColumn(out, cleaned(F.col(column)))


def prefilter() -> Prefilter:
    """Which families a text may belong to."""
    return Prefilter.of_patterns([pattern for _, pattern, _ in rules.FAMILIES])


def family(text: Column, gates: Sequence[Column] | None = None) -> Column:
    """The first error family that the text matches, null without any; gates: which of them are tried."""
    gates = gates or [F.lit(True)] * len(rules.FAMILIES)

    def first(t: Column) -> Column:
        chosen = F.lit(None).cast("string")
        for (name, pattern, flags), gate in reversed(list(zip(rules.FAMILIES, gates, strict=True))):
            chosen = F.when(gate & regex.matches(t, pattern, flags), F.lit(name)).otherwise(chosen)
        return chosen

    return regex.let(text, first)


def families(df: DataFrame, column: str = "cleaned", out: str = "family") -> DataFrame:
    """Adds `out` as family() gives it; only families of which the text has a literal are tried."""
    found, bits = prefilter(), f"__{out}_bits"
    df = df.withColumn(bits, found.column(F.col(column)))
    return df.withColumn(out, family(F.col(column), found.gates(F.col(bits)))).drop(bits)


def exit_code(text: Column) -> Column:
    """The number of the last exit-code phrase."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(regex.rx(rules.EXIT_CODE, "i")), F.lit(1)), F.lit(-1)).cast("int")


def last_meaningful(lines: Column) -> Column:
    """The last line of over ten characters that isn't blank or a shell echo, else the last short one."""
    stripped = F.filter(F.transform(lines, regex.strip), lambda x: (x != "") & ~F.substring(x, 1, 1).isin("$", "+", "#"))
    long = F.try_element_at(F.filter(stripped, lambda x: F.length(x) > 10), F.lit(-1))
    return regex.head(F.coalesce(long, F.try_element_at(stripped, F.lit(-1))), 500)


def _by_family(family_: Column, value: dict[str, Column], otherwise: Column) -> Column:
    for name, column in value.items():
        otherwise = F.when(family_ == name, column).otherwise(otherwise)
    return otherwise


def extracted(text: Column, gates: Sequence[Column] | None = None, settings: Settings = DEFAULTS) -> Column:
    """struct of excerpt and its lines, error_block, stack_trace, ecosystem, exit_code, error_message, matched_lines, total_lines.

    Line numbers count the text's lines from 1.
    """
    context, none = settings.excerpt_context_lines, F.array().cast("array<int>")

    def with_hits(x: Column) -> Column:
        hits = _by_family(x["family"], {name: regex.hit_lines(x["text"], pattern, flags) for name, pattern, flags in rules.FAMILIES}, none)
        return F.struct(x["text"].alias("text"), x["family"].alias("family"), F.split(x["text"], "\n", -1).alias("lines"), hits.alias("hits"))

    def with_window(x: Column) -> Column:
        first, last, total = F.try_element_at(x["hits"], F.lit(1)), F.try_element_at(x["hits"], F.lit(-1)), F.size(x["lines"])
        fields = [x[k].alias(k) for k in ("text", "family", "lines", "hits")]
        return F.struct(*fields, first.alias("first"), F.greatest(first - context, F.lit(0)).alias("start"), F.least(total, last + (context + 1)).alias("end"), total.alias("total"))

    def result(x: Column) -> Column:
        lines, total, first, start = x["lines"], x["total"], x["first"], x["start"]
        long = x["end"] - start > 400
        end = F.when(long, F.least(total, first + 200)).otherwise(x["end"])
        found = first.isNotNull()
        window = F.array_join(F.slice(lines, start + 1, end - start), "\n")
        window = F.when(long, F.concat(window, F.lit("\n…\n"), F.array_join(regex.last_lines(lines, 40), "\n"))).otherwise(window)
        tail = F.right(F.array_join(regex.last_lines(lines, 120), "\n"), F.lit(settings.max_log_chars))
        traces = {name: regex.nonempty(F.regexp_extract(x["text"], regex.rx(p, "m"), 0)) for name, p in rules.STACK_TRACES.items()}
        value = F.struct(
            F.when(found, regex.head(window, settings.max_log_chars)).otherwise(tail).alias("excerpt"),
            F.when(found, start + 1).otherwise(F.greatest(total - 120, F.lit(0)) + 1).alias("excerpt_start_line"),
            F.when(found, end).otherwise(total).alias("excerpt_end_line"),
            F.when(found, F.array_join(F.slice(lines, first + 1, F.lit(30)), "\n")).alias("error_block"),
            regex.head(_by_family(x["family"], traces, F.lit(None).cast("string")), 4000).alias("stack_trace"),
            x["family"].alias("ecosystem"),
            exit_code(x["text"]).alias("exit_code"),
            F.when(found, regex.nonempty(regex.head(regex.strip(F.get(lines, first)), 500))).otherwise(last_meaningful(lines)).alias("error_message"),
            F.transform(F.slice(x["hits"], 1, 50), lambda y: y + 1).alias("matched_lines"),
            total.alias("total_lines"),
        )
        return F.when(x["text"].isNotNull(), value)

    value = regex.let(text, lambda t: F.struct(t.alias("text"), family(t, gates).alias("family")))
    return regex.let(regex.let(regex.let(value, with_hits), with_window), result)


def extract(df: DataFrame, column: str = "cleaned", out: str = "extraction", settings: Settings = DEFAULTS, gates: Sequence[Column] | None = None) -> DataFrame:
    """Adds struct `out` as extracted() gives it; gates: which families are tried, where the caller knows."""
    if gates is not None:
        return df.withColumn(out, extracted(F.col(column), gates, settings))
    found, bits = prefilter(), f"__{out}_bits"
    df = df.withColumn(bits, found.column(F.col(column)))
    return df.withColumn(out, extracted(F.col(column), found.gates(F.col(bits)), settings)).drop(bits)


def reduction_ratio(original_chars: Column, excerpt_chars: Column) -> Column:
    """How much of a log the excerpt leaves out, to four decimals."""
    return rounded(1 - excerpt_chars / F.greatest(original_chars, F.lit(1)), 4)
