"""Secrets out of text: rules in order, each on the output of those before it."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog import rules
from cinderlog.functions import regex
from cinderlog.functions.literals import Prefilter
from cinderlog.functions.vector import shannon_entropy
from cinderlog.settings import DEFAULTS, Settings


def _is_email_secret(x: Column) -> Column:
    return ~regex.matches(x, rules.EMAIL_ALLOWED, "i")


def _is_random(x: Column, threshold: float) -> Column:
    return ~regex.matches(x, rules.ENTROPY_EXCLUDED, "i") & (shannon_entropy(x) >= threshold)


#: Two rules look for runs of 32 such characters at least, as the rule of 40 does.
_LONG_RUN = r"[A-Za-z0-9+/=_\-]{32}"
#: A run of the original, lower-cased text that may come to be as long: rules only shorten runs, but for the = that env_secret appends.
_RUN_BEFORE = re.compile(r"[a-z0-9+/=_\-]{31}")


def prefilter(chain: Sequence[rules.Redaction]) -> Prefilter:
    """Which rules' literals a lower-cased text has, and last whether it has a long run.

    aws_secret needs such a run, another rule without literals is always tried; rules of a caller's own may make runs.
    """
    runs = _RUN_BEFORE if all(x in rules.REDACTIONS for x in chain) else None
    return Prefilter([*(frozenset(x.literals) or (runs if x.name == "aws_secret" else None) for x in chain), runs], fold=False)


def _after(x: Column, text: Column, hits: Column, name: str) -> Column:
    return F.struct(text.alias("text"), (x["count"] + hits.cast("int")).alias("count"), F.array_append(x["types"], F.lit(name)).alias("types"))


def _step(rule: rules.Redaction, gate: Column) -> Callable[[Column], Column]:
    """What a rule makes of (text, count, types)."""

    def replaced(x: Column) -> Column:
        if rule.name == "email":
            return _parts_step(x, regex.split_matches(x["text"], rule.pattern, rule.flags), _is_email_secret, rule.replacement, rule.name)
        text = regex.replace(x["text"], rule.pattern, rule.replacement, rule.flags)
        return regex.let(regex.count(x["text"], rule.pattern, rule.flags), lambda n: F.when(n > 0, _after(x, text, n, rule.name)).otherwise(x))

    def step(x: Column) -> Column:
        tried = gate & regex.matches(x["text"], _LONG_RUN) if rule.name == "aws_secret" else gate
        return F.when(tried, replaced(x)).otherwise(x)

    return step


def _parts_step(x: Column, parts: Column, hit: Callable[[Column], Column], replacement: str, name: str) -> Column:
    """x after the matches among parts for which hit holds are replaced."""

    def replaced(marked: Column) -> Column:
        n = F.size(F.filter(marked, lambda y: y["hit"]))
        text = F.array_join(F.transform(marked, lambda y: F.when(y["hit"], F.lit(replacement)).otherwise(y["part"])), "")
        return F.when(n > 0, _after(x, text, n, name)).otherwise(x)

    marked = F.transform(parts, lambda y, i: F.struct(y.alias("part"), ((i % 2 == 1) & hit(y)).alias("hit")))
    return regex.let(marked, replaced)


def redacted(text: Column, found: Prefilter, bits: Column, chain: Sequence[rules.Redaction] = tuple(rules.REDACTIONS), strict: bool | Column = True, settings: Settings = DEFAULTS) -> Column:
    """struct<text, count, types>; found and bits: the chain's prefilter and what it found, which tells the rules to try."""
    *gates, runs = found.gates(bits)

    def rewritten(value: Column) -> Column:
        for rule, gate in zip(chain, gates, strict=True):
            value = regex.let(value, _step(rule, gate))
        if strict is not False:
            wanted = runs & (F.lit(strict) if isinstance(strict, bool) else strict)
            random = lambda y: _is_random(y, settings.entropy_threshold)
            entropy = lambda x: _parts_step(x, regex.split_matches(x["text"], rules.ENTROPY_CANDIDATE), random, "[REDACTED_HIGH_ENTROPY]", "high_entropy")
            value = regex.let(value, lambda x: F.when(wanted & regex.matches(x["text"], _LONG_RUN), entropy(x)).otherwise(x))
        return regex.let(value, lambda x: F.struct(x["text"].alias("text"), x["count"].alias("count"), F.array_sort(x["types"]).alias("types")))

    value = F.struct(text.alias("text"), F.lit(0).alias("count"), F.array().cast("array<string>").alias("types"))
    return regex.let(value, lambda x: F.when(found.some(bits), rewritten(x)).otherwise(x))


def redact(df: DataFrame, column: str, out: str = "redaction", strict: bool | Column = True, chain: Sequence[rules.Redaction] = tuple(rules.REDACTIONS), settings: Settings = DEFAULTS) -> DataFrame:
    """Adds struct `out` (text, count, types): all rules in one expression, each on what those before it left.

    Literals are looked for in the original text, in one pass for all rules. A failing row fails the task: no
    partly redacted text leaves. Null stays null.
    """
    found, bits = prefilter(chain), f"__{out}_bits"
    df = df.withColumn(bits, found.column(F.lower(F.col(column))))
    return df.withColumn(out, redacted(F.col(column), found, F.col(bits), chain, strict, settings)).drop(bits)


def redact_request(df: DataFrame, settings: Settings = DEFAULTS, redact_all: bool = True, more: dict[str, tuple[Prefilter, Column]] | None = None) -> DataFrame:
    """A request's texts redacted in place: log excerpt, error block, stack trace, commit message, patches and source windows.

    One pass finds the rules' literals, in the excerpt and in all the others, and the bitmaps `more`, by name, of
    texts as they come; these are added. Without redact_all only the excerpt is redacted.
    """
    none = F.array().cast("array<string>")
    patches, windows = F.coalesce(F.col("pipeline.changed_files.patch"), none), F.coalesce(F.col("source_context.content"), none)
    texts = F.concat(F.array("error_block", "stack_trace", F.col("pipeline.commit_message")), patches, windows) if redact_all else none
    found, columns = prefilter(rules.REDACTIONS), df.columns
    df = df.withColumn("__texts", texts)
    wanted = {"__excerpt_bits": (found, F.lower(F.col("log_excerpt"))), "__bits": (found, F.lower(F.array_join("__texts", "\n")))} | (more or {})
    df = df.withColumn("__found", Prefilter.columns(list(wanted.values()))).withColumns({name: F.get("__found", F.lit(i)) for i, name in enumerate(wanted)})
    df = df.withColumn("log_excerpt", redacted(F.col("log_excerpt"), found, F.col("__excerpt_bits"), strict=settings.strict_redaction, settings=settings)["text"])
    if not redact_all:
        return df.select(*columns, *(more or ()))
    # one expression for all texts: a copy of it for each would be planned again and again
    df = df.withColumn("__clean", F.transform("__texts", lambda x: redacted(x, found, F.col("__bits"), strict=settings.strict_redaction, settings=settings)["text"]))
    at = lambda i: F.get(F.col("__clean"), i)
    files = F.transform(F.col("pipeline.changed_files"), lambda x, i: x.withField("patch", at(i + 3)))
    pipeline = F.col("pipeline").withField("commit_message", at(F.lit(2))).withField("changed_files", files)
    n = F.size(patches)
    windows = F.transform(F.col("source_context"), lambda x, i: x.withField("content", at(i + 3 + n)))
    return df.withColumns({"error_block": at(F.lit(0)), "stack_trace": at(F.lit(1)), "pipeline": pipeline, "source_context": windows}).select(*columns, *(more or ()))
