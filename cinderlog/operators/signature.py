"""Signatures: a hash of the error without what varies from run to run."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog import rules
from cinderlog.functions import regex
from cinderlog.functions.literals import Prefilter
from cinderlog.settings import DEFAULTS, Settings


def basis(error_block: Column, error_message: Column, cleaned: Column) -> Column:
    """What a signature is made from: the first of these that isn't empty, or the text's end."""
    return F.coalesce(regex.nonempty(error_block), regex.nonempty(error_message), F.right(cleaned, F.lit(2000)))


def prefilter() -> Prefilter:
    """Which of NORMALISER_RUNS' patterns a text has."""
    return Prefilter([re.compile(x) for x in dict.fromkeys(rules.NORMALISER_RUNS.values())])


def _normaliser(pattern: str, flags: str, token: str, gate: Column | None) -> Callable[[Column], Column]:
    literal = rules.NORMALISER_LITERALS.get(pattern)

    def one(x: Column) -> Column:
        done = regex.replace(x, pattern, token, flags)
        if literal is not None:
            done = F.when(F.contains(x, F.lit(literal)), done).otherwise(x)
        return done if gate is None else F.when(gate, done).otherwise(x)

    return one


def normalised(text: Column, settings: Settings = DEFAULTS, gates: Sequence[Column] | None = None) -> Column:
    """The text with ids, times, paths and the like made tokens; gates: prefilter()'s of the text or of one that it is a part of.

    Numbers that tell errors apart are parked in numbered slots meanwhile and put back.
    """
    tried = dict(zip(dict.fromkeys(rules.NORMALISER_RUNS.values()), gates, strict=True)) if gates else {}
    slot = lambda i: F.concat(F.lit("\0PM"), ((i - 1) / 2).cast("int").cast("string"), F.lit("\0"))

    def park(parts: Column) -> Column:
        text = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, slot(i)).otherwise(x)), "")
        return F.struct(text.alias("text"), F.filter(parts, lambda x, i: i % 2 == 1).alias("parked"))

    def tokens(x: Column) -> Column:
        text = x["text"]
        for normaliser in rules.NORMALISERS:
            text = regex.let(text, _normaliser(*normaliser, tried.get(rules.NORMALISER_RUNS.get(normaliser[0]))))
        return F.struct(text.alias("text"), x["parked"].alias("parked"))

    def restore(x: Column) -> Column:
        n = F.size(x["parked"])
        indices = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(indices, x["text"], lambda text, i: F.replace(text, F.concat(F.lit("\0PM"), i.cast("string"), F.lit("\0")), F.get(x["parked"], i)))

    start = regex.head(regex.strip(text), settings.signature_chars)
    parts = regex.split_matches(start, rules.MEANINGFUL_NUMBER, "i")
    restored = regex.let(regex.let(regex.let(parts, park), tokens), restore)
    return F.lower(regex.strip(regex.replace(restored, r"\s+", " ")))


def normalise(df: DataFrame, column: str, out: str = "normalised", settings: Settings = DEFAULTS, gates: Sequence[Column] | None = None) -> DataFrame:
    """Adds `out`: the text as normalised() gives it."""
    return df.withColumn(out, normalised(F.col(column), settings, gates))


def signature_hash(ecosystem: Column, normalised: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(regex.nonempty(ecosystem), F.lit("unknown")), F.lit("::"), normalised), 256)


def rollup(signed: DataFrame) -> DataFrame:
    """A row for each team and hash: how often, in how many projects, first and last seen.

    signed: team_id, project_id, ts, signature_hash. Counts add up before the shuffle.
    """
    return signed.groupBy("team_id", "signature_hash").agg(
        F.count("*").alias("occurrence_count"), F.count_distinct("project_id").alias("projects_affected"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at")
    )


def histogram(rolled: DataFrame) -> DataFrame:
    """How many signatures occurred how often."""
    return rolled.groupBy("occurrence_count").agg(F.count("*").alias("signatures"))
