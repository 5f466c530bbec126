"""Quality rules: base counts, then robust multivariate outliers by language and source.

Every text gets counts; their transformed shares form a vector. For each language and
source the minimum-covariance-determinant estimate of mean and covariance is found by
concentration steps: each keeps the share H of the rows that lie nearest by Mahalanobis
distance and estimates again from them, until the determinant no longer falls. There are
two starts, the coordinatewise medians with absolute deviations and the plain moments;
the one whose end has the smaller determinant counts. A text is rejected when its
squared distance, made consistent by the median, is beyond LIMIT.

Groups with fewer than LEAST_ROWS texts that passed the base rules use the estimate of
their language, and languages with fewer use that of all texts. The three levels are
estimated together: a row counts for its group, its language and all, in aggregates that
are added up before the shuffle, so a source that holds a third of all rows is never
gathered. Rows meet estimates by broadcast while these are few, else by a salted join.

Vectors are kept as whole multiples of 1/1024, so sums are exact whatever their order.
The nearest rows are found by counts of distances in steps of 1/32 of their logarithm, so
a step keeps H of the rows or up to the end of that step's bin.

Cases: null or empty text has no words and fails the base rules; null lang and source are
groups of their own; ties in the distance fall on the kept side; repeated rows are judged
alike; an empty table gives an empty result; texts are read whole; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm._text import cut, map_arrow, windows, word_hashes

WINDOW_WORDS = 8
SYMBOLS = "#*$%&|<>"
H = 0.75
#: Concentration steps at most; a group's end earlier once its determinant no longer falls.
STEPS = 20
LEAST_ROWS = 100
#: Squared distance beyond which a text is rejected; 6 normal coordinates exceed it once in 400,000.
LIMIT = 36.0
#: Median of a chi-squared variable of 6 degrees of freedom.
MEDIAN = 5.348
#: Estimates that are broadcast at most, each under 1 kB; beyond, rows are joined in SALTS parts of each group.
BROADCAST_ROWS, SALTS = 20_000, 64
UNIT = 1024
#: Standard deviations added to each coordinate, so that constant ones don't count as infinitely narrow.
FLOOR = (0.05, 0.05, 0.10, 0.15, 0.15, 0.10)
NAMES = ("word_length", "symbol_share", "upper_share", "dup_line_share", "repeat_share", "stutter_share")
_SPACE = " \t\n\r\x0b\x0c"


def counts(text: str, words: np.ndarray) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_stutters of a text."""
    chars = len(text) - sum(map(text.count, _SPACE))
    seen: set[str] = set()
    lines = repeated = 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            lines += 1
            repeated += line in seen
            seen.add(line)
    again = 0
    if len(words) > WINDOW_WORDS:
        _, inverse, n = np.unique(windows(words, WINDOW_WORDS), return_inverse=True, return_counts=True)
        often = n[inverse] > 1
        if often.any():
            edge = np.zeros(len(words) + 1, np.int64)
            edge[: len(often)] += often
            edge[WINDOW_WORDS : WINDOW_WORDS + len(often)] -= often
            again = int((np.cumsum(edge)[:-1] > 0).sum())
    ascii_upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    stutters = int((words[1:] == words[:-1]).sum())  # words equal to the one before
    return len(words), chars, sum(map(text.count, SYMBOLS)), repeated, again, lines, ascii_upper, stutters


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, and the vector v of every row."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        _mark().alias("mark"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = [counts(t, w) for t, w in zip(texts, word_hashes([t.encode() for t in texts], False), strict=True)]
            n = np.array(own, np.int64).reshape(-1, 8)
            words, chars, symbols, repeated, again, lines, upper, stutters = n.T
            vector = np.stack([
                np.log(np.maximum(chars, 1) / np.maximum(words, 1)), np.sqrt(symbols / np.maximum(chars, 1)), np.sqrt(upper / np.maximum(chars, 1)),
                np.sqrt(repeated / np.maximum(lines, 1)), np.sqrt(again / np.maximum(words, 1)), np.sqrt(stutters / np.maximum(words, 1)),
            ], 1)
            out = {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "source": batch.column("source"), "mark": batch.column("mark")}
            out |= {"n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": repeated, "n_repeat_words": again}
            out["base_failed"] = (words < 20) | (100 * again > 30 * words)
            yield out | {"v": list(np.rint(vector * UNIT).astype(np.int64))}

    return map_arrow(rows, run, "doc_id long, mark long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, v array<long>")


DIM = len(NAMES)
_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
_GROUP = ["level", "lang", "source"]
_RUN = [*_GROUP, "start"]


def _at_levels(rows: DataFrame) -> DataFrame:
    """A row for each level: its language and source (0), its language (1), all (2)."""
    at = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source"))
    levels = F.array(at(0, F.col("lang"), F.col("source")), at(1, F.col("lang"), F.lit("")), at(2, F.lit(""), F.lit("")))
    return rows.select("v", F.xxhash64("v").alias("salt"), F.explode(levels).alias("g")).select("v", "salt", "g.*")


def _attach(rows: DataFrame, found: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """rows, which have a salt, with the columns of found; few: found has BROADCAST_ROWS rows at most, by count."""
    if few:
        return rows.join(F.broadcast(found), keys, how)
    parts = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("part", F.pmod("salt", F.lit(SALTS)).cast("int")).join(parts, [*keys, "part"], how).drop("part")


def _moments() -> list[Column]:
    """Count, sums and sums of products, as columns n, m0, m1 ..., which add up."""
    x = [F.col("v")[i] for i in range(DIM)]
    return [F.count("*").alias("n"), *(F.sum(c).alias(f"m{k}") for k, c in enumerate([*x, *(x[i] * x[j] for i, j in _PAIRS)]))]


def _sums(rows: DataFrame) -> DataFrame:
    """For each run n, s, q: rows' moments added up."""
    m = [F.sum(f"m{k}") for k in range(DIM + len(_PAIRS))]
    return rows.groupBy(*_RUN).agg(F.sum("n").alias("n"), F.array(*m[:DIM]).alias("s"), F.array(*m[DIM:]).alias("q"))


def shape(n: int, s: list[int], q: list[int]) -> tuple[list[float], list[float], float]:
    """Mean, inverse covariance (pairs, off-diagonal twice) and the covariance's log-determinant."""
    m = np.array(s, float) / n
    c = np.diag((np.array(FLOOR) * UNIT) ** 2)
    for (i, j), value in zip(_PAIRS, q, strict=True):
        c[i, j] += value / n - m[i] * m[j]
        c[j, i] = c[i, j]
    p = np.linalg.inv(c)
    return m.tolist(), [p[i, j] * (1 if i == j else 2) for i, j in _PAIRS], float(np.linalg.slogdet(c)[1])


def _invert(rows: DataFrame) -> DataFrame:
    """Mean, inverse and log-determinant from rows of n, s, q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [shape(*x) for x in zip(*(batch.column(x).to_pylist() for x in ("n", "s", "q")), strict=True)]
            yield {k: batch.column(k) for k in _RUN} | {"mean": [x[0] for x in found], "inverse": [x[1] for x in found], "logdet": [x[2] for x in found]}

    return map_arrow(rows.select(*_RUN, "n", "s", "q"), run, "level int, lang string, source string, start int, mean array<double>, inverse array<double>, logdet double")


def _distance() -> Column:
    d = [F.col("v")[i] - F.col("mean")[i] for i in range(DIM)]
    return sum((d[i] * d[j] * F.col("inverse")[k] for k, (i, j) in enumerate(_PAIRS)), F.lit(0.0))


def _bin() -> Column:
    """Squared distances in steps of 1/32 of their logarithm: under 1,200 bins whatever the rows."""
    return F.floor(F.log(F.least(F.greatest(_distance(), F.lit(1e-4)), F.lit(1e12))) * 32).cast("int")


def _upto(bins: DataFrame, share: float) -> DataFrame:
    """Of each run's bins (run, bin, n), those up to the first by which it has this share of its rows."""
    run = Window.partitionBy(*_RUN)
    bins = bins.withColumns({"upto": F.sum("n").over(run.orderBy("bin")), "total": F.sum("n").over(run)})
    return bins.where(F.col("upto") - F.col("n") < F.ceil(F.col("total") * share))


def _starts(rows: DataFrame) -> DataFrame:
    """Both starts of every group: start, mean, inverse. rows: what _at_levels gives."""
    middles = cut(rows.groupBy(*_GROUP).agg(F.array(*(F.percentile(F.col("v")[i], F.lit(0.5)) for i in range(DIM))).alias("m")))
    centred = _attach(rows, middles, _GROUP, middles.count() <= BROADCAST_ROWS)
    spread = centred.groupBy(*_GROUP).agg(*(F.percentile(F.abs(F.col("v")[i] - F.col("m")[i]), F.lit(0.5)).alias(f"d{i}") for i in range(DIM)))
    variance = [F.pow(F.lit(1.4826) * F.col(f"d{i}"), 2) + F.lit((FLOOR[i] * UNIT) ** 2) for i in range(DIM)]
    robust = middles.join(spread, _GROUP).select(*_GROUP, F.lit(0).alias("start"), F.col("m").alias("mean"), F.array(*(1 / variance[i] if i == j else F.lit(0.0) for i, j in _PAIRS)).alias("inverse"))
    plain = _invert(_sums(rows.groupBy(*_GROUP).agg(*_moments()).withColumn("start", F.lit(1)))).select(*_RUN, "mean", "inverse")
    return cut(robust.unionByName(plain))


def estimates(passed: DataFrame) -> DataFrame:
    """level, lang, source, n, mean, inverse, factor of each group: lang, source, v of the texts that passed the base rules, keys never null."""
    rows = _at_levels(passed)
    state = cut(_starts(rows).withColumns({"logdet": F.lit(float("inf")), "live": F.lit(True)}))
    few = state.count() <= BROADCAST_ROWS
    for _ in range(STEPS):
        now = state.where("live").select(*_RUN, "mean", "inverse")
        # one pass over the rows: their moments by bin, of which the nearest bins' are added up
        bins = _attach(rows, now, _GROUP, few).withColumn("bin", _bin()).groupBy(*_RUN, "bin").agg(*_moments())
        found = _invert(_sums(_upto(bins, H))).select(*_RUN, *(F.col(x).alias(f"{x}_new") for x in ("mean", "inverse", "logdet")))
        falls = F.coalesce(F.col("live") & (F.col("logdet_new") < F.col("logdet") - 1e-9), F.lit(False))
        taken = (F.when(falls, F.col(f"{x}_new")).otherwise(F.col(x)).alias(x) for x in ("mean", "inverse", "logdet"))
        ended = state.join(found, _RUN, "left").select(*_RUN, *taken, falls.alias("live"))
        state = cut(ended.coalesce(8) if few else ended)
        if state.where("live").isEmpty():
            break
    best = cut(state.groupBy(*_GROUP).agg(F.min_by(F.struct("start", "mean", "inverse"), F.struct("logdet", "start")).alias("x")).select(*_GROUP, "x.*"))
    bins = _attach(rows, best, _GROUP, few).withColumn("bin", _bin()).groupBy(*_RUN, "bin").agg(F.count("*").alias("n"))
    mid = _upto(bins, 0.5).groupBy(*_RUN).agg(F.max("bin").alias("mid"))
    n = rows.groupBy(*_GROUP).agg(F.count("*").alias("n"))
    # a factor over 1 would widen distances where most texts are alike
    return cut(best.join(mid, _RUN).join(n, _GROUP).select(*_GROUP, "n", "mean", "inverse", F.least(F.lit(1.0), MEDIAN / F.exp((F.col("mid") + 1) / 32)).alias("factor")))


def _chosen(rows: DataFrame, found: DataFrame) -> DataFrame:
    """For each lang and source the estimate it is judged by: the first of its levels with LEAST_ROWS texts."""
    groups = _at_levels(rows.select("lang", "source").distinct().withColumns({"v": F.struct("lang", "source")}))
    enough = found.where(F.col("n") >= LEAST_ROWS).drop("n")
    return cut(groups.join(enough, _GROUP).groupBy("v.lang", "v.source").agg(F.min_by(F.struct("mean", "inverse", "factor"), "level").alias("x")).select("lang", "source", "x.*"))


def judge(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance."""
    return _judged(documents).drop("mark")


def _judged(documents: DataFrame) -> DataFrame:
    rows = cut(statistics(documents).withColumns({"lang": F.coalesce("lang", F.lit("\0")), "source": F.coalesce("source", F.lit("\0"))}))
    found = estimates(rows.where(~F.col("base_failed")).select("lang", "source", "v"))
    chosen = _chosen(rows, found)
    judged = _attach(rows.withColumn("salt", F.xxhash64("v")), chosen, ["lang", "source"], chosen.count() <= BROADCAST_ROWS, "left")
    distance = F.coalesce(_distance() * F.col("factor"), F.lit(0.0))
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", "mark", *counted, "base_failed", (~F.col("base_failed") & (distance <= LIMIT)).alias("kept"), distance.alias("distance"))


def keep(documents: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns; rows go by doc_id, text, lang and source."""
    kept = _judged(documents).where("kept").select(F.col("doc_id").alias("kept_id"), "mark").distinct()
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), _mark().alias("own"))
    return rows.join(kept, rows["id"].eqNullSafe(kept["kept_id"]) & (rows["own"] == kept["mark"]), "left_semi").select("row.*")


def _mark() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("lang").cast("string"), F.col("source").cast("string"))
