"""Documents to overlapping chunks of paragraphs, and what gets embedded."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions import regex
from cinderlog.settings import DEFAULTS, Settings

_LOG = logging.getLogger(__name__)
Encoder = Callable[[list[str]], np.ndarray]


def estimate_tokens(text: Column, settings: Settings = DEFAULTS) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / settings.chars_per_token).cast("int"))


def split_oversized(paragraph: Column, size: int, step: int) -> Column:
    """Slices of `size` characters, one every `step`; the last may lie within the one before."""
    return F.transform(F.sequence(F.lit(1), F.length(paragraph), F.lit(step)), lambda i: F.substring(paragraph, i, F.lit(size)))


def overlap_tail(text: Column, chars: int) -> Column:
    """The last characters of a chunk, from the first word that begins there."""
    if chars <= 0:
        return text
    tail = F.right(text, F.lit(chars))
    space = F.instr(tail, " ")
    return F.when(F.length(text) <= chars, text).when(space > 0, F.substring(tail, space + 1, F.lit(chars))).otherwise(tail)


def chunks(text: Column, target_tokens: int | None = None, overlap_tokens: int | None = None, settings: Settings = DEFAULTS) -> Column:
    """array<struct<index, content, token_count>> of a document.

    A fold over its paragraphs holds the finished chunks and the open one.
    """
    target = (target_tokens or settings.chunk_target_tokens) * settings.chars_per_token
    overlap = (settings.chunk_overlap_tokens if overlap_tokens is None else overlap_tokens) * settings.chars_per_token
    whole = regex.strip(text)
    paragraphs = F.filter(F.transform(F.split(whole, regex.rx(r"\n\s*\n"), -1), regex.strip), lambda p: p != "")
    none = F.array().cast("array<string>")

    def state(done: Column, open_: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"))

    def step(acc: Column, p: Column) -> Column:
        done, current = acc["done"], acc["open"]
        flushed = F.when(current != "", F.concat(done, F.array(current))).otherwise(done)
        joined = F.when(current != "", F.concat(current, F.lit("\n\n"), p)).otherwise(p)
        carried = F.concat(overlap_tail(current, overlap), F.lit("\n\n"), p) if overlap else p
        return (
            F.when(F.length(p) > target, state(F.concat(flushed, split_oversized(p, target, max(1, target - overlap))), F.lit("")))
            .when(F.length(joined) <= target, state(done, joined))
            .otherwise(state(F.concat(done, F.array(current)), carried))
        )

    packed = F.aggregate(paragraphs, state(none, F.lit("")), step, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    rows = F.transform(packed, lambda c, i: F.struct(i.alias("index"), regex.strip(c).alias("content"), estimate_tokens(c, settings).alias("token_count")))
    return F.filter(rows, lambda x: x["content"] != "")


def chunk_rows(df: DataFrame, column: str, keys: list[str], **options: int) -> DataFrame:
    """A row for each chunk: keys, chunk_index, content, token_count."""
    rows = df.select(*keys, F.explode_outer(chunks(F.col(column), **options)).alias("c")).where("c IS NOT NULL")
    return rows.select(*keys, F.col("c.index").alias("chunk_index"), F.col("c.content").alias("content"), F.col("c.token_count").alias("token_count"))


def embedding_input(error: Column, category: Column, ecosystem: Column, job: Column) -> Column:
    """The error and its context, as one line for the encoder; absent parts are left out."""
    known = F.when(category != "UNKNOWN", regex.nonempty(category))
    return F.concat_ws(
        " | ", regex.head(regex.strip(error), 600), F.concat(F.lit("category: "), known), F.concat(F.lit("ecosystem: "), regex.nonempty(ecosystem)), F.concat(F.lit("job: "), regex.nonempty(job))
    )


def prepared(text: Column, settings: Settings = DEFAULTS) -> Column:
    """White space made single, cut to what an encoder reads."""
    return regex.head(regex.strip(regex.replace(text, r"\s+", " ")), settings.embedding_chars)


def knowledge_query(category: Column, error: Column, settings: Settings = DEFAULTS) -> Column:
    return regex.head(F.concat_ws(" ", category, error), settings.embedding_chars)


class HashedEncoder:
    """Words hashed to a fixed number of signed counts, scaled to length 1.

    A stand-in where no trained encoder is at hand; its similarities aren't those of one.
    """

    def __init__(self, dimensions: int = DEFAULTS.embedding_dimensions) -> None:
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> np.ndarray:
        import zlib

        # logs repeat their words: each is hashed once, and all are added up in one step
        words = [text.lower().split() for text in texts]
        hashes = {word: zlib.crc32(word.encode()) for word in set(chain.from_iterable(words))}
        h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.int64)
        at = np.repeat(np.arange(len(texts)) * self.dimensions, np.array([len(x) for x in words], np.int64)) + h % self.dimensions
        counts = np.bincount(at, np.where(h >> 31, 1.0, -1.0), len(texts) * self.dimensions)
        out = counts.reshape(len(texts), self.dimensions).astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def embed(df: DataFrame, column: str, out: str = "embedding", encoder: Callable[[], Encoder] = HashedEncoder, settings: Settings = DEFAULTS, degrade: bool = False) -> DataFrame:
    """Adds `out`; the encoder is made once a task and gets batches of texts.

    degrade: a text that the encoder fails on gets null, and where no encoder can be made all do; else the task fails.
    """

    def one_by_one(encode: Encoder, texts: list[str]) -> list:
        out: list = []
        for text in texts:
            try:
                out.append(encode([text])[0])
            except Exception as e:  # noqa: BLE001  an encoder may raise anything
                _LOG.warning("a text could not be encoded: %s", type(e).__name__)
                out.append(None)
        return out

    def encoded(encode: Encoder | None, texts: list[str]) -> list:
        if encode is None:
            return [None] * len(texts)
        try:
            return list(encode(texts))
        except Exception:  # noqa: BLE001
            if not degrade:
                raise
            return one_by_one(encode, texts)

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            encode = encoder()
        except Exception as e:  # noqa: BLE001
            if not degrade:
                raise
            _LOG.warning("no encoder: %s", type(e).__name__)
            encode = None
        for part in parts:
            texts = part.fillna("").tolist()
            rows = [x for i in range(0, len(texts), settings.embedding_batch) for x in encoded(encode, texts[i : i + settings.embedding_batch])]
            yield pd.Series(rows)

    from cinderlog.workers import workers_find_package

    workers_find_package(df.sparkSession)
    # non-deterministic, so that a filter on vectors doesn't move below a join or distinct, where each row that these drop would be encoded
    return df.withColumn(out, run.asNondeterministic()(prepared(F.col(column), settings)))


def chunk_embed(df: DataFrame, column: str, title: str, keys: list[str], encoder: Callable[[], Encoder] = HashedEncoder, **options: int) -> DataFrame:
    """Chunks with an embedding of "title: content"; the content itself stays without the title."""
    rows = chunk_rows(df, column, [*keys, title], **options)
    prefix = F.when(regex.nonempty(F.col(title)).isNotNull(), F.concat(F.col(title), F.lit(": "))).otherwise(F.lit(""))
    return embed(rows.withColumn("__embedded", F.concat(prefix, F.col("content"))), "__embedded", encoder=encoder).drop("__embedded")
