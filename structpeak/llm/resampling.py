"""Resampling of documents towards a target corpus, by importance weights and a distributed radix sort.

Words are runs of digits, letters a to z (after lower-casing A to Z) and signs beyond ASCII; features
are all runs of one to ``longest`` words, hashed to a fixed number of buckets. The counts of a bucket
in the documents and in the target give its gain; a document's weight is the sum of the gains of its
features, read from one array of fixed size. Seeded Gumbel noise added to the weight makes the highest scores a
draw without replacement in proportion to the weights.

The order is found by least-significant-digit radix sort. The key is the score, falling, and the id,
rising. Every pass is a stable counting sort by one digit: rows stand in chunks of fixed size, each
counts its digits, running totals over digits and chunks give where each chunk's rows of a digit go,
and a row's place among those is its rank in chunk and digit. One pass moves every row once, no task
holds more than a chunk's rows, and a digit that all rows share costs nothing. Each pass is stored, so a lost
executor costs part of one pass.

Null and empty texts have no words, weight 0. Null ids rank behind all others of their score; rows
with equal scores and ids get neighbouring ranks. An empty table gives an empty result; an empty
target gives gains from the documents alone. Ids must be whole numbers. Other columns are left out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structpeak.llm.storage import saved
from structpeak.llm.textbuf import blocks, column_bytes

BUCKETS = 10_000
#: In UTF-8 every sign beyond ASCII is made of bytes from 0x80 on.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Distinct features whose buckets a worker remembers.
KNOWN_FEATURES = 500_000
#: Bits of a digit, and of the number of rows in a chunk.
DIGIT_BITS, CHUNK_BITS = 12, 18


class Featurizer(dict):
    """The bucket of every feature, remembered."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest = buckets, longest

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN_FEATURES:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.buckets
        return bucket

    def of(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each document, features of each document, buckets of all features."""
        raw = data.tobytes().lower()  # of bytes: A to Z alone
        n_words, n_features, found = [], [], []
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            words = WORD.findall(raw, a, b)
            n_words.append(len(words))
            before = len(found)
            found += map(self.__getitem__, words)
            for size in range(2, self.longest + 1):
                found += (self[b" ".join(words[k:k + size])] for k in range(len(words) - size + 1))
            n_features.append(len(found) - before)
        return np.array(n_words, np.int64), np.array(n_features, np.int64), np.array(found, np.int64)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = 1, text: str = "text") -> np.ndarray:
    """Features in each bucket over the whole table; each task sends one row a bucket, the driver gets ``buckets`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Featurizer(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            data, borders, _ = column_bytes(batch.column(0))
            for _, _, part, local in blocks(data, borders):
                total += np.bincount(features.of(part, local)[2], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    rows = docs.select(docs[text].alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the log ratio of each bucket's smoothed shares, rounded down."""
    s, t = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log(float(y + 1) * s / (float(x + 1) * t))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_words, n_features, weight`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(len(gain), longest)
        for batch in batches:
            data, borders, _ = column_bytes(batch.column(1))
            for lo, hi, part, local in blocks(data, borders):
                n_words, n_features, bucket = features.of(part, local)
                total = np.concatenate(([0], np.cumsum(gain[bucket])))
                end = np.cumsum(n_features)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n_words), pa.array(n_features), pa.array(total[end] - total[end - n_features])], ["key", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long")
    return out.withColumnRenamed("key", key)


def gumbel(key: str, seed: int) -> Column:
    """Thousand times a standard Gumbel draw that depends on seed and key alone, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def counting_pass(rows: DataFrame, digit: Column, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Rows with their place ``_at`` after one stable pass by ``digit``; places before it may have gaps."""
    dealt = rows.withColumn("_chunk", F.shiftright("_at", chunk_bits)).withColumn("_digit", digit)
    counts = dealt.groupBy("_chunk", "_digit").agg(F.count(F.lit(1)).alias("_n"))
    digits = counts.groupBy("_digit").agg(F.sum("_n").alias("_all"))
    digits = digits.select("_digit", (F.sum("_all").over(Window.orderBy("_digit")) - F.col("_all")).alias("_base"))  # no more rows than a digit has values
    earlier = F.sum("_n").over(Window.partitionBy("_digit").orderBy("_chunk")) - F.col("_n")
    offset = counts.withColumn("_earlier", earlier).join(digits, "_digit").select("_chunk", "_digit", (F.col("_base") + F.col("_earlier")).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_chunk", "_digit").orderBy("_at"))
    placed = dealt.withColumn("_in", inside).join(offset, ["_chunk", "_digit"])
    return placed.select(*[c for c in rows.columns if c != "_at"], (F.col("_first") + F.col("_in") - 1).alias("_at"))


def radix_order(rows: DataFrame, keys: list[str], digit_bits: int = DIGIT_BITS, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """``rows`` with ``_at``, their place from 0 in the rising order of ``keys`` (longs, read as unsigned; the first counts most)."""
    state = saved(rows.withColumn("_at", F.monotonically_increasing_id()), "radix")
    varies = state.agg(*[F.bit_or(k).bitwiseXOR(F.bit_and(k)).alias(k) for k in keys]).first()
    mask = (1 << digit_bits) - 1
    passes = [
        (k, shift) for k in reversed(keys) for shift in range(0, 64, digit_bits) if (((varies[k] or 0) % (1 << 64)) >> shift) & mask
    ]
    for k, shift in passes or [(keys[0], 0)]:
        state = saved(counting_pass(state, F.shiftrightunsigned(k, shift).bitwiseAND(F.lit(mask)), chunk_bits), "radix")
    return state


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, buckets: int = BUCKETS, longest: int = 1, least_words: int = 20, text: str = "text", key: str = "doc_id",
    digit_bits: int = DIGIT_BITS, chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """``key, n_features, weight, score, rank`` of every row; ``rank`` is null where the row isn't drawn.

    Of the rows with ``least_words`` or more, ``percent`` per cent are drawn, rounded down.
    """
    gain = gains(bucket_counts(docs, buckets, longest, text), bucket_counts(target, buckets, longest, text))
    scored = saved(weigh(docs, gain, longest, text, key).withColumn("score", F.col("weight") + gumbel(key, seed)), "scored")
    enough = F.col("n_words") >= least_words
    n, highest = scored.where(enough).agg(F.count(F.lit(1)), F.max("score")).first()
    falling = (F.lit(highest or 0) - F.col("score")).alias("_falling")
    rising = F.coalesce(F.col(key).cast("long").bitwiseXOR(F.lit(-(1 << 63))), F.lit(-1)).alias("_rising")
    columns = [key, "n_features", "weight", "score"]
    placed = radix_order(scored.where(enough).select(*columns, falling, rising), ["_falling", "_rising"], digit_bits, chunk_bits)
    rank = F.when(F.col("_at") < n * percent // 100, F.col("_at") + 1)
    rest = scored.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank"))
    return reduce(DataFrame.unionByName, [placed.select(*columns, rank.alias("rank")), rest])
