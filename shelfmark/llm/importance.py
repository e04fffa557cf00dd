"""Importance resampling towards a target: hashed n-gram features, bucket gains, and a seeded draw without replacement.

Features are the single words of a text and its pairs of consecutive words; a feature's bucket is the CRC-32 of its bytes modulo
``BUCKETS``. A portion of a partition has a dictionary, an Aho-Corasick automaton of its distinct words, each between its
delimiters, with the word's CRC and length as payload. A scan of a text emits the payloads in order. The CRC of a pair follows from
the payloads of its two words, since a CRC moves over n more bytes by a linear map; no pair is ever spelled out.

Each text is scanned once; its packed buckets are a table. Counting takes one array of buckets a task, and the gains (an array of
``BUCKETS``) go to the tasks that score every document from its buckets. Ranks come from a range partition by score and key: places within a partition, and
the numbers of rows before it. Nothing grows on the driver but one count for each partition.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. A null text has no words, no features and weight 0,
and is never drawn, as all texts under ``LEAST_WORDS`` words. Equal scores rank by key, a null key first; of rows with one key the
smaller text hash comes first. Each repeated row has a rank of its own. Without documents there are no rows; without target texts
all target counts are zero. Texts of any length are scanned whole; words over ``LONG`` bytes get their payload without the automaton. A column of
the input with an output's name stays, as ``<name>_input``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _ALNUM_TABLE, PORTION, cut, discard, portions, set_aside, unused

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = "7"
LONG = 1_000
_OUTPUTS = ("n_words", "n_features", "weight", "score", "rank", "tie")
_POLYNOMIAL = 0xEDB88320  # fixed value: reflected CRC-32


def _apply(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear map whose images of single bits are ``columns``, of each number."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


@lru_cache(maxsize=64)
def _moved(power: int) -> np.ndarray:
    """Images of single bits when 2**power zero bytes follow a CRC."""
    if power == 0:
        column = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(8):
            column = (column >> np.uint32(1)) ^ np.where(column & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
        return column
    half = _moved(power - 1)
    return _apply(half, half)


@lru_cache(maxsize=4096)
def _shift_table(size: int) -> np.ndarray:
    """The map of ``size`` more bytes as four tables, one for each byte of a CRC."""
    column = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for power in range(size.bit_length()):
        if size >> power & 1:
            column = _apply(_moved(power), column)
    byte = np.arange(256, dtype=np.uint32)
    return np.stack([_apply(column, byte << np.uint32(8 * k)) for k in range(4)])


def joined_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs of a+b from those of a and b and the lengths of b."""
    if len(size) and size.max() <= 1 << 16:  # numbered without a sort
        has = np.bincount(size) > 0
        sizes, which = np.flatnonzero(has), (np.cumsum(has) - 1)[size]
    else:
        sizes, which = np.unique(size, return_inverse=True)
    out = np.empty(len(first), dtype=np.uint32)
    if len(sizes) <= 512:
        tables = np.stack([_shift_table(int(n)) for n in sizes]) if len(sizes) else np.empty((0, 4, 256), np.uint32)
        out = tables[which, 0, first & 255] ^ tables[which, 1, first >> 8 & 255] ^ tables[which, 2, first >> 16 & 255] ^ tables[which, 3, first >> 24]
    else:
        for k, n in enumerate(sizes):
            at = which == k
            t, x = _shift_table(int(n)), first[at]
            out[at] = t[0, x & 255] ^ t[1, x >> 8 & 255] ^ t[2, x >> 16 & 255] ^ t[3, x >> 24]
    return out ^ second


def _delimited(text: str | None) -> bytes:
    return b" " + (text or "").encode("utf-8", "surrogatepass").translate(_ALNUM_TABLE) + b" "


class Dictionary:
    """The distinct words of some texts, with a space before and after each, and their payloads."""

    def __init__(self, texts: list[bytes]):
        words = list(set().union(*(t.split() for t in texts)))
        self.crc = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.then_space = joined_crc(self.crc, np.full(len(words), zlib.crc32(b" "), np.uint32), np.ones(len(words), np.int64))
        self.long = {w: k for k, w in enumerate(words) if len(w) > LONG}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, w in enumerate(words):
            if len(w) <= LONG:
                self.machine.add_word(f" {w.decode('latin-1')} ", k)
        if len(self.machine):
            self.machine.make_automaton()

    def scan(self, text: bytes) -> list[int]:
        """The words of a text, by number, in order."""
        if self.long and max(map(len, text.split()), default=0) > LONG:
            found = [(at, k) for at, k in self.machine.iter(text.decode("latin-1"))] if len(self.machine) else []
            at = 0
            for w in text.split():
                at = text.index(w, at) + len(w)
                if len(w) > LONG:
                    found.append((at, self.long[w]))
            return [k for _, k in sorted(found)]
        return [k for _, k in self.machine.iter(text.decode("latin-1"))] if len(self.machine) else []


def feature_buckets(texts: list[str | None], buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The buckets of each text's features: its words, then its pairs."""
    lines = [_delimited(t) for t in texts]
    known = Dictionary(lines)
    found = [np.array(known.scan(line), dtype=np.int64) for line in lines]
    many = [len(f) for f in found]
    words = np.concatenate(found) if found else np.empty(0, np.int64)
    single = (known.crc[words] % np.uint32(buckets)).astype(np.int32)
    pair = (joined_crc(known.then_space[words[:-1]], known.crc[words[1:]], known.size[words[1:]]) % np.uint32(buckets)).astype(np.int32)
    at = 0
    for n in many:
        yield np.concatenate([single[at : at + n], pair[at : at + max(n - 1, 0)]])
        at += n


def _type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(text: Column, buckets: int = BUCKETS) -> Column:
    """Struct (n_words, n_features, buckets): the buckets of a text's features, packed."""

    @F.pandas_udf("n_words long, n_features long, buckets binary")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in portions(batches, PORTION):
            rows = [((len(found) + 1) // 2, len(found), found.astype(_type(buckets)).tobytes()) for found in feature_buckets(texts, buckets)]
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "buckets"])

    return find(text)


def bucket_counts(found: DataFrame, col: str = "buckets", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for pdf in batches:
            for packed in pdf["packed"]:
                total += np.bincount(np.frombuffer(packed, dtype=_type(buckets)), minlength=buckets)
        has = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": has.astype(np.int32), "n": total[has]})

    counted = found.select(F.col(col).alias("packed")).mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, dtype=np.int64)
    for row in counted.collect():  # at most one row a bucket
        total[row["bucket"]] = row["n"]
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of target to source) of each bucket."""
    buckets, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + buckets) / ((float(a) + 1) * (t + buckets)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def seeded_noise(key: Column, seed: str = SEED) -> Column:
    """The floored, scaled noise of a key; a null key counts as an empty one."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def feature_weights(packed: Column, gains: np.ndarray) -> Column:
    """The floored mean of the gains of packed buckets; 0 without any."""

    @F.pandas_udf("long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = [np.frombuffer(p, dtype=_type(len(gains))) for p in batch]
            yield pd.Series([int(gains[f].sum()) // max(1, len(f)) for f in found], dtype="int64")

    return weigh(packed)


def ranked(rows: DataFrame, order: list[Column], out_col: str) -> DataFrame:
    """``rows`` (a written table) with their place from 1 in a total order, without a window over all of them."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = unused(rows, "part")
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(out_col, F.monotonically_increasing_id())
    placed = cut(placed, "placed")
    part_of = F.shiftright(out_col, 33)
    counts = {r[0]: r[1] for r in placed.groupBy(part_of).agg(F.count("*")).collect()}  # one row a partition
    before, total = [], 0
    for k in sorted(counts):
        before.append((k, total))
        total += counts[k]
    earlier = unused(rows, "earlier")
    offsets = spark.createDataFrame(before, f"{part} long, {earlier} long")
    joined = placed.withColumn(part, part_of).join(F.broadcast(offsets), part)
    return joined.withColumn(out_col, F.col(earlier) + F.col(out_col).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(part, earlier)


def resample(docs: DataFrame, target: DataFrame, key_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` without its text, with n_words, n_features, weight, score and rank (null where it is not drawn)."""
    docs = set_aside(docs, *_OUTPUTS)
    text, key = (c if c in docs.columns else f"{c}_input" for c in (text_col, key_col))
    kept = [c for c in docs.columns if c != text]
    row = unused(docs, "row")
    found = docs.select(F.struct(*kept).alias(row), F.xxhash64(text).alias("tie"), features(F.col(text), buckets).alias("f"))
    found = cut(found.select(row, "tie", "f.*"), "features")
    wanted = target.select(features(F.col(text_col), buckets).alias("f")).select("f.buckets")
    gains = bucket_gains(bucket_counts(found, buckets=buckets), bucket_counts(wanted, buckets=buckets))
    score = (F.col("weight") + seeded_noise(F.col(row)[key], seed)).alias("score")
    scored = cut(found.withColumn("weight", feature_weights(F.col("buckets"), gains)).select(row, "tie", "n_words", "n_features", "weight", score), "scored")
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    out = ranked(scored, [(~fit).asc(), F.col("score").desc(), F.col(row)[key].asc(), F.col("tie").asc()], "rank")
    discard(found, scored)
    return out.select(f"{row}.*", "n_words", "n_features", "weight", "score", F.when(fit & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_features", "weight", "score", "rank")
