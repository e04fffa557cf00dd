"""SimHash near-duplicates, linked through BK-trees.

A fingerprint has 64 bits: a bit is set if it is set in over half of the hashes (XXH64, seed 42) of the text's word shingles.
Equal fingerprints are one class from the start, so groups of exact copies never meet as pairs. Classes are dealt to shards:
two fingerprints that differ in at most three bits agree in one of four blocks of bits, so a class goes to the bucket of each
of its blocks, and a bucket holds one BK-tree. A bucket with more than ``HOT`` classes is dealt again by four blocks of the bits
that it leaves open, until none is left: a bucket holds at most two to the number of its open bits, so that ends. In a tree the children of a node are keyed by their integer Hamming distance to it, and a search follows
only the edges within the radius of the query's own distance; nodes of all trees of a shard advance together. A shard returns
a spanning forest of the links it finds, never the pairs, and connected components join the forests.

The trees are not broadcast: their number grows with the corpus. Each query travels to the shards that can answer it instead.

Texts of any length are read whole, their shingles 65,536 at a time. Null text has no words, its fingerprint is zero, and it links like any other. Repeated rows keep their places and get equal results; a null key takes
part in no component and gets none unless its fingerprint's class has a key. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, discard, local_roots, portions, space_words

RADIUS = 3
SHINGLE = 3
SEED = 42
HOT = 20_000
SHARD_ROWS = 60_000
FRONTIER = 1 << 21


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64 bits as a signed integer."""
    words = space_words(text.translate(_FOLD) if text and not text.isascii() else text.lower() if text else None)
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    one = xxhash.xxh64_intdigest
    h = np.array([one(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.int64)[0])


_FOLD = {c: c + 32 for c in range(0x41, 0x5B)}


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def bits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in portions(batches):
            yield pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return bits(text)


class Forest:
    """BK-trees over the fingerprints of many buckets: flat arrays, children sorted by parent and distance."""

    def __init__(self, bits: np.ndarray, bucket: np.ndarray):
        n = len(bits)
        self.bits = bits
        order = np.argsort(bucket, kind="stable")
        group = np.unique(bucket[order], return_inverse=True)[1]
        parents, keys, kids = [], [], []
        self.root = np.empty(n, dtype=np.int64)
        items, top = order, True
        while len(items):
            head = np.flatnonzero(np.diff(group, prepend=-1))
            lead = np.repeat(items[head], np.diff(np.append(head, len(items))))
            if top:
                self.root[items], top = lead, False
            rest = np.ones(len(items), dtype=bool)
            rest[head] = False
            items, lead = items[rest], lead[rest]
            far = np.bitwise_count(bits[items] ^ bits[lead]).astype(np.int64)
            key = lead * 65 + far
            at = np.argsort(key, kind="stable")
            items, key = items[at], key[at]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            parents.append(key[first])
            kids.append(items[first])
            group = np.cumsum(np.diff(key, prepend=-1) != 0)
        edge, kid = np.concatenate(parents or [np.empty(0, np.int64)]), np.concatenate(kids or [np.empty(0, np.int64)])
        at = np.argsort(edge)
        self.edge, self.kid = edge[at], kid[at]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of nodes within the radius, each pair from either side, in portions."""
        order = np.argsort(self.root, kind="stable")
        size = np.unique(self.root[order], return_counts=True)[1]
        cost = np.cumsum(np.repeat(size, size))
        begin = 0
        while begin < len(order):
            end = max(begin + 1, int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + FRONTIER, "right")))
            query = order[begin:end]
            node = self.root[query]
            begin = end
            while len(query):
                far = np.bitwise_count(self.bits[query] ^ self.bits[node]).astype(np.int64)
                near = (far <= radius) & (query < node)
                if near.any():
                    yield query[near], node[near]
                low = np.searchsorted(self.edge, node * 65 + np.maximum(far - radius, 0), "left")
                high = np.searchsorted(self.edge, node * 65 + np.minimum(far + radius, 64), "right")
                many = high - low
                query = np.repeat(query, many)
                node = self.kid[np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(len(query))]


def _spanning(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """For a shard's rows, each linked class with the smallest class it reaches there."""
    pdf = pdf.sort_values("rep", kind="stable")
    rep, which = np.unique(pdf["rep"].to_numpy(), return_inverse=True)
    forest = Forest(pdf["fp"].to_numpy().view(np.uint64), np.unique(pdf[["mask", "value"]].to_numpy(), axis=0, return_inverse=True)[1].ravel())
    root = np.arange(len(rep))
    for a, b in forest.links(radius):
        links = np.unique(np.stack([root[which[a]], root[which[b]]]), axis=1)
        root = local_roots(len(rep), links[0], links[1])[root]
    moved = np.flatnonzero(root != np.arange(len(rep)))
    return pd.DataFrame({"a": rep[root[moved]], "b": rep[moved]})


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _parts(open_bits: list[int], n: int) -> list[list[int]]:
    edges = [round(i * len(open_bits) / n) for i in range(n + 1)]
    return [open_bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _narrower(masks: list[int], n: int) -> dict[int, list[int]]:
    return {m: [m | sum(1 << b for b in part) for part in _parts([b for b in range(64) if not m >> b & 1], n)] for m in masks}


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A spanning forest (a, b) of the links between classes (fp, rep), within ``radius`` bits."""
    spark = classes.sparkSession
    total = classes.count()
    if not total:
        return spark.createDataFrame([], "a long, b long")
    n = radius + 1
    rows, masks = classes.select(F.lit(0).cast("long").alias("mask"), "fp", "rep"), [0]
    ready, hot_tables = [], []
    while masks:
        finer = _narrower(masks, n)
        choice = F.coalesce(*(F.when(F.col("mask") == _signed(m), F.array(*(F.lit(_signed(x)).cast("long") for x in ms))) for m, ms in finer.items()))
        rows = rows.select(F.explode(choice).alias("mask"), "fp", "rep").withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        hot = cut(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("mask", "value"), "hot")
        hot_tables.append(hot)
        masks = sorted(r["mask"] % (1 << 64) for r in hot.select("mask").distinct().collect())  # at most n for each mask of the round before
        ready.append(rows.join(hot, ["mask", "value"], "left_anti") if masks else rows)
        rows = rows.join(hot, ["mask", "value"], "left_semi")
    shards = max(1, math.ceil(total * n / SHARD_ROWS))
    made = [
        r.withColumn("shard", F.pmod(F.xxhash64("mask", "value"), F.lit(shards))).groupBy("shard").applyInPandas(lambda pdf: _spanning(pdf, radius), "a long, b long")
        for r in ready
    ]
    found = cut(reduce(DataFrame.unionByName, made), "links")
    discard(*hot_tables)
    return found


def near_duplicates(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row for each document: its key (as ``key_col``), ``fp`` and ``component_id``."""
    marked = cut(docs.select(F.col(key_col).cast("long").alias("doc"), fingerprint(F.col(text_col), shingle).alias("fp")), "fingerprints")
    classes = cut(marked.groupBy("fp").agg(F.min("doc").alias("rep")), "classes")
    named = classes.where("rep is not null")
    linked = links(named, radius)
    joined = components(linked)
    final = cut(named.join(joined, named["rep"] == joined["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "final")
    discard(classes, linked)
    return marked.join(final, "fp", "left").select(F.col("doc").alias(key_col), "fp", "component_id")


def near_groups(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: its key, ``tie`` (a hash of its text) and ``group``, the smallest fingerprint it reaches.

    Groups follow the texts alone, so rows with one key and different texts are documents of their own.
    """
    marked = cut(docs.select(key_col, F.xxhash64(text_col).alias("tie"), fingerprint(F.col(text_col), shingle).alias("fp")), "fingerprints")
    classes = cut(marked.select("fp", F.col("fp").alias("rep")).distinct(), "classes")
    linked = links(classes, radius)
    joined = components(linked).select(F.col("node").alias("fp"), "component")
    return marked.join(joined.hint("merge"), "fp", "left").select(key_col, "tie", F.coalesce("component", "fp").alias("group"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
