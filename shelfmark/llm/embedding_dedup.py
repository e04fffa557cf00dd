"""Embedding near-duplicates as an exact metric range join.

Unit vectors are compared by the angle between them, which is a metric. Identical vectors of a label are one class from the
start. The pivots are vectors spread by a hash over all classes, about the square root of the largest label's size over
``PER_PIVOT`` and at most ``MOST_PIVOTS``; a class belongs to the cell of its nearest pivot. Take a link between x of cell p and
y of cell q, at an angle of at most r. By the triangle inequality
    d(y, p) <= d(y, x) + d(x, p) <= r + d(x, q) <= 2 r + d(y, q),
so y is copied into another cell p of its label only where d(y, p) - d(y, q) <= 2 r, and of those cells only where y's distance
from the plane between p and q is within the chord of r, which the same argument shows for the straight distance. Each cell then joins
its own members with its members and copies, alone: a link of x is found in the cell of x and nowhere else, so counts of links
add up. A cell with many rows is cut into blocks of members and blocks of all its rows, each as many as its own count asks for; each
pair of blocks is one group of bounded size, so a label or a cell with a third of all rows spreads over many tasks. Groups return counts and spanning
forests, never pairs.

Within a group a bound from pivot angles comes first (|d(x, p) - d(y, p)| > r for the cell's pivot), then the cosine in double
precision. Null labels, null or zero vectors and vectors with null or non-finite components link with nothing; vectors of
different lengths do not either. Repeated rows with the same key count as one vector, the least by label and bytes; each of the
rows gets its result. A null key links with nothing and has no component. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, discard, local_roots

LEAST_COSINE = 0.98
PER_PIVOT = 12
MOST_PIVOTS = 1024
BLOCK = 4096
_SLACK = 1e-6  # the angle of a rounded cosine near one is uncertain by about 1e-8


def _units(packed) -> np.ndarray:
    """Rows of doubles, packed as bytes, at length one."""
    x = np.frombuffer(b"".join(packed), dtype=np.float64).reshape(len(packed), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _copies(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell, whether it is the row's own cell, and the angle to the cell's pivot, of each row in each of its cells."""
    dot = np.clip(x @ pivots.T, -1.0, 1.0)
    angle = np.arccos(dot)
    near = dot.argmax(axis=1)
    every = np.arange(len(x))
    gap = np.sqrt(np.maximum(2.0 - 2.0 * np.clip(pivots @ pivots.T, -1.0, 1.0), 0.0))[near]  # between the own pivot and each other
    chord = 2.0 * np.sin(reach / 2.0)
    inside = (angle <= angle[every, near][:, None] + 2 * reach + _SLACK) & (dot[every, near][:, None] - dot <= chord * gap + _SLACK)
    inside[every, near] = True
    row, cell = np.nonzero(inside)
    return row, cell, near[row] == cell, angle[row, cell]


def _dealt(classes: DataFrame, pivots: dict[int, np.ndarray], reach: float) -> DataFrame:
    """Rows of each class in its own cell (own) and in the cells it is copied to: label, dim, cell, own, to_pivot."""
    held = classes.sparkSession.sparkContext.broadcast(pivots)
    columns = ["label", "dim", "cell", "own", "to_pivot", "rep", "n", "vector"]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, whole in pdf.groupby("dim"):
                for at in range(0, len(whole), 1024):
                    part = whole.iloc[at : at + 1024]
                    row, cell, own, angle = _copies(_units(part["vector"]), held.value[int(dim)], reach)
                    got = part.iloc[row][["label", "dim", "rep", "n", "vector"]].copy()
                    got["cell"], got["own"], got["to_pivot"] = cell, own, angle
                    yield got[columns]

    return classes.select("label", "dim", "rep", "n", "vector").mapInPandas(deal, "label long, dim int, cell int, own boolean, to_pivot double, rep long, n long, vector binary")


def _joined(pdf: pd.DataFrame, least: float, reach: float) -> pd.DataFrame:
    """One pair of blocks: for each member its links here, and for each class the smallest it reaches."""
    pdf = pdf.sort_values("rep", kind="stable")
    rep, which = np.unique(pdf["rep"].to_numpy(), return_inverse=True)
    x, weight, to = _units(pdf["vector"]), pdf["n"].to_numpy(), pdf["to_pivot"].to_numpy()
    left, right = np.flatnonzero(pdf["left"].to_numpy()), np.flatnonzero(pdf["right"].to_numpy())
    right = right[np.argsort(to[right], kind="stable")]
    left = left[np.argsort(to[left], kind="stable")]
    links = np.zeros(len(rep), dtype=np.int64)
    root = np.arange(len(rep))
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        low = np.searchsorted(to[right], to[rows[0]] - reach - _SLACK, "left")
        high = np.searchsorted(to[right], to[rows[-1]] + reach + _SLACK, "right")
        some = right[low:high]
        a, b = np.nonzero(x[rows] @ x[some].T >= least)
        a, b = rows[a], some[b]
        other = which[a] != which[b]
        a, b = a[other], b[other]
        np.add.at(links, which[a], weight[b])
        pair = np.unique(np.stack([root[which[a]], root[which[b]]]), axis=1)
        root = local_roots(len(rep), pair[0], pair[1])[root]
    here = np.flatnonzero((links > 0) | (root != np.arange(len(rep))))
    return pd.DataFrame({"rep": rep[here], "links": links[here], "low": rep[root[here]]})


def _pack(x):
    """An array of doubles as bytes; negative zero counts as zero, so that equal vectors are equal bytes."""

    @F.pandas_udf("binary")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([None if v is None else (np.asarray(v, dtype=np.float64) + 0.0).tobytes() for v in rows], dtype=object)

    return pack(x)


def near_duplicates(vectors: DataFrame, key_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST_COSINE) -> DataFrame:
    """One row for each key: ``key_col``, n_links, component_id, kept."""
    spark = vectors.sparkSession
    reach = math.acos(least)
    x = F.col(vector_col)
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = cut(vectors.select(F.col(key_col).cast("long").alias("key"), F.col(label_col).cast("long").alias("label"), F.when(sound, _pack(F.when(sound, x.cast("array<double>")))).alias("vector")), "vectors")
    usable = rows.where("key is not null and label is not null and vector is not null")
    if usable.count() > usable.select("key").distinct().count():  # repeated keys: the same class each time
        usable = usable.groupBy("key").agg(F.min(F.struct("label", "vector")).alias("v")).select("key", "v.label", "v.vector")
    classes = cut(usable.groupBy("label", "vector").agg(F.min("key").alias("rep"), F.count("*").alias("n")).withColumn("dim", (F.octet_length("vector") / 8).cast("int")), "classes")
    own_class = usable.select("key", "label", "vector").join(classes.select("label", "vector", "rep", "n"), ["label", "vector"]).select("key", "rep", "n")

    total = classes.count()
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    n_pivots = max(4, min(MOST_PIVOTS, math.ceil(math.sqrt(largest) / PER_PIVOT)))
    part = F.pmod(F.xxhash64("rep", F.lit("pivot")), F.lit(1_000_000)).cast("double")
    chosen = classes.where(part < 1_000_000 * min(1.0, 4 * n_pivots / max(total, 1))).select("dim", "vector", "rep").orderBy(part, "rep").limit(n_pivots).collect()
    pivots = {d: _units([r["vector"] for r in chosen if r["dim"] == d]) for d in {r["dim"] for r in chosen}}
    for d in [r["dim"] for r in classes.select("dim").distinct().collect()]:
        pivots.setdefault(d, np.eye(1, d))
    dealt = cut(_dealt(classes, pivots, reach), "cells")
    blocks = lambda rows: F.greatest(F.ceil(rows / BLOCK), F.lit(1)).cast("int")
    size = cut(dealt.groupBy("label", "dim", "cell").agg(blocks(F.count_if("own")).alias("n_own"), blocks(F.count("*")).alias("n_any")), "sizes")
    number = lambda salt, of: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(of)).cast("int")
    placed = dealt.join(size, ["label", "dim", "cell"]).withColumns({"as_own": number("own", "n_own"), "as_any": number("any", "n_any")})
    # as a member (left) a row meets every block of rows, as any row (right) every block of members
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    member = F.transform(F.when(F.col("own"), every("n_any")).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.col("as_own").alias("l"), i.alias("r")))
    anyone = F.transform(every("n_own"), lambda i: F.struct(i.alias("l"), F.col("as_any").alias("r")))
    meet = placed.withColumn("at", F.explode(F.array_union(member, anyone)))
    meet = meet.select("label", "dim", "cell", F.col("at.l").alias("l"), F.col("at.r").alias("r"), (F.col("own") & (F.col("at.l") == F.col("as_own"))).alias("left"), (F.col("at.r") == F.col("as_any")).alias("right"), "to_pivot", "rep", "n", "vector")
    found = cut(meet.groupBy("label", "dim", "cell", "l", "r").applyInPandas(lambda pdf: _joined(pdf, least, reach), "rep long, links long, low long"), "found")
    joined = components(found.select(F.col("low").alias("a"), F.col("rep").alias("b")))
    discard(dealt, size)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = cut(
        classes.select("rep", "n").join(links, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left").select("rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")),
        "per-class",
    )
    discard(found)
    per_key = cut(own_class.join(per_class, "rep").select("key", "n_links", "component_id"), "per-key")
    discard(classes, per_class)
    out = rows.select("key").join(per_key, "key", "left")
    return out.select(
        F.col("key").alias(key_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "key").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "key") == F.col("key"), F.lit(False)).alias("kept"),
    )
