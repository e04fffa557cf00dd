"""Shared helpers: tables that cut lineage, byte words, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PORTION = 4 << 20
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Bytes that end a word of letters and digits (ASCII that is neither), and A-Z to a-z.
_ALNUM_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that setting is absent and the session is on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="shelfmark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, a finished query's shuffle files go at once, so the steps of a job do not pile up on disk."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


_scopes: list[list[DataFrame]] = []


@contextmanager
def temporary() -> Iterator[list[DataFrame]]:
    """Deletes at its end all tables that ``cut`` writes within it, but for those that the block takes out of the list it is given."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)
        discard(*made)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here and any executor can be lost afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shelfmark-{name}-{uuid.uuid4().hex}"
    with tidy_shuffles(spark):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.shelfmark_path = path
    if _scopes:
        _scopes[-1].append(made)
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote, once what was made of them has been written itself."""
    for df in tables:
        path = getattr(df, "shelfmark_path", None)
        if path:
            jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(session.sessionState().newHadoopConf()).delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(df: DataFrame, *outputs: str) -> DataFrame:
    """``df`` with each column whose name an output needs kept under that name with ``_input`` after it."""
    needed = {o.lower() for o in outputs}
    for c in df.columns:
        if c.lower() in needed:
            df = df.withColumnRenamed(c, unused(df, f"{c}_input"))
    return df


def alnum_words(text: str | None) -> list[bytes]:
    """Words of letters and digits, A-Z lower-cased, every byte of a non-ASCII character kept."""
    return [] if not text else text.encode("utf-8", "surrogatepass").translate(_ALNUM_TABLE).split()


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (space, and 09 to 0D)."""
    return [] if not text else text.encode("utf-8", "surrogatepass").split()


def portions(batches: Iterator[pd.Series], size: int = PORTION) -> Iterator[list]:
    """The values of Arrow batches, in order, in lists of about ``size`` characters or items; a longer value stands alone."""
    for batch in batches:
        part, held = [], 0
        for value in batch:
            more = 0 if value is None else len(value)
            if part and held + more > size:
                yield part
                part, held = [], 0
            part.append(value)
            held += more
        if part:
            yield part


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For the nodes 0..n-1 and links a-b, the smallest node of each one's component."""
    root = np.arange(n, dtype=np.int64)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        apart = low != high
        if not apart.any():
            break
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while not np.array_equal(root, up := root[root]):
            root = up
    return root


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of links ``a``-``b`` (bigint): one row (node, component), component being the smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. Each step is one aggregation with map-side minimum
    and one join whose both sides are written tables, so that a node with very many links can be split. The number of
    links that are not yet stars falls by a factor each round. Nodes without a link do not appear.
    """
    links = cut(_ordered(edges), "links")
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        stars = cut(_ordered(large.select(F.col("x").alias("a"), F.col("y").alias("b"))), "large")
        # b is the larger end now: send its smaller neighbours, and itself, to the smallest of them
        least = cut(stars.groupBy("b").agg(F.min("a").alias("m")), "least")
        joined = stars.join(least, "b")
        small = joined.select(F.col("a"), F.col("m").alias("b")).unionByName(least.select(F.col("b").alias("a"), F.col("m").alias("b")))
        new = cut(_ordered(small), "links")
        discard(links, low, stars, least)
        # done when every node's smaller end is unique and is itself no one's larger end
        busy = new.select("b", "a").groupBy("b").agg(F.count("*").alias("n"))
        split = busy.where("n > 1").limit(1).count()
        chain = 0 if split else new.select("b").join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        links = new
        if not split and not chain:
            break
    else:
        raise RuntimeError("components did not converge")
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct links with a < b."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
