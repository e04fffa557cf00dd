"""Newly captured pages as a stream: parsed, validated and kept. A page is parsed once.

``append_books`` appends; an address counts once within a batch. ``keep_books`` has a state on disk, without expiry, by blocks of addresses: for each
address the hash of its last page and when it was captured. A page that has not changed, or that is older than the last one, is skipped; a changed
one replaces what was kept of its address, also where it can no longer be parsed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import pages, validate
from ..schemas import RAW_PAGE
from ..site import SITE, Site

#: A captured page: ``seq`` rises with the time of capture.
CAPTURED = T.StructType([*RAW_PAGE.fields, T.StructField("seq", T.LongType())])
#: Into how many blocks the addresses of a state are dealt; fixed, since a checkpoint belongs to its number.
BLOCKS = 1 << 13
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEPT = "url string, seq long, book_json string, status string, warnings array<string>, parse_error string, batch long"


def read_pages(spark: SparkSession, folder: str, most_files: int = 100, schema: T.StructType = RAW_PAGE) -> DataFrame:
    """Parquet files of (url, html), or of ``CAPTURED`` rows, as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def append_books(stream: DataFrame, books: str, errors: str, checkpoint: str, site: Site = SITE) -> StreamingQuery:
    """Appends each batch's new books and parse failures. A batch that is run again replaces its own folder, so it writes once."""

    def write(batch: DataFrame, number: int) -> None:
        done = validate.with_validation(pages.books(batch.dropDuplicates(["url"]), site)).persist()
        try:
            good, bad = pages.split_failures(done)
            good.select("url", F.to_json("book").alias("book_json"), "status", "warnings").write.mode("overwrite").parquet(f"{books}/batch={number}")
            bad.write.mode("overwrite").parquet(f"{errors}/batch={number}")
        finally:
            done.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_pages(stream: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Of a stream of captured pages (url, html, seq) those that differ from the last page of their address, the last one of each batch.

    Addresses share the state of one of ``blocks``, by their hash: what a batch costs beside its rows is bounded by the blocks, and not a call
    for each address. A block's state grows with its addresses and is written again when one of them comes."""

    def last_of(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple[int, str, str | None]] = {}
        for pdf in batches:
            for url, seq, sha, html in zip(pdf["url"], pdf["seq"], pdf["sha"], pdf["html"], strict=True):
                if url not in best or (seq, sha) > best[url][:2]:
                    best[url] = int(seq), sha, html
        known = json.loads(state.get[0]) if state.exists else {}
        fresh = []
        for url, (seq, sha, html) in best.items():
            last = known.get(url)
            if last is None or last[0] <= seq:
                known[url] = (seq, sha)
                if last is None or last[1] != sha:
                    fresh.append((url, html, seq))
        state.update((json.dumps(known),))
        if fresh:
            yield pd.DataFrame(fresh, columns=["url", "html", "seq"])

    keyed = stream.where("url is not null").withColumn("sha", F.sha2(F.coalesce("html", F.lit("")), 256)).withColumn("seq", F.coalesce("seq", F.lit(0)))
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("url"), F.lit(blocks)))
    return keyed.groupBy("block").applyInPandasWithState(last_of, CAPTURED, "known string", "append", GroupStateTimeout.NoTimeout)


def keep_books(stream: DataFrame, kept: str, checkpoint: str, site: Site = SITE) -> StreamingQuery:
    """Writes each batch's new and changed pages as books or failures, a folder a batch; ``current_books`` reads what holds now."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        done = validate.with_validation(pages.books(batch, site))
        row = done.select("url", "seq", F.when(F.col("parse_error").isNull(), F.to_json("book")).alias("book_json"), "status", "warnings", "parse_error")
        row.write.mode("overwrite").parquet(f"{kept}/batch={number}")

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ON_DISK)
    try:
        return changed_pages(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def current_books(spark: SparkSession, kept: str) -> DataFrame:
    """The last outcome of each address: url, seq, book_json, status, warnings, parse_error, batch."""
    rows = spark.read.schema(_KEPT).parquet(kept)
    return rows.groupBy("url").agg(F.max_by(F.struct(*rows.columns), "batch").alias("r")).select("r.*")
