"""Exact deduplication as a stream with keyed state on disk.

The files of a table come as a stream, in micro-batches of a bounded number of bytes. Its state is keyed by the digest of the
normalized text (A-Z lower-cased, null as empty), lives in RocksDB and never expires; a key retains the stable identifier of the row
that stays so far, where that row's content lies (file and row), and how many rows had the digest. The largest identifier stays, so
the order in which files arrive does not matter, and a kept checkpoint goes on with the files that are new. Rows of one task with
one digest are combined before they are dealt to the state, so a text that a third of all rows hold costs each task one row.

A hit is a digest that had more rows than one. Hits are checked on full bytes: the texts of a digest, each once, are held against the
content at the retained locator. Where one differs, digests say too little, and the rows of that digest are grouped by their bytes
instead. The state is read as a table and joined with the documents by digest; frequent digests are skewed join keys, which adaptive
execution splits.

Every row gets a decision, and one row of each group stays: of repeated rows with the largest identifier the one in the last
file and place. A null identifier is smaller than all others. An empty table gives an empty one. Texts are hashed and compared whole,
whatever their length. Other columns are not read; ``kept_documents`` returns the whole rows that stay, with all of their columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, shared_dir, unused

BATCH_BYTES = 64 << 30
DIGEST_BYTES = 32
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition of the state takes 4 MB of disk at once
}


def normalized(text: Column) -> Column:
    """A-Z in lower case, null as empty, all else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rows(files: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """key, file, row, sha (hex) and content (normalized) of each row of a table's files."""
    found = files.select(F.col(key_col).cast("long").alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), normalized(F.col(text_col)).alias("content"))
    return found.withColumn("sha", F.sha2("content", 256))


def _digest(size: int) -> Column:
    return F.substring(F.unhex("sha"), 1, size)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def take_in(spark: SparkSession, path: str, checkpoint: str, key_col: str = "doc_id", text_col: str = "text", digest_bytes: int = DIGEST_BYTES, batch_bytes: int = BATCH_BYTES) -> None:
    """Streams the files of a Parquet table that the checkpoint has not seen yet into its state, and ends when none is left."""
    # as a pattern, since a stream takes a single file for a folder otherwise
    pattern = f"{path[:-1]}[{path[-1]}]"
    files = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", batch_bytes).parquet(pattern)
    kept = F.max(F.struct("key", "file", "row")).alias("keep")
    state = _rows(files, key_col, text_col).select("key", "file", "row", _digest(digest_bytes).alias("digest")).groupBy("digest").agg(kept, F.count("*").alias("n"))
    with _state_on_disk(spark):
        stream = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.awaitTermination()


def state_table(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state: digest, keep (key, file, row) and n."""
    if not _exists(spark, f"{checkpoint}/state"):
        return spark.createDataFrame([], "digest binary, keep struct<key:long,file:string,row:long>, n long")
    with _state_on_disk(spark):
        state = spark.read.format("statestore").load(checkpoint)
    key, keep, n = (state.schema[c].dataType.fields[i].name for c, i in (("key", 0), ("value", 0), ("value", 1)))
    return state.select(F.col(f"key.{key}").alias("digest"), F.col(f"value.`{keep}`").alias("keep"), F.col(f"value.`{n}`").alias("n"))


def _same(a: str, b: str) -> Column:
    return (F.col(f"{a}.file") == F.col(f"{b}.file")) & (F.col(f"{a}.row") == F.col(f"{b}.row"))


def judge_copies(spark: SparkSession, path: str, key_col: str = "doc_id", text_col: str = "text", checkpoint: str | None = None, digest_bytes: int = DIGEST_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row for each row of the Parquet table at ``path``: key, place (key, file, row), keep (that of the row that stays), n
    (rows with this text), kept and sha. A ``checkpoint`` that is given stays for the next run; else the state goes with this one."""
    where = checkpoint or f"{shared_dir(spark)}/shelfmark-state-{uuid.uuid4().hex}"
    take_in(spark, path, where, key_col, text_col, digest_bytes, batch_bytes)
    with _state_on_disk(spark):
        state = cut(state_table(spark, where), "digests")
    rows = _rows(spark.read.parquet(path), key_col, text_col).select("sha", _digest(digest_bytes).alias("digest"), F.struct("key", "file", "row").alias("place"), "content")
    # the digests grow with the documents, so both sides are shuffled at every size
    judged = cut(rows.join(state.hint("merge"), "digest").withColumn("content", F.when(F.col("n") > 1, F.col("content"))), "judged")
    hits = judged.where("n > 1")
    texts = hits.groupBy("digest", "content").agg(F.count("*").alias("rows"))
    retained = hits.where(_same("place", "keep")).select("digest", F.col("content").alias("retained"))
    other = cut(texts.join(retained.hint("merge"), "digest").where("content <> retained").select("digest").distinct(), "other-bytes")
    out = judged
    if not other.isEmpty():
        apart = hits.join(other.hint("merge"), "digest", "left_semi")
        by_bytes = cut(apart.groupBy("digest", "content").agg(F.max("place").alias("own"), F.count("*").alias("own_n")), "by-bytes")
        out = judged.join(by_bytes.hint("merge"), ["digest", "content"], "left").withColumns({"keep": F.coalesce("own", "keep"), "n": F.coalesce("own_n", "n")})
    discard(state, other)
    if checkpoint is None:
        gone = spark.createDataFrame([], T.StructType())
        gone.shelfmark_path = where
        discard(gone)
    return out.select(F.col("place.key").alias("key"), "place", "keep", "n", _same("place", "keep").alias("kept"), "sha")


def kept_documents(spark: SparkSession, path: str, decisions: DataFrame) -> DataFrame:
    """The rows of the table that stay, with all their columns; ``decisions`` from ``judge_copies`` of the same files."""
    docs = spark.read.parquet(path)
    f, r = unused(docs, "place_file"), unused(docs, "place_row")
    placed = docs.select("*", F.col("_metadata.file_path").alias(f), F.col("_metadata.row_index").alias(r))
    stay = decisions.where("kept").select(F.col("place.file").alias(f), F.col("place.row").alias(r))
    return placed.join(stay.hint("merge"), [f, r], "left_semi").select(*docs.columns)


def digest(decisions: DataFrame) -> DataFrame:
    return decisions.select(F.col("key").alias("doc_id"), F.col("keep.key").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))
