"""Files and volumes of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import file_stem, pad2, volume_number

# Supported file types.
EXTENSIONS = ("epub", "pdf", "cbz", "cbr", "mobi", "azw3")


def supported_files(files: DataFrame) -> DataFrame:
    """Files (path, name) of supported types, in binary order of their names."""
    return files.where(F.lower(F.substring_index("name", ".", -1)).isin(*EXTENSIONS) & F.col("name").contains(".")).orderBy("name")


def match_files(volumes: DataFrame, files: DataFrame) -> DataFrame:
    """Volumes (series, volume_number, ...) with path and file_status; of files with one number the last by name counts. files: series, name, path."""
    kept = files.where(F.lower(F.substring_index("name", ".", -1)).isin(*EXTENSIONS) & file_stem(F.col("name")).rlike("[0-9]"))
    # every stem with a digit has a number; a column that cannot be null has no filter inferred for the join, which would repeat the rules
    numbered = kept.withColumn("volume_number", F.coalesce(volume_number(F.col("name")), F.lit("")))
    last = numbered.groupBy("series", "volume_number").agg(F.max(F.struct("name", "path")).alias("f")).select("series", "volume_number", F.col("f.path").alias("path"))
    return volumes.join(last, ["series", "volume_number"], "left").withColumn("file_status", F.when(F.col("path").isNotNull(), "matched").otherwise("missing"))


def number_volumes(books: DataFrame, order: str = "position") -> DataFrame:
    """Books (series, order, book) with volume_number 01.. and the series stamped into the book."""
    n = F.row_number().over(Window.partitionBy("series").orderBy(order))
    out = books.withColumn("volume_number", pad2(n.cast("string")))
    return out.withColumn("book", F.col("book").withField("series", F.col("series")).withField("series_number", F.col("volume_number")))


def generated_volumes(series: DataFrame) -> DataFrame:
    """Rows (series, count) to volumes ``Series NN``."""
    rows = series.select("series", F.explode(F.when(F.col("count") > 0, F.sequence(F.lit(1), F.col("count")))).alias("n"))
    number = pad2(F.col("n").cast("string"))
    return rows.select("series", number.alias("volume_number"), F.concat_ws(" ", "series", number).alias("title"))


def volumes_from_files(files: DataFrame) -> DataFrame:
    """Files (series, name, path) to volumes, numbered by their names or else by their place."""
    place = F.row_number().over(Window.partitionBy("series").orderBy("name"))
    kept = files.where(F.lower(F.substring_index("name", ".", -1)).isin(*EXTENSIONS))
    number = F.coalesce(volume_number(F.col("name")), pad2(place.cast("string")))
    out = kept.withColumn("volume_number", number)
    return out.select("series", "volume_number", F.concat_ws(" ", "series", "volume_number").alias("title"), "path", F.lit("matched").alias("file_status"))


def volume_summary(volumes: DataFrame, eligible: Column) -> DataFrame:
    """By series: incomplete volumes, matched and missing files, and whether all is ready."""
    done = F.count_if(F.col("file_status") == "matched")
    return volumes.groupBy("series").agg(F.count("*").alias("volumes"), F.count_if(~eligible).alias("incomplete"), done.alias("matched"), F.count_if(F.col("file_status") == "missing").alias("missing"), (F.count_if(~eligible) == 0).alias("ready"))
