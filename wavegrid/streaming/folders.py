"""A folder of images that grows: each call analyses the files that are new since the last one.

    follow_folder(spark, images, masks, out, channels=2, ...)    analyses what is new, then returns
    cells_of(spark, out), problems_of(spark, out)                 the results so far

The images are a file stream, whose progress is kept in `out`; a call takes what is there
(availableNow) in batches of at most `files_per_batch` files. A batch writes its cells and problems
into folders of its own number and then its files' names and lengths, which commits it: a batch that
is run again after a failure replaces what it had written, and a file that was committed before with
the same name and length is passed over. A file that comes again with another length is analysed
again, and its last version counts.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.functions.kept import kept
from wavegrid.plans.pipeline import process_files
from wavegrid.sources import tiff

FILES = "path string, modificationTime timestamp, length bigint, content binary"
PARTS = ("cells", "problems", "files")


def name_of(path: str):
    return F.element_at(F.split(path, "/"), -1)


def written(spark: SparkSession, out: str, part: str) -> DataFrame | None:
    """What all batches wrote of one part; None before the first."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(f"{out}/{part}")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def masks_of(spark: SparkSession, directory: str, names: list[str]) -> DataFrame:
    """(name, content) of the mask files that are there: only these are listed and read. There are as many names as a batch has files."""
    quoted = ",".join(re.sub(r"([\[\]{},*?^\\])", r"\\\1", n) for n in names)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{{{quoted}}}" if names else "-").load(directory)
    return files.select(name_of("path").alias("name"), "content")


def analyse_batch(batch: DataFrame, number: int, masks_directory: str, out: str, channels: int, **options) -> None:
    """Analyses the files of a batch that no other batch has committed, and commits them."""
    spark = batch.sparkSession
    files = batch.select(name_of("path").alias("name"), "length", "content")
    before = written(spark, out, "files")
    if before is not None:
        files = files.join(before.where(F.col("batch") != number).select("name", "length").distinct(), ["name", "length"], "left_anti")
    files = kept(files)
    names = [r.name for r in files.select("name").collect()]
    masks = masks_of(spark, masks_directory, [tiff.mask_name(n) for n in names])
    cells, problems = process_files(files.select("name", "content"), masks, channels, **options)
    for part, rows in zip(PARTS, (cells, problems, files.select("name", "length")), strict=True):
        rows.write.mode("overwrite").parquet(f"{out}/{part}/batch={number}")


def follow_folder(spark: SparkSession, images_directory: str, masks_directory: str, out: str, channels: int, files_per_batch: int = 1000, **options) -> None:
    """Analyses the images that are new since the last call with the same `out`; options as for process_folder()."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.{tif,nd2}").option("maxFilesPerTrigger", files_per_batch).load(images_directory)
    run = lambda batch, number: analyse_batch(batch, number, masks_directory, out, channels, **options)
    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, out: str, part: str) -> DataFrame:
    """The rows of a part, of the last committed batch of each file."""
    files, rows = written(spark, out, "files"), written(spark, out, part)
    if files is None or rows is None:
        raise ValueError(f"nothing has been analysed into {out}")
    last = files.groupBy(F.col("name").alias("image_filename")).agg(F.max("batch").alias("batch"))
    return rows.join(last, ["image_filename", "batch"])


def cells_of(spark: SparkSession, out: str) -> DataFrame:
    """The wide per-cell table of all images so far, with the number of the batch that analysed each."""
    return latest(spark, out, "cells")


def problems_of(spark: SparkSession, out: str) -> DataFrame:
    return latest(spark, out, "problems")
