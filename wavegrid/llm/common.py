"""Helpers that several corpus operators use."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The columns of the documents table.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    A temporary folder is set only where the session names none and runs in one process, as in
    local tests; on a cluster it would be another one on each machine, so there it raises.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wavegrid-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are kept as a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a partition of a small table that has been cut.
PARTITION_ROWS = 100_000


def counted(df: DataFrame, *more) -> tuple[DataFrame, tuple]:
    """cut(df) and its number of rows, seen as they were kept, with further aggregates of them; in as many partitions as they need, where they had more."""
    seen = Observation()
    names = [f"_{k}" for k in range(len(more) + 1)]
    kept = cut(df.observe(seen, *[a.alias(n) for a, n in zip((F.count(F.lit(1)), *more), names, strict=True)]))
    values = tuple(seen.get[n] for n in names)
    return kept.coalesce(max(1, -(-values[0] // PARTITION_ROWS))), values


def sent(df: DataFrame, bound: int | None = None) -> DataFrame:
    """df, cut and counted, to be sent to all tasks of a join if it has at most `bound` rows (SENT_ROWS); else Spark joins by an exchange."""
    kept, (n,) = counted(df)
    return F.broadcast(kept) if n <= (SENT_ROWS if bound is None else bound) else kept


def once(key: tuple, make: Callable):
    """make(), at most once per Python process as long as one operator runs: workers are used for many tasks.

    What another operator kept is freed, so that a worker's memory does not add up over a pipeline.
    """
    kept = sys.__dict__.setdefault("_wavegrid_kept", {})
    if key not in kept:
        release()
        kept[key] = make()
    return kept[key]


def release() -> None:
    """Frees what other operators kept in this Python process, and gives it back to the machine."""
    kept = sys.__dict__.get("_wavegrid_kept", {})
    if kept:
        kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        # The C library keeps what is freed unless it is told to give it back.
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


#: Rows of a batch of texts.
TEXT_ROWS = 1_000


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose texts Spark passes to Python in batches of at most TEXT_ROWS rows from now on (a setting of the session).

    A batch is held whole on both sides, outside of the heap, and texts may be long.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXT_ROWS:
        conf.set(name, str(TEXT_ROWS))
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, so that no column of df is hidden."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def ascii_lower(column):
    """A-Z to a-z, all else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def columns_of(df: DataFrame, *names: str) -> list:
    """The named columns, quoted, so that other columns' names cannot disturb them."""
    return [F.col(f"`{n}`") for n in names]


def hashed_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most `bound` rows: those with the smallest hashes of a column (ties by all columns).

    Rows with large hashes are left out first, so that what meets in one task to be ordered is in
    proportion to the bound, not to the number of tasks.
    """
    n = df.count()
    if n > 4 * bound:
        df = df.where(F.xxhash64(F.col(key)) < -(2**63) + int(2 * bound / n * 2**64))
    return df.orderBy(F.xxhash64(F.col(key)), *columns_of(df, *df.columns)).limit(bound)


#: Rows of a few numbers that are sent to every task at most (a few tens of MB).
SENT_ROWS = 2_000_000


def small_side(df: DataFrame, bound: int = SENT_ROWS) -> DataFrame:
    """df, which must be cut, to be sent to all tasks of a join if it has at most `bound` rows; else Spark joins by an exchange."""
    return F.broadcast(df) if df.count() <= bound else df
