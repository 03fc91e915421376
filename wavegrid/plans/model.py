"""Tables of the engine and how they are made from other tables.

series       image_id STRING, c INT, x INT, y INT, values ARRAY<DOUBLE> (one element for each frame)
voxels       image_id STRING, c INT, x INT, y INT, t INT, value DOUBLE
cell_labels  image_id STRING, mask_name STRING, x INT, y INT, label BIGINT (0 is background)
track_labels image_id STRING, t INT, x INT, y INT, label BIGINT
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXEL = ("image_id", "x", "y")


def voxels(series: DataFrame) -> DataFrame:
    """One row for each element of each series."""
    return series.select("image_id", "c", "x", "y", F.posexplode("values").alias("t", "value"))


def series(voxel_rows: DataFrame) -> DataFrame:
    """Series from voxels, in the order of t. A group is one pixel's frames of one channel."""
    rows = voxel_rows.groupBy("image_id", "c", "x", "y").agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("at"))
    return rows.select("image_id", "c", "x", "y", F.transform("at", lambda a: a["value"]).alias("values"))


def dense(voxel_rows: DataFrame, frames: int) -> DataFrame:
    """Series of `frames` elements; missing frames count 0."""
    rows = voxel_rows.groupBy("image_id", "c", "x", "y").agg(F.map_from_entries(F.collect_list(F.struct("t", "value"))).alias("at"))
    values = F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda t: F.coalesce(F.try_element_at("at", t), F.lit(0.0)))
    return rows.select("image_id", "c", "x", "y", values.alias("values"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as an image 25 wide with 2 channels of 32 frames."""
    value = lambda c: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda t: F.get("embedding", 2 * t + c).cast("double"))
    channels = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), value(c).alias("values")) for c in range(2)])).alias("s")
    rows = table(spark, sf_dir, "embeddings").select(F.expr("cast(vec_id div 25 as int)").alias("x"), F.expr("cast(vec_id % 25 as int)").alias("y"), channels)
    return rows.select(F.lit("E").alias("image_id"), "s.c", "x", "y", "s.values")


def embedding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.lit("E").alias("image_id"), F.lit("all").alias("mask_name"), F.expr("cast(vec_id div 25 as int)").alias("x"),
        F.expr("cast(vec_id % 25 as int)").alias("y"), (F.col("label") + 1).cast("bigint").alias("label"),
    )


def event_axes(spark: SparkSession, sf_dir: str):
    """(first day, number of days, event types in alphabetical order) of the events image: a frame for each day, a channel for each type."""
    day = F.to_date("ts")
    row = table(spark, sf_dir, "events").agg(F.min(day), F.datediff(F.max(day), F.min(day)) + 1, F.sort_array(F.collect_set("event_type"))).first()
    return row[0], row[1] or 0, row[2]


def event_series(spark: SparkSession, sf_dir: str, axes=None) -> DataFrame:
    """Events as an image 10 wide: a pixel for each user, a channel for each type, a frame for each day. axes: event_axes(), if known."""
    first, days, types = axes or event_axes(spark, sf_dir)
    kind = (F.array_position(F.array(*map(F.lit, types)), F.col("event_type")) - 1).cast("int")
    summed = table(spark, sf_dir, "events").groupBy("user_id", kind.alias("c"), F.datediff(F.to_date("ts"), F.lit(first)).alias("t")).agg(F.sum("value").alias("value"))
    pixels = summed.select(
        F.lit("V").alias("image_id"), "c", F.expr("cast(user_id div 10 as int)").alias("x"), F.expr("cast(user_id % 10 as int)").alias("y"), "t", "value"
    )
    return dense(pixels, days)


def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's static label: user_id % 7 + 1."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        F.lit("V").alias("image_id"), F.lit("all").alias("mask_name"), F.expr("cast(user_id div 10 as int)").alias("x"),
        F.expr("cast(user_id % 10 as int)").alias("y"), (F.col("user_id") % 7 + 1).cast("bigint").alias("label"),
    )


def event_tracks(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    """A label that moves: (user_id + t) % 7 + 1."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    rows = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("t"))
    return rows.select(
        F.lit("V").alias("image_id"), "t", F.expr("cast(user_id div 10 as int)").alias("x"),
        F.expr("cast(user_id % 10 as int)").alias("y"), ((F.col("user_id") + F.col("t")) % 7 + 1).cast("bigint").alias("label"),
    )


def sales_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as an image 10 wide: a pixel for each supplier, a channel for each return flag, a frame for each month."""
    items = table(spark, sf_dir, "lineitem")
    number = F.expr("year(l_shipdate) * 12 + month(l_shipdate)")
    first, last, flags = items.agg(F.min(number), F.max(number), F.sort_array(F.collect_set("l_returnflag"))).first()
    flag = (F.array_position(F.array(*map(F.lit, flags)), F.col("l_returnflag")) - 1).cast("int")
    summed = items.groupBy("l_suppkey", flag.alias("c"), (number - first).cast("int").alias("t")).agg((F.sum("l_extendedprice") / 1e5).alias("value"))
    pixels = summed.select(
        F.lit("L").alias("image_id"), "c", F.expr("cast(l_suppkey div 10 as int)").alias("x"), F.expr("cast(l_suppkey % 10 as int)").alias("y"), "t", "value"
    )
    return dense(pixels, last - first + 1)


def sales_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.lit("L").alias("image_id"), F.lit("all").alias("mask_name"), F.expr("cast(s_suppkey div 10 as int)").alias("x"),
        F.expr("cast(s_suppkey % 10 as int)").alias("y"), (F.col("s_nationkey") + 1).cast("bigint").alias("label"),
    )
