"""Wide and long tables of per-cell statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDS = ("mask_index", "image_filename", "mask_filename")


def channel_names(names: Sequence[str] | None, channels: int, default: str = "channel_{}") -> list[str]:
    if names is None:
        return [default.format(i) for i in range(channels)]
    if len(names) != channels:
        raise ValueError(f"{channels} channels have {len(names)} names")
    return list(names)


def column_name(channel: str, feature: str, stat: str, mask: str) -> str:
    return f"{channel}_{feature}_{stat}" + ("" if mask == "all" else f"___{mask}")


def wide_columns(names: Sequence[str], kinds: Sequence[tuple[str, str]], masks: Sequence[str]) -> list[str]:
    """Column names in order: mask, then feature and statistic, then channel."""
    return [column_name(n, f, s, m) for m in masks for f, s in kinds for n in names]


def named(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long cells with ids and channel names; columns as in reshape_to_longform()."""
    channel = F.get(F.array(*map(F.lit, names)), F.col("c"))
    ids = [F.col("label").alias("mask_index"), *[F.col(c) if c in cells.columns else F.lit(None).cast("string").alias(c) for c in IDS[1:]]]
    return cells.select(*ids, channel.alias("channel"), "feature", "stat", F.col("mask_name").alias("mask_type"), "value")


def create_wide(cells: DataFrame, names: Sequence[str], kinds: Sequence[tuple[str, str]], masks: Sequence[str]) -> DataFrame:
    """One row for each image and label, one column for each channel, feature, statistic and mask.

    The columns follow from the arguments, so no job is needed to find them.
    """
    rows = named(cells, names)
    suffix = F.when(F.col("mask_type") == "all", "").otherwise(F.concat(F.lit("___"), "mask_type"))
    rows = rows.withColumn("_m", F.concat(F.concat_ws("_", "channel", "feature", "stat"), suffix))
    return rows.groupBy(*IDS).pivot("_m", wide_columns(names, kinds, masks)).agg(F.first("value"))


def reshape_to_longform(wide: DataFrame, names: Sequence[str] | None = None, compat: bool = False) -> DataFrame:
    """(mask_index, image_filename, mask_filename, channel, feature, stat, mask_type, value) from a wide table.

    Column names are parsed from their ends: the statistic before the mask, the feature after the
    longest known channel name (the first token where names are not given). compat parses with
    one regular expression instead, as tables made elsewhere expect: it takes the two tokens
    before the statistic for channel and feature and keeps underscores before the mask.
    """
    values = [c for c in wide.columns if c not in IDS]
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("measurement"), F.col(f"`{c}`").cast("double").alias("value")) for c in values]))
    long = wide.select(*IDS, entries.alias("e")).select(*IDS, "e.*")
    m = F.col("measurement")
    if compat:
        pattern = r"([^_]+)_([^_]+)_(mean|sd)(?:_(.*))?"
        part = lambda k: F.nullif(F.regexp_extract(m, pattern, k), F.lit(""))
        channel, feature, stat, mask = part(1), part(2), part(3), F.coalesce(part(4), F.lit("all"))
    else:
        known = sorted(names or [], key=len, reverse=True)
        base, mask = F.regexp_extract(m, r"^(.*?)(?:___.*)?$", 1), F.coalesce(F.nullif(F.regexp_extract(m, r"^.*?___(.*)$", 1), F.lit("")), F.lit("all"))
        channel = F.coalesce(*[F.when(base.startswith(f"{n}_"), F.lit(n)) for n in known], F.regexp_extract(base, r"^([^_]+)_", 1))
        stat = F.regexp_extract(base, r"_(mean|sd)$", 1)
        feature = F.substring(base, F.length(channel) + 2, F.length(base) - F.length(channel) - F.length(stat) - 2)
    return long.select(*IDS, channel.alias("channel"), feature.alias("feature"), stat.alias("stat"), mask.alias("mask_type"), "value")


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables; columns that one lacks are null."""
    if not tables:
        raise ValueError("there are no tables to join")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
