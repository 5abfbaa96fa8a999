"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that surround keys without belonging to them.
BLANKS = " \t\r\n 　"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def clean_key(key: Column) -> Column:
    """A key without surrounding blanks and letter case."""
    return F.lower(F.btrim(key, F.lit(BLANKS)))


def latest(rows: DataFrame, key: str | list[str], columns: list[str], version: str = "updated_at") -> DataFrame:
    """The latest row of every key (one column or several) of a versioned table, with ``key`` and ``columns``.

    One shuffle on the key with map-side combine. Rows with equal versions (re-deliveries) are settled by the other
    columns' order, so the result is the same on every run; a null version counts as the oldest. A null key is a key.
    Columns whose type has no order (maps) are not accepted.
    """
    keys = [key] if isinstance(key, str) else key
    others = [c for c in columns if c not in (*keys, version)]
    state = F.struct(F.coalesce(F.col(version).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("_v"), F.col(version), *others)
    picked = rows.groupBy(*keys).agg(F.max(state).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns if c not in keys])
