"""Writes as pure functions of old and new rows: Parquet tables have no merge, so the result replaces the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old with those of new for equal keys; of new rows with one key any one stands, so deduplicate them before."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert_newest(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the largest version for each key, new ones before old ones."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_n")))).where("_r = 1").drop("_n", "_r")


def insert_ignore(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """New rows whose key is not there yet, the first of equal ones; null keys never conflict."""
    keyed = new.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
    return old.unionByName(keyed.join(old.where(F.col(key).isNotNull()).select(key), key, "left_anti").select(*new.columns)).unionByName(new.where(F.col(key).isNull()))


def merge_keep_first(old: DataFrame, new: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """(key, first, last): the first seen of old rows stays, the last seen comes from new ones."""
    o = old.select(key, F.col(first).alias("_f"), F.col(last).alias("_l"))
    return o.join(new.select(key, first, last), key, "full").select(key, F.coalesce("_f", first).alias(first), F.coalesce(last, "_l").alias(last))


def monotone(old: DataFrame, new: DataFrame, key: str, count: str) -> DataFrame:
    """(key, count): the larger of both sides."""
    return old.select(key, F.col(count).alias("_c")).join(new.select(key, count), key, "full").select(key, F.greatest(F.coalesce("_c", F.lit(0)), F.coalesce(count, F.lit(0))).alias(count))


def update_from(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """target with the columns of the matching row of source, one at most for each key; where there is none, or it has null, target's own stay."""
    s = source.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    return target.join(s, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*target.columns)


def replaced(old: DataFrame, new: DataFrame, run_col: str = "run_id") -> DataFrame:
    """The rows of old, but of the runs that new has, and those of new."""
    return old.join(new.select(run_col).distinct(), run_col, "left_anti").select(*new.columns).unionByName(new)


def replace_runs(df: DataFrame, path: str, run_col: str = "run_id") -> None:
    """Writes df so that only the runs it has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run_col).parquet(path)


def without(df: DataFrame, *others: DataFrame, on: str) -> DataFrame:
    """Rows whose key none of the others has."""
    for o in others:
        df = df.join(o.select(on), on, "left_anti")
    return df
