"""Connected components of links, by large and small stars in turn; checkpoints cut the lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> None:
    """Where no checkpoint folder is set, one of this machine, if it runs all of Spark; a cluster must name a shared one."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewell-")
    spark.sparkContext.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables, below the checkpoint folder."""
    checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ends of the links (left_id, right_id): the least id that links lead to.

    The least neighbours are found by an aggregate and joined afterwards, so the links of a hot node are in no one task,
    and the number of rounds grows with the logarithm of a component's size."""
    checkpoints(links.sparkSession)
    ends = links.select(F.col("left_id").alias("u")).union(links.select(F.col("right_id").alias("u"))).distinct().checkpoint()
    edges = links.select(F.greatest("left_id", "right_id").alias("u"), F.least("left_id", "right_id").alias("v")).where("u <> v").distinct().checkpoint()
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
        before, state = state, _state(edges)
        if state == before:
            break
    return ends.join(edges, "u", "left").select(F.col("u").alias("id"), F.coalesce("v", "u").alias("component"))
