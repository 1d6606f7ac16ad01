"""Writing a stream of events so that a batch that comes again adds nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def insert_once(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: new rows by key, the first by order of equal ones; null keys never conflict.

    A batch is a partition of the table, named by its number, and is written whole in the place of what an earlier try
    left there; keys are held against earlier batches only. So a batch that was written, but not noted as done, gives the
    same rows when it comes again, and a reader of the table sees each key once."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.where(F.col(key).isNotNull())
        first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
        if _exists(spark, path):
            earlier = spark.read.option("basePath", path).parquet(path).where(F.col("batch") < number)
            first = first.join(earlier.select(key), key, "left_anti").select(*batch.columns)
        first.unionByName(batch.where(F.col(key).isNull())).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
