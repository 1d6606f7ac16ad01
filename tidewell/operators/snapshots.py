"""Rankings kept as tables, so that a reader goes on in the ranking in which a page was read, without ranking again.

A snapshot has two tables: places, partitioned by context and by ranges of SPAN places, and items, partitioned by context
and by a hash of the item. A page reads the one partition of items that holds the cursor, and of places the ranges that
the page touches: two partitions at most for pages up to SPAN, however long the ranking is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.engagement import UUID

SPAN, SLOTS = 256, 64
ITEM, PLACES, ITEMS = "item_id", "places", "items"


def resolve(cursor: str | None, context: str | None, ranked_at: str | None, known: set[str] | None = None, new: tuple[str, str] | None = None) -> tuple[str, str, bool]:
    """(context, ranked_at, goes on): the ranking of a request, where it names one that can be gone on with, else the new one.

    It must have a cursor, a context that is a UUID, one of known if that is given, and a time that can be read."""
    import datetime
    import re
    import uuid

    try:
        at = datetime.datetime.fromisoformat((ranked_at or "").replace("Z", "+00:00"))
        at = at if at.tzinfo else at.replace(tzinfo=datetime.timezone.utc)
    except ValueError:
        at = None
    if cursor and context and re.match(UUID, context) and at and (known is None or context in known):
        return context, at.astimezone(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03}Z", True
    now = datetime.datetime.now(datetime.timezone.utc)
    return (*(new or (str(uuid.uuid4()), now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03}Z")), False)


def keep_ranking(ranked: DataFrame, path: str, context: str) -> None:
    """Writes the snapshot of a context: ranked has item_id, position from 0, and what a page shows. Written again, it replaces itself."""
    rows = ranked.withColumns({"span": F.floor(F.col("position") / SPAN), "slot": F.pmod(F.xxhash64(F.col(ITEM).cast("string")), F.lit(SLOTS))})
    places = rows.drop("slot").repartition("span").sortWithinPartitions("span", "position")
    places.write.mode("overwrite").partitionBy("span").parquet(f"{path}/{PLACES}/context={context}")
    items = rows.select(ITEM, "position", "slot").repartition("slot").sortWithinPartitions("slot", ITEM)
    items.write.mode("overwrite").partitionBy("slot").parquet(f"{path}/{ITEMS}/context={context}")


def place_of(spark: SparkSession, path: str, context: str, item: str | None) -> int:
    """The first place behind an item, 0 where the ranking has none such."""
    if item is None:
        return 0
    slot = spark.range(1).select(F.pmod(F.xxhash64(F.lit(item)), F.lit(SLOTS))).first()[0]
    found = spark.read.parquet(f"{path}/{ITEMS}").where((F.col("context") == context) & (F.col("slot") == slot) & (F.col(ITEM).cast("string") == item))
    last = found.agg(F.max("position")).first()[0]
    return 0 if last is None else last + 1


def page(spark: SparkSession, path: str, context: str, item: str | None, limit: int = 30) -> DataFrame:
    """The items of a context that follow an item, from the ranges that hold them."""
    start = place_of(spark, path, context, item)
    rows = spark.read.parquet(f"{path}/{PLACES}").where(F.col("context") == context)
    held = rows.where(F.col("span").between(start // SPAN, (start + limit - 1) // SPAN))
    return held.where((F.col("position") >= start) & (F.col("position") < start + limit)).drop("context", "span")
