"""The relations that operators work on, as views of the given tables; each is one projection, so scans stay pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ["AI / Labs", "Software / Engineering", "Cybersecurity", "Świat / Biznes / Makro", "Świat / Geopolityka", "Software / Status", "General"]
#: The clock of queries over the given tables: 2024-01-31, in seconds.
AS_OF = 1706659200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _category(c: str):
    out = F.lit(CATEGORIES[6])
    for i in range(5, -1, -1):
        out = F.when(F.col(c) % 7 == i, CATEGORIES[i]).otherwise(out)
    return out


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, title, summary, source, category, priority, published_epoch: the first 80 characters of a text are its title, all the others its summary."""
    flat = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"),
        F.substring(flat, 1, 80).alias("title"),
        F.expr("substring(replace(text, '\n', ' '), 81)").alias("summary"),
        "source",
        _category("doc_id").alias("category"),
        (F.col("doc_id") % 5 + 1).alias("priority"),
        (F.lit(AS_OF) - (F.col("doc_id") * 37) % 240 * 3600).alias("published_epoch"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, epoch, day, user_id, event_type, origin, story_id, session_id, context_id, rank, policy."""
    e = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    kind = F.when(F.col("event_type") == "view", "impression").when(F.col("event_type") == "click", "source_open").when(F.col("event_type") == "purchase", "save").when(F.col("event_type") == "signup", "read").otherwise("feedback")
    origin = F.when(F.col("event_id") % 10 == 0, "bulk").when(F.col("event_id") % 10 == 1, "automatic").when(F.col("event_id") % 10 == 2, F.lit(None).cast("string")).otherwise("direct")
    session = F.concat(F.col("user_id").cast("string"), F.lit("-"), day)
    return e.select(
        "event_id",
        F.unix_timestamp("ts").alias("epoch"),
        day.alias("day"),
        "user_id",
        kind.alias("event_type"),
        origin.alias("origin"),
        F.get_json_object("props", "$.k").cast("long").alias("story_id"),
        session.alias("session_id"),
        session.alias("context_id"),
        (F.col("event_id") % 15).alias("rank"),
        F.concat(F.lit("v"), (F.col("event_id") % 2 + 1).cast("string")).alias("policy"),
    )


def story_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """story_id, source_id, contribution: two sources of each story, the first its canonical one."""
    s = interactions(spark, sf_dir).select("story_id").distinct()
    a = s.select("story_id", F.concat(F.lit("src"), (F.col("story_id") % 20).cast("string")).alias("source_id"), F.lit("canonical").alias("contribution"))
    b = s.select("story_id", F.concat(F.lit("src"), (F.col("story_id") * 7 % 20).cast("string")).alias("source_id"), F.lit("confirmation").alias("contribution"))
    return a.union(b.where(F.col("story_id") % 20 != F.col("story_id") * 7 % 20))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, source_id, and what one run saw of one source: months of orders, by nation of the customer."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        o.join(c, o["o_custkey"] == c["c_custkey"])
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), F.col("n_name").alias("source_id"))
        .agg(
            F.count("*").alias("parsed"),
            F.count_if(F.col("o_orderstatus") != "P").alias("eligible"),
            F.count_if(F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2")).alias("unique_stories"),
            F.count_if(F.col("o_orderpriority").startswith("1")).alias("selected"),
            F.count_if(F.col("o_orderpriority").startswith("2")).alias("confirmed"),
            (F.count_if(F.col("o_orderstatus") == "F") > 0).alias("succeeded"),
            F.max(F.col("o_orderkey") % 9000).alias("duration_ms"),
        )
    )
