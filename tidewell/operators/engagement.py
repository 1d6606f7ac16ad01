"""What readers do: event validation, exposure attribution, funnels, source value and quality, exposure islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as X

OUTCOMES = ["source_open", "save", "read", "feedback", "archive", "fast_read"]
EVENT_TYPES = ["impression", "fast_read", "source_open", "read", "save", "archive", "feedback"]
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


SORTS = ["for-you", "top", "latest"]
BATCH, JSON_CHARS, REASONS, REASON_CHARS = 100, 5000, 20, 200


def event_problems(df: DataFrame) -> DataFrame:
    """Adds problems: what is wrong with an event. Columns that df lacks are taken as not given.

    event_type, session_id, news_item_id, story_cluster_id, context_uuid, rank, model_rank, rank_score, feed, sort_mode,
    policy, origin as they are; metadata and score_components as JSON text; reasons as an array."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    given = lambda c, ok: has(c).isNotNull() & ~F.coalesce(ok, F.lit(False))
    whole = lambda c: given(c, (has(c).cast("double") >= 0) & (has(c).cast("double") == F.floor(has(c).cast("double"))))
    number = has("rank_score").cast("double")
    reasons = F.col("reasons") if "reasons" in df.columns else F.lit(None).cast("array<string>")
    fits = (F.size(reasons) <= REASONS) & F.forall(reasons, lambda r: F.coalesce(F.length(r).between(1, REASON_CHARS), F.lit(False))) & (F.length(F.to_json(reasons)) <= JSON_CHARS)
    bad = {
        "event_type": ~F.coalesce(has("event_type").isin(EVENT_TYPES), F.lit(False)),
        "session_id": ~F.coalesce(has("session_id").rlike(UUID), F.lit(False)),
        **{c: given(c, has(c).rlike(UUID)) for c in ("news_item_id", "story_cluster_id", "context_uuid")},
        "rank": whole("rank"),
        "model_rank": whole("model_rank"),
        "rank_score": given("rank_score", ~F.isnan(number) & (F.abs(number) != float("inf"))),
        "feed": given("feed", F.length(has("feed")) <= 100),
        "sort_mode": given("sort_mode", has("sort_mode").isin(SORTS)),
        "policy": given("policy", F.length(has("policy")).between(1, 100)),
        "origin": given("origin", has("origin").isin("direct", "bulk", "automatic")),
        "metadata": given("metadata", F.length(has("metadata")) <= JSON_CHARS),
        "score_components": given("score_components", has("score_components").rlike(r"^\s*\{") & (F.length(has("score_components")) <= JSON_CHARS)),
        "reasons": reasons.isNotNull() & ~F.coalesce(fits, F.lit(False)),
    }
    return df.withColumn("problems", F.array_compact(F.array(*(F.when(c, k) for k, c in bad.items()))))


def accepted_batches(df: DataFrame, batch: str) -> DataFrame:
    """(batch, n, n_bad, accepted): a batch stands whole, if it has at most 100 events and none has a problem."""
    out = event_problems(df).groupBy(batch).agg(F.count("*").alias("n"), F.count_if(F.size("problems") > 0).alias("n_bad"))
    return out.withColumn("accepted", (F.col("n") <= BATCH) & (F.col("n_bad") == 0))


def state_events(states: DataFrame) -> DataFrame:
    """(user_id, item_id, at, event_type): what a change of an item's state says: saved, else read, else archived.

    states: user_id, item_id, at, saved_at, read_at, archived_at, one row for each state in time."""
    w = Window.partitionBy("user_id", "item_id").orderBy("at")
    turned = lambda c: F.lag(c).over(w).isNull() & F.col(c).isNotNull()
    event = F.when(turned("saved_at"), "save").when(turned("read_at"), "read").when(turned("archived_at"), "archive")
    return states.select("user_id", "item_id", "at", F.when(F.row_number().over(w) > 1, event).alias("event_type")).where("event_type is not null")


def ignored(feedback: DataFrame, stories: DataFrame, by: str, most: int = 5) -> DataFrame:
    """(user_id, label, n): the sources or categories of the stories of which a reader wants less, the most frequent ones."""
    n = feedback.where("sentiment = 'less'").join(stories.select("story_id", F.col(by).alias("label")), "story_id").groupBy("user_id", "label").agg(F.count("*").alias("n"))
    return n.withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "label"))).where(F.col("_r") <= most).drop("_r")


def since(events: DataFrame, as_of: int, days: int = 180, at: str = "epoch") -> DataFrame:
    return events.where(F.col(at) >= as_of - days * 86400)


def impression_key(df: DataFrame) -> Column:
    """user:context:story for impressions that can be attributed, else null."""
    return F.when((F.col("event_type") == "impression") & F.col("context_id").isNotNull() & F.col("story_id").isNotNull(), F.concat_ws(":", F.col("user_id").cast("string"), "context_id", F.col("story_id").cast("string")))


def exposures(events: DataFrame) -> DataFrame:
    """One row per (context_id, story_id, policy) that was shown, with its best rank; events of bulk or automatic origin don't count."""
    e = events.where((F.col("event_type") == "impression") & F.col("context_id").isNotNull() & F.col("policy").isNotNull())
    return e.groupBy("context_id", "story_id", "policy").agg(F.min("rank").alias("rank"))


def outcomes(events: DataFrame) -> DataFrame:
    direct = ~F.coalesce("origin", F.lit("direct")).isin("bulk", "automatic")
    return events.where(F.col("event_type").isin(OUTCOMES) & direct)


def engagement(events: DataFrame) -> DataFrame:
    """Per policy: impressions, distinct exposures with an open, save or feedback, their rates; and outcomes without an exposure."""
    shown = exposures(events)
    acted = outcomes(events).groupBy("context_id", "story_id", "policy").agg(*(F.max(F.when(F.col("event_type") == t, 1).otherwise(0)).alias(t) for t in ("source_open", "save", "feedback")))
    j = shown.join(acted, ["context_id", "story_id", "policy"], "full")
    seen = F.col("rank").isNotNull()
    n = lambda c: F.sum(F.when(seen, F.coalesce(c, F.lit(0))).otherwise(0)).cast("long")
    out = j.groupBy("policy").agg(F.count_if(seen).alias("impressions"), n("source_open").alias("opened"), n("save").alias("saved"), n("feedback").alias("answered"), F.count_if(~seen).alias("unattributed"))
    rate = lambda c: X.percentage(F.col(c), F.col("impressions")).alias(f"{c}_pct")
    return out.select("policy", "impressions", "opened", "saved", "answered", "unattributed", rate("opened"), rate("saved"), rate("answered"))


def rank_buckets(events: DataFrame) -> DataFrame:
    """Impressions and opens by rank 1-5, 6-10 and 11+."""
    opened = outcomes(events).where("event_type = 'source_open'").select("context_id", "story_id", "policy").distinct().withColumn("hit", F.lit(1))
    bucket = F.when(F.col("rank") < 5, "1-5").when(F.col("rank") < 10, "6-10").otherwise("11+")
    return exposures(events).join(opened, ["context_id", "story_id", "policy"], "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("impressions"), F.sum(F.coalesce("hit", F.lit(0))).cast("long").alias("opens"))


def reader_value(events: DataFrame, story_sources: DataFrame) -> DataFrame:
    """(source_id, value): an open is worth 1 to the canonical source, a save 3 and a read 2 in equal parts to all sources of the story."""
    e = events.where(F.col("event_type").isin("source_open", "save", "read") & ~F.coalesce("origin", F.lit("direct")).isin("bulk", "automatic")).groupBy("story_id", "event_type").agg(F.count("*").alias("n"))
    s = story_sources.withColumn("among", F.count("*").over(Window.partitionBy("story_id")))
    worth = F.when(F.col("event_type") == "source_open", F.when(F.col("contribution") == "canonical", F.col("n").cast("double")).otherwise(0.0)).otherwise(F.col("n") * F.when(F.col("event_type") == "save", 3.0).otherwise(2.0) / F.col("among"))
    return e.join(s, "story_id").groupBy("source_id").agg(F.sum(worth).alias("value"))


def source_quality(observations: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Reliability, yields, values, label and recommendation of each source."""
    o = observations.groupBy("source_id").agg(F.count("*").alias("runs"), F.count_if("succeeded").alias("ok"), *(F.sum(c).alias(c) for c in ("parsed", "eligible", "unique_stories", "selected", "confirmed")), F.round(F.avg("duration_ms") if "duration_ms" in observations.columns else F.lit(0.0), 6).alias("mean_duration_ms"))
    o = o.withColumn("value", F.lit(0.0)) if values is None else o.join(values, "source_id", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    pct = lambda a, b: X.percentage(F.col(a), F.col(b))
    o = o.withColumns({"reliability": pct("ok", "runs"), "fresh_yield": pct("eligible", "parsed"), "unique_yield": pct("unique_stories", "eligible"), "selection_value": pct("selected", "unique_stories"), "confirmation_value": pct("confirmed", "unique_stories"), "reader_value": X.clamp(X.js_round(F.col("value") / F.greatest(F.lit(1), F.col("selected")) * 25), 0, 100).cast("long")})
    label = F.when(F.col("runs") < 5, "Collecting data").when(F.col("reliability") < 75, "Often unavailable").when(F.col("fresh_yield") < 10, "Low fresh yield").when(F.col("selection_value") >= 35, "Often selected").when(F.col("confirmation_value") >= 35, "Useful confirmation").when(F.col("reliability") >= 95, "Reliable").otherwise("Needs review")
    o = o.withColumn("label", label)
    advice = F.when((F.col("runs") >= 8) & (F.col("reliability") < 40), "consider_pausing").when(F.col("label").isin("Needs review", "Low fresh yield", "Often unavailable"), "review").otherwise("keep")
    return o.withColumn("recommendation", advice).select("source_id", "runs", "reliability", "fresh_yield", "unique_yield", "selection_value", "confirmation_value", "reader_value", "label", "recommendation", "mean_duration_ms")


def exposure_islands(samples: DataFrame, least_ms: int = 500) -> DataFrame:
    """(item_id, started, seen_at): the first moment at which an item has been half visible for least_ms without a break.

    samples: (item_id, at_ms, ratio, visible); a sample holds until the next one."""
    w = Window.partitionBy("item_id").orderBy("at_ms")
    s = samples.withColumn("on", F.coalesce((F.col("ratio") >= 0.5) & F.col("visible"), F.lit(False))).withColumn("turn", F.when(F.col("on") == F.lag("on").over(w), 0).otherwise(1)).withColumn("next", F.lead("at_ms").over(w))
    s = s.withColumn("island", F.sum("turn").over(w))
    runs = s.where("on").groupBy("item_id", "island").agg(F.min("at_ms").alias("started"), F.max(F.coalesce("next", F.col("at_ms"))).alias("ended"))
    return runs.where(F.col("ended") - F.col("started") >= least_ms).groupBy("item_id").agg(F.min("started").alias("started")).withColumn("seen_at", F.col("started") + least_ms)


def unread_after(items: DataFrame, touched: DataFrame, as_of: int, hours: int = 24) -> DataFrame:
    """How many items older than that are neither read nor archived."""
    return items.where(F.col("published_epoch") < as_of - hours * 3600).join(touched, "item_id", "left_anti").agg(F.count("*").alias("n_unread"))
