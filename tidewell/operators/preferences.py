"""Preference signals: what readers say and do about stories, how it is kept, and what profiles are built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import values as V
from tidewell.operators.merging import upsert
from tidewell.operators.reading import implicit_events

COLD_START = 5
SIGNAL = ["user_id", "story_id", "dimension", "target", "origin"]


def behavioural_signals(events: DataFrame, stories: DataFrame) -> DataFrame:
    """Signals of direct events on known stories: opening a source speaks for the source, all else for the first topic tag or the category.

    events: user_id, story_id, event_type, origin, epoch, ordinal; stories: story_id, category, source, topic_tags. Of several
    events with one target the last stands."""
    weight, sure = (F.create_map(*(F.lit(x) for k, v in V.BEHAVIOUR.items() for x in (k, v[i]))) for i in (0, 1))
    e = events.where(F.col("event_type").isin(list(V.BEHAVIOUR)) & F.col("story_id").isNotNull() & (F.coalesce("origin", F.lit("direct")) == "direct")).drop("origin")
    of_source = F.col("event_type") == "source_open"
    tags = F.filter("topic_tags", lambda t: F.trim(t) != "")
    j = e.join(stories, "story_id").select("user_id", "story_id", F.when(of_source, "source").otherwise("topic").alias("dimension"), F.when(of_source, F.col("source")).otherwise(F.coalesce(F.get(tags, F.lit(0)), F.col("category"))).alias("target"), F.lit("behavioral").alias("origin"), F.lit("more").alias("sentiment"), F.element_at(weight, F.col("event_type")).alias("weight"), F.element_at(sure, F.col("event_type")).alias("confidence"), F.col("epoch").alias("updated_epoch"), "ordinal")
    w = Window.partitionBy(*SIGNAL).orderBy(F.desc("updated_epoch"), F.desc("ordinal"))
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "ordinal")


def set_signals(signals: DataFrame, changes: DataFrame) -> DataFrame:
    """Signals after changes, one for each key: a sentiment sets the signal, none clears it. Both have the columns of SIGNAL."""
    kept = signals.join(changes.select(*SIGNAL), SIGNAL, "left_anti")
    return kept.unionByName(changes.where("sentiment is not null").select(*signals.columns))


def usable(signals: DataFrame) -> DataFrame:
    """Explicit signals, and behavioural ones of readers with such signals on at least five stories."""
    of = signals.where("origin = 'behavioral'").groupBy("user_id").agg(F.count_distinct("story_id").alias("_n")).where(F.col("_n") >= COLD_START).select("user_id")
    return signals.where("origin = 'explicit'").unionByName(signals.where("origin = 'behavioral'").join(of, "user_id", "left_semi").select(*signals.columns))


def signal_basis(signals: DataFrame, stories: DataFrame, implicit: bool = True) -> DataFrame:
    """What profiles are built from: user_id, story_id, category, source, text, sentiment, reason, weight, updated_epoch, origin.

    The target of a signal stands for the part of the story that it speaks of; stories have story_id, category, source,
    title, summary, topic_tags, entity_tags. Signals of unknown stories are left out."""
    s = usable(signals)
    if not implicit:
        s = s.where("origin = 'explicit'")
    d, target = F.col("dimension"), F.col("target")
    j = s.join(stories.withColumnRenamed("source", "story_source"), "story_id")
    topics, entities = (F.when(d == k, F.array(target)).otherwise(F.col(c)) for k, c in (("topic", "topic_tags"), ("entity", "entity_tags")))
    text = F.concat_ws(" ", F.when(d == "topic", target).otherwise(F.col("title")), F.when(d == "entity", target).otherwise(F.col("summary")), topics, entities)
    return j.select(
        "user_id",
        "story_id",
        F.when(d == "topic", target).otherwise(F.col("category")).alias("category"),
        F.when(d == "source", target).otherwise(F.col("story_source")).alias("source"),
        text.alias("text"),
        "sentiment",
        F.when(d == "repetition", "repetitive").otherwise(d).alias("reason"),
        (F.col("weight") * F.col("confidence")).alias("weight"),
        "updated_epoch",
        F.when(F.col("origin") == "behavioral", "implicit").otherwise("explicit").alias("origin"),
    )


def legacy_basis(feedback: DataFrame, events: DataFrame, stories: DataFrame, implicit: bool = True) -> DataFrame:
    """The basis of readers without signals: feedback on stories, and what they did, if it touches at least five stories.

    feedback: user_id, story_id, sentiment, reason, updated_epoch; events as for implicit_events, with epoch."""
    told = stories.select("story_id", "category", "source", F.concat_ws(" ", "title", "summary").alias("text"))
    out = feedback.join(told, "story_id").select("user_id", "story_id", "category", "source", "text", "sentiment", "reason", F.lit(1.0).alias("weight"), "updated_epoch", F.lit("explicit").alias("origin"))
    if not implicit:
        return out
    e = implicit_events(events.where(F.col("story_id").isNotNull()))
    warm = e.groupBy("user_id").agg(F.count_distinct("story_id").alias("_n")).where(F.col("_n") >= COLD_START).select("user_id")
    done = e.join(warm, "user_id", "left_semi").join(told, "story_id").select("user_id", "story_id", "category", "source", "text", F.lit("more").alias("sentiment"), F.lit(None).cast("string").alias("reason"), "weight", F.col("epoch").alias("updated_epoch"), F.lit("implicit").alias("origin"))
    return out.unionByName(done)


def basis(signals: DataFrame, feedback: DataFrame, events: DataFrame, stories: DataFrame) -> DataFrame:
    """Signals for the readers who have usable ones, the older records for the others."""
    have = usable(signals).select("user_id").distinct()
    old = legacy_basis(feedback, events, stories).join(have, "user_id", "left_anti")
    return signal_basis(signals, stories).unionByName(old.select("user_id", "story_id", "category", "source", "text", "sentiment", "reason", "weight", "updated_epoch", "origin"))


def record_feedback(stories: DataFrame, items: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback by story and by item after what was given, one row for each reader and item; no sentiment takes it back.

    stories: user_id, story_id, sentiment, reason; items: user_id, item_id, sentiment; given: user_id, item_id, story_id,
    sentiment, reason. What was said of an entity is kept as said of the topic; of items of one story the last id counts."""
    per_item = items.join(given.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").unionByName(given.where("sentiment is not null").select("user_id", "item_id", "sentiment"))
    s = given.where("story_id is not null").withColumn("_n", F.row_number().over(Window.partitionBy("user_id", "story_id").orderBy(F.desc("item_id")))).where("_n = 1")
    reason = F.when(F.col("reason") == "entity", "topic").otherwise(F.col("reason")).alias("reason")
    per_story = stories.join(s.select("user_id", "story_id"), ["user_id", "story_id"], "left_anti").unionByName(s.where("sentiment is not null").select("user_id", "story_id", "sentiment", reason))
    return per_story, per_item


def migrated_feedback(stories: DataFrame, items: DataFrame, news: DataFrame) -> DataFrame:
    """Feedback by story (user_id, story_id, sentiment, reason, updated_epoch) after that by item, whose stories news (item_id, story_id) names."""
    j = items.join(news.where("story_id is not null"), "item_id")
    last = j.withColumn("_n", F.row_number().over(Window.partitionBy("user_id", "story_id").orderBy(F.desc("updated_epoch"), F.desc("item_id")))).where("_n = 1")
    return upsert(stories, last.select("user_id", "story_id", "sentiment", F.lit("topic").alias("reason"), "updated_epoch").select(*stories.columns), ["user_id", "story_id"])


def forgotten(tables: list[DataFrame], readers: DataFrame) -> list[DataFrame]:
    """The tables without the rows of these readers."""
    return [t.join(readers.select("user_id"), "user_id", "left_anti") for t in tables]


def set_states(states: DataFrame, changes: DataFrame, field: str, now: int) -> DataFrame:
    """Item states (user_id, item_id, read_at, saved_at, archived_at) after changes (user_id, item_id, on) of one field: the time, or null."""
    c = changes.groupBy("user_id", "item_id").agg(F.bool_or("on").alias("_on"))
    j = states.join(c, ["user_id", "item_id"], "full")
    return j.select("user_id", "item_id", *(F.when(F.col("_on").isNull(), F.col(f)).otherwise(F.when(F.col("_on"), F.lit(now))).alias(f) if f == field else F.col(f) for f in ("read_at", "saved_at", "archived_at")))


def mark_visits(visits: DataFrame, seen: DataFrame) -> DataFrame:
    """(user_id, last_visit): the newest visit of each reader."""
    return visits.unionByName(seen).groupBy("user_id").agg(F.max("last_visit").alias("last_visit"))


def visible(rows: DataFrame, readers: DataFrame, allowed: DataFrame, user: str | None = None) -> DataFrame:
    """Rows with the reader who may see them: readers (user_id, email) whose address, in lower case, is allowed (email).

    With user, the name of a column of rows, each reader sees the own rows only."""
    who = readers.join(allowed.select(F.col("email").alias("_email")), F.lower("email") == F.col("_email"), "left_semi").select(F.col("user_id").alias("seen_by"))
    return rows.join(who, F.col(user) == F.col("seen_by")).drop(user).withColumnRenamed("seen_by", user) if user else rows.join(who)


def active_groups(kind: str, keywords: Column) -> Column:
    """The groups of a kind of which any keyword is among a reader's, in their own order."""
    held = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.lower(F.trim(k)))
    return F.array_compact(F.array(*(F.when(F.arrays_overlap(held, F.array(*map(F.lit, words))), group) for group, words in V.KEYWORD_GROUPS[kind].items())))


def keywords_of(kind: str, groups: Column) -> Column:
    """The keywords of the groups that are on, each once, in the order of the groups; other names turn nothing on."""
    on = F.coalesce(groups, F.array().cast("array<string>"))
    lists = [F.when(F.array_contains(on, group), F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")) for group, words in V.KEYWORD_GROUPS[kind].items()]
    return F.array_distinct(F.concat(*lists))
