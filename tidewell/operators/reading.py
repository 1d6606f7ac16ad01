"""A reader's feed: preference profiles, scores, orders, exploration, sections, pages, facets."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.functions import values as V
from tidewell.operators.order import placed

PREFERENCE_LIMIT = 9


def reason_routes(basis: DataFrame) -> DataFrame:
    """(user_id, kind, key, sentiment, weight) from feedback rows (user_id, story_id, category, source, text, sentiment, reason, weight).

    No reason speaks of source, feed and keywords; source and quality of the source; topic of feed and keywords; entity of keywords;
    repetitive of the story."""
    r = F.col("reason")
    entry = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    none = F.array().cast("array<struct<kind:string,key:string>>")
    parts = [
        F.when(r.isNull() | r.isin("source", "quality"), entry("source", F.array(F.lower("source")))).otherwise(none),
        F.when(r.isNull() | (r == "topic"), entry("feed", F.array(X.feed_of(F.col("category"))))).otherwise(none),
        F.when(r.isNull() | r.isin("topic", "entity"), entry("keyword", X.feedback_keywords(F.col("text")))).otherwise(none),
        F.when((r == "repetitive") & (F.col("sentiment") == "less"), entry("story", F.array(F.col("story_id").cast("string")))).otherwise(none),
    ]
    return basis.select("user_id", "sentiment", "weight", F.explode(F.concat(*parts)).alias("e")).select("user_id", "e.kind", "e.key", "sentiment", "weight")


def preference_profile(basis: DataFrame, as_of: int) -> DataFrame:
    """(user_id, kind, key, more, less): weights that halve every 45 days; basis has updated_epoch."""
    age = (F.lit(as_of) - F.col("updated_epoch")) / 86400.0
    weighted = basis.withColumn("weight", X.half_life(age) * F.greatest(F.lit(0.0), F.coalesce("weight", F.lit(1.0))))
    side = lambda s: F.sum(F.when(F.col("sentiment") == s, F.col("weight")).otherwise(0.0)).alias(s)
    return reason_routes(weighted).groupBy("user_id", "kind", "key").agg(side("more"), side("less"))


def preference_scores(items: DataFrame, profile: DataFrame) -> DataFrame:
    """(user_id, item_id, preference) for all of a user's items (user_id, item_id, story_id, category, source, text)."""
    keys = F.concat(
        F.array(F.struct(F.lit("source").alias("kind"), F.lower("source").alias("key")), F.struct(F.lit("feed").alias("kind"), X.feed_of(F.col("category")).alias("key")), F.struct(F.lit("story").alias("kind"), F.col("story_id").cast("string").alias("key"))),
        F.transform(X.feedback_keywords(F.col("text")), lambda k: F.struct(F.lit("keyword").alias("kind"), k.alias("key"))),
    )
    e = items.select("user_id", "item_id", F.explode(keys).alias("k")).select("user_id", "item_id", "k.kind", "k.key").join(profile, ["user_id", "kind", "key"], "left")
    of = lambda kind, c, f: F.sum(F.when(F.col("kind") == kind, F.col(c) * f).otherwise(0.0))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    total = (
        F.when(F.max(F.when((F.col("kind") == "story") & F.col("less").isNotNull(), 1).otherwise(0)) == 1, -20.0).otherwise(0.0)
        + X.clamp(none(of("source", "more", 5)), 0.0, 5.0)
        - X.clamp(none(of("source", "less", 8)), 0.0, 8.0)
        + X.clamp(none(of("feed", "more", 3)), 0.0, 3.0)
        - X.clamp(none(of("feed", "less", 5)), 0.0, 5.0)
        + X.clamp(none(of("keyword", "more", 2)), 0.0, 12.0)
        - X.clamp(none(of("keyword", "less", 3)), 0.0, 16.0)
    )
    return e.groupBy("user_id", "item_id").agg(total.alias("preference"))


def freshness_boost(age_hours: Column) -> Column:
    return F.when(age_hours <= 6, 12).when(age_hours <= 24, 9).when(age_hours <= 72, 5).when(age_hours <= 168, 2).otherwise(0)


def update_boost(first_selected: Column, changed: Column, visit: Column, is_new: Column, has_changes: Column) -> Column:
    return F.when(visit.isNull(), F.when(is_new, 4).when(has_changes, 2).otherwise(0)).when(first_selected > visit, 8).when(changed > visit, 6).otherwise(0)


def ranked(items: DataFrame, sort: str = "for-you", policy: str = "v2", partition: list[str] = ()) -> DataFrame:
    """Adds rank_score and model_rank, from 0; items have editorial, preference, freshness, update, selected_epoch, item_id.

    Within each group of partition, or over all items."""
    pref = X.clamp(F.col("preference"), -PREFERENCE_LIMIT, PREFERENCE_LIMIT) if policy == "v2" else F.col("preference")
    df = items.withColumn("rank_score", (F.col("editorial") + pref + F.col("freshness") + F.col("update")).cast("double"))
    order = {"top": [("editorial", True)], "latest": [("selected_epoch", True)], "for-you": [("rank_score", True), *([("editorial", True)] if policy == "v2" else [])]}[sort] + [("item_id", False)]
    if not partition:
        return placed(df, order, "model_rank")
    by = [F.desc(c) if down else F.asc(c) for c, down in order]
    return df.withColumn("model_rank", (F.row_number().over(Window.partitionBy(*partition).orderBy(*by)) - 1).cast("long"))


def visit_flags(items: DataFrame) -> DataFrame:
    """Adds is_new, is_updated and update: what a reader with a last visit has not seen; items have first_selected, changed, visit (epochs), changes."""
    new = F.coalesce(F.col("first_selected") > F.col("visit"), F.lit(False))
    updated = ~new & F.coalesce(F.col("changed") > F.col("visit"), F.lit(False))
    return items.withColumns({"is_new": new, "is_updated": updated, "update": update_boost(F.col("first_selected"), F.col("changed"), F.col("visit"), F.array_contains("changes", "new"), F.size("changes") > 0)})


# What a place in the feed is said to rest on.
LIKED, DISLIKED, RECENT = "Matches your preferences", "Lowered by your preferences", "Recently selected"
NEW, UPDATED, EITHER = "New since your last visit", "Materially updated", "New or materially updated since your last visit"
CONFIRMED, EXPLORED = "Confirmed by {} sources", "Exploration pick"
IMPORTANT, LESS_IMPORTANT, LATEST = "High editorial importance", "Editorial importance", "Most recently selected"
# End of fixed values.


def ranking_reasons(sort: str = "for-you", policy: str = "v2") -> Column:
    """What an item's place rests on; items have editorial, preference, freshness, update, is_new, source_count, is_exploration."""
    before, after = CONFIRMED.split("{}")
    confirmed = F.when(F.col("source_count") >= 3, F.concat(F.lit(before), F.col("source_count").cast("string"), F.lit(after)))
    if sort == "latest":
        return F.array(F.lit(LATEST))
    if sort == "top":
        return F.array_compact(F.array(F.when(F.col("editorial") >= 70, IMPORTANT).otherwise(LESS_IMPORTANT), confirmed))
    moved = F.when(F.col("update") > 0, F.lit(EITHER) if policy == "v2" else F.when(F.col("is_new"), NEW).otherwise(UPDATED))
    return F.array_compact(F.array(F.when(F.col("preference") > 0, LIKED), F.when(F.col("preference") < 0, DISLIKED), F.when(F.col("freshness") >= 9, RECENT), moved, confirmed, F.when(F.col("is_exploration"), EXPLORED)))


def of_period(items: DataFrame, view: str, period: str, feed: str = "all") -> DataFrame:
    """The items of a view, a feed and a period: the latest digest's, those new or changed since the visit, or all.

    Saved and archived items are those of all periods. Items have feed, read, saved, archived, digest_date, first_selected, changed, visit."""
    df = items.where(in_view(view, F.col("read"), F.col("saved"), F.col("archived")))
    if feed != "all":
        df = df.where(F.col("feed") == feed)
    if view in ("saved", "archived") or period == "history":
        return df
    if period == "since-visit":
        return df.where(F.coalesce(F.greatest("first_selected", "changed") > F.col("visit"), F.lit(False)))
    latest = items.agg(F.max("digest_date").alias("_latest"))
    return df.join(F.broadcast(latest), F.col("digest_date") == F.col("_latest")).drop("_latest")


def explored(items: DataFrame, date_key: str, schema_key: str = "user_id") -> DataFrame:
    """At places 9, 19, ... the best item by editorial score, then by a hash of the day, from further down changes places.

    One group a reader, of all items; items have user_id, item_id, model_rank, editorial, preference."""

    def swap(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("model_rank")
        order = list(range(len(g)))
        ids, editorial, pref = g["item_id"].tolist(), g["editorial"].tolist(), g["preference"].tolist()

        def hashed(text: str) -> int:
            h = 2166136261
            units = text.encode("utf-16-le")
            for low, high in zip(units[::2], units[1::2]):
                h = (h ^ (low | high << 8)) * 16777619 & 0xFFFFFFFF
            return h

        pool = sorted((i for i in order if pref[i] >= 0), key=lambda i: (-editorial[i], hashed(f"{date_key}:{ids[i]}")))
        picked = set()
        nth = {i: n for n, i in enumerate(pool)}
        left, place = list(range(len(pool))), list(order)  # a heap; what stands at or before a slot never moves again
        for slot in range(9, len(order), 10):
            while left and place[pool[left[0]]] <= slot:
                heapq.heappop(left)
            if left:
                found, gone = pool[left[0]], order[slot]
                j = place[found]
                order[slot], order[j], place[found], place[gone] = found, gone, slot, j
                picked.add(found)
                if gone in nth:
                    heapq.heappush(left, nth[gone])
        out = g.iloc[order].copy()
        out["position"] = range(len(out))
        out["is_exploration"] = [i in picked for i in order]
        return out[[schema_key, "item_id", "position", "is_exploration"]]

    kinds = dict(items.dtypes)
    return items.select(schema_key, "item_id", "model_rank", "editorial", "preference").groupBy(schema_key).applyInPandas(swap, f"{schema_key} {kinds[schema_key]}, item_id {kinds['item_id']}, position long, is_exploration boolean")


# Fixed values.
ACTIONABLE = ["build_opportunity", "geopolitical_risk", "infrastructure_outage", "market_risk", "regulatory_risk", "security_risk"]
# End of fixed values.


def sections(items: DataFrame, partition: list[str] = ()) -> DataFrame:
    """top (5), actionable (up to 5 of the rest, by bucket), next (10), rest; items have position, from 0, and bucket."""
    rest, useful = F.col("position") >= 5, F.col("bucket").isin(ACTIONABLE)
    if partition:
        w = Window.partitionBy(*partition).orderBy("position")
        df = items.withColumn("a", F.sum(F.when(rest & useful, 1).otherwise(0)).over(w))
        act = rest & useful & (F.col("a") <= 5)
        df = df.withColumn("b", F.sum(F.when(rest & ~act, 1).otherwise(0)).over(w))
        return df.withColumn("section", F.when(~rest, "top").when(act, "actionable").when(F.col("b") <= 10, "next").otherwise("rest")).drop("a", "b")
    # one list: the few places that are actionable or next are found by limits, and rows learn them from a broadcast of 15
    act = items.where(rest & useful).select("position").orderBy("position").limit(5)
    nearest = items.where(rest & (F.col("position") < 20)).select("position").join(act, "position", "left_anti").orderBy("position").limit(10)
    named = act.withColumn("_s", F.lit("actionable")).union(nearest.withColumn("_s", F.lit("next")))
    return items.join(F.broadcast(named), "position", "left").withColumn("section", F.when(~rest, "top").otherwise(F.coalesce("_s", F.lit("rest")))).drop("_s")


def in_view(view: str, read: Column, saved: Column, archived: Column) -> Column:
    return {"archived": archived, "saved": saved & ~archived, "unread": ~read & ~archived, "all": ~archived}[view]


def facets(items: DataFrame) -> DataFrame:
    """Counts of feeds for each view, and of views: views overlap, so they are conditional sums of one pass."""
    views = {v: F.sum(F.when(in_view(v, F.col("read"), F.col("saved"), F.col("archived")), 1).otherwise(0)).cast("long").alias(f"n_{v}") for v in ("all", "unread", "saved", "archived")}
    return items.groupBy("feed").agg(*views.values())


def cursor_of(item_id: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(item_id.cast("string").cast("binary")), "+/", "-_"), "=+$", "")


def page_after(items: DataFrame, cursor: str | None, limit: int = 30) -> DataFrame:
    """The items after the cursor's, limit of them; a cursor of none of them starts from the top. items have position."""
    n = max(10, min(100, limit))
    if cursor is None:
        return items.where(F.col("position") < n)
    at = items.where(cursor_of(F.col("item_id")) == cursor).agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("start"))
    return items.join(at).where((F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + n)).drop("start")


def implicit_events(events: DataFrame) -> DataFrame:
    """Direct events, the strongest of a session and story, then of a day and story; the first of equals.

    events have user_id, session_id, day, story_id, event_type, origin, ordinal."""
    kinds = F.create_map(*(F.lit(x) for kv in V.IMPLICIT_WEIGHTS.items() for x in kv))
    e = events.where(F.col("event_type").isin(list(V.IMPLICIT_WEIGHTS)) & (F.coalesce("origin", F.lit("direct")) == "direct")).withColumn("weight", F.element_at(kinds, F.col("event_type")))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weight"), "ordinal"))
    e = e.withColumn("n", first("user_id", "session_id", "story_id")).where("n = 1")
    return e.withColumn("n", first("user_id", "day", "story_id")).where("n = 1").drop("n")


def behavioural_signals(events: DataFrame) -> DataFrame:
    """(user_id, story_id, weight, confidence) of the strongest direct behaviour towards a story."""
    w = F.create_map(*(F.lit(x) for k, (a, _) in V.BEHAVIOUR.items() for x in (k, a)))
    c = F.create_map(*(F.lit(x) for k, (_, b) in V.BEHAVIOUR.items() for x in (k, b)))
    e = events.where(F.col("event_type").isin(list(V.BEHAVIOUR)) & (F.coalesce("origin", F.lit("direct")) == "direct"))
    best = F.max(F.struct(F.element_at(w, F.col("event_type")).alias("weight"), F.element_at(c, F.col("event_type")).alias("confidence")))
    return e.groupBy("user_id", "story_id").agg(best.alias("b")).select("user_id", "story_id", "b.weight", "b.confidence")


def strongest_preferences(profile: DataFrame, most: int = 5) -> DataFrame:
    """The keys of each kind with the largest |more - less| from 0.2."""
    d = profile.withColumn("net", F.col("more") - F.col("less")).where(F.abs("net") >= 0.2)
    return d.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "kind").orderBy(F.desc(F.abs("net")), "key"))).where(F.col("n") <= most)
