"""Editorial scores of stories: components, feed adjustments, buckets, eligibility, reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.functions import values as V

WEIGHTS = {"impact": 2.4, "novelty": 1.6, "confirmation": 1.4, "scope": 2.4, "action": 1.7, "urgency": 1.2, "priority": 1.5}


def article_importance(text: Column, enriched_chars: Column, important=V.IMPORTANT_KEYWORDS) -> Column:
    return X.clamp(2 + X.hits(text, important) + F.when(enriched_chars > 900, 2).otherwise(0), 1, 10)


def components(df: DataFrame, as_of: int, important=V.IMPORTANT_KEYWORDS, preferred: list[str] = (), scope=V.SCOPE_KEYWORDS, actions=V.ACTIONABILITY_KEYWORDS, entities=V.HIGH_PRIORITY_ENTITIES, build=V.BUILD_RELEVANCE_KEYWORDS) -> DataFrame:
    """Adds the score components and the editorial score; df has text, source_count, changes, priority, published_epoch."""
    df = df.withColumn("_spaced", X.spaced(F.col("text")))
    text, words = F.col("text"), F.col("_spaced")
    age = F.coalesce((F.lit(as_of) - F.col("published_epoch")) / 3600.0, F.lit(72.0))
    parts = {
        "impact": X.clamp(2 + X.hits(text, important, words) + X.hits(text, list(preferred), words), 1, 10),
        "confirmation": F.least(F.lit(10), F.when(F.col("source_count") >= 5, 10).otherwise(F.col("source_count") * 3)),
        "scope": F.when(X.any_keyword(text, [*scope, *preferred], words), 9).otherwise(4),
        "action": X.clamp(2 + X.hits(text, actions, words) + F.least(F.lit(3), X.hits(text, entities, words)) + F.least(F.lit(2), X.hits(text, build, words)), 1, 10),
        "urgency": F.when(age <= 6, 10).when(age <= 24, 8).when(age <= 72, 5).otherwise(3),
        "novelty": F.when(F.array_contains("changes", "new"), 10).when(F.size("changes") > 0, 7).otherwise(2),
        "priority_part": X.clamp(F.col("priority"), 0, 5),
    }
    df = df.withColumns(parts)
    weighted = reduce(lambda a, b: a + b, [F.col("priority_part" if k == "priority" else k) * w for k, w in WEIGHTS.items()])
    return df.withColumn("editorial", X.js_round(weighted).cast("long")).drop("_spaced")


def feed_adjustment(feed: Column, relevant: Column, major: Column, developer: Column) -> Column:
    return F.when(feed == "geopolitics", F.when(relevant, 10).otherwise(-12)).when(feed == "business", 6).when(feed == "security", F.when(major, 16).when(developer, 5).otherwise(-25)).otherwise(0)


def adjusted(df: DataFrame, major=V.MAJOR_SECURITY_KEYWORDS, developer=V.DEVELOPER_SECURITY_KEYWORDS, geo=V.GEOPOLITICS_KEYWORDS, build=V.BUILD_RELEVANCE_KEYWORDS) -> DataFrame:
    """Adds is_major, is_developer, is_relevant and feed_adjustment; df has text, feed, source_count."""
    text, words = F.col("text"), F.col("_spaced")
    df = df.withColumn("_spaced", X.spaced(text)).withColumns({"is_major": (F.col("source_count") >= 3) | X.any_keyword(text, major, words), "is_developer": X.any_keyword(text, [*developer, *build], words), "is_relevant": X.any_keyword(text, geo, words)})
    return df.drop("_spaced").withColumn("feed_adjustment", feed_adjustment(F.col("feed"), F.col("is_relevant"), F.col("is_major"), F.col("is_developer")))


def practical_bucket(text: Column, buckets: dict[str, list[str]] = V.BUCKET_KEYWORDS, scope=V.SCOPE_KEYWORDS) -> Column:
    def first(words: Column) -> Column:
        out = F.when(X.any_keyword(text, scope, words), "product_trend").otherwise("ignore")
        for name, some in reversed(buckets.items()):
            out = F.when(X.any_keyword(text, some, words), name).otherwise(out)
        return out

    return X.let(X.spaced(text), first)


def recommended_action(bucket: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in V.BUCKET_ACTIONS.items() for x in kv)), bucket)


def eligibility_reasons(excluded: Column, readable: Column, age_hours: Column, window_hours: Column, sources: Column, min_sources: Column, score: Column, min_score: Column, novelty: Column, feed: Column, major: Column, developer: Column, readable_only: bool = True, require_major: bool = True) -> Column:
    """Codes of what speaks against a story, in a fixed order; none makes it eligible."""
    return F.array_compact(
        F.array(
            F.when(excluded, "excluded_keyword"),
            F.when(F.lit(readable_only) & ~readable, "unreadable"),
            F.when(age_hours > window_hours, "stale"),
            F.when(sources < min_sources, "insufficient_sources"),
            F.when(score < min_score, "below_importance"),
            F.when(novelty <= 2, "insufficient_novelty"),
            F.when((feed == "security") & F.lit(require_major) & ~major & ~developer, "security_relevance"),
        )
    )


# What a selection is said to rest on.
STRONG = {"scope": "scope fit", "action": "actionability", "impact": "impact", "urgency": "urgency", "confirmation": "confirmation"}
MATCHED, SCORED, FITS = "matched ", "scored high on ", "fits the {} feed target"
LIKED, MAJOR, DEVELOPER = "matches previous positive feedback", "major security signal", "developer-relevant security signal"
RELEVANT = "geopolitics with business, chips, energy, or security impact"
# End of fixed values.


def selection_reason(df: DataFrame, keywords: list[str] = (*V.HIGH_PRIORITY_ENTITIES, *V.BUILD_RELEVANCE_KEYWORDS, *V.ACTIONABILITY_KEYWORDS)) -> Column:
    """One line on why a story is selected: up to five keywords, up to three scores from 7, and what speaks for it.

    df has text, bucket, feed, the score components, feed_adjustment, preference, is_major, is_developer, is_relevant."""
    scores = F.array(*(F.struct((-F.col(c)).alias("minus"), F.lit(i).alias("i"), F.concat(F.lit(f"{label} "), F.col(c).cast("string"), F.lit("/10")).alias("said")) for i, (c, label) in enumerate(STRONG.items())))
    strong = F.transform(F.slice(F.array_sort(F.filter(scores, lambda x: x["minus"] <= -7)), 1, 3), lambda x: x["said"])
    found = F.slice(X.matching_keywords(F.col("text"), list(keywords)), 1, 5)
    before, after = FITS.split("{}")
    parts = [
        X.let(found, lambda x: F.when(F.size(x) > 0, F.concat(F.lit(MATCHED), F.array_join(x, ", ")))),
        X.let(strong, lambda x: F.when(F.size(x) > 0, F.concat(F.lit(SCORED), F.array_join(x, ", ")))),
        F.when(F.col("feed_adjustment") > 0, F.concat(F.lit(before), F.col("feed"), F.lit(after))),
        F.when(F.col("preference") > 0, LIKED),
        F.when(F.col("is_major"), MAJOR),
        F.when(~F.col("is_major") & F.col("is_developer"), DEVELOPER),
        F.when(F.col("is_relevant"), RELEVANT),
    ]
    reasons = X.let(F.array_compact(F.array(*parts)), lambda r: F.when(F.size(r) > 0, F.concat(F.lit(": "), F.array_join(r, "; "))).otherwise(F.lit("")))
    return F.concat(F.lit("Selected as "), X.human_label(F.col("bucket")), reasons, F.lit("."))


def explanation(objective: Column, feed: Column, adjustment: Column, preference: Column, score: Column) -> Column:
    """The lines of a recommendation's record: objective reasons, what feed and preference add or take, the final score."""
    said = lambda text, n: F.concat(F.lit(text), F.when(n > 0, F.lit("+")).otherwise(F.lit("")), X.js_number(n))
    on_feed = F.concat(F.lit("Objective "), feed, said(" relevance ", adjustment))
    return F.array_compact(F.concat(objective, F.array(F.when(adjustment != 0, on_feed), F.when(preference != 0, said("Preference signal ", preference)), F.concat(F.lit("Final score "), X.js_number(score)))))
