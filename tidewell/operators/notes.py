"""Readers' notes: what is valid, how they are written and found; and the constraints that tables keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as X

KINDS, STATUSES = ["knowledge", "research", "thought"], ["open", "done"]
NOTE, QUOTE, CONTEXT = 10_000, 4000, 200
PAGE, MOST = 30, 500


def comparable(c: Column) -> Column:
    return F.lower(X.squeezed(X.plain_text(c)))


def note_problems(notes: DataFrame) -> DataFrame:
    """Adds problems: what is wrong with a note (kind, note_text, quote_text, quote_prefix, quote_suffix)."""
    size = lambda c: F.length(X.squeezed(F.coalesce(c, F.lit(""))))
    text = F.trim(F.coalesce("note_text", F.lit("")))
    bad = {
        "kind": ~F.coalesce(F.col("kind").isin(KINDS), F.lit(False)),
        "note_text": F.length(text) > NOTE,
        "quote_text": size("quote_text") > QUOTE,
        "quote_prefix": size("quote_prefix") > CONTEXT,
        "quote_suffix": size("quote_suffix") > CONTEXT,
        "empty": (text == "") & (size("quote_text") == 0),
    }
    return notes.withColumn("problems", F.array_compact(F.array(*(F.when(c, k) for k, c in bad.items()))))


def new_notes(notes: DataFrame, items: DataFrame, articles: DataFrame, links: DataFrame) -> DataFrame:
    """Valid notes with what they are on: the item must be there, the article, if one is named, belong to its story, and the quote stand in either.

    notes: note_id, user_id, item_id, article_id, ...; items: item_id, story_id, title, summary, source, source_url;
    articles: article_id, body, source, url; links: story_id, article_id."""
    i = items.select("item_id", "story_id", X.plain_text(F.col("title")).alias("title"), F.concat_ws(" ", "title", "summary").alias("_item"), F.col("source").alias("_source"), F.col("source_url").alias("_url"))
    a = articles.select("article_id", F.col("body").alias("_body"), F.col("source").alias("_article_source"), F.col("url").alias("_article_url"), F.lit(True).alias("_there"))
    j = note_problems(notes).where(F.size("problems") == 0).join(i, "item_id").join(a, "article_id", "left")
    j = j.join(links.select("story_id", "article_id", F.lit(True).alias("_linked")), ["story_id", "article_id"], "left")
    belongs = F.col("article_id").isNull() | (F.coalesce("_there", F.lit(False)) & (F.col("story_id").isNull() | F.coalesce("_linked", F.lit(False))))
    quoted = F.contains(comparable(F.concat_ws(" ", "_body", "_item")), comparable(F.coalesce("quote_text", F.lit(""))))
    return j.where(belongs & quoted).select("note_id", "user_id", "item_id", "story_id", "article_id", "kind", F.lit("open").alias("status"), F.trim("note_text").alias("note_text"), "quote_text", "title", F.coalesce("_article_source", "_source").alias("source"), F.coalesce("_article_url", "_url").alias("source_url"))


def edit_notes(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """Notes after edits (note_id, user_id, kind, status, note_text; null leaves as is); only the writer's own, and only valid ones."""
    ok = (F.col("kind").isNull() | F.col("kind").isin(KINDS)) & (F.col("status").isNull() | F.col("status").isin(STATUSES)) & (F.col("note_text").isNull() | (F.length(F.trim("note_text")) <= NOTE))
    e = edits.where(ok).select("note_id", "user_id", *(F.col(c).alias(f"_{c}") for c in ("kind", "status", "note_text")))
    new = {c: F.coalesce(F.trim(f"_{c}") if c == "note_text" else F.col(f"_{c}"), F.col(c)) for c in ("kind", "status", "note_text")}
    return notes.join(e, ["note_id", "user_id"], "left").withColumns(new).select(*notes.columns)


def delete_notes(notes: DataFrame, gone: DataFrame) -> DataFrame:
    """Notes but those that their writers took back, (note_id, user_id)."""
    return notes.join(gone.select("note_id", "user_id"), ["note_id", "user_id"], "left_anti")


def find_notes(notes: DataFrame, query: str = "", kind: str | None = None, status: str | None = None, most: int = MOST) -> DataFrame:
    """Of each reader's newest notes of a kind and status those that hold the query in any of their texts.

    The newest ``most`` are looked at, which is part of the feature. Notes have user_id, note_id, updated_epoch, note_text, quote_text, title, source, tags."""
    df = notes
    for c, v in (("kind", kind), ("status", status)):
        if v is not None:
            df = df.where(F.col(c) == v)
    newest = Window.partitionBy("user_id").orderBy(F.desc("updated_epoch"), F.desc("note_id"))
    df = df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most).drop("_n")
    texts = F.concat_ws(" ", "note_text", F.coalesce("quote_text", F.lit("")), "title", "source", "tags")
    return df.where(F.contains(comparable(texts), comparable(F.lit(query)))) if query.strip() else df


def page_of_notes(notes: DataFrame, page: int, size: int = PAGE) -> DataFrame:
    """A page of each reader's notes, newest first; a number beyond the last page gives the last, one below 1 the first."""
    w = Window.partitionBy("user_id")
    df = notes.withColumns({"_n": F.row_number().over(w.orderBy(F.desc("updated_epoch"), F.desc("note_id"))) - 1, "_c": F.count("*").over(w)})
    at = F.greatest(F.lit(1), F.least(F.lit(page), F.ceil(F.col("_c") / size))) - 1
    return df.where(F.floor(F.col("_n") / size) == at).drop("_n", "_c")


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(constraint, n): how many rows break each constraint; as in SQL, what is unknown breaks none."""
    counts = df.agg(*(F.count_if(F.coalesce(~c, F.lit(False))).alias(k) for k, c in checks.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("constraint"), F.col(k).alias("n")) for k in checks))).alias("x")).select("x.constraint", "x.n")


#: The constraints of the tables, by table: what each row must hold.
CONSTRAINTS = {
    "news_items": {"importance_score": "importance_score is null or importance_score between 0 and 100"},
    "stage_runs": {"status": "status in ('queued', 'running', 'succeeded', 'failed', 'skipped')", "attempt_count": "attempt_count >= 0"},
    "digest_runs": {"trigger_type": "trigger_type in ('manual', 'scheduled')", "status": "status in ('queued', 'running', 'succeeded', 'failed', 'cancelled')"},
    "stories": {"latest_duplicate_count": "latest_duplicate_count >= 1", "confirmation_count": "confirmation_count >= 1"},
    "settings": {"publish_top_n": "publish_top_n between 5 and 100", "summary_max_chars": "summary_max_chars between 180 and 5000", "minimum_importance_score": "minimum_importance_score between 0 and 100", "source_budget": "source_budget between 5 and 200", "source_probe_count": "source_probe_count between 0 and 10"},
    "sources": {"name": "length(trim(name)) > 0", "category": "length(trim(category)) > 0", "feed_url": "feed_url rlike '(?i)^https?://'", "priority": "priority between 1 and 5", "selection_mode": "selection_mode in ('auto', 'always_on', 'blocked')"},
    "feedback": {"sentiment": "sentiment in ('more', 'less')"},
    "source_decisions": {"policy_version": "length(policy_version) between 1 and 100", "confidence": "confidence between 0 and 1", "role": "role in ('selected', 'explore', 'probe', 'skipped')", "role_selected": "(actual_selected and role in ('selected', 'explore')) or (not actual_selected and role in ('probe', 'skipped'))"},
    "notes": {"kind": "kind in ('knowledge', 'research', 'thought')", "status": "status in ('open', 'done')", "content": "length(trim(note_text)) > 0 or length(trim(coalesce(quote_text, ''))) > 0", "note_length": "char_length(note_text) <= 10000", "quote_length": "char_length(coalesce(quote_text, '')) <= 4000"},
}


def broken(df: DataFrame, table: str) -> DataFrame:
    """violations of a table's own constraints."""
    return violations(df, {k: F.expr(c) for k, c in CONSTRAINTS[table].items()})
