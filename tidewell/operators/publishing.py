"""Publication and the small lookups around it: summaries, cached copies, timelines, briefs, feed discovery, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as X

# Fixed values.
CATEGORY_WORDS = {
    "Cybersecurity": ["security", "vulnerability", "cyber", "breach", "cve", "ransomware"],
    "AI / Technology": ["artificial intelligence", " ai ", "llm", "model", "openai", "machine learning"],
    "Business / Markets": ["business", "market", "economy", "finance", "earnings", "bank"],
    "World / Geopolitics": ["world", "government", "war", "europe", "china", "policy", "election"],
    "Software / Engineering": ["software", "developer", "github", "release", "framework", "cloud"],
}
POLISH_WORDS = r"(?U)\b(oraz|jest|się|dla|przez|który)\b"
ENGLISH_WORDS = r"\b(the|and|with|from|that|this|for)\b"
# End of fixed values.


def language(body: Column) -> Column:
    """What the text declares, else pl or en by letters and small words, else unknown."""
    declared = F.coalesce(F.nullif(F.trim(F.regexp_extract(body, r"(?is)<language\b[^>]*>(.*?)</language>", 1)), F.lit("")), F.nullif(F.regexp_extract(body, r"""(?i)(?:xml:lang|lang)=["']([a-zA-Z-]{2,35})["']""", 1), F.lit("")))
    text = F.lower(X.plain_text(F.substring(body, 1, 100_000)))
    counts = lambda t: F.struct((F.regexp_count(t, F.lit("[ąćęłńóśźż]")) + F.regexp_count(t, F.lit(POLISH_WORDS))).alias("pl"), F.regexp_count(t, F.lit(ENGLISH_WORDS)).alias("en"))
    guess = X.let(X.let(text, counts), lambda n: F.when(n["pl"] > n["en"], "pl").when(n["en"] > 2, "en").otherwise("unknown"))
    return F.coalesce(F.substring(F.lower(declared), 1, 35), guess)


def category(body: Column) -> Column:
    """The category of which most words occur, of equal ones the first by name; General where none does."""
    return X.let(F.lower(X.plain_text(F.substring(body, 1, 200_000))), _category)


def _category(text: Column) -> Column:
    scored = F.array(*(F.struct((-sum(F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in words)).alias("minus"), F.lit(c).alias("category")) for c, words in CATEGORY_WORDS.items()))
    return X.let(F.array_min(scored), lambda best: F.when(best["minus"] < 0, best["category"]).otherwise("General"))


def error_class(message: Column) -> Column:
    code = F.regexp_extract(message, r"(?i)\b(?:http|status)[ _:]*(\d{3})\b", 1)
    return F.when(message.isNull(), F.lit(None).cast("string")).when(code != "", F.concat(F.lit("http_"), code)).when(message.rlike("(?i)abort|time[d ]*out"), "timeout").otherwise("network_or_parse_error")


def fetch_allowed(status: Column, size: Column, redirects: Column) -> Column:
    """The bounds of a fetch: success, 2 MB, five redirects."""
    return status.between(200, 299) & (size <= 2_000_000) & (redirects <= 5)


def enrichment_candidates(articles: DataFrame, most: int = 40) -> DataFrame:
    """Articles without a current copy, the most important and newest first."""
    wanted = (F.col("status") != "enriched") | (F.col("content_mode") == "unknown") | (F.coalesce("copy_version", F.lit(0)) < 2)
    return articles.where(wanted).orderBy(F.desc("importance"), F.desc("published_epoch"), "article_id").limit(most)


def cached_copy(items: DataFrame, copies: DataFrame) -> DataFrame:
    """(item_id, article_id): of an item's readable copies those of its own URL before others, then most words, then longest."""
    j = items.select("item_id", "url").join(copies.where("readable"), "item_id")
    w = Window.partitionBy("item_id").orderBy(F.desc(F.col("canonical_url") == F.col("url")), F.desc("n_words"), F.desc("n_chars"), "article_id")
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("item_id", "article_id")


def published_summary(summary: Column, title: Column, most: int = 500, fallback: str = "No summary available.") -> Column:
    clean = X.clean_summary(F.coalesce(summary, F.lit("")), title)
    return X.compact(F.coalesce(F.nullif(clean, F.lit("")), F.nullif(F.trim(title), F.lit("")), F.lit(fallback)), most)


def score_changes(now: DataFrame, before: DataFrame, least: int = 10) -> DataFrame:
    """Stories whose editorial score moved by at least that much; the bump is 8, and novelty becomes 7."""
    b = before.select("story_id", F.col("editorial").alias("_old"))
    moved = F.abs(F.col("editorial") - F.col("_old")) >= least
    return now.join(b, "story_id", "left").withColumn("moved", F.coalesce(moved, F.lit(False))).withColumn("editorial", F.col("editorial") + F.when(F.col("moved"), 8).otherwise(0)).drop("_old")


def timeline(updates: DataFrame, most: int = 20) -> DataFrame:
    """The newest updates of each story, from 0."""
    w = Window.partitionBy("story_id").orderBy(F.desc("epoch"), F.desc("event_id"))
    return updates.withColumn("place", (F.row_number().over(w) - 1).cast("long")).where(F.col("place") < most)


def readable_variants(stories: DataFrame, articles: DataFrame) -> DataFrame:
    """Stories with the fields of their best readable article, where they have one: highest priority, then longest text, then first in the list.

    stories: story_id, article_ids, title, summary, source, url; articles: article_id, content_mode, priority, body, title, summary, source, url."""
    fields = ("title", "summary", "source", "url")
    a = articles.where("content_mode = 'readable'").select("article_id", F.struct("article_id", *fields).alias("_a"), "priority", F.length(F.coalesce("body", F.lit(""))).alias("_n"))
    best = stories.select("story_id", F.posexplode("article_ids").alias("_i", "article_id")).join(a, "article_id").groupBy("story_id").agg(F.max_by("_a", F.struct("priority", "_n", -F.col("_i"))).alias("_a"))
    j = stories.join(best, "story_id", "left")
    return j.withColumns({**{c: F.when(F.col("_a").isNotNull(), F.col(f"_a.{c}")).otherwise(F.col(c)) for c in fields}, "canonical_article": F.col("_a.article_id"), "has_readable": F.col("_a").isNotNull()}).drop("_a")


def content_modes(stories: DataFrame, articles: DataFrame) -> DataFrame:
    """(story_id, modes): the different content modes of a story's articles."""
    return stories.select("story_id", F.explode("article_ids").alias("article_id")).join(articles.select("article_id", "content_mode"), "article_id").groupBy("story_id").agg(F.sort_array(F.collect_set("content_mode")).alias("modes"))


def publication_rows(selected: DataFrame, existing: DataFrame, now: int) -> DataFrame:
    """Published items of selected stories: importance within 0 to 100, tags, counts, and times, of which the first selection and the last change stay.

    selected: story_id, title, url, summary, category, source, bucket, editorial, selection, changes, variants (array), duplicate_count, summary_max;
    existing: story_id, first_selected, last_change."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url"))
    old = existing.select("story_id", F.col("first_selected").alias("_first"), F.col("last_change").alias("_change"))
    j = selected.join(old, "story_id", "left")
    return j.select(
        "story_id",
        F.concat(F.lit("story:"), F.col("story_id").cast("string")).alias("external_id"),
        X.plain_text(title).alias("title"),
        published_summary(F.col("summary"), title, 500).alias("summary"),
        F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("general")).alias("category"),
        F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("Unknown")).alias("source"),
        X.clamp(X.js_round(F.col("editorial")), 0, 100).cast("long").alias("importance"),
        F.coalesce(F.nullif(F.col("selection"), F.lit(0.0)), F.col("editorial").cast("double")).alias("selection_score"),
        F.greatest(F.lit(1), F.coalesce(F.nullif(F.size("variants"), F.lit(0)), F.col("duplicate_count"))).cast("long").alias("source_count"),
        X.topic_tags(F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("general")), F.coalesce(F.nullif(F.col("bucket"), F.lit("")), F.lit("ignore")), title).alias("topic_tags"),
        X.entity_tags(title).alias("entity_tags"),
        F.coalesce("_first", F.lit(now)).cast("long").alias("first_selected"),
        F.lit(now).cast("long").alias("last_selected"),
        F.when(F.size("changes") > 0, F.lit(now)).otherwise(F.col("_change")).cast("long").alias("last_change"),
    )


PAYLOAD = "struct<preview:struct<whatHappened:string,whyItMatters:string,clickIf:string,practicalBucket:string>,practicalBucket:string,recommendedAction:string,whyInteresting:string>"
VARIANTS = "array<struct<articleId:string,name:string,url:string,priority:double,publishedAt:string>>"


def _said(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def project_items(items: DataFrame) -> DataFrame:
    """Items with what their JSON columns hold, as far as it has the right shape: variants, preview, bucket, action, score components.

    raw_payload and source_variants are JSON text; variants without article, name or URL go, a preview stands only whole."""
    p = F.from_json("raw_payload", PAYLOAD)
    variants = F.filter(F.from_json("source_variants", VARIANTS), lambda v: _said(v["articleId"]).isNotNull() & _said(v["name"]).isNotNull() & _said(v["url"]).isNotNull())
    parts = F.from_json(F.get_json_object("raw_payload", "$.score.components"), "map<string,string>")
    df = items.withColumns({"_p": p, "variants": F.coalesce(variants, F.array().cast(VARIANTS))})
    bucket = F.coalesce(_said(F.col("_p.preview.practicalBucket")), _said(F.col("_p.practicalBucket")))
    said = {c: _said(F.col(f"_p.preview.{c}")) for c in ("whatHappened", "whyItMatters", "clickIf")}
    whole = said["whatHappened"].isNotNull() & said["whyItMatters"].isNotNull() & said["clickIf"].isNotNull() & bucket.isNotNull()
    preview = F.when(whole, F.struct(*(c.alias(k) for k, c in said.items()), bucket.alias("practicalBucket")))
    plain = F.map_filter(parts, lambda k, v: v.isNotNull() & ~v.rlike(r"^\s*[\[{]"))
    return df.withColumns({"preview": preview, "bucket": F.when(whole, bucket).otherwise(_said(F.col("_p.practicalBucket"))), "recommended_action": _said(F.col("_p.recommendedAction")), "why_interesting": _said(F.col("_p.whyInteresting")), "score_components": F.coalesce(plain, F.create_map().cast("map<string,string>"))}).drop("_p")


def with_feedback(items: DataFrame, states: DataFrame, story_feedback: DataFrame, item_feedback: DataFrame, notes: DataFrame) -> DataFrame:
    """Items (item_id, story_id) of each reader with state, feedback and number of notes; feedback on the story goes before that on the item, which counts as on the topic."""
    s = story_feedback.select("user_id", "story_id", F.col("sentiment").alias("_s"), F.col("reason").alias("_r"))
    i = item_feedback.select("user_id", "item_id", F.col("sentiment").alias("_i"))
    n = notes.groupBy("user_id", "item_id").agg(F.count("*").alias("_n"))
    j = items.join(states, ["user_id", "item_id"], "left").join(s, ["user_id", "story_id"], "left").join(i, ["user_id", "item_id"], "left").join(n, ["user_id", "item_id"], "left")
    return j.withColumns({"feedback": F.coalesce("_s", "_i"), "feedback_reason": F.when(F.col("_s").isNotNull(), F.col("_r")).when(F.col("_i").isNotNull(), "topic"), "note_count": F.coalesce("_n", F.lit(0))}).drop("_s", "_r", "_i", "_n")


# The text of a brief that nobody wrote.
BRIEF = "Najnowszy digest obejmuje {}. Poniżej znajdziesz najważniejsze informacje z tego zestawu."
ONE, SEVERAL = "jedną wiadomość", "{} wiadomości"
# End of fixed values.


def fallback_brief(items: DataFrame, most: int = 5) -> DataFrame:
    """(digest_date, summary, highlights) of the latest digest: how many items it has, and the first of them, in order.

    items: item_id, digest_date, place, source, title, why, why_interesting, summary."""
    latest = items.agg(F.max("digest_date").alias("digest_date"))
    now = items.join(F.broadcast(latest), "digest_date")
    few = now.orderBy("place", "item_id").limit(most)
    why = F.coalesce(_said(F.col("why")), _said(F.col("why_interesting")), F.col("summary"))
    lines = few.groupBy("digest_date").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item_id", "source", "title", why.alias("why_it_matters")))), lambda x: F.struct(x["item_id"].alias("item_id"), x["source"].alias("source"), x["title"].alias("title"), x["why_it_matters"].alias("why_it_matters"))).alias("highlights"))
    n = now.groupBy("digest_date").agg(F.count("*").alias("n"))
    a, z = BRIEF.split("{}")
    subject = F.when(F.col("n") == 1, ONE).otherwise(F.concat(F.col("n").cast("string"), F.lit(SEVERAL.split("{}")[1])))
    return n.join(lines, "digest_date").select("digest_date", F.concat(F.lit(a), subject, F.lit(z)).alias("summary"), "highlights")


def decode_highlights(briefs: DataFrame) -> DataFrame:
    """Briefs with their highlights as far as each names item, source, title and reason; highlights are JSON text."""
    rows = F.from_json("highlights", "array<struct<newsItemId:string,source:string,title:string,whyItMatters:string>>")
    ok = F.filter(rows, lambda h: F.coalesce((h["newsItemId"] != "") & (h["source"] != "") & (h["title"] != "") & (h["whyItMatters"] != ""), F.lit(False)))
    return briefs.withColumn("highlights", F.coalesce(ok, F.array().cast("array<struct<newsItemId:string,source:string,title:string,whyItMatters:string>>")))


def canonical_flags(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """Links (story_id, article_id, is_canonical) with one canonical article for each of the chosen (story_id, article_id); other stories stay."""
    c = chosen.select("story_id", F.col("article_id").alias("_c"))
    return links.join(c, "story_id", "left").withColumn("is_canonical", F.when(F.col("_c").isNull(), F.col("is_canonical")).otherwise(F.col("article_id") == F.col("_c"))).drop("_c")


def attribution(links: DataFrame, articles: DataFrame) -> DataFrame:
    """(story_id, reader_source_id, contribution, first_run, last_run, first_seen, last_seen) from links of articles whose metadata names a source by uuid.

    links: story_id, article_id, is_canonical, first_run, last_run, first_seen, last_seen; articles: article_id, metadata (JSON text)."""
    from tidewell.operators.engagement import UUID

    a = articles.select("article_id", F.get_json_object("metadata", "$.readerSourceId").alias("reader_source_id")).where(F.col("reader_source_id").rlike(UUID))
    j = links.join(a, "article_id").groupBy("story_id", F.lower("reader_source_id").alias("reader_source_id"))
    first = F.min_by("first_run", F.when(F.col("first_run").isNotNull(), F.struct("first_seen", "article_id")))
    last = F.max_by("last_run", F.when(F.col("last_run").isNotNull(), F.struct("last_seen", "article_id")))
    return j.agg(F.when(F.bool_or("is_canonical"), "canonical").otherwise("confirmation").alias("contribution"), first.alias("first_run"), last.alias("last_run"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def merge_attribution(old: DataFrame, new: DataFrame) -> DataFrame:
    """Attribution after a run: what was first seen stays, the rest is the new; both have the columns of attribution."""
    key = ["story_id", "reader_source_id"]
    o = old.select(*key, *(F.col(c).alias(f"_{c}") for c in old.columns if c not in key))
    first = lambda c: F.coalesce(f"_{c}", c).alias(c)
    latest = lambda c: F.coalesce(c, f"_{c}").alias(c)
    return o.join(new, key, "full").select(*key, *((first if c.startswith("first") else latest)(c) for c in old.columns if c not in key))


def ingest_problems(payloads: DataFrame) -> DataFrame:
    """Adds problems: what is wrong with an item that comes from outside; a payload stands whole, with 1 to 100 items."""
    size = lambda c, most: ~F.coalesce(F.length(c).between(1, most), F.lit(False))
    bad = {
        "external_id": size("external_id", 500),
        "digest_date": ~F.coalesce(F.col("digest_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)),
        "title": size("title", 500),
        "summary": size("summary", 5000),
        "source": size("source", 200),
        "source_url": size("source_url", 2000) | ~F.coalesce(F.col("source_url").rlike(r"(?i)^[a-z][a-z0-9+.-]*://\S+$"), F.lit(False)),
        "category": size("category", 100),
        "importance": F.col("importance").isNotNull() & ~(F.col("importance").between(0, 100) & (F.col("importance") == F.floor("importance"))),
        "published_at": F.col("published_at").isNotNull() & ~F.coalesce(F.col("published_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z$"), F.lit(False)),
    }
    return payloads.withColumn("problems", F.array_compact(F.array(*(F.when(c, k) for k, c in bad.items()))))


def ingest(items: DataFrame, payloads: DataFrame) -> DataFrame:
    """Items (external_id, title, digest_date) after the payloads (payload_id, ordinal, ...) that stand; the last of equal ids counts."""
    from tidewell.operators.merging import upsert

    rows = ingest_problems(payloads)
    whole = rows.groupBy("payload_id").agg(F.count("*").alias("_n"), F.count_if(F.size("problems") > 0).alias("_bad")).where("_n <= 100 and _bad = 0")
    good = rows.join(whole, "payload_id", "left_semi")
    last = good.withColumn("_r", F.row_number().over(Window.partitionBy("external_id").orderBy(F.desc("payload_id"), F.desc("ordinal")))).where("_r = 1")
    return upsert(items, last.select(*items.columns), ["external_id"])


def load_settings(readers: DataFrame, stored: DataFrame, defaults: dict, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Each reader's settings, or the defaults, numbers within their ranges; readers and stored have user_id."""
    s = stored.withColumn("_has", F.lit(True))
    j = readers.select("user_id").join(s, "user_id", "left")
    value = lambda c, d: F.when(F.col("_has"), F.coalesce(X.clamp(X.js_round(F.col(c).cast("double")).cast("long"), *ranges[c]), F.lit(d)) if c in ranges else F.coalesce(c, F.lit(d))).otherwise(F.lit(d))
    return j.select("user_id", *(value(c, d).alias(c) for c, d in defaults.items()))


def run_settings(runs: DataFrame, settings: DataFrame, defaults: dict) -> DataFrame:
    """A run's settings: those of the reader who started it, or the defaults; runs have run_id, started_by."""
    j = runs.select("run_id", F.col("started_by").alias("user_id")).join(settings.withColumn("_has", F.lit(True)), "user_id", "left")
    return j.select("run_id", *(F.when(F.col("_has"), F.col(c)).otherwise(F.lit(d)).alias(c) for c, d in defaults.items()))


def retained(items: DataFrame, saved: DataFrame, noted: DataFrame, as_of: int, days: int = 90) -> DataFrame:
    """Items but those last selected longer ago that are neither saved nor noted; all have item_id."""
    gone = items.where(F.col("last_selected") < as_of - days * 86400).select("item_id").join(saved.select("item_id"), "item_id", "left_anti").join(noted.select("item_id"), "item_id", "left_anti")
    return items.join(gone, "item_id", "left_anti")


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there; those without one stay."""
    p = parents.select(key).distinct().withColumn("_there", F.lit(True))
    return children.join(p, key, "left").where(F.col(key).isNull() | F.col("_there")).drop("_there")


def source_story_counts(variants: DataFrame) -> DataFrame:
    """(source_key, stories, confirmed): stories of each source, by id, else by URL, and those of them that several sources have.

    variants: story_id, reader_source_id, source_url, one row for each source of a story; without a URL they don't count."""
    n = F.count("*").over(Window.partitionBy("story_id"))
    key = F.coalesce(F.concat(F.lit("id:"), F.col("reader_source_id").cast("string")), F.concat(F.lit("url:"), F.col("source_url")))
    v = variants.withColumn("_n", n).where(F.col("source_url").isNotNull())
    return v.groupBy(key.alias("source_key")).agg(F.count_distinct("story_id").alias("stories"), F.count_distinct(F.when(F.col("_n") >= 2, F.col("story_id"))).alias("confirmed"))


def update_observations(observations: DataFrame, counts: DataFrame) -> DataFrame:
    """Observations (reader_source_id, source_url, stories, confirmed) with the counts of their source, where it has any."""
    key = F.coalesce(F.concat(F.lit("id:"), F.col("reader_source_id").cast("string")), F.concat(F.lit("url:"), F.col("source_url")))
    c = counts.select("source_key", F.col("stories").alias("_s"), F.col("confirmed").alias("_c"))
    return observations.withColumn("source_key", key).join(c, "source_key", "left").withColumns({"stories": F.coalesce("_s", "stories"), "confirmed": F.coalesce("_c", "confirmed")}).drop("_s", "_c", "source_key")


def explicit_signals(items: DataFrame) -> DataFrame:
    """(item_id, dimension, target) from (item_id, story_id, reason, category, source, topic_tags, entity_tags); without a target none."""
    r = F.col("reason")
    target = F.when(r == "topic", F.coalesce(F.try_element_at("topic_tags", F.lit(1)), F.col("category"))).when(r == "entity", F.try_element_at("entity_tags", F.lit(1))).when(r == "source", F.col("source")).otherwise(F.col("story_id").cast("string"))
    return items.where(F.col("story_id").isNotNull() & r.isNotNull()).select("item_id", F.when(r == "repetitive", "repetition").otherwise(r).alias("dimension"), F.trim(target).alias("target")).where(F.col("target").isNotNull())


def brief_lines(items: DataFrame, most: int = 5) -> DataFrame:
    """One row a run: the titles of its first items, in order, and how many there are."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("selection_rank", "title"))
    first = items.select("run_id", "title", place.alias("n")).where(F.col("n") <= most)  # what is behind goes before the shuffle
    titles = first.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda x: x["title"]).alias("titles"))
    return items.groupBy("run_id").agg(F.count("*").alias("n_items")).join(titles, "run_id")


def highlighted(indexes: DataFrame, items: DataFrame) -> DataFrame:
    """Highlights by their place in a run's list: (run_id, highlights array of places) to (run_id, place, story_id); other places go."""
    i = indexes.select("run_id", F.explode("highlights").alias("place"))
    return i.join(items.select("run_id", F.col("selection_rank").alias("place"), "story_id"), ["run_id", "place"])


def clamped_settings(df: DataFrame, ranges: dict[str, tuple[int, int, int]]) -> DataFrame:
    """Integer settings (least, most, default) from text: rounded and kept within their range, or the default."""
    value = lambda c, lo, hi, default: F.coalesce(X.clamp(X.js_round(F.col(c).try_cast("double")).cast("long"), lo, hi), F.lit(default)).cast("long")
    return df.withColumns({c: value(c, *r) for c, r in ranges.items()})


def keyword_setting(c: Column, most: int = 50) -> Column:
    """A list from text with commas or lines: trimmed, lower case, each once."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[,\n]"), lambda x: F.lower(X.squeezed(x)))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: x != "")), 1, most)


def set_null_where_gone(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children of parents that are gone lose the reference."""
    p = parents.select(key).distinct().withColumn("_there", F.lit(True))
    return children.join(p, key, "left").withColumn(key, F.when(F.col("_there"), F.col(key))).drop("_there")


def fallback_rows(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """All rows of primary, or those of fallback where primary has none."""
    empty = primary.limit(1).agg((F.count("*") == 0).alias("_empty"))
    return primary.unionByName(fallback.join(empty).where("_empty").drop("_empty"))
