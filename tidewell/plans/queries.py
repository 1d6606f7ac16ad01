"""Queries over the given tables, one for each operator or family, by name. Each takes a session and a folder of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import engagement as E
from tidewell.operators import lifecycle as L
from tidewell.operators import merging as M
from tidewell.operators import notes as N
from tidewell.operators import reading as R
from tidewell.operators import scoring as S
from tidewell.operators import selection as C
from tidewell.operators import sourcing as P
from tidewell.operators import stories as D
from tidewell.operators.graph import checkpoints
from tidewell.sources import adapters as A
from tidewell.sources.adapters import AS_OF

#: Keywords of the invented texts, in the place of the default lists.
IMPORTANT = ["that", "with", "edth", "der die", "que de", "onan"]
PREFERRED = ["this", "les", "ntst"]
SCOPE = ["from", "und", "para", "est"]
ACTIONS = ["are", "for", "the of", "nicht", "los"]
ENTITIES = ["what", "was", "dem", "eau"]
BUILD = ["ones", "ins", "thst", "con"]
BUCKETS = {"security_risk": ["edor", "nicht"], "market_risk": ["with", "pour"], "build_opportunity": ["this", "und"], "product_trend": ["that", "que"]}


def texts(spark: SparkSession, d: str) -> DataFrame:
    return A.articles(spark, d).withColumn("text", F.concat_ws(" ", "title", "summary"))


def stories(spark: SparkSession, d: str) -> DataFrame:
    """Articles as stories, with what scoring needs."""
    df = texts(spark, d).withColumns({"feed": X.feed_of(F.col("category")), "source_count": F.col("article_id") % 4 + 1, "changes": F.when(F.col("article_id") % 3 == 0, F.array(F.lit("new"))).when(F.col("article_id") % 3 == 1, F.array(F.lit("title"))).otherwise(F.array().cast("array<string>"))})
    return S.components(df, AS_OF, IMPORTANT, PREFERRED, SCOPE, ACTIONS, ENTITIES, BUILD)


def editorial_topn(spark: SparkSession, d: str) -> DataFrame:
    top = stories(spark, d).select("article_id", "feed", "impact", "confirmation", "scope", "action", "urgency", "novelty", "editorial").orderBy(F.desc("editorial"), "article_id").limit(50)
    return top.withColumn("selection_rank", F.row_number().over(Window.orderBy(F.desc("editorial"), "article_id")) - 1)


def editorial_scores(spark, d):
    return stories(spark, d).select("article_id", "feed", *(F.col(c).cast("long").alias(c) for c in ("impact", "confirmation", "scope", "action", "urgency", "novelty", "editorial")))


def keyword_match(spark, d):
    return texts(spark, d).select("article_id", F.array_join(X.matching_keywords(F.col("text"), IMPORTANT), ",").alias("found"), X.hits(F.col("text"), IMPORTANT).cast("long").alias("n_found"))


def feed_category(spark, d):
    return A.articles(spark, d).select("article_id", "category", X.feed_of(F.col("category")).alias("feed"))


def feed_counts(spark, d):
    return A.articles(spark, d).groupBy(X.feed_of(F.col("category")).alias("feed")).agg(F.count("*").alias("n_articles"), F.count_distinct("source").alias("n_sources"))


def feed_totals_rollup(spark, d):
    df = A.articles(spark, d).withColumn("feed", X.feed_of(F.col("category")))
    return df.rollup("feed").agg(F.count("*").alias("n"), F.count_if(F.col("priority") >= 3).alias("n_high")).select(F.coalesce("feed", F.lit("all")).alias("feed"), "n", "n_high")


def text_compact(spark, d):
    return texts(spark, d).select("article_id", X.compact(F.col("text"), 60).alias("short"), X.word_count(F.col("text")).cast("long").alias("n_words"))


def feedback_keywords(spark, d):
    return texts(spark, d).select("article_id", F.array_join(X.feedback_keywords(F.col("text")), " ").alias("words"))


def title_fingerprint(spark, d):
    return A.articles(spark, d).select("article_id", X.fingerprint(X.dedupe_tokens(F.col("title"), True)).alias("fingerprint"))


def simhash32(spark, d):
    return texts(spark, d).select("article_id", X.simhash32(X.dedupe_tokens(F.col("text"), True)).alias("simhash"))


def simhash_distance(spark, d):
    """Differing bits of all pairs of articles that share a blocking key."""
    return D.key_distances(profiles(spark, d))


def title_similarity(spark, d):
    """Jaccard and containment of the titles of each article and the next of its source and feed."""
    w = Window.partitionBy("source", "category").orderBy("article_id")
    p = A.articles(spark, d).withColumn("t", X.dedupe_tokens(F.col("title"), True)).withColumns({"u": F.lead("t").over(w), "right_id": F.lead("article_id").over(w)}).where("right_id is not null")
    return p.select(F.col("article_id").alias("left_id"), "right_id", F.round(X.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"), F.round(X.containment(F.col("t"), F.col("u")), 6).alias("containment"))


def exact_dup_groups(spark, d):
    return A.table(spark, d, "documents").groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def url_dedupe_best(spark, d):
    rows = A.articles(spark, d).select((F.col("article_id") % 200).alias("canonical_url"), "summary", F.col("article_id").alias("ordinal"))
    return D.best_per_url(rows).select("canonical_url", F.col("ordinal").alias("article_id"), "first_seen")


def url_normalize(spark, d):
    return A.table(spark, d, "pages").select("page_id", X.normalize_url(F.col("url")).alias("canonical_url"), X.url_host(F.col("url")).alias("host"))


def readable_classify(spark, d):
    return A.table(spark, d, "pages").select("page_id", X.readable(F.col("html")).alias("r")).select("page_id", F.col("r.n_words").cast("long").alias("n_words"), F.col("r.n_paragraphs").cast("long").alias("n_paragraphs"), "r.mode", F.md5("r.text").alias("text_md5"))


def page_language(spark, d):
    return A.table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"""(?i)<html[^>]*\blang=["']?([a-z]+)""", 1).alias("lang"), X.feed_kind(F.col("html")).alias("feed_kind"), F.size(X_alternate(F.col("html"))).cast("long").alias("n_feeds"))


def X_alternate(html: Column) -> Column:
    from tidewell.sources.intake import alternate_feeds

    return alternate_feeds(html)


def intake_items(spark, d):
    """Documents as RSS items of their source, parsed again."""
    from tidewell.sources import intake

    esc = F.replace(F.replace(F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    item = F.concat(F.lit("<item><title>"), esc, F.lit("</title><link>https://Example.com/"), F.col("article_id").cast("string"), F.lit("?utm_source=x&amp;id=1#a</link><pubDate>"), F.date_format(F.timestamp_seconds("published_epoch"), "dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    feeds = A.articles(spark, d).withColumn("feed_no", F.expr("article_id div 20")).select("feed_no", "source", F.struct("article_id", item.alias("xml")).alias("x")).groupBy("source", "feed_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["xml"]), "").alias("items"))
    payloads = feeds.select(F.concat_ws("-", "source", "feed_no").alias("source_id"), F.col("source").alias("source_name"), F.lit("AI").alias("category"), F.lit(1).alias("priority"), F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("body"))
    got = intake.recent(intake.items(payloads), F.timestamp_seconds(F.lit(AS_OF)))
    return got.select("url", F.unix_timestamp("published").alias("published_epoch"), "age")


def warsaw_recency(spark, d):
    day = X.warsaw_date(F.timestamp_seconds("published_epoch"))
    today = X.warsaw_date(F.timestamp_seconds(F.lit(AS_OF)))
    return A.articles(spark, d).groupBy(F.date_format(day, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.bool_or(day.between(F.date_sub(today, 1), today)).alias("kept"))


def ipv4_safety(spark, d):
    e = A.table(spark, d, "events")
    ip = F.concat_ws(".", *((F.col("event_id") * k % m).cast("string") for k, m in ((7, 260), (13, 256), (29, 256), (3, 256))))
    return e.select("event_id", ip.alias("ip"), X.ipv4_number(ip).alias("number"), X.blocked_ipv4(ip).alias("blocked"))


def fnv_hash(spark, d):
    return A.table(spark, d, "documents").select("doc_id", X.fnv1a32(F.concat(F.lit("2024-01-31:"), F.col("doc_id").cast("string"))).alias("hash"))


# --- joins, sets, writes ---------------------------------------------------------------------------------------------


def states(spark, d):
    """Per item of the feed: read, saved, archived by the interactions of its story."""
    i = A.interactions(spark, d).groupBy("story_id").agg(F.bool_or(F.col("event_type") == "read").alias("read"), (F.count_if(F.col("event_type") == "save") >= 25).alias("saved"), (F.count_if(F.col("event_type") == "feedback") >= 25).alias("archived"))
    return i


def feed_items(spark, d):
    none = F.lit(False)
    items = stories(spark, d).select("article_id", "feed", "editorial", "published_epoch", "priority", (F.col("article_id") % 150).alias("story_id"))
    return items.join(states(spark, d), "story_id", "left").withColumns({c: F.coalesce(c, none) for c in ("read", "saved", "archived")})


def item_state_join(spark, d):
    notes = A.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("article_id")).agg(F.count("*").alias("n_notes"))
    labels = A.table(spark, d, "labels").select(F.col("doc_id").alias("article_id"), F.when(F.col("quality") == 1, "more").otherwise("less").alias("feedback"))
    df = feed_items(spark, d).join(labels, "article_id", "left").join(notes, "article_id", "left")
    return df.select("article_id", "feed", "read", "saved", "archived", "feedback", F.coalesce("n_notes", F.lit(0)).alias("n_notes"))


def anti_expired(spark, d):
    """Old items that are neither saved nor noted: what retention deletes."""
    items = feed_items(spark, d)
    notes = A.table(spark, d, "conversations").select(F.col("conv_id").alias("article_id")).distinct()
    return M.without(items.where(L.expired(items, AS_OF, 5)).select("article_id", "saved"), items.where("saved").select("article_id"), notes, on="article_id").select("article_id")


def semi_probe_health(spark, d):
    o = A.observations(spark, d)
    return P.healthy_probes(o.withColumn("role", F.when(F.col("parsed") % 5 == 0, "probe").otherwise("selected")), o)


def latest_tags_distinct_on(spark, d):
    w = Window.partitionBy("story_id").orderBy(F.desc("epoch"), F.desc("event_id"))
    return A.interactions(spark, d).withColumn("n", F.row_number().over(w)).where("n = 1").select("story_id", "event_id", "event_type")


def last30_per_key(spark, d):
    w = Window.partitionBy("source_id").orderBy(F.desc("run_id"))
    return A.observations(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 30").groupBy("source_id").agg(F.count("*").alias("runs"), F.min("run_id").alias("first_run"), F.sum("parsed").alias("parsed"))


def first_last_by_time(spark, d):
    """Per story and event type: bounds in time, the first and last event, whether any was direct."""
    return A.interactions(spark, d).groupBy("story_id", "event_type").agg(F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"), F.min_by("event_id", F.struct("epoch", "event_id")).alias("first_id"), F.max_by("event_id", F.struct("epoch", "event_id")).alias("last_id"), F.bool_or(F.coalesce(F.col("origin") == "direct", F.lit(False))).alias("any_direct"))


def merge_upsert(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    new = c.where("id % 3 = 0").select((F.col("id") + 1000).alias("id"), (F.col("value") + 1).alias("value"))
    return M.upsert(c, new, ["id"])


def merge_newest(spark, d):
    i = A.interactions(spark, d).select("user_id", "event_id", "epoch")
    return M.upsert_newest(i.where("event_id % 2 = 0"), i.where("event_id % 2 = 1"), ["user_id"], "event_id").select("user_id", "event_id")


def insert_ignore(spark, d):
    i = A.interactions(spark, d).withColumn("impression_key", E.impression_key(A.interactions(spark, d))).select("event_id", "impression_key")
    return M.insert_ignore(i.where("event_id < 1000"), i.where("event_id >= 1000"), "impression_key", "event_id").select("event_id", "impression_key")


def merge_keep_first(spark, d):
    i = A.interactions(spark, d)
    side = lambda c: i.where(c).groupBy("story_id").agg(F.min("epoch").alias("first_seen"), F.max("epoch").alias("last_seen"))
    return M.merge_keep_first(side("event_id < 5000"), side("event_id >= 5000"), "story_id", "first_seen", "last_seen")


def monotone_counts(spark, d):
    i = A.interactions(spark, d)
    side = lambda c: i.where(c).groupBy("story_id").agg(F.count_distinct("user_id").alias("n"))
    return M.monotone(side("event_id < 3000"), side("event_id >= 3000"), "story_id", "n")


def set_operations(spark, d):
    i = A.interactions(spark, d)
    a, b = i.where("policy = 'v1'").select("story_id", "user_id").distinct(), i.where("policy = 'v2'").select("story_id", "user_id").distinct()
    n = lambda df, k: df.groupBy("story_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(k))
    return reduce(DataFrame.unionByName, [n(a.intersect(b), "both"), n(a.subtract(b), "added"), n(b.subtract(a), "removed"), n(a.union(b).distinct(), "any")])


def notes(spark, d):
    """Turns of conversations as notes of ten readers."""
    c = A.table(spark, d, "conversations")
    kind = F.element_at(F.array(*map(F.lit, N.KINDS)), (F.col("turn") % 3 + 1).cast("int"))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("note_id"), (F.col("conv_id") % 10).alias("user_id"), F.col("conv_id").alias("item_id"), kind.alias("kind"), F.when(F.col("turn") % 2 == 0, "open").otherwise("done").alias("status"), F.coalesce("text", F.lit("")).alias("note_text"), F.lit(None).cast("string").alias("quote_text"), F.coalesce("role", F.lit("")).alias("title"), F.lit("src").alias("source"), F.lit("").alias("tags"), (F.col("conv_id") * 7 + F.col("turn")).alias("updated_epoch"))


def note_search(spark, d):
    return N.find_notes(notes(spark, d), " With ", status="open").select("note_id", "user_id")


def note_pages(spark, d):
    return N.page_of_notes(notes(spark, d), 2).select("note_id", "user_id")


def constraint_violations(spark, d):
    """The tables' own constraints, on rows of which some break them."""
    a, n = A.articles(spark, d), notes(spark, d)
    news = a.select((F.col("article_id") % 120 - 5).alias("importance_score"))
    src = a.select(F.when(F.col("article_id") % 11 == 0, " ").otherwise(F.col("source")).alias("name"), "category", F.when(F.col("article_id") % 13 == 0, "ftp://x").otherwise("https://x").alias("feed_url"), (F.col("priority") + F.when(F.col("article_id") % 7 == 0, 5).otherwise(0)).alias("priority"), F.lit("auto").alias("selection_mode"))
    n = n.select(F.when(F.col("note_id") % 17 == 0, "idea").otherwise(F.col("kind")).alias("kind"), "status", F.when(F.col("note_id") % 5 == 0, "  ").otherwise(F.col("note_text")).alias("note_text"), "quote_text")
    return reduce(DataFrame.unionByName, [N.broken(df, t).select(F.concat(F.lit(f"{t}."), F.col("constraint")).alias("constraint"), "n") for t, df in (("news_items", news), ("sources", src), ("notes", n))])


# --- readers -----------------------------------------------------------------------------------------------------------


def engagement(spark, d):
    return E.engagement(A.interactions(spark, d))


def rank_buckets(spark, d):
    return E.rank_buckets(A.interactions(spark, d))


def uuid_of(c: Column) -> Column:
    m = F.md5(c.cast("string").cast("binary"))
    return F.concat(F.substring(m, 1, 8), F.lit("-"), F.substring(m, 9, 4), F.lit("-4"), F.substring(m, 14, 3), F.lit("-8"), F.substring(m, 18, 3), F.lit("-"), F.substring(m, 21, 12))


def event_problems(spark, d):
    """Batches of one session each; some events have a bad rank, origin, session, policy, metadata, reasons or score."""
    i, n = A.interactions(spark, d), F.col("event_id")
    e = i.withColumns({
        "batch": F.col("session_id"),
        "session_id": F.when(n % 211 == 0, F.col("session_id")).otherwise(uuid_of(F.col("session_id"))),
        "rank": F.when(n % 97 == 0, F.lit(-1.0)).when(n % 89 == 0, F.lit(1.5)).otherwise(F.col("rank").cast("double")),
        "origin": F.when(n % 101 == 0, "robot").otherwise(F.col("origin")),
        "policy": F.when(n % 103 == 0, "").otherwise(F.col("policy")),
        "metadata": F.when(n % 107 == 0, F.repeat(F.lit("x"), 5001)).otherwise("{}"),
        "score_components": F.when(n % 109 == 0, "[1]").when(n % 2 == 0, '{"a": 1}'),
        "reasons": F.when(n % 113 == 0, F.array(F.lit(""))).when(n % 2 == 0, F.array(F.lit("ok"))),
        "rank_score": F.when(n % 127 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0)),
        "sort_mode": F.when(n % 131 == 0, "random").otherwise("top"),
    })
    return E.accepted_batches(e, "batch").withColumnRenamed("batch", "session_id")


def top_ignored(spark, d):
    i = A.interactions(spark, d)
    opened = i.where("event_type = 'source_open'").select("user_id", "story_id").distinct()
    return i.where("event_type = 'impression'").join(opened, ["user_id", "story_id"], "left_anti").groupBy("story_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "story_id").limit(5)


def unread_after_day(spark, d):
    items = feed_items(spark, d).select(F.col("article_id").alias("item_id"), "published_epoch", "read", "archived")
    return E.unread_after(items, items.where("read or archived").select("item_id"), AS_OF)


def implicit_events(spark, d):
    return R.implicit_events(A.interactions(spark, d).withColumn("ordinal", F.col("event_id"))).select("event_id", "user_id", "story_id", "event_type", "weight")


def behavioural_signals(spark, d):
    return R.behavioural_signals(A.interactions(spark, d))


def basis(spark, d):
    l = A.table(spark, d, "labels").join(texts(spark, d), F.col("doc_id") == F.col("article_id"))
    why = F.when(F.col("toxic") == 1, "quality").when(F.col("doc_id") % 4 == 1, "topic").when(F.col("doc_id") % 4 == 2, "source").when((F.col("doc_id") % 4 == 3) & (F.col("quality") == 0), "repetitive")
    return l.select((F.col("doc_id") % 10).alias("user_id"), (F.col("doc_id") % 150).alias("story_id"), "category", "source", F.col("title").alias("text"), F.when(F.col("quality") == 1, "more").otherwise("less").alias("sentiment"), why.alias("reason"), F.lit(1.0).alias("weight"), F.col("published_epoch").alias("updated_epoch"))


def preference_profile(spark, d):
    p = R.preference_profile(basis(spark, d), AS_OF)
    return p.select("user_id", "kind", "key", F.round("more", 6).alias("more"), F.round("less", 6).alias("less"))


def preferred(spark, d):
    """All items for each of ten readers, with their preference, freshness and update parts."""
    s = stories(spark, d).select(F.col("article_id").alias("item_id"), (F.col("article_id") % 150).alias("story_id"), "category", "source", F.col("title").alias("text"), "editorial", "published_epoch", "feed")
    items = s.withColumn("user_id", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("user_id", F.col("user_id").cast("long"))
    scored = R.preference_scores(items, R.preference_profile(basis(spark, d), AS_OF))
    age = (F.lit(AS_OF) - F.col("published_epoch")) / 3600.0
    return items.join(scored, ["user_id", "item_id"]).withColumns({"preference": F.round("preference", 6), "freshness": R.freshness_boost(age), "update": F.when(F.col("item_id") % 3 == 0, 4).otherwise(0), "selected_epoch": F.col("published_epoch")})


def feedback_adjust(spark, d):
    return preferred(spark, d).select("user_id", "item_id", "preference")


def rank_foryou(spark, d):
    return R.ranked(preferred(spark, d), "for-you", "v2", ["user_id"]).select("user_id", "item_id", F.round("rank_score", 6).alias("rank_score"), "model_rank")


def rank_explored(spark, d):
    return R.explored(R.ranked(preferred(spark, d), "for-you", "v2", ["user_id"]), "2024-01-31")


def plain_items(spark, d):
    """Feed items with the parts of a rank but preferences, as one list."""
    age = (F.lit(AS_OF) - F.col("published_epoch")) / 3600.0
    return feed_items(spark, d).withColumns({"item_id": F.col("article_id"), "preference": (F.col("article_id") * 7 % 31 - 15).cast("double"), "freshness": R.freshness_boost(age), "update": F.when(F.col("article_id") % 3 == 0, 4).otherwise(0), "selected_epoch": F.col("published_epoch")})


def rank_top(spark, d):
    return R.ranked(plain_items(spark, d), "top").select("item_id", "model_rank")


def rank_latest(spark, d):
    return R.ranked(plain_items(spark, d), "latest").select("item_id", "model_rank")


def rank_plain_v1(spark, d):
    return R.ranked(plain_items(spark, d), "for-you", "v1").select("item_id", "rank_score", "model_rank")


def feed_sections(spark, d):
    df = R.ranked(plain_items(spark, d), "for-you", "v2").withColumn("position", F.col("model_rank")).withColumn("bucket", F.when(F.col("item_id") % 5 == 0, "security_risk").otherwise("product_trend"))
    return R.sections(df).select("item_id", "position", "section")


def feed_page(spark, d):
    df = R.ranked(plain_items(spark, d), "for-you", "v2").withColumn("position", F.col("model_rank"))
    return R.page_after(df, "NDI", 30).select("item_id", "position")


def facet_counts(spark, d):
    return R.facets(feed_items(spark, d))


def dated_items(spark, d):
    """Feed items with the day of their digest, when they were first selected and last changed, and a visit."""
    n = F.col("article_id")
    return feed_items(spark, d).withColumns({"digest_date": F.date_format(F.timestamp_seconds("published_epoch"), "yyyy-MM-dd"), "first_selected": F.col("published_epoch"), "changed": F.when(n % 4 == 0, F.col("published_epoch") + 86400), "visit": F.lit(AS_OF - 3 * 86400)})


def period_latest(spark, d):
    """How many items each period of each view shows."""
    i = dated_items(spark, d)
    shown = [R.of_period(i, view, period).groupBy("feed").agg(F.count("*").alias("n")).select(F.lit(f"{view} {period}").alias("shown"), "feed", "n") for view in ("all", "unread", "saved") for period in ("latest", "since-visit", "history")]
    return reduce(DataFrame.unionByName, [*shown, R.of_period(i, "all", "history", "ai").groupBy("feed").agg(F.count("*").alias("n")).select(F.lit("ai").alias("shown"), "feed", "n")])


# --- scoring and selection ----------------------------------------------------------------------------------------------


def judged(spark, d):
    s = stories(spark, d)
    s = S.adjusted(s, ["edor"], ["ones"], ["with"], BUILD).withColumn("excluded", X.any_keyword(F.col("text"), ["eatat"]))
    age = (F.lit(AS_OF) - F.col("published_epoch")) / 3600.0
    reasons = S.eligibility_reasons(F.col("excluded"), F.col("article_id") % 9 != 0, age, F.lit(168.0), F.col("source_count"), F.lit(2), F.col("editorial"), F.lit(45), F.col("novelty"), F.col("feed"), F.col("is_major"), F.col("is_developer"))
    return s.withColumns({"reasons": reasons, "preference": F.col("article_id") * 7 % 31 - 15, "bucket": S.practical_bucket(F.col("text"), BUCKETS, SCOPE)})


def eligibility(spark, d):
    return judged(spark, d).select("article_id", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("eligible"))


def feed_adjustments(spark, d):
    return judged(spark, d).select("article_id", "feed", F.col("feed_adjustment").cast("long").alias("feed_adjustment"), "is_major", "is_developer")


def practical_buckets(spark, d):
    return judged(spark, d).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("editorial").alias("editorial"))


NEEDED = ("feed", "editorial", "feed_adjustment", "preference", "excluded")


def _of_runs(j: DataFrame) -> DataFrame:
    return j.select(F.concat(F.lit("run"), (F.col("article_id") % 12).cast("string")).alias("run_id"), F.col("article_id").alias("story_id"), "feed", F.lower("source").alias("publisher"), *NEEDED[1:])


def candidates(spark, d):
    return _of_runs(judged(spark, d).where(F.size("reasons") == 0))


def _kept_candidates(spark, d):
    """The same, with all that is made of texts worked out once and kept: a condition on it goes below what selects columns, and is worked out there again, part by part."""
    checkpoints(spark)
    j = judged(spark, d).select("article_id", "source", *NEEDED, (F.size("reasons") == 0).alias("eligible")).checkpoint()
    return _of_runs(j.where("eligible"))


def with_profiles(spark, d):
    """What adds profiles to candidates that a selection looks at; a text is read, but has no profile made, where it is none of them."""

    def profiled(batch: DataFrame) -> DataFrame:
        few = batch.drop("feed")
        few = F.broadcast(few) if few.count() <= 100_000 else few
        return D.profiles(_linked(spark, d).join(few.withColumnRenamed("story_id", "article_id"), "article_id").repartition("article_id")).withColumnRenamed("article_id", "story_id")

    return profiled


TARGETS = {"geopolitics": 3, "business": 3, "ai": 3, "software": 4, "security": 2}


def selection_v1(spark, d):
    return C.select_stories(C.score_v1(_kept_candidates(spark, d)), 12, TARGETS, 2, with_profiles(spark, d))


def selection_v2(spark, d):
    return C.select_stories(C.score_v2(_kept_candidates(spark, d)), 12, TARGETS, 2, with_profiles(spark, d))


def selection_scores(spark, d):
    c = C.score_v1(candidates(spark, d)).withColumnRenamed("final_score", "score_v1")
    return C.score_v2(c).select("story_id", "score_v1", F.col("final_score").alias("score_v2"))


def policy_gate(spark, d):
    """Both policies' twelve best of each run against each other."""
    c = C.score_v1(candidates(spark, d)).withColumnRenamed("final_score", "v1")
    c = C.score_v2(c).withColumnRenamed("final_score", "v2")
    scores = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.col(p).alias("final_score")) for p in ("v1", "v2")))).alias("s")
    by = Window.partitionBy("policy", "run_id").orderBy(F.desc("final_score"), "story_id")
    both = c.select(*(x for x in c.columns if x not in ("v1", "v2")), scores).select("*", "s.policy", "s.final_score").drop("s").withColumn("selection_rank", (F.row_number().over(by) - 1).cast("int"))
    return P.policy_gate(both.withColumns({"selected": F.col("selection_rank") < 12, "eligible": F.col("story_id") % 50 != 0}))


# --- stories --------------------------------------------------------------------------------------------------------------


def _linked(spark, d):
    """Whole articles; each third has a URL, the same for equal titles."""
    url = F.when(F.col("article_id") % 3 == 0, F.concat(F.lit("https://example.com/"), F.md5(F.col("title").cast("binary")))).otherwise("")
    return A.articles(spark, d).withColumn("canonical_url", url)


def profiles(spark, d):
    return D.profiles(_linked(spark, d))


def dup_pairs(spark, d):
    return D.duplicate_pairs(profiles(spark, d), all_pairs=False).where("duplicate").select("left_id", "right_id", "reason", F.round("score", 6).alias("score"))


def dup_reason_counts(spark, d):
    return D.reason_counts(profiles(spark, d))


def story_clusters(spark, d):
    return D.clusters(profiles(spark, d))


def story_memberships(spark, d):
    return D.memberships(profiles(spark, d))


def _recurring(spark, d):
    """Whole articles as stories, with profiles: each third is of the past, and each seventh has a key of its own."""
    a = _linked(spark, d).withColumn("story_id", F.col("article_id")).withColumn("last_seen_epoch", F.col("published_epoch"))
    a = a.withColumn("story_key", F.when(F.col("story_id") % 7 == 0, F.concat(F.lit("k"), (F.col("story_id") % 60).cast("string"))).otherwise(F.concat(F.lit("s"), F.col("story_id").cast("string"))))
    # those of the past are taken before they have profiles; their rows come from one task
    past = D.recent_history(a.where("story_id % 3 = 0"), A.AS_OF).repartition("story_id")
    checkpoints(spark)
    return D.profiles(a.where("story_id % 3 > 0")), D.profiles(past.checkpoint())


def history_matches(spark, d):
    """Stories of a run that go on from one of the last week: by key, else by the best profile that is left."""
    now, past = _recurring(spark, d)
    return D.match_stories(now, past).select("story_id", "history_id", "story_key", "reason", F.round("score", 6).alias("score"))


def _members(spark, d):
    """Stories by exact title, so that what follows has a form in SQL."""
    a = A.articles(spark, d)
    return a.withColumn("story_id", F.min("article_id").over(Window.partitionBy("title")))


def canonical_articles(spark, d):
    return D.canonical_article(_members(spark, d)).select("story_id", "article_id")


def source_variants(spark, d):
    m = _members(spark, d)
    return D.contributions(D.source_variants(m), D.canonical_article(m)).select("story_id", "publisher", "article_id", "contribution")


def story_changes(spark, d):
    m = _members(spark, d).groupBy(F.col("story_id").alias("story_key")).agg(F.min("title").alias("title"), F.max("summary").alias("summary"), F.min("source").alias("canonical_source"), F.count_distinct("source").alias("source_count"))
    old = m.where("story_key % 4 > 0").withColumn("source_count", F.when(F.col("story_key") % 4 == 1, F.col("source_count") + 1).otherwise(F.col("source_count"))).withColumn("title", F.when(F.col("story_key") % 8 == 5, F.lit("?")).otherwise(F.col("title")))
    return D.changes(m, old).select("story_key", F.array_join("changes", ",").alias("changes"))


def story_keys(spark, d):
    p = profiles(spark, d)
    return D.story_keys(p.join(_members(spark, d).select("article_id", "story_id"), "article_id"))


# --- sources -----------------------------------------------------------------------------------------------------------------


def reader_value(spark, d):
    return E.reader_value(A.interactions(spark, d), A.story_sources(spark, d)).select("source_id", F.round("value", 6).alias("value"))


def _quality(spark, d):
    values = A.observations(spark, d).groupBy("source_id").agg((F.sum("selected") * 0.1).alias("value"))
    return E.source_quality(A.observations(spark, d), values)


def source_quality(spark, d):
    return _quality(spark, d).drop("mean_duration_ms")


def _catalog(spark, d):
    q = P.penalties(_quality(spark, d)).withColumn("healthy_probes", F.col("runs") % 7)
    n = F.regexp_extract("source_id", r"(\d+)$", 1).cast("int")
    feed = F.element_at(F.array(*map(F.lit, X.V.FEEDS)), n % 5 + 1)
    return q.withColumn("feed", feed).withColumn("mode", F.when(n % 11 == 3, "always_on").when(n % 13 == 5, "blocked").otherwise("auto"))


def portfolio_scores(spark, d):
    return P.utility(_catalog(spark, d)).select("source_id", F.round("fetch_penalty", 6).alias("fetch_penalty"), "feed", "mode", F.col("category_need").cast("long").alias("category_need"), F.round("confidence", 6).alias("confidence"), "score")


def portfolio_select(spark, d):
    return P.portfolio(P.utility(_catalog(spark, d)), 14, 2).select("source_id", "mode", "role")


def run_summary(spark, d):
    n = F.regexp_extract("source_id", r"(\d+)$", 1).cast("int")
    return P.run_summary(A.observations(spark, d).withColumn("category", F.concat(F.lit("c"), (n % 5).cast("string"))))


def autopilot_gate(spark, d):
    return P.autopilot_gate(run_summary(spark, d).withColumn("automatic", F.substring("run_id", 6, 2).cast("int") % 2 == 0))


# --- time ---------------------------------------------------------------------------------------------------------------------


def exposure_islands(spark, d):
    e = A.table(spark, d, "events").select((F.col("event_id") % 300).alias("item_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), (F.col("value") / 20.0).alias("ratio"), (F.col("event_type") != "error").alias("visible"))
    return E.exposure_islands(e, 3_600_000)


def decay_by_day(spark, d):
    i = A.interactions(spark, d)
    age = (F.lit(AS_OF) - F.col("epoch")) / 86400.0
    return i.groupBy("story_id").agg(F.round(F.sum(X.half_life(age)), 6).alias("influence"), F.count("*").alias("n"))


def retention_runs(spark, d):
    runs = A.observations(spark, d).groupBy("run_id").agg(F.sum("parsed").alias("created_epoch")).select("run_id", F.col("created_epoch").cast("long").alias("created_epoch"))
    return L.runs_beyond(runs, 60)


ALL = [v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and k not in ("texts", "stories", "states", "feed_items", "basis", "preferred", "plain_items", "judged", "candidates", "profiles", "X_alternate", "uuid_of", "notes", "dated_items", "with_profiles") and not k.startswith("_")]
QUERIES = {f.__name__: f for f in ALL}
