"""Queries on what readers see, say and keep: feedback, signals, states, notes, items; with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import engagement as E
from tidewell.operators import notes as N
from tidewell.operators import preferences as B
from tidewell.operators import publishing as P
from tidewell.operators import reading as R
from tidewell.plans import oracle as O
from tidewell.plans import queries as Q
from tidewell.sources import adapters as A
from tidewell.sources.adapters import AS_OF

USERS = 10


def known_stories(spark, d):
    """story_id, category, source, title, summary, topic_tags, entity_tags: the articles, as stories of their own."""
    a = A.articles(spark, d)
    return a.select(F.col("article_id").alias("story_id"), "category", "source", "title", F.lit("").alias("summary"), F.when(F.col("article_id") % 3 == 0, F.array(F.lit("agents"))).otherwise(F.array().cast("array<string>")).alias("topic_tags"), F.array().cast("array<string>").alias("entity_tags"))


def events(spark, d):
    i = A.interactions(spark, d)
    return i.withColumns({"user_id": F.col("user_id") % USERS, "ordinal": F.col("event_id")})


def explicit(spark, d):
    l = A.table(spark, d, "labels").where("quality is not null")
    dimension = F.element_at(F.array(*map(F.lit, ["topic", "entity", "source", "repetition"])), (F.col("doc_id") % 4 + 1).cast("int"))
    s = l.select((F.col("doc_id") % USERS).alias("user_id"), F.col("doc_id").alias("story_id"), dimension.alias("dimension"), F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string")).alias("target"), F.lit("explicit").alias("origin"), F.when(F.col("quality") == 1, "more").otherwise("less").alias("sentiment"))
    return s.dropDuplicates(["user_id", "story_id", "dimension", "target"]).withColumns({"weight": F.lit(1.0), "confidence": F.lit(1.0), "updated_epoch": F.lit(AS_OF).cast("long")})


def behavioural_targets(spark, d):
    got = B.behavioural_signals(events(spark, d), known_stories(spark, d))
    return got.select("user_id", "story_id", "dimension", "target", "weight", "confidence", "updated_epoch")


def preference_basis(spark, d):
    s = explicit(spark, d)
    both = s.unionByName(B.behavioural_signals(events(spark, d).where("user_id < 7"), known_stories(spark, d)).select(*s.columns))
    got = B.signal_basis(both, known_stories(spark, d))
    return got.groupBy("user_id", "reason", "sentiment", "origin", "category", "source").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def story_feedback(spark, d):
    l = A.table(spark, d, "labels").where("quality is not null").groupBy((F.col("doc_id") % USERS).alias("user_id"), (F.col("doc_id") % 150).alias("story_id")).agg(F.max("quality").alias("q"), F.max("doc_id").alias("k"))
    return l.select("user_id", "story_id", F.when(F.col("q") == 1, "more").otherwise("less").alias("sentiment"), F.lit("quality").alias("reason"), (F.lit(AS_OF) - F.col("k") % 90 * 86400).alias("updated_epoch"))


def legacy_basis(spark, d):
    got = B.legacy_basis(story_feedback(spark, d), events(spark, d).where("user_id % 4 > 0"), known_stories(spark, d))
    return got.groupBy("user_id", "origin", "sentiment", "category").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def signal_writes(spark, d):
    s = explicit(spark, d)
    c = s.where("story_id % 3 = 0").withColumn("sentiment", F.when(F.col("story_id") % 2 == 0, F.lit(None).cast("string")).otherwise("less"))
    return B.set_signals(s, c).select("user_id", "story_id", "dimension", "target", "sentiment")


def feedback_writes(spark, d):
    """Feedback by story after what was said of items; then the older records by item for stories that have none."""
    l = A.table(spark, d, "labels").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    given = l.select((F.col("doc_id") % USERS).alias("user_id"), F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 150).alias("story_id"), F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string")).when(F.col("q") == 1, "more").otherwise("less").alias("sentiment"), F.when(F.col("doc_id") % 2 == 0, "entity").otherwise("source").alias("reason"))
    old = story_feedback(spark, d).select("user_id", "story_id", "sentiment", "reason")
    per_story, per_item = B.record_feedback(old, given.limit(0).select("user_id", "item_id", "sentiment"), given)
    return per_story.select("user_id", "story_id", F.lit(None).cast("long").alias("item_id"), "sentiment", "reason").unionByName(per_item.select("user_id", F.lit(None).cast("long").alias("story_id"), "item_id", "sentiment", F.lit(None).cast("string").alias("reason")))


def feedback_migration(spark, d):
    items = A.table(spark, d, "labels").where("toxic = 1").select((F.col("doc_id") % USERS).alias("user_id"), F.col("doc_id").alias("item_id"), F.lit("less").alias("sentiment"), F.col("doc_id").alias("updated_epoch")).distinct()
    news = A.articles(spark, d).select(F.col("article_id").alias("item_id"), F.when(F.col("article_id") % 9 > 0, F.col("article_id") % 150).alias("story_id"))
    return B.migrated_feedback(story_feedback(spark, d), items, news)


def forgotten_readers(spark, d):
    gone = spark.createDataFrame([(3,), (5,)], "user_id long")
    tables = [story_feedback(spark, d), events(spark, d), explicit(spark, d)]
    kept = [t.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("kept_of", F.lit(k)) for k, t in zip(("feedback", "events", "signals"), B.forgotten(tables, gone))]
    return reduce(DataFrame.unionByName, kept)


def state_writes(spark, d):
    i = A.articles(spark, d).select((F.col("article_id") % USERS).alias("user_id"), F.col("article_id").alias("item_id"), F.when(F.col("article_id") % 2 == 0, F.lit(5)).alias("read_at"), F.when(F.col("article_id") % 3 == 0, F.lit(6)).alias("saved_at"), F.lit(None).cast("int").alias("archived_at")).where("item_id % 4 > 0")
    c = A.articles(spark, d).where("article_id % 5 = 0").select((F.col("article_id") % USERS).alias("user_id"), F.col("article_id").alias("item_id"), (F.col("article_id") % 10 == 0).alias("on"))
    return B.set_states(i, c, "read_at", 9)


def state_events(spark, d):
    """States of items in time: each interaction sets one of them."""
    e, t = events(spark, d), F.col("event_id")
    marked = e.select("user_id", F.col("story_id").alias("item_id"), t.alias("at"), F.when(t % 3 == 0, t).alias("saved_at"), F.when(t % 2 == 0, t).alias("read_at"), F.when(t % 5 == 0, t).alias("archived_at"))
    return E.state_events(marked)


def visits(spark, d):
    e = events(spark, d)
    side = lambda c: e.where(c).groupBy("user_id").agg(F.max("epoch").alias("last_visit"))
    return B.mark_visits(side("event_id % 2 = 0"), side("event_id % 2 = 1 and user_id > 2"))


def ignored_sources(spark, d):
    return E.ignored(story_feedback(spark, d), known_stories(spark, d), "source", 3)


def recent_engagement(spark, d):
    """The engagement of the days before the last event."""
    i = A.interactions(spark, d)
    return E.engagement(E.since(i, AS_OF - 60, 20)).select("policy", "impressions", "opened", "unattributed")


def own_rows(spark, d):
    """What the readers with an allowed address see of their own."""
    readers = spark.range(USERS).select(F.col("id").alias("user_id"), F.concat(F.lit("Reader"), F.col("id").cast("string"), F.lit("@X.org")).alias("email"))
    allowed = readers.where("user_id % 3 = 0").select(F.lower("email").alias("email"))
    mine = B.visible(story_feedback(spark, d), readers, allowed, "user_id")
    return mine.select("user_id", "story_id", "sentiment")


def item_details(spark, d):
    """Items of one reader each with state, feedback and number of notes, and the newest of their updates."""
    a = A.articles(spark, d)
    items = a.select((F.col("article_id") % USERS).alias("user_id"), F.col("article_id").alias("item_id"), (F.col("article_id") % 150).alias("story_id"))
    states = a.where("article_id % 3 = 0").select((F.col("article_id") % USERS).alias("user_id"), F.col("article_id").alias("item_id"), F.lit(1).alias("read_at"))
    told = A.table(spark, d, "labels").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("t")).select((F.col("doc_id") % USERS).alias("user_id"), F.col("doc_id").alias("item_id"), F.when(F.col("t") == 1, "less").otherwise("more").alias("sentiment"))
    got = P.with_feedback(items, states, story_feedback(spark, d), told, Q.notes(spark, d))
    updates = P.timeline(A.interactions(spark, d)).groupBy("story_id").agg(F.count("*").alias("n_updates"), F.max_by("event_id", -F.col("place")).alias("latest"))
    return got.join(updates, "story_id", "left").select("user_id", "item_id", "read_at", "feedback", "feedback_reason", "note_count", F.coalesce("n_updates", F.lit(0)).alias("n_updates"), "latest")


def payloads(spark, d):
    n = F.col("article_id")
    preview = F.struct(F.when(n % 4 > 0, "what").alias("whatHappened"), F.lit("why").alias("whyItMatters"), F.when(n % 5 == 0, " ").otherwise("click").alias("clickIf"), F.when(n % 2 == 0, "market_risk").alias("practicalBucket"))
    raw = F.to_json(F.struct(F.when(n % 3 > 0, preview).alias("preview"), F.when(n % 7 > 0, "product_trend").alias("practicalBucket"), F.struct(F.struct(n.alias("impact"), F.lit("x").alias("note"), F.array(n).alias("list")).alias("components")).alias("score"), F.lit(" read it ").alias("recommendedAction")))
    variant = lambda i, name: F.struct(F.concat(F.lit("a"), i.cast("string")).alias("articleId"), name.alias("name"), F.lit("https://x").alias("url"), F.lit(1).alias("priority"))
    variants = F.when(n % 11 == 0, F.lit("no json")).otherwise(F.to_json(F.array(variant(n, F.lit("A")), variant(n + 1, F.when(n % 2 == 0, "B")))))
    return A.articles(spark, d).select(n.alias("item_id"), raw.alias("raw_payload"), variants.alias("source_variants"))


def item_projection(spark, d):
    p = P.project_items(payloads(spark, d))
    return p.select("item_id", F.size("variants").cast("long").alias("n_variants"), "bucket", F.col("preview").isNotNull().alias("has_preview"), "recommended_action", F.array_join(F.array_sort(F.map_keys("score_components")), ",").alias("components"))


def ranking_reasons(spark, d):
    n = F.col("item_id")
    i = Q.plain_items(spark, d).withColumns({"first_selected": F.col("published_epoch"), "changed": F.when(n % 4 == 0, F.lit(AS_OF)), "visit": F.when(n % 5 > 0, F.lit(AS_OF - 3 * 86400)), "changes": F.when(n % 3 == 0, F.array(F.lit("new"))).when(n % 3 == 1, F.array(F.lit("title"))).otherwise(F.array().cast("array<string>")), "source_count": n % 4 + 1, "is_exploration": n % 10 == 0})
    i = R.visit_flags(i)
    said = lambda sort, policy: F.array_join(R.ranking_reasons(sort, policy), "; ")
    return i.select("item_id", "is_new", "is_updated", F.col("update").cast("long").alias("update"), said("for-you", "v1").alias("v1"), said("for-you", "v2").alias("v2"), said("top", "v2").alias("top"), said("latest", "v2").alias("latest"))


def strongest_preferences(spark, d):
    got = R.strongest_preferences(R.preference_profile(Q.basis(spark, d), AS_OF).where("kind <> 'story'").withColumns({c: F.round(c, 6) for c in ("more", "less")}))
    return got.select("user_id", "kind", "key", F.round("net", 6).alias("net"))


def note_writes(spark, d):
    """New notes on articles' items: some are not valid, some quote what is not there, some name another story's article."""
    n = F.col("note_id")
    made = Q.notes(spark, d).select("note_id", "user_id", "item_id", F.when(n % 3 == 0, F.col("item_id")).when(n % 7 == 0, F.col("item_id") + 1).alias("article_id"), F.when(n % 13 == 0, "idea").otherwise(F.col("kind")).alias("kind"), F.when(n % 4 == 0, "").otherwise("  a note ").alias("note_text"), F.when(n % 8 == 0, F.lit(None).cast("string")).when(n % 5 == 0, "not in there").otherwise(" <b>THE</b>  Item").alias("quote_text"), F.lit(None).cast("string").alias("quote_prefix"), F.when(n % 17 == 0, F.repeat(F.lit("y"), 201)).alias("quote_suffix"))
    a = A.articles(spark, d)
    items = a.select(F.col("article_id").alias("item_id"), F.col("article_id").alias("story_id"), F.concat(F.lit("the item "), F.col("article_id").cast("string")).alias("title"), F.lit("x").alias("summary"), "source", F.lit("u").alias("source_url"))
    articles = a.select("article_id", F.lit("body").alias("body"), F.lit("paper").alias("source"), F.lit("v").alias("url"))
    return N.new_notes(made, items, articles, a.select(F.col("article_id").alias("story_id"), "article_id")).select("note_id", "user_id", "item_id", "article_id", "note_text", "title", "source", "source_url")


def note_edits(spark, d):
    n, notes = F.col("note_id"), Q.notes(spark, d).select("note_id", "user_id", "kind", "status", "note_text")
    edits = notes.where(n % 3 == 0).select("note_id", F.when(n % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("user_id"), F.when(n % 12 == 0, "idea").when(n % 4 == 0, "thought").alias("kind"), F.lit("done").alias("status"), F.when(n % 9 == 0, " new ").alias("note_text"))
    kept = N.delete_notes(N.edit_notes(notes, edits), notes.where(n % 11 == 0).select("note_id", "user_id"))
    return kept.select("note_id", "kind", "status", F.length("note_text").alias("n_chars"))


def settings_loaded(spark, d):
    readers = A.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    stored = A.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal") / 50).alias("publish_top_n"), F.when(F.col("c_custkey") % 5 == 0, "v2").alias("policy"))
    return P.load_settings(readers, stored, {"publish_top_n": 30, "policy": "shadow"}, {"publish_top_n": (5, 100)})


def settings_writes(spark, d):
    """One row a reader after an upsert, and the settings of runs by who started them."""
    c = A.table(spark, d, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.lit(1).alias("top_n"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), F.lit(2).alias("top_n"))
    from tidewell.operators.merging import upsert

    runs = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey")).alias("started_by"))
    return P.run_settings(runs, upsert(old, new, ["user_id"]), {"top_n": 9}).groupBy("top_n").agg(F.count("*").alias("n"))


def retained_items(spark, d):
    i = A.articles(spark, d).select(F.col("article_id").alias("item_id"), F.col("published_epoch").alias("last_selected"))
    noted = Q.notes(spark, d).select("item_id").distinct()
    kept = P.retained(i, i.where("item_id % 6 = 0").select("item_id"), noted, AS_OF, 4)
    states = i.select("item_id", F.lit("state").alias("of"))
    return P.cascade(states, kept, "item_id")


KNOWN = f"{O.ARTICLES}, known AS (SELECT article_id AS story_id, category, source, title, article_id % 3 = 0 AS tagged FROM articles)"
EXPLICIT = "explicit AS (SELECT doc_id % 10 AS user_id, doc_id AS story_id, ['topic', 'entity', 'source', 'repetition'][doc_id % 4 + 1] AS dimension, 't' || (doc_id % 5) AS target, CASE WHEN max(quality) = 1 THEN 'more' ELSE 'less' END AS sentiment FROM labels WHERE quality IS NOT NULL GROUP BY doc_id)"
BEHAVIOUR = f"""{O.INTERACTIONS}, acted AS (SELECT user_id % 10 AS user_id, i.story_id, CASE WHEN event_type = 'source_open' THEN 'source' ELSE 'topic' END AS dimension, CASE WHEN event_type = 'source_open' THEN k.source WHEN tagged THEN 'agents' ELSE k.category END AS target, event_type, epoch, event_id FROM interactions i JOIN known k ON k.story_id = i.story_id WHERE event_type IN ('save', 'read', 'source_open') AND coalesce(origin, 'direct') = 'direct'),
behaviour AS (SELECT user_id, story_id, dimension, target, CASE event_type WHEN 'save' THEN 0.8::DOUBLE WHEN 'read' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END AS weight, CASE event_type WHEN 'save' THEN 0.85::DOUBLE WHEN 'read' THEN 0.65::DOUBLE ELSE 0.6::DOUBLE END AS confidence, epoch AS updated_epoch FROM (SELECT *, row_number() OVER (PARTITION BY user_id, story_id, dimension, target ORDER BY epoch DESC, event_id DESC) AS n FROM acted) WHERE n = 1)"""
FEEDBACK = "feedback AS (SELECT doc_id % 10 AS user_id, doc_id % 150 AS story_id, CASE WHEN max(quality) = 1 THEN 'more' ELSE 'less' END AS sentiment, 'quality' AS reason, 1706659200 - max(doc_id) % 90 * 86400 AS updated_epoch FROM labels WHERE quality IS NOT NULL GROUP BY ALL)"

QUERIES = {f.__name__: f for f in (behavioural_targets, preference_basis, legacy_basis, signal_writes, feedback_writes, feedback_migration, forgotten_readers, state_writes, state_events, visits, ignored_sources, recent_engagement, own_rows, item_details, item_projection, ranking_reasons, strongest_preferences, note_writes, note_edits, settings_loaded, settings_writes, retained_items)}
ORACLE = {
    "behavioural_targets": f"WITH {KNOWN}, {BEHAVIOUR} SELECT * FROM behaviour",
    "preference_basis": f"""WITH {KNOWN}, {EXPLICIT}, {BEHAVIOUR}, warm AS (SELECT user_id FROM behaviour WHERE user_id < 7 GROUP BY 1 HAVING count(DISTINCT story_id) >= 5),
s AS (SELECT user_id, story_id, dimension, target, sentiment, 'explicit' AS origin, 1.0::DOUBLE AS w FROM explicit UNION ALL SELECT user_id, story_id, dimension, target, 'more', 'implicit', weight * confidence FROM behaviour WHERE user_id IN (SELECT user_id FROM warm))
SELECT user_id, CASE dimension WHEN 'repetition' THEN 'repetitive' ELSE dimension END AS reason, sentiment, origin, CASE WHEN dimension = 'topic' THEN target ELSE category END AS category, CASE WHEN dimension = 'source' THEN target ELSE source END AS source, count(*) AS n, round(sum(w), 6) AS weight FROM s JOIN known k ON k.story_id = s.story_id GROUP BY ALL""",
    "legacy_basis": f"""WITH {KNOWN}, {FEEDBACK}, {O.INTERACTIONS}, w AS (SELECT user_id % 10 AS u, session_id, day, story_id, event_id, CASE event_type WHEN 'read' THEN 1.25::DOUBLE WHEN 'save' THEN 2.0::DOUBLE WHEN 'source_open' THEN 0.75::DOUBLE END AS weight FROM interactions WHERE coalesce(origin, 'direct') = 'direct' AND user_id % 10 % 4 > 0 AND story_id IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY u, session_id, story_id ORDER BY weight DESC, event_id) AS n FROM w WHERE weight IS NOT NULL), b AS (SELECT * EXCLUDE n, row_number() OVER (PARTITION BY u, day, story_id ORDER BY weight DESC, event_id) AS n FROM a WHERE n = 1), c AS (SELECT * FROM b WHERE n = 1 AND u IN (SELECT u FROM b WHERE n = 1 GROUP BY u HAVING count(DISTINCT story_id) >= 5)),
t AS (SELECT user_id, 'explicit' AS origin, sentiment, category, 1.0::DOUBLE AS weight FROM feedback f JOIN known k ON k.story_id = f.story_id UNION ALL SELECT u, 'implicit', 'more', category, weight FROM c JOIN known k ON k.story_id = c.story_id)
SELECT user_id, origin, sentiment, category, count(*) AS n, round(sum(weight), 6) AS weight FROM t GROUP BY ALL""",
    "signal_writes": f"WITH {EXPLICIT} SELECT user_id, story_id, dimension, target, CASE WHEN story_id % 3 = 0 THEN 'less' ELSE sentiment END AS sentiment FROM explicit WHERE NOT (story_id % 3 = 0 AND story_id % 2 = 0)",
    "feedback_writes": f"""WITH {FEEDBACK}, l AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY 1), g AS (SELECT doc_id % 10 AS user_id, doc_id AS item_id, CASE WHEN doc_id % 7 > 0 THEN doc_id % 150 END AS story_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN q = 1 THEN 'more' ELSE 'less' END AS sentiment, CASE WHEN doc_id % 2 = 0 THEN 'topic' ELSE 'source' END AS reason FROM l),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, story_id ORDER BY item_id DESC) AS n FROM g WHERE story_id IS NOT NULL) WHERE n = 1)
SELECT user_id, story_id, NULL::BIGINT AS item_id, sentiment, reason FROM feedback f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = f.user_id AND s.story_id = f.story_id) UNION ALL SELECT user_id, story_id, NULL, sentiment, reason FROM s WHERE sentiment IS NOT NULL UNION ALL SELECT user_id, NULL, item_id, sentiment, NULL FROM g WHERE sentiment IS NOT NULL""",
    "feedback_migration": f"""WITH {FEEDBACK}, i AS (SELECT DISTINCT doc_id % 10 AS user_id, doc_id % 150 AS story_id, doc_id FROM labels WHERE toxic = 1 AND doc_id % 9 > 0 AND doc_id IN (SELECT doc_id FROM documents)), m AS (SELECT user_id, story_id, 'less' AS sentiment, 'topic' AS reason, max(doc_id) AS updated_epoch FROM i GROUP BY ALL)
SELECT * FROM feedback f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = f.user_id AND m.story_id = f.story_id) UNION ALL SELECT * FROM m""",
    "forgotten_readers": f"WITH {FEEDBACK}, {EXPLICIT}, t AS (SELECT user_id, 'feedback' AS kept_of FROM feedback UNION ALL SELECT user_id % 10, 'events' FROM events UNION ALL SELECT user_id, 'signals' FROM explicit) SELECT user_id, count(*) AS n, kept_of FROM t WHERE user_id NOT IN (3, 5) GROUP BY ALL",
    "state_writes": "SELECT doc_id % 10 AS user_id, doc_id AS item_id, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 10 = 0 THEN 9 END WHEN doc_id % 2 = 0 THEN 5 END AS read_at, CASE WHEN doc_id % 4 > 0 AND doc_id % 3 = 0 THEN 6 END AS saved_at, NULL::INT AS archived_at FROM documents WHERE doc_id % 4 > 0 OR doc_id % 5 = 0",
    "state_events": f"""WITH {O.INTERACTIONS}, s AS (SELECT user_id % 10 AS user_id, story_id AS item_id, event_id AS "at", event_id % 3 = 0 AS s, event_id % 2 = 0 AS r, event_id % 5 = 0 AS a FROM interactions), p AS (SELECT *, lag(s) OVER w AS ps, lag(r) OVER w AS pr, lag(a) OVER w AS pa FROM s WINDOW w AS (PARTITION BY user_id, item_id ORDER BY "at")) SELECT user_id, item_id, "at", CASE WHEN s AND NOT ps THEN 'save' WHEN r AND NOT pr THEN 'read' ELSE 'archive' END AS event_type FROM p WHERE ps IS NOT NULL AND ((s AND NOT ps) OR (r AND NOT pr) OR (a AND NOT pa))""",
    "visits": f"WITH {O.INTERACTIONS} SELECT user_id % 10 AS user_id, max(epoch) AS last_visit FROM interactions WHERE event_id % 2 = 0 OR user_id % 10 > 2 GROUP BY 1",
    "ignored_sources": f"WITH {KNOWN}, {FEEDBACK}, n AS (SELECT user_id, source AS label, count(*) AS n FROM feedback f JOIN known k ON k.story_id = f.story_id WHERE sentiment = 'less' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, label) AS k FROM n) SELECT user_id, label, n FROM r WHERE k <= 3",
    "recent_engagement": f"WITH {O.INTERACTIONS.replace('interactions AS', 'every_one AS', 1)}, interactions AS (SELECT * FROM every_one WHERE epoch >= 1706659200 - 60 - 20 * 86400), seen AS ({O.SEEN}), acted AS ({O.ACTED}), j AS (SELECT coalesce(seen.policy, acted.policy) AS policy, seen.rank IS NOT NULL AS shown, o FROM seen FULL JOIN acted ON seen.context_id = acted.context_id AND seen.story_id = acted.story_id AND seen.policy = acted.policy) SELECT policy, count(*) FILTER (shown) AS impressions, CAST(coalesce(sum(o) FILTER (shown), 0) AS BIGINT) AS opened, count(*) FILTER (NOT shown) AS unattributed FROM j GROUP BY policy",
    "own_rows": f"WITH {FEEDBACK} SELECT user_id, story_id, sentiment FROM feedback WHERE user_id % 3 = 0",
    "item_details": f"""WITH {O.INTERACTIONS}, {FEEDBACK}, {O.NOTES}, told AS (SELECT doc_id, CASE WHEN max(toxic) = 1 THEN 'less' ELSE 'more' END AS s FROM labels WHERE toxic IS NOT NULL GROUP BY 1), n AS (SELECT user_id, note_id // 100 AS item_id, count(*) AS n FROM notes GROUP BY ALL), u AS (SELECT story_id, least(20, count(*)) AS n, last(event_id ORDER BY epoch, event_id) AS latest FROM interactions GROUP BY 1)
SELECT d.doc_id % 10 AS user_id, d.doc_id AS item_id, CASE WHEN d.doc_id % 3 = 0 THEN 1 END AS read_at, coalesce(f.sentiment, t.s) AS feedback, CASE WHEN f.sentiment IS NOT NULL THEN 'quality' WHEN t.s IS NOT NULL THEN 'topic' END AS feedback_reason, coalesce(n.n, 0) AS note_count, coalesce(u.n, 0) AS n_updates, u.latest
FROM documents d LEFT JOIN feedback f ON f.user_id = d.doc_id % 10 AND f.story_id = d.doc_id % 150 LEFT JOIN told t ON t.doc_id = d.doc_id LEFT JOIN n ON n.user_id = d.doc_id % 10 AND n.item_id = d.doc_id LEFT JOIN u ON u.story_id = d.doc_id % 150""",
    "item_projection": "WITH p AS (SELECT doc_id AS n, doc_id % 3 > 0 AS has, CASE WHEN doc_id % 3 > 0 AND doc_id % 2 = 0 THEN 'market_risk' WHEN doc_id % 7 > 0 THEN 'product_trend' END AS b FROM documents) SELECT n AS item_id, CASE WHEN n % 11 = 0 THEN 0 WHEN n % 2 = 0 THEN 2 ELSE 1 END AS n_variants, CASE WHEN has AND n % 4 > 0 AND n % 5 > 0 AND b IS NOT NULL THEN b WHEN n % 7 > 0 THEN 'product_trend' END AS bucket, has AND n % 4 > 0 AND n % 5 > 0 AND b IS NOT NULL AS has_preview, 'read it' AS recommended_action, 'impact,note' AS components FROM p",
    "ranking_reasons": f"""WITH {O.PLAIN}, f AS (SELECT *, item_id % 5 > 0 AND published_epoch > 1706659200 - 259200 AS is_new, item_id % 5 > 0 AND item_id % 4 = 0 AND published_epoch <= 1706659200 - 259200 AS is_updated FROM plain), u AS (SELECT *, CASE WHEN item_id % 5 = 0 THEN CASE item_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 0 END WHEN is_new THEN 8 WHEN is_updated THEN 6 ELSE 0 END AS up, CASE WHEN preference > 0 THEN 'Matches your preferences' WHEN preference < 0 THEN 'Lowered by your preferences' END AS p, CASE WHEN freshness >= 9 THEN 'Recently selected' END AS r, CASE WHEN item_id % 4 >= 2 THEN 'Confirmed by ' || (item_id % 4 + 1) || ' sources' END AS c, CASE WHEN item_id % 10 = 0 THEN 'Exploration pick' END AS e FROM f)
SELECT item_id, is_new, is_updated, CAST(up AS BIGINT) AS update, concat_ws('; ', p, r, CASE WHEN up > 0 THEN CASE WHEN is_new THEN 'New since your last visit' ELSE 'Materially updated' END END, c, e) AS v1, concat_ws('; ', p, r, CASE WHEN up > 0 THEN 'New or materially updated since your last visit' END, c, e) AS v2, concat_ws('; ', CASE WHEN editorial >= 70 THEN 'High editorial importance' ELSE 'Editorial importance' END, c) AS top, 'Most recently selected' AS latest FROM u""",
    "strongest_preferences": f"WITH {O.PROFILE}, n AS (SELECT user_id, kind, key, round(more, 6) - round(less, 6) AS net FROM profile WHERE kind <> 'story'), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY abs(net) DESC, key) AS k FROM n WHERE abs(net) >= 0.2) SELECT user_id, kind, key, round(net, 6) AS net FROM r WHERE k <= 5",
    "note_writes": f"""WITH {O.NOTES}, n AS (SELECT note_id, user_id, note_id // 100 AS item_id, CASE WHEN note_id % 3 = 0 THEN note_id // 100 WHEN note_id % 7 = 0 THEN note_id // 100 + 1 END AS article_id, CASE WHEN note_id % 4 = 0 THEN '' ELSE 'a note' END AS note_text, CASE WHEN note_id % 8 = 0 THEN NULL WHEN note_id % 5 = 0 THEN 'not' ELSE 'the' END AS quote FROM notes WHERE note_id % 13 > 0 AND note_id % 17 > 0)
SELECT note_id, user_id, item_id, article_id, note_text, 'the item ' || item_id AS title, CASE WHEN article_id IS NULL THEN d.source ELSE 'paper' END AS source, CASE WHEN article_id IS NULL THEN 'u' ELSE 'v' END AS source_url FROM n JOIN documents d ON d.doc_id = item_id WHERE (note_text <> '' OR quote IS NOT NULL) AND coalesce(quote, 'the') = 'the' AND (article_id IS NULL OR article_id = item_id)""",
    "note_edits": f"WITH {O.NOTES} SELECT note_id, CASE WHEN note_id % 3 = 0 AND note_id % 2 = 0 AND note_id % 12 > 0 AND note_id % 4 = 0 THEN 'thought' ELSE kind END AS kind, CASE WHEN note_id % 3 = 0 AND note_id % 2 = 0 AND note_id % 12 > 0 THEN 'done' ELSE status END AS status, CASE WHEN note_id % 9 = 0 AND note_id % 2 = 0 AND note_id % 12 > 0 THEN 3 ELSE length(note_text) END AS n_chars FROM notes WHERE note_id % 11 > 0",
    "settings_loaded": "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 > 0 THEN CAST(greatest(5, least(100, floor(c_acctbal / 50 + 0.5))) AS BIGINT) ELSE 30 END AS publish_top_n, CASE WHEN c_custkey % 10 = 0 THEN 'v2' ELSE 'shadow' END AS policy FROM customer",
    "settings_writes": "SELECT CASE WHEN o_orderkey % 4 = 0 THEN 9 WHEN o_custkey % 3 = 0 THEN 2 WHEN o_custkey % 2 = 0 THEN 1 ELSE 9 END AS top_n, count(*) AS n FROM orders GROUP BY 1",
    "retained_items": f"WITH {O.ARTICLES} SELECT article_id AS item_id, 'state' AS of FROM articles WHERE published_epoch >= 1706659200 - 345600 OR article_id % 6 = 0 OR article_id IN (SELECT conv_id FROM conversations)",
}
