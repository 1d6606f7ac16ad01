"""Further queries, of publication and of the lookups around it, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import publishing as P
from tidewell.plans import oracle as O
from tidewell.plans import queries as Q
from tidewell.sources import adapters as A


def enrichment_candidates(spark, d):
    s = Q.stories(spark, d).select("article_id", F.col("editorial").alias("importance"), "published_epoch", F.when(F.col("article_id") % 3 == 0, "pending").otherwise("enriched").alias("status"), F.when(F.col("article_id") % 11 == 0, "unknown").otherwise("readable").alias("content_mode"), (F.col("article_id") % 4).alias("copy_version"))
    return P.enrichment_candidates(s).select("article_id", "importance")


def cached_copies(spark, d):
    """Five articles are copies of an item; one of them has the item's own URL."""
    url = lambda n: F.concat(F.lit("u"), n.cast("string"))
    items = A.articles(spark, d).select(F.col("article_id").alias("item_id"), url(F.col("article_id") * 5 + F.col("article_id") % 5).alias("url"))
    copies = Q.texts(spark, d).select(F.expr("article_id div 5").alias("item_id"), "article_id", url(F.col("article_id")).alias("canonical_url"), (F.col("article_id") % 7 != 0).alias("readable"), X.word_count(F.col("text")).alias("n_words"), F.length("text").alias("n_chars"))
    return P.cached_copy(items, copies)


def score_changes(spark, d):
    s = Q.stories(spark, d).select(F.col("article_id").alias("story_id"), "editorial")
    before = s.where("story_id % 3 > 0").withColumn("editorial", F.col("editorial") - F.col("story_id") % 25)
    return P.score_changes(s, before).select("story_id", "editorial", "moved")


def story_timeline(spark, d):
    return P.timeline(A.interactions(spark, d)).select("story_id", "event_id", "place")


def explicit_signals(spark, d):
    i = A.articles(spark, d).select(F.col("article_id").alias("item_id"), F.when(F.col("article_id") % 13 > 0, F.col("article_id") % 150).alias("story_id"), F.element_at(F.array(*map(F.lit, ["topic", "entity", "source", "repetitive", "quality"])), (F.col("article_id") % 5 + 1).cast("int")).alias("reason"), "category", "source", F.when(F.col("article_id") % 2 == 0, F.array(F.lit(" agents "))).otherwise(F.array().cast("array<string>")).alias("topic_tags"), F.when(F.col("article_id") % 3 == 0, F.array(F.lit("OpenAI"))).otherwise(F.array().cast("array<string>")).alias("entity_tags"))
    return P.explicit_signals(i)


def published_summaries(spark, d):
    a = A.articles(spark, d)
    return a.select("article_id", P.published_summary(F.when(F.col("article_id") % 4 > 0, F.col("summary")), F.col("title"), 120).alias("summary"))


def page_category(spark, d):
    return A.table(spark, d, "pages").select("page_id", P.category(F.col("html")).alias("category"), P.language(F.col("html")).alias("language"))


def error_classes(spark, d):
    e = A.table(spark, d, "events")
    message = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("HTTP "), (F.col("event_id") % 100 + 400).cast("string"))).when(F.col("event_id") % 4 == 1, "The operation timed out").when(F.col("event_id") % 4 == 2, "bad xml")
    return e.groupBy(P.error_class(message).alias("class")).agg(F.count("*").alias("n"))


def highlights(spark, d):
    items = Q.editorial_topn(spark, d).select((F.lit("run")).alias("run_id"), F.col("selection_rank"), F.col("article_id").alias("story_id"))
    runs = spark.createDataFrame([("run", [3, 0, 99])], "run_id string, highlights array<int>")
    return P.highlighted(runs, items).select("run_id", F.col("place").cast("long").alias("place"), "story_id")


def settings_clamp(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "many").otherwise((F.col("c_acctbal") / 100).cast("string")).alias("top_n"))
    return P.clamped_settings(c, {"top_n": (1, 50, 20)})


def fetch_policy(spark, d):
    li = A.table(spark, d, "lineitem")
    ok = P.fetch_allowed((F.col("l_quantity") * 10).cast("int"), F.col("l_extendedprice") * 30, F.col("l_linenumber"))
    return li.groupBy("l_linenumber").agg(F.count_if(ok).alias("n_ok"), F.count("*").alias("n"))


def gone_parents(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return P.set_null_where_gone(o, A.table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"), "c_custkey").select("o_orderkey", "c_custkey")


def keyword_settings(spark, d):
    return A.articles(spark, d).select("article_id", F.array_join(F.sort_array(P.keyword_setting(F.replace(F.col("title"), F.lit(". "), F.lit(",")))), "|").alias("keywords"))


QUERIES = {f.__name__: f for f in (enrichment_candidates, cached_copies, score_changes, story_timeline, explicit_signals, published_summaries, page_category, error_classes, highlights, settings_clamp, fetch_policy, gone_parents, keyword_settings)}
ORACLE = {
    "enrichment_candidates": f"WITH {O.STORIES} SELECT article_id, editorial AS importance FROM stories WHERE article_id % 3 = 0 OR article_id % 11 = 0 OR article_id % 4 < 2 ORDER BY editorial DESC, published_epoch DESC, article_id LIMIT 40",
    "cached_copies": rf"WITH {O.TEXTS}, c AS (SELECT article_id // 5 AS item_id, article_id, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS w, length(text) AS n FROM texts WHERE article_id % 7 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY article_id = item_id * 5 + item_id % 5 DESC, w DESC, n DESC, article_id) AS k FROM c WHERE item_id IN (SELECT article_id FROM texts)) SELECT item_id, article_id FROM r WHERE k = 1",
    "score_changes": f"WITH {O.STORIES} SELECT article_id AS story_id, editorial + CASE WHEN article_id % 3 > 0 AND article_id % 25 >= 10 THEN 8 ELSE 0 END AS editorial, article_id % 3 > 0 AND article_id % 25 >= 10 AS moved FROM stories",
    "story_timeline": f"WITH {O.INTERACTIONS}, r AS (SELECT story_id, event_id, row_number() OVER (PARTITION BY story_id ORDER BY epoch DESC, event_id DESC) - 1 AS place FROM interactions) SELECT * FROM r WHERE place < 20",
    "explicit_signals": f"WITH {O.ARTICLES}, r AS (SELECT article_id AS item_id, ['topic','entity','source','repetition','quality'][article_id % 5 + 1] AS dimension, CASE article_id % 5 WHEN 0 THEN CASE WHEN article_id % 2 = 0 THEN 'agents' ELSE category END WHEN 1 THEN CASE WHEN article_id % 3 = 0 THEN 'OpenAI' END WHEN 2 THEN source ELSE CAST(article_id % 150 AS VARCHAR) END AS target FROM articles WHERE article_id % 13 > 0) SELECT * FROM r WHERE target IS NOT NULL",
    "error_classes": "SELECT CASE event_id % 4 WHEN 0 THEN 'http_' || (event_id % 100 + 400) WHEN 1 THEN 'timeout' WHEN 2 THEN 'network_or_parse_error' END AS class, count(*) AS n FROM events GROUP BY 1",
    "highlights": f"WITH {O.STORIES}, r AS (SELECT row_number() OVER (ORDER BY editorial DESC, article_id) - 1 AS place, article_id AS story_id FROM stories) SELECT 'run' AS run_id, place, story_id FROM r WHERE place IN (0, 3)",
    "settings_clamp": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 20 ELSE CAST(greatest(1, least(50, floor(c_acctbal / 100 + 0.5))) AS BIGINT) END AS top_n FROM customer",
    "fetch_policy": "SELECT l_linenumber, count(*) FILTER (CAST(l_quantity * 10 AS INT) BETWEEN 200 AND 299 AND l_extendedprice * 30 <= 2000000 AND l_linenumber <= 5) AS n_ok, count(*) AS n FROM lineitem GROUP BY 1",
    "gone_parents": "SELECT o_orderkey, c_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON o_custkey = c.c_custkey",
    "keyword_settings": rf"WITH {O.ARTICLES} SELECT article_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(replace(title, '. ', ','), ','), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))), lambda x: x <> ''))), '|') AS keywords FROM articles",
}
