"""Queries on sources, portfolios, intake and publication, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import merging as M
from tidewell.operators import publishing as P
from tidewell.operators import scoring as S
from tidewell.operators import sourcing as G
from tidewell.operators import stories as D
from tidewell.plans import oracle as O
from tidewell.plans import queries as Q
from tidewell.sources import adapters as A
from tidewell.sources import intake as I
from tidewell.sources.adapters import AS_OF


def _proposal(spark, d):
    n = F.regexp_extract("source_id", r"(\d+)$", 1).cast("int")
    return G.portfolio(G.utility(Q._catalog(spark, d)), 14, 2).withColumn("enabled", n % 3 > 0)


def portfolio_decisions(spark, d):
    return G.decisions(_proposal(spark, d), automatic=False).select("source_id", "actual_selected", "proposed_selected", "role", F.array_join("reasons", "; ").alias("reasons"))


def portfolio_automatic(spark, d):
    """What an automatic portfolio does after one in which every other source was in; a feed needs three sources."""
    p = G.portfolio(G.utility(Q._catalog(spark, d), 3), 14, 2, 3).withColumn("enabled", F.lit(True))
    before = p.where(F.regexp_extract("source_id", r"(\d+)$", 1).cast("int") % 2 == 0).select("source_id")
    got = G.decisions(G.limited_changes(p, before, minimum=3), automatic=True, probes=2)
    return got.select("source_id", "actual_selected", "proposed_selected", "role", F.array_join("reasons", "; ").alias("reasons"))


def decided(spark, d):
    """Decisions of runs on sources, made up from what was parsed."""
    n = F.col("parsed")
    role = F.element_at(F.array(*map(F.lit, ["probe", "selected", "skipped", "explore"])), (n % 4 + 1).cast("int"))
    return A.observations(spark, d).select("run_id", "source_id", role.alias("role"), (n % 2 == 1).alias("actual_selected"), (n % 3 == 0).alias("proposed_selected"), (n % 5 < 3).alias("legacy_enabled"), (n % 7 == 0).alias("dismissed"), F.substring("run_id", 1, 4).cast("long").alias("created_epoch"), F.element_at(F.array(*map(F.lit, ["manual", "advisory", "automatic"])), (n % 3 + 1).cast("int")).alias("portfolio_mode"), n.cast("double").alias("score"), F.lit(0.5).alias("confidence"))


def _sources(spark, d):
    return A.table(spark, d, "nation").where("n_nationkey % 4 > 0").select(F.col("n_name").alias("source_id"), (F.col("n_nationkey") % 2 == 0).alias("enabled"))


def portfolio_history(spark, d):
    """The sources of the last portfolio that was used, of the runs of even months."""
    runs = A.observations(spark, d).select("run_id").distinct().withColumns({"status": F.when(F.substring("run_id", 6, 2).cast("int") % 4 == 1, "failed").otherwise("succeeded"), "finished_epoch": F.substring("run_id", 1, 4).cast("long")})
    last = G.last_portfolio(runs, decided(spark, d).where(F.substring("run_id", 6, 2).cast("int") % 2 == 0))
    return G.fetchable(last, _sources(spark, d)).select("source_id", "enabled", "role")


def portfolio_suggestions(spark, d):
    """What the latest run suggests, and the sources once it is accepted."""
    s = G.suggestions(decided(spark, d), _sources(spark, d))
    after = G.apply_suggestions(_sources(spark, d), s)
    return after.join(s.select("source_id", "action", "score"), "source_id", "left").select("source_id", "enabled", "action", "score")


def portfolio_modes(spark, d):
    return G.mode_of_runs(decided(spark, d)).groupBy("mode").agg(F.count("*").alias("n"))


def source_presets(spark, d):
    a = A.articles(spark, d).select(F.concat(F.lit("n"), (F.col("article_id") % 20).cast("string")).alias("name"), "category", F.when(F.col("article_id") % 3 > 0, F.col("article_id") % 2 == 0).alias("enabled"))
    return reduce(DataFrame.unionByName, [G.preset(a, p, ["n1", "n2"], ["n3"]).groupBy("mode").agg(F.count("*").alias("n")).withColumn("preset", F.lit(p)) for p in ("balanced", "essentials", "markets", "ai-software", "security-watch")])


def source_writes(spark, d):
    """Sources after forms, some of which are not valid or of a known URL; then those confirmed from discovery."""
    a, n = A.articles(spark, d), F.col("article_id")
    url = F.concat(F.lit("https://Host"), n.cast("string"), F.lit(".org/feed"))
    old = a.where("article_id % 4 = 0").select(F.lower(url).alias("feed_url"), F.lit("old").alias("name"), "category", F.lit(2).alias("priority"), F.lit("auto").alias("mode"), F.lit(True).alias("enabled"), F.lower(url).alias("normalized_url"), F.lit("h").alias("host"))
    forms = a.select(F.when(n % 9 == 0, " ").otherwise(F.concat(F.lit(" f"), n.cast("string"), F.lit(" "))).alias("name"), "category", F.when(n % 8 == 0, F.lower(url)).otherwise(F.concat(F.lit(" "), url, F.lit("#x"))).alias("url"), F.when(n % 7 == 0, 9).otherwise(3).alias("priority"), F.element_at(F.array(*map(F.lit, ["auto", "always_on", "blocked", "other"])), (n % 4 + 1).cast("int")).alias("mode"), (n % 2 == 0).alias("enabled"))
    now = G.upsert_sources(old, forms)
    found = a.select(F.concat(url, F.lit("#y")).alias("discovered_url"), F.when(n % 5 == 0, F.lit("https://z")).otherwise(url).alias("confirmed_url"), F.lit("new").alias("name"))
    all_ = G.confirm_discovered(now.select("feed_url", "enabled", "mode", "priority", "name"), found)
    return all_.join(now.select("feed_url", "host", "normalized_url"), "feed_url", "left")


def source_insights(spark, d):
    """Quality by identity: some observations name their source by id, others by URL."""
    o, n = A.observations(spark, d), F.regexp_extract("source_id", r"(\d+)$", 1).cast("int")
    o = o.withColumns({"reader_source_id": F.when(n % 3 > 0, n), "source_url": F.concat(F.lit("u"), (n % 6).cast("string")), "created_epoch": F.lit(AS_OF) - F.substring("run_id", 6, 2).cast("long") * 10 * 86400})
    values = spark.createDataFrame([("id:1", 30.0), ("url:u3", 99.0)], "source_key string, value double")
    return G.insights(o, values, AS_OF).select("source_id", "runs", "reliability", "fresh_yield", "reader_value", "label")


def source_story_counts(spark, d):
    """Stories and confirmed stories of each source, and observations that learn them."""
    n = F.regexp_extract("source_id", r"(\d+)$", 1).cast("int")
    v = A.story_sources(spark, d).select("story_id", F.when(n % 2 == 0, n).alias("reader_source_id"), F.when(n != 7, F.concat(F.lit("u"), (n % 5).cast("string"))).alias("source_url"))
    o = spark.range(22).select(F.when(F.col("id") % 2 == 0, F.col("id").cast("int")).alias("reader_source_id"), F.concat(F.lit("u"), (F.col("id") % 5).cast("string")).alias("source_url"), F.lit(0).cast("long").alias("stories"), F.lit(0).cast("long").alias("confirmed"), "id")
    return P.update_observations(o, P.source_story_counts(v)).select("id", "stories", "confirmed")


def source_attribution(spark, d):
    """Which source, named by uuid in an article's metadata, has which part in a story; merged with what was known."""
    a, n = A.articles(spark, d), F.col("article_id")
    who = F.when(n % 3 > 0, F.upper(Q.uuid_of(n % 5))).otherwise("none")
    articles = a.select("article_id", F.to_json(F.struct(who.alias("readerSourceId"))).alias("metadata"))
    links = a.select((n % 40).alias("story_id"), "article_id", (n % 8 == 0).alias("is_canonical"), F.when(n % 2 == 0, n).alias("first_run"), n.alias("last_run"), n.alias("first_seen"), (n + 5).alias("last_seen"))
    side = lambda c: P.attribution(links.where(c), articles)
    return P.merge_attribution(side("article_id < 90"), side("article_id >= 90"))


def source_catalog(spark, d):
    """Stored sources with defaults; where none is stored, the configured ones."""
    n = F.col("n_nationkey")
    stored = A.table(spark, d, "nation").select(n.cast("string").alias("id"), F.col("n_name").alias("name"), F.lit("c").alias("category"), F.lit("u").alias("url"), F.lit(2).alias("priority"), F.lit(True).alias("enabled"), F.lit("auto").alias("mode"), F.when(n % 3 == 0, "rss").otherwise("xml").alias("feed_type"), F.when(n % 2 == 0, "pl").otherwise("").alias("language"), F.when(n % 4 == 0, "valid").otherwise("odd").alias("status"))
    configured = A.table(spark, d, "region").select(F.col("r_regionkey").alias("ordinal"), F.col("r_name").alias("name"), F.lit("c").alias("category"), F.lit("u").alias("url"), F.when(F.col("r_regionkey") > 1, 4).alias("priority"), F.when(F.col("r_regionkey") == 2, False).alias("enabled"))
    both = G.catalog_rows(stored, configured).unionByName(G.catalog_rows(stored.where("false"), configured))
    return both.select("id", "name", "priority", "enabled", "mode", "feed_type", "language", "status")


def intake_status(spark, d):
    """Which sources could be fetched, and what became of their items; probed ones are left out."""
    n = F.col("article_id")
    p = A.articles(spark, d).select(F.concat(F.lit("s"), n.cast("string")).alias("source_id"), F.when(n % 7 == 0, 503).otherwise(200).alias("http_status"), F.when(n % 11 == 0, "timed out").alias("error"), F.when(n % 5 == 0, "nothing").otherwise(F.repeat(F.lit("<item><title>t</title></item>"), (n % 4).cast("int"))).alias("body"))
    got = I.fetched(p).select("source_id", "status", "error", "parsed")
    return I.without_probes(got, got.select("source_id", F.when(F.regexp_extract("source_id", r"(\d+)", 1).cast("int") % 10 == 3, "probe").otherwise("selected").alias("role")))


def intake_articles(spark, d):
    """Items with the same URLs, as articles; and how many of each source's are repeats."""
    n = F.col("article_id")
    i = A.articles(spark, d).select(F.concat(F.lit("s"), (n % 6).cast("string")).alias("source_id"), n.alias("ordinal"), F.when(n % 10 > 0, F.concat(F.lit("https://x/"), (n % 50).cast("string"))).alias("url"), F.when(n % 9 > 0, F.col("title")).otherwise("").alias("title"), "summary", F.when(n % 3 == 0, "kept").when(n % 3 == 1, "old").otherwise("undated").alias("age"))
    got = I.to_articles(i).groupBy("source_id").agg(F.count("*").alias("n_articles"), F.sum(F.length("summary")).alias("n_chars"))
    return I.intake_counts(i).join(I.duplicate_ratio(i).drop("n"), "source_id").join(got, "source_id", "left")


def feed_candidates(spark, d):
    n = F.col("page_id")
    page = F.when(n % 3 == 0, F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="/own.xml?a=1&amp;b=2"><link href="//cdn.org/x" type="application/atom+xml" rel="alternate">'), "html")).when(n % 3 == 1, F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="feed">'), "html")).otherwise(F.col("html"))
    p = A.table(spark, d, "pages").select("page_id", I.feed_candidates(page, F.lit("https://Example.org/a/b?c")).alias("c"))
    return p.select("page_id", F.array_join("c", " ").alias("candidates"))


def page_details(spark, d):
    """A page's description, its text, cut off, and labels."""
    n = F.col("page_id")
    head = F.concat(F.when(n % 2 == 0, '<meta name="description" content="about it">').otherwise(""), F.lit('<meta property="og:description" content="seen elsewhere">'), "html")
    text = X.plain_text(F.col("html"))
    return A.table(spark, d, "pages").select("page_id", X.meta_description(head).alias("description"), X.truncated(text, 40).alias("start"), F.md5(text).alias("text_md5"), X.priority_label(n % 100).alias("priority"), X.human_label(F.lit("build_opportunity")).alias("label"))


def readable_variants(spark, d):
    """Stories of five articles each, of which some are readable."""
    a, n = A.articles(spark, d), F.col("article_id")
    articles = a.select("article_id", F.when(n % 3 == 0, "readable").when(n % 3 == 1, "video_only").otherwise("unknown").alias("content_mode"), F.col("priority"), F.col("summary").alias("body"), F.concat(F.lit("t"), n.cast("string")).alias("title"), F.lit("s").alias("summary"), "source", F.lit("u").alias("url"))
    s = a.groupBy(F.expr("article_id div 5").alias("story_id")).agg(F.sort_array(F.collect_list("article_id")).alias("article_ids")).withColumns({c: F.lit("own") for c in ("title", "summary", "source", "url")})
    s = s.withColumn("article_ids", F.when(F.col("story_id") % 7 == 0, F.filter("article_ids", lambda x: x % 3 > 0)).otherwise(F.col("article_ids")))
    return P.readable_variants(s, articles).join(P.content_modes(s, articles), "story_id", "left").select("story_id", "title", "canonical_article", "has_readable", F.array_join("modes", ",").alias("modes"))


def publication_rows(spark, d):
    s, n = Q.stories(spark, d), F.col("article_id")
    selected = s.select(n.alias("story_id"), F.when(n % 9 == 0, "").otherwise(F.concat(F.lit("Story "), n.cast("string"))).alias("title"), F.lit("https://u").alias("url"), F.lit("a summary").alias("summary"), F.when(n % 4 > 0, F.col("category")).alias("category"), F.when(n % 5 > 0, F.col("source")).alias("source"), F.when(n % 3 == 0, "market_risk").alias("bucket"), (F.col("editorial") + n % 60).alias("editorial"), F.when(n % 2 == 0, n.cast("double")).otherwise(0.0).alias("selection"), "changes", F.when(n % 6 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>")).alias("variants"), "source_count")
    old = A.articles(spark, d).where("article_id % 3 = 0").select(n.alias("story_id"), n.alias("first_selected"), (n + 1).alias("last_change"))
    p = P.publication_rows(selected.withColumnRenamed("source_count", "duplicate_count"), old, AS_OF)
    return p.select("story_id", "external_id", "title", "category", "source", "importance", "selection_score", "source_count", F.array_join("topic_tags", ",").alias("topic_tags"), "first_selected", "last_selected", "last_change")


def explanations(spark, d):
    c = Q.candidates(spark, d)
    scored = Q.C.score_v2(c)
    said = S.explanation(F.when(F.col("story_id") % 2 == 0, F.array(F.lit("fresh"))).otherwise(F.array().cast("array<string>")), F.col("feed"), F.col("feed_adjustment"), X.clamp(F.col("preference"), -6, 6), F.col("final_score") + F.col("story_id") % 4 / 8)
    return scored.select("story_id", F.array_join(said, " | ").alias("said"))


def selection_reasons(spark, d):
    """Why a story is selected, what to do about it, and how much its article weighs."""
    j = Q.judged(spark, d)
    why = S.selection_reason(j, Q.IMPORTANT)
    return j.select("article_id", why.alias("why"), S.recommended_action(F.col("bucket")).alias("action"), S.article_importance(F.col("text"), F.length("summary"), Q.IMPORTANT).cast("long").alias("importance"))


def latest_brief(spark, d):
    n = F.col("article_id")
    i = A.articles(spark, d).select(n.alias("item_id"), F.date_format(F.timestamp_seconds("published_epoch"), "yyyy-MM-dd").alias("digest_date"), (n * 7 % 100).alias("place"), "source", F.concat(F.lit("t"), n.cast("string")).alias("title"), F.when(n % 2 == 0, " why ").alias("why"), F.when(n % 3 == 0, "because").alias("why_interesting"), F.lit("sum").alias("summary"))
    return P.fallback_brief(i).select("digest_date", "summary", F.array_join(F.transform("highlights", lambda h: F.concat_ws(":", h["item_id"].cast("string"), h["title"], h["why_it_matters"])), " ").alias("lines"))


def briefs_decoded(spark, d):
    n = F.col("doc_id")
    h = F.struct(F.when(n % 2 == 0, "i").alias("newsItemId"), F.lit("s").alias("source"), F.when(n % 3 == 0, "").otherwise("t").alias("title"), F.lit("w").alias("whyItMatters"))
    whole = F.struct(*(F.lit(x).alias(k) for k, x in (("newsItemId", "a"), ("source", "b"), ("title", "c"), ("whyItMatters", "d"))))
    b = A.table(spark, d, "documents").select("doc_id", F.when(n % 5 == 0, "oops").otherwise(F.to_json(F.array(h, whole))).alias("highlights"))
    return P.decode_highlights(b).select("doc_id", F.size("highlights").cast("long").alias("n"))


def canonical_flags(spark, d):
    """Each story's links, of which the canonical article of half the stories changes."""
    links = Q._members(spark, d).select("story_id", "article_id", (F.col("article_id") == F.col("story_id")).alias("is_canonical"))
    chosen = D.canonical_article(Q._members(spark, d)).where("story_id % 2 = 0").select("story_id", "article_id")
    return P.canonical_flags(links, chosen)


def story_history(spark, d):
    """Stories that take the key of a recent one of the last week."""
    n = F.col("article_id")
    s = A.articles(spark, d).select(n.alias("story_id"), F.concat(F.lit("k"), (n % 60).cast("string")).alias("story_key"), F.col("published_epoch").alias("last_seen_epoch"))
    history = D.recent_history(s.where("story_id % 3 = 0"), AS_OF)
    return D.match_history(s.where("story_id % 3 > 0"), history).select("story_id", "adopted_key")


def run_articles(spark, d):
    """The articles that a run saw last, how many there are, and the stories that name them."""
    n = F.col("article_id")
    a = A.articles(spark, d).select("article_id", F.struct(F.concat(F.lit("run"), (n % 5).cast("string")).alias("lastDigestRunId")).alias("metadata"))
    mine = a.where(F.col("metadata.lastDigestRunId") == "run2")
    links = A.articles(spark, d).select((n % 30).alias("story_id"), "article_id")
    named = links.join(mine, "article_id").groupBy("story_id").agg(F.count("*").alias("n"))
    return named.join(mine.agg(F.count("*").alias("n_of_run")))


def ingested_items(spark, d):
    """Items after payloads of which some are not valid, and so taken not at all."""
    n = F.col("article_id")
    old = A.articles(spark, d).where("article_id % 5 = 0").select(F.concat(F.lit("x"), n.cast("string")).alias("external_id"), F.lit("old").alias("title"), F.lit("2024-01-01").alias("digest_date"))
    p = A.articles(spark, d).select(F.expr("article_id div 4").alias("payload_id"), n.alias("ordinal"), F.concat(F.lit("x"), (n % 150).cast("string")).alias("external_id"), F.when(n % 31 == 0, "").otherwise(F.concat(F.lit("t"), n.cast("string"))).alias("title"), F.lit("s").alias("summary"), F.lit("src").alias("source"), F.when(n % 37 == 0, "no url").otherwise("https://x.y").alias("source_url"), F.lit("c").alias("category"), F.when(n % 41 == 0, "2024-1-1").otherwise("2024-01-02").alias("digest_date"), F.when(n % 43 == 0, 101).otherwise(7).cast("double").alias("importance"), F.when(n % 47 == 0, "yesterday").otherwise("2024-01-02T10:00:00Z").alias("published_at"))
    return P.ingest(old, p)


def newest_items(spark, d):
    """The 500 items last selected, those never selected at the end: what a page of the feed starts from."""
    n = F.col("article_id")
    i = A.articles(spark, d).select("article_id", F.when(n % 3 > 0, F.col("published_epoch")).alias("last_selected"), "published_epoch")
    return i.orderBy(F.col("last_selected").desc_nulls_last(), F.desc("published_epoch"), "article_id").limit(500)


def replaced_runs(spark, d):
    o = A.observations(spark, d).select("run_id", "source_id", "parsed")
    return M.replaced(o, o.where("parsed % 2 = 0 and run_id > '1994-06'").withColumn("parsed", F.col("parsed") + 100))


def backfilled(spark, d):
    """Orders that learn the segment of their customer, where there is one."""
    o = A.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.lit("none").alias("segment"))
    c = A.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return M.update_from(o, c, ["key"], ["segment"]).groupBy("segment").agg(F.count("*").alias("n"))


NUMBER = "CAST(regexp_extract(source_id, '([0-9]+)$', 1) AS INT)"
ROLES = O.ORACLE["portfolio_select"][5:].replace("SELECT source_id, mode, coalesce(r2", "roles AS (SELECT *, coalesce(r2").replace("(SELECT *, coalesce(r2, CASE WHEN mode = 'auto' AND nx", "(SELECT *, coalesce(r2, CASE WHEN mode = 'auto' AND nx")
ROLES = ROLES.replace(") roles AS", "), roles AS") + ")"
DECIDED = f"{O.OBSERVATIONS}, decided AS (SELECT run_id, source_id, ['probe', 'selected', 'skipped', 'explore'][parsed % 4 + 1] AS role, parsed % 2 = 1 AS actual, parsed % 3 = 0 AS proposed, parsed % 5 < 3 AS legacy, parsed % 7 = 0 AS dismissed, CAST(substr(run_id, 1, 4) AS BIGINT) AS created, CAST(substr(run_id, 6, 2) AS INT) AS month, ['manual', 'advisory', 'automatic'][parsed % 3 + 1] AS portfolio_mode, CAST(parsed AS DOUBLE) AS score FROM observations), src AS (SELECT n_name AS source_id, n_nationkey % 2 = 0 AS enabled FROM nation WHERE n_nationkey % 4 > 0)"
UUIDS = "substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-4' || substr(m, 14, 3) || '-8' || substr(m, 18, 3) || '-' || substr(m, 21, 12)"

QUERIES = {f.__name__: f for f in (portfolio_decisions, portfolio_automatic, portfolio_history, portfolio_suggestions, portfolio_modes, source_presets, source_writes, source_insights, source_story_counts, source_attribution, source_catalog, intake_status, intake_articles, feed_candidates, page_details, readable_variants, publication_rows, explanations, selection_reasons, latest_brief, briefs_decoded, canonical_flags, story_history, run_articles, ingested_items, newest_items, replaced_runs, backfilled)}
ORACLE = {
    "portfolio_decisions": f"WITH {ROLES}, t AS (SELECT *, role <> 'none' AS wanted, {NUMBER} % 3 > 0 AS on_now FROM roles), u AS (SELECT *, mode = 'always_on' OR (on_now AND mode <> 'blocked') AS actual FROM t), w AS (SELECT *, concat_ws('; ', CASE WHEN mode = 'always_on' THEN 'Always on' END, CASE WHEN mode = 'blocked' THEN 'Blocked by operator' END, CASE WHEN wanted AND category_need = 100 THEN 'Fills ' || feed || ' minimum' END, CASE WHEN role = 'explore' THEN 'Reserved exploration slot' END, CASE WHEN on_now <> wanted THEN 'Shadow proposal differs from legacy input' END) AS said FROM u) SELECT source_id, actual AS actual_selected, wanted AS proposed_selected, CASE WHEN actual THEN 'selected' ELSE 'skipped' END AS role, CASE WHEN said = '' THEN 'Ranked by marginal source utility' ELSE said END AS reasons FROM w",
    "portfolio_history": f"WITH {DECIDED}, r AS (SELECT DISTINCT run_id, created, month FROM decided), s AS (SELECT run_id, created, month FROM r WHERE month % 4 <> 1 ORDER BY created DESC, run_id DESC LIMIT 10), b AS (SELECT run_id FROM s WHERE month % 2 = 0 ORDER BY created DESC, run_id DESC LIMIT 1) SELECT d.source_id, enabled, role FROM decided d JOIN b ON b.run_id = d.run_id JOIN src ON src.source_id = d.source_id WHERE actual OR role = 'probe'",
    "portfolio_suggestions": f"WITH {DECIDED}, l AS (SELECT run_id FROM decided WHERE NOT dismissed ORDER BY created DESC, run_id DESC LIMIT 1), s AS (SELECT source_id, proposed, score FROM decided WHERE NOT dismissed AND run_id IN (SELECT run_id FROM l) AND proposed <> legacy) SELECT src.source_id, coalesce(proposed, enabled) AS enabled, CASE WHEN proposed THEN 'add' WHEN NOT proposed THEN 'remove' END AS action, score FROM src LEFT JOIN s ON s.source_id = src.source_id",
    "portfolio_modes": f"WITH {DECIDED}, m AS (SELECT run_id, last(portfolio_mode ORDER BY created, source_id) AS mode FROM decided GROUP BY 1) SELECT mode, count(*) AS n FROM m GROUP BY 1",
    "source_presets": f"""WITH {O.ARTICLES}, a AS (SELECT article_id % 20 AS n, feed, category, CASE WHEN article_id % 3 > 0 THEN article_id % 2 = 0 ELSE true END AS enabled FROM articles),
p AS (SELECT 'balanced' AS preset, enabled AS e FROM a UNION ALL SELECT 'essentials', n IN (1, 2) FROM a UNION ALL SELECT 'markets', feed IN ('geopolitics', 'business') OR n = 3 FROM a UNION ALL SELECT 'ai-software', feed IN ('ai', 'software') OR n = 3 FROM a UNION ALL SELECT 'security-watch', feed = 'security' OR contains(lower(category), 'status') FROM a)
SELECT CASE WHEN e THEN 'always_on' ELSE 'blocked' END AS mode, count(*) AS n, preset FROM p GROUP BY ALL""",
    "source_writes": f"""WITH {O.ARTICLES}, f AS (SELECT article_id AS n, CASE WHEN article_id % 8 = 0 THEN lower('https://Host' || article_id || '.org/feed') ELSE 'https://Host' || article_id || '.org/feed#x' END AS url, ['auto', 'always_on', 'blocked', 'other'][article_id % 4 + 1] AS mode FROM articles WHERE article_id % 9 > 0 AND article_id % 7 > 0 AND article_id % 4 < 3),
now AS (SELECT url AS feed_url, 'f' || n AS name, 3 AS priority, mode, CASE mode WHEN 'always_on' THEN true WHEN 'blocked' THEN false ELSE n % 2 = 0 END AS enabled, regexp_replace(url, '#.*$', '') AS normalized_url, 'host' || n || '.org' AS host FROM f
  UNION ALL SELECT 'https://host' || article_id || '.org/feed', 'old', 2, 'auto', true, 'https://host' || article_id || '.org/feed', 'h' FROM articles WHERE article_id % 4 = 0 AND 'https://host' || article_id || '.org/feed' NOT IN (SELECT url FROM f)),
new AS (SELECT 'https://host' || article_id || '.org/feed' AS feed_url FROM articles WHERE article_id % 5 > 0 AND 'https://host' || article_id || '.org/feed' NOT IN (SELECT lower(normalized_url) FROM now))
SELECT feed_url, name, priority, mode, enabled, normalized_url, host FROM now UNION ALL SELECT feed_url, 'new', 3, 'auto', false, NULL, NULL FROM new""",
    "source_insights": f"WITH {O.OBSERVATIONS.replace('observations AS', 'seen AS', 1)}, observations AS (SELECT * REPLACE (CASE WHEN {NUMBER} % 3 > 0 THEN 'id:' || {NUMBER} ELSE 'url:u' || ({NUMBER} % 6) END AS source_id) FROM seen WHERE CAST(substr(run_id, 6, 2) AS INT) * 10 <= 90), {O.QUALITY[len(O.OBSERVATIONS) + 2:].replace('sum(selected) * 0.1 AS value', 'CASE source_id WHEN chr(105) || chr(100) || chr(58) || chr(49) THEN 30.0 WHEN chr(117) || chr(114) || chr(108) || chr(58) || chr(117) || chr(51) THEN 99.0 ELSE 0.0 END AS value')} SELECT source_id, runs, reliability, fresh_yield, reader_value, label FROM quality",
    "source_story_counts": f"WITH {O.INTERACTIONS}, v AS (SELECT DISTINCT story_id, story_id % 20 AS n FROM interactions UNION ALL SELECT DISTINCT story_id, story_id * 7 % 20 FROM interactions WHERE story_id % 20 <> story_id * 7 % 20), k AS (SELECT story_id, n, CASE WHEN n % 2 = 0 THEN 'id:' || n ELSE 'url:u' || (n % 5) END AS key, count(*) OVER (PARTITION BY story_id) AS c FROM v), s AS (SELECT key, count(DISTINCT story_id) AS stories, count(DISTINCT story_id) FILTER (c >= 2) AS confirmed FROM k WHERE n <> 7 GROUP BY key) SELECT id, coalesce(stories, 0) AS stories, coalesce(confirmed, 0) AS confirmed FROM range(22) r(id) LEFT JOIN s ON s.key = CASE WHEN id % 2 = 0 THEN 'id:' || id ELSE 'url:u' || (id % 5) END",
    "source_attribution": f"""WITH m AS (SELECT doc_id AS n, md5(CAST(doc_id % 5 AS VARCHAR)) AS m FROM documents WHERE doc_id % 3 > 0), l AS (SELECT n, n % 40 AS story_id, {UUIDS} AS who, n < 90 AS old FROM m),
a AS (SELECT story_id, who, old, bool_or(n % 8 = 0) AS c, min(n) FILTER (n % 2 = 0) AS fr, max(n) AS lr, min(n) AS fs, max(n + 5) AS ls FROM l GROUP BY ALL)
SELECT coalesce(o.story_id, w.story_id) AS story_id, coalesce(o.who, w.who) AS reader_source_id, CASE WHEN coalesce(w.c, o.c) THEN 'canonical' ELSE 'confirmation' END AS contribution, coalesce(o.fr, w.fr) AS first_run, coalesce(w.lr, o.lr) AS last_run, coalesce(o.fs, w.fs) AS first_seen, coalesce(w.ls, o.ls) AS last_seen FROM (SELECT * FROM a WHERE old) o FULL JOIN (SELECT * FROM a WHERE NOT old) w ON w.story_id = o.story_id AND w.who = o.who""",
    "source_catalog": "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 2 AS priority, true AS enabled, 'auto' AS mode, CASE WHEN n_nationkey % 3 = 0 THEN 'rss' ELSE 'unknown' END AS feed_type, CASE WHEN n_nationkey % 2 = 0 THEN 'pl' ELSE 'unknown' END AS language, CASE WHEN n_nationkey % 4 = 0 THEN 'valid' ELSE 'unverified' END AS status FROM nation UNION ALL SELECT 'fallback-' || r_regionkey, r_name, CASE WHEN r_regionkey > 1 THEN 4 ELSE 3 END, r_regionkey <> 2, CASE WHEN r_regionkey = 2 THEN 'blocked' ELSE 'always_on' END, 'unknown', 'unknown', 'unverified' FROM region",
    "intake_status": "WITH p AS (SELECT doc_id AS n, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id % 4 END AS c FROM documents WHERE doc_id % 10 <> 3) SELECT 's' || n AS source_id, CASE WHEN n % 11 = 0 OR n % 7 = 0 OR c = 0 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN n % 11 = 0 THEN 'timeout' WHEN n % 7 = 0 THEN 'http_503' WHEN c = 0 THEN 'network_or_parse_error' END AS error, CASE WHEN n % 11 = 0 OR n % 7 = 0 THEN 0 ELSE c END AS parsed FROM p",
    "intake_articles": f"""WITH {O.ARTICLES}, i AS (SELECT article_id AS n, 's' || (article_id % 6) AS source_id, CASE WHEN article_id % 10 > 0 THEN 'https://x/' || (article_id % 50) END AS url, CASE WHEN article_id % 9 > 0 THEN title ELSE '' END AS title, length(summary) AS c FROM articles),
b AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY c DESC, source_id, n) AS k FROM i WHERE url IS NOT NULL AND title <> ''), g AS (SELECT source_id, count(*) AS n_articles, CAST(sum(c) AS BIGINT) AS n_chars FROM b WHERE k = 1 GROUP BY 1),
s AS (SELECT source_id, count(*) AS parsed, count(*) FILTER (n % 3 = 0) AS kept, count(*) FILTER (n % 3 = 1) AS old, count(*) FILTER (n % 3 = 2) AS undated, round((count(*) - count(DISTINCT url)) / count(*)::DOUBLE, 6) AS duplicate_ratio FROM i GROUP BY 1) SELECT s.*, n_articles, n_chars FROM s LEFT JOIN g ON g.source_id = s.source_id""",
    "feed_candidates": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://Example.org/own.xml?a=1&b=2 https://cdn.org/x ' WHEN 1 THEN 'https://Example.org/a/feed ' ELSE '' END || 'https://Example.org/feed https://Example.org/feed.xml https://Example.org/rss https://Example.org/rss.xml https://Example.org/atom.xml' AS candidates FROM pages",
    "page_details": f"WITH {O.plain('pl', 'pages', 'html', 'page_id')} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'about it' ELSE 'seen elsewhere' END AS description, CASE WHEN length(plain) > 40 THEN substr(plain, 1, 39) || '…' ELSE plain END AS start, md5(plain) AS text_md5, CASE WHEN page_id % 100 >= 85 THEN 'Critical' WHEN page_id % 100 >= 70 THEN 'High' WHEN page_id % 100 >= 55 THEN 'Useful' ELSE 'Background' END AS priority, 'build opportunity' AS label FROM pl",
    "readable_variants": f"""WITH {O.ARTICLES}, s AS (SELECT article_id // 5 AS story_id, article_id AS n, priority, length(summary) AS c FROM articles WHERE NOT (article_id // 5 % 7 = 0 AND article_id % 3 = 0)), b AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY priority DESC, c DESC, n) AS k FROM s WHERE n % 3 = 0),
m AS (SELECT story_id, string_agg(DISTINCT CASE n % 3 WHEN 0 THEN 'readable' WHEN 1 THEN 'video_only' ELSE 'unknown' END, ',' ORDER BY CASE n % 3 WHEN 0 THEN 'readable' WHEN 1 THEN 'video_only' ELSE 'unknown' END) AS modes FROM s GROUP BY 1), e AS (SELECT DISTINCT article_id // 5 AS story_id FROM articles)
SELECT e.story_id, coalesce('t' || b.n, 'own') AS title, b.n AS canonical_article, b.n IS NOT NULL AS has_readable, modes FROM e LEFT JOIN b ON b.story_id = e.story_id AND b.k = 1 LEFT JOIN m ON m.story_id = e.story_id""",
    "publication_rows": f"""WITH {O.STORIES}, p AS (SELECT article_id AS n, CASE WHEN article_id % 9 = 0 THEN 'https://u' ELSE 'Story ' || article_id END AS title, CASE WHEN article_id % 4 > 0 THEN category ELSE 'general' END AS category, CASE WHEN article_id % 5 > 0 THEN source ELSE 'Unknown' END AS source, editorial + article_id % 60 AS e, CASE WHEN article_id % 3 = 0 THEN 'market_risk' ELSE 'ignore' END AS bucket, source_count AS sc FROM stories)
SELECT n AS story_id, 'story:' || n AS external_id, title, category, source, CAST(greatest(0, least(100, e)) AS BIGINT) AS importance, CASE WHEN n % 2 = 0 AND n > 0 THEN CAST(n AS DOUBLE) ELSE CAST(e AS DOUBLE) END AS selection_score, CAST(CASE WHEN n % 6 = 0 THEN 2 ELSE greatest(1, sc) END AS BIGINT) AS source_count, lower(category) || ',' || bucket || CASE WHEN n % 9 = 0 THEN ',https' ELSE ',story' || CASE WHEN n >= 10000 THEN ',' || n ELSE '' END END AS topic_tags,
  CASE WHEN n % 3 = 0 THEN n ELSE 1706659200 END AS first_selected, 1706659200 AS last_selected, CASE WHEN n % 3 < 2 THEN 1706659200 END AS last_change FROM p""",
    "explanations": f"WITH {O.JUDGED}, c AS (SELECT article_id AS n, feed, feed_adjustment AS f, greatest(-6, least(6, preference)) AS p, CAST(editorial + feed_adjustment + greatest(-6, least(6, preference)) AS DOUBLE) + article_id % 4 / 8.0::DOUBLE AS s FROM reasoned WHERE len(reasons) = 0) SELECT n AS story_id, concat_ws(' | ', CASE WHEN n % 2 = 0 THEN 'fresh' END, CASE WHEN f <> 0 THEN 'Objective ' || feed || ' relevance ' || CASE WHEN f > 0 THEN '+' ELSE '' END || f END, CASE WHEN p <> 0 THEN 'Preference signal ' || CASE WHEN p > 0 THEN '+' ELSE '' END || p END, 'Final score ' || regexp_replace(CAST(CAST(s AS DECIMAL(30, 3)) AS VARCHAR), '\\.?0+$', '')) AS said FROM c",
    "selection_reasons": f"""WITH {O.JUDGED}, b AS (SELECT *, CASE WHEN {O.hits(['edor', 'nicht'], 's')} > 0 THEN 'security_risk' WHEN {O.hits(['with', 'pour'], 's')} > 0 THEN 'market_risk' WHEN {O.hits(['this', 'und'], 's')} > 0 THEN 'build_opportunity' WHEN {O.hits(['that', 'que'], 's')} > 0 THEN 'product_trend' WHEN {O.hits(O.SCOPE, 's')} > 0 THEN 'product_trend' ELSE 'ignore' END AS bucket,
  list_filter([{", ".join(f"CASE WHEN contains(s, ' {w} ') THEN '{w}' END" for w in O.IMPORTANT)}], lambda x: x IS NOT NULL)[1:5] AS found,
  list_transform(list_sort(list_filter([{", ".join(f"{{'m': -{c}, 'i': {i}, 't': '{t} ' || {c} || '/10'}}" for i, (c, t) in enumerate((("scope", "scope fit"), ("action", "actionability"), ("impact", "impact"), ("urgency", "urgency"), ("confirmation", "confirmation"))))}], lambda x: x.m <= -7))[1:3], lambda x: x.t) AS strong FROM reasoned),
r AS (SELECT *, concat_ws('; ', CASE WHEN len(found) > 0 THEN 'matched ' || array_to_string(found, ', ') END, CASE WHEN len(strong) > 0 THEN 'scored high on ' || array_to_string(strong, ', ') END, CASE WHEN feed_adjustment > 0 THEN 'fits the ' || feed || ' feed target' END, CASE WHEN preference > 0 THEN 'matches previous positive feedback' END, CASE WHEN is_major THEN 'major security signal' WHEN is_developer THEN 'developer-relevant security signal' END, CASE WHEN is_relevant THEN 'geopolitics with business, chips, energy, or security impact' END) AS said FROM b)
SELECT article_id, 'Selected as ' || replace(bucket, '_', ' ') || CASE WHEN said = '' THEN '' ELSE ': ' || said END || '.' AS why, CASE bucket WHEN 'security_risk' THEN 'Review exposure, patches, dependencies, and vendor advisories.' WHEN 'market_risk' THEN 'Watch second-order effects on tech valuations, budgets, and customer spend.' WHEN 'build_opportunity' THEN 'Check whether this creates a product, automation, or integration opportunity.' WHEN 'product_trend' THEN 'Track adoption and compare against current AI/product roadmap assumptions.' ELSE 'No action recommended unless the story becomes more directly relevant.' END AS action,
  CAST(least(10, greatest(1, 2 + {O.hits(O.IMPORTANT, 's')} + CASE WHEN length(summary) > 900 THEN 2 ELSE 0 END)) AS BIGINT) AS importance FROM r""",
    "latest_brief": f"WITH {O.ARTICLES}, i AS (SELECT article_id AS n, strftime(make_timestamp(published_epoch * 1000000), '%Y-%m-%d') AS day, article_id * 7 % 100 AS place FROM articles), l AS (SELECT * FROM i WHERE day = (SELECT max(day) FROM i)), f AS (SELECT * FROM l ORDER BY place, n LIMIT 5) SELECT (SELECT max(day) FROM i) AS digest_date, 'Najnowszy digest obejmuje ' || CASE WHEN (SELECT count(*) FROM l) = 1 THEN 'jedną wiadomość' ELSE (SELECT count(*) FROM l) || ' wiadomości' END || '. Poniżej znajdziesz najważniejsze informacje z tego zestawu.' AS summary, string_agg(n || ':t' || n || ':' || CASE WHEN n % 2 = 0 THEN 'why' WHEN n % 3 = 0 THEN 'because' ELSE 'sum' END, ' ' ORDER BY place, n) AS lines FROM f",
    "briefs_decoded": "SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 2 = 0 AND doc_id % 3 > 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM documents",
    "canonical_flags": f"WITH {O.MEMBERS}, c AS (SELECT story_id, article_id FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY priority DESC, length(summary) DESC, article_id) AS n FROM members) WHERE n = 1 AND story_id % 2 = 0) SELECT m.story_id, m.article_id, CASE WHEN c.story_id IS NULL THEN m.article_id = m.story_id ELSE m.article_id = c.article_id END AS is_canonical FROM members m LEFT JOIN c ON c.story_id = m.story_id",
    "story_history": f"WITH {O.ARTICLES}, h AS (SELECT DISTINCT article_id % 60 AS k FROM (SELECT * FROM articles WHERE article_id % 3 = 0 AND published_epoch >= 1706659200 - 604800 ORDER BY published_epoch DESC, article_id LIMIT 2000)), s AS (SELECT article_id, article_id % 60 AS k, row_number() OVER (PARTITION BY article_id % 60 ORDER BY article_id) AS n FROM articles WHERE article_id % 3 > 0) SELECT article_id AS story_id, CASE WHEN n = 1 AND h.k IS NOT NULL THEN 'k' || s.k END AS adopted_key FROM s LEFT JOIN h ON h.k = s.k",
    "run_articles": "SELECT doc_id % 30 AS story_id, count(*) AS n, (SELECT count(*) FROM documents WHERE doc_id % 5 = 2) AS n_of_run FROM documents WHERE doc_id % 5 = 2 GROUP BY 1",
    "ingested_items": """WITH p AS (SELECT doc_id AS n, doc_id // 4 AS payload, 'x' || (doc_id % 150) AS id, doc_id % 31 = 0 OR doc_id % 37 = 0 OR doc_id % 41 = 0 OR doc_id % 43 = 0 OR doc_id % 47 = 0 AS bad FROM documents), g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY payload DESC, n DESC) AS k FROM p WHERE payload NOT IN (SELECT payload FROM p WHERE bad)) WHERE k = 1)
SELECT id AS external_id, 't' || n AS title, '2024-01-02' AS digest_date FROM g UNION ALL SELECT 'x' || doc_id, 'old', '2024-01-01' FROM documents WHERE doc_id % 5 = 0 AND 'x' || doc_id NOT IN (SELECT id FROM g)""",
    "newest_items": f"WITH {O.ARTICLES} SELECT article_id, CASE WHEN article_id % 3 > 0 THEN published_epoch END AS last_selected, published_epoch FROM articles ORDER BY last_selected DESC NULLS LAST, published_epoch DESC, article_id LIMIT 500",
    "replaced_runs": f"WITH {O.OBSERVATIONS}, n AS (SELECT run_id, source_id, parsed + 100 AS parsed FROM observations WHERE parsed % 2 = 0 AND run_id > '1994-06') SELECT run_id, source_id, parsed FROM observations WHERE run_id NOT IN (SELECT run_id FROM n) UNION ALL SELECT * FROM n",
    "backfilled": "SELECT coalesce(c_mktsegment, 'none') AS segment, count(*) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o_custkey GROUP BY 1",
}
