"""Queries of JSON by VARIANT, policies as SQL, addresses, kept rankings, keyword groups and upkeep, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import address as I
from tidewell.functions import variant as J
from tidewell.functions.values import KEYWORD_GROUPS
from tidewell.operators import lifecycle as L
from tidewell.operators import notes as N
from tidewell.operators import policies
from tidewell.operators import preferences as R2
from tidewell.operators import reading as R
from tidewell.operators import snapshots as S
from tidewell.operators import sourcing as P
from tidewell.operators.graph import shared_folder
from tidewell.plans import oracle as O
from tidewell.plans import publication as U
from tidewell.plans import queries as Q
from tidewell.sources import adapters as A
from tidewell.sources import payloads as K
from tidewell.sources.intake import fetched

#: Documents as stored metadata and as what a later stage adds; some of the latter is broken or no object.
OLDER = "'{\"id\":' || n || ',\"kind\":\"old\",\"deep\":{\"a\":[' || (n % 3) || ',\"x\"]},\"chars\":' || coalesce(n_chars, 0) || '}'"
NEWER = "CASE n % 5 WHEN 0 THEN '{\"kind\":' WHEN 1 THEN '[' || n || ']' WHEN 2 THEN '{}' ELSE '{\"kind\":\"new\",\"deep\":{\"b\":' || n || '},\"score\":' || (n % 100) || '.5}' END"
TYPED = """CASE n % 6 WHEN 0 THEN '{"title":"  t' || n || ' ","rank":' || n || ',"tags":["a",1,"b",null]}' WHEN 1 THEN '{"title":' || n || ',"rank":"' || n || '","tags":"a"}' WHEN 2 THEN '{"title":null,"rank":1e2,"tags":[]}'
  WHEN 3 THEN '{"rank":true,"tags":[["a"],{"a":1},"c"]}' WHEN 4 THEN '["title"]' ELSE '{"title":"t' END"""
ANSWER = """CASE n % 9 WHEN 0 THEN 'Sure: {}' WHEN 1 THEN '[{"summary":"s"}]' WHEN 2 THEN '{"summary":"  ","highlights":[{"articleIndex":0,"whyItMatters":"w"}]}' WHEN 3 THEN '{"summary":"s"}'
  WHEN 4 THEN '{"summary":"s","highlights":[{"articleIndex":7,"whyItMatters":"w"},{"articleIndex":-1,"whyItMatters":"w"},{"articleIndex":0.5,"whyItMatters":"w"},{"articleIndex":"0","whyItMatters":"w"},7]}'
  WHEN 5 THEN ' {"summary":"<b>s' || n || '</b>","highlights":[{"articleIndex":2,"whyItMatters":" "},{"articleIndex":2,"whyItMatters":"first"},{"articleIndex":2,"whyItMatters":"again"},{"articleIndex":1.0,"whyItMatters":"w' || n || '"}]} '
  ELSE '{"summary":"s' || n || '","highlights":[{"articleIndex":6,"whyItMatters":"g"},{"articleIndex":5,"whyItMatters":"f"},{"articleIndex":4,"whyItMatters":"e"},{"articleIndex":3,"whyItMatters":"d"},{"articleIndex":2,"whyItMatters":"c"},{"articleIndex":1,"whyItMatters":"b"}]}' END"""
GROUPS = "substr(h, 9, 4) || ':' || substr(h, 13, 4) || ':' || substr(h, 17, 4) || ':' || substr(h, 21, 4) || ':' || substr(h, 25, 4) || ':' || substr(h, 29, 4)"
HEADS = ("2606", "2001", "fe80", "fc12", "ff02", "2002", "64", "0", "3fff")
HEAD = "CASE n % 9 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADS)) + " END"
SECOND = "CASE n % 5 WHEN 0 THEN 'db8' WHEN 1 THEN '0' ELSE substr(h, 5, 4) END"
DOTTED = "(n % 256) || '.' || (n % 7 * 40) || '.' || (n % 251) || '.' || (n % 299)"
ADDRESS = f"""CASE n % 7 WHEN 0 THEN {HEAD} || ':' || {SECOND} || ':' || {GROUPS} WHEN 1 THEN upper({HEAD}) || '::' || substr(h, 29, 4) WHEN 2 THEN '::ffff:' || {DOTTED}
  WHEN 3 THEN {DOTTED} WHEN 4 THEN {HEAD} || '::1%eth' || (n % 3) WHEN 5 THEN CASE n % 4 WHEN 0 THEN '1:2:3' WHEN 1 THEN 'g::1' WHEN 2 THEN '1::2::3' ELSE '1:2:3:4:5:6:7:8:9' END ELSE '::' END"""
#: The first reader whose address is listed and who has orders.
READER = 4


def _numbered(spark, d, of: str):
    return A.table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("n"), "n_chars").select("doc_id", F.expr(of).alias("content"), F.expr(OLDER).alias("older"))


def json_merged(spark, d):
    """Members of stored metadata after what is new has been laid over them."""
    rows = _numbered(spark, d, NEWER).select("doc_id", F.explode(J.merged(J.json_object(F.col("older")), J.json_object(F.col("content")))).alias("key", "value"))
    return rows.select("doc_id", "key", F.to_json("value").alias("value"))


def json_typed(spark, d):
    rows = _numbered(spark, d, TYPED).withColumn("o", J.json_object(F.col("content")))
    return rows.select("doc_id", J.json_string(F.col("o"), "title").alias("title"), J.json_number(F.col("o"), "rank").alias("rank"), F.array_join(J.json_strings(F.col("o"), "tags"), ",").alias("tags"))


def briefs_checked(spark, d):
    """Answers that stand as a brief of seven articles."""
    rows = _numbered(spark, d, ANSWER).select("doc_id", J.brief(F.col("content"), F.lit(7)).alias("b")).where("b is not null")
    lines = F.transform("b.highlights", lambda x: F.concat(x["articleIndex"].cast("string"), F.lit(":"), x["whyItMatters"]))
    return rows.select("doc_id", "b.summary", F.array_join(lines, "|").alias("lines"))


def address_safety(spark, d):
    """Addresses of both kinds, in all their forms, and whether a fetch may reach them."""
    e = A.table(spark, d, "events").select("event_id", F.col("event_id").alias("n"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("h")).select("event_id", F.expr(ADDRESS).alias("a"))
    return e.select("event_id", I.ipv6_digits(F.when(F.col("a").contains(":"), F.col("a"))).alias("digits"), I.blocked_address(F.col("a")).alias("blocked"))


def reader_policy(spark, d):
    """What one reader sees of two views: orders are a reader's own, nations are for all who are listed."""
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit("@Example.org")).alias("email"))
    policies.allow_readers(spark, c.where("user_id % 2 = 0").select(F.lower("email").alias("email")), c)
    policies.set_reader(spark, f"c{READER}@EXAMPLE.org")
    policies.protect(spark, A.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id")), "my_orders", "user_id")
    policies.protect(spark, A.table(spark, d, "nation").select("n_nationkey"), "open_nations")
    return spark.sql("SELECT 'order' AS kind, o_orderkey AS id FROM my_orders UNION ALL SELECT 'nation', n_nationkey FROM open_nations")


#: What readers have set: of each third word of a list one, in odd spelling.
WORDS = ("gossip", "NBA ", "token", "leak", "gpu", "fed", " CVE", "api", "nato", "none of them", "ai", "model x")


def keyword_groups(spark, d):
    """The groups that readers' keywords turn on, and the keywords of groups that they have turned on."""
    c = A.table(spark, d, "customer")
    n = F.col("c_custkey")
    words = F.array(*(F.get(F.array(*map(F.lit, WORDS)), (n * k % len(WORDS)).cast("int")) for k in (1, 5, 7)))
    groups = F.array(F.get(F.array(*map(F.lit, GROUPS)), (n % len(GROUPS)).cast("int")), F.lit("ai-infra"))
    cols = {"avoid": R2.active_groups("avoid", words), "prefer": R2.active_groups("prefer", words), "set": R2.keywords_of("prefer", groups)}
    return c.select("c_custkey", *(F.array_join(x, "|").alias(k) for k, x in cols.items()))


GROUPS = ("geopolitics", "engineering", "no group", "ai-infra")


def retained_events(spark, d):
    """How many events of each kind are left of 180 days, some time later."""
    e = A.interactions(spark, d).withColumn("epoch", F.when(F.col("event_id") % 50 > 0, F.col("epoch")))
    return L.kept_events(e, A.AS_OF + 170 * 86400).groupBy("event_type").agg(F.count("*").alias("n"))


def purged_items(spark, d):
    """What orders leave in the scratch table of their runs once those of status F are finished."""
    runs = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderstatus")
    items = A.table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") < 7, F.col("l_orderkey")).alias("run_id"), "l_linenumber")
    return L.purged(items, runs.where("o_orderstatus = 'F'")).groupBy("l_linenumber").agg(F.count("*").alias("n"))


def portfolio_frozen(spark, d):
    """The decisions of a run that has some, and of one that gets those of the newest run of its month."""
    decided = U.decided(spark, d).select("run_id", "source_id", "role")
    newest = decided.where(F.substring("run_id", 6, 2) == "03")
    newest = newest.join(newest.agg(F.max("run_id").alias("run_id")), "run_id")
    first = decided.agg(F.min("run_id")).first()[0]
    return P.frozen_portfolio(decided, first, lambda: newest).unionByName(P.frozen_portfolio(decided, "none", lambda: newest))


CATALOG = """CASE n % 7 WHEN 0 THEN '[{"name":"s' || n || '","category":"c","url":"https://x.org/' || n || '"},{"name":"t","category":"d","url":"http://y.org","enabled":false,"priority":' || (n % 8) || '}]'
  WHEN 1 THEN '[{"name":"","category":"c","url":"x.org"},7,{"name":"n","category":null,"url":"https://"}]' WHEN 2 THEN '{"name":"s"}' WHEN 3 THEN '[]' WHEN 4 THEN '[{"name":"n","category":"c","url":"https://x.org","priority":2.5,"enabled":"yes"}]'
  WHEN 5 THEN '[{"name":' ELSE '[{"name":"n","category":"c","url":"https://x.org/a?b#c","priority":5.0,"enabled":true,"more":[1]}]' END"""


def catalogs_checked(spark, d):
    """Entries of catalogs, and what is wrong with each."""
    rows = _numbered(spark, d, CATALOG).select("doc_id", F.posexplode(K.catalog_entries(F.col("content"))).alias("ordinal", "e"))
    return rows.select("doc_id", "ordinal", "e.name", "e.url", "e.enabled", "e.priority", F.array_join("e.problems", ",").alias("problems"))


def payload_status(spark, d):
    """What became of payloads that lie in folders of their sources: items, and payloads without one."""
    path = shared_folder(spark, "payloads")
    a = A.articles(spark, d).select(F.coalesce("source", F.lit("none")).alias("source_id"), F.when(F.col("article_id") % 9 == 0, "nothing").otherwise(F.repeat(F.lit("<item><title>t</title></item>"), (F.col("article_id") % 4 + 1).cast("int"))).alias("value"))
    a.write.partitionBy("source_id").text(path)
    p = K.payloads(spark, path).select("source_id", F.lit(200).alias("http_status"), "error", "body")
    return fetched(p).groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.sum("parsed").alias("parsed"))


def run_constraint_violations(spark, d):
    """The constraints of the tables of runs, stories, settings, feedback and decisions, on rows of which some break them."""
    n = F.col("n")
    of = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (n % len(xs) + 1).cast("int"))
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("n"))
    tables = {
        "stage_runs": {"status": of("queued", "running", "succeeded", "failed", "skipped", "lost"), "attempt_count": n % 9 - 1},
        "digest_runs": {"trigger_type": of("manual", "scheduled", "cron"), "status": of("queued", "running", "succeeded", "failed", "cancelled", "done", None)},
        "stories": {"latest_duplicate_count": n % 5, "confirmation_count": n % 4},
        "settings": {"publish_top_n": n % 120, "summary_max_chars": n % 6000, "minimum_importance_score": n % 110, "source_budget": n % 220, "source_probe_count": n % 13},
        "feedback": {"sentiment": of("more", "less", "same")},
        "source_decisions": {"policy_version": F.repeat(F.lit("v"), (n % 120).cast("int")), "confidence": (n % 15) / 10, "role": of("selected", "explore", "probe", "skipped", "other"), "actual_selected": n % 2 == 0},
    }
    found = [N.broken(rows.select(*(c.alias(k) for k, c in cols.items())), t).select(F.concat(F.lit(f"{t}."), F.col("constraint")).alias("constraint"), "n") for t, cols in tables.items()]
    return reduce(DataFrame.unionByName, found)


def feed_page_kept(spark, d):
    """The same page as feed_page, out of a ranking that was kept, by its cursor alone."""
    path, context = shared_folder(spark, "rankings"), "0b5f1c1e-7a51-4f0e-9d0c-3f1f5a6b7c8d"
    ranked = R.ranked(Q.plain_items(spark, d), "for-you", "v2").withColumn("position", F.col("model_rank"))
    S.keep_ranking(ranked.select("item_id", "position"), path, context)
    return S.page(spark, path, context, "42", 30).select("item_id", "position")


QUERIES = {f.__name__: f for f in (run_constraint_violations, catalogs_checked, payload_status, keyword_groups, retained_events, purged_items, portfolio_frozen, feed_page_kept, json_merged, json_typed, briefs_checked, address_safety, reader_policy)}
_DOCS = "n AS (SELECT doc_id, doc_id AS n, n_chars FROM documents)"
_FIRST = f"lpad({HEAD}, 4, '0')"
_OPEN = f"({_FIRST} BETWEEN '2000' AND '3fff' AND {_FIRST} <> '2002')"
_OPEN4 = """NOT (a = 0 OR a = 10 OR a = 127 OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100))) OR (a = 203 AND b = 0 AND c = 113))"""
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_HELD = f"list_transform([1, 5, 7], lambda k: lower(trim({_LIST(WORDS)}[c_custkey * k % {len(WORDS)} + 1])))"
_ACTIVE = lambda kind: "concat_ws('|', " + ", ".join(f"CASE WHEN list_has_any(held, {_LIST(words)}) THEN '{g}' END" for g, words in KEYWORD_GROUPS[kind].items()) + ")"
_ON = f"[{_LIST(GROUPS)}[c_custkey % {len(GROUPS)} + 1], 'ai-infra']"
_SET = "concat_ws('|', " + ", ".join(f"CASE WHEN list_contains(groups, '{g}') THEN '{'|'.join(words)}' END" for g, words in KEYWORD_GROUPS["prefer"].items()) + ")"
_BROKEN = {
    "stage_runs.status": "n % 6 = 5", "stage_runs.attempt_count": "n % 9 = 0", "digest_runs.trigger_type": "n % 3 = 2", "digest_runs.status": "n % 7 = 5",
    "stories.latest_duplicate_count": "n % 5 = 0", "stories.confirmation_count": "n % 4 = 0",
    "settings.publish_top_n": "n % 120 NOT BETWEEN 5 AND 100", "settings.summary_max_chars": "n % 6000 NOT BETWEEN 180 AND 5000", "settings.minimum_importance_score": "n % 110 > 100", "settings.source_budget": "n % 220 NOT BETWEEN 5 AND 200", "settings.source_probe_count": "n % 13 > 10",
    "feedback.sentiment": "n % 3 = 2", "source_decisions.policy_version": "n % 120 NOT BETWEEN 1 AND 100", "source_decisions.confidence": "n % 15 > 10", "source_decisions.role": "n % 5 = 4", "source_decisions.role_selected": "n % 5 = 4 OR (n % 2 = 0) <> (n % 5 < 2)",
}
ORACLE = {
    "run_constraint_violations": "WITH o AS (SELECT o_orderkey AS n FROM orders) " + " UNION ALL ".join(f"SELECT '{k}' AS constraint, count(*) FILTER ({c}) AS n FROM o" for k, c in _BROKEN.items()),
    "catalogs_checked": """WITH d AS (SELECT doc_id, doc_id AS n FROM documents) SELECT doc_id, 0 AS ordinal, 's' || n AS name, 'https://x.org/' || n AS url, NULL::BOOLEAN AS enabled, NULL::INT AS priority, '' AS problems FROM d WHERE n % 7 = 0
UNION ALL SELECT doc_id, 1, 't', 'http://y.org', false, n % 8, CASE WHEN n % 8 BETWEEN 1 AND 5 THEN '' ELSE 'priority' END FROM d WHERE n % 7 = 0
UNION ALL SELECT doc_id, unnest([0, 1, 2]), unnest(['', NULL, 'n']), unnest(['x.org', NULL, 'https://']), NULL, NULL, unnest(['name,url', 'object,name,category,url', 'category,url']) FROM d WHERE n % 7 = 1
UNION ALL SELECT doc_id, 0, 'n', 'https://x.org', NULL, NULL, 'enabled,priority' FROM d WHERE n % 7 = 4 UNION ALL SELECT doc_id, 0, 'n', 'https://x.org/a?b#c', true, 5, '' FROM d WHERE n % 7 = 6""",
    "payload_status": "SELECT coalesce(source, 'none') AS source_id, count(*) AS n, count(*) FILTER (doc_id % 9 = 0) AS n_failed, CAST(sum(CASE WHEN doc_id % 9 = 0 THEN 0 ELSE doc_id % 4 + 1 END) AS BIGINT) AS parsed FROM documents GROUP BY 1",
    "keyword_groups": f"WITH c AS (SELECT c_custkey, {_HELD} AS held, {_ON} AS groups FROM customer) SELECT c_custkey, {_ACTIVE('avoid')} AS avoid, {_ACTIVE('prefer')} AS prefer, {_SET} AS \"set\" FROM c",
    "retained_events": f"WITH {O.INTERACTIONS} SELECT event_type, count(*) AS n FROM interactions WHERE event_id % 50 = 0 OR epoch >= 1706659200 - 10 * 86400 GROUP BY 1",
    "purged_items": "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber >= 7 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "portfolio_frozen": f"WITH {U.DECIDED}, f AS (SELECT run_id, source_id, role FROM decided WHERE run_id = (SELECT min(run_id) FROM decided)), m AS (SELECT 'none' AS run_id, source_id, role FROM decided WHERE run_id = (SELECT max(run_id) FROM decided WHERE month = 3)) SELECT * FROM f UNION ALL SELECT * FROM m",
    "feed_page_kept": O.ORACLE["feed_page"],
    "json_merged": f"""WITH {_DOCS}, j AS (SELECT doc_id, {OLDER} AS a, {NEWER} AS b FROM n), o AS (SELECT doc_id, a, CASE WHEN json_valid(b) THEN CASE WHEN json_type(b) = 'OBJECT' THEN b END END AS b FROM j),
k AS (SELECT doc_id, a, b, unnest(list_distinct(list_concat(json_keys(a), coalesce(json_keys(b), [])))) AS key FROM o)
SELECT doc_id, key, CAST(coalesce(json_extract(b, '$.' || key), json_extract(a, '$.' || key)) AS VARCHAR) AS value FROM k""",
    "json_typed": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 't' || doc_id ELSE '' END AS title, CASE doc_id % 6 WHEN 0 THEN CAST(doc_id AS DOUBLE) WHEN 2 THEN 100.0 ELSE 0.0 END AS rank, CASE doc_id % 6 WHEN 0 THEN 'a,b' WHEN 3 THEN 'c' ELSE '' END AS tags FROM documents",
    "briefs_checked": "SELECT doc_id, 's' || doc_id AS summary, CASE WHEN doc_id % 9 = 5 THEN '2:first|1:w' || doc_id ELSE '6:g|5:f|4:e|3:d|2:c' END AS lines FROM documents WHERE doc_id % 9 >= 5",
    "address_safety": f"""WITH e AS (SELECT event_id, event_id AS n, md5(CAST(event_id AS VARCHAR)) AS h, event_id % 256 AS a, event_id % 7 * 40 AS b, event_id % 251 AS c, event_id % 299 AS d FROM events)
SELECT event_id, CASE n % 7 WHEN 0 THEN {_FIRST} || lpad({SECOND}, 4, '0') || substr(h, 9) WHEN 1 THEN {_FIRST} || repeat('0', 24) || substr(h, 29, 4) WHEN 2 THEN CASE WHEN d < 256 THEN repeat('0', 20) || 'ffff' || lower(printf('%02x%02x%02x%02x', a, b, c, d)) END
  WHEN 4 THEN {_FIRST} || repeat('0', 27) || '1' WHEN 6 THEN repeat('0', 32) END AS digits,
  CASE n % 7 WHEN 0 THEN NOT {_OPEN} OR ({_FIRST} = '2001' AND lpad({SECOND}, 4, '0') IN ('0000', '0db8')) WHEN 1 THEN NOT {_OPEN} OR {_FIRST} = '2001' WHEN 4 THEN NOT {_OPEN} OR {_FIRST} = '2001' WHEN 2 THEN d > 255 OR NOT {_OPEN4} WHEN 3 THEN d > 255 OR NOT {_OPEN4} ELSE true END AS blocked FROM e""",
    "reader_policy": f"SELECT 'order' AS kind, o_orderkey AS id FROM orders WHERE o_custkey = {READER} UNION ALL SELECT 'nation', n_nationkey FROM nation",
}
