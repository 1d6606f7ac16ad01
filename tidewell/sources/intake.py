"""RSS and Atom payloads to items and articles. No network here: payloads come as rows (source_id, source_name, category, priority, body)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as X


def tag_text(xml: Column, tag: str) -> Column:
    return X.let(F.trim(X.decode_entities(F.regexp_extract(xml, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))), lambda t: F.nullif(t, F.lit("")))


def tag_attribute(xml: Column, tag: str, name: str) -> Column:
    return F.nullif(F.regexp_extract(xml, rf"""(?is)<{tag}\b[^>]*\b{name}=["']([^"']*)["']""", 1), F.lit(""))


def items(payloads: DataFrame) -> DataFrame:
    """One row for each <item>, or <entry> where there is no item, with ordinal, title, link, url, summary, published."""
    rss = F.regexp_extract_all("body", F.lit(r"(?is)(<item\b.*?</item>)"), F.lit(1))
    atom = F.regexp_extract_all("body", F.lit(r"(?is)(<entry\b.*?</entry>)"), F.lit(1))
    x = payloads.select("source_id", "source_name", "category", "priority", F.posexplode(F.when(F.size(rss) > 0, rss).otherwise(atom)).alias("ordinal", "xml"))
    xml = F.col("xml")
    link = F.coalesce(tag_text(xml, "link"), tag_attribute(xml, "link", "href"))
    texts = F.array_compact(F.array(*(tag_text(xml, t) for t in ("description", "summary", "content:encoded", "content"))))
    ranked = F.transform(texts, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t")))
    dates = F.coalesce(*(X.parse_date(tag_text(xml, t)) for t in ("pubDate", "published", "updated", "dc:date")))
    title = X.plain_text(F.coalesce(tag_text(xml, "title"), F.lit("")))
    x = x.select("source_id", "source_name", "category", "priority", "ordinal", title.alias("title"), link.alias("link"), F.coalesce(F.array_max(ranked)["t"], F.lit("")).alias("summary"), dates.alias("published"))
    x = x.withColumn("summary", X.clean_summary(F.col("summary"), F.col("title")))
    return x.withColumn("url", X.normalize_url(F.col("link"))).where((F.col("title") != "") | F.col("link").isNotNull())


def recent(df: DataFrame, as_of: Column) -> DataFrame:
    """Adds age: kept for today and yesterday in Warsaw, old, or undated."""
    today = X.warsaw_date(as_of)
    day = X.warsaw_date(F.col("published"))
    return df.withColumn("age", F.when(F.col("published").isNull(), "undated").when(day.between(F.date_sub(today, 1), today), "kept").otherwise("old"))


def intake_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source_id").agg(F.count("*").alias("parsed"), *(F.count_if(F.col("age") == a).alias(a) for a in ("kept", "old", "undated")))


def fetched(payloads: DataFrame) -> DataFrame:
    """(source_id, status, error, parsed, body): whether a source's fetch succeeded, by itself; what failed has no body and the class of its error.

    payloads: source_id, http_status, error (of the fetch), body; a body without items is a failure too."""
    from tidewell.operators.publishing import error_class

    message = F.coalesce(F.col("error"), F.when(~F.col("http_status").between(200, 299), F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))))
    n = F.regexp_count("body", F.lit(r"(?i)<(?:item|entry)\b"))
    bad = message.isNotNull() | F.col("body").isNull() | (n == 0)
    return payloads.withColumn("parsed", F.when(bad, 0).otherwise(n).cast("long")).select("source_id", F.when(bad, "failed").otherwise("succeeded").alias("status"), F.when(bad, error_class(F.coalesce(message, F.lit("no items")))).alias("error"), "parsed", F.when(~bad, F.col("body")).alias("body"))


def without_probes(df: DataFrame, roles: DataFrame) -> DataFrame:
    """Items but those of sources that are only probed; roles (source_id, role); items without a source stay."""
    return df.join(roles.where("role = 'probe'").select("source_id"), "source_id", "left_anti")


# Where feeds often are.
COMMON_PATHS = ["/feed", "/feed.xml", "/rss", "/rss.xml", "/atom.xml"]
# End of fixed values.


def feed_candidates(html: Column, url: Column, most: int = 10) -> Column:
    """Where a page's feed may be: the feeds that it names, resolved, then the common paths of its host; at most ten, each once."""
    origin = F.regexp_extract(url, r"(?i)^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"(?i)^(https?://[^/]+(?:/.*)?/)", 1)
    base = F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder)
    full = lambda h: F.when(h.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.regexp_extract(url, r"(?i)^(https?:)", 1), h)).when(h.startswith("/"), F.concat(origin, h)).otherwise(F.concat(base, h))
    named = F.transform(alternate_feeds(html), lambda h: full(X.decode_entities(h)))
    return F.slice(F.array_distinct(F.concat(named, F.array(*(F.concat(origin, F.lit(p)) for p in COMMON_PATHS)))), 1, most)


def duplicate_ratio(df: DataFrame) -> DataFrame:
    """(source_id, n, duplicate_ratio): the share of a source's items whose URL another one has."""
    return df.groupBy("source_id").agg(F.count("*").alias("n"), F.round((F.count("*") - F.count_distinct("url")) / F.count("*"), 6).alias("duplicate_ratio"))


def to_articles(df: DataFrame) -> DataFrame:
    """Items with URL and title, one for each URL: the longest summary, of equal ones the first."""
    from tidewell.operators.stories import best_per_url

    rows = df.where(F.col("url").isNotNull() & (F.col("title") != "")).withColumnRenamed("url", "canonical_url")
    return best_per_url(rows.withColumn("ordinal", F.struct("source_id", "ordinal")))


def alternate_feeds(html: Column) -> Column:
    """Links to feeds that a page names, as they stand."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^>]*>)"), F.lit(1))
    feeds = F.filter(tags, lambda t: t.rlike(r"""(?i)rel=["']?[^"'>]*alternate""") & t.rlike(r"(?i)application/(?:rss|atom)\+xml"))
    return F.array_compact(F.transform(feeds, lambda t: F.nullif(F.regexp_extract(t, r"""(?i)href=["']([^"']*)["']""", 1), F.lit(""))))
