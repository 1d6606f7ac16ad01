"""Expressions for text, URLs and numbers against literal expectations."""

from pyspark.sql import functions as F

from tidewell.functions import text as X


def one(spark, expr, *values):
    df = spark.createDataFrame([tuple(values) or (None,)], ", ".join(f"c{i} string" for i in range(max(1, len(values)))))
    return df.select(expr.alias("x")).first()[0]


def test_urls(spark):
    u = lambda s: one(spark, X.normalize_url(F.col("c0")), s)
    assert u("https://example.com/story?utm_source=x&id=1#section") == "https://example.com/story?id=1"
    assert u("HTTPS://Example.com:443") == "https://example.com/"
    assert u("http://a.b/?REF=1&q=2&fbclid=3") == "http://a.b/?q=2"
    assert u("ftp://a.b/c") is None and u("nonsense") is None and u(None) is None


def test_keywords_are_whole_tokens(spark):
    found = lambda t, *k: one(spark, X.matching_keywords(F.col("c0"), list(k)), t)
    assert found("the capital", "api") == [] and found("pharmacy", "arm") == [] and found("she said", "ai") == []
    assert found("The SEC rules", "sec") == ["sec"]
    assert found("actively-exploited zero-day needs an emergency patch", "zero day", "emergency patch") == ["zero day", "emergency patch"]
    assert found("OpenAI ships an API", "openai", "API", "api") == ["openai", "API"]


def test_summaries(spark):
    c = lambda s, t: one(spark, X.clean_summary(F.col("c0"), F.col("c1")), s, t)
    assert c("Article URL: https://x.y Comments URL: https://z Points: 3 # Comments: 4 A title", "A title") == ""
    assert c("<p>Summary &amp; context</p>", "t") == "Summary & context"
    assert one(spark, X.plain_text(F.col("c0")), "&lt;b&gt;x&lt;/b&gt;&#39;s") == "x 's"
    assert one(spark, X.decode_numeric_entities(F.col("c0")), "&#233;&#x1F600;&#99999999;") == "é😀&#99999999;"
    assert one(spark, X.compact(F.col("c0"), 10), "one two three four") == "one two t..."


def test_feedback_keywords(spark):
    got = one(spark, X.feedback_keywords(F.col("c0")), "This NVIDIA security story is about a critical supply chain breach")
    assert got == ["nvidia", "security", "story", "critical", "supply", "chain", "breach"]


def test_feeds(spark):
    cases = {"Świat / Geopolityka / Europa": "geopolitics", "Świat / Biznes / Makro": "business", "AI / Open Source": "ai", "Software / Engineering": "software", "Cyberbezpieczeństwo PL": "security", "Software / Status": "software", "Anything": "geopolitics"}
    for category, feed in cases.items():
        assert one(spark, X.feed_of(F.col("c0")), category) == feed


def test_fingerprints_and_hashes(spark):
    f = lambda t: one(spark, X.fingerprint(X.dedupe_tokens(F.col("c0"), True)), t)
    assert f("OpenAI launches new GPT-5 model") == f("New GPT-5 model launches from OpenAI")
    assert one(spark, X.dedupe_tokens(F.col("c0"), True), "Café — the -résumé- of it") == ["cafe", "resume"]
    import hashlib

    words = ["alpha", "beta", "gamma"]
    h = [int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) for w in words]
    expected = sum(1 << i for i in range(32) if sum(1 if x >> i & 1 else -1 for x in h) > 0)
    assert one(spark, X.simhash32(F.split("c0", " ")), " ".join(words)) == expected
    def fnv(s):
        x = 2166136261
        for c in s.encode():
            x = (x ^ c) * 16777619 & 0xFFFFFFFF
        return x
    assert one(spark, X.fnv1a32(F.col("c0")), "2024-01-31:abc") == fnv("2024-01-31:abc")


def test_tokens_and_bits_of_odd_texts(spark):
    """Words with hyphens, marks, letters beyond 16 bits, against the steps one after the other and a plain count; some batches have empty texts."""
    import hashlib
    import random
    import unicodedata

    r = random.Random(7)
    signs = "abcxyz019--- _\t\n éÉßø½²Ⅻ中文ﬁ𝒳𐐀😀'.!"
    texts = ["", None, *("".join(r.choice(signs) for _ in range(r.choice([1, 3, 10, 60, 300]))) for _ in range(400)), " ".join(f"word{i}" for i in range(70_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, c string").repartition(3).withColumn("t", X.dedupe_tokens(F.col("c"), True))
    steps = F.filter(F.transform(F.split(X.dedupe_text(F.col("c"), True), " "), lambda w: F.regexp_replace(w, "^-+|-+$", "")), lambda w: (F.length(w) > 2) & ~w.isin(X.V.DEDUPE_STOPWORDS))
    for x in df.select("c", "t", F.array_distinct(steps).alias("steps"), X.simhash32(F.col("t")).alias("bits"), X.nfkd(F.col("c")).alias("plain")).collect():
        assert x.t == x.steps
        assert x.plain == (x.c and "".join(c for c in unicodedata.normalize("NFKD", x.c) if not unicodedata.category(c).startswith("M")))
        h = [int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) for w in x.t or []]
        assert x.bits == sum(1 << i for i in range(32) if 2 * sum(y >> i & 1 for y in h) > len(h))


def test_numbers_and_dates(spark):
    r = spark.sql("select -2.5 x, 1.0 a, 0.0 b").select(X.js_round(F.col("x")).alias("r"), X.percentage(F.col("a"), F.col("b")).alias("p"), X.half_life(F.lit(45.0)).alias("h")).first()
    assert (r.r, r.p, r.h) == (-2, 0, 0.5)
    for text in ("Fri, 19 Jun 2026 10:15:00 GMT", "2026-06-19T10:15:00.000Z", "2026-06-19T12:15:00+02:00"):
        assert str(one(spark, X.parse_date(F.col("c0")).cast("string"), text)) == "2026-06-19 10:15:00"
    assert one(spark, X.parse_date(F.col("c0")).cast("string"), "soon") is None
    assert one(spark, X.blocked_ipv4(F.col("c0")), "192.168.1.1") and not one(spark, X.blocked_ipv4(F.col("c0")), "8.8.8.8") and one(spark, X.blocked_ipv4(F.col("c0")), "8.8.8.999")


def test_readable_pages(spark):
    from tidewell.functions import values as V

    p = "<p>" + "word " * 95 + "</p>"
    html = f"<html><nav><p>{'menu ' * 300}</p></nav><article>{p}{p}</article></html>"
    df = spark.createDataFrame([(html,), ("<article><p>short</p></article><audio src=x>",)], "h string")
    got = df.select(X.word_count(X.readable_text(X.content_html(F.col("h")))).alias("w"), X.paragraph_count(X.content_html(F.col("h"))).alias("p"), F.col("h").rlike("(?i)" + V.AUDIO_SIGNAL).alias("a")).collect()
    assert [tuple(r) for r in got] == [(190, 2, False), (1, 0, True)]
