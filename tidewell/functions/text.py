"""Column expressions for text, HTML, URLs, dates and numbers. All are built-in functions; nothing leaves the JVM but
``decode_numeric_entities`` and ``nfkd``, for which Spark has no function, and ``simhash32``, which counts bits by columns."""

from __future__ import annotations

import hashlib
import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from tidewell.functions import values as V

SPACES = r"(?U)\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c: Column, f) -> Column:
    """f(c) with c worked out once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


# --- numbers -------------------------------------------------------------------------------------------------------


def js_round(c: Column) -> Column:
    """Half up, toward positive infinity."""
    return F.floor(c + 0.5)


def clamp(c: Column, low, high) -> Column:
    """The value within its bounds; null for null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def percentage(part: Column, whole: Column) -> Column:
    """min(1, part / whole) * 100, rounded; 0 where whole is not positive."""
    return F.when(whole > 0, js_round(F.least(F.lit(1.0), part / F.nullif(whole, F.lit(0))) * 100)).otherwise(F.lit(0)).cast("long")


def half_life(age_days: Column, days: float = V.HALF_LIFE_DAYS) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.coalesce(age_days, F.lit(0.0)), F.lit(0.0)) / days)


# --- plain text ----------------------------------------------------------------------------------------------------


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def decode_entities(c: Column) -> Column:
    """CDATA marks go; named references and numeric ones up to 255 become characters, others stay for decode_numeric_entities."""
    return let(c, lambda x: F.when(F.contains(x, F.lit("&")) | F.contains(x, F.lit("]]>")) | F.contains(x, F.lit("<![CDATA[")), _decoded(x)).otherwise(x))


def _decoded(c: Column) -> Column:
    out = F.replace(F.replace(c, F.lit("<![CDATA[")), F.lit("]]>"))
    refs = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?i)(&#(?:\d{1,7}|x[0-9a-f]{1,6});)"), F.lit(1)))

    def put(text: Column, ref: Column) -> Column:
        body = F.lower(F.substring(ref, 3, 9))
        hexa = F.startswith(body, F.lit("x"))
        code = F.when(hexa, F.conv(F.regexp_replace(body, "[x;]", ""), 16, 10)).otherwise(F.regexp_replace(body, ";", "")).cast("long")
        return F.when(code.between(1, 255) & (code != 38), F.replace(text, ref, F.char(code))).otherwise(text)

    out = let(out, lambda t: F.aggregate(refs(t), t, put))
    for name, char in V.ENTITIES.items():
        if name != "amp":
            out = F.regexp_replace(out, f"(?i)&{name};", char)
    return F.regexp_replace(out, "(?i)&(?:amp|#0*38|#x0*26);", "&")


@F.pandas_udf(StringType())
def decode_numeric_entities(s: pd.Series) -> pd.Series:
    """All numeric character references; what names no character stays."""

    def char(m) -> str:
        try:
            return chr(int(m[1][1:], 16) if m[1][0] in "xX" else int(m[1])) or m[0]
        except (ValueError, OverflowError):
            return m[0]

    return s.str.replace(r"&#(\d+|[xX][0-9a-fA-F]+);", char, regex=True)


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without marks."""
    return s.map(_decomposed)


def _decomposed(x: str | None) -> str | None:
    if x is None or x.isascii():
        return x
    x = unicodedata.normalize("NFKD", x)
    for c in set(x):
        if unicodedata.category(c).startswith("M"):
            x = x.replace(c, "")
    return x


def plain_text(c: Column) -> Column:
    out = c
    for _ in range(2):
        out = F.regexp_replace(decode_entities(out), "<[^>]+>", " ")
    return squeezed(F.replace(out, F.lit("\u0000"), F.lit(" ")))


def clean_summary(summary: Column, title: Column) -> Column:
    """Plain text without feed metadata; empty where it says no more than the title."""
    out = reduce(lambda a, p: F.regexp_replace(a, "(?i)" + p, " "), V.FEED_METADATA, plain_text(summary))
    return let(squeezed(out), lambda x: F.when((F.coalesce(title, F.lit("")) != "") & (F.lower(x) == F.lower(plain_text(title))), F.lit("")).otherwise(x))


def compact(c: Column, most: int) -> Column:
    return let(squeezed(c), lambda x: F.when(F.length(x) > most, F.concat(F.trim(F.substring(x, 1, most - 1)), F.lit("..."))).otherwise(x))


def human_label(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def priority_label(score: Column) -> Column:
    return F.when(score >= 85, "Critical").when(score >= 70, "High").when(score >= 55, "Useful").otherwise("Background")


# --- tokens and keywords ---------------------------------------------------------------------------------------------


def keyword_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _normal(keyword: str) -> str:
    import re

    return " ".join(re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", keyword).lower()))


def spaced(c: Column) -> Column:
    """The tokens of a text, a space around each: what keywords are looked up in."""
    return F.concat(F.lit(" "), F.array_join(keyword_tokens(F.coalesce(c, F.lit(""))), " "), F.lit(" "))


def _forms(keywords: list[str]) -> dict[str, str]:
    """Each normal form once, with the first keyword that has it."""
    forms: dict[str, str] = {}
    for k in keywords:
        if n := _normal(k):
            forms.setdefault(n, k)
    return forms


def matching_keywords(c: Column, keywords: list[str], among: Column | None = None) -> Column:
    """The keywords whose tokens follow one another in the text, in the order of the list, each normal form once.

    ``among`` is spaced(c) where a query has it already."""
    forms = _forms(keywords)
    if not forms:
        return F.array().cast("array<string>")
    found = lambda s: F.array_compact(F.array(*(F.when(F.contains(s, F.lit(f" {n} ")), F.lit(k)) for n, k in forms.items())))
    return let(spaced(c), found) if among is None else found(among)


def hits(c: Column, keywords: list[str], among: Column | None = None) -> Column:
    """How many of the keywords the text has."""
    forms = _forms(keywords)
    if not forms:
        return F.lit(0)
    count = lambda s: reduce(lambda a, b: a + b, [F.contains(s, F.lit(f" {n} ")).cast("int") for n in forms])
    return let(spaced(c), count) if among is None else count(among)


def any_keyword(c: Column, keywords: list[str], among: Column | None = None) -> Column:
    forms = _forms(keywords)
    if not forms:
        return F.lit(False)
    some = lambda s: reduce(lambda a, b: a | b, [F.contains(s, F.lit(f" {n} ")) for n in forms])
    return let(spaced(c), some) if among is None else some(among)


def feedback_keywords(c: Column, most: int = 40) -> Column:
    words = F.filter(keyword_tokens(c), lambda w: (F.length(w) >= 4) & ~w.isin(V.FEEDBACK_STOPWORDS))
    return F.slice(F.array_distinct(words), 1, most)


def topic_tags(category: Column, bucket: Column, title: Column) -> Column:
    words = F.slice(F.filter(keyword_tokens(title), lambda w: F.length(w) >= 5), 1, 5)
    return F.slice(F.array_distinct(F.filter(F.concat(F.array(F.lower(category), bucket), words), lambda x: x.isNotNull() & (x != ""))), 1, 8)


def entity_tags(title: Column) -> Column:
    found = F.regexp_extract_all(title, F.lit(r"(\b\p{Lu}[\p{L}\p{N}-]{2,}(?:\s+\p{Lu}[\p{L}\p{N}-]{2,})*)"), F.lit(1))
    return F.slice(F.array_distinct(found), 1, 8)


def feed_of(category: Column) -> Column:
    low = F.lower(category)
    has = lambda parts: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts])
    out = F.lit("geopolitics")
    for feed, parts in reversed(V.FEED_RULES):
        out = F.when(has(parts), feed).otherwise(out)
    return out


# --- dedupe text -------------------------------------------------------------------------------------------------


def dedupe_text(c: Column, strip_marks: bool = False) -> Column:
    """Lower case, letters, digits and hyphens, single spaces; with strip_marks without accents, by an Arrow function."""
    low = nfkd(F.lower(c)) if strip_marks else F.lower(c)
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}\s-]", " "), SPACES, " "))


#: What is left of the words of dedupe_text without the hyphens at their ends, if that has more than two characters; frequent characters are asked first.
WORD = r"([a-z0-9\p{L}\p{N}][a-z0-9\p{L}\p{N}-]+[a-z0-9\p{L}\p{N}])"


def dedupe_tokens(c: Column, strip_marks: bool = False) -> Column:
    """The words of dedupe_text without hyphens at their ends, each once, but short ones and stop words; found in one pass."""
    low = nfkd(F.lower(c)) if strip_marks else F.lower(c)
    return F.array_except(F.regexp_extract_all(low, F.lit(WORD), F.lit(1)), F.array(*map(F.lit, V.DEDUPE_STOPWORDS)))


def fingerprint(tokens: Column) -> Column:
    return F.array_join(F.slice(F.sort_array(F.array_distinct(tokens)), 1, 12), " ")


#: Tokens whose bits are counted in one step.
STEP = 1 << 18


def simhash32(tokens: Column) -> Column:
    """A bit is set where more tokens' hashes have it than have not; a token's hash is the first 4 bytes of its SHA-256."""
    return _simhash32(F.coalesce(tokens, F.array().cast("array<string>")))


@F.arrow_udf(LongType())
def _simhash32(tokens: pa.Array) -> pa.Array:
    """The tokens of a batch are hashed once each."""
    sizes = tokens.value_lengths().to_numpy(zero_copy_only=False)
    words = tokens.flatten().dictionary_encode()
    codes, first = words.indices.to_numpy(), b"".join([hashlib.sha256(w).digest()[:4] for w in words.dictionary.cast(pa.binary()).to_pylist()])
    bits = np.unpackbits(np.frombuffer(first, np.uint8).reshape(-1, 4), axis=1)
    some = np.flatnonzero(sizes)
    n, to = sizes[some].astype(np.int64), np.cumsum(sizes[some], dtype=np.int64)
    out, at = np.zeros(len(sizes), np.int64), 0
    while at < len(some):
        start = to[at] - n[at]
        end = max(at + 1, int(np.searchsorted(to, start + STEP, side="right")))
        ones = np.add.reduceat(bits[codes[start : to[end - 1]]], to[at:end] - n[at:end] - start, axis=0, dtype=np.int32)
        out[some[at:end]] = np.packbits(2 * ones > n[at:end, None], axis=1).view(">u4").ravel()
        at = end
    return pa.array(out)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / F.nullif(union, F.lit(0)))


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(least, F.lit(0)))


def anchors(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: (F.length(w) >= 7) | w.rlike(r"\d"))


# --- HTML ------------------------------------------------------------------------------------------------------------


def without_elements(c: Column, tags: list[str] = V.NON_CONTENT_ELEMENTS) -> Column:
    """Each kind of element is cut out after the one before it, as nested markup can tell."""
    return reduce(lambda a, t: F.regexp_replace(a, rf"(?is)<{t}\b.*?</{t}>", " "), tags, c)


def longest_body(c: Column, tag: str) -> Column:
    found = F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    ranked = F.transform(found, lambda x, i: F.struct(F.length(plain_text(x)).alias("n"), (-i).alias("i"), x.alias("x")))
    return F.array_max(ranked)["x"]


def content_html(c: Column) -> Column:
    some = lambda x: F.nullif(x, F.lit(""))
    return let(without_elements(c), lambda cut: F.coalesce(some(longest_body(cut, "article")), some(longest_body(cut, "main")), some(longest_body(cut, "body")), cut))


def paragraph_count(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    return F.size(F.filter(found, lambda x: F.length(plain_text(x)) >= 40))


def readable_text(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"(?is)<(?:h[1-6]|p|li|blockquote)\b[^>]*>(.*?)</(?:h[1-6]|p|li|blockquote)>"), F.lit(1))
    blocks = F.filter(F.transform(found, plain_text), lambda x: x != "")
    return let(blocks, lambda b: F.when(F.size(b) > 0, F.array_join(b, "\n\n")).otherwise(plain_text(c)))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+"))


def readable(html: Column) -> Column:
    """struct(text, n_words, n_paragraphs, mode): a page's text, at most 200,000 characters, and whether it can be read here.

    It can with 170 words, or 120 in two paragraphs, or 90 in four of 700 characters, unless it asks to subscribe; else
    it is named for what it has instead."""

    def judged(p: Column) -> Column:
        words, full = word_count(p["text"]), F.length(p["text"]) >= 700
        enough = (words >= 170) | (words >= 120) & (p["paragraphs"] >= 2) | (words >= 90) & (p["paragraphs"] >= 4) & full
        mode = F.when(enough & ~p["wall"], "readable").when(p["wall"], "insufficient_text").when(p["audio"], "audio_only").when(p["video"], "video_only").otherwise("insufficient_text")
        return F.struct(p["text"].alias("text"), words.alias("n_words"), p["paragraphs"].alias("n_paragraphs"), mode.alias("mode"))

    def parts(content: Column) -> Column:
        return F.struct(F.substring(readable_text(content), 1, 200_000).alias("text"), paragraph_count(content).alias("paragraphs"), plain_text(content).rlike("(?i)" + V.ACCESS_WALL).alias("wall"), html.rlike("(?i)" + V.AUDIO_SIGNAL).alias("audio"), html.rlike("(?i)" + V.VIDEO_SIGNAL).alias("video"))

    return let(let(content_html(html), parts), judged)


def meta_description(c: Column) -> Column:
    plain = F.regexp_extract(c, r"""(?is)<meta\b[^>]*name=["']description["'][^>]*content=["']([^"']*)["']""", 1)
    graph = F.regexp_extract(c, r"""(?is)<meta\b[^>]*property=["']og:description["'][^>]*content=["']([^"']*)["']""", 1)
    return F.coalesce(F.nullif(plain, F.lit("")), F.nullif(graph, F.lit("")))


def feed_kind(c: Column) -> Column:
    return F.when(c.rlike(r"(?i)<feed\b"), "atom").when(c.rlike(r"(?i)<rss\b|<rdf:RDF\b|<channel\b"), "rss")


# --- URLs -------------------------------------------------------------------------------------------------------------


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host without a default port, no fragment, no tracking parameters; null for what is no http URL."""
    return let(c, _normalized)


def _normalized(c: Column) -> Column:
    pattern = r"(?i)^(https?)://([^/?#\s]+)([^?#\s]*)(?:\?([^#\s]*))?(?:#\S*)?$"
    part = lambda i: F.regexp_extract(F.trim(c), pattern, i)
    scheme = F.lower(part(1))
    host = F.regexp_replace(F.lower(part(2)), r"(?<=.):(?:80|443)$", "")
    host = F.when((scheme == "http") & F.lower(part(2)).rlike(":443$") | (scheme == "https") & F.lower(part(2)).rlike(":80$"), F.lower(part(2))).otherwise(host)
    path = F.when(part(3) == "", F.lit("/")).otherwise(part(3))
    query = F.array_join(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(V.TRACKING_PARAMS)), "&")
    return F.when(F.trim(c).rlike(pattern), F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def url_host(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def ipv4_number(c: Column) -> Column:
    p = lambda i: F.try_element_at(F.split(c, r"\."), F.lit(i)).try_cast("long")
    ok = c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(p(1), p(2), p(3), p(4)) <= 255)
    return F.when(ok, p(1) * 16777216 + p(2) * 65536 + p(3) * 256 + p(4))


# Address blocks that no fetch may reach.
BLOCKED_IPV4 = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]


def blocked_ipv4(c: Column) -> Column:
    n = ipv4_number(c)

    def inside(block: str) -> Column:
        base, bits = block.split("/")
        low = sum(int(x) << s for x, s in zip(base.split("."), (24, 16, 8, 0)))
        return n.between(low, low + (1 << 32 - int(bits)) - 1)

    return n.isNull() | reduce(lambda a, b: a | b, map(inside, BLOCKED_IPV4))


# --- dates -----------------------------------------------------------------------------------------------------------


def warsaw_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "Europe/Warsaw"))


def parse_date(c: Column) -> Column:
    """ISO 8601 or RFC 822; null for anything else."""
    return let(c, _parsed)


def _parsed(c: Column) -> Column:
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(bare, r"\bGMT$|\bUT$|\bZ$", "+0000")
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm Z")))


def fnv1a32(c: Column) -> Column:
    """FNV-1a over the UTF-16 units of a text."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(....)"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


def js_number(c: Column, digits: int = 3) -> Column:
    """A number as text, rounded, without zeros at its end."""
    return F.regexp_replace(F.round(c, digits).cast(f"decimal(30,{digits})").cast("string"), r"\.?0+$", "")


def truncated(c: Column, most: int) -> Column:
    """At most so many characters, the last of them an ellipsis where something is cut off."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)
