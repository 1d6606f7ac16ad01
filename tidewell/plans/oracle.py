"""The same rows in DuckDB's SQL, written from the definitions and not from the plans."""

from __future__ import annotations

CATEGORY = "CASE doc_id % 7 WHEN 0 THEN 'AI / Labs' WHEN 1 THEN 'Software / Engineering' WHEN 2 THEN 'Cybersecurity' WHEN 3 THEN 'Świat / Biznes / Makro' WHEN 4 THEN 'Świat / Geopolityka' WHEN 5 THEN 'Software / Status' ELSE 'General' END"
FEED = "CASE doc_id % 7 WHEN 0 THEN 'ai' WHEN 1 THEN 'software' WHEN 2 THEN 'security' WHEN 3 THEN 'business' WHEN 4 THEN 'geopolitics' WHEN 5 THEN 'software' ELSE 'geopolitics' END"
ARTICLES = f"""articles AS (
  SELECT doc_id AS article_id, substr(replace(text, chr(10), ' '), 1, 80) AS title, substr(replace(text, chr(10), ' '), 81) AS summary,
         source, {CATEGORY} AS category, {FEED} AS feed, doc_id % 5 + 1 AS priority, 1706659200 - ((doc_id * 37) % 240) * 3600 AS published_epoch
  FROM documents)"""
INTERACTIONS = """interactions AS (
  SELECT event_id, epoch_us(ts) // 1000000 AS epoch, strftime(ts, '%Y-%m-%d') AS day, user_id,
         CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'source_open' WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'read' ELSE 'feedback' END AS event_type,
         CASE event_id % 10 WHEN 0 THEN 'bulk' WHEN 1 THEN 'automatic' WHEN 2 THEN NULL ELSE 'direct' END AS origin,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS story_id, user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
         user_id || '-' || strftime(ts, '%Y-%m-%d') AS context_id, event_id % 15 AS rank, 'v' || (event_id % 2 + 1) AS policy
  FROM events)"""
OBSERVATIONS = """observations AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS run_id, n_name AS source_id, count(*) AS parsed, count(*) FILTER (o_orderstatus <> 'P') AS eligible,
         count(*) FILTER (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') AS unique_stories, count(*) FILTER (o_orderpriority LIKE '1%') AS selected,
         count(*) FILTER (o_orderpriority LIKE '2%') AS confirmed, count(*) FILTER (o_orderstatus = 'F') > 0 AS succeeded, max(o_orderkey % 9000) AS duration_ms
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
STOP = "['" + "','".join("a about after again against all amid an and are as at be been being by for from has have how in into is it its latest live new news of on or over report reports says that the this to under update updates was what when why will with".split()) + "']"


def spaced(text: str = "text") -> str:
    return rf"(' ' || array_to_string(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+'), ' ') || ' ')"


def hits(words: list[str], text: str = "text") -> str:
    return "(" + " + ".join(f"CAST(contains({text}, ' {w} ') AS INT)" for w in words) + ")"


TEXTS = f"{ARTICLES}, texts AS (SELECT *, title || ' ' || summary AS text FROM articles), spaced AS (SELECT *, {spaced()} AS s FROM texts)"
IMPORTANT = ["that", "with", "edth", "der die", "que de", "onan"]
PREFERRED = ["this", "les", "ntst"]
SCOPE = ["from", "und", "para", "est"]
ACTIONS = ["are", "for", "the of", "nicht", "los"]
ENTITY = ["what", "was", "dem", "eau"]
BUILD = ["ones", "ins", "thst", "con"]
STORIES = f"""{TEXTS}, parts AS (
  SELECT *, article_id % 4 + 1 AS source_count, (1706659200 - published_epoch) / 3600.0 AS age,
         least(10, greatest(1, 2 + {hits(IMPORTANT, 's')} + {hits(PREFERRED, 's')})) AS impact,
         CASE WHEN {hits(SCOPE + PREFERRED, 's')} > 0 THEN 9 ELSE 4 END AS scope,
         least(10, greatest(1, 2 + {hits(ACTIONS, 's')} + least(3, {hits(ENTITY, 's')}) + least(2, {hits(BUILD, 's')}))) AS action,
         CASE article_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 7 ELSE 2 END AS novelty
  FROM spaced), timed AS (
  SELECT *, least(10, CASE WHEN source_count >= 5 THEN 10 ELSE source_count * 3 END) AS confirmation,
         CASE WHEN age <= 6 THEN 10 WHEN age <= 24 THEN 8 WHEN age <= 72 THEN 5 ELSE 3 END AS urgency FROM parts), stories AS (
  SELECT *, CAST(floor(CAST(impact AS DOUBLE) * 2.4 + CAST(novelty AS DOUBLE) * 1.6 + CAST(confirmation AS DOUBLE) * 1.4 + CAST(scope AS DOUBLE) * 2.4 + CAST(action AS DOUBLE) * 1.7 + CAST(urgency AS DOUBLE) * 1.2 + CAST(least(5, greatest(0, priority)) AS DOUBLE) * 1.5 + 0.5) AS BIGINT) AS editorial FROM timed)"""
ITEMS = f"""{STORIES}, {INTERACTIONS}, states AS (
  SELECT story_id, bool_or(event_type = 'read') AS read, count(*) FILTER (event_type = 'save') >= 25 AS saved, count(*) FILTER (event_type = 'feedback') >= 25 AS archived
  FROM interactions GROUP BY story_id), items AS (
  SELECT article_id, feed, editorial, published_epoch, s.priority, coalesce(read, false) AS read, coalesce(saved, false) AS saved, coalesce(archived, false) AS archived
  FROM stories s LEFT JOIN states t ON s.article_id % 150 = t.story_id)"""
FRESH = "CASE WHEN age <= 6 THEN 12 WHEN age <= 24 THEN 9 WHEN age <= 72 THEN 5 WHEN age <= 168 THEN 2 ELSE 0 END"
PLAIN = f"""{ITEMS}, plain AS (
  SELECT article_id AS item_id, editorial, CAST(article_id * 7 % 31 - 15 AS DOUBLE) AS preference, {FRESH} AS freshness, CASE WHEN article_id % 3 = 0 THEN 4 ELSE 0 END AS upd, published_epoch
  FROM (SELECT *, (1706659200 - published_epoch) / 3600.0 AS age FROM items)), v2 AS (
  SELECT item_id, row_number() OVER (ORDER BY editorial + greatest(-9, least(9, preference)) + freshness + upd DESC, editorial DESC, item_id) - 1 AS position FROM plain)"""
MEMBERS = f"{ARTICLES}, members AS (SELECT *, min(article_id) OVER (PARTITION BY title) AS story_id FROM articles)"
SEEN = "SELECT context_id, story_id, policy, min(rank) AS rank FROM interactions WHERE event_type = 'impression' AND context_id IS NOT NULL GROUP BY ALL"
ACTED = "SELECT context_id, story_id, policy, max(CAST(event_type = 'source_open' AS INT)) AS o, max(CAST(event_type = 'save' AS INT)) AS s, max(CAST(event_type = 'feedback' AS INT)) AS f FROM interactions WHERE event_type IN ('source_open','save','read','feedback') AND coalesce(origin, 'direct') = 'direct' GROUP BY ALL"


def pct(part: str, whole: str) -> str:
    return f"CAST(CASE WHEN {whole} > 0 THEN floor(least(1.0, CAST({part} AS DOUBLE) / {whole}) * 100 + 0.5) ELSE 0 END AS BIGINT)"


QUALITY = f"""{OBSERVATIONS}, sums AS (
  SELECT source_id, count(*) AS runs, count(*) FILTER (succeeded) AS ok, sum(parsed) AS parsed, sum(eligible) AS eligible, sum(unique_stories) AS uniq, sum(selected) AS selected, sum(confirmed) AS confirmed, sum(selected) * 0.1 AS value, round(avg(duration_ms), 6) AS dur
  FROM observations GROUP BY source_id), rates AS (
  SELECT source_id, runs, dur, {pct('ok', 'runs')} AS reliability, {pct('eligible', 'parsed')} AS fresh_yield, {pct('uniq', 'eligible')} AS unique_yield, {pct('selected', 'uniq')} AS selection_value, {pct('confirmed', 'uniq')} AS confirmation_value,
         CAST(greatest(0, least(100, floor(CAST(value AS DOUBLE) / greatest(1, selected) * 25 + 0.5))) AS BIGINT) AS reader_value FROM sums), labelled AS (
  SELECT *, CASE WHEN runs < 5 THEN 'Collecting data' WHEN reliability < 75 THEN 'Often unavailable' WHEN fresh_yield < 10 THEN 'Low fresh yield' WHEN selection_value >= 35 THEN 'Often selected' WHEN confirmation_value >= 35 THEN 'Useful confirmation' WHEN reliability >= 95 THEN 'Reliable' ELSE 'Needs review' END AS label FROM rates), quality AS (
  SELECT *, CASE WHEN runs >= 8 AND reliability < 40 THEN 'consider_pausing' WHEN label IN ('Needs review','Low fresh yield','Often unavailable') THEN 'review' ELSE 'keep' END AS recommendation FROM labelled)"""
SCORED = f"""{QUALITY}, catalog AS (
  SELECT *, CAST(regexp_extract(source_id, '([0-9]+)$', 1) AS INT) AS n FROM quality), modes AS (
  SELECT *, ['geopolitics','business','ai','software','security'][n % 5 + 1] AS feed, CASE WHEN n % 11 = 3 THEN 'always_on' WHEN n % 13 = 5 THEN 'blocked' ELSE 'auto' END AS mode FROM catalog), needs AS (
  SELECT *, CASE WHEN count(*) FILTER (mode = 'always_on') OVER (PARTITION BY feed) < 2 THEN 100 ELSE 40 END AS category_need, least(1.0, runs / 10.0) AS confidence,
         greatest(0, (50 - unique_yield) * 0.2) AS red, least(15, greatest(0, (100 - reliability) * 0.1::DOUBLE + dur / 10000)) AS pen, runs % 7 AS healthy_probes FROM modes), scored AS (
  SELECT *, round(CAST(confidence AS DOUBLE) * (0.2::DOUBLE * reliability + 0.1::DOUBLE * fresh_yield + 0.2::DOUBLE * unique_yield + 0.15::DOUBLE * confirmation_value + 0.1::DOUBLE * selection_value + 0.15::DOUBLE * reader_value + 0.1::DOUBLE * category_need - CAST(red AS DOUBLE) - CAST(pen AS DOUBLE)) + (1 - CAST(confidence AS DOUBLE)) * 50, 3) AS score FROM needs)"""
SUMMARY = f"""{OBSERVATIONS}, summary AS (
  SELECT run_id, count(*) AS sources, count(DISTINCT CAST(regexp_extract(source_id, '([0-9]+)$', 1) AS INT) % 5) FILTER (succeeded AND unique_stories > 0) AS coverage, round(avg(CASE WHEN succeeded THEN 0.0 ELSE 1.0 END), 6) AS failure_rate,
         round(coalesce(max(selected)::DOUBLE / nullif(sum(selected), 0), 0.0), 6) AS concentration, CAST(sum(selected) AS BIGINT) AS unique_selected FROM observations GROUP BY run_id)"""
JUDGED = f"""{STORIES}, judged AS (
  SELECT *, (source_count >= 3 OR contains(s, ' edor ')) AS is_major, {hits(['ones', *BUILD], 's')} > 0 AS is_developer, contains(s, ' with ') AS is_relevant, contains(s, ' eatat ') AS excluded, article_id * 7 % 31 - 15 AS preference FROM stories), reasoned AS (
  SELECT *, list_filter([CASE WHEN excluded THEN 'excluded_keyword' END, CASE WHEN article_id % 9 = 0 THEN 'unreadable' END, CASE WHEN age > 168 THEN 'stale' END, CASE WHEN source_count < 2 THEN 'insufficient_sources' END, CASE WHEN editorial < 45 THEN 'below_importance' END, CASE WHEN novelty <= 2 THEN 'insufficient_novelty' END, CASE WHEN feed = 'security' AND NOT is_major AND NOT is_developer THEN 'security_relevance' END], lambda x: x IS NOT NULL) AS reasons,
         CASE feed WHEN 'geopolitics' THEN CASE WHEN is_relevant THEN 10 ELSE -12 END WHEN 'business' THEN 6 WHEN 'security' THEN CASE WHEN is_major THEN 16 WHEN is_developer THEN 5 ELSE -25 END ELSE 0 END AS feed_adjustment FROM judged)"""
DEDUPE = rf"list_filter(list_transform(string_split(trim(regexp_replace(regexp_replace(lower(TEXT), '[^\p{{L}}\p{{N}}\s-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: regexp_replace(w, '^-+|-+$', '', 'g')), lambda w: length(w) > 2 AND NOT list_contains({STOP}, w))"
# accents that NFKD takes apart in the given languages
PLAIN_LETTERS = "strip_accents(TEXT)"


def dedupe_tokens(text: str) -> str:
    return "list_distinct(" + DEDUPE.replace("TEXT", PLAIN_LETTERS.replace("TEXT", text)) + ")"


#: Profiles, keys and decisions of pairs, as in the rules of near-duplicate stories.
TOKEN_ROWS = DEDUPE.replace("TEXT", PLAIN_LETTERS.replace("TEXT", "COLUMN"))
PAIRS = f"""{TEXTS}, raw AS (SELECT article_id, feed, published_epoch, CASE WHEN article_id % 3 = 0 THEN 'https://example.com/' || md5(title) ELSE '' END AS url, {TOKEN_ROWS.replace("COLUMN", "title")} AS tl, {TOKEN_ROWS.replace("COLUMN", "text")} AS xl FROM texts),
prof AS (SELECT article_id, feed, published_epoch, url, list_distinct(tl) AS tt, list_distinct(xl) AS xt, array_to_string(list_sort(list_distinct(tl))[1:12], ' ') AS fp FROM raw),
hashed AS (SELECT article_id, ('0x' || substr(sha256(t), 1, 8))::BIGINT AS h FROM (SELECT article_id, unnest(xt) AS t FROM prof)),
bits AS (SELECT article_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS w FROM hashed, range(32) r(i) GROUP BY ALL),
sims AS (SELECT p.article_id, CAST(coalesce(sum(CASE WHEN w > 0 THEN 1::BIGINT << i ELSE 0 END), 0) AS BIGINT) AS simhash FROM prof p LEFT JOIN bits b ON p.article_id = b.article_id GROUP BY p.article_id),
placed AS (SELECT article_id, feed, 't' AS k, t, min(i) AS i FROM (SELECT article_id, feed, unnest(tl) AS t, generate_subscripts(tl, 1) AS i FROM raw) GROUP BY ALL
  UNION ALL SELECT article_id, feed, 'x', t, min(i) FROM (SELECT article_id, feed, unnest(xl) AS t, generate_subscripts(xl, 1) AS i FROM raw) WHERE regexp_matches(t, '[0-9]') OR length(t) >= 7 GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY article_id, k ORDER BY CASE WHEN k = 't' THEN CASE WHEN regexp_matches(t, '[0-9]') THEN 0 ELSE 1 END END, CASE WHEN k = 't' THEN -length(t) END, i) AS n FROM placed),
keyed AS (SELECT article_id, CASE k WHEN 't' THEN 'title:' ELSE 'anchor:' END || feed || ':' || t AS key FROM numbered WHERE n <= CASE k WHEN 't' THEN 8 ELSE 4 END
  UNION SELECT article_id, 'fingerprint:' || fp FROM prof WHERE fp <> ''),
keys AS (SELECT * FROM keyed UNION SELECT article_id, 'feed:' || feed FROM prof WHERE len(tt) < 2 OR article_id NOT IN (SELECT article_id FROM keyed)),
met AS (SELECT DISTINCT a.article_id AS l, b.article_id AS r FROM keys a JOIN keys b ON a.key = b.key AND a.article_id < b.article_id),
told AS (SELECT l, r, a.url AS lu, b.url AS ru, a.fp AS lf, b.fp AS rf, a.feed = b.feed AS same_feed, abs(a.published_epoch - b.published_epoch) > 345600 AS far, len(a.tt) AS nlt, len(b.tt) AS nrt, len(list_intersect(a.tt, b.tt)) AS nt,
  len(a.xt) AS nlx, len(b.xt) AS nrx, list_intersect(a.xt, b.xt) AS shared, bit_count(xor(c.simhash, e.simhash)) AS bits
  FROM met JOIN prof a ON a.article_id = l JOIN prof b ON b.article_id = r JOIN sims c ON c.article_id = l JOIN sims e ON e.article_id = r),
rated AS (SELECT *, CASE WHEN nlt + nrt - nt = 0 THEN 1.0::DOUBLE ELSE nt::DOUBLE / (nlt + nrt - nt) END AS tj, CASE WHEN nlx + nrx - len(shared) = 0 THEN 1.0::DOUBLE ELSE len(shared)::DOUBLE / (nlx + nrx - len(shared)) END AS xj,
  CASE WHEN least(nlt, nrt) = 0 THEN 0.0::DOUBLE ELSE nt::DOUBLE / least(nlt, nrt) END AS cont, len(list_filter(shared, lambda w: regexp_matches(w, '[0-9]') OR length(w) >= 7)) AS anchors FROM told),
scored_pairs AS (SELECT *, greatest(0.58::DOUBLE * tj + 0.27::DOUBLE * xj + 0.15::DOUBLE * (1 - bits / 32::DOUBLE), 0.7::DOUBLE * cont + 0.3::DOUBLE * xj) AS s FROM rated),
pairs AS (SELECT l AS left_id, r AS right_id, bits, CASE WHEN lu <> '' AND lu = ru THEN 'canonical_url' WHEN far THEN 'outside_time_window' WHEN lf <> '' AND lf = rf AND nlt >= 3 THEN 'title_fingerprint' WHEN tj >= 0.72::DOUBLE AND xj >= 0.18::DOUBLE THEN 'title_and_text_overlap'
  WHEN cont >= 0.82::DOUBLE AND xj >= 0.25::DOUBLE THEN 'title_containment' WHEN bits <= 4 AND xj >= 0.3::DOUBLE THEN 'simhash' WHEN s >= 0.58::DOUBLE AND (same_feed OR anchors >= 2) THEN 'weighted_similarity' WHEN tj >= 0.35::DOUBLE AND xj >= 0.22::DOUBLE AND anchors >= 2 THEN 'anchored_overlap' ELSE 'below_threshold' END AS reason,
  CASE WHEN lu <> '' AND lu = ru THEN 1.0::DOUBLE WHEN far THEN 0.0::DOUBLE WHEN lf <> '' AND lf = rf AND nlt >= 3 THEN greatest(s, 0.95::DOUBLE) ELSE s END AS score FROM scored_pairs)"""
FEEDBACK_STOP = "['" + "','".join("about after also amid from have into more over said that their this with will would your oraz jest jako przez tego tych dla się".split()) + "']"


def keyword_list(text: str) -> str:
    """The words that feedback speaks of, each once, in no order."""
    return rf"list_distinct(list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 4 AND NOT list_contains({FEEDBACK_STOP}, w)))"


#: White space of every kind.
WHITE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WHITE}', ' ', 'g'))"


def decoded(text: str) -> str:
    """Character references as characters: numbers up to 255 and six names."""
    bare = f"replace(replace({text}, '<![CDATA[', ''), ']]>', '')"
    code = "(CASE WHEN lower(r[3:3]) = 'x' THEN ('0x' || r[4:-2])::BIGINT ELSE r[3:-2]::BIGINT END)"
    out = rf"list_reduce(list_prepend({bare}, list_distinct(regexp_extract_all({bare}, '(?i)&#(?:\d{{1,7}}|x[0-9a-f]{{1,6}});'))), lambda a, r: CASE WHEN {code} BETWEEN 1 AND 255 AND {code} <> 38 THEN replace(a, r, chr(CAST({code} AS INT))) ELSE a END)"
    for name, char in (("gt", ">"), ("lt", "<"), ("nbsp", " "), ("quot", '"'), ("apos", "''")):
        out = f"regexp_replace({out}, '(?i)&{name};', '{char}', 'g')"
    return f"regexp_replace({out}, '(?i)&(?:amp|#0*38|#x0*26);', '&', 'g')"


def plain(name: str, source: str, column: str, keep: str) -> str:
    """CTEs that end in name(keep, plain): a column of source without tags and references, with single spaces."""
    return f"{name}_a AS (SELECT {keep}, regexp_replace({decoded(column)}, '<[^>]+>', ' ', 'g') AS x FROM {source}), {name}_b AS (SELECT {keep}, regexp_replace({decoded('x')}, '<[^>]+>', ' ', 'g') AS x FROM {name}_a), {name} AS (SELECT {keep}, {squeezed('x')} AS plain FROM {name}_b)"


def _without(column: str) -> str:
    for tag in "script style nav footer header aside form button svg noscript template".split():
        column = rf"regexp_replace({column}, '(?is)<{tag}\b.*?</{tag}>', ' ', 'g')"
    return column


def _bodies(tag: str, n: int) -> str:
    found = rf"regexp_extract_all(html, '(?is)<{tag}\b[^>]*>(.*?)</{tag}>', 1)"
    return f"SELECT page_id, {n} AS tag, unnest({found}) AS x0, generate_subscripts({found}, 1) AS i FROM cut"


BLOCKS = r"regexp_extract_all(content, '(?is)<(?:h[1-6]|p|li|blockquote)\b[^>]*>(.*?)</(?:h[1-6]|p|li|blockquote)>', 1)"
PARAGRAPHS = r"regexp_extract_all(content, '(?is)<p\b[^>]*>(.*?)</p>', 1)"
WALL = r"(?i)(?:subscribe|sign in|log in|register)\s+(?:now\s+)?to\s+(?:continue|keep reading|read|unlock)|already (?:a )?subscriber|subscriber-only|dla subskrybentów|zaloguj się,? aby|wykup (?:dostęp|subskrypcję)"
AUDIO = r"""(?i)<audio\b|type=["'']audio/|(?:spotify|soundcloud|megaphone|omny|podbean|audioboom)\.com|(?:audio|podcast)[-_ ]player|data-audio"""
VIDEO = r"""(?i)<video\b|type=["'']video/|(?:youtube|youtu\.be|vimeo)\.com|(?:video)[-_ ]player|data-video"""
READABLE = f"""cut AS (SELECT page_id, {_without('html')} AS html FROM pages), bodies AS ({_bodies('article', 1)} UNION ALL {_bodies('main', 2)} UNION ALL {_bodies('body', 3)}), {plain('bp', 'bodies', 'x0', 'page_id, tag, i, x0')},
best AS (SELECT page_id, tag, x0 FROM (SELECT *, row_number() OVER (PARTITION BY page_id, tag ORDER BY length(plain) DESC, i) AS n FROM bp) WHERE n = 1 AND x0 <> ''),
content AS (SELECT cut.page_id, coalesce(min_by(best.x0, best.tag), any_value(cut.html)) AS content FROM cut LEFT JOIN best ON cut.page_id = best.page_id GROUP BY cut.page_id),
blocks AS (SELECT page_id, unnest({BLOCKS}) AS x1, generate_subscripts({BLOCKS}, 1) AS i FROM content), {plain('kp', 'blocks', 'x1', 'page_id, i')}, joined AS (SELECT page_id, string_agg(plain, chr(10) || chr(10) ORDER BY i) AS text FROM kp WHERE plain <> '' GROUP BY page_id),
paras AS (SELECT page_id, unnest({PARAGRAPHS}) AS x2 FROM content), {plain('pp', 'paras', 'x2', 'page_id')}, counted AS (SELECT page_id, count(*) FILTER (length(plain) >= 40) AS n FROM pp GROUP BY page_id), {plain('cp', 'content', 'content', 'page_id')},
read AS (SELECT p.page_id, substr(coalesce(j.text, cp.plain), 1, 200000) AS text, coalesce(c.n, 0) AS paragraphs, regexp_matches(cp.plain, '{WALL}') AS wall, regexp_matches(p.html, '{AUDIO}') AS audio, regexp_matches(p.html, '{VIDEO}') AS video FROM pages p JOIN cp ON cp.page_id = p.page_id LEFT JOIN joined j ON j.page_id = p.page_id LEFT JOIN counted c ON c.page_id = p.page_id),
words AS (SELECT *, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS w FROM read)""".replace("\\\\p", "\\p")

BASIS = f"""{TEXTS}, basis AS (
  SELECT l.doc_id % 10 AS user_id, l.doc_id % 150 AS story_id, t.feed, t.title, lower(t.source) AS source, CASE WHEN quality = 1 THEN 'more' ELSE 'less' END AS sentiment,
         CASE WHEN toxic = 1 THEN 'quality' WHEN l.doc_id % 4 = 1 THEN 'topic' WHEN l.doc_id % 4 = 2 THEN 'source' WHEN l.doc_id % 4 = 3 AND quality = 0 THEN 'repetitive' END AS reason,
         pow(0.5, greatest((1706659200 - published_epoch) / 86400.0, 0) / 45) AS w
  FROM labels l JOIN texts t ON l.doc_id = t.article_id)"""

PROFILE = f"""{BASIS}, routed AS (SELECT user_id, 'source' AS kind, source AS key, sentiment, w FROM basis WHERE reason IS NULL OR reason IN ('source','quality') UNION ALL SELECT user_id, 'feed', feed, sentiment, w FROM basis WHERE reason IS NULL OR reason = 'topic'
  UNION ALL SELECT user_id, 'keyword', unnest({keyword_list('title')}), sentiment, w FROM basis WHERE reason IS NULL OR reason = 'topic' UNION ALL SELECT user_id, 'story', CAST(story_id AS VARCHAR), sentiment, w FROM basis WHERE reason = 'repetitive' AND sentiment = 'less'),
profile AS (SELECT user_id, kind, key, sum(CASE WHEN sentiment = 'more' THEN w ELSE 0 END) AS more, sum(CASE WHEN sentiment = 'less' THEN w ELSE 0 END) AS less FROM routed GROUP BY ALL)"""
PREFERRED = f"""{STORIES.replace(TEXTS, PROFILE, 1)}, mine AS (SELECT u AS user_id, article_id AS item_id, article_id % 150 AS story_id, lower(source) AS source, feed, title, editorial, published_epoch, age FROM stories, range(10) r(u)),
wanted AS (SELECT user_id, item_id, 'source' AS kind, source AS key FROM mine UNION ALL SELECT user_id, item_id, 'feed', feed FROM mine UNION ALL SELECT user_id, item_id, 'story', CAST(story_id AS VARCHAR) FROM mine UNION ALL SELECT user_id, item_id, 'keyword', unnest({keyword_list('title')}) FROM mine),
found AS (SELECT w.user_id, w.item_id, bool_or(w.kind = 'story' AND less IS NOT NULL) AS blocked, {", ".join(f"coalesce(sum({c} * {f}.0::DOUBLE) FILTER (w.kind = '{k}'), 0) AS {k}_{c}" for k, c, f in (("source", "more", 5), ("source", "less", 8), ("feed", "more", 3), ("feed", "less", 5), ("keyword", "more", 2), ("keyword", "less", 3)))} FROM wanted w LEFT JOIN profile p ON p.user_id = w.user_id AND p.kind = w.kind AND p.key = w.key GROUP BY ALL),
preferred AS (SELECT m.*, CASE WHEN blocked THEN -20.0::DOUBLE ELSE 0.0::DOUBLE END + least(5, source_more) - least(8, source_less) + least(3, feed_more) - least(5, feed_less) + least(12, keyword_more) - least(16, keyword_less) AS preference, {FRESH} AS freshness, CASE WHEN m.item_id % 3 = 0 THEN 4 ELSE 0 END AS upd FROM mine m JOIN found f ON f.user_id = m.user_id AND f.item_id = m.item_id)"""
CATEGORY_WORDS = {
    "Cybersecurity": ["security", "vulnerability", "cyber", "breach", "cve", "ransomware"],
    "AI / Technology": ["artificial intelligence", " ai ", "llm", "model", "openai", "machine learning"],
    "Business / Markets": ["business", "market", "economy", "finance", "earnings", "bank"],
    "World / Geopolitics": ["world", "government", "war", "europe", "china", "policy", "election"],
    "Software / Engineering": ["software", "developer", "github", "release", "framework", "cloud"],
}
METADATA = squeezed(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(s.plain, '(?i)\bArticle URL:\s+\S+', ' ', 'g'), '(?i)\bComments URL:\s+\S+', ' ', 'g'), '(?i)\bPoints:\s+\d+', ' ', 'g'), '(?i)#\s*Comments:\s+\d+', ' ', 'g')")
NOTES = "notes AS (SELECT conv_id * 100 + turn AS note_id, conv_id % 10 AS user_id, ['knowledge', 'research', 'thought'][turn % 3 + 1] AS kind, CASE WHEN turn % 2 = 0 THEN 'open' ELSE 'done' END AS status, coalesce(text, '') AS note_text, coalesce(role, '') AS title, conv_id * 7 + turn AS updated_epoch FROM conversations)"

ORACLE = {
    "editorial_topn": f"WITH {STORIES} SELECT article_id, feed, impact, confirmation, scope, action, urgency, novelty, editorial, row_number() OVER (ORDER BY editorial DESC, article_id) - 1 AS selection_rank FROM stories ORDER BY editorial DESC, article_id LIMIT 50",
    "editorial_scores": f"WITH {STORIES} SELECT article_id, feed, CAST(impact AS BIGINT) AS impact, CAST(confirmation AS BIGINT) AS confirmation, CAST(scope AS BIGINT) AS scope, CAST(action AS BIGINT) AS action, CAST(urgency AS BIGINT) AS urgency, CAST(novelty AS BIGINT) AS novelty, editorial FROM stories",
    "keyword_match": f"WITH {TEXTS} SELECT article_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(s, ' {w} ') THEN '{w}' END" for w in IMPORTANT) + f"], lambda x: x IS NOT NULL), ',') AS found, CAST({hits(IMPORTANT, 's')} AS BIGINT) AS n_found FROM spaced",
    "feed_category": f"WITH {ARTICLES} SELECT article_id, category, feed FROM articles",
    "feed_counts": f"WITH {ARTICLES} SELECT feed, count(*) AS n_articles, count(DISTINCT source) AS n_sources FROM articles GROUP BY feed",
    "feed_totals_rollup": f"WITH {ARTICLES} SELECT coalesce(feed, 'all') AS feed, count(*) AS n, count(*) FILTER (priority >= 3) AS n_high FROM articles GROUP BY ROLLUP (feed)",
    "text_compact": rf"WITH {TEXTS}, flat AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM texts) SELECT article_id, CASE WHEN length(t) > 60 THEN trim(substr(t, 1, 59)) || '...' ELSE t END AS short, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS n_words FROM flat",
    "feedback_keywords": rf"WITH {TEXTS}, w AS (SELECT article_id, unnest({TOKENS}) AS w, generate_subscripts({TOKENS}, 1) AS i FROM texts), f AS (SELECT article_id, w, min(i) AS i FROM w WHERE length(w) >= 4 AND NOT list_contains({FEEDBACK_STOP}, w) GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY i) AS n FROM f) SELECT t.article_id, coalesce(string_agg(w, ' ' ORDER BY n) FILTER (n <= 40), '') AS words FROM texts t LEFT JOIN n ON n.article_id = t.article_id GROUP BY t.article_id",
    "title_fingerprint": f"WITH {ARTICLES} SELECT article_id, array_to_string(list_sort({dedupe_tokens('title')})[1:12], ' ') AS fingerprint FROM articles",
    "simhash32": f"WITH {TEXTS}, toks AS (SELECT article_id, unnest({dedupe_tokens('text')}) AS t FROM texts), h AS (SELECT article_id, ('0x' || substr(sha256(t), 1, 8))::BIGINT AS h FROM toks), bits AS (SELECT article_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS w FROM h, range(32) r(i) GROUP BY ALL) SELECT t.article_id, CAST(coalesce(sum(CASE WHEN w > 0 THEN 1::BIGINT << i ELSE 0 END), 0) AS BIGINT) AS simhash FROM texts t LEFT JOIN bits b ON t.article_id = b.article_id GROUP BY t.article_id",
    "title_similarity": f"WITH {ARTICLES}, p AS (SELECT article_id, source, category, {dedupe_tokens('title')} AS t FROM articles), j AS (SELECT article_id AS left_id, lead(article_id) OVER w AS right_id, t, lead(t) OVER w AS u FROM p WINDOW w AS (PARTITION BY source, category ORDER BY article_id)), k AS (SELECT left_id, right_id, len(t) AS na, len(u) AS nb, len(list_intersect(t, u)) AS n FROM j WHERE right_id IS NOT NULL) SELECT left_id, right_id, round(CASE WHEN na + nb - n = 0 THEN 1.0::DOUBLE ELSE n::DOUBLE / (na + nb - n) END, 6) AS jaccard, round(CASE WHEN least(na, nb) = 0 THEN 0.0::DOUBLE ELSE n::DOUBLE / least(na, nb) END, 6) AS containment FROM k",
    "exact_dup_groups": "SELECT md5(coalesce(text, '')) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "url_dedupe_best": f"WITH {ARTICLES} SELECT canonical_url, article_id, first_seen FROM (SELECT article_id % 200 AS canonical_url, article_id, min(article_id) OVER (PARTITION BY article_id % 200) AS first_seen, row_number() OVER (PARTITION BY article_id % 200 ORDER BY length(summary) DESC, article_id) AS n FROM articles) WHERE n = 1",
    "url_normalize": r"WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages), p AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\?(.*)$', 1) AS q FROM u), k AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','ref','fbclid','gclid','mc_cid','mc_eid','at_campaign','at_medium'], lower(string_split(x, '=')[1]))), '&') AS kept FROM p) SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical_url, regexp_extract(host, '^([^:]+)', 1) AS host FROM k",
    "page_language": """SELECT page_id, regexp_extract(html, '<html[^>]*lang=.([a-z]+)', 1) AS lang, CAST(NULL AS VARCHAR) AS feed_kind, CAST(0 AS BIGINT) AS n_feeds FROM pages""",
    "warsaw_recency": f"WITH {ARTICLES}, d AS (SELECT CAST(timezone('Europe/Warsaw', to_timestamp(published_epoch)) AS DATE) AS day FROM articles) SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, bool_or(day BETWEEN DATE '2024-01-30' AND DATE '2024-01-31') AS kept FROM d GROUP BY 1",
    "item_state_join": f"WITH {ITEMS}, notes AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT i.article_id, i.feed, i.read, i.saved, i.archived, CASE l.quality WHEN 1 THEN 'more' WHEN 0 THEN 'less' END AS feedback, coalesce(n.n, 0) AS n_notes FROM items i LEFT JOIN labels l ON i.article_id = l.doc_id LEFT JOIN notes n ON n.conv_id = i.article_id",
    "anti_expired": f"WITH {ITEMS} SELECT article_id FROM items WHERE published_epoch < 1706659200 - 5 * 86400 AND NOT saved AND article_id NOT IN (SELECT conv_id FROM conversations)",
    "semi_probe_health": f"WITH {OBSERVATIONS} SELECT source_id, count(*) AS healthy_probes FROM observations o WHERE parsed % 5 = 0 AND EXISTS (SELECT 1 FROM observations s WHERE s.succeeded AND s.run_id = o.run_id AND s.source_id = o.source_id) GROUP BY source_id",
    "latest_tags_distinct_on": f"WITH {INTERACTIONS} SELECT DISTINCT ON (story_id) story_id, event_id, event_type FROM interactions ORDER BY story_id, epoch DESC, event_id DESC",
    "last30_per_key": f"WITH {OBSERVATIONS} SELECT source_id, count(*) AS runs, min(run_id) AS first_run, CAST(sum(parsed) AS BIGINT) AS parsed FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY run_id DESC) AS n FROM observations) WHERE n <= 30 GROUP BY source_id",
    "first_last_by_time": f"WITH {INTERACTIONS} SELECT story_id, event_type, min(epoch) AS first_epoch, max(epoch) AS last_epoch, first(event_id ORDER BY epoch, event_id) AS first_id, last(event_id ORDER BY epoch, event_id) AS last_id, bool_or(coalesce(origin = 'direct', false)) AS any_direct FROM interactions GROUP BY ALL",
    "merge_upsert": "WITH n AS (SELECT c_custkey + 1000 AS id, c_acctbal + 1 AS value FROM customer WHERE c_custkey % 3 = 0) SELECT c_custkey AS id, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT id FROM n) UNION ALL SELECT id, value FROM n",
    "merge_newest": "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id",
    "insert_ignore": f"WITH {INTERACTIONS}, k AS (SELECT event_id, CASE WHEN event_type = 'impression' THEN user_id || ':' || context_id || ':' || story_id END AS impression_key FROM interactions), o AS (SELECT * FROM k WHERE event_id < 1000) SELECT * FROM o UNION ALL SELECT min(event_id) AS event_id, impression_key FROM k WHERE event_id >= 1000 AND impression_key IS NOT NULL AND impression_key NOT IN (SELECT impression_key FROM o WHERE impression_key IS NOT NULL) GROUP BY impression_key UNION ALL SELECT * FROM k WHERE event_id >= 1000 AND impression_key IS NULL",
    "merge_keep_first": f"WITH {INTERACTIONS}, a AS (SELECT story_id, min(epoch) AS f, max(epoch) AS l FROM interactions WHERE event_id < 5000 GROUP BY 1), b AS (SELECT story_id, min(epoch) AS f, max(epoch) AS l FROM interactions WHERE event_id >= 5000 GROUP BY 1) SELECT coalesce(a.story_id, b.story_id) AS story_id, coalesce(a.f, b.f) AS first_seen, coalesce(b.l, a.l) AS last_seen FROM a FULL JOIN b ON a.story_id = b.story_id",
    "monotone_counts": f"WITH {INTERACTIONS}, a AS (SELECT story_id, count(DISTINCT user_id) AS n FROM interactions WHERE event_id < 3000 GROUP BY 1), b AS (SELECT story_id, count(DISTINCT user_id) AS n FROM interactions WHERE event_id >= 3000 GROUP BY 1) SELECT story_id, max(n) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY story_id",
    "set_operations": f"WITH {INTERACTIONS}, a AS (SELECT DISTINCT story_id, user_id FROM interactions WHERE policy = 'v1'), b AS (SELECT DISTINCT story_id, user_id FROM interactions WHERE policy = 'v2') SELECT story_id, count(*) AS n, 'both' AS kind FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY 1 UNION ALL SELECT story_id, count(*), 'added' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY 1 UNION ALL SELECT story_id, count(*), 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) GROUP BY 1 UNION ALL SELECT story_id, count(*), 'any' FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY 1",
    "note_search": f"WITH {NOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_epoch DESC, note_id DESC) AS n FROM notes WHERE status = 'open') SELECT note_id, user_id FROM r WHERE n <= 500 AND contains(lower(note_text || ' ' || title || ' src'), 'with')",
    "note_pages": f"WITH {NOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_epoch DESC, note_id DESC) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS c FROM notes) SELECT note_id, user_id FROM r WHERE n // 30 = least(2, ceil(c / 30)) - 1",
    "constraint_violations": f"""WITH {ARTICLES}, {NOTES}, a AS (SELECT count(*) FILTER (article_id % 120 - 5 < 0 OR article_id % 120 - 5 > 100) AS i, count(*) FILTER (article_id % 11 = 0) AS b, count(*) FILTER (article_id % 13 = 0) AS u, count(*) FILTER (article_id % 7 = 0) AS p FROM articles),
n AS (SELECT count(*) FILTER (note_id % 17 = 0) AS k, count(*) FILTER (note_id % 5 = 0 OR trim(note_text) = '') AS c, count(*) FILTER (note_id % 5 <> 0 AND length(note_text) > 10000) AS l FROM notes)
SELECT unnest(['news_items.importance_score', 'sources.name', 'sources.category', 'sources.feed_url', 'sources.priority', 'sources.selection_mode', 'notes.kind', 'notes.status', 'notes.content', 'notes.note_length', 'notes.quote_length']) AS constraint, unnest([i, b, 0, u, p, 0, k, 0, c, l, 0]) AS n FROM a, n""",
    "engagement": f"WITH {INTERACTIONS}, seen AS ({SEEN}), acted AS ({ACTED}), j AS (SELECT coalesce(seen.policy, acted.policy) AS policy, seen.rank IS NOT NULL AS shown, o, s, f FROM seen FULL JOIN acted ON seen.context_id = acted.context_id AND seen.story_id = acted.story_id AND seen.policy = acted.policy), n AS (SELECT policy, count(*) FILTER (shown) AS impressions, CAST(coalesce(sum(o) FILTER (shown), 0) AS BIGINT) AS opened, CAST(coalesce(sum(s) FILTER (shown), 0) AS BIGINT) AS saved, CAST(coalesce(sum(f) FILTER (shown), 0) AS BIGINT) AS answered, count(*) FILTER (NOT shown) AS unattributed FROM j GROUP BY policy) SELECT *, {pct('opened', 'impressions')} AS opened_pct, {pct('saved', 'impressions')} AS saved_pct, {pct('answered', 'impressions')} AS answered_pct FROM n",
    "rank_buckets": f"WITH {INTERACTIONS}, seen AS ({SEEN}), o AS (SELECT DISTINCT context_id, story_id, policy, 1 AS hit FROM interactions WHERE event_type = 'source_open' AND coalesce(origin, 'direct') = 'direct') SELECT CASE WHEN rank < 5 THEN '1-5' WHEN rank < 10 THEN '6-10' ELSE '11+' END AS bucket, count(*) AS impressions, CAST(sum(coalesce(hit, 0)) AS BIGINT) AS opens FROM seen LEFT JOIN o USING (context_id, story_id, policy) GROUP BY 1",
    "event_problems": f"WITH {INTERACTIONS}, b AS (SELECT session_id, count(*) AS n, count(*) FILTER (event_id % 211 = 0 OR event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 101 = 0 OR event_id % 103 = 0 OR event_id % 107 = 0 OR event_id % 109 = 0 OR event_id % 113 = 0 OR event_id % 127 = 0 OR event_id % 131 = 0) AS n_bad FROM interactions GROUP BY session_id) SELECT *, n <= 100 AND n_bad = 0 AS accepted FROM b",
    "top_ignored": f"WITH {INTERACTIONS} SELECT story_id, count(*) AS n FROM interactions i WHERE event_type = 'impression' AND NOT EXISTS (SELECT 1 FROM interactions o WHERE o.event_type = 'source_open' AND o.user_id = i.user_id AND o.story_id = i.story_id) GROUP BY story_id ORDER BY n DESC, story_id LIMIT 5",
    "unread_after_day": f"WITH {ITEMS} SELECT count(*) AS n_unread FROM items WHERE published_epoch < 1706659200 - 86400 AND NOT read AND NOT archived",
    "implicit_events": f"WITH {INTERACTIONS}, w AS (SELECT *, CASE event_type WHEN 'fast_read' THEN 0.5::DOUBLE WHEN 'read' THEN 1.25::DOUBLE WHEN 'save' THEN 2.0::DOUBLE WHEN 'source_open' THEN 0.75::DOUBLE END AS weight FROM interactions WHERE coalesce(origin, 'direct') = 'direct'), a AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id, story_id ORDER BY weight DESC, event_id) AS n FROM w WHERE weight IS NOT NULL), b AS (SELECT * EXCLUDE n, row_number() OVER (PARTITION BY user_id, day, story_id ORDER BY weight DESC, event_id) AS n FROM a WHERE n = 1) SELECT event_id, user_id, story_id, event_type, weight FROM b WHERE n = 1",
    "behavioural_signals": f"WITH {INTERACTIONS}, w AS (SELECT user_id, story_id, CASE event_type WHEN 'save' THEN 0.8::DOUBLE WHEN 'read' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END AS w, CASE event_type WHEN 'save' THEN 0.85::DOUBLE WHEN 'read' THEN 0.65::DOUBLE ELSE 0.6::DOUBLE END AS c FROM interactions WHERE event_type IN ('save','read','source_open') AND coalesce(origin, 'direct') = 'direct') SELECT user_id, story_id, max(w) AS weight, max(c) AS confidence FROM w GROUP BY ALL",
    "preference_profile": f"WITH {BASIS}, r AS (SELECT user_id, 'source' AS kind, source AS key, sentiment, w FROM basis WHERE reason IS NULL OR reason IN ('source','quality') UNION ALL SELECT user_id, 'feed', feed, sentiment, w FROM basis WHERE reason IS NULL OR reason = 'topic' UNION ALL SELECT user_id, 'keyword', unnest({keyword_list('title')}), sentiment, w FROM basis WHERE reason IS NULL OR reason = 'topic' UNION ALL SELECT user_id, 'story', CAST(story_id AS VARCHAR), sentiment, w FROM basis WHERE reason = 'repetitive' AND sentiment = 'less') SELECT user_id, kind, key, round(sum(CASE WHEN sentiment = 'more' THEN w ELSE 0 END), 6) AS more, round(sum(CASE WHEN sentiment = 'less' THEN w ELSE 0 END), 6) AS less FROM r GROUP BY ALL",
    "rank_top": f"WITH {PLAIN} SELECT item_id, row_number() OVER (ORDER BY editorial DESC, item_id) - 1 AS model_rank FROM plain",
    "rank_latest": f"WITH {PLAIN} SELECT item_id, row_number() OVER (ORDER BY published_epoch DESC, item_id) - 1 AS model_rank FROM plain",
    "rank_plain_v1": f"WITH {PLAIN} SELECT item_id, editorial + preference + freshness + upd AS rank_score, row_number() OVER (ORDER BY editorial + preference + freshness + upd DESC, item_id) - 1 AS model_rank FROM plain",
    "feed_sections": f"WITH {PLAIN}, a AS (SELECT item_id, position, position >= 5 AND item_id % 5 = 0 AS act FROM v2), b AS (SELECT *, act AND sum(CAST(act AS INT)) OVER (ORDER BY position) <= 5 AS actionable FROM a), c AS (SELECT *, sum(CASE WHEN position >= 5 AND NOT actionable THEN 1 ELSE 0 END) OVER (ORDER BY position) AS n FROM b) SELECT item_id, position, CASE WHEN position < 5 THEN 'top' WHEN actionable THEN 'actionable' WHEN n <= 10 THEN 'next' ELSE 'rest' END AS section FROM c",
    "feed_page": f"WITH {PLAIN}, s AS (SELECT coalesce(max(position) + 1, 0) AS start FROM v2 WHERE item_id = 42) SELECT item_id, position FROM v2, s WHERE position >= start AND position < start + 30",
    "facet_counts": f"WITH {ITEMS} SELECT feed, count(*) FILTER (NOT archived) AS n_all, count(*) FILTER (NOT archived AND NOT read) AS n_unread, count(*) FILTER (saved AND NOT archived) AS n_saved, count(*) FILTER (archived) AS n_archived FROM items GROUP BY feed",
    "period_latest": f"""WITH {ITEMS}, d AS (SELECT *, strftime(make_timestamp(published_epoch * 1000000), '%Y-%m-%d') AS day, published_epoch > 1706659200 - 259200 OR (article_id % 4 = 0 AND published_epoch + 86400 > 1706659200 - 259200) AS fresh FROM items),
v AS (SELECT 'all' AS view, * FROM d WHERE NOT archived UNION ALL SELECT 'unread', * FROM d WHERE NOT archived AND NOT read UNION ALL SELECT 'saved', * FROM d WHERE NOT archived AND saved)
SELECT view || ' ' || p AS shown, feed, count(*) AS n FROM v, (SELECT unnest(['latest', 'since-visit', 'history']) AS p) WHERE view = 'saved' OR p = 'history' OR (p = 'since-visit' AND fresh) OR (p = 'latest' AND day = (SELECT max(day) FROM d)) GROUP BY ALL
UNION ALL SELECT 'ai', feed, count(*) FROM d WHERE NOT archived AND feed = 'ai' GROUP BY feed""",
    "eligibility": f"WITH {JUDGED} SELECT article_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS eligible FROM reasoned",
    "feed_adjustments": f"WITH {JUDGED} SELECT article_id, feed, CAST(feed_adjustment AS BIGINT) AS feed_adjustment, is_major, is_developer FROM reasoned",
    "practical_buckets": f"WITH {JUDGED} SELECT CASE WHEN {hits(['edor', 'nicht'], 's')} > 0 THEN 'security_risk' WHEN {hits(['with', 'pour'], 's')} > 0 THEN 'market_risk' WHEN {hits(['this', 'und'], 's')} > 0 THEN 'build_opportunity' WHEN {hits(['that', 'que'], 's')} > 0 THEN 'product_trend' WHEN {hits(SCOPE, 's')} > 0 THEN 'product_trend' ELSE 'ignore' END AS bucket, count(*) AS n, CAST(sum(editorial) AS BIGINT) AS editorial FROM reasoned GROUP BY 1",
    "selection_scores": f"WITH {JUDGED} SELECT article_id AS story_id, CAST(editorial + feed_adjustment + preference - CASE WHEN excluded THEN 80 ELSE 0 END AS DOUBLE) AS score_v1, CAST(editorial + feed_adjustment + greatest(-6, least(6, preference)) AS DOUBLE) AS score_v2 FROM reasoned WHERE len(reasons) = 0",
    "canonical_articles": f"WITH {MEMBERS} SELECT story_id, article_id FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY priority DESC, length(summary) DESC, article_id) AS n FROM members) WHERE n = 1",
    "story_changes": f"WITH {MEMBERS}, m AS (SELECT story_id AS k, count(DISTINCT source) AS n FROM members GROUP BY 1) SELECT k AS story_key, CASE WHEN k % 4 = 0 THEN 'new' ELSE array_to_string(list_filter([CASE WHEN k % 8 = 5 THEN 'title' END, CASE WHEN k % 4 = 1 THEN 'source_count' END], lambda x: x IS NOT NULL), ',') END AS changes FROM m",
    "reader_value": f"WITH {INTERACTIONS}, src AS (SELECT DISTINCT story_id, 'src' || (story_id % 20) AS source_id, true AS canonical FROM interactions UNION ALL SELECT DISTINCT story_id, 'src' || (story_id * 7 % 20), false FROM interactions WHERE story_id % 20 <> story_id * 7 % 20), n AS (SELECT story_id, count(*) AS among FROM src GROUP BY 1), e AS (SELECT story_id, event_type, count(*) AS c FROM interactions WHERE event_type IN ('source_open','save','read') AND coalesce(origin, 'direct') = 'direct' GROUP BY ALL) SELECT source_id, round(sum(CASE WHEN event_type = 'source_open' THEN CASE WHEN canonical THEN c ELSE 0 END WHEN event_type = 'save' THEN c * 3.0::DOUBLE / among ELSE c * 2.0::DOUBLE / among END), 6) AS value FROM e JOIN src USING (story_id) JOIN n USING (story_id) GROUP BY source_id",
    "source_quality": f"WITH {QUALITY} SELECT source_id, runs, reliability, fresh_yield, unique_yield, selection_value, confirmation_value, reader_value, label, recommendation FROM quality",
    "portfolio_scores": f"WITH {SCORED} SELECT source_id, feed, mode, round(CAST(pen AS DOUBLE), 6) AS fetch_penalty, CAST(category_need AS BIGINT) AS category_need, round(CAST(confidence AS DOUBLE), 6) AS confidence, score FROM scored",
    "portfolio_select": f"WITH {SCORED}, a AS (SELECT *, greatest(0, 2 - count(*) FILTER (mode = 'always_on') OVER (PARTITION BY feed)) AS need, row_number() OVER (PARTITION BY feed, mode = 'auto' ORDER BY score DESC, source_id) AS place FROM scored), b AS (SELECT *, CASE WHEN mode = 'always_on' THEN 'always_on' WHEN mode = 'auto' AND place <= need THEN 'category_minimum' END AS r FROM a), c AS (SELECT *, greatest(0, 12 - count(r) OVER ()) AS remaining, row_number() OVER (PARTITION BY r IS NULL AND mode = 'auto' ORDER BY score DESC, source_id) AS nx FROM b), e AS (SELECT *, coalesce(r, CASE WHEN mode = 'auto' AND nx <= remaining THEN 'budget' END) AS r2 FROM c), g AS (SELECT *, row_number() OVER (PARTITION BY r2 IS NULL AND mode = 'auto' AND healthy_probes >= 3 ORDER BY confidence, score DESC, source_id) AS ex FROM e) SELECT source_id, mode, coalesce(r2, CASE WHEN mode = 'auto' AND healthy_probes >= 3 AND ex <= 2 THEN 'explore' END, 'none') AS role FROM g",
    "run_summary": f"WITH {SUMMARY} SELECT * FROM summary",
    "autopilot_gate": f"WITH {SUMMARY}, t AS (SELECT *, CAST(substr(run_id, 6, 2) AS INT) % 2 = 0 AS a FROM summary), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY run_id DESC) AS k FROM t) WHERE k <= 10), g AS (SELECT count(*) FILTER (a) AS automatic_runs, round(avg(coverage) FILTER (a), 6) AS auto_coverage, round(avg(coverage) FILTER (NOT a), 6) AS base_coverage, round(avg(failure_rate) FILTER (a), 6) AS auto_failure_rate, round(avg(failure_rate) FILTER (NOT a), 6) AS base_failure_rate, round(avg(concentration) FILTER (a), 6) AS auto_concentration, round(avg(concentration) FILTER (NOT a), 6) AS base_concentration, round(avg(unique_selected) FILTER (a), 6) AS auto_unique_selected, round(avg(unique_selected) FILTER (NOT a), 6) AS base_unique_selected FROM n) SELECT *, coalesce(automatic_runs >= 10 AND auto_coverage >= base_coverage AND auto_failure_rate <= base_failure_rate AND auto_concentration <= base_concentration + 0.1 AND auto_unique_selected >= 0.95 * base_unique_selected, false) AS passed FROM g",
    "exposure_islands": "WITH s AS (SELECT event_id % 300 AS item_id, epoch_us(ts) // 1000 AS at_ms, coalesce(value / 20.0 >= 0.5 AND event_type <> 'error', false) AS is_on FROM events), t AS (SELECT *, CASE WHEN is_on = lag(is_on) OVER w THEN 0 ELSE 1 END AS turn, lead(at_ms) OVER w AS nx FROM s WINDOW w AS (PARTITION BY item_id ORDER BY at_ms)), i AS (SELECT *, sum(turn) OVER (PARTITION BY item_id ORDER BY at_ms) AS island FROM t), r AS (SELECT item_id, island, min(at_ms) AS started, max(coalesce(nx, at_ms)) AS ended FROM i WHERE is_on GROUP BY ALL) SELECT item_id, min(started) AS started, min(started) + 3600000 AS seen_at FROM r WHERE ended - started >= 3600000 GROUP BY item_id",
    "decay_by_day": f"WITH {INTERACTIONS} SELECT story_id, round(sum(pow(0.5, greatest((1706659200 - epoch) / 86400.0, 0) / 45)), 6) AS influence, count(*) AS n FROM interactions GROUP BY story_id",
    "retention_runs": f"WITH {OBSERVATIONS}, r AS (SELECT run_id, CAST(sum(parsed) AS BIGINT) AS created_epoch FROM observations GROUP BY 1) SELECT run_id, created_epoch FROM (SELECT *, row_number() OVER (ORDER BY created_epoch DESC, run_id DESC) AS n FROM r) WHERE n > 60",
    "ipv4_safety": "WITH e AS (SELECT event_id, event_id * 7 % 260 AS a, event_id * 13 % 256 AS b, event_id * 29 % 256 AS c, event_id * 3 % 256 AS d FROM events), n AS (SELECT *, CASE WHEN a <= 255 THEN a * 16777216 + b * 65536 + c * 256 + d END AS number FROM e) SELECT event_id, concat_ws('.', a, b, c, d) AS ip, number, number IS NULL OR a IN (0, 10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a >= 224 AS blocked FROM n",
    "intake_items": f"WITH {ARTICLES}, d AS (SELECT *, CAST(timezone('Europe/Warsaw', to_timestamp(published_epoch)) AS DATE) AS day FROM articles) SELECT 'https://example.com/' || article_id || '?id=1' AS url, published_epoch, CASE WHEN day BETWEEN DATE '2024-01-30' AND DATE '2024-01-31' THEN 'kept' ELSE 'old' END AS age FROM d",
    "fnv_hash": "SELECT doc_id, CAST(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split('2024-01-31:' || doc_id, ''), lambda x: ascii(x)::UBIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295::UBIGINT) AS BIGINT) AS hash FROM documents",
    "simhash_distance": f"WITH {PAIRS} SELECT left_id, right_id, CAST(bits AS BIGINT) AS bits FROM pairs",
    "dup_pairs": f"WITH {PAIRS} SELECT left_id, right_id, reason, round(score, 6) AS score FROM pairs WHERE reason NOT IN ('below_threshold', 'outside_time_window')",
    "dup_reason_counts": f"WITH {PAIRS} SELECT reason, count(*) AS n FROM pairs GROUP BY reason",
    "readable_classify": f"WITH {READABLE} SELECT page_id, CAST(w AS BIGINT) AS n_words, paragraphs AS n_paragraphs, CASE WHEN (w >= 170 OR (w >= 120 AND paragraphs >= 2) OR (w >= 90 AND paragraphs >= 4 AND length(text) >= 700)) AND NOT wall THEN 'readable' WHEN wall THEN 'insufficient_text' WHEN audio THEN 'audio_only' WHEN video THEN 'video_only' ELSE 'insufficient_text' END AS mode, md5(text) AS text_md5 FROM words",
    "page_category": rf"""WITH heads AS (SELECT page_id, html, substr(html, 1, 200000) AS x3, substr(html, 1, 100000) AS x4 FROM pages), {plain('hp', 'heads', 'x3', 'page_id, html')}, {plain('lp', 'heads', 'x4', 'page_id')},
c AS (SELECT page_id, unnest([{", ".join(f"'{c}'" for c in CATEGORY_WORDS)}]) AS category, unnest([{", ".join("(" + " + ".join(f"CAST(contains(lower(plain), '{w}') AS INT)" for w in ws) + ")" for ws in CATEGORY_WORDS.values())}]) AS n FROM hp),
b AS (SELECT page_id, CASE WHEN max(n) > 0 THEN first(category ORDER BY n DESC, category) ELSE 'General' END AS category FROM c GROUP BY page_id),
t AS (SELECT h.page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<language\b[^>]*>(.*?)</language>', 1)), ''), nullif(regexp_extract(html, '(?i)(?:xml:lang|lang)=["'']([a-zA-Z-]{{2,35}})["'']', 1), '')) AS declared,
  len(regexp_extract_all(lower(l.plain), '[ąćęłńóśźż]')) + len(regexp_extract_all(lower(l.plain), '(?:^|[^\p{{L}}\p{{N}}_])(?:oraz|jest|się|dla|przez|który)(?:$|[^\p{{L}}\p{{N}}_])')) AS pl, len(regexp_extract_all(lower(l.plain), '\b(?:the|and|with|from|that|this|for)\b')) AS en FROM hp h JOIN lp l ON l.page_id = h.page_id)
SELECT b.page_id, b.category, coalesce(substr(lower(declared), 1, 35), CASE WHEN pl > en THEN 'pl' WHEN en > 2 THEN 'en' ELSE 'unknown' END) AS language FROM b JOIN t ON t.page_id = b.page_id""",
    "published_summaries": rf"""WITH {ARTICLES}, {plain('sp', 'articles', 'summary', 'article_id, title')}, {plain('tp', 'articles', 'title', 'article_id')},
c AS (SELECT s.article_id, s.title, {METADATA} AS x, t.plain AS said FROM sp s JOIN tp t ON t.article_id = s.article_id),
k AS (SELECT article_id, {squeezed("coalesce(CASE WHEN article_id % 4 > 0 AND x <> '' AND NOT (title <> '' AND lower(x) = lower(said)) THEN x END, nullif(trim(title), ''), 'No summary available.')")} AS s FROM c)
SELECT article_id, CASE WHEN length(s) > 120 THEN trim(substr(s, 1, 119)) || '...' ELSE s END AS summary FROM k""",
    "source_variants": f"WITH {MEMBERS}, g AS (SELECT story_id, lower(source) AS publisher, list({{'article_id': article_id, 'priority': priority, 'n': length(summary)}} ORDER BY article_id) AS rows FROM members GROUP BY ALL), v AS (SELECT story_id, publisher, list_reduce(rows, lambda a, x: CASE WHEN x.priority > a.priority OR x.n > a.n THEN x ELSE a END) AS best FROM g), c AS (SELECT story_id, lower(source) AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY priority DESC, length(summary) DESC, article_id) AS n FROM members) WHERE n = 1) SELECT v.story_id, publisher, best.article_id AS article_id, CASE WHEN publisher = canonical THEN 'canonical' ELSE 'confirmation' END AS contribution FROM v JOIN c ON c.story_id = v.story_id",
    "story_keys": f"WITH {PAIRS}, m AS (SELECT article_id, min(article_id) OVER (PARTITION BY title) AS story_id FROM articles), j AS (SELECT m.story_id, CAST(to_json([p.feed, p.fp, CASE WHEN p.url <> '' THEN p.url ELSE CAST(p.article_id AS VARCHAR) END]) AS VARCHAR) AS row FROM m JOIN prof p ON p.article_id = m.article_id) SELECT story_id, substr(sha256(CAST(to_json(list(row ORDER BY row)) AS VARCHAR)), 1, 32) AS story_key FROM j GROUP BY story_id",
    "policy_gate": f"WITH {JUDGED}, c AS (SELECT 'run' || (article_id % 12) AS run_id, article_id AS story_id, CAST(editorial + feed_adjustment + preference - CASE WHEN excluded THEN 80 ELSE 0 END AS DOUBLE) AS v1, CAST(editorial + feed_adjustment + greatest(-6, least(6, preference)) AS DOUBLE) AS v2 FROM reasoned WHERE len(reasons) = 0), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY v1 DESC, story_id) <= 12 AS in1, row_number() OVER (PARTITION BY run_id ORDER BY v2 DESC, story_id) <= 12 AS in2 FROM c), g AS (SELECT run_id, count(*) FILTER (in1) AS n1, count(*) FILTER (in2) AS n2, count(*) FILTER (in1 AND in2) AS common, count(*) FILTER (in2 AND story_id % 50 = 0) AS bad FROM r GROUP BY run_id) SELECT count(*) AS paired_runs, round(avg(CASE WHEN greatest(n1, n2) = 0 THEN 1.0 ELSE common::DOUBLE / greatest(n1, n2) END), 6) AS mean_overlap, coalesce(max(abs(n1 - n2)), 0) AS parity, CAST(coalesce(sum(bad), 0) AS BIGINT) AS violations, coalesce(count(*) >= 10 AND max(abs(n1 - n2)) <= 1 AND sum(bad) = 0, false) AS passed FROM g",
    "feedback_adjust": f"WITH {PREFERRED} SELECT user_id, item_id, round(preference, 6) AS preference FROM preferred",
    "rank_foryou": f"WITH {PREFERRED}, r AS (SELECT user_id, item_id, editorial, editorial + greatest(-9, least(9, round(preference, 6))) + freshness + upd AS score FROM preferred) SELECT user_id, item_id, round(score, 6) AS rank_score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, editorial DESC, item_id) - 1 AS model_rank FROM r",
}
