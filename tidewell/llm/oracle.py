"""SQL of the operators that SQL can express over whole tables."""

SPACE = r"[^\x20\x09-\x0D]+"


def _edit(item: str, cost: str, edit: str) -> str:
    """An item, its cost in eight digits before its audit, and one edit more."""
    return f"(printf('%08d', CAST({item}[1:8] AS BIGINT) + {cost}) || {item}[9:] || {edit})"


def _insert(*items: str) -> str:
    return ", ".join(_edit(i, "3", "'I'") for i in items)


def _insert2(*items: str) -> str:
    return ", ".join(_edit(i, "6", "'II'") for i in items)


def _read(initial: str, *items: str) -> str:
    """A row that isn't deleted, kept where it has the initial."""
    return ", ".join(f"CASE WHEN NOT gone THEN {_edit(i, f'(CASE WHEN initial = {initial!r} THEN 0 ELSE 3 END) + stays', f'(CASE WHEN initial = {initial!r} THEN chr(75) ELSE chr(82) END)')} END" for i in items)

ORACLE = {
    "op1_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACE}')) AS BIGINT) AS size FROM documents),
b AS (SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS bin FROM d),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1] AS weight FROM b GROUP BY source),
o AS (SELECT *, 3 * source_size AS most, (3 * source_size) / weight AS level_at, sum(source_size) OVER () AS total FROM src),
h AS (SELECT *, coalesce(sum(most) OVER (ORDER BY level_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(weight) OVER (ORDER BY level_at, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o),
l AS (SELECT *, CAST(total - held AS DOUBLE) / CAST(rest AS DOUBLE) AS level FROM h),
m AS (SELECT arg_min(level, level_at) AS level FROM l WHERE level_at >= level),
t AS (SELECT source, source_size, n, CASE WHEN level_at <= m.level THEN CAST(most AS DOUBLE) ELSE m.level * weight END AS target FROM l, m),
c AS (SELECT b.source, b.bin, CAST(ceil(count(*) / greatest(256, ceil(any_value(t.n) / 4096))) AS BIGINT) AS slices FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source GROUP BY b.source, b.bin),
s AS (SELECT b.doc_id, b.source, b.size, b.bin * 1048576 + CAST('0x' || substr(md5(coalesce(CAST(b.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % c.slices AS slice FROM b JOIN c ON b.source IS NOT DISTINCT FROM c.source AND b.bin = c.bin),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY slice, size, doc_id) AS rank FROM s),
x AS (SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS e,
             (CAST('0x' || substr(md5('17:' || coalesce(r.source, 'null')), 1, 3) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 4096 AS u FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(least(floor(rank * e + u) - floor((rank - 1) * e + u), 3) AS BIGINT) AS copies FROM x)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies, source FROM k""",
    "op10_minhash_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM g),
u AS (SELECT doc_id, unnest(g) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM u a JOIN u b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.doc_id)
SELECT n.doc_id, n.n AS n_shingles, m.r AS component_id, n.doc_id = m.r AS kept FROM n JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) m ON m.doc_id = n.doc_id""",
    "op11_conversations": rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations),
c AS (SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(place) + 1), lambda i: list_transform(range(0, 8), lambda j: (ascii(place[i]) >> j) & 1)))),
             lambda a, b: xor(a >> 1, CASE WHEN (xor(a, b) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS n FROM d),
f AS (SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS initial, NOT regexp_matches(text, '{SPACE}') AS blank,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS open FROM o),
r AS (SELECT conv_id, turn, n, role, text, initial, blank, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND open AS truncated, blank OR seen AS gone,
      CASE WHEN open THEN 3 ELSE 0 END AS stays, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial NOT IN ('su', 'ua', 'au') AS wrong FROM f),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, '00000000' AS s, CAST(NULL AS VARCHAR) AS q, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS d FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL
      SELECT conv_id, n, {_edit('s', '4', "'D'")} AS s,
             least({_edit('q', '4', "'D'")}, CASE WHEN NOT gone AND initial = 's' THEN {_edit('s', 'stays', "'K'")} END) AS q,
             least({_edit('a', '4', "'D'")}, {_read('u', 's', 'q', 'd')}) AS a,
             least({_edit('d', '4', "'D'")}, {_read('a', 'a')}) AS d
      FROM (SELECT p.conv_id, r.n, r.gone, r.initial, r.stays, s, q, least(a, {_insert('s', 'q', 'd')}) AS a, least(d, {_insert('a')}, {_insert2('s', 'q')}) AS d
            FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = p.n + 1)),
e AS (SELECT conv_id, max(n) AS n FROM p GROUP BY conv_id),
b AS (SELECT p.conv_id, least(s, d, {_insert('a')}, {_insert2('q')}) AS best FROM p JOIN e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.n = p.n),
w AS (SELECT conv_id, best[9:] AS audit, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, '' AS before, CAST(NULL AS VARCHAR) AS lines FROM b
      UNION ALL
      SELECT conv_id, audit, i, n, CASE WHEN edit = 'D' THEN before ELSE role[1] END, CASE WHEN edit = 'D' THEN lines ELSE coalesce(lines || chr(10), '') || role || ':' || text END
      FROM (SELECT w.conv_id, audit, w.i + 1 AS i, w.n + CASE WHEN audit[w.i + 1] = 'I' THEN 0 ELSE 1 END AS n, before, lines, audit[w.i + 1] AS edit,
                   CASE WHEN audit[w.i + 1] = 'K' THEN r.role WHEN before = 'u' THEN 'assistant' ELSE 'user' END AS role, CASE WHEN audit[w.i + 1] = 'I' THEN '' ELSE r.text END AS text
            FROM w LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1 WHERE w.i < length(audit))),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (wrong) AS illegal FROM r GROUP BY conv_id)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(best[1:8] AS BIGINT) AS cost, w.audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM b JOIN w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i = length(w.audit) LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id""",
    "op12_fim": r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g),
c AS (SELECT *, array_to_string(units[1:x], '') AS a, array_to_string(units[x + 1:y], '') AS m, array_to_string(units[y + 1:], '') AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c""",
    "op13_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256 FROM n""",
}
