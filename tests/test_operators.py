"""Operators on small tables, sequential ones against plain statements of their rules."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.functions import address
from tidewell.operators import engagement as E
from tidewell.operators import lifecycle as L
from tidewell.operators import merging as M
from tidewell.operators import reading as R
from tidewell.operators import selection as C
from tidewell.operators import sourcing as P
from tidewell.operators import stories as D
from tidewell.sources import intake


def test_intake(spark):
    body = """<rss><channel><item><title>Launch &amp;amp; breach</title><link>https://example.com/story?utm_source=x&amp;id=1#section</link>
    <pubDate>Fri, 19 Jun 2026 18:30:00 GMT</pubDate><description>Summary &amp;amp; context</description></item>
    <item><title>Old</title><link>https://example.com/old</link><pubDate>Thu, 18 Jun 2026 18:30:00 GMT</pubDate></item><item><title>Undated</title></item></channel></rss>"""
    df = intake.items(spark.createDataFrame([("s", "S", "AI", 1, body), ("e", "E", "AI", 1, "")], "source_id string, source_name string, category string, priority int, body string"))
    got = {r.title: r for r in intake.recent(df, F.lit("2026-06-20 12:00:00").cast("timestamp")).collect()}
    assert got["Launch & breach"].url == "https://example.com/story?id=1" and got["Launch & breach"].summary == "Summary & context"
    assert {t: r.age for t, r in got.items()} == {"Launch & breach": "kept", "Old": "old", "Undated": "undated"}


def _articles(spark, rows):
    return spark.createDataFrame(rows, "article_id long, title string, summary string, category string, canonical_url string, published_epoch long, source string")


def test_pair_decisions(spark):
    rows = [
        (1, "OpenAI launches GPT-5 model for developers", "The GPT-5 model brings developers reasoning tools and an updated API", "AI", "", 0, "a"),
        (2, "GPT-5 model launched by OpenAI for developers", "Developers get the GPT-5 model with reasoning tools and the updated API", "AI", "", 3600, "b"),
        (3, "NVIDIA shares fall after earnings", "Investors sold semiconductor stocks as guidance disappointed", "Business", "", 0, "c"),
        (4, "OpenAI launches GPT-5 model for developers", "The GPT-5 model brings developers reasoning tools and an updated API", "AI", "", 10 * 86400, "d"),
        (5, "One thing", "x", "AI", "https://a.b/c", 0, "e"),
        (6, "Another matter", "y", "AI", "https://a.b/c", 0, "f"),
    ]
    p = D.profiles(_articles(spark, rows))
    side = F.struct("feed", "title_tokens", "text_tokens", "fingerprint", "simhash", "published_epoch", "canonical_url")
    s = p.select("article_id", side.alias("s"))
    pairs = s.select(F.col("article_id").alias("i"), F.col("s").alias("l")).crossJoin(s.select(F.col("article_id").alias("j"), F.col("s").alias("r"))).where("i < j")
    got = {(r.i, r.j): (r.d.duplicate, r.d.reason) for r in pairs.select("i", "j", D.decision().alias("d")).collect()}
    assert got[1, 2][0] and not got[1, 3][0] and got[1, 4] == (False, "outside_time_window") and got[5, 6] == (True, "canonical_url")
    clusters = {r.article_id: r.story_id for r in D.clusters(p).collect()}
    assert clusters[1] == clusters[2] != clusters[3] and clusters[4] == 4 and sorted(clusters) == [1, 2, 3, 4, 5, 6]


def test_pairs_of_large_keys(spark, monkeypatch):
    """No key is too large: 300 copies of one story, among others, against all pairs by brute force."""
    monkeypatch.setattr(D, "BLOCK", 40)
    r = random.Random(3)
    words = [f"word{i}" for i in range(14)]
    rows = [(i, "Harbour tunnel opens after delays", "The tunnel under the harbour carries trains", "AI", "", i % 7 * 86400, "a") for i in range(300)]
    rows += [(i, " ".join(["Harbour", *r.sample(words, 3)]), " ".join(r.sample(words, 6)), "AI", r.choice(["", "", f"https://a.b/{i % 3}"]), r.randrange(9) * 86400, "b") for i in range(300, 360)]
    p = D.profiles(_articles(spark, rows)).cache()
    side = F.struct("feed", "title_tokens", "text_tokens", "fingerprint", "simhash", "published_epoch", "canonical_url")
    s = p.select("article_id", side.alias("s"), D.blocking_keys().alias("keys"))
    a, b = (s.select(F.col("article_id").alias(x), F.col("s").alias(y), F.col("keys").alias(f"{y}k")) for x, y in (("i", "l"), ("j", "r")))
    brute = a.crossJoin(b).where("i < j").where(F.arrays_overlap("lk", "rk")).select("i", "j", D.decision().alias("d")).select("i", "j", "d.duplicate", "d.reason", F.round("d.score", 6).alias("score"))
    brute = sorted(map(tuple, brute.collect()))
    got = D.duplicate_pairs(p).withColumn("score", F.round("score", 6))
    assert sorted(map(tuple, got.collect())) == brute and len(brute) > 300 * 299 / 2
    some = D.duplicate_pairs(p, all_pairs=False).withColumn("score", F.round("score", 6)).where("duplicate")
    assert sorted(map(tuple, some.collect())) == [x for x in brute if x[2]]
    reasons = pd.Series([x[3] for x in brute]).value_counts().to_dict()
    assert {x.reason: x.n for x in D.reason_counts(p).collect()} == reasons
    score = {x[:2]: x[4] for x in brute if x[2]}
    groups = []
    for i, t in sorted(((x[0], x[5]) for x in rows), key=lambda x: (-x[1], x[0])):
        least = [min(score.get((min(i, m), max(i, m)), -1.0) for m in g) for g in groups]
        best = max(least, default=-1.0)
        groups[least.index(best)].append(i) if best >= 0 else groups.append([i])
    assert {x.article_id: x.story_id for x in D.clusters(p).collect()} == {i: g[0] for g in groups for i in g}
    p.unpersist()


def test_whole_texts(spark, tmp_path):
    """Profiles have what is behind character 480."""
    from tidewell.plans import queries as Q
    from tidewell.sources import adapters as A

    r = random.Random(5)
    start = "Harbour tunnel opens after delays " * 15
    texts = [start + " ".join(f"{x}{r.randrange(10**6)}" for _ in range(300)) for x in ("alpha", "gamma")]
    rows = [(i, t, "en", "s", len(t)) for i, t in ((0, texts[0]), (210, texts[1]), (240, texts[0]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [x.title + x.summary for x in A.articles(spark, str(tmp_path)).orderBy("article_id").collect()] == [t for _, t, *_ in rows]
    sizes = {x.article_id: x.n for x in Q.profiles(spark, str(tmp_path)).select("article_id", F.size("text_tokens").alias("n")).collect()}
    assert min(sizes.values()) > 290
    assert (0, 240) in {(x.left_id, x.right_id) for x in Q.dup_pairs(spark, str(tmp_path)).collect()}


def test_simhash_distance_of_all_candidates(spark, small):
    from tidewell.plans import queries as Q

    p = Q.profiles(spark, small).select("article_id", "simhash", D.blocking_keys().alias("keys")).collect()
    brute = {(a.article_id, b.article_id): bin(a.simhash ^ b.simhash).count("1") for a in p for b in p if a.article_id < b.article_id and set(a["keys"]) & set(b["keys"])}
    got = Q.simhash_distance(spark, small).collect()
    assert {(x.left_id, x.right_id): x.bits for x in got} == brute and len(got) == len(brute) and max(x.right_id for x in got) >= 120


def test_distances_of_copies_in_lists(spark, monkeypatch):
    """Copies that take several lists, keys that take several blocks, against a plain loop."""
    monkeypatch.setattr(D, "BLOCK", 7)
    monkeypatch.setattr(D, "KEY_BLOCK", 10)
    rows = random_stories(random.Random(17), 60)
    rows += [(500 + i, *rows[3 + i % 2][1:]) for i in range(40)]
    p, _ = profile_dicts(spark, rows)
    told = p.select("article_id", "simhash", D.blocking_keys().alias("keys")).collect()
    brute = {(a.article_id, b.article_id): bin(a.simhash ^ b.simhash).count("1") for a in told for b in told if a.article_id < b.article_id and set(a["keys"]) & set(b["keys"])}
    got = D.key_distances(p).collect()
    assert {(x.left_id, x.right_id): x.bits for x in got} == brute and len(got) == len(brute) > 1000


def test_distances_in_steps(monkeypatch):
    """Rows of keys that span batches, blocks of a hot key, few rows and many, in small steps, against a plain loop."""
    import pyarrow as pa

    monkeypatch.setattr(D, "FEW", 3)
    monkeypatch.setattr(D, "STEP_PAIRS", 60)
    r = random.Random(29)
    told = [(i, r.getrandbits(32), sorted(r.sample(range(60), r.randrange(5)) + [7] * (i % 3 == 0))) for i in range(150)] + [(1000 + i, 5, [61, 62, 63]) for i in range(30)]
    rows = []
    for i, bits, keys in told:
        for n, key in enumerate(keys):
            if key not in keys[:n]:
                blocks = 3 if key == 7 else 1
                for other in range(blocks):
                    a, b = sorted((i % blocks, other))
                    rows.append({"key": key, "i": a, "j": b, "first": i % blocks == a, "article_id": i, "simhash": bits, "same": hash(tuple(keys[:n])), "below": keys[:n]})
    rows.sort(key=lambda x: (x["key"], x["i"], x["j"]))
    schema = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("first", pa.bool_()), ("article_id", pa.int64()), ("simhash", pa.int64()), ("same", pa.int64()), ("below", pa.list_(pa.int64()))])
    out = list(D._key_distances(b for x in range(0, len(rows), 17) for b in pa.Table.from_pylist(rows[x : x + 17], schema).to_batches()))
    got = [(x["left_id"], x["right_id"], x["bits"]) for b in out for x in b.to_pylist()]
    brute = [(a[0], b[0], (a[1] ^ b[1]).bit_count()) for a in told for b in told if a[0] < b[0] and set(a[2]) & set(b[2])]
    assert sorted(got) == sorted(brute) and len(brute) > 2000 and max(map(len, out)) <= 60


def test_keys_are_worked_out_once(spark):
    """The anchors of a text are looked for once, where its keys name them more than once; tokens and bits are not folded one by one."""
    p = D.profiles(_articles(spark, [(1, "Harbour tunnel", "opens", "AI", "", 0, "a")]))
    plan = p.select("simhash", D.hashed_keys().alias("keys"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("anchor:") == 1 and "aggregate(" not in plan and "split(" not in plan


def test_story_keys(spark):
    m = spark.createDataFrame([(1, "ai", 'a "b" \\ ü', "https://x"), (1, "ai", "c", ""), (2, "ai", "c", "")], "story_id long, feed string, fingerprint string, canonical_url string").withColumn("article_id", F.lit(7))
    got = {r.story_id: r.story_key for r in D.story_keys(m).collect()}
    assert got[1] == D.story_key_of([("ai", 'a "b" \\ ü', "https://x"), ("ai", "c", "7")]) and got[1] != got[2]


def test_variants_and_contributions(spark):
    m = spark.createDataFrame([(1, 1, "src1", 3, "aa", 0), (1, 2, "src1", 5, "a", 0), (1, 3, "src2", 4, "a", 0)], "story_id long, article_id long, source string, priority long, summary string, published_epoch long")
    v = D.contributions(D.source_variants(m), D.canonical_article(m))
    assert {(r.publisher, r.article_id, r.contribution) for r in v.collect()} == {("src1", 2, "canonical"), ("src2", 3, "confirmation")}


def random_stories(r, n, words=26, urls=True):
    """Articles of few words, so that many are alike; some share a URL, some have no time."""
    pool = ["Harbour", "tunnel", "budget", "inflation", "GPT5", "semiconductor", "exploit", "patch", "markets", "climate", *(f"word{i}x" for i in range(words - 10))]
    rows = []
    for i in range(n):
        title = r.sample(pool, r.choice([1, 3, 4, 5, 6]))
        if rows and r.random() < 0.45:  # near an earlier one
            title = rows[r.randrange(len(rows))][1].split(" ")
            title[r.randrange(len(title))] = r.choice(pool)
        summary = " ".join(r.sample(pool, r.randrange(1, 9)))
        rows.append((i, " ".join(title), summary, r.choice(["AI", "Business", "Cyber"]), r.choice(["", "", "", f"https://a.b/{r.randrange(6)}"]) if urls else "", None if r.random() < 0.1 else r.randrange(9) * 86400 + r.randrange(3), r.choice("abcd")))
    return rows


def profile_dicts(spark, rows):
    p = D.profiles(_articles(spark, rows))
    return p, {x.article_id: {**D.profile_of(x.asDict()), "keys": x["keys"]} for x in p.withColumn("keys", D.blocking_keys()).collect()}


def test_decisions_in_python_are_those_of_the_expression(spark):
    r = random.Random(4)
    p, told = profile_dicts(spark, random_stories(r, 60))
    side = F.struct(*D.PROFILE, "published_epoch")
    s = p.select("article_id", side.alias("s"))
    pairs = s.select(F.col("article_id").alias("i"), F.col("s").alias("l")).crossJoin(s.select(F.col("article_id").alias("j"), F.col("s").alias("r")))
    seen = set()
    for x in pairs.select("i", "j", D.decision().alias("d")).collect():
        yes, why, score = D.decide(told[x.i], told[x.j])
        assert (yes, why) == (x.d.duplicate, x.d.reason) and abs(score - x.d.score) < 1e-9
        assert D.decide(told[x.j], told[x.i])[:2] == (yes, why)  # sides are of no account
        seen.add(why)
    assert len(seen) >= 7


def thousandths(x):
    """As the rule rounds scores: by the exact value of the double, of two equally near numbers the larger."""
    return float(Decimal(x).quantize(Decimal("0.001"), ROUND_HALF_UP))


def grouped(rows, told):
    """The sequential grouping: newest first, each against all members of the groups in which it shares a key."""
    order = [x[0] for x in sorted(rows, key=lambda x: (-x[5] if x[5] is not None else float("inf"), x[0]))]
    buckets, groups, of, edges = {}, [], {}, []
    for i in order:
        found = {}
        for key in told[i]["keys"]:
            for j in buckets.get(key, ()):
                found.setdefault(of[j], None)
        best = None
        for g in found:
            ds = [(D.decide(told[j], told[i]), j) for j in groups[g]]
            if all(d[0] for d, _ in ds) and (best is None or min(d[2] for d, _ in ds) > best[0]):
                best = (min(d[2] for d, _ in ds), g, ds)
        if best:
            edges += [(j, i, d[1], thousandths(d[2])) for d, j in best[2]]
            groups[best[1]].append(i)
            of[i] = best[1]
        else:
            of[i] = len(groups)
            groups.append([i])
        for key in told[i]["keys"]:
            buckets.setdefault(key, []).append(i)
    out = {}
    for i in order:
        mine = sorted((e for e in edges if i in e[:2]), key=lambda e: -e[3])
        out[i] = (groups[of[i]][0], mine[0][2] if mine else "new_story", mine[0][3] if mine else 1.0)
    return out


def test_clusters_are_those_of_the_sequential_rule(spark):
    r = random.Random(11)
    rows = random_stories(r, 320)
    rows += [(400 + i, *rows[7][1:5], r.randrange(5) * 86400, "z") for i in range(40)]  # copies of one
    p, told = profile_dicts(spark, rows)
    expected = grouped(rows, told)
    got = {x.article_id: (x.story_id, x.match_reason, round(x.match_score, 3)) for x in D.memberships(p).collect()}
    assert got == expected
    assert len({x[0] for x in expected.values()}) < 300 and {x.article_id: x.story_id for x in D.clusters(p).collect()} == {i: x[0] for i, x in expected.items()}


def test_scores_are_rounded_by_their_exact_value(spark):
    xs = [0.8125, 0.5325, 0.0005, 0.0015, 0.9995, 1.0, 0.0, 0.1 + 0.2, *(i / 2000 for i in range(2000))]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", D.thousandths(F.col("x")).alias("y")).collect()
    assert [(x.x, x.y) for x in got] == [(x, thousandths(x)) for x in xs]


@pytest.mark.parametrize("most", [40])
def test_components_of_any_size_are_placed_in_rounds(spark, monkeypatch, most):
    """The same groups where a component takes many rounds; no task is given more newcomers than a round has."""
    monkeypatch.setattr(D, "ROUND", most)
    r = random.Random(13)
    rows = random_stories(r, 120)
    rows += [(400 + i, *rows[7][1:5], r.randrange(5) * 86400, "z") for i in range(15)]
    p, told = profile_dicts(spark, rows)
    expected = grouped(rows, told)
    got = {x.article_id: (x.story_id, x.match_reason, round(x.match_score, 3)) for x in D.memberships(p).collect()}
    assert got == expected


def test_evidence_finds_every_pair_of_duplicates(spark, monkeypatch):
    """Candidates hold all pairs that share a key and that the decision calls duplicates; rows of evidence follow an article's own sizes."""
    from tidewell.operators import similar as S

    monkeypatch.setattr(S, "BLOCK", 16)
    r = random.Random(14)
    rows = random_stories(r, 260) + [(900 + i, t, s, "AI", "", 0, "a") for i, (t, s) in enumerate((("", ""), ("", ""), ("the", "harbour"), ("Harbour", "x"), ("Harbour news", ""), ("", "Harbour tunnel budget")))]
    p, told = profile_dicts(spark, rows)
    k, _ = D.profile_classes(p)
    k = k.checkpoint()
    found = {(x.left, x.right) for x in S.candidates(k).collect()}
    ids = sorted(x.class_id for x in k.select("class_id").collect())
    meant = {(a, b) for a in ids for b in ids if a < b and set(told[a]["keys"]) & set(told[b]["keys"]) and D.decide(told[a], told[b], timed=False)[0]}
    assert meant <= found and len(meant) > 100
    assert S.evidence(k).groupBy("class_id").count().agg({"count": "max"}).first()[0] < 200


def matched_in_turn(stories, past, told):
    """stories: id to (key, articles); past: (id, key), newest first. Equal keys first, then each story, by id, the best that is left."""
    used, out = set(), {}
    by_key = {key: h for h, key in past}
    for story in sorted(stories):
        h = by_key.get(stories[story][0])
        if h is not None and h not in used:
            used.add(h)
            out[story] = (h, "stable_story_key", 1.0)
    for story in sorted(stories):
        best = None
        for h, _ in past if story not in out else ():
            ds = [x for i in stories[story][1] if (x := D.decide(told[h], told[i]))[0]]
            if h not in used and ds and (best is None or max(x[2] for x in ds) > best[0] + 1e-12):
                best = (max(x[2] for x in ds), h)
        if best:
            used.add(best[1])
            out[story] = (best[1], None, best[0])
    return out


def test_history_is_matched_in_turn(spark):
    """Random stories of several profiles, tokens in all of them, equal keys, against the plain loop."""
    r = random.Random(12)
    rows = random_stories(r, 110, words=20)
    rows = [(i, f"{t} markets", f"{s} markets climate", *x) for i, t, s, *x in rows]
    p, told = profile_dicts(spark, rows)
    p = p.withColumnRenamed("article_id", "story_id").withColumn("last_seen_epoch", (F.col("story_id") * 7 % 5).cast("long"))
    p = p.withColumn("story_key", F.when(F.col("story_id") % 3 == 0, F.concat(F.lit("k"), F.col("story_id").cast("string"))).otherwise(F.concat(F.lit("k"), (F.expr("story_id div 6") * 6).cast("string")))).checkpoint()
    history, now = p.where("story_id % 3 = 0 and story_id % 4 > 0"), p.where("story_id % 3 > 0").withColumn("story_id", F.expr("story_id div 6"))
    past = sorted((i for i, *_ in rows if i % 3 == 0 and i % 4), key=lambda i: (-(i * 7 % 5), i))
    members = {}
    for x in rows:
        if x[0] % 3:
            members.setdefault(x[0] // 6, (f"k{x[0] // 6 * 6}", []))[1].append(x[0])
    for keyed in (True, False):
        expected = matched_in_turn({k: (v[0] if keyed else None, v[1]) for k, v in members.items()}, [(h, f"k{h}") for h in past], told)
        got = D.match_stories(now, history) if keyed else D.match_history_fuzzy(now, history)
        got = {x.story_id: (x.history_id, x.reason, x.score) for x in got.collect()}
        assert {k: (v[0], round(v[2], 6)) for k, v in got.items()} == {k: (v[0], round(v[2], 6)) for k, v in expected.items()} and len(got) > 10
        assert {k for k, v in got.items() if v[1] == "stable_story_key"} == {k for k, v in expected.items() if v[1]}
    told_by = spark.createDataFrame([(1, 0, "new_story", 1.0), (2, 5, "simhash", 0.7)], "article_id long, story_id long, match_reason string, match_score double")
    found = spark.createDataFrame([(5, 9, "k", "simhash", 0.8125)], "story_id long, history_id long, story_key string, reason string, score double")
    assert sorted(tuple(x) for x in D.with_history(told_by, found).collect()) == [(1, 0, "new_story", 1.0), (2, 5, "history:simhash", 0.813)]


def test_history_in_parts_and_cells(spark, monkeypatch):
    """A history of several parts and stories of several cells, some without a time or with the same URL, against the plain loop."""
    monkeypatch.setattr(D, "HISTORY_ROWS", 9)
    monkeypatch.setattr(D, "STORY_CELL", 20)
    rows = random_stories(random.Random(15), 120, words=22) + [(900, "the", "and", "AI", "", 0, "a"), (901, "", "", "AI", "", 0, "a"), (902, "", "", "AI", "", 0, "a")]
    p, told = profile_dicts(spark, rows)
    p = p.withColumnRenamed("article_id", "story_id").withColumn("last_seen_epoch", (F.col("story_id") * 7 % 5).cast("long"))
    past = sorted((x[0] for x in rows if x[0] % 3 == 0), key=lambda i: (-(i * 7 % 5), i))
    expected = matched_in_turn({x[0]: (None, [x[0]]) for x in rows if x[0] % 3}, [(h, f"k{h}") for h in past], told)
    got = {x.story_id: (x.history_id, round(x.score, 6)) for x in D.match_history_fuzzy(p.where("story_id % 3 > 0"), p.where("story_id % 3 = 0")).collect()}
    assert got == {k: (v[0], round(v[2], 6)) for k, v in expected.items()} and len(got) > 20 and 901 in got
    none = D.match_history_fuzzy(p.where("story_id % 3 > 0"), p.where("false"))
    assert none.count() == 0 and D.match_history_fuzzy(p.where("false"), p).count() == 0


def test_history_keeps_no_copies_of_the_texts(spark, tmp_path):
    """What is checkpointed follows the history and what it matches, not the texts of a run."""
    from pathlib import Path

    from tidewell.plans import queries as Q

    r = random.Random(16)
    docs = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(250)), "src1") for i in range(600)]
    docs = [(i, docs[i - 1][1] if i % 30 == 1 else t, s) for i, t, s in docs]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    used = lambda: sum(x.stat().st_size for x in folder.rglob("*") if x.is_file())
    before = used()
    got = Q.history_matches(spark, str(tmp_path)).collect()
    assert len(got) >= 10 and used() - before < 1.5 * sum(len(t) for _, t, _ in docs)


@pytest.mark.parametrize("look", [500, 7])
def test_selection_by_its_rule(spark, monkeypatch, look):
    """Runs that are full after one step, and runs that take several, of which one is never full."""
    monkeypatch.setattr(C, "LOOK", look)
    r = random.Random(1)
    rows = random_stories(r, 150, urls=False)
    p, told = profile_dicts(spark, rows)
    extra = [(i, f"r{i % 3}", r.choice(["p", "q", "r", ""]), float(r.randrange(60)), r.randrange(9)) for i in range(150)]
    df = p.withColumnRenamed("article_id", "story_id").join(spark.createDataFrame(extra, "story_id long, run_id string, publisher string, final_score double, editorial long"), "story_id")
    limits = {"ai": 3, "security": 4}
    got = {x.story_id: x for x in C.select_stories(df, 9, limits, 3).collect()}
    feeds = {x.article_id: x.feed for x in p.select("article_id", "feed").collect()}
    why = set()
    for run in ("r0", "r1", "r2"):
        chosen = []
        for i, _, who, _, _ in sorted((x for x in extra if x[1] == run), key=lambda x: (-x[3], -x[4], x[0])):
            dup = next((j for j, _ in chosen if D.decide(told[i], told[j])[0]), None)
            if len(chosen) >= 9:
                expected = "capacity"
            elif sum(feeds[j] == feeds[i] for j, _ in chosen) >= limits.get(feeds[i], 9):
                expected = "category_limit"
            elif who and sum(w == who for _, w in chosen) >= 3:
                expected = "publisher_cap"
            elif dup is not None:
                expected = "duplicate_suppression"
                assert got[i].duplicate_of == dup and got[i].duplicate_reason == D.decide(told[i], told[dup])[1]
            else:
                expected = "global_rank"
                assert got[i].selection_rank == len(chosen)
                chosen.append((i, who))
            assert got[i].reason == expected and got[i].selected == (expected == "global_rank")
            why.add(expected)
    assert len(why) == 5


def test_selection_looks_at_what_can_be_selected(spark, monkeypatch):
    """Runs that their publishers never fill: the same as one fold over all rows, with profiles of the first rows only, in few rounds."""
    monkeypatch.setattr(C, "LOOK", 10)
    r = random.Random(5)
    rows = random_stories(r, 240, words=60, urls=False)
    p, told = profile_dicts(spark, rows)
    feeds = {x.article_id: x.feed for x in p.select("article_id", "feed").collect()}
    extra = [(i, f"r{i % 2}", r.choice(["p", "q"]) if i > 9 else None if i % 4 > 1 else "q", float(r.randrange(60)) if i > 9 else -1.0, r.randrange(9)) for i in range(240)]
    looked = []

    def profiled(batch):
        looked.append([x.story_id for x in batch.select("story_id").collect()])
        return batch.drop("feed").join(p.withColumnRenamed("article_id", "story_id"), "story_id")

    df = spark.createDataFrame(extra, "story_id long, run_id string, publisher string, final_score double, editorial long").join(p.select(F.col("article_id").alias("story_id"), "feed"), "story_id")
    for top_n, limits in ((9, {"ai": 3}), (5, {"ai": 0, "security": 2}), (0, {})):
        looked.clear()
        got = {x.story_id: tuple(x)[3:] for x in C.select_stories(df, top_n, limits, 2, profiled).collect()}
        expected = {}
        for run in ("r0", "r1"):
            ranked = [{"story_id": i, "feed": feeds[i], "publisher": who, "profile": {**told[i]}} for i, x, who, _, _ in sorted(extra, key=lambda x: (-x[3], -x[4], x[0])) if x == run]
            expected |= {x[0]: x[1:] for x in C.fold(ranked, top_n, limits, 2)}
        assert got == expected and len(got) == 240
        assert len(looked) <= 4 and sum(map(len, looked)) < 120
    assert {x[2] for x in expected.values()} == {"capacity"}


def test_exploration_is_a_permutation(spark):
    rows = [("u", i, i, 100 - i, -1.0 if i % 7 == 0 else 1.0) for i in range(35)]
    df = spark.createDataFrame(rows, "user_id string, item_id long, model_rank long, editorial long, preference double")
    got = R.explored(df, "2024-01-31").toPandas().sort_values("position")
    assert sorted(got.item_id) == list(range(35)) and set(got[got.is_exploration].position) <= {9, 19, 29}
    assert got[~got.is_exploration].shape[0] >= 32
    few = R.explored(df.where("item_id < 9"), "2024-01-31").toPandas()
    assert not few.is_exploration.any()


def test_exploration_by_its_rule(spark):
    r = random.Random(7)
    rows = [("u", i, i, r.randrange(1000) * 1000 + i, r.choice([-1.0, 1.0])) for i in range(404)]
    order, pool = list(range(404)), sorted((x[1] for x in rows if x[4] >= 0), key=lambda i: -rows[i][3])
    for slot in range(9, 404, 10):
        found = next((i for i in pool if order.index(i) > slot), None)
        if found is not None:
            j = order.index(found)
            order[slot], order[j] = order[j], order[slot]
    got = R.explored(spark.createDataFrame(rows, "user_id string, item_id long, model_rank long, editorial long, preference double"), "2024-01-31").toPandas()
    assert got.sort_values("position").item_id.tolist() == order


def test_exploration_of_ties_by_the_hash_of_whole_characters(spark):
    def hashed(text):
        h = 2166136261
        for c in text:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return h

    ids = [f"{c}{i}" for i in range(20) for c in "aąЖ"]
    rows = [("u", x, n, 5, 1.0) for n, x in enumerate(ids)]
    order, pool = list(ids), sorted(ids, key=lambda x: hashed(f"2024-01-31:{x}"))
    for slot in range(9, len(ids), 10):
        found = next((x for x in pool if order.index(x) > slot), None)
        if found is not None:
            j = order.index(found)
            order[slot], order[j] = order[j], order[slot]
    got = R.explored(spark.createDataFrame(rows, "user_id string, item_id string, model_rank long, editorial long, preference double"), "2024-01-31").toPandas()
    assert got.sort_values("position").item_id.tolist() == order


def test_all_items_are_ranked_for_readers(spark, small, monkeypatch):
    from tidewell.plans import queries as Q

    plain = Q.stories
    monkeypatch.setattr(Q, "stories", lambda *a, **b: plain(*a, **b).withColumn("article_id", F.col("article_id") + 1000))
    got, n = Q.rank_foryou(spark, small).toPandas(), Q.A.articles(spark, small).count()
    assert len(got) == 10 * n and got.item_id.min() >= 1000
    for _, g in got.groupby("user_id"):
        g = g.sort_values("model_rank")
        assert g.model_rank.tolist() == list(range(n)) and g.rank_score.is_monotonic_decreasing


def test_implicit_events_keep_the_strongest(spark):
    rows = [(1, "x", "d", 1, "fast_read", "direct"), (1, "x", "d", 1, "save", None), (1, "y", "d", 1, "read", "direct"), (1, "z", "d", 1, "save", "bulk"), (1, "z", "d", 1, "save", "automatic")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "user_id long, session_id string, day string, story_id long, event_type string, origin string, ordinal long")
    assert [r.ordinal for r in R.implicit_events(df).collect()] == [1]


def test_preferences(spark):
    b = spark.createDataFrame([("u", 1, "AI", "HF Blog", "NVIDIA tooling shipping agents", "more", None, 1.0, 0), ("u", 2, "AI", "Other", "x", "less", "source", 1.0, 0), ("u", 3, "AI", "Z", "x", "less", "repetitive", 1.0, 0)], "user_id string, story_id long, category string, source string, text string, sentiment string, reason string, weight double, updated_epoch long")
    items = spark.createDataFrame([("u", 1, 9, "AI", "HF Blog", "NVIDIA tooling shipping agents today"), ("u", 2, 9, "Software", "Other", "nothing"), ("u", 3, 3, "Software", "None", "nothing")], "user_id string, item_id long, story_id long, category string, source string, text string")
    got = {r.item_id: r.preference for r in R.preference_scores(items, R.preference_profile(b, 0)).collect()}
    assert got == {1: 16.0, 2: -8.0, 3: -20.0}
    old = R.preference_profile(b.where("story_id = 1"), 45 * 86400).where("kind = 'source'").first()
    assert abs(old.more - 0.5) < 1e-12


def test_sections_and_pages(spark):
    df = spark.createDataFrame([(i, i, "security_risk" if i == 6 else "x") for i in range(22)], "item_id long, position long, bucket string")
    got = R.sections(df).toPandas()
    assert got.section.value_counts().to_dict() == {"next": 10, "rest": 6, "top": 5, "actionable": 1}
    cursor = df.where("item_id = 4").select(R.cursor_of(F.col("item_id"))).first()[0]
    assert sorted(r.item_id for r in R.page_after(df, cursor, 10).collect()) == list(range(5, 15))
    assert min(r.item_id for r in R.page_after(df, "gone", 10).collect()) == 0


def test_quality_labels(spark):
    good = [("a", True, 20, 10, 5, 3, 2)] * 6
    bad = [("b", i < 2, 20, 10, 5, 3, 2) for i in range(8)]
    o = spark.createDataFrame(good + bad, "source_id string, succeeded boolean, parsed long, eligible long, unique_stories long, selected long, confirmed long")
    v = spark.createDataFrame([("a", 12.0)], "source_id string, value double")
    got = {r.source_id: r for r in E.source_quality(o, v).collect()}
    a = got["a"]
    assert (a.confirmation_value, a.fresh_yield, a.selection_value, a.unique_yield, a.reliability, a.label) == (40, 50, 60, 50, 100, "Often selected")
    assert got["b"].recommendation == "consider_pausing"


def test_reader_value(spark):
    e = spark.createDataFrame([(1, "source_open", "direct"), (1, "save", None), (1, "read", "bulk")], "story_id long, event_type string, origin string")
    s = spark.createDataFrame([(1, "src1", "canonical"), (1, "src2", "confirmation")], "story_id long, source_id string, contribution string")
    assert {r.source_id: r.value for r in E.reader_value(e, s).collect()} == {"src1": 2.5, "src2": 1.5}


def test_exposure(spark):
    rows = [(1, 0, 0.6, True), (1, 300, 0.4, True), (1, 400, 0.7, True), (1, 800, 0.9, True), (1, 950, 0.1, True), (2, 0, 0.9, False), (2, 900, 0.9, True)]
    df = spark.createDataFrame(rows, "item_id long, at_ms long, ratio double, visible boolean")
    assert [(r.item_id, r.started, r.seen_at) for r in E.exposure_islands(df).collect()] == [(1, 400, 900)]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, n long")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "id long, v string, n long")
    got = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert got(M.upsert(old, new, ["id"])) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]
    once = M.upsert(old, new, ["id"])
    assert got(M.upsert(once, new, ["id"])) == got(once)
    assert got(M.upsert_newest(old, new, ["id"], "n")) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]
    k = spark.createDataFrame([("x", 1), (None, 2)], "k string, i long")
    more = spark.createDataFrame([("x", 3), ("y", 4), ("y", 5), (None, 6)], "k string, i long")
    assert sorted(r.i for r in M.insert_ignore(k, more, "k", "i").collect()) == [1, 2, 4, 6]
    assert got(M.monotone(old.select("id", "n"), new.select("id", "n"), "id", "n")) == [(1, 1), (2, 2), (3, 2)]


def test_runs(spark):
    s = L.new_run(spark, "r")
    assert L.claimable(s).first().stage == "source_fetch"
    s = L.transition(s, "r", "source_fetch", "running", 100)
    assert L.claimable(s).isEmpty() and L.reclaim_stale(s, 150).where("status = 'running'").count() == 1
    s = L.reclaim_stale(s, 300)
    assert L.claimable(s).first().stage == "source_fetch"
    s = L.transition(L.transition(s, "r", "source_fetch", "succeeded", 300), "r", "article_normalization", "failed", 301)
    assert L.progress(s).first().percent == 14
    assert L.retry(s, "r").where("status = 'queued'").count() == 6 and L.reset(s, "r").where("status = 'skipped'").count() == 5


def test_portfolio(spark):
    rows = [("a", "ai", "auto", 90.0), ("b", "ai", "auto", 80.0), ("c", "ai", "auto", 70.0), ("d", "sw", "always_on", 10.0), ("e", "sw", "auto", 60.0), ("f", "sw", "blocked", 99.0), ("g", "sw", "auto", 5.0), ("h", "sw", "auto", 6.0)]
    df = spark.createDataFrame([(*x, 4 if x[0] in "gh" else 0, 0.1 if x[0] == "g" else 0.5) for x in rows], "source_id string, feed string, mode string, score double, healthy_probes long, confidence double")
    assert {r.source_id: r.role for r in P.portfolio(df, 6, 1).collect()} == {"a": "category_minimum", "b": "category_minimum", "c": "budget", "d": "always_on", "e": "category_minimum", "f": "none", "g": "explore", "h": "none"}


def plain_portfolio(sources, previous, minimum, budget, explore, probes, ratio):
    """The whole automatic policy, a step after the other; sources: id, feed, mode, score, confidence, healthy."""
    feeds = P.V.FEEDS
    by = {s[0]: s for s in sources}
    auto = sorted((s for s in sources if s[2] == "auto"), key=lambda s: (-s[3], s[0]))
    picked = [s[0] for s in sources if s[2] == "always_on"]
    for f in feeds:
        for s in auto:
            if s[1] == f and sum(by[x][1] == f for x in picked) < minimum and s[0] not in picked:
                picked.append(s[0])
    for s in auto:
        if len(picked) < max(budget - explore, 0) and s[0] not in picked:
            picked.append(s[0])
    new = [s[0] for s in sorted((s for s in auto if s[0] not in picked and s[5] >= 3), key=lambda s: s[4])][:explore]
    picked += new
    actual = set(picked)
    if previous:
        actual = {x for x in previous if by[x][2] != "blocked"} | {s[0] for s in sources if s[2] == "always_on"}
        moves = [x for x in picked if x not in actual] + sorted(x for x in actual if x not in picked and by[x][2] == "auto")
        for x in moves[: max(1, int(len(previous) * ratio))]:
            actual ^= {x}
    for f in feeds:
        for s in auto:
            if s[1] == f and s[0] in picked and sum(by[x][1] == f for x in actual) < minimum:
                actual.add(s[0])
    probe = [s[0] for s in auto if s[0] not in actual and s[4] < 0.3][:probes]
    return {s[0]: (s[0] in actual, s[0] in picked, ("explore" if s[0] in new else "selected") if s[0] in actual else "probe" if s[0] in probe else "skipped") for s in sources}


def test_automatic_portfolio_by_its_rule(spark):
    for seed in range(6):
        r = random.Random(seed)
        sources = [(f"s{i:02d}", r.choice(P.V.FEEDS), r.choice(["auto"] * 6 + ["always_on", "blocked"]), float(r.randrange(100)), r.randrange(11) / 10, r.randrange(6)) for i in range(40)]
        previous = {s[0] for s in sources if r.random() < 0.4} if seed else set()
        df = spark.createDataFrame([(*s, True, 40) for s in sources], "source_id string, feed string, mode string, score double, confidence double, healthy_probes long, enabled boolean, category_need int")
        before = spark.createDataFrame([(x,) for x in previous], "source_id string")
        got = P.decisions(P.limited_changes(P.portfolio(df, 20, 2, 3), before, 0.2, 3), automatic=True, probes=2).collect()
        assert {x.source_id: (x.actual_selected, x.proposed_selected, x.role) for x in got} == plain_portfolio(sources, previous, 3, 20, 2, 2, 0.2), seed


def test_runs_advance(spark):
    clock = iter(range(0, 1000, 10))
    stages, active = L.start_run(L.new_run(spark, "a"), "b")
    assert active == "a" and stages.count() == 7
    done = []

    def runner(name):
        def run(metrics):
            batch, metrics = L.next_batch(list(range(9)), metrics)
            done.append((name, batch))
            if name == "reader_publication":
                raise ValueError("no")
            return name != "enrichment" or len(metrics["processed"]) == 9, metrics

        return run

    stages, ran, metrics = L.advance_until(stages, "a", {s: runner(s) for s in L.ORDER}, lambda: next(clock), 500)
    assert ran == ["source_fetch", "article_normalization", "story_clustering", "enrichment", "enrichment", "enrichment", "editorial_scoring", "reader_publication"]
    assert [b for n, b in done if n == "enrichment"] == [[0, 1, 2, 3], [4, 5, 6, 7], [8]] and metrics["reader_publication"] == {"error": "no"}
    assert L.run_status(stages).first().status == "failed" and L.run_status(L.reset(L.retry(stages, "a"), "a")).first().status == "cancelled"
    assert L.start_run(stages, "b")[1] == "b"
    spent, ran, _ = L.advance_until(L.retry(stages, "a"), "a", {s: lambda m: (True, m) for s in L.ORDER}, iter([0, 1, 100, 200]).__next__, 50)
    assert ran == ["reader_publication"]


def test_frozen_portfolios(spark):
    old = spark.createDataFrame([("r1", "s")], "run_id string, source_id string")
    build = lambda: spark.createDataFrame([("t",)], "source_id string")
    assert [tuple(x) for x in P.frozen_portfolio(old, "r1", build).collect()] == [("r1", "s")] and [tuple(x) for x in P.frozen_portfolio(old, "r2", build).collect()] == [("r2", "t")]


def test_places_over_all_rows(spark, monkeypatch):
    from tidewell.operators import order as O

    r = random.Random(3)
    rows = [(i, r.choice([1, 1, 1, 1, 2, 7]), r.randrange(3)) for i in range(500)]  # one value has most rows
    df = spark.createDataFrame(rows, "id long, a long, b long")
    got = {x.id: x.place for x in O.placed(df, [("a", True), ("b", False), ("id", False)], "place").collect()}
    assert got == {x[0]: n for n, x in enumerate(sorted(rows, key=lambda x: (-x[1], x[2], x[0])))}
    assert O.placed(df.where("false"), [("a", True), ("id", False)], "place").count() == 0


def test_replaced_runs_on_disk(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, n long")
    M.replace_runs(df, f"{tmp_path}/t")
    M.replace_runs(spark.createDataFrame([("b", 3)], df.schema), f"{tmp_path}/t")
    assert sorted((x.run_id, x.n) for x in spark.read.parquet(f"{tmp_path}/t").collect()) == [("a", 1), ("b", 3)]


def test_changes_and_history(spark):
    now = spark.createDataFrame([("k1", "t", "s", "a", 1), ("k2", "t", "s", "a", 1), ("k3", "t", "s", "a", 1)], "story_key string, title string, summary string, canonical_source string, source_count long")
    old = spark.createDataFrame([("k2", "u", "v", "b", 2), ("k3", "t", "s", "a", 1)], now.schema)
    assert {r.story_key: r.changes for r in D.changes(now, old).collect()} == {"k1": ["new"], "k2": ["title", "summary", "canonical_source", "source_count"], "k3": []}
    s = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "story_id long, story_key string")
    assert {r.story_id: r.adopted_key for r in D.match_history(s, s.where("story_id < 3")).collect()} == {1: "x", 2: None, 3: None}


def test_publication(spark):
    from tidewell.operators import publishing as B

    row = lambda e, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(e.alias("x")).first()[0]
    c = F.col("c0")
    assert row(B.published_summary(c, F.col("c1"), 20), "", "A title") == "A title" and row(B.published_summary(c, F.col("c1"), 20), None, "") == "No summary availabl..."
    assert row(B.language(c), "<rss><language>pl-PL</language></rss>") == "pl-pl" and row(B.language(c), "to jest dla przez się") == "pl" and row(B.language(c), "the cat and the dog with that") == "en" and row(B.language(c), "xyz") == "unknown"
    assert row(B.category(c), "a cve, a breach and a bank") == "Cybersecurity" and row(B.category(c), "bank war") == "Business / Markets" and row(B.category(c), "zzz") == "General"
    assert row(B.error_class(c), "HTTP 503 from host") == "http_503" and row(B.error_class(c), "timed out") == "timeout" and row(B.error_class(c), "bad") == "network_or_parse_error"
    assert [row(address.blocked_ipv6(c), a) for a in ("::1", "fe80::1", "::ffff:10.0.0.1", "2606:4700::1111", "nonsense")] == [True, True, True, False, True]
    assert row(B.keyword_setting(c), " Foo,bar\nfoo ,, b  c") == ["foo", "bar", "b c"]
    a, b = spark.createDataFrame([(1,)], "i int"), spark.createDataFrame([(2,)], "i int")
    assert [r.i for r in B.fallback_rows(a, b).collect()] == [1] and [r.i for r in B.fallback_rows(a.where("false"), b).collect()] == [2]
    brief = B.brief_lines(spark.createDataFrame([("r", i, f"t{i}") for i in (3, 1, 2, 0, 5, 4)], "run_id string, selection_rank int, title string")).first()
    assert brief.n_items == 6 and brief.titles == ["t0", "t1", "t2", "t3", "t4"]


def test_duplicates_in_blocks_and_groups(spark, small, monkeypatch):
    from tidewell.operators import stories as D
    from tidewell.plans import queries as Q

    p = Q.profiles(spark, small)
    k, _ = D.kept_classes(p)
    assert k.schema["text_tokens"].dataType.simpleString() == "array<bigint>" and "summary" not in k.columns
    told = lambda d: sorted((*sorted((x.left, x.right)), x.reason, round(x.score, 9)) for x in d.where("duplicate").collect())
    expected = told(D.all_decisions(k))
    monkeypatch.setattr(D, "KEY_BLOCK", 3)
    monkeypatch.setattr(D, "CELL_PAIRS", 1)
    monkeypatch.setattr(D, "CELL_CLASSES", 7)
    near = {tuple(sorted((x.left, x.right))) for x in D.judged_pairs(k).select("left", "right").collect()}
    assert expected and told(D.class_decisions(k)) == [x for x in expected if x[0] == x[1] or x[:2] in near]
