"""Addresses, JSON of any shape, and policies in SQL."""

import ipaddress
import json
import random

from pyspark.sql import functions as F

from tidewell.functions import address, variant
from tidewell.operators import policies


def test_ipv6_addresses_are_read_as_the_standard_library_reads_them(spark):
    r = random.Random(1)
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2", "1::2::3", ":::", "g::", "12345::", "", ":", "::ffff:1.2.3.4", "::1.2.3.256", "1.2.3.4::", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "1::2:3:4:5:6:7:8", "FE80::ABCD"]
    for _ in range(300):
        a = ipaddress.IPv6Address(r.getrandbits(128) & r.getrandbits(128) & r.choice([-1, r.getrandbits(128)]))
        texts += [a.compressed, a.exploded.upper()]
    df = spark.createDataFrame([(x,) for x in [*texts, None]], "a string")
    for x in df.select("a", address.ipv6_digits(F.col("a")).alias("d")).collect():
        try:
            expected = f"{int(ipaddress.IPv6Address(x.a)):032x}"
        except ValueError:
            expected = None
        assert x.d == expected, x


def test_addresses_that_no_fetch_may_reach(spark):
    closed = ["::", "::1", "fe80::1%eth0", "fc00::1", "fdff::", "ff02::1", "fec0::1", "::ffff:127.0.0.1", "::ffff:a00:1", "64:ff9b::a9fe:a9fe", "64:ff9b::7f00:1", "2001::1", "2001:db8::1", "2002:a9fe:a9fe::1", "::7f00:1", "4000::", "127.0.0.1", "169.254.169.254", "nonsense", "", "1.2.3", "::ffff:1.2.3.999"]
    open_ = ["2606:4700:4700::1111", "2001:4860:4860::8888", "::ffff:8.8.8.8", "2001:db9::1", "3fff:ffff::1", "8.8.8.8", "2001:1::"]
    df = spark.createDataFrame([(x,) for x in closed + open_], "a string")
    got = {x.a: x.b for x in df.select("a", address.blocked_address(F.col("a")).alias("b")).collect()}
    assert {a for a, b in got.items() if not b} == set(open_)
    assert spark.range(1).select(address.blocked_address(F.lit(None).cast("string")).alias("b")).first().b


def test_merges_keep_the_newer_member(spark):
    pairs = [('{"a":1,"b":{"x":1}}', '{"b":{"y":2},"c":null}'), ('{"a":1}', "{broken"), (None, '{"a":[1]}'), ('{"a":1}', None), ("[1]", "7"), ('{"":1,"a.b":"ü\\n"}', '{"a.b":2,"$":3}')]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", F.transform_values(variant.merged(variant.json_object(F.col("a")), variant.json_object(F.col("b"))), lambda _, v: F.to_json(v)).alias("m")).collect()

    def obj(t):
        try:
            x = json.loads(t)
        except (TypeError, ValueError):
            return {}
        return x if isinstance(x, dict) else {}

    for x in got:
        assert {k: json.loads(v) for k, v in x.m.items()} == {**obj(x.a), **obj(x.b)}


def plain_brief(content, n):
    """The rule of a brief, as a loop."""
    say = lambda v: v.strip() or None if isinstance(v, str) else None
    try:
        x = json.loads(content.strip())
    except (AttributeError, ValueError):
        return None
    if not isinstance(x, dict) or not say(x.get("summary")) or not isinstance(x.get("highlights"), list):
        return None
    seen, lines = set(), []
    for h in x["highlights"]:
        if isinstance(h, dict):
            i, why = h.get("articleIndex"), say(h.get("whyItMatters"))
            if isinstance(i, (int, float)) and not isinstance(i, bool) and i == int(i) and 0 <= i < min(n, 10) and why and i not in seen:
                seen.add(i)
                lines.append((int(i), why))
    return (say(x["summary"]), lines[:5]) if lines else None


def test_briefs_are_read_strictly(spark):
    r = random.Random(2)
    index = lambda: r.choice([0, 1, 2, 3, 4, 5, 6, 9, 10, 11, -1, 1.5, 2.0, "1", None, True, [1], 1e20])
    line = lambda: r.choice([{"articleIndex": index(), "whyItMatters": r.choice(["why", " x ", "", None, 3])}, {"articleIndex": index(), "whyItMatters": f"w{r.random()}"}, 7, None, []])
    made = [{"summary": r.choice(["s", " s ", "t", "u", "", None, 1, ["s"]]), "highlights": r.choice([[line() for _ in range(r.randrange(12))], [line() for _ in range(12)], [line() for _ in range(12)], None, {}])} for _ in range(400)]
    texts = [json.dumps(x) for x in made] + ["", None, "{", "[]", "null", ' {"summary":"s","highlights":[{"articleIndex":0,"whyItMatters":"w"}]} ']
    rows = [(i, t, r.choice([1, 5, 12])) for i, t in enumerate(texts)]
    got = spark.createDataFrame(rows, "i int, t string, n int").select("i", variant.brief(F.col("t"), F.col("n")).alias("b")).collect()
    told = {x.i: x.b and (x.b.summary, [(h.articleIndex, h.whyItMatters) for h in x.b.highlights]) for x in got}
    assert told == {i: plain_brief(t, n) for i, t, n in rows} and sum(v is not None for v in told.values()) > 40


def test_previews_need_all_their_texts(spark):
    whole = {"clickIf": "c", "practicalBucket": " b ", "whatHappened": "<i>h</i>", "whyItMatters": "w", "entities": ["a", "a", 1, " ", "b"], "topics": [str(i) for i in range(12)]}
    rows = [json.dumps(whole), json.dumps({**whole, "clickIf": " "}), json.dumps({k: v for k, v in whole.items() if k != "whyItMatters"}), json.dumps({**whole, "topics": None, "entities": "x"}), "nothing"]
    got = [x.p for x in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", variant.preview(F.col("t")).alias("p")).orderBy("i").collect()]
    assert tuple(got[0]) == ("c", ["a", "b"], "b", [str(i) for i in range(8)], "h", "w")
    assert got[1] is None and got[2] is None and (got[3].topics, got[3].entities) == ([], []) and got[4] is None


def test_policies_hold_for_any_statement(spark):
    readers = spark.createDataFrame([(1, "One@x.org"), (2, "two@x.org"), (3, None)], "user_id long, email string")
    allowed = spark.createDataFrame([("one@x.org",), (None,)], "email string")
    policies.allow_readers(spark, allowed, readers)
    notes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "user_id long, text string")
    seen = {}
    for who in ("ONE@x.org", "two@x.org", "none@x.org", None):
        policies.set_reader(spark, who)
        policies.protect(spark, notes, "own_notes", "user_id")
        policies.protect(spark, notes, "open_notes")
        seen[who] = (sorted(x.text for x in spark.sql("SELECT text FROM own_notes").collect()), spark.sql("SELECT count(*) AS n FROM open_notes").first().n)
    assert seen == {"ONE@x.org": (["a", "b"], 5), "two@x.org": ([], 0), "none@x.org": ([], 0), None: ([], 0)}
    policies.set_reader(spark, "one@x.org")
    plan = spark.sql("SELECT text FROM own_notes WHERE text > 'a'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 1 and "Filter" in plan
    assert not spark.sql(f"SELECT {policies.FUNCTION}(NULL) AS x").first().x


def test_pages_of_a_kept_ranking(spark, tmp_path):
    from tidewell.operators import snapshots as S

    r = random.Random(3)
    ids = r.sample(range(10**6), 1000)
    rows = [(x, i) for i, x in enumerate(ids)]
    context, other = "0b5f1c1e-7a51-4f0e-9d0c-3f1f5a6b7c8d", "1b5f1c1e-7a51-4f0e-9d0c-3f1f5a6b7c8d"
    ranked = spark.createDataFrame(rows, "item_id long, position long")
    path = str(tmp_path / "r")
    S.keep_ranking(ranked, path, context)
    S.keep_ranking(ranked.withColumn("position", 999 - F.col("position")), path, other)
    S.keep_ranking(ranked, path, context)  # again
    for at in (None, 0, 254, 255, 970, 998, 999):
        start = 0 if at is None else at + 1
        got = S.page(spark, path, context, None if at is None else str(ids[at]), 30)
        assert sorted((x.position, x.item_id) for x in got.collect()) == [(i, ids[i]) for i in range(start, min(start + 30, 1000))]
    assert S.page(spark, path, context, "no item").count() == 30
    assert S.page(spark, path, "no context", "5").count() == 0
    plan = S.page(spark, path, context, str(ids[300]), 30)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(context" in plan and "span" in plan.split("PartitionFilters")[1][:300]
    assert len(S.page(spark, path, context, str(ids[300]), 30).inputFiles()) <= 2 * 8
    good = ("x", context, "2024-01-31T10:00:00Z")
    assert S.resolve(*good) == (context, "2024-01-31T10:00:00.000Z", True)
    new = (other, "now")
    for bad in ((None, *good[1:]), ("x", "no uuid", good[2]), ("x", None, good[2]), ("x", context, "yesterday"), ("x", context, None)):
        assert S.resolve(*bad, new=new) == (*new, False)
    assert S.resolve(*good, known={other}, new=new) == (*new, False)


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    from tidewell.streaming.sink import insert_once

    kind = "event_key string, at long"
    put = lambda *rows: spark.createDataFrame(list(rows), kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path, write = str(tmp_path / "out"), insert_once(str(tmp_path / "out"), "event_key", "at")
    tries = []

    def fails_once(batch, number):
        write(batch, number)
        tries.append(number)
        if len(tries) in (1, 3):
            raise RuntimeError("lost between the write and the note of it")

    def run():
        s = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        q = s.writeStream.foreachBatch(fails_once).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception:  # noqa: BLE001  the stream is started again
            return False
        return True

    put(("a", 2), ("a", 1), ("b", 5), (None, 1), (None, 1))
    assert not run() and run()
    put(("b", 1), ("c", 3), ("c", 4), (None, 1))
    assert not run() and run() and run()
    got = sorted(((x.event_key, x.at) for x in spark.read.parquet(path).collect()), key=str)
    assert got == sorted([("a", 1), ("b", 5), ("c", 3), (None, 1), (None, 1), (None, 1)], key=str) and len(tries) == 4


def test_a_table_that_is_not_there_has_no_rows(spark):
    from tidewell.operators import lifecycle as L

    assert L.table_or_empty(spark, "no_such_table", "a long, b string").count() == 0
    spark.createDataFrame([(1, "x")], "a int, c string").createOrReplaceTempView("half_a_table")
    assert [tuple(x) for x in L.table_or_empty(spark, "half_a_table", "a long, b string").collect()] == [(1, None)]


def test_payloads_of_a_folder(spark, tmp_path):
    """A file that can't be read, or holds no text, costs nothing of the others."""
    from tidewell.sources import payloads as K

    root = tmp_path / "p"
    for source, data in (("a", b"<item/>\n<item/><item/>\n"), ("b", b"\xff\xfe broken"), ("c", "<item>ü</item>".encode()), ("d", b""), ("a/more", b"<entry/>")):
        (root / f"source_id={source}").mkdir(parents=True, exist_ok=True)
        (root / f"source_id={source}" / "x.xml").write_bytes(data)
    (root / "source_id=a" / "_SUCCESS").write_bytes(b"x")
    df = K.payloads(spark, str(root))
    assert df.rdd.getNumPartitions() == 5
    got = sorted((x.source_id, x.body or "", x.error or "") for x in df.collect())
    assert got == [("a", "<entry/>", ""), ("a", "<item/>", ""), ("a", "<item/><item/>", ""), ("b", "", "UnicodeDecodeError"), ("c", "<item>ü</item>", "")]


def test_catalogs_are_taken_whole_or_not_at_all(spark, tmp_path):
    from tidewell.sources import payloads as K

    good = [{"name": "A", "category": "c", "url": "https://a.org/feed"}, {"name": "B", "category": "c", "url": "http://b.org", "enabled": False, "priority": 4}]
    (tmp_path / "good.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "bad.json").write_text(json.dumps([*good, {"name": "C", "category": "c", "url": "https://c.org", "priority": 6}]))
    (tmp_path / "broken.json").write_text('[{"name":')
    assert [tuple(x) for x in K.read_catalog(spark, str(tmp_path / "good.json")).orderBy("ordinal").collect()] == [(0, "A", "c", "https://a.org/feed", None, None), (1, "B", "c", "http://b.org", False, 4)]
    assert K.read_catalog(spark, str(tmp_path / "bad.json")).count() == 0 and K.read_catalog(spark, str(tmp_path / "broken.json")).count() == 0
