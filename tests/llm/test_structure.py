"""Repair of conversations, fill-in-middle and exact duplicates against plain statements of them: op11, op12, op13."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tidewell.llm import op11_conversations as op11
from tidewell.llm import op12_fim as op12
from tidewell.llm import op13_exact as op13

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# --- op11 ------------------------------------------------------------------------------------------------------------

GRAMMAR = re.compile(r"(s?(ua)+)?")


def marks_of(rows):
    """The first fault of each row (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        solid = SPACE.sub("", text)
        out.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ".")
        seen.add((role, text))
    return out


def brute_repair(rows, most_inserts=2):
    """The cheapest edits of a few rows (role, text) among all of them, and the repaired rows."""
    marks = marks_of(rows)
    options = []
    for mark in marks:
        ops = [("D", 4)] if mark in "bd" else [("D", 4), ("K", 3 * (mark == "t")), ("R", 3 + 3 * (mark == "t"))]
        options.append([("I" * k + op, 3 * k + c) for k in range(most_inserts + 1) for op, c in ops])
    options.append([("I" * k, 3 * k) for k in range(most_inserts + 1)])
    best = None
    for way in itertools.product(*options):
        cost, audit = sum(c for _, c in way), "".join(a for a, _ in way)
        if best and (cost, audit) >= best[:2]:
            continue
        free = sum(x in "IR" for x in audit)
        for roles in itertools.product(("user", "assistant"), repeat=free):
            given, out, i = iter(roles), [], 0
            for x in audit:
                role, text = rows[i] if i < len(rows) and x != "I" else ("", "")
                i += x != "I"
                if x != "D":
                    out.append((role if x == "K" else next(given), text))
            if GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                best = (cost, audit, out)
                break
    return best


def symbols(rows):
    return "".join(r[0] if r[:1] in ("s", "u", "a") else "x" for r, _ in rows), "".join(marks_of(rows))


def chart_repair(rows, cuts):
    """The same by charts of segments."""
    initials, marks = symbols(rows)
    marks = op11._forced(marks)
    ends = [0, *sorted(cuts), len(rows)]
    parts = [(initials[a:b], marks[a:b]) for a, b in zip(ends, ends[1:]) if b > a]
    cost, path = op11.through([op11.transfer(*p) for p in parts])
    audit, out, at = "", [], 0
    for k, (p, (start, end)) in enumerate(zip(parts, path)):
        per_row = op11.edits(*p, start, end, k == len(parts) - 1)
        audit += "".join(per_row)
        for made in op11.given(per_row, p[0], start):
            out += [(role or rows[at][0], "" if edit == "I" else rows[at][1]) for edit, role in made]
            at += 1
    return cost, audit, out


def test_charts_of_segments_find_the_least_cost_and_audit():
    r = random.Random(1)
    for n in (1, 2, 3, 4):
        for _ in range(60 if n < 4 else 12):
            rows = [(r.choice(["system", "user", "user", "assistant", "tool", " "]), r.choice(["Yes.", "so", " ", "Go!", f"w{r.random()}."])) for _ in range(n)]
            cost, audit, out = brute_repair(rows)
            for cuts in ([], range(1, n), [r.randrange(n)]):
                assert chart_repair(rows, cuts) == (cost, audit, out), rows


def test_long_conversations_in_segments_as_whole():
    r = random.Random(2)
    for _ in range(30):
        rows = [(r.choice(["system", "user", "assistant", "bot"]), r.choice(["a.", "b", "", f"{r.random()}?"])) for _ in range(200)]
        whole = chart_repair(rows, [])
        assert GRAMMAR.fullmatch("".join(x[0] for x, _ in whole[2]))
        for _ in range(3):
            assert chart_repair(rows, r.sample(range(1, 200), 9)) == whole


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_query(rows):
    out, after = [], plain_damage(rows)
    for conv in {x[0] for x in rows}:
        own = [x[1:] for x in after if x[0] == conv]
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).digest()))
        turns = [t for t, _, _ in own if t is not None]
        said = [(role, text) for _, role, text in own]
        marks, (initials, _) = marks_of(said), symbols(said)
        cost, audit, made = chart_repair(said, []) if said else (0, "", [])
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(marks.count(m) for m in "bdt"), illegal, cost, audit, sha("\n".join(f"{a}:{b}" for a, b in made))))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
KIND = "conv_id long, turn long, role string, text string, cost string"


def write(spark, tmp_path, rows):
    spark.createDataFrame([(*x, "x") for x in rows], KIND).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return op11.op11_conversations(spark, str(tmp_path))


def test_conversations_with_nulls_ties_copies_and_long_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op11, "SEGMENT_BITS", 3)
    r = random.Random(3)
    pick = lambda n: r.choice([None, "system", "user", "assistant", "user", "assistant", "", "Tool"][:n])
    text = lambda: r.choice([None, "", " \n", "Same.", f"Say {r.random()}.", f"cut {r.random()}", "é" * 2000 + "!"])
    rows = [(r.choice([None, 1, 2, 3, 4, -5]), r.choice([None, *range(9)]), pick(8), text()) for _ in range(150)]
    rows += rows[:20] + [(9, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(300)] + [(7, 0, "user", "The same.")] * 60 + [(8, 2**63 - 1, "user", "End."), (8, -(2**63), "user", "Begin.")]
    got = write(spark, tmp_path, rows)
    assert got.columns == COLUMNS
    expected = [tuple(min(v, 2**63 - 1) if i == 1 else v for i, v in enumerate(x)) for x in plain_query(rows)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_conversations_of_which_nothing_is_left_and_none_at_all(spark, tmp_path):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert [tuple(x) for x in write(spark, tmp_path, [(conv, 0, "user", "Gone.")]).collect()] == [(conv, 0, 0, 0, 0, 0, 0, "", sha(""))]
    assert write(spark, tmp_path, []).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Well?"), (1, 2, "bot", "Yes."), (1, 3, "bot", "Yes.")]
    made, told = op11.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [tuple(x) for x in made.orderBy("at", "place").select("edit", "role", "text").collect()] == [("I", "user", ""), ("K", "assistant", "Hi."), ("K", "user", "Well?"), ("R", "assistant", "Yes.")]
    assert [tuple(x) for x in told.select("cost", "audit", "duplicate").collect()] == [(10, "IKKRD", 1)]


# --- op12 ------------------------------------------------------------------------------------------------------------


def plain_fim(i, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, m, z = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return i, n, "plain", None, None, text
    if h4 % 100 < spm:
        return i, n, "spm", len(a), len(m), f"<S>{z}<P>{a}<M>{m}"
    return i, n, "psm", len(a), len(m), f"<P>{a}<S>{z}<M>{m}"


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_fill_in_middle_equals_the_plain_form(spark, docs, monkeypatch, block):
    r = random.Random(block)
    bits = ["a", "\n", "\n\n", "é", "日本", "😀", "<", "<P", "<S", "<M", "M>", ">", "\r\n", "<<", "<P\n>", "x" * 40]
    texts = ["", None, "\n", "a", "<P>", "<<M>", "<P<S>", "a\n<M\nP>", *("".join(r.choices(bits, k=r.randrange(60))) for _ in range(250))]
    texts += ["".join(r.choices(bits[:6], k=40_000))]
    ids = [*range(len(texts) - 2), None, 5]
    with monkeypatch.context() as m:
        m.setattr(op12, "BLOCK", block)
        data = "".join(t or "" for t in texts).encode()
        ends = np.cumsum([0, *(len((t or "").encode()) for t in texts)])
        auto = op12.Automaton()
        first, _, before = found = auto.scan(np.frombuffer(data, np.uint8), ends)
        for k, t in enumerate(texts):
            t = t or ""
            points, units, sentinels = before[first[k + 1]] - before[first[k]]
            assert (points, units, sentinels > 0) == (len(t), t.count("\n"), any(s in t for s in op12.SENTINELS))
            lines = re.findall(r"[^\n]*\n|[^\n]+", t)
            assert units + auto.open[k] == len(lines)
            at, seen = auto.locate(np.frombuffer(data, np.uint8), ends, found, np.full(len(lines) + 1, k), np.arange(len(lines) + 1))
            assert seen.tolist() == [len("".join(lines[:i])) for i in range(len(lines) + 1)]
            assert at.tolist() == [len("".join(lines[:i]).encode()) for i in range(len(lines) + 1)]
    df = docs(texts, ids).withColumnRenamed("n_chars", "output")
    for rate, spm in ((100, 50), (60, 30)):
        made = op12.fill_in_middle(df, rate=rate, spm=spm)
        back = {}
        for x in made.withColumn("back", op12.restored(made["output"], made["form"])).collect():
            back.setdefault(x.id, []).append(tuple(x)[:-1])
            assert any((t or "") == x.back for i, t in zip(ids, texts) if i == x.id)
        assert sorted((x for v in back.values() for x in v), key=str) == sorted((plain_fim(i, t, rate=rate, spm=spm) for i, t in zip(ids, texts)), key=str)


def test_fill_in_middle_of_no_rows(spark, docs):
    assert op12.fill_in_middle(docs(["a"]).where("false")).count() == 0


def test_the_automaton_reads_any_sentinels():
    auto = op12.Automaton(("ab", "abc", "ünd"))
    for t in ("xabcx", "üünd", "aab", "ün d", "a b", "cabünd"):
        b = t.encode()
        _, _, before = auto.scan(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        assert (before[-1][2] > 0) == any(s in t for s in ("ab", "abc", "ünd"))
        assert before[-1][0] == len(t)


# --- op13 ------------------------------------------------------------------------------------------------------------


def plain_groups(rows):
    norm = lambda t: SPACE.sub(" ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), k == 0, sha(t)) for k, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize("capacity", [2, 256])
def test_exact_duplicates(spark, docs, capacity):
    """Buckets that split, chains of many pages, nulls, repeated ids, white space of all kinds, long texts."""
    r = random.Random(capacity)
    texts = [r.choice(["a b", "a  b", "a\tb\n", " a b", "", None, " ", " ", "x" * 100_000, "X" * 100_000, f"t{r.randrange(60)}"]) for _ in range(400)] + ["copy"] * 700
    ids = [r.choice([None, i, i, i, 7]) for i in range(len(texts))]
    rows = list(zip(ids, texts))
    df = docs(texts, ids).withColumnRenamed("n_chars", "page").withColumnRenamed("source", "h")
    got = op13.exact_duplicates(df, keep=("h",), capacity=capacity, depth=10)
    assert got.columns == ["id", "keep_id", "group_size", "kept", "text_sha256", "h"]
    assert sorted((tuple(x)[:5] for x in got.collect()), key=str) == plain_groups(rows)
    assert op13.exact_duplicates(df.where("false")).count() == 0


def test_collisions_of_pseudo_keys_stay_apart(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(op13.F, "xxhash64", lambda *c: F.length("norm").cast("long") if c == ("norm",) else real(*c))
    texts = [f"t{i % 7}" for i in range(90)] + ["u1"] * 40
    got = op13.exact_duplicates(docs(texts), capacity=4, depth=8)
    monkeypatch.undo()
    assert sorted(map(tuple, got.collect()), key=str) == plain_groups(list(enumerate(texts)))


def test_the_directory_splits_what_is_overfull(spark):
    keys = spark.createDataFrame([(i << 56, 1) for i in range(-128, 128)] + [((3 << 56) + j, 1) for j in range(1, 40)], "h long, c long")
    got = op13.directory(keys, 20, 12).groupBy("bucket", "depth").count().collect()
    cells = {x.cell: x for x in op13.directory(keys, 20, 12).collect()}
    assert len(cells) == 256 and all(x["count"] <= 16 for x in got)
    assert cells[3 << 4].depth == 12 and cells[128 << 4].depth == 4


# --- op4: hand-written lines -----------------------------------------------------------------------------------------

CLEAN = """from 1990 1991 1992 1993
Fibonacci: 1 1 2 3 5 8 13 21 34 55 89
matrix 0 1 0 0 1 0 1 1 0
10 2 11 2 12 2 13 2
mac 00:1A:2B:3C:4D:5E
years 1914-1918 and 1939-1945
table 12 34 56 78 90 12 34
rows: 100 200 300 400 500
see pages 101-110 and 120-135
UTC 12:30:45:10
1 234 567 890 people
0.5 0.25 0.125 0.0625
ISBN 978-3-16-148410-0
seq 1-2-3-4-5-6-7-8
3 14 15 92 65 35 89 79
2024 01 15 10 30 00
wwn 50:06:01:60:3b:a0:11:22
bits 1010 1100 0011 0101
temps 21 22 23 24 25 26
sizes 10 x 20 x 30 x 40
GB12 ABCD 1234
the vote was 212-203 and 218-210
squares 1 4 9 16 25 36 49 64 81 100
chess 1-0 0-1 1-0 0.5-0.5
built 1987, 1992, 1998 and 2004
12/24/36/48 months
powers 2 4 8 16 32 64 128 256 512 1024
ports 8080 8081 8443 9001""".split("\n")
PERSONAL = {
    "call (212) 555-0187 now": "(212) 555-0187",
    "phone: 415-555-0132": "415-555-0132",
    "Tel 0049 301 2345678": "0049 301 2345678",
    "write jane.doe (at) example (dot) com please": "jane.doe (at) example (dot) com",
    "server 2001:db8:85a3:8d3:1319:8a2e:370:7348": "2001:db8:85a3:8d3:1319:8a2e:370:7348",
    "IBAN DE89 3704 0044 0532 0130 00 please": "DE89 3704 0044 0532 0130 00",
}


def test_added_spans_leave_everyday_numbers_alone(spark, docs):
    from tidewell.llm import op4_pii as op4

    made = op4.lines(1500, 99)  # of a seed that nothing was fitted to
    texts = [*CLEAN, *PERSONAL, *(x for x, _ in made)]
    got = {x.doc_id: [(s.kind, x.text[s.start : s.end]) for s in x.spans if not s.base] for x in op4.find_pii(docs(texts)).select("doc_id", "text", "spans").collect()}
    assert not [(t, got[i]) for i, t in enumerate(CLEAN) if got[i]]
    assert {t: got[len(CLEAN) + i][0][1] for i, t in enumerate(PERSONAL)} == PERSONAL
    of_made = [(m, got[len(CLEAN) + len(PERSONAL) + i]) for i, (_, m) in enumerate(made)]
    assert sum(any((k, x) not in m for k, x in g) for m, g in of_made) <= 0.01 * len(made)
    assert sum(bool(m) and m == g for m, g in of_made) >= 0.85 * sum(bool(m) for m, _ in of_made)
    lines = docs(CLEAN)
    assert sorted(x.text for x in op4.redact(lines).collect()) == sorted(CLEAN)
