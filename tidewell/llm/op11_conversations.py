"""Repair of the turn structure of conversations by error-correcting Earley parsing.

The grammar of roles is right-linear and weighted (GRAMMAR): a conversation is empty, or user and assistant take turns,
perhaps after a system turn. A row is kept by the rule that expects its role; other productions of each terminal correct
errors: a row is deleted, rerolled to the user or assistant that a rule expects, or a user or assistant is inserted
before it. The last symbol of a rule is a tail call: what it predicts keeps the origin of the rule that predicts it, so all
items begin at 0 and a column of the chart has one item for each nonterminal that is expected there.

An item keeps its least (cost, audit). Audits themselves aren't carried: items of one column have read the same rows and
end with one of them, so none's audit begins another's, and it is enough to keep their order. The next column's audits
are compared by that order, then by what the row adds. Back pointers give the audit of the completed chart.

Conversations of any length are parsed in parallel. Rows are sorted by ranges over all tasks, so each gets a place in one
order; runs of at most SEGMENT places of one conversation are segments. A segment is parsed from each nonterminal that
may be expected at its beginning, which gives costs and the order of audits for each end: the same kind of table as that
of one row. A fold over these small tables picks the items through which the best parse goes, and each segment then
gives its part of the audit.

Rows are read by turn, null first, ties by role, then by the digest of the text; rows equal in all of them are copies.
Defined results: null role or text is one space; a null id is a conversation; an empty role, or one whose first letter no
rule expects, can't be kept; an empty table gives an empty one; other columns are not looked at, whatever their names.
Texts are never cut. The digest of a conversation is one pass over its text by definition, so its rows stream through one
task, sorted on disk, none of them held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, give_back, table

#: For each nonterminal its rules: none, or a role and the nonterminal behind it.
GRAMMAR = {
    "talk": ((), ("system", "ask"), ("user", "answer")),
    "ask": (("user", "answer"),),
    "answer": (("assistant", "done"),),
    "done": ((), ("user", "answer")),
}
NAMES = tuple(GRAMMAR)
EXPECTED = range(len(NAMES))
START = NAMES.index("talk")
#: Roles that may be inserted or given to a row, and what edits cost.
GIVEN = ("user", "assistant")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SEGMENT_BITS = 10
SPACE = " \t\n\x0b\f\r"
LEGAL = ("su", "ua", "au")


def _rules(at: int) -> list[tuple[str, int]]:
    return [(rule[0], NAMES.index(rule[1])) for rule in GRAMMAR[NAMES[at]] if rule]


def _insertions(start: int) -> dict[int, tuple[int, str]]:
    """What is expected after inserts from an item: nonterminal to (cost, audit)."""
    best, agenda = {start: (0, "")}, [start]
    for at in agenda:
        for role, to in _rules(at):
            now = (best[at][0] + INSERT, best[at][1] + "I")
            if role in GIVEN and (to not in best or now < best[to]):
                best[to] = now
                agenda.append(to)
    return best


@lru_cache(maxsize=None)
def _moves(initial: str, mark: str) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, audit) of one row: the best way from each expected nonterminal to each behind the row."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    stays = TRUNCATED if mark == "t" else 0
    for start in EXPECTED:
        for at, (cost, audit) in _insertions(start).items():
            ways = [(at, cost + DELETE, audit + "D")]
            if mark != "d":
                for role, to in _rules(at):
                    if role[0] == initial:
                        ways.append((to, cost + stays, audit + "K"))
                    if role in GIVEN:
                        ways.append((to, cost + REROLE + stays, audit + "R"))
            for to, *found in ways:
                if (start, to) not in best or tuple(found) < best[start, to]:
                    best[start, to] = tuple(found)
    return tuple((a, b, cost, audit) for (a, b), (cost, audit) in sorted(best.items()))


def _column(items: dict[int, tuple[int, int]], moves: tuple) -> tuple[dict[int, tuple[int, int]], dict[int, tuple[int, object]]]:
    """The next column from one of nonterminal to (cost, order of its audit), and (item before, what is added) for each item.

    moves are (from, to, cost, addition); additions of one item to different ones behind are in the order of their audits."""
    best: dict[int, tuple] = {}
    for a, b, cost, added in moves:
        if a in items:
            c, order = items[a]
            way = (c + cost, order, added, a)
            if b not in best or way < best[b]:
                best[b] = way
    ranked = sorted(best, key=lambda b: best[b][1:3])
    return {b: (best[b][0], i) for i, b in enumerate(ranked)}, {b: (w[3], w[2]) for b, w in best.items()}


def chart(initials: str, marks: str, start: int) -> tuple[dict[int, tuple[int, int]], list[dict]]:
    """The last column of a segment's chart, and the back pointers of every column."""
    items, back = {start: (0, 0)}, []
    for i, m in zip(initials, marks):
        items, pointers = _column(items, _moves(i, m))
        back.append(pointers)
    return items, back


@lru_cache(maxsize=1 << 14)
def transfer(initials: str, marks: str) -> tuple[tuple[int, int, int, int], ...]:
    """(from, to, cost, order of the audit among those from there) of a whole segment."""
    return tuple((a, b, cost, order) for a in EXPECTED for b, (cost, order) in sorted(chart(initials, marks, a)[0].items()))


def _tails() -> dict[int, tuple[int, str]]:
    """What ends a conversation from an item: inserts up to a nonterminal that may be empty."""
    ends = {a: [way for to, way in _insertions(a).items() if () in GRAMMAR[NAMES[to]]] for a in EXPECTED}
    return {a: min(ways) for a, ways in ends.items() if ways}


TAILS = _tails()


def through(tables: list[tuple]) -> tuple[int, list[tuple[int, int]]]:
    """The cost of the best parse over segments in order, and (item before, item behind) of each of them."""
    items, back = {START: (0, 0)}, []
    for t in tables:
        items, pointers = _column(items, t)
        back.append(pointers)
    cost, _, at = min((c + TAILS[a][0], order, a) for a, (c, order) in items.items() if a in TAILS)
    path = []
    for pointers in reversed(back):
        before = pointers[at][0]
        path.append((before, at))
        at = before
    return cost, path[::-1]


def edits(initials: str, marks: str, start: int, end: int, last: bool) -> list[str]:
    """The audit of each row of a segment from one item to another; the last segment's last row has the inserts behind it too."""
    out, at = [], end
    for pointers in reversed(chart(initials, marks, start)[1]):
        at, added = pointers[at]
        out.append(added)
    out.reverse()
    if last:
        out[-1] += TAILS[end][1]
    return out


def given(audits: list[str], initials: str, start: int) -> list[list[tuple[str, str | None]]]:
    """For each row the rows that its audit makes: (edit, role), no role where the row keeps its own."""
    out, at = [], start
    for audit, initial in zip(audits, initials):
        made = []
        for edit in audit:
            if edit != "D":
                role, to = next((r, to) for r, to in _rules(at) if (r[0] == initial if edit == "K" else r in GIVEN))
                made.append((edit, None if edit == "K" else role))
                at = to
        out.append(made)
    return out


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, at): at is a row's place in the order over all rows, with gaps between tasks.

    Ranges are cut by all that orders rows and then by their places in the input, so neither a long conversation nor one
    of many equal rows is in one task."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"))
    rows = rows.withColumns({"digest": F.unhex(F.md5(F.col("text").cast("binary"))), "place": F.monotonically_increasing_id()})
    order = (F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "place")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("place")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, at, initial, mark): mark b blank, d duplicate, t truncated, else a point; of several the first counts."""
    solid = F.rtrim("text", F.lit(SPACE))
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first_at")).select("first_at")
    end, initial = F.substring(solid, -1, 1), F.substring("role", 1, 1)
    light = rows.select("conv_id", "turn", "at", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), F.when(solid == "", "b").when(end.isin(".", "!", "?"), ".").otherwise("t").alias("mark"))
    light = light.join(first, F.col("at") == F.col("first_at"), "left")
    return light.withColumn("mark", F.when((F.col("mark") != "b") & F.col("first_at").isNull(), "d").otherwise(F.col("mark"))).drop("first_at")


def segments(marked: DataFrame) -> DataFrame:
    """(conv_id, segment, ats, initials, marks) of at most 2 ** SEGMENT_BITS rows each, in their order."""
    listed = F.array_sort(F.collect_list(F.struct("at", "initial", "mark")))
    s = marked.groupBy("conv_id", F.shiftright("at", SEGMENT_BITS).alias("segment")).agg(listed.alias("r"))
    joined = lambda c: F.array_join(F.col(f"r.{c}"), "")
    return s.select("conv_id", "segment", F.col("r.at").alias("ats"), joined("initial").alias("initials"), joined("mark").alias("marks"))


def _forced(marks: str) -> str:
    return marks.replace("b", "d")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.list_(pa.int64()))
    for batch in batches:
        read = list(zip(batch["initials"].to_pylist(), batch["marks"].to_pylist()))
        pairs = [sum(a + b not in LEGAL for a, b in zip(i, i[1:])) for i, _ in read]
        tables = [[list(move) for move in transfer(i, _forced(m))] for i, m in read]
        yield pa.record_batch([batch["conv_id"], batch["segment"], pa.array([i[0] for i, _ in read]), pa.array([i[-1] for i, _ in read]), pa.array(pairs, pa.int64()), pa.array(tables, kind)], names=["conv_id", "segment", "first", "last", "illegal", "moves"])


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple]:
    """(whether a new run of equal keys begins, row) of a stream that is sorted by it."""
    now: object = batches  # equal to no key
    for batch in batches:
        for row in batch.to_pylist():
            yield row[key] != now or now is batches, row
            now = row[key]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []

    def path() -> pa.RecordBatch:
        cost, found = through([tuple(map(tuple, s["moves"])) for s in held])
        illegal = sum(s["illegal"] for s in held) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(held, held[1:]))
        rows = [{"conv": s["conv_id"], "seg": s["segment"], "start": a, "end": b, "is_last": s is held[-1], "cost": cost if s is held[-1] else 0, "illegal": illegal if s is held[-1] else 0} for s, (a, b) in zip(held, found)]
        return pa.RecordBatch.from_pylist(rows, schema=PATH)

    done: list[pa.RecordBatch] = []
    for new, row in _runs(batches, "conv_id"):
        if new and held:
            done.append(path())
            held = []
            if len(done) == 1000:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        held.append(row)
    if held:
        done.append(path())
    if done:
        yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]


PATH = pa.schema([("conv", pa.int64()), ("seg", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("is_last", pa.bool_()), ("cost", pa.int64()), ("illegal", pa.int64())])
MADE = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("audit", pa.string()), ("made", pa.list_(pa.struct([("at", pa.int64()), ("rows", pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string())])))])))])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for s in batch.to_pylist():
            audits = edits(s["initials"], _forced(s["marks"]), s["start"], s["end"], s["is_last"])
            made = [{"at": at, "rows": [{"edit": e, "role": r} for e, r in rows]} for at, rows in zip(s["ats"], given(audits, s["initials"], s["start"])) if rows]
            out.append({"conv_id": s["conv_id"], "segment": s["segment"], "audit": "".join(audits), "made": made})
        yield pa.RecordBatch.from_pylist(out, schema=MADE)
        give_back()


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the best repair makes of conversations (conv_id long, turn long, role, text): two tables.

    (conv_id, at, place, edit, role, text) are the repaired rows in order of at and place, edit K, R or I. (conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit) has a row for each conversation that has rows."""
    scratch = Scratch(turns.sparkSession, "conversations")
    rows = scratch.write(ordered(turns.select("conv_id", "turn", "role", "text")))
    marked = scratch.write(faults(rows))
    cut = scratch.write(segments(marked))
    parsed = cut.select("conv_id", "segment", "initials", "marks").mapInArrow(_parsed, "conv_id long, segment long, first string, last string, illegal long, moves array<array<long>>")
    # a row for each segment, so that a conversation's are few beside its rows
    path = scratch.write(parsed.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_folded, "conv long, seg long, start int, end int, is_last boolean, cost long, illegal long"))
    ways = path.select("conv", "seg", "start", "end", "is_last")
    chosen = cut.join(ways, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("segment") == F.col("seg"))).drop("conv", "seg")
    made = scratch.write(chosen.mapInArrow(_edited, "conv_id long, segment long, audit string, made array<struct<at: long, rows: array<struct<edit: string, role: string>>>>"))
    steps = made.select(F.explode("made").alias("m")).select(F.col("m.at").alias("row_at"), "m.rows")
    out = rows.join(steps, F.col("at") == F.col("row_at")).select("conv_id", "at", "role", "text", F.posexplode("rows").alias("place", "step"))
    repaired = out.select("conv_id", "at", "place", F.col("step.edit").alias("edit"), F.coalesce("step.role", "role").alias("role"), F.when(F.col("step.edit") == "I", "").otherwise(F.col("text")).alias("text"))
    turn = F.col("turn").cast("decimal(38,0)")
    has = lambda m: F.sum(F.when(F.col("mark") == m, F.col("n")).otherwise(0)).cast("long")
    by_turn = marked.groupBy("conv_id", "turn", "mark").agg(F.count("*").alias("n")).groupBy("conv_id", "turn").agg(*(has(m).alias(c) for m, c in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))))
    counts = by_turn.groupBy("conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *(F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")))
    costs = path.where("is_last").select("conv", "cost", "illegal")
    audits = made.groupBy(F.col("conv_id").alias("conv2")).agg(F.array_sort(F.collect_list(F.struct("segment", "audit"))).alias("l")).select("conv2", F.array_join("l.audit", "").alias("audit"))
    told = counts.join(costs, F.col("conv_id").eqNullSafe(F.col("conv"))).join(audits, F.col("conv_id").eqNullSafe(F.col("conv2")))
    # a gap that no long holds is the largest one
    gaps = F.least("gaps", F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("gaps")
    return repaired, told.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines as they stream by in order."""
    ids, out, digest, key = [], [], None, None
    for new, row in _runs(batches, "conv_id"):
        if new:
            if digest is not None:
                ids.append(key)
                out.append(digest.hexdigest())
            digest, key = hashlib.sha256(row["line"].encode()), row["conv_id"]
        else:
            digest.update(b"\n")
            digest.update(row["line"].encode())
    if digest is not None:
        ids.append(key)
        out.append(digest.hexdigest())
    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["conv", "sha"])


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha) of the repaired lines role:text of each conversation."""
    lines = repaired.select("conv_id", "at", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "at", "place").select("conv_id", "line").mapInArrow(_digested, "conv long, sha string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows that a checksum of their place drops, empties, strips of ends of sentences, repeats or calls user's."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"))
    rows = rows.withColumn("kind", F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).where("kind <> 0")
    text: Column = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversations(spark, sf_dir: str) -> DataFrame:
    given_rows = table(spark, sf_dir, "conversations")
    repaired, told = repair(damaged(given_rows))
    every = given_rows.select(F.col("conv_id").alias("id")).distinct()
    out = every.join(told, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(digests(repaired), F.col("id").eqNullSafe(F.col("conv")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
