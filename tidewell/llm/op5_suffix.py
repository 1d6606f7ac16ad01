"""Exact substring dedup by sorted suffixes: every byte that lies in a SPAN-byte string which also starts elsewhere goes.

Suffixes start at anchors. A window of SPAN bytes has as its anchor the first of its GRAM-byte strings of least hash, a
choice that depends on the window alone, so equal windows have equal anchors at equal places, and one byte in some
eighty starts a suffix. An anchor's context is what its windows cover: up to SPAN - GRAM bytes before it and SPAN behind
its start.

Anchors whose GRAM bytes occur once are done. Where a whole context occurs again, all windows in it do. The remaining
contexts, one for each different content, are at the edges of repeats. They are sorted twice, as suffixes from the
anchor on and as prefixes before it read backwards: sampled splitters deal them by range of their leading bytes to
buckets, a bucket sorts its strings by multikey quicksort, neighbours are compared, those across the boundaries of
buckets too. Neighbours show the longest match of each context on either side. A match of R bytes from the anchor on
and of L before it, with the same neighbour, repeats the windows that begin SPAN - R to L bytes before the anchor.
Windows between the longest matches of both sides that no neighbour accounts for, as when those come from different
places, are few; they are settled by counting their hashes.

Hashes stand for contents: 64 bits of the anchor's string and 64 of its context together name a context; texts are
named by 64 bits and their length.

Defined results: a null or empty text has 0 bytes and loses none; a text of less than SPAN bytes keeps all; rows with
equal texts, with the same id, none or different ones, are copies of each other and lose every byte if they have SPAN or
more; rows that share an id but not the text are documents of their own, each with its own row in the result. An empty table gives an empty one; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm.common import U64, Rolling, Scratch, mix, steps, table

SPAN, GRAM = 200, 48
BEFORE = SPAN - GRAM
WIDE = BEFORE + 1
#: Contexts that a bucket sorts, about.
BUCKET = 20_000
LETTERS, CONTEXTS = Rolling(51), Rolling(52)


def _least(h: np.ndarray, width: int, best) -> np.ndarray:
    """The least (or largest) of each run of width values, by doubling."""
    n = len(h) - width + 1
    m, size = h, 1
    while size * 2 <= width:
        m = best(m[: len(m) - size], m[size:])
        size *= 2
    return best(m[:n], m[width - size : width - size + n])


def anchors(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the texts: the text each is in, its place in it, where its windows begin and end, the hash of its string
    and of its context."""
    n = len(b)
    if n < SPAN:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),) * 2
    at = np.arange(n - GRAM + 1)
    h = LETTERS.of(LETTERS.prefix(b), at, at + GRAM)
    least = _least(h, WIDE, np.minimum)
    start = at[: len(least)]
    window = np.flatnonzero(start + SPAN <= ends[np.searchsorted(ends, start, "right")])
    least = least[window]
    pad = np.zeros(n - SPAN + 1 + 2 * BEFORE, U64)
    pad[window + BEFORE] = least
    a = np.flatnonzero(_least(pad, WIDE, np.maximum) == h)
    # each window's anchor: the first in it whose hash is the least
    which = np.searchsorted(a, window)
    wrong = np.flatnonzero(h[a[which]] != least)
    while len(wrong):
        which[wrong] += 1
        wrong = wrong[h[a[which[wrong]]] != least[wrong]]
    first = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else which
    last = np.append(first[1:], len(which)) - 1
    a, lo, hi = a[which[first]], window[first], window[last] + SPAN
    text = np.searchsorted(ends, a, "right") - 1
    context = mix(CONTEXTS.of(CONTEXTS.prefix(b), lo, hi) ^ ((a - lo) * 1000 + (hi - a)).astype(U64))
    return text, a - ends[text], lo - ends[text], hi - ends[text], h[a], context


def _scanned(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row for each text (doc_id, n_bytes, t, sha), and one for each anchor (fp, ctx, t, a, lo, hi, n_bytes)."""
    names = ["doc_id", "sha", "fp", "ctx", "t", "a", "lo", "hi", "n_bytes"]
    for batch in batches:
        for i, j, b, ends in steps(batch):
            raw = b.tobytes()
            sha = [hashlib.sha256(raw[s:e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
            t = np.array([int.from_bytes(x.digest()[:8], "little", signed=True) for x in sha], np.int64)
            n = np.diff(ends)
            none = pa.nulls(j - i, pa.int64())
            yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array([x.hexdigest() for x in sha], pa.string()), none, none, pa.array(t), *(pa.nulls(j - i, pa.int32()),) * 3, pa.array(n)], names=names)
            text, a, lo, hi, h, c = anchors(b, ends)
            yield pa.record_batch([pa.nulls(len(a), kind), pa.nulls(len(a), pa.string()), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(t[text]), *(pa.array(x.astype(np.int32)) for x in (a, lo, hi)), pa.array(n[text])], names=names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, ctx, right, left) from texts and their wanted anchors; left is read backwards."""
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    out: tuple[list, ...] = ([], [], [], [])

    def flushed() -> pa.RecordBatch:
        got = pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds)], names=["fp", "ctx", "right", "left"])
        for x in out:
            x.clear()
        return got

    for batch in batches:
        for text, wanted in zip(batch.column("text"), batch.column("wanted")):
            raw = (text.as_py() or "").encode()
            w = wanted.values
            for fp, ctx, a, lo, hi in zip(*(w.field(k).to_pylist() for k in ("fp", "ctx", "a", "lo", "hi"))):
                out[0].append(fp)
                out[1].append(ctx)
                out[2].append(raw[a:hi])
                out[3].append(raw[lo:a][::-1])
            if len(out[0]) > 5000:
                yield flushed()
    yield flushed()


def _padded(strings: list[bytes], width: int) -> np.ndarray:
    """Bytes + 1 as rows of a matrix, zeros behind their ends; UTF-8 has no byte 255."""
    raw = np.frombuffer(b"".join(s.ljust(width, b"\xff") for s in strings), np.uint8).reshape(len(strings), width)
    return raw + np.uint8(1)


def multikey_quicksort(rows: np.ndarray) -> np.ndarray:
    """The order of the rows of a matrix of bytes, eight of which are a key.

    A pivot parts the rows into those less, equal and greater in the key at hand; the equal ones go on to the next key."""
    keys = np.ascontiguousarray(rows).view(">u8").astype(U64)
    out = np.arange(len(rows))
    todo = [(0, len(rows), 0)]
    while todo:
        lo, hi, k = todo.pop()
        part = out[lo:hi]
        if hi - lo < 2 or k == keys.shape[1]:
            continue
        if hi - lo <= 512:
            out[lo:hi] = part[np.lexsort(keys[part, k:].T[::-1])]
            continue
        x = keys[part, k]
        pivot = np.partition(x[:: max(1, len(x) // 255)], len(x[:: max(1, len(x) // 255)]) // 2)[len(x[:: max(1, len(x) // 255)]) // 2]
        less, more = x < pivot, x > pivot
        same = ~(less | more)
        out[lo:hi] = np.concatenate((part[less], part[same], part[more]))
        i, j = lo + int(less.sum()), hi - int(more.sum())
        todo += [(lo, i, k), (i, j, k + 1), (j, hi, k)]
    return out


def _matches(right: np.ndarray, left: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that rows x and y have in common from the anchor on, and before it."""
    out = []
    for m in (right, left):
        stop = (m[x] != m[y]) | (m[x] == 0)
        out.append(np.where(stop.any(axis=1), stop.argmax(axis=1), m.shape[1]))
    return out[0], out[1]


#: Neighbours on each side with which a context is compared in its bucket; with the next one across a boundary.
NEAR = 4
FOUND = "fp long, ctx long, r array<int>, l array<int>, bucket int, last boolean, right binary, left binary"
NAMES = ["fp", "ctx", "r", "l", "bucket", "last", "right", "left"]


def _lists(values: np.ndarray, on: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(on.sum(axis=1))), pa.int32()), pa.array(values[on].astype(np.int32)))


def _sorted_bucket(batches: Iterator[pa.RecordBatch], backwards: bool) -> Iterator[pa.RecordBatch]:
    """For each context its matches with its neighbours in the bucket; the first and last of the bucket with their strings."""
    from pyspark import TaskContext

    got = pa.Table.from_batches(list(batches))
    if not len(got):
        return
    fp, ctx = np.asarray(got.column("fp").combine_chunks()), np.asarray(got.column("ctx").combine_chunks())
    raw_right, raw_left = got.column("right").to_pylist(), got.column("left").to_pylist()
    right, left = _padded(raw_right, SPAN), _padded(raw_left, BEFORE)
    order = multikey_quicksort(np.concatenate((right[:, :GRAM], left, right[:, GRAM:]) if backwards else (right, left), axis=1))
    fp, ctx, right, left = fp[order], ctx[order], right[order], left[order]
    n, bucket = len(order), TaskContext.get().partitionId()
    r, l = np.full((n, 2 * NEAR), -1), np.full((n, 2 * NEAR), -1)
    for k in range(1, min(NEAR, n - 1) + 1):
        x = np.flatnonzero(fp[k:] == fp[:-k])
        a, b = _matches(right, left, x, x + k)
        r[x, k - 1], l[x, k - 1] = a, b
        r[x + k, NEAR + k - 1], l[x + k, NEAR + k - 1] = a, b
    on = r >= GRAM
    some = on.any(axis=1)
    yield pa.record_batch([pa.array(fp[some]), pa.array(ctx[some]), _lists(r[some], on[some]), _lists(l[some], on[some]), pa.array(np.full(some.sum(), -1, np.int32)), pa.array(np.zeros(some.sum(), bool)), pa.nulls(some.sum(), pa.binary()), pa.nulls(some.sum(), pa.binary())], names=NAMES)
    ends = [0, n - 1]
    none = pa.array([[], []], pa.list_(pa.int32()))
    yield pa.record_batch([pa.array(fp[ends]), pa.array(ctx[ends]), none, none, pa.array([bucket, bucket], pa.int32()), pa.array([False, True]), pa.array([raw_right[order[i]] for i in ends], pa.binary()), pa.array([raw_left[order[i]] for i in ends], pa.binary())], names=NAMES)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of a bucket's last context with the next bucket's first."""
    for batch in batches:
        a, b = batch.column("mine"), batch.column("next")
        side = lambda s, k: _padded([x or b"" for x in s.field(k).to_pylist()], SPAN if k == "right" else BEFORE)
        n = len(batch)
        right, left = np.concatenate((side(a, "right"), side(b, "right"))), np.concatenate((side(a, "left"), side(b, "left")))
        r, l = _matches(right, left, np.arange(n), np.arange(n) + n)
        on = np.tile(r >= GRAM, 2)
        both = lambda k: pa.array(np.concatenate((np.asarray(a.field(k)), np.asarray(b.field(k))))[on])
        one = np.ones((int(on.sum()), 1), bool)
        yield pa.record_batch([both("fp"), both("ctx"), _lists(np.tile(r, 2)[on][:, None], one), _lists(np.tile(l, 2)[on][:, None], one)], names=["fp", "ctx", "r", "l"])


def _neighbours(contexts: DataFrame, buckets: int, backwards: bool, scratch: Scratch) -> DataFrame:
    key = F.concat(F.substring("right", 1, GRAM), "left", F.substring("right", GRAM + 1, SPAN)) if backwards else F.concat("right", "left")
    dealt = contexts.withColumn("key", key).repartitionByRange(buckets, "key").drop("key")
    out = scratch.write(dealt.mapInArrow(lambda it: _sorted_bucket(it, backwards), FOUND))
    edge = F.struct("fp", "ctx", "right", "left")
    # two rows a bucket: one task orders them
    seam = out.where("bucket >= 0").groupBy("bucket").agg(F.max(F.when(~F.col("last"), edge)).alias("first"), F.max(F.when(F.col("last"), edge)).alias("mine"))
    seam = seam.withColumn("next", F.lead("first").over(Window.orderBy("bucket"))).where("next is not null").select("mine", "next")
    return out.where("bucket < 0").select("fp", "ctx", "r", "l").union(seam.mapInArrow(_across, "fp long, ctx long, r array<int>, l array<int>"))


SETTLED = "fp long, ctx long, covered array<struct<lo:int,hi:int>>, open array<int>, low int, high int"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each context (with its lengths nr, nl and its matches r, l) the places of repeated windows, those still open,
    and the first and last place at which one can be."""
    for batch in batches:
        n = len(batch)
        rl, ll = batch.column("r"), batch.column("l")
        row = np.repeat(np.arange(n), np.diff(np.asarray(rl.offsets)))
        r, l = np.asarray(rl.flatten()), np.asarray(ll.flatten())
        most_r, most_l = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.maximum.at(most_r, row, r)
        np.maximum.at(most_l, row, l)
        low = np.maximum(SPAN - most_r, SPAN - np.asarray(batch.column("nr")))
        high = np.minimum(most_l, np.asarray(batch.column("nl")))
        turn = np.zeros((n, BEFORE + 3), np.int32)
        on = l >= SPAN - r
        np.add.at(turn, (row[on], SPAN - r[on]), 1)
        np.add.at(turn, (row[on], l[on] + 1), -1)
        covered = np.cumsum(turn, axis=1) > 0
        edge = np.diff(np.concatenate((np.zeros((n, 1), np.int8), covered.astype(np.int8)), axis=1), axis=1)
        (a, lo), (_, hi) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        runs = pa.StructArray.from_arrays([pa.array(lo.astype(np.int32)), pa.array((hi - 1).astype(np.int32))], ["lo", "hi"])
        spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(a, minlength=n))), pa.int32()), runs)
        place = np.arange(BEFORE + 3)[None, :]
        open_ = ~covered & (place >= low[:, None]) & (place <= high[:, None])
        yield pa.record_batch([batch.column("fp"), batch.column("ctx"), spans, _lists(np.broadcast_to(place, open_.shape), open_), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["fp", "ctx", "covered", "open", "low", "high"])


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r, l, o in zip(batch.column("right").to_pylist(), batch.column("left").to_pylist(), batch.column("o").to_pylist()):
            ok = o <= len(l) and SPAN - o <= len(r)
            out.append(hashlib.blake2b(l[:o][::-1] + r[: SPAN - o], digest_size=16).digest() if ok else None)
        yield pa.record_batch([batch.column("fp"), batch.column("ctx"), batch.column("o"), batch.column("is_open"), pa.array(out, pa.binary())], names=["fp", "ctx", "o", "is_open", "w"])


def _edge_contexts(contexts: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, ctx, covered) for different contexts of anchors with equal strings; contexts has (fp, ctx, right, left)."""
    buckets = max(1, -(-contexts.count() // BUCKET))
    pairs = _neighbours(contexts, buckets, False, scratch).union(_neighbours(contexts, buckets, True, scratch))
    # two rows of a context, and one for each boundary it is at
    pairs = pairs.groupBy("fp", "ctx").agg(F.flatten(F.collect_list("r")).alias("r"), F.flatten(F.collect_list("l")).alias("l"))
    sizes = contexts.select("fp", "ctx", F.length("right").alias("nr"), F.length("left").alias("nl"))
    settled = scratch.write(sizes.join(pairs, ["fp", "ctx"]).select("fp", "ctx", "nr", "nl", "r", "l").mapInArrow(_settle, SETTLED))
    out = settled.select("fp", "ctx", "covered")
    if settled.where("size(open) > 0").take(1):
        places = scratch.write(settled.select("fp", F.explode("open").alias("o")).distinct())
        # a window can be repeated only between the longest matches of both sides
        can = contexts.join(settled.select("fp", "ctx", "low", "high", "open").where("low <= high"), ["fp", "ctx"]).join(places, "fp").where("o between low and high").select("fp", "ctx", "right", "left", "o", F.array_contains("open", F.col("o")).alias("is_open"))
        windows = scratch.write(can.mapInArrow(_window_hashes, "fp long, ctx long, o int, is_open boolean, w binary").where("w is not null"))
        again = scratch.write(windows.groupBy("fp", "o", "w").agg(F.count("*").alias("c")).where("c > 1").select("fp", "o", "w"))
        found = windows.where("is_open").join(again, ["fp", "o", "w"]).groupBy("fp", "ctx").agg(F.collect_set(F.struct(F.col("o").alias("lo"), F.col("o").alias("hi"))).alias("more"))
        out = settled.join(found, ["fp", "ctx"], "left").select("fp", "ctx", F.concat("covered", F.coalesce("more", F.array().cast("array<struct<lo:int,hi:int>>"))).alias("covered"))
    return scratch.write(out.where("size(covered) > 0"))


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_removed, n_spans and the digest of what is left, from texts and their spans."""
    for batch in batches:
        removed, runs, sha = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            raw = (text.as_py() or "").encode()
            edge = np.zeros(len(raw) + 1, np.int64)
            lo, hi = np.asarray(spans.values.field("lo")), np.asarray(spans.values.field("hi"))
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            runs.append(int((gone & ~np.append(False, gone[:-1])).sum()))
            sha.append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
        yield pa.record_batch([batch.column("t"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha)], names=["t", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(plain.dtypes)["doc_id"]
    arrow = to_arrow_type(plain.schema["doc_id"].dataType)
    scanned = scratch.write(plain.mapInArrow(lambda it: _scanned(it, arrow), f"doc_id {kind}, sha string, fp long, ctx long, t long, a int, lo int, hi int, n_bytes long"))
    signed, found = scanned.where("fp is null").select("doc_id", "n_bytes", "t", "sha"), scanned.where("fp is not null").select("fp", "ctx", "t", "a", "lo", "hi", "n_bytes")
    # texts by name: how many rows have each, and the row that stands for it
    texts = scratch.write(signed.groupBy("t", "n_bytes").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep")))
    #: whether a text and its id come together more than once, so that a text's own row is not one
    twice = not signed.groupBy("doc_id", "t", "n_bytes").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    # a row's text has the name that the scan gave it: equal ids, null ones too, do not mix up texts
    whole_text = F.coalesce("text", F.lit(""))
    first_bytes = F.substring(F.sha2(whole_text.cast("binary"), 256), 1, 16)
    name = F.conv(F.regexp_replace(F.reverse(first_bytes), "(.)(.)", "$2$1"), 16, -10).cast("long")
    named = plain.select(F.col("doc_id").alias("own"), "text", name.alias("t"), F.octet_length(whole_text).cast("long").alias("n_bytes"))

    def of_texts(some: DataFrame) -> DataFrame:
        """some, (t, n_bytes, rep, ...), with the text of each; more than once where rows repeat."""
        return named.join(some, ["t", "n_bytes"]).where(F.col("own").eqNullSafe(F.col("rep"))).drop("own", "rep")

    again = scratch.write(found.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp"))
    repeated = scratch.write(found.join(again, "fp", "left_semi"))
    by_context = scratch.write(repeated.groupBy("fp", "ctx").agg(F.count("*").alias("c"), *(F.first(c).alias(c) for c in ("t", "a", "lo", "hi", "n_bytes"))))
    many = scratch.write(by_context.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp"))
    edge = scratch.write(by_context.join(many, "fp", "left_semi").groupBy("t", "n_bytes").agg(F.collect_list(F.struct("fp", "ctx", "a", "lo", "hi")).alias("wanted")))
    edge = edge.join(texts.select("t", "n_bytes", "rep"), ["t", "n_bytes"])
    contexts = of_texts(edge).select("text", "wanted").mapInArrow(_cut, "fp long, ctx long, right binary, left binary")
    contexts = scratch.write(contexts.dropDuplicates(["fp", "ctx"]) if twice else contexts)
    settled = _edge_contexts(contexts, scratch)

    # texts with copies lose all; of the others, spans come from contexts that occur again and from the settled ones
    single = repeated.join(texts.where("copies > 1").select("t", "n_bytes"), ["t", "n_bytes"], "left_anti")
    whole = by_context.where("c > 1").select("fp", "ctx", F.array(F.struct(F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))).alias("covered"))
    places = scratch.write(whole.union(settled.join(by_context.where("c > 1").select("fp", "ctx"), ["fp", "ctx"], "left_anti")))
    spans = single.join(places, ["fp", "ctx"]).select("t", "n_bytes", "a", "lo", "hi", F.explode("covered").alias("o"))
    lo, hi = F.coalesce(F.col("a") - F.col("o.hi"), F.col("lo")), F.coalesce(F.col("a") - F.col("o.lo") + SPAN, F.col("hi"))
    spans = spans.groupBy("t", "n_bytes").agg(F.collect_set(F.struct(lo.alias("lo"), hi.alias("hi"))).alias("spans"))
    spans = scratch.write(spans.join(texts.select("t", "n_bytes", "rep"), ["t", "n_bytes"]))
    trimmed = scratch.write(of_texts(spans).select("t", "n_bytes", "text", "spans").mapInArrow(_trimmed, "t long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["t", "n_bytes"]))

    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= SPAN)
    empty = hashlib.sha256(b"").hexdigest()
    out = signed.join(texts.select("t", "n_bytes", "copies"), ["t", "n_bytes"]).join(trimmed, ["t", "n_bytes"], "left")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
