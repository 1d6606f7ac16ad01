"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Target text is what labels call good; raw text is every document. There are two pairs of models. One counts hashed
words and marks, alone and in pairs, and so tells subjects and languages apart. The other counts runs of one to three
tokens of which a mark is itself and a word its form: small, capital, mixed, with digits, very long, the same as the
word before it; it tells how a text is written, whatever it is about. A document's log weight is the sum, over its
n-grams, of the log ratios of target and raw. Of n documents the k with the largest log weight + Gumbel noise are kept,
which samples k documents without replacement by weight. k is the number of documents whose log weight reaches the cut
that parts labelled good and bad documents best; whether a document itself reaches it is told in a column of its own.

Raw counts are of all documents. Target counts and the cut rest on at most LABELLED labelled rows, those of least
hash of their id; nothing else is limited. Counts are summed within tasks, then by bucket; the driver gets 2 * BUCKETS rows.

Defined results: null and empty texts have log weight 0 and meet the same cut; noise depends on id and text only, so
reruns agree and rows that repeat are kept or rejected together, as are rows of one key; of labels that repeat an id
the better counts; without labels of both kinds the cut is 0; a label
that is null, or on no document, counts for nothing. An empty table gives an empty one; other columns are not looked at,
whatever their names, but by ``kept_rows``, which keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import LOWER, U64, Rolling, Scratch, mix, steps, table

#: Of either pair of models; words come behind forms.
BUCKETS = 1 << 14
LABELLED = 20_000
TEMPERATURE = 1.0
BINS = 4096

#: 0 space, 1 part of a word, 2 other.
KIND = np.full(256, 2, np.uint8)
KIND[128:] = 1
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz":
    KIND[_c] = 1
KIND[[0x20, *range(0x09, 0x0E)]] = 0
TOKENS = Rolling(23)


def _inside(what: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    total = np.zeros(len(what) + 1, np.int32)
    np.cumsum(what, out=total[1:])
    return total[e] - total[s]


def buckets(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of the texts, and the number of the text each is in."""
    n = len(b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = KIND[b]
    cut = np.ones(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut[ends] = True
    edge = np.flatnonzero(cut)
    s, e = edge[:-1], edge[1:]
    solid = kind[s] > 0
    s, e = s[solid], e[solid]
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(ends, s, "right") - 1
    h = TOKENS.of(TOKENS.prefix(LOWER[b]), s, e)
    large = _inside((b >= 65) & (b <= 90), s, e)
    small = _inside((b >= 97) & (b <= 122), s, e)
    digits = _inside((b >= 48) & (b <= 57), s, e)
    size = e - s
    after = b[np.minimum(s + 1, n - 1)]
    head = (b[s] >= 65) & (b[s] <= 90) | (b[s] == 0xC3) & (after >= 0x80) & (after <= 0x9E)  # A-Z, À-Þ
    form = np.select([digits == size, digits > 0, (large > 0) & (small == 0) & (size > 1), head & (large <= 1), large > 0], [0, 1, 2, 3, 5], 4)
    form = form + 8 * (size > 40)
    word = kind[s] == 1
    w = np.flatnonzero(word)
    again = np.zeros(len(s), bool)
    again[w[1:]] = (h[w[1:]] == h[w[:-1]]) & (doc[w[1:]] == doc[w[:-1]])
    t = np.where(word, mix((form + 16 * again + 1).astype(U64)), h)
    pair = mix(t[:-1] * U64(0x9E3779B97F4A7C15) + t[1:])
    three = mix(pair[:-1] * U64(0x9E3779B97F4A7C15) + t[2:])
    two_in, three_in = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    forms = (np.concatenate((t, pair[two_in], three[three_in])) & U64(BUCKETS - 1)).astype(np.int64)
    both = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])
    words = (np.concatenate((h, both[two_in])) & U64(BUCKETS - 1)).astype(np.int64) + BUCKETS
    return np.concatenate((forms, words)), np.concatenate((doc, doc[:-1][two_in], doc[:-2][three_in], doc, doc[:-1][two_in]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
    for batch in batches:
        good = np.asarray(batch.column(1).fill_null(False))
        for i, j, b, ends in steps(batch):
            k, doc = buckets(b, ends)
            raw += np.bincount(k, minlength=2 * BUCKETS)
            target += np.bincount(k[good[i:j][doc]], minlength=2 * BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.record_batch([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])


def log_ratio(docs: DataFrame, good: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """log p_target - log p_raw of each bucket; good has at most LABELLED ids."""
    flagged = docs.join(F.broadcast(good), docs[id_col] == good["good_id"], "left").select(F.col(text_col).cast("string").alias("text"), F.col("good_id").isNotNull().alias("good"))
    rows = flagged.mapInArrow(_counts, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.full((2, BUCKETS), 0.5), np.full((2, BUCKETS), 0.5)
    for k, r, t in rows:
        raw[divmod(k, BUCKETS)] += r
        target[divmod(k, BUCKETS)] += t
    share = lambda x: np.log(x / x.sum(axis=1, keepdims=True))
    return (share(target) - share(raw)).ravel()


def gumbel(b: np.ndarray, ends: np.ndarray, ids: np.ndarray, seed: int) -> np.ndarray:
    """Noise that depends on id and text only."""
    whole = TOKENS.of(TOKENS.prefix(b), ends[:-1], ends[1:])
    u = mix(mix(whole ^ U64(seed)) + ids.astype(np.int64).view(U64))
    return -np.log(-np.log(((u >> U64(11)).astype(float) + 0.5) / (1 << 53)))


def weights(docs: DataFrame, ratio: np.ndarray, id_col: str, text_col: str, temperature: float, seed: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(-1))
            for i, j, b, ends in steps(batch):
                k, doc = buckets(b, ends)
                w = np.bincount(doc, held.value[k], minlength=j - i)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(w), pa.array(w + temperature * gumbel(b, ends, ids[i:j], seed))], names=["id", "log_weight", "key"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, log_weight double, key double")


def best_cut(w: np.ndarray, y: np.ndarray) -> float:
    """The cut between values of good and bad that is right for the largest share of either, in the middle of its gap."""
    if not len(y) or y.all() or not y.any():
        return 0.0
    order = np.argsort(w, kind="stable")
    w, y = w[order], y[order]
    below_bad = np.append(0, np.cumsum(~y)) / (~y).sum()
    above_good = 1 - np.append(0, np.cumsum(y)) / y.sum()
    edge = np.append(True, np.append(w[1:] > w[:-1], True))
    value = np.where(edge, below_bad + above_good, -1.0)
    i = int(np.argmax(value))
    return float(w[0] - 1 if i == 0 else w[-1] + 1 if i == len(w) else (w[i - 1] + w[i]) / 2)


def kth_largest(df: DataFrame, k: int) -> float:
    """The k-th largest key, exactly, by counts in ever smaller ranges; the driver gets BINS counts at a time."""
    lo, hi, n = df.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k <= 0 or not n:
        return float("inf")
    if k >= n:
        return float("-inf")
    while True:
        inside = df.where(F.col("key").between(lo, hi))
        width = (hi - lo) / BINS
        if width <= 0 or lo + width == lo:
            return lo
        counts = dict(inside.groupBy(F.least(F.floor((F.col("key") - lo) / width), F.lit(BINS - 1)).alias("bin")).agg(F.struct(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))).collect())
        for b in sorted(counts, reverse=True):
            if k <= counts[b]["n"]:
                break
            k -= counts[b]["n"]
        lo, hi = counts[b]["lo"], counts[b]["hi"]
        if counts[b]["n"] == 1 or lo == hi:
            return lo


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, temperature: float, labelled: int, seed: int) -> tuple[np.ndarray, DataFrame, float, float]:
    """The log ratios, the scored rows (id, log_weight, key), the least key that is kept, and the cut."""
    scratch = Scratch(docs.sparkSession, "quality")
    some = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("quality").alias("quality"))
    some = scratch.write(some.orderBy(F.xxhash64("label_id"), "label_id").limit(labelled))
    ratio = log_ratio(docs, some.where("quality = 1").select(F.col("label_id").alias("good_id")), id_col, text_col)
    scored = scratch.write(weights(docs, ratio, id_col, text_col, temperature, seed))
    marked = scored.join(F.broadcast(some), scored["id"] == some["label_id"]).groupBy("id").agg(F.first("log_weight"), F.first("quality")).collect()
    cut = best_cut(np.array([r[1] for r in marked]), np.array([r[2] for r in marked]) == 1)
    k = scored.where(F.col("log_weight") >= cut).count()
    return ratio, scored, kth_largest(scored, k), cut


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", temperature: float = TEMPERATURE, labelled: int = LABELLED, seed: int = 41) -> DataFrame:
    """(id, log_weight, key, above_cut, kept) for every row of docs; labels has (doc_id, quality 0/1)."""
    _, scored, least, cut = _fitted(docs, labels, id_col, text_col, temperature, labelled, seed)
    return scored.withColumn("above_cut", F.col("log_weight") >= F.lit(cut)).withColumn("kept", F.col("key") >= F.lit(least))


def kept_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", temperature: float = TEMPERATURE, labelled: int = LABELLED, seed: int = 41) -> DataFrame:
    """The rows of docs that resample keeps, with all their columns; keys are worked out again where the rows are, so no text is shuffled."""
    ratio, _, least, _ = _fitted(docs, labels, id_col, text_col, temperature, labelled, seed)
    held = docs.sparkSession.sparkContext.broadcast(ratio)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            ids = np.asarray(batch.column(names.index(id_col)).cast(pa.int64()).fill_null(-1))
            for i, j, b, ends in steps(batch, text_col):
                k, doc = buckets(b, ends)
                keep[i:j] = np.bincount(doc, held.value[k], minlength=j - i) + temperature * gumbel(b, ends, ids[i:j], seed) >= least
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "log_weight", "key", "above_cut", "kept")
