"""Exact top-k search by inner product over a bit-sliced index.

Vectors are quantised to integers. The index of a block of rows holds, for each dimension, bitmaps over the rows: one
for each binary digit of (value - least value of the block), and of (largest value - value). A query's score is a sum
of slices: dimension d counts |q_d| times, from the first kind of slices where q_d is positive, from the second where
it is negative, so that all terms are non-negative. Bitmaps of equal weight are added by full adders, three at a time,
until each weight has one bitmap: the slices of the score. From the most significant slice downward the rows are parted
into those surely among the best k, those still open and those out; what is open behind the last slice are ties,
resolved by the smaller id. Scores of the selected rows come from exact integer products.

Queries go to the executors in blocks of QUERY_BYTES, a bounded broadcast each, which the driver holds one at a time; as a
rule there is one block, and the rows are read and indexed once. A task keeps the k best of each query over all its
rows, and of those of all tasks the k best are taken; a block's answers are written before the next block is sent.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; nor do rows without id.
A component beyond what a long holds is the largest (least) long. Scores are exact integers of any size, and rows are
ordered by them; a score beyond what a long holds is given as the largest (least) long. An empty vector scores 0
against other empty ones. Vectors of different lengths have no product and are not compared. Rows that repeat an id are
rows of their own, but no candidates of queries with that id. An empty table, or no query, gives no rows; other columns
are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, table

SCALE = 256
QUERY_BYTES = 32 << 20
#: Rows under one index; a row is a bit of each bitmap. A task has up to INDEXES of them.
ROW_BLOCK, INDEXES = 8192, 32
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Bytes of a score as a key that orders as the score does.
KEY_BYTES, KEY_ZERO = 20, 1 << 159


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v) of the rows that take part; v holds floor(scale * x) of each component."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _bits(rows: np.ndarray) -> np.ndarray:
    """Booleans (..., rows) as words of 64 bits."""
    pad = -rows.shape[-1] % 64
    if pad:
        rows = np.concatenate((rows, np.zeros((*rows.shape[:-1], pad), bool)), axis=-1)
    return np.packbits(rows, axis=-1, bitorder="little").view(np.uint64)


class Index:
    """Slices of a block of equally long vectors, in the order of their ids."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], v[order]
        self.low, self.high = (self.v.min(axis=0), self.v.max(axis=0)) if self.v.size else (self.v[:1], self.v[:1])
        # differences of two longs fit 64 bits without sign, whatever the longs are
        whole = self.v.view(np.uint64)
        up, down = whole - self.low.view(np.uint64), self.high.view(np.uint64) - whole
        self.width = max(1, int(up.max()).bit_length()) if self.v.size else 1
        self.largest = max(-int(self.low.min()), int(self.high.max()), 0) if self.v.size else 0
        place = np.arange(self.width, dtype=np.uint64)[:, None]
        one = np.uint64(1)
        # (kind, dimension, digit, word)
        self.slices = np.stack([np.stack([_bits((x[:, d][None, :] >> place & one).astype(bool)) for d in range(v.shape[1])]) for x in (up, down)]) if v.shape[1] else np.zeros((2, 0, 1, -(-len(ids) // 64)), np.uint64)
        self.every = _bits(np.ones(len(ids), bool))

    def score_slices(self, q: np.ndarray) -> list[np.ndarray]:
        """The slices of sum |q_d| * term_d, least significant first."""
        size = np.abs(q).view(np.uint64)  # the least long too has its size then
        top = int(size.max()).bit_length() if len(q) else 0
        one = np.uint64(1)
        levels: list[list[np.ndarray]] = [[] for _ in range(self.width + top)]
        for j in range(top):
            for kind, sign in ((0, q > 0), (1, q < 0)):
                d = np.flatnonzero(sign & (size >> np.uint64(j) & one == one))
                if len(d):
                    for s in range(self.width):
                        levels[s + j].append(self.slices[kind, d, s])
        out, carried = [], []
        level = 0
        while level < len(levels) or carried:
            parts = [*(levels[level] if level < len(levels) else []), *carried]
            carried = []
            row = np.concatenate(parts) if parts else np.zeros((1, len(self.every)), np.uint64)
            while len(row) > 2:
                third = len(row) // 3
                a, b, c = row[:third], row[third : 2 * third], row[2 * third : 3 * third]
                half = a ^ b
                carried.append(a & b | c & half)
                row = np.concatenate((half ^ c, row[3 * third :]))
            if len(row) == 2:
                carried.append((row[0] & row[1])[None])
                row = (row[0] ^ row[1])[None]
            out.append(row[0])
            level += 1
        return out

    def scores(self, rows: np.ndarray, q: np.ndarray) -> list[int]:
        """The exact scores of some rows."""
        size = max(-int(q.min()), int(q.max()), 0) if len(q) else 0
        if self.largest * size * max(1, len(q)) <= MOST:
            return (self.v[rows] @ q).tolist()
        return [sum(x * y for x, y in zip(row, q.tolist())) for row in self.v[rows].tolist()]

    def best(self, q: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, list[int]]:
        """Row numbers and scores of the k best rows of other ids, ties to smaller ids."""
        same = slice(*np.searchsorted(self.ids, [query_id, query_id + 1])) if query_id < np.iinfo(np.int64).max else slice(*np.searchsorted(self.ids, [query_id, query_id], "left"))
        open_ = self.every.copy()
        for i in range(same.start, same.stop):
            open_[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        sure = np.zeros_like(open_)
        n_sure = 0
        for s in reversed(self.score_slices(q)):
            on = open_ & s
            n = int(np.bitwise_count(on).sum())
            if n_sure + n > k:
                open_ = on
            else:
                sure |= on
                n_sure += n
                open_ &= ~s
                if n_sure == k:
                    break
        rows = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little")[: len(self.ids)])
        found = rows(sure)
        if n_sure < k:
            found = np.concatenate((found, rows(open_)[: k - n_sure]))
        return found, self.scores(found, q)


def _search(batches: Iterator[pa.RecordBatch], queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    #: for each length of vectors the best (minus score, id) of each query so far
    top: dict[int, list[list[tuple[int, int]]]] = {}

    def meet(size: int) -> None:
        index = Index(*(np.concatenate(x) for x in zip(*held.pop(size))))
        qid, qv = queries[size]
        best = top.setdefault(size, [[] for _ in qid])
        for n, (i, q) in enumerate(zip(qid.tolist(), qv)):
            rows, scores = index.best(q, i, k)
            best[n] = sorted(best[n] + [(-s, x) for s, x in zip(scores, index.ids[rows].tolist())])[:k]

    for batch in batches:
        for size, ids, v in by_length(batch):
            if size in queries:
                held.setdefault(size, []).append((ids, v))
                if sum(len(x) for x, _ in held[size]) >= ROW_BLOCK:
                    meet(size)
    for size in list(held):
        meet(size)
    for size, best in top.items():
        qid = queries[size][0].tolist()
        for at in range(0, len(qid), 4096):
            found = [(i, x, -minus) for i, rows in zip(qid[at : at + 4096], best[at : at + 4096]) for minus, x in rows]
            i, x, s = zip(*found) if found else ((), (), ())
            yield pa.record_batch([pa.array(i, pa.int64()), pa.array(x, pa.int64()), pa.array([min(MOST, max(LEAST, y)) for y in s], pa.int64()), pa.array([(KEY_ZERO - y).to_bytes(KEY_BYTES, "big") for y in s], pa.binary())], names=["query_id", "vec_id", "score", "key"])


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, vectors) of the rows of each length of vector."""
    ids, lists = np.asarray(batch.column(0)), batch.column(1)
    sizes = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten())
    first = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, ids[rows], flat[(first[rows][:, None] + np.arange(size)[None, :])]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of other ids, ties to the smaller id."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.write(quantised(vectors, id_col, vec_col, scale))
    asked = scratch.write(quantised(queries, id_col, vec_col, scale))
    n = rows.count()
    tasks = -(-n // ROW_BLOCK)
    rows = rows.repartition(max(1, -(-n // (ROW_BLOCK * INDEXES)), min(tasks, 4 * spark.sparkContext.defaultParallelism)))
    blocks = max(1, -(-int(asked.agg(F.sum(8 * F.size("v") + 8)).first()[0] or 0) // QUERY_BYTES))
    found = None
    for block in range(blocks):
        near = spark.sparkContext.broadcast({size: (ids, v) for size, ids, v in by_length(_one_batch(asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)))})
        part = scratch.write(rows.mapInArrow(_searcher(near, k), "query_id long, vec_id long, score long, key binary"))
        near.destroy()
        found = part if found is None else found.union(part)
    by = Window.partitionBy("query_id").orderBy("key", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(near, k: int):
    return lambda batches: _search(batches, near.value, k)


def _one_batch(df: DataFrame) -> pa.RecordBatch:
    got = df.toArrow().combine_chunks()
    return got.to_batches()[0] if len(got) else pa.record_batch([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64()))], names=["id", "v"])


def op1_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)
