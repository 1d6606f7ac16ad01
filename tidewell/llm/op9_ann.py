"""Approximate nearest neighbours by NN-descent, and greedy search of the neighbour graph.

Equal vectors are one node. The graph starts from TREES partitions of the nodes by random hyperplanes into leaves of at
most LEAF nodes, compared by brute force. Then, round by round, neighbours of neighbours meet: Spark joins give each node
its neighbours and up to NEIGHBOURS of the nodes that have it as theirs, with their vectors; of these all pairs are
compared in which one is new on its list since the last round, and each node keeps its NEIGHBOURS best. Rounds end when
fewer than SETTLED of all entries are new, or after ROUNDS. A query starts from its node's list, which grows to LIST
entries, and, HOPS times, looks at the neighbours of its WIDEN best entries that it has not looked at yet. Products that
are returned are exact, in double precision, in the order of the components. Inside graph and search a vector is its
direction, in half precision, and its length, relative to the longest; a node's list is ordered by the product of the
node's direction with the other's direction and length, so that far vectors take no precision from near ones.

Work is dealt out by blocks of some thousand nodes; a block's task gets each vector it needs once. Hyperplanes are
fitted on SAMPLE rows at most, those of least hash; cells that hold more than LEAF nodes by that are parted further by
random directions at the median of the cell's sample, and a cell of more than CELL nodes goes to several tasks by a hash.
Every row is indexed. The nodes that point to a node are thinned by a hash where they are more than NEIGHBOURS, which is
part of the method; the graph is approximate, its recall measured.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do vectors of
another length than most have, nor rows without id. Equal vectors are all candidates, by the smaller id; a query with
fewer candidates than asked for gets them all. Rows that repeat an id are one candidate; if their vectors differ, the
least of them, component by component, is the id's vector. An empty table, or no query, gives no rows; other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, table

NEIGHBOURS = 40
TREES, LEAF, SAMPLE = 10, 256, 16_384
CELL = 8192
ROUNDS, SETTLED = 6, 0.02
HOPS, WIDEN = 3, 48
BLOCK = 4096
#: The length of a query's list, and how many of it are compared exactly.
LIST, EXACT = 160, 40
LISTS = "u long, v array<long>, s array<float>"
NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))


def _clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), v.alias("vec"))


def _halved(batches: Iterator[pa.RecordBatch], longest: float) -> Iterator[pa.RecordBatch]:
    """The direction of each vector in half precision, and behind it its length relative to ``longest``."""
    for batch in batches:
        x = _matrix(batch.column(1))
        top = np.abs(x).max(axis=1, keepdims=True)
        x = x / top  # squares of what is left neither overflow nor vanish
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        far = np.maximum(top / longest * norm, 1e-30).astype(np.float32)
        yield pa.record_batch([batch.column(0), pa.array([a.tobytes() + b.tobytes() for a, b in zip((x / norm).astype(np.float16), far)], pa.binary())], names=["k", "h"])


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = np.asarray(lists.flatten())
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _unpacked(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths of n vectors."""
    if not n:
        return np.zeros((0, 0), np.float32), np.zeros(0, np.float32)
    rows = np.frombuffer(raw, np.uint8).reshape(n, -1)
    return np.ascontiguousarray(rows[:, :-4]).view(np.float16).astype(np.float32), np.ascontiguousarray(rows[:, -4:]).view(np.float32)[:, 0]


def _vectors(binary: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return _unpacked(b"".join(binary.to_pylist()), len(binary))


def _best(u: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> pa.RecordBatch:
    """For each u the k distinct v of largest s, best first, ties to the smaller v."""
    order = np.lexsort((-s, v, u))
    u, v, s = u[order], v[order], s[order]
    if len(u):  # a pair may come more than once, with products that differ in their last bits
        on = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))
        u, v, s = u[on], v[on], s[on]
    order = np.lexsort((v, -s, u))
    u, v, s = u[order], v[order], s[order]
    first = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(u)))
    keep = np.arange(len(u)) - np.repeat(first, size) < k
    offsets = np.append(0, np.cumsum(np.minimum(size, k)))
    lists = lambda x: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x[keep]))
    return pa.record_batch([pa.array(u[first]), lists(v), lists(s.astype(np.float32))], names=["u", "v", "s"])


def _unlisted(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, v, s = batch.column("u"), batch.column("v"), batch.column("s")
    if isinstance(u, pa.ChunkedArray):
        u, v, s = u.combine_chunks(), v.combine_chunks(), s.combine_chunks()
    return np.repeat(np.asarray(u), np.diff(np.asarray(v.offsets))), np.asarray(v.flatten()), np.asarray(s.flatten())


#: What goes to one block of nodes: flat lists of pairs and their products.
PACKED = "to int, u array<long>, v array<long>, s array<float>"


def _packed(u: np.ndarray, v: np.ndarray, s: np.ndarray, blocks: int, k: int) -> pa.RecordBatch:
    """The k best of each u, one row for each block that they go to."""
    u, v, s = _unlisted(_best(u, v, s, k))
    to = ((u >> 1) + (u >> 8) + (u >> 18)) % blocks
    order = np.argsort(to, kind="stable")
    some, size = np.unique(to, return_counts=True)
    offsets = pa.array(np.append(0, np.cumsum(size)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (u, v, s.astype(np.float32))]
    return pa.record_batch([pa.array(some.astype(np.int32)), *lists], names=["to", "u", "v", "s"])


def block_of(c: str, blocks: int):
    """The block of a node, as in _packed."""
    return F.pmod(F.shiftright(c, 1) + F.shiftright(c, 8) + F.shiftright(c, 18), F.lit(blocks)).cast("int")


def packed_lists(lists: DataFrame, blocks: int) -> DataFrame:
    return lists.select(block_of("u", blocks).alias("to"), F.expr("array_repeat(u, size(v))").alias("u"), "v", "s")


def merged(packed: DataFrame, blocks: int, k: int) -> DataFrame:
    """One list of the k best for each u; a task holds one block of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(tuple(np.asarray(batch.column(c).flatten()) for c in ("u", "v", "s")))
            size += len(held[-1][0])
            if size > 4_000_000:
                held = [_unlisted(_best(*(np.concatenate(x) for x in zip(*held)), k))]
                size = len(held[0][0])
        if held:
            yield _best(*(np.concatenate(x) for x in zip(*held)), k)

    return packed.repartitionById(blocks, F.col("to")).mapInArrow(run, LISTS)


def plant(sample: np.ndarray, n: int, seed: int) -> tuple[list, np.ndarray, np.ndarray]:
    """A tree of hyperplanes, each (normal, offset, below, above), that parts n nodes into cells of about LEAF; a child -c is cell c - 1.

    Where the sample is too small for that: further directions, and for each cell the places at which they part it."""
    r = np.random.default_rng(seed)
    small = max(8, int(LEAF * len(sample) / max(1, n) * 0.8))
    out: list = []
    cells: list[np.ndarray] = []
    todo = [(np.arange(len(sample)), None, 0)]
    while todo:
        rows, parent, side = todo.pop()
        me = len(out)
        a, b = r.choice(len(rows), 2, replace=False) if len(rows) > small else (0, 0)
        normal = sample[rows[a]] - sample[rows[b]] if len(rows) > small else None
        if normal is None or not normal.any():
            cells.append(rows)
            me = -len(cells)
        else:
            at = sample[rows] @ normal
            cut = float(np.median(at))
            out.append([normal, cut, 0, 0])
            todo += [(rows[at <= cut], me, 2), (rows[at > cut], me, 3)] if (at > cut).any() else [(rows[:1], me, 2), (rows[1:], me, 3)]
        if parent is not None:
            out[parent][side] = me
    more = max(0, int(np.ceil(np.log2(max(1, n) / LEAF / len(cells)))))
    normals = r.standard_normal((sample.shape[1], more)).astype(np.float32)
    return [tuple(x) for x in out], normals, np.stack([np.median(sample[rows] @ normals, axis=0) if len(rows) else np.zeros(more) for rows in cells]).astype(np.float32)


def cell_of(tree: tuple[list, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    nodes, normals, places = tree
    at = np.zeros(len(x), np.int64) if nodes else np.full(len(x), -1)
    while (at >= 0).any():
        for node in np.unique(at[at >= 0]):
            rows = np.flatnonzero(at == node)
            normal, cut, below, above = nodes[node]
            at[rows] = np.where(x[rows] @ normal <= cut, below, above)
    cell = -at - 1
    for bit in range(normals.shape[1]):
        cell = cell | (x @ normals[:, bit] > places[-at - 1, bit]).astype(np.int64) << (16 + bit)
    return cell


def _leaves(x: np.ndarray, r: np.random.Generator) -> Iterator[np.ndarray]:
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            yield rows
            continue
        a, b = r.choice(len(rows), 2, replace=False)
        order = np.argsort(x[rows] @ (x[rows[a]] - x[rows[b]]), kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]


def _in_cell(cell: pa.Table, k: int, blocks: int) -> pa.Table:
    ids = np.asarray(cell.column("k").combine_chunks())
    order = np.argsort(ids, kind="stable")
    x, size = (z[order] for z in _vectors(cell.column("h")))
    ids = ids[order]
    out = []
    for rows in _leaves(x, np.random.default_rng(len(ids))):
        if len(rows) < 2:
            continue
        m = min(k, len(rows) - 1)
        s = x[rows] @ x[rows].T * size[rows]
        np.fill_diagonal(s, -np.inf)
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        out.append(_packed(np.repeat(ids[rows], m), ids[rows][top.ravel()], np.take_along_axis(s, top, 1).ravel(), blocks, m))
    return pa.Table.from_batches(out or [_packed(*NOTHING, blocks, 1)])


#: Vectors that one block of nodes sends to another.
SENT = "at_block int, ks array<long>, h binary, far array<float>"


def _send(nodes: pa.Table, asked: pa.Table) -> pa.Table:
    """The vectors of a block's nodes for each block that asks for some, one row for each."""
    out: tuple[list, ...] = ([], [], [], [])
    if len(nodes):
        ids = np.asarray(nodes.column("k").combine_chunks())
        order = np.argsort(ids, kind="stable")
        ids, h, far = ids[order], nodes.column("h").to_pylist(), np.asarray(nodes.column("far").combine_chunks())[order]
        for at, ks in zip(asked.column("at_block").to_pylist(), asked.column("ks").combine_chunks()):
            ks = np.asarray(ks.values)
            rows = np.searchsorted(ids, ks)
            for x, y in zip(out, (at, ks, b"".join(h[i] for i in order[rows]), far[rows])):
                x.append(y)
    kinds = (pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float32()))
    return pa.table([pa.array(x, k) for x, k in zip(out, kinds)], names=["at_block", "ks", "h", "far"])


def _received(sent: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, their directions and lengths, their farthest neighbours' products."""
    ids = np.asarray(sent.column("ks").combine_chunks().flatten())
    order = np.argsort(ids, kind="stable")
    x, size = _unpacked(b"".join(sent.column("h").to_pylist()), len(ids))
    return ids[order], x[order], size[order], np.asarray(sent.column("far").combine_chunks().flatten())[order]


def _join_around(pivots: pa.Table, vectors: pa.Table, k: int, blocks: int) -> pa.Table:
    """All pairs with a new one around each pivot: for each node the best of those it meets that are nearer than its farthest neighbour."""
    if not len(pivots) or not len(vectors):
        return pa.Table.from_batches([_packed(*NOTHING, blocks, 1)])
    ids, x, length, far = _received(vectors)
    members, news = (pivots.column(c).combine_chunks() for c in ("members", "news"))
    size = np.diff(np.asarray(members.offsets))
    flat, new = np.searchsorted(ids, np.asarray(members.flatten())), np.asarray(news)
    first = np.cumsum(size) - size
    held, total = [], 0
    by_size = np.argsort(size, kind="stable")  # pivots of like sizes waste little
    for at in range(0, len(size), 64):
        turn = by_size[at : at + 64]
        n, f, fresh = size[turn], first[turn], new[turn]
        wide, old = int(n.max()), int(fresh.max())
        on = np.arange(wide)[None, :] < n[:, None]
        rows = np.where(on, flat[np.minimum(f[:, None] + np.arange(wide)[None, :], len(flat) - 1)], 0)
        g = x[rows]
        # new ones stand first: only their products with all are taken
        s = np.matmul(g[:, :old], g.transpose(0, 2, 1))
        ok = on[:, None, :] & (np.arange(old)[None, :] < fresh[:, None])[:, :, None]
        ok[:, np.arange(old), np.arange(old)] = False
        ahead, back = s * length[rows][:, None, :], s * length[rows][:, :old, None]
        for products, least, turned in ((ahead, far[rows][:, :old, None], False), (back, far[rows][:, None, :], True)):
            p, a, b = np.nonzero(ok & (products > least))
            u, v = (rows[p, b], rows[p, a]) if turned else (rows[p, a], rows[p, b])
            held.append((u, v, products[p, a, b]))
            total += len(p)
        if total > 3_000_000:
            held = [_unlisted(_best(*(np.concatenate(z) for z in zip(*held)), k))]
            total = len(held[0][0])
    u, v, s = (np.concatenate(z) for z in zip(*held))
    return pa.Table.from_batches([_packed(ids[u], ids[v], s, blocks, k)])


def _ask(queries: pa.Table, blocks: int) -> pa.Table:
    """For each block the distinct nodes of it that a block's queries want to look at."""
    ks = np.unique(np.asarray(queries.column("c").combine_chunks().flatten()))
    to = ((ks >> 1) + (ks >> 8) + (ks >> 18)) % blocks
    order = np.argsort(to, kind="stable")
    some, size = np.unique(to, return_counts=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(ks[order]))
    at = queries.column("block")[0].as_py() if len(queries) else 0
    return pa.table([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), at, np.int32)), lists], names=["src", "at_block", "ks"])


def _look(queries: pa.Table, vectors: pa.Table, k: int, blocks: int) -> pa.Table:
    """Products of each query (u, its h, candidates) with its candidates."""
    out = [NOTHING]
    if len(queries) and len(vectors):
        ids, x, size, _ = _received(vectors)
        mine, _ = _vectors(queries.column("h"))
        for u, q, c in zip(queries.column("u").to_pylist(), mine, queries.column("c").combine_chunks()):
            c = np.unique(np.asarray(c.values))
            rows = np.searchsorted(ids, c)
            out.append((np.full(len(c), u), c, x[rows] @ q * size[rows]))
    return pa.Table.from_batches([_packed(*(np.concatenate(z) for z in zip(*out)), blocks, k)])


class Graph:
    """Nodes (k, h), members of nodes, and the neighbour lists (u, v, s)."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding"):
        spark = vectors.sparkSession
        self.scratch = scratch = Scratch(spark, "ann")
        rows = _clean(vectors, id_col, vec_col)
        lengths = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c"), F.max(F.array_max(F.transform("vec", F.abs))).alias("top")).orderBy(F.desc("c"), "n").first()
        self.empty = lengths is None
        rows = rows.where(F.size("vec") == (lengths["n"] if lengths else 0))
        longest = float(lengths["top"]) if lengths else 1.0
        rows = scratch.write(rows.groupBy("id").agg(F.min("vec").alias("vec")))
        #: (k, vec): one row for each distinct vector, named by its least id
        self.exact = scratch.write(rows.groupBy("vec").agg(F.min("id").alias("k"), F.count("*").alias("copies")))
        many = scratch.write(self.exact.where("copies > 1").select("k", F.col("vec").alias("vec2")))
        #: (k, id) of vectors that more than one row has
        self.copies = scratch.write(rows.join(many, F.col("vec") == F.col("vec2")).select("k", "id"))
        self.n = self.exact.count()
        self.blocks = max(1, -(-self.n // BLOCK))
        self.nodes = scratch.write(self.exact.select("k", "vec").mapInArrow(lambda it: _halved(it, longest), "k long, h binary"))
        self.k = NEIGHBOURS
        self.lists = self._grown()

    def _block(self, c: str):
        return block_of(c, self.blocks)

    def _with_vectors(self, needed: DataFrame, nodes: DataFrame) -> DataFrame:
        """The vectors of the distinct (block, k) in needed, as rows of SENT; nodes has (k, h, far)."""
        return self._sent(needed.select(F.col("block").alias("at_block"), "k").distinct().groupBy(self._block("k").alias("src"), "at_block").agg(F.collect_list("k").alias("ks")), nodes)

    def _sent(self, asked: DataFrame, nodes: DataFrame) -> DataFrame:
        """The vectors that blocks ask for, (src, at_block, ks), as rows of SENT."""
        held = nodes.select(self._block("k").alias("held"), "k", "h", F.col("far").cast("float").alias("far"))
        return held.groupBy("held").cogroup(asked.groupBy("src")).applyInArrow(_send, SENT)

    def _grown(self) -> DataFrame:
        sample, _ = _vectors(self.nodes.orderBy(F.xxhash64("k"), "k").limit(SAMPLE).select("h").toArrow().column(0).combine_chunks())
        trees = self.nodes.sparkSession.sparkContext.broadcast([plant(sample, self.n, seed) for seed in range(TREES)])

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, _ = _vectors(batch.column(1))
                for t, tree in enumerate(trees.value):
                    yield pa.record_batch([pa.array(cell_of(tree, x) + (t << 56)), batch.column(0), batch.column(1)], names=["cell", "k", "h"])

        k, blocks = self.k, self.blocks
        cells = self.nodes.mapInArrow(dealt, "cell long, k long, h binary")
        full = self.scratch.write(cells.groupBy("cell").agg(F.count("*").alias("c")).where(F.col("c") > CELL).select(F.col("cell").alias("full"), F.ceil(F.col("c") / CELL).alias("parts")))
        cells = cells.join(full, F.col("cell") == F.col("full"), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("k"), F.col("parts")), F.lit(0)))
        near = cells.select("cell", "part", "k", "h").groupBy("cell", "part").applyInArrow(lambda cell: _in_cell(cell, k, blocks), PACKED)
        lists = self.scratch.write(merged(near, blocks, k).withColumn("fresh", F.col("v")))
        for _ in range(ROUNDS):
            new = self.scratch.write(self._round(lists).join(lists.select(F.col("u").alias("u2"), F.col("v").alias("before")), F.col("u") == F.col("u2"), "left").select("u", "v", "s", F.array_except("v", F.coalesce("before", F.array().cast("array<long>"))).alias("fresh")))
            self.scratch.drop(lists)
            lists = new
            fresh, entries = lists.agg(F.sum(F.size("fresh")), F.sum(F.size("v"))).first()
            if (fresh or 0) <= SETTLED * (entries or 0):
                break
        return lists.select("u", "v", "s")

    def _round(self, lists: DataFrame) -> DataFrame:
        k, blocks = self.k, self.blocks
        edges = lists.select("u", F.explode("v").alias("v"), "fresh").select("u", "v", F.array_contains("fresh", F.col("v")).alias("new"))
        in_degree = self.scratch.write(edges.groupBy("v").agg(F.count("*").alias("d")).withColumnRenamed("v", "v2"))
        # where more nodes point to v than may, a hash thins them
        back = edges.join(in_degree, F.col("v") == F.col("v2")).where(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 20)) * F.col("d") < k * (1 << 20)).select(F.col("v").alias("pivot"), F.col("u").alias("k"), "new")
        around = edges.select(F.col("u").alias("pivot"), F.col("v").alias("k"), "new").union(back)
        around = around.groupBy("pivot").agg(F.collect_set(F.when(F.col("new"), F.col("k"))).alias("n"), F.collect_set(F.when(~F.col("new"), F.col("k"))).alias("o"))
        around = around.where("size(n) > 0").select("pivot", F.concat("n", F.array_except("o", "n")).alias("members"), F.size("n").alias("news"), self._block("pivot").alias("block"))
        around = self.scratch.write(around.where("size(members) > 1"))
        far = self.nodes.join(lists.select(F.col("u").alias("k"), F.when(F.size("s") >= k, F.element_at("s", -1)).otherwise(F.lit(float("-inf"))).cast("float").alias("far")), "k")
        needed = around.select("block", F.explode("members").alias("k"))
        vectors = self._with_vectors(needed, far)
        found = around.groupBy("block").cogroup(vectors.groupBy("at_block")).applyInArrow(lambda a, b: _join_around(a, b, k, blocks), PACKED)
        return merged(packed_lists(lists, blocks).union(found), blocks, k)

    def search(self, query_nodes: DataFrame) -> DataFrame:
        """(u, v): for each node u in query_nodes its EXACT nearest found, itself left out, best first."""
        scratch, keep, blocks = self.scratch, LIST, self.blocks
        now = scratch.write(self.lists.join(query_nodes.select(F.col("k").alias("u")).distinct(), "u", "left_semi").withColumn("seen", F.array().cast("array<long>")))
        mine = self.nodes.join(now.select(F.col("u").alias("k")), "k", "left_semi").select(F.col("k").alias("u"), "h")
        mine = scratch.write(mine)
        for _ in range(HOPS):
            fresh = F.slice(F.array_except("v", "seen"), 1, WIDEN)
            step = scratch.write(now.select("u", fresh.alias("at")))
            hop = step.select("u", F.explode("at").alias("a")).join(self.lists.select(F.col("u").alias("a"), F.col("v").alias("c")), "a")
            hop = scratch.write(hop.groupBy("u").agg(F.array_distinct(F.flatten(F.collect_list("c"))).alias("c")).join(mine, "u").select("u", "h", F.array_except("c", F.array("u")).alias("c"), self._block("u").alias("block")))
            asked = hop.select("block", "c").groupBy("block").applyInArrow(lambda t: _ask(t, blocks), "src int, at_block int, ks array<long>")
            vectors = self._sent(asked, self.nodes.withColumn("far", F.lit(0.0)))
            found = hop.groupBy("block").cogroup(vectors.groupBy("at_block")).applyInArrow(lambda a, b: _look(a, b, keep, blocks), PACKED)
            best = merged(packed_lists(now, blocks).union(found), blocks, keep)
            new = scratch.write(best.join(now.select("u", "seen"), "u").join(step, "u").select("u", "v", "s", F.concat("seen", "at").alias("seen")))
            now = new
        return now.select("u", F.slice("v", 1, EXACT).alias("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", graph: Graph | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, a row of vectors; candidates are all rows of other ids."""
    g = graph or Graph(vectors, id_col, vec_col)
    asked = _clean(queries, id_col, vec_col)
    # each query's node: its own id where its vector is its own, else the least id of that vector
    asked = g.scratch.write(asked.select("id").distinct().join(g.copies.withColumnRenamed("k", "ck"), "id", "left").select(F.col("id").alias("query_id"), F.coalesce("ck", "id").alias("k")).join(g.exact.select("k"), "k", "left_semi"))
    found = g.search(asked).select("u", F.explode("v").alias("v"))
    found = found.union(asked.select(F.col("k").alias("u"), F.col("k").alias("v")).distinct())
    left = g.exact.select(F.col("k").alias("u"), F.col("vec").alias("a"))
    right = g.exact.select(F.col("k").alias("v"), F.col("vec").alias("b"))
    product = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    scored = g.scratch.write(found.join(left, "u").join(right, "v").select("u", "v", product.alias("score")))
    # of equal vectors the k + 1 least ids are enough; they are found by parts, as one vector may have very many
    part = Window.partitionBy("k", "part").orderBy("id")
    few = g.copies.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(256))).withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1)
    few = g.scratch.write(few.groupBy("k").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids")).withColumnRenamed("k", "v"))
    # copies of a vector share their best lists: k + 1 rows of each node hold the k best of any of its queries
    spread = scored.join(few, "v", "left").select("u", "score", F.explode(F.coalesce("ids", F.array("v"))).alias("vec_id"))
    best = spread.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    best = g.scratch.write(best.groupBy("u").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("best")))
    out = asked.join(best.withColumnRenamed("u", "k"), "k").select("query_id", F.filter("best", lambda x: x["vec_id"] != F.col("query_id")).alias("best"))
    out = out.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), "x.vec_id", (0.0 - F.col("x.minus")).alias("score"))


def op9_ann(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)
