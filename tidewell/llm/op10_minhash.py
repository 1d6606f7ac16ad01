"""MinHash near-dedup by circulant signatures, banding and exact verification.

Two permutations make the whole signature: the first scatters the shingles of a text over a circle, the second,
read from K consecutive places of that circle, gives K values for each shingle; coordinate k is the least of the
values at shift k. Coordinates are banded; texts that share a band are candidates. Every link rests on the full
shingle sets. Texts with equal sets are one class from the start and are never paired with each other.

Links are sought until none can be missing among candidates. In a few rounds all members of a bucket meet a pivot,
components are joined, and buckets that lie in one component are done. What is left are texts that share a bucket, but
no component. Two sets of sizes a and b that are to be linked have so much in common that, with all shingles in one
order, they share one among the first few of each, its prefix. The order is by how often a shingle comes among the
texts that are left, the rarest first, counted in a fixed number of cells; it decides how much work is done, never what
is found. So a passage that many texts share brings none of them together, as their own words come before it. Texts
whose prefix no other component shares are done. Of the others those that are alike, though too little to be linked,
form families, as copies edited at many places do; within a family all members of different components are compared in
blocks of texts, block against block, so that no row stands for a pair. Other pairs that share a shingle of their
prefixes are compared one by one.
With 48 bands of 6, two texts of similarity 0.8 share no band with probability below 1e-6. Sets so small that no other
set can be similar enough, of three shingles or fewer at 80 per cent, are linked with equal ones only and have no bands.

Defined results: null and empty texts, and texts of white space, have no shingles, are linked with nothing and stay;
ids that are null take no part in links and stay; rows that share an id are documents of their own: equal ones are
copies, different ones are linked as their texts are. A component has the least id among its documents. Of each
component exactly one pair of id and text is ``kept``: that of least id, then of least digest. An empty table gives an empty one; other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import U64, Scratch, mix, shingles, steps, words

CIRCLE = 1 << 20
BANDS, ROWS = 48, 6
#: Pivots that the members of a bucket meet before all that is left meets.
PIVOTS = 3
#: Shingles and texts in a block of a family, about; a longer text is a block with few others.
BLOCK_SHINGLES, BLOCK_TEXTS = 60_000, 800
#: Bands of the first round; it joins most copies, so that later rounds have few pairs.
FIRST_BANDS = 6
#: Cells in which shingles are counted for the order of prefixes, and the parts in which a task's counts travel.
CELLS, PARTS = 1 << 18, 32


@cache
def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240)
    scatter = rng.permutation(CIRCLE).astype(np.int32)
    ring = rng.permutation(CIRCLE).astype(np.int32)
    return scatter, np.lib.stride_tricks.sliding_window_view(np.concatenate((ring, ring[: k - 1])), k)


def signature(hashes: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """The k circulant minima of a set of at least one shingle."""
    scatter, ring = _permutations(k)
    at = scatter[(hashes & U64(CIRCLE - 1)).astype(np.int64)]
    out = ring[at[:256]].min(axis=0)
    for i in range(256, len(at), 256):
        np.minimum(out, ring[at[i : i + 256]].min(axis=0), out=out)
    return out


def _set_hash(x: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _signed(batches: Iterator[pa.RecordBatch], words_per: int, percent: int) -> Iterator[pa.RecordBatch]:
    times = (np.random.default_rng(7).integers(0, 1 << 62, ROWS).astype(U64) << U64(1)) | U64(1)
    salt = mix(np.arange(1, BANDS + 1, dtype=U64))
    for batch in batches:
        for i, j, b, ends in steps(batch):
            sets = shingles(*words(b, ends), words_per)
            # a set of n has no other one to be linked with unless n of n + 1 are enough
            full = [n for n, x in enumerate(sets) if 100 * len(x) >= percent * (len(x) + 1) and len(x)]
            keys: list = [None] * len(sets)
            if full:
                sig = np.stack([signature(sets[n]) for n in full]).astype(U64).reshape(len(full), BANDS, ROWS)
                bands = mix(mix((sig * times).sum(axis=2, dtype=U64)) + salt).astype(np.int64)
                for n, row in zip(full, bands):
                    keys[n] = row
            yield pa.record_batch(
                [
                    batch.column(0).slice(i, j - i),
                    batch.column(2).slice(i, j - i),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([_set_hash(x) if len(x) else None for x in sets], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["id", "digest", "n_shingles", "set_hash", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch], words_per: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, b, ends in steps(batch):
            sets = shingles(*words(b, ends), words_per)
            yield pa.record_batch([pa.array([_set_hash(x) for x in sets], pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["set_hash", "grams"])


def _cell(grams: np.ndarray) -> np.ndarray:
    return (grams.view(U64) >> U64(20) & U64(CELLS - 1)).astype(np.int64)


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of this task's shingles, PARTS rows of them."""
    out = np.zeros(CELLS, np.int64)
    for batch in batches:
        out += np.bincount(_cell(np.asarray(batch.column("grams").flatten())), minlength=CELLS)
    if out.any():
        yield pa.record_batch([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array([x.tobytes() for x in out.reshape(PARTS, -1)], pa.binary())], names=["part", "counts"])


def _summed(parts: pa.Table) -> pa.Table:
    total = np.zeros(CELLS // PARTS, np.int64)
    for x in parts.column("counts").to_pylist():
        total += np.frombuffer(x, np.int64)
    return pa.table([parts.column("part").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])


def shingle_counts(full: DataFrame) -> np.ndarray:
    """How often the shingles of each cell come in full's grams; CELLS numbers, summed part by part."""
    rows = full.select("grams").mapInArrow(_cell_counts, "part int, counts binary").groupBy("part").applyInArrow(_summed, "part int, counts binary").collect()
    out = np.zeros((PARTS, CELLS // PARTS), np.int64)
    for part, counts in rows:
        out[part] = np.frombuffer(counts, np.int64)
    return out.ravel()


def prefix(grams: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set of n, so many that one must be in any set linked with it: all but those that
    percent of n, rounded up, leaves, and one more."""
    n = len(grams)
    some = n - -(-percent * n // 100) + 1
    return grams[np.lexsort((grams, counts[_cell(grams)]))[:some]]


def _prefixes(batches: Iterator[pa.RecordBatch], counts, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = batch.column("grams")
        flat, ends = np.asarray(grams.flatten()), np.asarray(grams.offsets) - grams.offsets[0].as_py()
        some = [prefix(flat[a:z], counts.value, percent) for a, z in zip(ends[:-1], ends[1:])]
        offsets = np.append(0, np.cumsum([len(x) for x in some]))
        rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(some) if some else np.zeros(0, np.int64)))
        yield pa.record_batch([batch.column("k"), batch.column("c"), batch.column("n"), rows], names=["k", "c", "n", "grams"])


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for the ends of the links (a, b): the least id that links lead to.

    Large and small stars in turn, until nothing changes. Minima are taken, written and only then joined, so that the
    links of one node are never needed in one task and Spark can split a hot node's rows."""
    edges = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.write(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        scratch.drop(least)
        least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = scratch.write(small.where("u <> v").distinct())
        for df in (edges, large, least):
            scratch.drop(df)
        edges, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _in_families(members: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The links (a, b) between texts of one family f and different components c; members has (k, c, f)."""
    full = scratch.write(members.join(sets, "k"))
    sizes = full.groupBy("f").agg(F.ceil(F.greatest(F.sum(F.size("grams")) / BLOCK_SHINGLES, F.count("*") / BLOCK_TEXTS)).cast("int").alias("blocks"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    sizes = scratch.write(sizes.select("f", "blocks"))
    placed = full.join(sizes, "f").withColumn("i", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    blocks = scratch.write(placed.groupBy("f", "i").agg(F.max("blocks").alias("blocks"), F.collect_list(F.struct("k", "c", "grams")).alias("texts")))
    left = blocks.select("f", "i", F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j"), F.col("texts").alias("x"))
    right = blocks.select("f", F.explode(F.sequence(F.lit(0), "i")).alias("i"), F.col("i").alias("j"), F.col("texts").alias("y"))
    return left.join(right, ["f", "i", "j"]).select("x", "y").mapInArrow(lambda it: _block_links(it, percent), "a long, b long")


def _columns(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, components, all shingles, and the text that each shingle is of."""
    grams = texts.field("grams")
    sizes = np.diff(np.asarray(grams.offsets))
    return np.asarray(texts.field("k")), np.asarray(texts.field("c")), np.asarray(grams.flatten()), np.repeat(np.arange(len(texts)), sizes)


def _block_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            (ka, ca, ga, ia), (kb, cb, gb, ib) = (_columns(pa.array(batch.column(n)[row].values)) for n in (0, 1))
            na, nb = np.bincount(ia, minlength=len(ka)), np.bincount(ib, minlength=len(kb))
            common = np.intersect1d(ga, gb)
            both = np.zeros((len(ka), len(kb)), np.float32)
            pa_, pb_ = np.searchsorted(common, ga), np.searchsorted(common, gb)
            in_a = common[np.minimum(pa_, len(common) - 1)] == ga if len(common) else np.zeros(len(ga), bool)
            in_b = common[np.minimum(pb_, len(common) - 1)] == gb if len(common) else np.zeros(len(gb), bool)
            for at in range(0, len(common), 4096):
                width = min(4096, len(common) - at)
                one, two = (np.zeros((len(k), width), np.float32) for k in (ka, kb))
                for m, inn, p, t in ((one, in_a, pa_, ia), (two, in_b, pb_, ib)):
                    on = inn & (p >= at) & (p < at + width)
                    m[t[on], p[on] - at] = 1
                both += one @ two.T
            union = na[:, None] + nb[None, :] - both
            x, y = np.nonzero((100 * both >= percent * union) & (ca[:, None] != cb[None, :]))
            yield pa.record_batch([pa.array(ka[x]), pa.array(kb[y])], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per: int = 5, percent: int = 80) -> DataFrame:
    """(id, digest, n_shingles, component, kept) for every row of docs; linked are texts with 100 * intersection >= percent * union.

    digest is the md5 of the text, which with the id names the one text of a component that is kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.write(plain.withColumn("digest", F.md5(F.coalesce("text", F.lit("")))).mapInArrow(lambda it: _signed(it, words_per, percent), "id long, digest string, n_shingles long, set_hash binary, bands array<long>"))
    # k numbers the classes of equal sets; the written table holds it fast
    classes = signed.where("set_hash is not null and id is not null").groupBy("set_hash").agg(F.min(F.struct("id", "digest")).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.write(classes.withColumn("k", F.monotonically_increasing_id()))
    rows = classes.select("k", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = scratch.write(rows.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"))
    rows = scratch.write(rows.join(shared, "bucket"))
    scratch.drop(shared)
    wanted = scratch.write(classes.join(rows.select("k").distinct(), "k", "left_semi").select("set_hash", "k", F.col("rep.id").alias("id")))
    sets = plain.join(wanted.select("id"), "id", "left_semi").mapInArrow(lambda it: _sets(it, words_per), "set_hash binary, grams array<long>")
    sets = scratch.write(sets.groupBy("set_hash").agg(F.first("grams").alias("grams")).join(wanted.select("set_hash", "k"), "set_hash").select("k", "grams"))

    tested, comp = None, None

    def verified(pairs: DataFrame) -> tuple[DataFrame, int, int]:
        pairs = pairs.where(100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")).select(F.least("k", "pk").alias("a"), F.greatest("k", "pk").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = pairs.join(sets.select(F.col("k").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("k").alias("b"), F.col("grams").alias("gb")), "b")
        both = F.size(F.array_intersect("ga", "gb"))
        union = F.size("ga") + F.size("gb") - both
        pairs = scratch.write(pairs.select("a", "b", (100 * both >= percent * union).alias("linked"), (2 * both >= union).alias("alike")))
        return pairs, *pairs.agg(F.count("*"), F.count_if("linked")).first()

    def joined(new: DataFrame) -> DataFrame:
        return components(new if comp is None else new.union(comp.select(F.col("id").alias("a"), F.col("component").alias("b"))), scratch)

    def live_rows(rows: DataFrame) -> DataFrame:
        """The rows of buckets that hold more than one component."""
        if comp is None:
            return rows.withColumn("c", F.col("k"))
        live = scratch.write(rows.join(comp.select(F.col("id").alias("k"), "component"), "k", "left").select("bucket", "k", "n", F.coalesce("component", "k").alias("c")))
        split = scratch.write(live.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("bucket"))
        return scratch.write(live.join(split, "bucket"))

    for turn in range(PIVOTS):
        live = live_rows(rows.where(F.col("band") < FIRST_BANDS) if turn == 0 else rows)
        if turn and live.isEmpty():
            break
        pivot = scratch.write(live.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("k", F.lit(turn)), F.col("k").alias("pk"), F.col("c").alias("pc"), F.col("n").alias("pn"))).alias("p")).select("bucket", "p.pk", "p.pc", "p.pn"))
        pairs, _, found = verified(live.join(pivot, "bucket").where("c <> pc"))
        tested = pairs if tested is None else tested.union(pairs)
        if found:
            comp = joined(pairs.where("linked").select("a", "b"))
    left = scratch.write(live_rows(rows).select("k", "c", "n").distinct())
    if not left.isEmpty():
        full = scratch.write(left.join(sets, "k"))
        counts = spark.sparkContext.broadcast(shingle_counts(full))
        first = full.mapInArrow(lambda it: _prefixes(it, counts, percent), "k long, c long, n long, grams array<long>")
        first = scratch.write(first.select("k", "c", "n", F.explode("grams").alias("gram")))
        split = scratch.write(first.groupBy("gram").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("gram"))
        family = components(tested.where("alike").select("a", "b"), scratch)
        first = first.join(split, "gram").join(family.select(F.col("id").alias("k"), F.col("component").alias("family")), "k", "left")
        first = scratch.write(first.select("gram", "k", "c", "n", F.coalesce("family", "k").alias("f")))
        other = first.select("gram", F.col("k").alias("pk"), F.col("n").alias("pn"), F.col("c").alias("pc"), F.col("f").alias("pf"))
        pairs, _, found = verified(first.join(other, "gram").where("k < pk and c <> pc and f <> pf"))
        inside = scratch.write(_in_families(first.select("k", "c", "f").distinct(), sets, scratch, percent))
        if found or not inside.isEmpty():
            comp = joined(inside.union(pairs.where("linked").select("a", "b")))
    if comp is None:
        belongs = classes.select("set_hash", "k", "rep", F.col("k").alias("c"))
    else:
        belongs = classes.join(comp.withColumnRenamed("id", "k"), "k", "left").select("set_hash", "k", "rep", F.coalesce("component", "k").alias("c"))
    best = scratch.write(belongs.groupBy("c").agg(F.min("rep").alias("best")))
    belongs = scratch.write(belongs.join(best, "c").select("set_hash", "best"))
    out = signed.select("id", "digest", "n_shingles", F.when(F.col("id").isNotNull(), F.col("set_hash")).alias("set_hash")).join(belongs, "set_hash", "left")
    return out.select("id", "digest", "n_shingles", F.coalesce("best.id", "id").alias("component"), F.coalesce(F.struct("id", "digest") == F.col("best"), F.lit(True)).alias("kept"))


def op10_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    from tidewell.llm.common import table

    out = near_duplicates(table(spark, sf_dir, "documents"), words_per=2, percent=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
