"""Pairs of profiles that can be duplicates, found by what such a pair must have in common, not by all pairs of a key.

The rules of ``stories.decision`` bound the overlaps of titles (T of the union, C of the smaller) and texts (X), so a
pair of one feed that is a duplicate has at least one of these in common:

url, print   its URL, or its fingerprint
none         titles without tokens
bits         4 or fewer of 32 bits differ: 3 of 7 blocks of bits are equal
text         X >= 0.766: one of the rarest tokens of each, of which a text has as many as such a pair can't miss
title        C > 0.5: two title tokens, both among the rarest of the smaller title, as it shares more than half of its own;
             a title of one token shares that one

Nothing else can: with C <= 0.5, T is below 0.35, so only the bits rule, or a weighted score with X > 0.766, says duplicate.
Rarity is told by the tokens that are at least one 65,536th of all occurrences, so that table has at most as many rows.

Every class gives a number of rows that depends on its own sizes only. Classes that share evidence meet in blocks, so no
task gets a hot one whole; what remains quadratic is evidence that very many unlike articles share, for which sizes and
bits are compared before a pair becomes a row.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.graph import checkpoints

#: Least overlap of texts where titles share no more than half of the smaller one, and where few bits differ.
TEXT, BITS_TEXT, BITS = 0.766, 0.3, 4
#: Bits of each of 7 blocks of a hash; of 7, the pairs within 4 bits have 3 equal.
BLOCKS = (5, 5, 5, 5, 4, 4, 4)
COMMON = 1 << 16
BLOCK = 500


def rare_first(k: DataFrame, tokens: str = "text_tokens") -> DataFrame:
    """(class_id, rare): the tokens of each row of k, rare ones first, by one order for all rows."""
    words = k.select("class_id", F.explode(tokens).alias("t"))
    counts = words.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    least = words.count() / COMMON
    common = counts.where(F.col("df") >= least)  # no more than COMMON can be
    # exploded rows stay where their class is
    placed = k.select("class_id", tokens).repartition("class_id").select("class_id", F.explode(tokens).alias("t")).join(F.broadcast(common), "t", "left")
    ranked = placed.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("l"))
    return ranked.select("class_id", F.col("l.t").alias("rare"))


def _masks() -> list[int]:
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    part = [((1 << n) - 1) << s for n, s in zip(BLOCKS, starts)]
    return [sum(part[i] for i in three) for three in combinations(range(len(BLOCKS)), 3)]


def evidence(k: DataFrame, by_feed: bool = True) -> DataFrame:
    """(class_id, key, kind, side, n_title, n_text, simhash): side 1 meets side 2, and 3 meets 3.

    Without by_feed articles of different feeds may have evidence in common."""
    ranked = k.join(rare_first(k), "class_id", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>")))
    title = F.concat(F.array_intersect("rare", "title_tokens"), F.array_except("title_tokens", "rare"))
    light = ranked.select(
        "class_id", "feed", "canonical_url", "fingerprint", "simhash", title.alias("title"), F.size("title_tokens").alias("n_title"), F.size("text_tokens").alias("n_text"),
        F.slice("rare", 1, (F.size("rare") - F.ceil(F.size("rare") * TEXT) + 1).cast("int")).alias("text"),
    )
    feed = F.col("feed") if by_feed else F.lit("")
    key = lambda kind, *v: F.xxhash64(feed, F.lit(kind), *v)
    told = lambda keys, kind, side: F.transform(keys, lambda x: F.struct(x.alias("key"), F.lit(kind).alias("kind"), F.lit(side).alias("side")))
    none = F.array().cast("array<bigint>")

    def twos(tokens: Column) -> Column:
        each = F.transform(tokens, lambda x, i: F.transform(F.slice(tokens, i + 2, F.size(tokens)), lambda y: key("title", F.least(x, y), F.greatest(x, y))))
        return F.array_distinct(F.flatten(each))

    # as many of the smaller title's rarest tokens as hold two of any floor(n / 2) + 1
    rarest = F.slice("title", 1, (F.col("n_title") - F.floor(F.col("n_title") / 2) + 1).cast("int"))
    one = F.transform("title", lambda x: key("one", x))
    when = lambda yes, keys: F.when(yes, keys).otherwise(none)
    rows = F.concat(
        told(when(F.coalesce(F.col("canonical_url") != "", F.lit(False)), F.array(key("url", F.col("canonical_url")))), "same", 3),
        told(when(F.coalesce(F.col("fingerprint") != "", F.lit(False)), F.array(F.xxhash64(F.lit("print"), F.col("fingerprint")))), "same", 3),
        told(when(F.col("n_title") == 0, F.array(key("none"))), "same", 3),
        told(F.array(*(key("bits", F.lit(i), F.col("simhash").cast("long").bitwiseAND(F.lit(m))) for i, m in enumerate(_masks()))), "bits", 3),
        told(F.transform("text", lambda x: key("text", x)), "text", 3),
        told(when(F.col("n_title") > 1, twos(rarest)), "title", 1),
        told(when(F.col("n_title") > 1, twos(F.col("title"))), "title", 2),
        told(when(F.col("n_title") == 1, one), "one", 1),
        told(one, "one", 2),
    )
    return light.select("class_id", F.explode(rows).alias("e"), "n_title", "n_text", "simhash").select("class_id", "e.key", "e.kind", "e.side", "n_title", "n_text", F.col("simhash").cast("long").alias("simhash"))


def candidates(k: DataFrame, by_feed: bool = True) -> DataFrame:
    """(left, right), left < right: pairs of classes of k (class_id and a profile) with evidence in common, each once."""
    checkpoints(k.sparkSession)
    return _met(evidence(k, by_feed).checkpoint())


def _met(e: DataFrame) -> DataFrame:
    """Pairs of classes with a key in common, each once."""
    met = e.groupBy("key", "kind").agg(F.count(F.when(F.col("side") > 1, 1)).alias("c"), F.count(F.when(F.col("side") != 2, 1)).alias("from")).where("c > 0 and from > 0 and c + from > 2")
    once = F.when(F.col("l.side") == 3, F.col("l.class_id") < F.col("r.class_id")).otherwise(F.col("l.class_id") != F.col("r.class_id"))
    pairs = _pairs(e, met, F.col("side") != 2, F.col("side") != 1, once)
    return pairs.select(F.least("l.class_id", "r.class_id").alias("left"), F.greatest("l.class_id", "r.class_id").alias("right")).distinct()


def _pairs(e: DataFrame, met: DataFrame, on_left: Column, on_right: Column, once: Column) -> DataFrame:
    """(l, r) of rows of the two sides that share a key of met (key, kind, c on the right, from on the left) and fit by size; blocks of a hot key meet in tasks of their own."""
    blocks = F.ceil(F.greatest("c", "from") / BLOCK).cast("int")
    rows = e.join(met.select("key", "kind", blocks.alias("blocks")), ["key", "kind"]).withColumn("at", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    side = lambda s: F.struct("class_id", "side", "n_title", "n_text", "simhash").alias(s)
    every = lambda: F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.where(on_left).select("key", "kind", F.col("at").alias("i"), every().alias("j"), side("l"))
    right = rows.where(on_right).select("key", "kind", every().alias("i"), F.col("at").alias("j"), side("r"))
    least, most = F.least("l.n_text", "r.n_text"), F.greatest("l.n_text", "r.n_text")
    near = F.bit_count(F.col("l.simhash").bitwiseXOR(F.col("r.simhash"))) <= BITS
    smaller, larger = (F.when(F.col("l.side") == x, F.col("l.n_title")).otherwise(F.col("r.n_title")) for x in (1, 2))
    fits = F.when(F.col("kind") == "title", smaller <= larger).when(F.col("kind") == "text", least >= most * TEXT).when(F.col("kind") == "bits", near & (least >= most * BITS_TEXT)).otherwise(F.lit(True))
    return left.join(right, ["key", "kind", "i", "j"]).where(once & fits)
