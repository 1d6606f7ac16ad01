"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Targets: all words together are shared by weight; a source stops at ``most`` times its own size and what it can't take
is shared by weight among the rest, until none is above. That limit is found in closed form: sources in the order of
limit / weight, the first k at their limits, the others at one level per unit of weight.

Sampling: within a source every document expects target / source_size copies. Documents stand in a fixed order; with
P the prefix sum of expected copies and u one random offset of the source, a document comes once for each integer
that lies between P before it + u and P behind it + u. The order is by size, so that neighbours are alike and the words
taken differ from the target by little more than one document.

A prefix sum needs a document's rank in its source. A source is cut into size bins, and bins into slices by a hash, so
that a slice has a few hundred rows, or a 4096th of its source if that is more; ranks inside slices come from a window,
the offsets of slices from a window over the counts of slices. No task gets a whole source.

Defined results: a null text has size 0; a size of 0 takes no words, and a source without words has target 0;
a null source is a source of its own, the last; rows that repeat an id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, table

WEIGHTS = (5, 2, 1)
MOST = 3
#: Rows that a slice has, unless its source has more than MAX_SLICES of them.
SLICE_ROWS = 256
MAX_SLICES = 4096
WORD = "[^\\x20\\x09-\\x0D]+"


def _fraction(*what: Column) -> Column:
    """An even number of [0, 4096) from a digest, with the text of what it is taken from."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *what)), 1, 3), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n); one row a source, so one task orders them."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1)
    s = sizes.withColumn("weight", weight.cast("long")).withColumn("limit", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("total", F.sum("source_size").over(every))
    # the level if this source and all behind it stay below their limits
    s = s.withColumn("held", F.coalesce(F.sum("limit").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("rest", F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("held")) / F.col("rest"))
    # the first source in that order whose limit is not reached gives the level of all behind it
    s = s.withColumn("level", F.min(F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(every)["level"])
    target = F.when(F.col("limit") / F.col("weight") <= F.col("level"), F.col("limit").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return s.select("source", "source_size", "n", F.coalesce(target, F.col("limit").cast("double")).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) and the columns in keep, one row for each row of docs.

    All tables that are written are of ids and counts; the columns in keep are shuffled once, to their slices."""
    scratch = Scratch(docs.sparkSession, "mix")
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    # eight bins for each doubling of the size
    sized = sized.withColumn("bin", F.expr("length(bin(size)) * 16 + shiftright(size, greatest(length(bin(size)) - 4, 0))"))
    light = scratch.write(sized.select("doc_id", "source", "size", "bin")) if keep else scratch.write(sized)
    bins = scratch.write(light.groupBy("source", "bin").agg(F.count("*").alias("c"), F.sum("size").alias("s")))
    plan = scratch.write(targets(bins.groupBy("source").agg(F.sum("s").alias("source_size"), F.sum("c").alias("n")), weights, most))
    per = F.greatest(F.lit(SLICE_ROWS), F.ceil(F.col("n") / MAX_SLICES))
    of_source = plan.select(F.col("source").alias("s2"), "n", "source_size", "target")
    cut = bins.join(of_source, _same(F.col("source"), F.col("s2"))).select(F.col("source").alias("bin_source"), F.col("bin").alias("bin_no"), F.ceil(F.col("c") / per).cast("long").alias("slices"), "source_size", "target")
    cut = scratch.write(cut)
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")

    def sliced(rows: DataFrame) -> DataFrame:
        rows = rows.join(cut, _same(F.col("source"), F.col("bin_source")) & (F.col("bin") == F.col("bin_no"))).drop("bin_source", "bin_no")
        return rows.withColumn("slice", F.col("bin") * 1048576 + digest % F.col("slices")).drop("slices", "bin")

    counts = scratch.write(sliced(light).groupBy("source", "slice").agg(F.count("*").alias("c")))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.write(counts.select(F.col("source").alias("s2"), F.col("slice").alias("slice2"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("source", "slice").orderBy("size", F.col("doc_id").asc_nulls_last())
    ranked = sliced(sized if keep else light).withColumn("rank", F.row_number().over(inside))
    ranked = ranked.join(offsets, _same(F.col("source"), F.col("s2")) & (F.col("slice") == F.col("slice2"))).withColumn("rank", F.col("rank") + F.col("offset")).drop("s2", "slice2", "offset")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = (_fraction(F.lit(str(seed)), F.coalesce(F.col("source"), F.lit("null"))) + 0.5) / 4096
    crossed = F.floor(F.col("rank") * expected + offset) - F.floor((F.col("rank") - 1) * expected + offset)
    ranked = ranked.withColumn("copies", F.least(crossed, F.lit(most)).cast("long"))
    return ranked.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *(F.col(f"keep_{c}").alias(c) for c in keep))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
