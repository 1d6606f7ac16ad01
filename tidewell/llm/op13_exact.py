"""Exact duplicates by an extendible-hash index on shared files, in DataFrame functions only.

The pseudo-key of a text is a 64-bit hash of it after runs of white space became one space. The directory has one cell
for each value of a pseudo-key's first DEPTH bits. It starts as one bucket of depth 0; a bucket that holds more than its
capacity is split by the next bit, which doubles the directory where that bucket already used all its bits. As splits
depend on counts only, the buckets of all depths are counted at once, and a cell belongs to the one of least depth that
isn't overfull.

Doubling can't part copies of one text. A pseudo-key with more rows than a bucket holds becomes a chain of overflow
pages, to which its rows are dealt by their places, so no task gets a large group of copies whole.

The owner of a page sorts its rows by pseudo-key and bytes: rows of one pseudo-key are a chain, and only those of equal
bytes are copies, so collisions stay apart. Owners write their pages to the shared folder; the heads of the pages of one
chain are compared by their bytes again and give the row that stays.

Capacity follows the number of rows, so the directory has at most 2 ** DEPTH cells and long chains at most
2 ** (DEPTH - 1) pages at any size: both are broadcast. Every text is shuffled once.

Defined results: a null text is empty; among equal ids in a group any one of those rows stays, and only one; a null id
comes behind all others; an empty table gives an empty one; other columns are not looked at, whatever their names.
Very long texts are moved and compared whole, one row at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, table

#: Bits of a pseudo-key that the directory may use, and rows that a bucket holds, unless the table has more than 2 ** (DEPTH - 2) times as many.
DEPTH = 16
CAPACITY = 256
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def directory(keys: DataFrame, capacity: int, depth: int = DEPTH) -> DataFrame:
    """(cell, bucket, depth) for each first bits of a pseudo-key that occur; keys has a row for each pseudo-key h with its number of rows c.

    A pseudo-key counts as one page at most: more of its rows go to pages of their own."""
    cell = F.shiftrightunsigned("h", 64 - depth).alias("cell")
    cells = keys.groupBy(cell).agg(F.sum(F.least("c", F.lit(capacity))).alias("rows"))
    split = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {depth} - depth)"))
    buckets = split.groupBy("depth", "prefix").agg(F.sum("rows").alias("held")).where((F.col("held") <= capacity) | (F.col("depth") == depth))
    # buckets of any depth that aren't overfull are fewer than 2 ** (depth + 1)
    found = split.join(F.broadcast(buckets), ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return found.select("cell", F.expr(f"shiftrightunsigned(cell, {depth} - depth) * 64 + depth").alias("bucket"), "depth")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), capacity: int = CAPACITY, depth: int = DEPTH) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) and the columns in keep, one row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), *(F.col(c).alias(f"keep_{c}") for c in keep)).withColumn("h", F.xxhash64("norm"))
    keys = scratch.write(rows.groupBy("h").agg(F.count("*").alias("c")))
    n = keys.agg(F.sum("c")).first()[0] or 0
    capacity = max(capacity, -(-n >> depth - 2))
    cells = scratch.write(directory(keys, capacity, depth))
    chains = scratch.write(keys.where(F.col("c") > capacity).select("h", F.ceil(F.col("c") / capacity).cast("int").alias("pages")))
    # at most 2 ** DEPTH cells and a quarter as many chains
    dealt = rows.withColumn("cell", F.shiftrightunsigned("h", 64 - depth)).join(F.broadcast(cells), "cell").join(F.broadcast(chains), "h", "left")
    dealt = dealt.withColumn("pages", F.coalesce("pages", F.lit(1))).withColumn("page", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("pages")).cast("int"))
    chain = Window.partitionBy("bucket", "page", "h", "norm").orderBy(F.col("id").asc_nulls_last())
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    owned = dealt.repartition("bucket", "page").withColumns({"place": F.row_number().over(chain), "n": F.count("*").over(whole), "first": F.min("id").over(whole)})
    head = F.when((F.col("pages") > 1) & (F.col("place") == 1), F.col("norm"))
    pages = scratch.write(owned.select("id", "h", "bucket", "page", "pages", "place", "n", "first", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), head.alias("head"), *(f"keep_{c}" for c in keep)))
    heads = pages.where("head is not null").groupBy("h", "head").agg(F.sum("n").alias("all"), F.min(F.struct(F.isnull("id").alias("none"), "id", "page")).alias("least"))
    heads = heads.select("h", F.sha2(F.col("head").cast("binary"), 256).alias("sha"), "all", F.col("least.id").alias("least_id"), F.col("least.page").alias("least_page"))
    # a head for each text of more rows than a bucket holds
    told = pages.drop("head").join(F.broadcast(heads), ["h", "sha"], "left")
    paged = F.col("all").isNotNull()
    return told.select(
        "id",
        F.when(paged, F.col("least_id")).otherwise(F.col("first")).alias("keep_id"),
        F.when(paged, F.col("all")).otherwise(F.col("n")).alias("group_size"),
        ((F.col("place") == 1) & (~paged | (F.col("page") == F.col("least_page")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(F.col(f"keep_{c}").alias(c) for c in keep),
    )


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
