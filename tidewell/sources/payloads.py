"""A folder of feed payloads as a Spark data source, and catalogs of sources from JSON with their checks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewell.functions import text as X
from tidewell.functions import variant as J

FORMAT = "feed_payloads"
#: Bytes that are read at a time; a payload is a line, so a file of any size is never held whole.
CHUNK = 1 << 20


class _File(InputPartition):
    def __init__(self, source: str, path: str):
        self.source, self.path = source, path


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        """One for each file below source_id=...; what begins with a point or an underscore is none."""
        fs, root = _folder(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = [f.path for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._" and "source_id=" in f.path]
        return [_File(p.rsplit("source_id=", 1)[1].split("/")[0], p) for p in sorted(files)]

    def read(self, partition: _File) -> Iterator[tuple]:
        """A row for each line; a file that can't be read gives a row that says so, behind those that could."""
        fs, _ = _folder(self.path)
        try:
            with fs.open_input_stream(partition.path) as f:
                rest = b""
                while chunk := f.read(CHUNK):
                    *whole, rest = (rest + chunk).split(b"\n")
                    for line in whole:
                        yield partition.source, line.decode(), None
                if rest:
                    yield partition.source, rest.decode(), None
        except (OSError, ValueError) as e:  # ValueError: bytes that are no text
            yield partition.source, None, type(e).__name__


class FeedPayloads(DataSource):
    """Payloads below a path, in folders source_id=...: (source_id, body, error). Without a path there is nothing to read."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "source_id string, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def payloads(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FeedPayloads)
    return spark.read.format(FORMAT).load(path)


def catalog_entries(content: Column) -> Column:
    """The entries of a catalog in JSON, in order: array of (name, category, url, enabled, priority, problems); null where it is no array.

    name, category and url are needed, a URL with a scheme and a host; enabled is true or false and priority a whole number
    from 1 to 5, where they are given."""
    rows = F.try_variant_get(F.try_parse_json(content), "$", "array<variant>")

    def entry(v: Column) -> Column:
        m = F.try_variant_get(v, "$", "map<string,variant>")

        def read(o: Column) -> Column:
            text = lambda k: J.text_of(J.member(o, k))
            truth = F.schema_of_variant(J.member(o, "enabled")) == "BOOLEAN"
            number = J.number_of(J.member(o, "priority"))
            enabled, priority = F.when(truth, F.try_variant_get(J.member(o, "enabled"), "$", "boolean")), F.when(number == F.floor(number), number)
            given = lambda k: F.coalesce(F.map_contains_key(o, F.lit(k)), F.lit(False))
            bad = {
                "object": o.isNull(),
                **{k: F.coalesce(text(k), F.lit("")) == "" for k in ("name", "category")},
                "url": ~F.coalesce(text("url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+"), F.lit(False)),
                "enabled": given("enabled") & enabled.isNull(),
                "priority": given("priority") & ~F.coalesce(priority.between(1, 5), F.lit(False)),
            }
            return F.struct(text("name").alias("name"), text("category").alias("category"), text("url").alias("url"), enabled.alias("enabled"), priority.cast("int").alias("priority"), F.array_compact(F.array(*(F.when(c, k) for k, c in bad.items()))).alias("problems"))

        return X.let(m, read)

    return F.transform(rows, entry)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, name, category, url, enabled, priority) of a catalog file; a catalog of which any entry has a problem has no rows."""
    entries = spark.read.text(path, wholetext=True).select(catalog_entries(F.col("value")).alias("e"))
    sound = F.forall("e", lambda x: F.size(x["problems"]) == 0)
    rows = entries.where(sound).select(F.posexplode("e").alias("ordinal", "x"))
    return rows.select("ordinal", "x.name", "x.category", "x.url", "x.enabled", "x.priority")
