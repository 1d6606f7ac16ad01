"""JSON of any shape by VARIANT: typed access with defaults, shallow merges, and strict reading of expected objects.

Broken JSON is null, and so is what isn't of the kind that is asked for; nothing raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import let, plain_text

EDGES = r"(?U)^[\s﻿]+|[\s﻿]+$"


def _is(v: Column, *kinds: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(f"^({'|'.join(kinds)})"), F.lit(False))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def json_object(c: Column) -> Column:
    """The members of a JSON object as a map to variants; null for anything else."""
    return F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>")


def json_items(v: Column) -> Column:
    """The entries of a variant that is an array, else none."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def member(obj: Column, key: str) -> Column:
    return F.try_element_at(obj, F.lit(key))


def text_of(v: Column) -> Column:
    """A variant that is a string; null for others, numbers too."""
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def number_of(v: Column) -> Column:
    """A variant that is a finite number; null for others, digits in a string too."""
    n = F.try_variant_get(v, "$", "double")
    return F.when(_is(v, "BIGINT", "DECIMAL", "DOUBLE") & (F.abs(n) < float("inf")), n)


def json_string(obj: Column, key: str) -> Column:
    return F.coalesce(trimmed(text_of(member(obj, key))), F.lit(""))


def json_number(obj: Column, key: str) -> Column:
    return F.coalesce(number_of(member(obj, key)), F.lit(0.0))


def json_strings(obj: Column, key: str) -> Column:
    """The strings among the entries of an array."""
    return F.array_compact(F.transform(json_items(member(obj, key)), text_of))


def merged(older: Column, newer: Column) -> Column:
    """The members of two objects, of equal names those of the newer; an object that is null has none."""
    none = F.create_map().cast("map<string,variant>")
    a, b = F.coalesce(older, none), F.coalesce(newer, none)
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.map_concat(F.map_filter(s["a"], lambda k, _: ~F.map_contains_key(s["b"], k)), s["b"]))


def said(v: Column) -> Column:
    """A string's plain text; null where it is none, or nothing but space."""
    return let(F.coalesce(text_of(v), F.lit("")), lambda t: F.when(trimmed(t) != "", F.nullif(trimmed(plain_text(t)), F.lit(""))))


def place_of(v: Column, count: Column) -> Column:
    """A whole number from 0 below count, else null."""
    return let(number_of(v), lambda n: F.when((n == F.floor(n)) & (n >= 0) & (n < count), n.cast("int")))


#: Places that a brief may name, lines that it may have, and words of a list in a preview.
SHOWN, LINES, LIST = 10, 5, 8


def brief(content: Column, articles: Column) -> Column:
    """struct(summary, highlights of (articleIndex, whyItMatters)) of an answer, null unless it has a summary and a line that stands.

    A line stands if its index is that of an article, none before it has the same, and it says something."""
    count = F.least(articles, F.lit(SHOWN))

    def lines(obj: Column) -> Column:
        rows = F.transform(json_items(member(obj, "highlights")), lambda v: F.try_variant_get(v, "$", "map<string,variant>"))
        read = F.transform(rows, lambda m: F.struct(place_of(member(m, "articleIndex"), count).alias("articleIndex"), said(member(m, "whyItMatters")).alias("whyItMatters")))
        valid = F.filter(read, lambda x: x["articleIndex"].isNotNull() & x["whyItMatters"].isNotNull())
        return let(valid, lambda v: F.slice(F.filter(v, lambda x, i: F.array_position(F.transform(v, lambda y: y["articleIndex"]), x["articleIndex"]) == i + 1), 1, LINES))

    def read(obj: Column) -> Column:
        parts = F.struct(said(member(obj, "summary")).alias("summary"), lines(obj).alias("highlights"))
        return let(parts, lambda p: F.when(p["summary"].isNotNull() & (F.size(p["highlights"]) > 0), p))

    return let(json_object(trimmed(content)), read)


def preview(content: Column) -> Column:
    """struct(clickIf, entities, practicalBucket, topics, whatHappened, whyItMatters) of an answer, null unless all four texts are there."""
    words = lambda obj, key: F.slice(F.array_distinct(F.array_compact(F.transform(json_items(member(obj, key)), said))), 1, LIST)

    def read(obj: Column) -> Column:
        texts = {k: said(member(obj, k)).alias(k) for k in ("clickIf", "practicalBucket", "whatHappened", "whyItMatters")}
        s = F.struct(texts["clickIf"], words(obj, "entities").alias("entities"), texts["practicalBucket"], words(obj, "topics").alias("topics"), texts["whatHappened"], texts["whyItMatters"])
        return let(s, lambda x: F.when(x["clickIf"].isNotNull() & x["practicalBucket"].isNotNull() & x["whatHappened"].isNotNull() & x["whyItMatters"].isNotNull(), x))

    return let(json_object(trimmed(content)), read)
