"""Schema paths against the paths found in data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from structmine.functions import patterns
from structmine.functions.paths import ADDITIONAL_KEY, PATTERN_KEY, is_wildcard
from structmine.session import parts_of, stored


def match_paths(references: DataFrame, paths: DataFrame) -> DataFrame:
    """Distinct (dataset, ref, path): data paths that a referring schema path stands for.

    Every schema path has a set of wildcard positions, and a dataset has few different sets.
    Data paths are blanked at these positions, so that wildcard paths too meet their matches by
    an equi-join; paths without wildcards are the case of the empty set.  Patterns are tested on
    the joined rows only.  Both tables are read twice; dealt by dataset alike, as the result is, they are not shuffled.
    """
    # most paths don't even hold the words; only the others are looked at element by element
    text = F.array_join("path", "/")
    wild = (text.contains(ADDITIONAL_KEY) | text.contains(PATTERN_KEY)) & F.exists("path", lambda k: is_wildcard(k))
    literal = references.where(~wild).select("dataset", "ref", "path")
    exact = literal.join(paths.select("dataset", "path"), ["dataset", "path"])

    def opened(open_paths):
        masks = open_paths.select("dataset", F.size("open").alias("size"), "open").distinct()
        blanked = (
            masks.join(paths.select("dataset", "path", F.size("path").alias("size")), ["dataset", "size"])
            .select(
                "dataset",
                "path",
                "open",
                F.transform(
                    F.arrays_zip(F.col("path").alias("k"), F.col("open").alias("o")),
                    lambda x: F.when(~x["o"], x["k"]),
                ).alias("literal"),
            )
        )
        return open_paths.join(blanked, ["dataset", "open", "literal"])

    open_paths = references.where(wild).select(
        "dataset",
        "ref",
        F.col("path").alias("schema_path"),
        F.transform("path", lambda k: is_wildcard(k)).alias("open"),
        F.transform("path", lambda k: F.when(~is_wildcard(k), k)).alias("literal"),
    )
    plain = F.forall("schema_path", lambda s: (s == ADDITIONAL_KEY) | ~s.startswith(PATTERN_KEY))
    fits = F.pandas_udf(patterns.all_fit, BooleanType())("schema_path", "path")
    # a function in Python is called for every row it stands over, so rows without a pattern go by themselves
    every = exact.select("dataset", "ref", "path")
    for met in (opened(open_paths.where(plain)), opened(open_paths.where(~plain)).where(fits)):
        every = every.unionByName(met.select("dataset", "ref", "path"))
    parts = parts_of(references)
    return stored(every.repartition(parts, "dataset").distinct(), "dataset", like=parts)


def unreadable_patterns(references: DataFrame) -> DataFrame:
    """(dataset) with a pattern that is no regular expression; every distinct pattern is tried once."""
    keys = references.select("dataset", F.explode("path").alias("key")).where(
        F.col("key").startswith(PATTERN_KEY) & (F.col("key") != ADDITIONAL_KEY)
    )
    found = keys.select("dataset", F.expr(f"substring(key, {len(PATTERN_KEY) + 1})").alias("pattern")).distinct()
    readable = F.pandas_udf(patterns.readable, BooleanType())
    bad = found.select("pattern").distinct().where(~readable("pattern"))
    return found.join(bad, "pattern", "left_semi").select("dataset").distinct()


def frequent_definitions(matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions met on more than one path, and the paths only single ones meet.

    ``matched`` has distinct rows, so plain counting is enough.
    """
    counts = matched.groupBy("dataset", "ref").agg(F.count(F.lit(1)).alias("n"))
    # a schema has no more of these than definitions
    counted = matched.join(counts.hint("shuffle_hash"), ["dataset", "ref"])
    most = counted.groupBy("dataset", "path").agg(F.max("n").alias("n"))
    return counted.where("n > 1").drop("n"), most.where("n = 1").select("dataset", "path")


def definitions_in_records(frequent: DataFrame, records: DataFrame) -> DataFrame:
    """Frequent definitions cut down to recorded paths; those with one path left are gone."""
    inside = frequent.join(records.select("dataset", "path"), ["dataset", "path"], "left_semi")
    inside = stored(inside, "dataset", like=frequent)
    kept = inside.groupBy("dataset", "ref").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return inside.join(kept.hint("shuffle_hash"), ["dataset", "ref"], "left_semi")


def definition_of_path(paths: DataFrame, truth: DataFrame) -> DataFrame:
    """Each path with the first definition (by name) that holds it, or null."""
    first = truth.groupBy("dataset", "path").agg(F.min("ref").alias("ref"))
    return paths.join(first, ["dataset", "path"], "left")
