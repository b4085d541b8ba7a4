"""Recursive definitions and how deep they go in data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structmine.functions.paths import DEFINITION_KEYWORDS, last_segment
from structmine.operators.schema_graph import local_refs
from structmine.session import broadcast_if_small, cut_lineage

# The words dropped from a usage path.
USAGE_KEYWORDS = (
    "definitions", "$defs", "properties", "allOf", "oneOf", "anyOf", "not", "if", "then", "else",
)


def starred_refs(nodes: DataFrame) -> DataFrame:
    """(dataset, ref, ptr) of every reference, ``items`` and list positions written ``*``."""
    zipped = F.arrays_zip(F.col("ptr").alias("k"), F.col("in_list").alias("p"))
    starred = F.transform(zipped, lambda x: F.when(x["p"] | (x["k"] == "items"), F.lit("*")).otherwise(x["k"]))
    return local_refs(nodes).select("dataset", "ref", starred.alias("ptr"))


def recursive_references(nodes: DataFrame) -> DataFrame:
    """(dataset, ref): references inside a definition that lead back to a name on their way."""
    inside = F.try_element_at("ptr", F.lit(1)).isin(*DEFINITION_KEYWORDS)
    return (
        starred_refs(nodes)
        .where(inside & F.array_contains("ptr", last_segment("ref")))
        .select("dataset", "ref")
        .distinct()
    )


def usage_paths(nodes: DataFrame, refs: DataFrame, strip_definition_names: bool = False) -> DataFrame:
    """Distinct (dataset, ref, ref_path): where the given references are used, keywords dropped.

    Definition names stay in the path unless ``strip_definition_names`` drops them too.
    """
    used = starred_refs(nodes).join(refs, ["dataset", "ref"], "left_semi")
    ptr = F.col("ptr")
    if strip_definition_names:
        inside = F.try_element_at("ptr", F.lit(1)).isin(*DEFINITION_KEYWORDS)
        ptr = F.when(inside, F.slice("ptr", 3, F.greatest(F.size("ptr") - 2, F.lit(0)))).otherwise(ptr)
    return used.select(
        "dataset", "ref", F.filter(ptr, lambda k: ~k.isin(*USAGE_KEYWORDS)).alias("ref_path")
    ).distinct()


def recursion_depth(usages: DataFrame, containers: DataFrame) -> DataFrame:
    """(dataset, ref, ref_path, max_depth): most repetitions of a usage path in one data path.

    Repetitions may overlap; a usage path that is nowhere in its dataset has depth 0, an empty one fits once
    more often than the longest path has elements.  ``containers`` has distinct paths.  Every path is opened
    into its windows of the lengths that usages of its dataset have, so a usage meets its repetitions by
    equality, whatever its elements, and only windows that are some usage go on.
    """
    key = ["dataset", "ref", "ref_path"]
    asked = cut_lineage(usages.select(*key).distinct())
    wanted = asked.select("dataset", "ref_path").distinct()
    lengths = wanted.groupBy("dataset").agg(F.collect_set(F.size("ref_path")).alias("lengths"))
    n = F.size("path")
    starts = lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.struct(i.alias("i"), m.alias("m")))
    windows = F.flatten(F.transform(F.filter("lengths", lambda m: m <= n), starts))
    opened = (
        containers.join(broadcast_if_small(lengths), "dataset")
        .select("dataset", "path", F.explode(windows).alias("w"))
        .select("dataset", "path", F.expr("slice(path, w.i, w.m)").alias("ref_path"))
    )
    met = opened.join(broadcast_if_small(wanted), ["dataset", "ref_path"])
    repeated = met.groupBy("dataset", "ref_path", "path").agg(F.count(F.lit(1)).cast("int").alias("n"))
    depths = repeated.groupBy("dataset", "ref_path").agg(F.max("n").alias("max_depth"))
    known = asked.join(containers.select("dataset").distinct(), "dataset", "left_semi")
    found = known.join(depths, ["dataset", "ref_path"], "left")
    return found.select(*key, F.coalesce("max_depth", F.lit(0)).alias("max_depth"))
