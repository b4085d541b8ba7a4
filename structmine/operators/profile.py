"""Path profile and per-path records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structmine.functions.json_walk import ARRAY_ITEM
from structmine.functions.paths import type_names


def path_profile(counts: DataFrame) -> DataFrame:
    """(dataset, path, key, frequency, type_mask, types) for the members of every object path."""
    return counts.where((F.col("key") != ARRAY_ITEM) & (F.size("path") > 0)).select(
        "dataset",
        "path",
        "key",
        F.col("n").alias("frequency"),
        "type_mask",
        type_names("type_mask").alias("types"),
    )


def path_totals(profile: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(dataset, path, parent_frequency).

    The total counts key occurrences; with ``counts`` it counts the objects at the path instead.
    """
    totals = profile.groupBy("dataset", "path").agg(F.sum("frequency").alias("parent_frequency"))
    if counts is None:
        return totals
    objects = counts.where("objects > 0").select("dataset", F.concat("path", F.array("key")).alias("path"), "objects")
    return totals.join(objects, ["dataset", "path"]).select(
        "dataset", "path", F.col("objects").alias("parent_frequency")
    )


def infrequent_paths(totals: DataFrame) -> DataFrame:
    """Paths whose total is one; they leave the analysis."""
    return totals.where("parent_frequency <= 1").select("dataset", "path")


def frequent_paths(totals: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    kept = totals.where("parent_frequency > 1")
    return kept if excluded is None else kept.join(excluded, ["dataset", "path"], "left_anti")


def path_properties(profile: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per property of a kept path, with its share and whether it is required."""
    joined = profile.join(totals, ["dataset", "path"])
    share = F.col("frequency") / F.col("parent_frequency")
    return joined.select(
        "dataset",
        "path",
        "key",
        "frequency",
        share.alias("relative_frequency"),
        F.bround(share, 3).alias("relative_frequency_rounded"),
        "type_mask",
        "types",
        (F.col("frequency") == F.col("parent_frequency")).alias("required"),
        "parent_frequency",
    )


def path_summary(properties: DataFrame) -> DataFrame:
    """One row per path with its derived features.

    Every feature is a decomposable aggregate: -sum(p ln p) is ln T - sum(f ln f) / T, one
    shared type set means the smallest mask equals the largest, and a key is optional when the
    smallest frequency is below the total.  So a path with any number of keys is combined
    before the shuffle and never gathered.
    """
    f = F.col("frequency").cast("double")
    flat = properties.groupBy("dataset", "path").agg(
        F.count(F.lit(1)).alias("num_nested_keys"),
        F.sum(f).alias("occurrences"),
        F.sum(f * F.log(f)).alias("f_ln_f"),
        F.max("parent_frequency").alias("parent_frequency"),
        F.min("required").alias("all_required"),
        F.min("type_mask").alias("low_mask"),
        F.max("type_mask").alias("high_mask"),
        *fingerprint_aggregates(),
    )
    entropy = F.when(F.col("num_nested_keys") == 1, F.lit(0.0)).otherwise(
        F.log("occurrences") - F.col("f_ln_f") / F.col("occurrences")
    )
    return flat.select(
        "dataset",
        "path",
        (F.size("path") - 1).alias("nesting_depth"),
        F.when(F.col("low_mask") == F.col("high_mask"), 0).otherwise(1).alias("datatype_entropy"),
        "num_nested_keys",
        "parent_frequency",
        (~F.col("all_required")).alias("additional_properties"),
        entropy.alias("key_entropy_raw"),
        F.bround(entropy, 2).alias("key_entropy"),
        F.struct("num_nested_keys", "parent_frequency", F.size("path").alias("depth"), "sum1", "sum2").alias(
            "fingerprint"
        ),
    )


def fingerprint_aggregates():
    """Order-free 2 x 64 bit sums over (key, share, types): equal for equal property lists."""
    wide = "decimal(38,0)"
    cells = ("key", "relative_frequency_rounded", "type_mask")
    return (
        F.sum(F.xxhash64(F.lit("a"), *cells).cast(wide)).alias("sum1"),
        F.sum(F.xxhash64(F.lit("b"), *cells).cast(wide)).alias("sum2"),
    )


def schema_text(properties: DataFrame, summary: DataFrame) -> DataFrame:
    """(dataset, path, schema): the record as JSON text, for sinks that need one cell per path."""
    listed = properties.groupBy("dataset", "path").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "key",
                    F.struct(F.col("relative_frequency_rounded").alias("frequency"), F.col("types").alias("type")).alias("entry"),
                    "required",
                )
            )
        ).alias("listed")
    )
    similarity = [F.col("semantic_similarity")] if "semantic_similarity" in summary.columns else []
    body = F.struct(
        F.col("additional_properties").alias("additionalProperties"),
        "datatype_entropy",
        "key_entropy",
        "nesting_depth",
        "num_nested_keys",
        "parent_frequency",
        F.map_from_entries(F.transform("listed", lambda p: F.struct(p["key"], p["entry"]))).alias("properties"),
        F.transform(F.filter("listed", lambda p: p["required"]), lambda p: p["key"]).alias("required"),
        *similarity,
    )
    return summary.join(listed, ["dataset", "path"]).select("dataset", "path", F.to_json(body).alias("schema"))
