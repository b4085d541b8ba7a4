"""From JSON lines to documents and path counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structmine.functions import json_walk
from structmine.functions.paths import ROOT, star_items
from structmine.session import PART_ROWS, broadcast_if_small, configure_tables, stored


def with_declared_keys(lines: DataFrame, schemas: DataFrame | None) -> DataFrame:
    """Lines that can still match their schema, as (dataset, line, keys).

    ``schemas`` holds (dataset, schema).  A line holding an object is decided here, on the JVM,
    by its root keys; ``keys`` is then null.  Lines that need a look at their items (arrays)
    carry the declared keys along.  Without ``schemas`` every document counts.
    """
    if schemas is None:
        return lines.select("dataset", "line", F.lit(None).cast("array<string>").alias("keys"))
    declared = schemas.select(
        "dataset",
        F.coalesce(
            F.json_object_keys(F.get_json_object("schema", "$.properties")),
            F.array().cast("array<string>"),
        ).alias("declared"),
    )
    # a row of its own, so that each line is parsed once, not for every mention of its keys
    roots = F.inline(F.array(F.struct(F.json_object_keys("line").alias("roots"))))
    return (
        lines.join(broadcast_if_small(declared), "dataset")
        .select("dataset", "line", "declared", roots)
        .where(
            F.col("roots").isNull()
            | (F.size("declared") == 0)
            | F.arrays_overlap("roots", "declared")
        )
        .select("dataset", "line", F.when(F.col("roots").isNull(), F.col("declared")).alias("keys"))
    )


def _with_keys_text(lines: DataFrame, schemas: DataFrame | None) -> DataFrame:
    return with_declared_keys(lines, schemas).withColumn("keys", F.to_json("keys"))


def documents(lines: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """(dataset, doc): objects that match their schema, arrays of objects taken apart."""
    configure_tables(lines.sparkSession)
    return _with_keys_text(lines, schemas).mapInArrow(
        json_walk.unnest_documents, "dataset string, doc string"
    )


def path_counts(
    lines: DataFrame, schemas: DataFrame | None = None, unnest: bool = True
) -> DataFrame:
    """(dataset, path, key, n, type_mask, objects) over all values inside the documents.

    The documents themselves are counted as key ``$`` of the empty path.

    One pass over the text.  The lines of a dataset are brought together first, so a corpus of many
    small datasets is added up where it is read; a dataset too large for a task is split over several
    and its sums meet in the aggregate.  What follows carries distinct members, not values.
    With ``unnest`` off, arrays at the root stay arrays.
    """
    return _added_up(_partial_counts(lines, schemas, unnest))


def _partial_counts(lines: DataFrame, schemas: DataFrame | None, unnest: bool) -> DataFrame:
    configure_tables(lines.sparkSession)
    together = _with_keys_text(lines, schemas).hint("rebalance", "dataset")
    return together.mapInArrow(json_walk.count_paths(ROOT, unnest), json_walk.PathCounts.SCHEMA)


def _added_up(partial: DataFrame) -> DataFrame:
    return partial.groupBy("dataset", "path", "key").agg(
        F.sum("n").alias("n"), F.bit_or("type_mask").alias("type_mask"), F.sum("objects").alias("objects")
    )


def stored_counts(lines: DataFrame, schemas: DataFrame | None = None, unnest: bool = True) -> DataFrame:
    """``path_counts`` as a table dealt by (dataset, path), so what follows groups and joins paths where they are.

    The partial counts are written first: their number says over how many partitions the sums are dealt.
    """
    partial = stored(_partial_counts(lines, schemas, unnest))
    parts = 1 + partial.count() // PART_ROWS
    return stored(_added_up(partial.repartition(parts, "dataset", "path")), "dataset", "path", like=parts)


def explode_paths(docs: DataFrame, text: str = "doc") -> DataFrame:
    """One row per value inside each document: carried columns, path, type, value."""
    configure_tables(docs.sparkSession)
    carry = [c for c in docs.columns if c != text]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    out = docs.select(*carry, text).mapInArrow(
        json_walk.explode_values(len(carry), True), json_walk.VALUE_SCHEMA.format(carry=fields)
    )
    return out.where(F.size("path") > 0).select(
        *carry, F.concat(F.array(F.lit(ROOT)), "path").alias("path"), "type", "value"
    )


def container_paths(lines: DataFrame) -> DataFrame:
    """Distinct (dataset, path) of objects and arrays, without root, ``*`` for list positions.

    A walk of its own: nothing is counted and scalars are passed over, so only containers leave a task.
    """
    configure_tables(lines.sparkSession)
    together = lines.select("dataset", "line").hint("rebalance", "dataset")
    found = together.mapInArrow(json_walk.find_containers, json_walk.Containers.SCHEMA)
    return found.distinct().select("dataset", star_items(F.concat(F.array(F.lit(ROOT)), "path")).alias("path"))
