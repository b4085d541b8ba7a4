"""Schema documents as tables: nodes, references, expansion of nested definitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structmine.functions import json_walk
from structmine.functions.json_walk import ARRAY_ITEM
from structmine.functions.paths import (
    ADDITIONAL_KEY,
    DEFINITION_KEYWORDS,
    PATTERN_KEY,
    ROOT,
    last_segment,
    without_keywords,
)
from structmine.session import configure_tables, parts_of, stored

# The JSON Schema words with a meaning of their own on the way to data paths.
LIST_KEYWORDS = ("items", "prefixItems")
COMBINATORS = ("oneOf", "anyOf", "allOf", "not", "if", "then", "else")

#: Members that decide whether a schema object describes an object.
TELLING = ("type", "properties", "additionalProperties", "patternProperties", "$ref")

MAX_SUBSTITUTIONS = 9

#: Tables of a walk's rounds that are looked up one by one before they are written together.
MAX_PARTS = 8


def schema_nodes(schemas: DataFrame) -> DataFrame:
    """(dataset, ptr, in_list, type, value, n_children): every value of every schema.

    Written once: the analyses read this table many times.  It is dealt by ``dataset`` as all tables made from it,
    so nothing about schemas is shuffled after it.
    """
    configure_tables(schemas.sparkSession)
    parts = parts_of(schemas)
    nodes = schemas.select("dataset", "schema").repartition(parts, "dataset").mapInArrow(
        json_walk.explode_values(1, False), json_walk.VALUE_SCHEMA.format(carry="dataset string")
    )
    return stored(nodes.withColumnRenamed("path", "ptr"), "dataset", like=parts, placed=True)


def local_refs(nodes: DataFrame) -> DataFrame:
    """Reference members: (dataset, ptr, in_list, ref), ``ptr`` being the referring object."""
    size = F.size("ptr")
    return nodes.where(
        (F.try_element_at("ptr", F.lit(-1)) == "$ref") & ~F.try_element_at("in_list", F.lit(-1)) & (F.col("type") == "string")
    ).select(
        "dataset",
        F.slice("ptr", 1, F.greatest(size - 1, F.lit(0))).alias("ptr"),
        F.slice("in_list", 1, F.greatest(size - 1, F.lit(0))).alias("in_list"),
        F.col("value").alias("ref"),
    )


STATE = "struct<mode:string,path:array<string>,data:boolean>"


def data_path(ptr: Column, in_list: Column, keep_pattern: bool = False) -> Column:
    """Data path of a schema pointer, null where no data corresponds to it.

    A fold over the pointer.  The state is where the walk stands: at a schema, inside
    ``properties``, ``patternProperties`` or definitions, inside a list of schemas, or lost.
    Whether a step leads to an object or a list shows in the following step.
    """

    def state(mode, path, data):
        return F.struct(F.lit(mode).alias("mode"), path.alias("path"), data.alias("data")).cast(STATE)

    def advance(s, step):
        key, position, to_list = step["key"], step["position"], step["to_list"]
        path, data, mode = s["path"], s["data"], s["mode"]
        lost = state("lost", path, data)
        item_path = F.concat(path, F.array(F.lit(ARRAY_ITEM)))
        item_data = data | (key == "items")
        at_schema = (
            F.when(key.isin(*LIST_KEYWORDS) & to_list, state("list", item_path, item_data))
            .when(key.isin(*COMBINATORS) & to_list, state("list", path, data))
            .when(to_list, lost)
            .when(key == "properties", state("properties", path, data))
            .when(key == "patternProperties", state("patterns", path, data))
            .when(
                key == "additionalProperties",
                state("schema", F.concat(path, F.array(F.lit(ADDITIONAL_KEY))), F.lit(True)),
            )
            .when(key.isin(*LIST_KEYWORDS), state("schema", item_path, item_data))
            .when(key.isin(*COMBINATORS), state("schema", path, data))
            .when(key.isin(*DEFINITION_KEYWORDS), state("definitions", F.concat(path, F.array(key)), F.lit(False)))
            .when(data | (key != "$ref"), state("schema", F.concat(path, F.array(key)), data))
            .otherwise(lost)
        )
        pattern = F.concat(F.lit(PATTERN_KEY), key) if keep_pattern else F.lit(PATTERN_KEY)
        return (
            F.when((mode == "list") & position & ~to_list, state("schema", path, data))
            .when(position | to_list & (mode != "schema"), lost)
            .when(mode == "schema", at_schema)
            .when(mode == "properties", state("schema", F.concat(path, F.array(key)), F.lit(True)))
            .when(mode == "patterns", state("schema", F.concat(path, F.array(pattern)), F.lit(True)))
            .when(mode == "definitions", state("schema", F.concat(path, F.array(key)), F.lit(False)))
            .otherwise(lost)
        )

    following = F.concat(F.slice(in_list, 2, F.greatest(F.size(in_list), F.lit(1))), F.array(F.lit(False)))
    steps = F.arrays_zip(ptr.alias("key"), in_list.alias("position"), following.alias("to_list"))
    start = state("schema", F.array(F.lit(ROOT)), F.lit(False))
    return F.aggregate(
        steps, start, advance, lambda s: F.when(s["mode"] == "schema", s["path"])
    )


def reference_paths(nodes: DataFrame, keep_pattern: bool = False) -> DataFrame:
    """Distinct (dataset, ref, path) for each local reference, with its data path."""
    refs = local_refs(nodes).where(F.col("ref").startswith("#"))
    # nulls are dropped inside the array: a filter behind it would fold every pointer a second time
    path = F.filter(F.array(data_path(F.col("ptr"), F.col("in_list"), keep_pattern)), lambda p: p.isNotNull())
    return refs.select("dataset", "ref", F.explode(path).alias("path")).distinct()


def definition_references(references: DataFrame) -> DataFrame:
    """References of the three-part shape ``#/x/Name``."""
    return references.where(F.size(F.split("ref", "/")) == 3)


def definition_steps(references: DataFrame) -> DataFrame:
    """Distinct (dataset, ref, target, rest): the definition a path starts at, null for a data path, and its tail."""
    path = F.col("path")
    nested = (F.size(path) >= 3) & F.try_element_at(path, F.lit(2)).isin(*DEFINITION_KEYWORDS)
    return references.select(
        "dataset",
        "ref",
        F.when(nested, F.concat_ws("/", F.lit("#"), F.slice(path, 2, 2))).alias("target"),
        F.when(nested, F.slice(path, 4, F.size(path))).otherwise(path).alias("rest"),
    ).distinct()


def expand_nested(references: DataFrame, limit: int = MAX_SUBSTITUTIONS) -> DataFrame:
    """Replace paths that start at a definition by the paths that reach the definition.

    Each round swaps one leading ``$ / keyword / name`` for a path of that definition.  Cyclic
    definitions unroll and end with round ``limit``; what still leads to a definition then, or
    to one never referenced, is not in the result: ``expanded_and_left`` has it, ``definition_graph.expansion_bounds`` counts it.
    """
    return expanded_and_left(references, limit)[0]


def expanded_and_left(references: DataFrame, limit: int = MAX_SUBSTITUTIONS) -> tuple[DataFrame, DataFrame]:
    """``expand_nested``, and the (dataset, ref, target, rest) that still lead to a definition after the last round.

    Those left for want of rounds have a ``target`` that references lead to; the others' is referred to by nothing.
    """
    heads = stored(definition_steps(references), "dataset")
    every = heads
    frontier = heads.where("target is not null")
    # only definitions that a path starts at are ever looked up
    steps = heads.select(
        "dataset", F.col("ref").alias("target"), F.col("target").alias("next"), F.col("rest").alias("front")
    ).join(frontier.select("dataset", "target").distinct(), ["dataset", "target"], "left_semi")
    steps = stored(steps, "dataset", like=heads)
    known = steps.select("dataset", "target").distinct()
    left = frontier.join(known, ["dataset", "target"], "left_anti")
    for _ in range(limit):
        if frontier.isEmpty():
            break
        moved = stored(
            # a schema has no more of these than references
            frontier.join(steps.hint("shuffle_hash"), ["dataset", "target"])
            .select("dataset", "ref", F.col("next").alias("target"), F.concat("front", "rest").alias("rest"))
            .distinct(),
            "dataset",
            like=heads,
        )
        every = every.unionByName(moved)
        frontier = moved.where("target is not null")
        left = left.unionByName(frontier.join(known, ["dataset", "target"], "left_anti"))
    cut = frontier.join(known, ["dataset", "target"], "left_semi")
    finished = every.where("target is null").select("dataset", "ref", F.col("rest").alias("path"))
    return finished.repartition(parts_of(heads), "dataset").distinct(), left.unionByName(cut).select("dataset", "ref", "target", "rest").distinct()


def strip_definition_keywords(references: DataFrame) -> DataFrame:
    return references.withColumn("path", without_keywords("path")).distinct()


def children(nodes: DataFrame) -> DataFrame:
    """Nodes below another one, with parent pointer and own key."""
    return nodes.where(F.size("ptr") > 0).select(
        "dataset",
        F.slice("ptr", 1, F.greatest(F.size("ptr") - 1, F.lit(0))).alias("parent"),
        F.try_element_at("ptr", F.lit(-1)).alias("key"),
        F.try_element_at("in_list", F.lit(-1)).alias("position"),
        "ptr",
        "type",
        "value",
        "n_children",
    )


def definition_roots(nodes: DataFrame) -> DataFrame:
    """(dataset, keyword): ``$defs`` when it holds something, else ``definitions``."""
    roots = nodes.where((F.size("ptr") == 1) & F.try_element_at("ptr", F.lit(1)).isin(*DEFINITION_KEYWORDS))
    filled = (F.try_element_at("ptr", F.lit(1)) == "$defs") & (F.col("n_children") > 0)
    return roots.groupBy("dataset").agg(
        F.when(F.max(filled), F.lit("$defs")).otherwise(F.lit("definitions")).alias("keyword")
    )


def _object_facts(nodes: DataFrame) -> DataFrame:
    """Per object of a schema what it says of itself, and its reference; objects that say nothing have no row."""
    member = lambda name, cond=F.lit(True): F.max((F.col("key") == name) & cond)
    telling = ~F.col("position") & F.col("key").isin(*TELLING)
    return children(nodes).where(telling).groupBy("dataset", F.col("parent").alias("ptr")).agg(
        member("type", (F.col("type") == "string") & (F.col("value") == "object")).alias("says_object"),
        member("properties").alias("has_properties"),
        member("properties", F.col("n_children") == 0).alias("no_properties"),
        member("additionalProperties").alias("has_additional"),
        member("patternProperties").alias("has_patterns"),
        F.max(F.when(F.col("key") == "$ref", F.col("value"))).alias("ref"),
    )


def object_edges(nodes: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(dataset, ptr, child): a node is an object if its child is, its reference's target or one of its branches."""
    facts = stored(_object_facts(nodes), "dataset", like=nodes) if facts is None else facts
    by_ref = (
        facts.where("ref is not null")
        .join(definition_roots(nodes), "dataset")
        .select("dataset", F.array("keyword", last_segment("ref")).alias("child"), "ptr")
    )
    # an item of a list stands two below its owner, any other value one; the word is looked at before pointers are cut
    position = F.try_element_at("in_list", F.lit(-1))
    word = F.when(position, F.try_element_at("ptr", F.lit(-2))).otherwise(F.try_element_at("ptr", F.lit(-1)))
    above = F.size("ptr") - F.when(position, 2).otherwise(1)
    by_branch = (
        nodes.where("type = 'object' and size(ptr) > 1")
        .where(word.isin("oneOf", "anyOf", "allOf"))
        .select("dataset", F.col("ptr").alias("child"), F.slice("ptr", 1, F.greatest(above, F.lit(0))).alias("ptr"))
        .join(facts.where("ref is not null").select("dataset", "ptr"), ["dataset", "ptr"], "left_anti")
        .select("dataset", "child", "ptr")
    )
    return by_ref.unionByName(by_branch).repartition(parts_of(nodes), "dataset").distinct()


def named_definitions(nodes: DataFrame) -> DataFrame:
    """(dataset, ptr, name) of the definitions of each schema."""
    return (
        nodes.where("size(ptr) = 2")
        .join(definition_roots(nodes), "dataset")
        .where(F.try_element_at("ptr", F.lit(1)) == F.col("keyword"))
        .select("dataset", "ptr", F.try_element_at("ptr", F.lit(2)).alias("name"))
    )


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def object_like_definitions(
    nodes: DataFrame, facts: DataFrame | None = None, edges: DataFrame | None = None
) -> DataFrame:
    """(dataset, name) of definitions that describe an object with properties.

    A node counts when it says so itself, or when its reference or one of its
    ``oneOf/anyOf/allOf`` branches does.  The answer spreads from the plain nodes along these
    edges, one join per round, until nothing new is reached; cycles add nothing.
    """
    facts = stored(_object_facts(nodes), "dataset", like=nodes) if facts is None else facts
    plain = facts.where(
        "ref is null and says_object and (has_properties or has_additional or has_patterns) and not no_properties"
    ).select("dataset", "ptr")
    edges = stored(object_edges(nodes, facts), "dataset", like=nodes) if edges is None else edges
    frontier = stored(plain, "dataset", like=nodes)
    reached = [frontier]
    while not frontier.isEmpty():
        # a schema has no more of these than objects
        found = frontier.withColumnRenamed("ptr", "child").join(edges.hint("shuffle_hash"), ["dataset", "child"])
        found = found.select("dataset", "ptr").distinct()
        if len(reached) > MAX_PARTS:
            reached = [stored(_together(reached), "dataset", like=nodes)]
        for part in reached:
            found = found.join(part.hint("shuffle_hash"), ["dataset", "ptr"], "left_anti")
        frontier = stored(found, "dataset", like=nodes)
        reached.append(frontier)
    return (
        _together(reached)
        .where("size(ptr) = 2")
        .join(definition_roots(nodes), "dataset")
        .where(F.try_element_at("ptr", F.lit(1)) == F.col("keyword"))
        .select("dataset", F.try_element_at("ptr", F.lit(2)).alias("name"))
    )


def object_references(references: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References to object-like definitions, and the (dataset, path) of all the others."""
    names = stored(object_like_definitions(nodes), "dataset", like=nodes)
    named = stored(references.withColumn("name", last_segment("ref")), "dataset", like=nodes)
    kept = named.join(names, ["dataset", "name"], "left_semi").drop("name")
    dropped = named.join(names, ["dataset", "name"], "left_anti").select("dataset", "path").distinct()
    return kept, dropped


def dereference(nodes: DataFrame, max_depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """Schemas with every local reference replaced by its target.

    Returns the resolved nodes (dataset, ptr, type, value) and (dataset, status), status being
    ``ok``, ``max_depth`` or ``dangling``.  Every step down and every replacement counts as one
    level; a schema that needs more than ``max_depth`` has no nodes in the result.
    """
    below = children(nodes)
    refs = (
        below.where("key = '$ref' and not position and type = 'string'")
        .select("dataset", F.col("parent").alias("src"), F.col("value").alias("ref"))
        .where(F.col("ref").startswith("#/$defs/") | F.col("ref").startswith("#/definitions/"))
        .select(
            "dataset", "src", F.array(F.split("ref", "/")[1], last_segment("ref")).alias("target")
        )
    )
    known = nodes.where("size(ptr) = 2").select("dataset", F.col("ptr").alias("target"), F.lit(True).alias("found"))
    refs = stored(refs.join(known, ["dataset", "target"], "left"), "dataset", like=nodes)
    downs = stored(
        below.select("dataset", F.col("parent").alias("src"), "key", F.col("ptr").alias("child")), "dataset", like=nodes
    )
    facts = nodes.select("dataset", F.col("ptr").alias("src"), "type", "value")
    frontier = stored(nodes.where("size(ptr) = 0").select("dataset", "ptr", F.col("ptr").alias("src")), "dataset", like=nodes)
    seen = [frontier]
    dangling = []
    for _ in range(max_depth + 1):
        if frontier.isEmpty():
            break
        at_refs = frontier.join(refs, ["dataset", "src"])
        dangling.append(at_refs.where("found is null").select("dataset"))
        jumps = at_refs.where("found").select("dataset", "ptr", F.col("target").alias("src"))
        steps = (
            frontier.join(refs, ["dataset", "src"], "left_anti")
            .join(downs, ["dataset", "src"])
            .select("dataset", F.concat("ptr", F.array("key")).alias("ptr"), F.col("child").alias("src"))
        )
        frontier = stored(jumps.unionByName(steps), "dataset", like=nodes)
        seen.append(frontier)
    too_deep = seen.pop().select("dataset") if len(seen) > max_depth + 1 else frontier.select("dataset")
    marks = too_deep.select("dataset", F.lit("max_depth").alias("status"))
    for part in dangling:
        marks = marks.unionByName(part.select("dataset", F.lit("dangling").alias("status")))
    marks = marks.groupBy("dataset").agg(F.min("status").alias("status"))
    status = (
        nodes.where("size(ptr) = 0")
        .select("dataset")
        .join(marks, "dataset", "left")
        .select("dataset", F.coalesce("status", F.lit("ok")).alias("status"))
    )
    walked = seen[0]
    for part in seen[1:]:
        walked = walked.unionByName(part)
    resolved = (
        walked.join(refs, ["dataset", "src"], "left_anti")
        .join(facts, ["dataset", "src"])
        .join(marks, "dataset", "left_anti")
        .select("dataset", "ptr", "type", "value")
    )
    return resolved, status
