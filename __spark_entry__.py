"""Queries over the given tables, one per operator, and their DuckDB counterparts."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import composed
import oracle
from structmine.functions import sequences
from structmine.functions.paths import dotted
from structmine.operators import (
    candidates,
    classify,
    clusters,
    definition_graph,
    definition_walk,
    documents,
    features,
    matching,
    pairing,
    profile,
    recursion,
    sampling,
    schema_graph,
)
from structmine.plans import mining
from structmine.session import configure_tables, cut_lineage, parts_of, shared_folder, spread, stored
from structmine.sources import corpus, results

SMALLEST = "/root/testdata/sf0.001"

_shared: dict[tuple, object] = {}


def _once(spark: SparkSession, folder: str, name: str, make: Callable[[], object]):
    """Stages many queries start from are computed once per session and folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _lines(spark, folder):
    # every query reads them once, so they are not written in between: no table is larger
    return composed.lines(configure_tables(spark), folder)


def _schemas(spark, folder):
    return _once(spark, folder, "schemas", lambda: spread(composed.schemas(configure_tables(spark), folder), "schema", "dataset"))


def _loaded(spark, folder):
    def make():
        dealt = _schemas(spark, folder)
        return stored(corpus.split_loaded(dealt)[0], "dataset", like=dealt, placed=True)

    return _once(spark, folder, "loaded", make)


def _nodes(spark, folder):
    return _once(spark, folder, "nodes", lambda: schema_graph.schema_nodes(_loaded(spark, folder)))


def _counts(spark, folder):
    return _once(spark, folder, "counts", lambda: documents.stored_counts(_lines(spark, folder)))


def _profile(spark, folder):
    return profile.path_profile(_counts(spark, folder))


def _expanded(spark, folder):
    def make():
        found = schema_graph.definition_references(schema_graph.reference_paths(_nodes(spark, folder)))
        return stored(schema_graph.strip_definition_keywords(schema_graph.expand_nested(found)), "dataset", like=_nodes(spark, folder))

    return _once(spark, folder, "expanded", make)


def _mined(spark, folder):
    return _once(spark, folder, "mined", lambda: mining.mine(_lines(spark, folder), _schemas(spark, folder)))


def _evaluated(spark, folder):
    return _once(spark, folder, "evaluated", lambda: mining.evaluate(_mined(spark, folder)))


def _training(spark, folder):
    return _once(spark, folder, "training", lambda: mining.training_data(_mined(spark, folder)))


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    """Paths as dotted text."""
    return df.withColumns({c: dotted(c) for c in columns})


# -- documents and profile ---------------------------------------------------------------------


def path_profile(spark, folder):
    configure_tables(spark)
    found = profile.path_profile(documents.path_counts(composed.lines(spark, folder)))
    return _shown(found, "path").select("dataset", "path", "key", "frequency", F.array_join("types", ",").alias("types"))


def _summary_columns(summary):
    return _shown(summary, "path").select(
        "dataset", "path", "nesting_depth", "datatype_entropy", "num_nested_keys", "parent_frequency",
        "additional_properties", F.round("key_entropy_raw", 6).alias("key_entropy"),
    )


def path_summary(spark, folder):
    found = _profile(spark, folder)
    return _summary_columns(profile.path_summary(profile.path_properties(found, profile.path_totals(found))))


def frequent_paths(spark, folder):
    return _shown(profile.frequent_paths(profile.path_totals(_profile(spark, folder))), "path")


def object_counts(spark, folder):
    counts, found = _counts(spark, folder), _profile(spark, folder)
    by_key = profile.path_totals(found)
    by_object = profile.path_totals(found, counts).withColumnRenamed("parent_frequency", "objects")
    return _shown(by_key.join(by_object, ["dataset", "path"]), "path")


def _ids(docs):
    key = F.get_json_object("doc", "$.id").cast("long").alias("id")
    return docs.select("dataset", key).groupBy("dataset", "id").agg(F.count(F.lit(1)).alias("n"))


def document_unnest(spark, folder):
    return _ids(documents.documents(_lines(spark, folder)))


def document_match(spark, folder):
    return _ids(documents.documents(_lines(spark, folder), _loaded(spark, folder)))


def rejected_lines(spark, folder):
    return corpus.with_kind(_lines(spark, folder), "line").groupBy("dataset").agg(
        F.count_if(F.col("json_kind").isNull()).alias("rejected"), F.count(F.lit(1)).alias("total")
    )


def clean_lines(spark, folder):
    return corpus.clean_documents(_lines(spark, folder)).groupBy("dataset", "line").agg(F.count(F.lit(1)).alias("n"))


def type_mix(spark, folder):
    events = _table(spark, folder, "events").select("event_type", F.col("props").alias("doc"))
    return _shown(documents.explode_paths(events), "path").groupBy("event_type", "path", "type").agg(F.count(F.lit(1)).alias("n"))


def container_paths(spark, folder):
    return _shown(documents.container_paths(_lines(spark, folder)), "path")


# -- schemas -------------------------------------------------------------------------------------


def draft_counts(spark, folder):
    return _loaded(spark, folder).groupBy(corpus.draft_of().alias("draft")).agg(F.count(F.lit(1)).alias("n"))


def schema_nodes(spark, folder):
    return _nodes(spark, folder).groupBy("dataset", "type").agg(F.count(F.lit(1)).alias("n"))


def corpus_validation(spark, folder):
    return corpus.validate(_schemas(spark, folder), composed.file_sizes(spark, folder))


def validation_funnel(spark, folder):
    return corpus.funnel(corpus_validation(spark, folder), corpus.VALIDATION_STATUSES)


def reference_paths(spark, folder):
    return _shown(schema_graph.reference_paths(_nodes(spark, folder)), "path")


def definition_paths(spark, folder):
    return _shown(_expanded(spark, folder), "path")


def _definition_references(spark, folder):
    def make():
        found = schema_graph.definition_references(schema_graph.reference_paths(_nodes(spark, folder)))
        return stored(found, "dataset", like=_nodes(spark, folder))

    return _once(spark, folder, "definition references", make)


def expansion_bounds(spark, folder):
    return definition_graph.expansion_bounds(_definition_references(spark, folder))


def expansion_left(spark, folder):
    """Nested references that three substitutions leave unresolved, by the definition they still lead to."""
    left = schema_graph.expanded_and_left(_definition_references(spark, folder), limit=3)[1]
    return _shown(left, "rest").select("dataset", "ref", "target", "rest")


def definition_cycles(spark, folder):
    return definition_graph.definition_cycles(_definition_references(spark, folder))


def definition_flags(spark, folder):
    return definition_graph.definition_flags(_nodes(spark, folder))


def object_definitions(spark, folder):
    references, nodes = _expanded(spark, folder), _nodes(spark, folder)
    kept, _ = schema_graph.object_references(references, nodes)
    flagged = kept.select("dataset", "ref").distinct().withColumn("object_like", F.lit(1))
    return (
        references.select("dataset", "ref")
        .distinct()
        .join(flagged, ["dataset", "ref"], "left")
        .select("dataset", "ref", F.coalesce("object_like", F.lit(0)).alias("object_like"))
    )


def dereference_status(spark, folder):
    return schema_graph.dereference(_nodes(spark, folder))[1]


def matched_paths(spark, folder):
    def make():
        kept, dropped = schema_graph.object_references(_expanded(spark, folder), _nodes(spark, folder))
        parts = parts_of(_nodes(spark, folder))
        kept = stored(kept, "dataset", like=parts)
        known = _loaded(spark, folder).join(kept.select("dataset").distinct(), "dataset", "left_semi")
        found = profile.path_profile(documents.stored_counts(_lines(spark, folder), known))
        totals = profile.path_totals(found).repartition(parts, "dataset")
        return matching.match_paths(kept, stored(profile.frequent_paths(totals, dropped), "dataset", like=parts))

    return _shown(_once(spark, folder, "matched", make), "path")


def ref_attribution(spark, folder):
    paths = _profile(spark, folder).select("dataset", "path").distinct()
    known = _loaded(spark, folder).select("dataset")
    found = definition_walk.attribute_paths(_nodes(spark, folder), paths.join(known, "dataset", "left_semi"))
    return _shown(paths.join(found, ["dataset", "path"], "left"), "path")


def recursive_references(spark, folder):
    return recursion.recursive_references(_nodes(spark, folder))


def recursion_depth(spark, folder):
    nodes = _nodes(spark, folder)
    usages = recursion.usage_paths(nodes, recursion.recursive_references(nodes), strip_definition_names=True)
    return _shown(recursion.recursion_depth(usages, documents.container_paths(_lines(spark, folder))), "ref_path")


# -- the mined corpus ----------------------------------------------------------------------------


def dataset_status(spark, folder):
    return _mined(spark, folder).status


def processing_funnel(spark, folder):
    return corpus.funnel(_mined(spark, folder).status)


def ground_truth(spark, folder):
    return _shown(_mined(spark, folder).truth, "path")


def truth_round_trip(spark, folder):
    return _shown(results.parse_ground_truth(results.ground_truth_lines(_mined(spark, folder).truth)), "path")


def path_records(spark, folder):
    return _summary_columns(_mined(spark, folder).summary)


def path_definition(spark, folder):
    mined = _mined(spark, folder)
    return _shown(matching.definition_of_path(mined.summary.select("dataset", "path"), mined.truth), "path")


def candidate_pairs(spark, folder):
    found = candidates.candidate_pairs(_mined(spark, folder).properties)
    return _shown(found.withColumn("jaccard", F.round("jaccard", 6)), "path1", "path2")


def pair_averages(spark, folder):
    names = ["datatype_entropy", "parent_frequency", "num_nested_keys"]
    ends = features.enrich_pairs(
        _evaluated(spark, folder).candidates.select("dataset", "path1", "path2"), _mined(spark, folder).summary, names
    )
    averaged = features.pair_averages(ends, names)
    return _shown(averaged, "path1", "path2").select("dataset", "path1", "path2", *[f"avg_{n}" for n in names])


def found_clusters(spark, folder):
    links = candidates.candidate_links(_mined(spark, folder).properties)
    return _shown(clusters.connected_components(links), "cluster_id", "path")


def cluster_pair_counts(spark, folder):
    return clusters.pair_counts(_mined(spark, folder).truth, ["dataset"], "ref")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


def cluster_scores(spark, folder):
    return _rounded(_evaluated(spark, folder).scores, "precision", "recall", "f1_score")


def corpus_average(spark, folder):
    return _rounded(_evaluated(spark, folder).average, "average_precision", "average_recall", "average_f1_score")


def evaluation_rows(spark, folder):
    return results.evaluation_rows(cluster_scores(spark, folder), corpus_average(spark, folder))


def evaluation_clusters(spark, folder):
    """The clusters behind the scores, from the files they are written to."""
    out = shared_folder(spark, "evaluation-clusters")
    done = _evaluated(spark, folder)
    results.write_evaluation_clusters(_mined(spark, folder).truth, done.clusters, done.scores, out)
    found = results.read_evaluation_clusters(spark, out)
    smallest = F.array_join(F.from_json("cluster", "array<string>"), ".")
    named = F.when(F.col("kind") == "predicted", smallest).otherwise(F.col("cluster"))
    return _shown(found.withColumn("cluster", named), "path")


def clean_schemas(spark, folder):
    """Schemas of valid datasets, from the files they are written to."""
    out = shared_folder(spark, "clean-schemas")
    corpus.write_schemas(_schemas(spark, folder), corpus_validation(spark, folder), out)
    return corpus.read_clean(spark, out, "schema").select("dataset", "schema")


def matched_files(spark, folder):
    """Matching documents of every third dataset, from the files they are written to."""
    out = shared_folder(spark, "matched-documents")
    third = F.regexp_extract("dataset", r"-(\d+)", 1).cast("long") % 3 == 0
    split = _loaded(spark, folder).select("dataset", F.when(third, "test").otherwise("train").alias("split"))
    corpus.write_matched_documents(_lines(spark, folder), _loaded(spark, folder), split, out)
    return _ids(corpus.read_clean(spark, out, "doc"))


def pair_files(spark, folder):
    """Positive pairs with a text of both records, from the CSV files they are written to."""
    out = shared_folder(spark, "pairs")
    text = F.to_json(F.struct("nesting_depth", "num_nested_keys", "parent_frequency")).alias("schema")
    pairs = _training(spark, folder).pairs.where("label = 1").select("dataset", "label", "path1", "path2")
    results.write_pairs(pairs, _mined(spark, folder).summary.select("dataset", "path", text), out)
    return _shown(results.read_pairs(spark, out), "path1", "path2")


def global_schema(spark, folder):
    pairs = _evaluated(spark, folder).candidates.withColumnRenamed("dataset", "filename")
    fingerprint = F.lit("record")
    placed = results.assemble_schemas(pairs.withColumns({"schema1": fingerprint, "schema2": fingerprint}))
    return placed.where("pointer <> '#'").select("filename", "pointer")


# -- pairs, features, classifier -------------------------------------------------------------------


def positive_pairs(spark, folder):
    return _shown(
        _training(spark, folder).pairs.where("label = 1").select("dataset", "path1", "path2"), "path1", "path2"
    )


def labelled_pairs(spark, folder):
    return _shown(_training(spark, folder).pairs, "path1", "path2")


def pair_scores(spark, folder):
    mined, data = _mined(spark, folder), _training(spark, folder)
    featured = stored(classify.pair_features(data.pairs, data.records, mined.properties))
    return _shown(classify.score_pairs(classify.fit_pair_classifier(featured), featured), "path1", "path2")


def vector_topk(spark, folder):
    items = _table(spark, folder, "embeddings").withColumn("wanted", F.lit(sampling.PER_DEFINITION))
    best = pairing.ranked_pairs(items, ["label"], "vec_id", "embedding", "wanted", most_similar=True)
    return best.select("label", "vec_id1", "vec_id2")


def vector_bottomk(spark, folder):
    items = _table(spark, folder, "embeddings").select(
        F.lit("all").alias("corpus"), "vec_id", "embedding", F.lit(1000).alias("wanted"), (F.col("label") < 3).alias("good")
    )
    worst = pairing.ranked_pairs(
        items, ["corpus"], "vec_id", "embedding", "wanted", most_similar=False, skip_both="good"
    )
    return worst.select("vec_id1", "vec_id2")


def key_similarity(spark, folder):
    vectors = _table(spark, folder, "embeddings").select("label", array_to_vector("embedding").alias("raw"))
    unit = Normalizer(inputCol="raw", outputCol="vector").transform(vectors)
    means = features.mean_pairwise_cosine(unit, ["label"])
    return means.where("n > 1").select("label", F.round("similarity_raw", 6).alias("similarity"))


def group_split(spark, folder):
    names = _schemas(spark, folder).select("dataset")
    split = cut_lineage(sampling.group_split(names, 0.6, 42))
    group = F.substring("dataset", 1, 4).alias("name_group")
    sides = split.groupBy(group).agg(
        F.count(F.lit(1)).alias("names"),
        F.count_distinct("split").alias("sides"),
        F.max((F.col("split") == "train").cast("long")).alias("train"),
    )
    total = sides.agg(F.sum("train").alias("train_groups")).first()["train_groups"]
    return sides.drop("train").withColumn("train_groups", F.lit(total))


def _turns(spark, folder):
    words = _table(spark, folder, "conversations").select("conv_id", "turn", F.split("text", " ").alias("a"))
    following = words.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return words.join(following, ["conv_id", "turn"])


def property_order(spark, folder):
    ordered = sequences.common_first("a", "b")
    return _turns(spark, folder).select("conv_id", "turn", F.array_join(ordered, " ").alias("ordered"))


def pair_packing(spark, folder):
    packed = _turns(spark, folder).withColumn("packed", sequences.pack_pair("a", "b", max_tokens=64))
    mask = sequences.attention_mask(sequences.pad("packed", length=64))
    return packed.select(
        "conv_id",
        "turn",
        F.array_join("packed", " ").alias("sequence"),
        F.aggregate(mask, F.lit(0), lambda s, x: s + x).alias("unmasked"),
    )


def classifier_metrics(spark, folder):
    scored = _table(spark, folder, "labels").select(
        F.col("quality").alias("label"),
        F.col("toxic").alias("prediction"),
        F.when(F.col("toxic") == 1, 0.75).otherwise(0.25).alias("probability"),
    )
    metrics = clusters.classifier_metrics(scored)
    return _rounded(metrics, *metrics.columns)


QUERIES = (
    path_profile, path_summary, frequent_paths, object_counts, document_unnest, document_match,
    rejected_lines, clean_lines, type_mix, container_paths, draft_counts, schema_nodes,
    corpus_validation, validation_funnel, reference_paths, definition_paths, object_definitions,
    expansion_bounds, expansion_left, definition_cycles, definition_flags, dereference_status, matched_paths, ref_attribution, recursive_references, recursion_depth,
    dataset_status, processing_funnel, ground_truth, truth_round_trip, path_records,
    path_definition, candidate_pairs, pair_averages, cluster_pair_counts, cluster_scores,
    corpus_average, evaluation_rows, evaluation_clusters, clean_schemas, matched_files, pair_files, global_schema, positive_pairs, labelled_pairs, pair_scores,
    vector_topk, vector_bottomk, key_similarity, group_split, property_order, pair_packing,
    classifier_metrics,
)


def _training_data() -> tuple[dict[str, Callable], dict[str, str]]:
    """Queries and SQL of the ``llm`` package and the pipeline over it, where they are there."""
    try:
        import corpus_pipeline
        from structmine.llm import queries as more
    except ModuleNotFoundError as missing:
        if not (missing.name or "").startswith(("corpus_pipeline", "structmine.llm")):
            raise
        return {}, {}
    found = {q.__name__: q for q in more.QUERIES} | {"pipeline": corpus_pipeline.run}
    said = more.SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
    return found, said


def entry(spark: SparkSession) -> DataFrame:
    """Which object shapes occur in the corpus, how often, with which keys and types."""
    return path_profile(spark, SMALLEST)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES} | {"clusters": found_clusters} | _training_data()[0]


def oracle_sql() -> dict[str, str]:
    return oracle.sql() | _training_data()[1]
