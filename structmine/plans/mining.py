"""The whole mining question for a corpus in one go."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structmine.operators import (
    candidates,
    classify,
    clusters,
    documents,
    features,
    matching,
    profile,
    sampling,
    schema_graph,
)
from structmine.session import configure_tables, cut_lineage, parts_of, spread, stored
from structmine.sources.corpus import split_loaded


@dataclass
class MinedCorpus:
    """Tables of a processed corpus; every one is keyed by ``dataset``."""

    status: DataFrame
    truth: DataFrame
    properties: DataFrame
    summary: DataFrame
    unexpanded: DataFrame


def mine(
    lines: DataFrame, schemas: DataFrame, keep_pattern: bool = False, max_substitutions: int = schema_graph.MAX_SUBSTITUTIONS
) -> MinedCorpus:
    """Profile the documents, derive which paths share a definition, and keep the rest as records.

    A dataset leaves at the first stage that has nothing left for it; ``status`` names it.  ``unexpanded`` has the
    nested references that ``max_substitutions`` left unresolved.
    """
    configure_tables(lines.sparkSession)
    # every table about the schemas has these partitions, so none is shuffled
    dealt = spread(schemas.select("dataset", "schema"), "schema", "dataset")
    loaded, failed = split_loaded(dealt)
    loaded = stored(loaded, "dataset", like=dealt, placed=True)
    nodes = schema_graph.schema_nodes(loaded)
    parts = parts_of(nodes)
    references = stored(
        schema_graph.definition_references(schema_graph.reference_paths(nodes, keep_pattern)), "dataset", like=parts
    )
    unrolled, unexpanded = schema_graph.expanded_and_left(references, max_substitutions)
    expanded = schema_graph.strip_definition_keywords(unrolled)
    objects, not_objects = schema_graph.object_references(expanded, nodes)
    objects = stored(objects, "dataset", like=parts)
    # a pattern that can't be read costs its own dataset, not the corpus
    unreadable = stored(matching.unreadable_patterns(objects), "dataset", like=parts)
    objects = objects.join(unreadable, "dataset", "left_anti")

    # datasets without objects leave through the schema side: the lines are joined once
    with_objects = loaded.join(objects.select("dataset").distinct(), "dataset", "left_semi")
    profiled = profile.path_profile(documents.stored_counts(lines, with_objects))
    # paths meet their references by dataset; members stay dealt by path
    totals = profile.path_totals(profiled).repartition(parts, "dataset")
    frequent = stored(profile.frequent_paths(totals, not_objects), "dataset", like=parts)

    matched = matching.match_paths(objects, frequent)
    shared, singles = matching.frequent_definitions(matched)
    shared = stored(shared, "dataset", like=parts)
    with_truth = shared.select("dataset").distinct()
    kept = stored(
        frequent.join(with_truth.hint("shuffle_hash"), "dataset", "left_semi").join(singles, ["dataset", "path"], "left_anti"), "dataset", like=parts
    )
    truth = stored(matching.definitions_in_records(shared, kept), "dataset", like=parts)
    members = parts_of(profiled)
    # a partition has fewer paths than members
    properties = profile.path_properties(profiled, kept.repartition(members, "dataset", "path").hint("shuffle_hash"))
    properties = stored(properties, "dataset", "path", like=members)
    summary = stored(profile.path_summary(properties), "dataset", "path", like=members)

    stages = [
        ("ref_defn", references),
        ("object_defn", objects),
        ("path", frequent),
        ("schema_intersection", matched),
        ("freq_defn", shared),
        ("properties", truth),
    ]
    passed = None
    for number, (_, table) in enumerate(stages, 1):
        seen = table.select("dataset").distinct().withColumn("passed", F.lit(number))
        passed = seen if passed is None else passed.unionByName(seen)
    reached = passed.groupBy("dataset").agg(F.max("passed").alias("passed"))
    names = F.array(*[F.lit(name) for name, _ in stages], F.lit("ok"))
    status = (
        loaded.select("dataset")
        .join(reached, "dataset", "left")
        .join(unreadable.withColumn("unreadable", F.lit(True)), "dataset", "left")
        .select(
            "dataset",
            F.when(F.col("unreadable"), "error")
            .otherwise(F.element_at(names, F.coalesce("passed", F.lit(0)) + 1))
            .alias("status"),
        )
        .unionByName(failed)
    )
    return MinedCorpus(status, truth, properties, summary, unexpanded)


@dataclass
class TrainingData:
    records: DataFrame
    pairs: DataFrame


def training_data(mined: MinedCorpus, embed: features.Embedder = features.trigram_embedding) -> TrainingData:
    """Labelled pairs of a mined corpus."""
    vectors = cut_lineage(features.key_vectors(mined.properties, embed))
    records = features.path_records(mined.properties, mined.summary, vectors)
    return TrainingData(records, stored(sampling.labelled_pairs(mined.truth, records)))


def train(mined: MinedCorpus, data: TrainingData) -> PipelineModel:
    """Pair classifier fitted on the labelled pairs."""
    featured = stored(classify.pair_features(data.pairs, data.records, mined.properties))
    return classify.fit_pair_classifier(featured)


@dataclass
class Evaluation:
    """Candidate pairs, clusters of the accepted ones, and their scores; each is worked out when first read."""

    mined: MinedCorpus
    model: PipelineModel | None
    records: DataFrame | None
    jaccard_threshold: float
    min_common: int

    @cached_property
    def candidates(self) -> DataFrame:
        pairs = candidates.candidate_pairs(self.mined.properties, self.jaccard_threshold, self.min_common)
        return pairs if self._by_links else stored(pairs)

    @property
    def _by_links(self) -> bool:
        return self.model is None and self.min_common > 0

    @cached_property
    def _evaluated(self) -> DataFrame:
        if not self._by_links:
            return self.candidates
        return stored(candidates.candidate_links(self.mined.properties, self.jaccard_threshold, self.min_common))

    @cached_property
    def clusters(self) -> DataFrame:
        accepted = self._evaluated
        if self.model is not None:
            records = training_data(self.mined).records if self.records is None else self.records
            featured = classify.pair_features(accepted, records, self.mined.properties)
            accepted = stored(clusters.predicted_edges(classify.score_pairs(self.model, featured)))
        return stored(clusters.connected_components(accepted))

    @cached_property
    def scores(self) -> DataFrame:
        return stored(clusters.cluster_scores(self.mined.truth, self.clusters, self._evaluated))

    @cached_property
    def average(self) -> DataFrame:
        return clusters.corpus_average(self.scores)


def evaluate(
    mined: MinedCorpus,
    model: PipelineModel | None = None,
    records: DataFrame | None = None,
    jaccard_threshold: float = 0.25,
    min_common: int = 2,
) -> Evaluation:
    """Candidate pairs, clusters of the accepted ones, and their scores against the truth.

    Without ``model`` every candidate is accepted; clusters then come from links between key sets,
    and the pairs are only listed when ``candidates`` is read, as clusters and scores are.
    """
    return Evaluation(mined, model, records, jaccard_threshold, min_common)
