"""Tables dealt by a key need no shuffle, and vectors and token lists of a path are worked out once for all its pairs."""

import itertools
import random

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from structmine import session
from structmine.functions.sequences import MAX_TOKENS
from structmine.operators import classify, documents, features, pairing, profile, schema_graph


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_dealt_alike_meet_without_a_shuffle(spark):
    session.configure_tables(spark)
    made = spark.createDataFrame(
        [(f"d{i % 7}", [f"p{i % 3}"], i) for i in range(60)] + [(None, ["p"], 1), ("d1", None, 2)], "dataset string, path array<string>, n int"
    )
    one = session.stored(made, "dataset", like=3)
    two = session.stored(made.where("n % 2 = 0"), "dataset", like=one)
    assert session.parts_of(one) == session.parts_of(two) == 3
    assert sorted(map(str, one.collect())) == sorted(map(str, made.collect()))
    met = one.join(two.select("dataset", "path", F.col("n").alias("m")), ["dataset", "path"]).groupBy("dataset", "path").agg(F.sum("m"))
    assert "Exchange hashpartitioning" not in _plan(met)
    assert met.count() == made.where("n % 2 = 0 and dataset is not null and path is not null").select("dataset", "path").distinct().count()
    assert session.stored(made.limit(0), "dataset", like=2).isEmpty()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("table_")]


def test_tables_dealt_alike_are_one_group_after_a_union(spark):
    made = spark.range(400).select(F.concat(F.lit("d"), F.col("id") % 50).alias("dataset"), (F.col("id") % 3).alias("k"), F.col("id").alias("n"))
    parts = [session.stored(made.withColumn("n", F.col("n") + i), "dataset", like=4) for i in range(3)]
    together = parts[0].unionByName(parts[1]).unionByName(parts[2])
    for table in (together, together.repartition(4, "dataset")):
        assert table.groupBy("dataset", "k").agg(F.min("n").alias("n")).count() == 150
        assert table.select("dataset", "k").distinct().count() == 150


def test_tables_about_schemas_stay_where_their_schema_is(spark):
    schema = '{"properties":{"a":{"$ref":"#/$defs/A"}},"$defs":{"A":{"type":"object","properties":{"x":{"$ref":"#/$defs/B"}}},"B":{"type":"object","properties":{"y":{}}}}}'
    schemas = spark.createDataFrame([(f"d{i}", schema) for i in range(9)], "dataset string, schema string")
    nodes = schema_graph.schema_nodes(session.spread(schemas, "schema", "dataset"))
    references = session.stored(schema_graph.definition_references(schema_graph.reference_paths(nodes)), "dataset", like=nodes)
    for table in (references, schema_graph.definition_steps(references), schema_graph._object_facts(nodes)):
        assert "Exchange hashpartitioning" not in _plan(table)
    objects, _ = schema_graph.object_references(schema_graph.expand_nested(references), nodes)
    assert rows(objects, "ref", "path") == {("#/$defs/A", "$.a"), ("#/$defs/B", "$.a.x")}
    assert objects.count() == 18


def test_counts_are_dealt_by_path_and_equal_the_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(documents, "PART_ROWS", 20)
    lines = [(f"d{i % 5}", '{"a":{"k%d":1,"b":[{"c":null}]}}' % (i % 4)) for i in range(40)] + [(None, '{"z":1}'), ("d1", "{")]
    table = spark.createDataFrame(lines, "dataset string, line string")
    dealt = documents.stored_counts(table)
    assert session.parts_of(dealt) > 1
    text = lambda df: sorted(map(str, df.select("dataset", "path", "key", "n", "type_mask", "objects").collect()))
    assert text(dealt) == text(documents.path_counts(table))
    members = profile.path_profile(dealt)
    assert "Exchange hashpartitioning" not in _plan(profile.path_properties(members, profile.path_totals(members)))


def test_record_sums_equal_the_vectors(spark):
    dice = random.Random(3)
    keys = ["alpha", "alphabet", "beta", "betamax", "gamma"]
    shares = {(p, k): dice.random() + 0.1 for p in "abcd" for k in dice.sample(keys, "abcd".index(p) + 1)}
    properties = spark.createDataFrame(
        [("d", [p], k, w) for (p, k), w in shares.items()], "dataset string, path array<string>, key string, relative_frequency double"
    )
    vectors = features.key_vectors(properties)
    arrays = {r["key"]: r["vector"].toArray() for r in vectors.collect()}
    found = {r["path"][0]: r for r in features.record_sums(properties, vectors).collect()}
    assert set(found) == set("abcd")
    for p, row in found.items():
        own = [(arrays[k], w) for (q, k), w in shares.items() if q == p]
        want = sum(v * w for v, w in own)
        got = np.zeros(len(want))
        got[list(row["vector"])] = list(row["vector"].values())
        assert np.allclose(got, want, atol=1e-12) and all(row["vector"].values())
        near = np.mean([a @ b for (a, _), (b, _) in itertools.combinations(own, 2)]) if len(own) > 1 else 0.5
        assert abs(row["semantic_similarity_raw"] - near) < 1e-9


def test_sparse_vectors_rank_and_compare_as_dense_ones(spark):
    rng = np.random.default_rng(7)
    data = [(g, f"p{i:02d}", [float(x) for x in rng.integers(-1, 2, 6)]) for g in ("big", "small") for i in range(40 if g == "big" else 5)]
    dense = spark.createDataFrame(data + [("zero", f"p{i}", [0.0] * 6) for i in range(3)], "g string, item string, v array<double>")
    dense = dense.withColumn("wanted", F.lit(25))
    entries = F.filter(F.transform("v", lambda x, i: F.struct(i, x.alias("x"))), lambda e: e["x"] != 0)
    sparse = dense.withColumn("v", F.map_from_entries(entries))
    for most in (True, False):
        for block_rows in (8, 4096):
            one, two = (pairing.ranked_pairs(t, ["g"], "item", "v", "wanted", most, block_rows=block_rows) for t in (dense, sparse))
            assert rows(one, "g", "item1", "item2", "similarity") == rows(two, "g", "item1", "item2", "similarity")
    pair = lambda t, **more: t.where("g <> 'small'").select("item", "v", *more.values())
    lengths = {"norm": features.sparse_norm("v").alias("norm")}
    both = pair(sparse, **lengths).toDF("a", "va", "na").crossJoin(pair(sparse, **lengths).toDF("b", "vb", "nb"))
    got = {(r["a"], r["b"]): r["c"] for r in both.select("a", "b", features.sparse_cosine("va", "vb", "na", "nb").alias("c")).collect()}
    plain = pair(dense).toDF("a", "va").crossJoin(pair(dense).toDF("b", "vb")).select("a", "b", features.cosine("va", "vb").alias("c"))
    assert got == {(r["a"], r["b"]): r["c"] for r in plain.collect()}


def test_packed_pairs_with_and_without_long_lists_are_alike(spark):
    own = {"p": [f"k{i:03d}" for i in range(MAX_TOKENS + 40)], "q": ["k550", "k003", "z"], "r": ["k003", "a", "z"]}
    tokens = spark.createDataFrame(
        [("d", [p], k, [k, p]) for p, ks in own.items() for k in ks], "dataset string, path array<string>, key string, tokens array<string>"
    )
    pairs = spark.createDataFrame([("d", ["p"], ["q"]), ("d", ["q"], ["r"])], "dataset string, path1 array<string>, path2 array<string>")
    got = {r["path1"][0] + r["path2"][0]: r["sequence"] for r in classify.packed_pairs(pairs, tokens).collect()}
    apart = {r["path1"][0] + r["path2"][0]: r["sequence"] for r in classify._packed_apart(pairs, tokens).collect()}
    assert got == apart and set(got) == {"pq", "qr"}
    assert got["qr"] == ["<s>", "k003", "q", "z", "q", "k550", "q", "</s>", "k003", "r", "z", "r", "a", "r", "</s>"]
    assert got["pq"][:5] == ["<s>", "k003", "p", "k550", "p"]
