"""Tasks over tables of names and paths stay small however large the tables are."""

import json

import pyarrow as pa
from conftest import rows

from pyspark.sql import functions as F
from structmine import session
from structmine.functions import json_walk
from structmine.operators import definition_graph, documents, schema_graph


def test_rows_of_a_task_do_not_grow_with_a_shuffled_table(spark):
    def largest(n):
        names = spark.range(n).select(F.array(F.lit("$"), F.lit("definitions"), F.concat(F.lit("name-"), F.col("id"))).alias("path"))
        counted = names.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        return session.stored(counted.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))).agg(F.max("n")).first()[0]

    session.configure_tables(spark)
    assert largest(1_600_000) < 2 * largest(400_000) < 800_000


def test_partitions_grow_with_the_text_and_stay(spark, monkeypatch):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, "1")
    monkeypatch.setattr(session, "SPREAD_CHARS", 1)
    try:
        text = spark.range(40).select(F.lit("x" * 100).alias("schema"))
        session.spread(text, "schema")
        assert int(spark.conf.get(name)) >= 4000
        session.configure_tables(spark)
        assert int(spark.conf.get(name)) >= 4000
    finally:
        spark.conf.set(name, before)


def test_stored_tables_come_back_as_they_were(spark):
    made = spark.createDataFrame(
        [("d", ["a", None], 1.5, None), (None, [], float("nan"), {"k": 1}), ("e", None, -0.0, {})],
        "dataset string, path array<string>, x double, m map<string,int>",
    ).withColumn("total", F.lit(3).cast("decimal(38,0)"))
    again = session.stored(made)
    assert again.dtypes == made.dtypes
    assert sorted(map(str, again.collect())) == sorted(map(str, made.collect()))
    assert session.stored(made.limit(0)).isEmpty()


def test_facts_of_schema_objects_are_gathered_once_for_the_flags(spark, monkeypatch):
    seen, gather = [], schema_graph._object_facts
    monkeypatch.setattr(schema_graph, "_object_facts", lambda nodes: seen.append(1) or gather(nodes))
    schema = json.dumps({"$defs": {"A": {"type": "object", "properties": {"x": {}}}, "B": {"$ref": "#/$defs/A"}, "C": {"$ref": "#/$defs/C"}}})
    nodes = schema_graph.schema_nodes(spark.createDataFrame([("d", schema)], "dataset string, schema string"))
    found = rows(definition_graph.definition_flags(nodes), "name", "object_like", "cyclic")
    assert found == {("A", True, False), ("B", True, False), ("C", False, True)}
    assert seen == [1]


def test_only_containers_leave_the_walk_for_them(spark):
    lines = [
        '{"$":{"a":[1,[],{"b":{}}]},"n":1,"<ARRAY_ITEM>":{}}', '[{"c":[]},7,[[{"d":null}]]]', '{"n":{"x":"y"}}', '{"n":2}', '[1,2]',
        "{", "5", '{"\\ud800":{}}', None,
    ]
    found = list(json_walk.find_containers([pa.RecordBatch.from_pydict({"dataset": ["d"] * 9, "line": pa.array(lines, pa.string())})]))
    assert sum(b.num_rows for b in found) == 10
    table = spark.createDataFrame([("d", x) for x in lines] + [(None, '{"z":[]}')], "dataset string, line string")
    want = {"$", "$.a", "$.a.*", "$.a.*.b", "*", "*.c", "*.*", "*.*.*", "n", "�"}
    assert rows(documents.container_paths(table), "dataset", "path") == {("d", p) for p in want} | {(None, "z")}


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_line_is_parsed_once_for_its_keys(spark):
    text = F.concat(F.lit('{"a":'), F.col("id").cast("string"), F.lit("}"))
    lines = spark.range(3).select(F.lit("d").alias("dataset"), F.when(F.col("id") < 2, text).otherwise("[7]").alias("line"))
    schemas = spark.createDataFrame([("d", '{"properties":{"a":{}}}')], "dataset string, schema string")
    found = documents.with_declared_keys(lines, schemas)
    assert _optimized(found).count("jsonObjectKeys(line") == 1
    assert rows(found, "line", "keys") == {('{"a":0}', None), ('{"a":1}', None), ("[7]", "a")}
    other = schemas.withColumn("schema", F.lit('{"properties":{"b":{}}}'))
    assert rows(documents.with_declared_keys(lines, other), "line", "keys") == {("[7]", "b")}
    free = schemas.withColumn("schema", F.lit("{}"))
    assert documents.with_declared_keys(lines, free).count() == 3


def test_pointers_are_folded_once_and_words_looked_at_before_they_are_cut(spark):
    schema = json.dumps(
        {
            "properties": {"x": {"$ref": "#/$defs/A"}, "y": {"if": [{"$ref": "#/$defs/A"}], "properties": [{"$ref": "#/$defs/L"}]}},
            "oneOf": [{"type": "object"}, {"anyOf": {"k": {}}}, 5],
            "$defs": {"A": {"allOf": [{"allOf": [{}]}]}, "L": {"anyOf": {"z": {"$ref": "#/$defs/A"}}}},
        }
    )
    nodes = schema_graph.schema_nodes(spark.createDataFrame([("d", schema), (None, schema)], "dataset string, schema string"))
    found = schema_graph.reference_paths(nodes)
    assert _optimized(found).count("aggregate(") == 1
    paths = {("#/$defs/A", "$.x"), ("#/$defs/A", "$.y"), ("#/$defs/A", "$.$defs.L.anyOf.z"), ("#/$defs/A", "$.$defs.L.z")}
    got = {(d, r, p) for d, r, p in rows(found, "dataset", "ref", "path")}
    assert {(r, p) for d, r, p in got if d == "d"} == {(r, p) for d, r, p in got if d is None} <= paths
    assert ("d", "#/$defs/A", "$.x") in got and not any(r == "#/$defs/L" for _, r, _ in got)
    edges = schema_graph.object_edges(nodes)
    assert not any("slice(" in line for line in _optimized(edges).splitlines() if line.strip(" :+-").startswith("Filter"))
    by_branch = {(p, c) for d, p, c in rows(edges, "dataset", "ptr", "child") if d == "d" and not c.startswith("$defs.A") or c == "$defs.A.allOf.0.allOf.0"}
    assert {("", "oneOf.0"), ("", "oneOf.1"), ("oneOf.1", "oneOf.1.anyOf"), ("$defs.L", "$defs.L.anyOf"), ("$defs.A.allOf.0", "$defs.A.allOf.0.allOf.0")} <= by_branch
