"""Hand-computed corpora through the chain."""

import random

import pytest
from conftest import A, path, rows
from pyspark.sql import functions as F

from structmine import session
from structmine.operators import classify, clusters, definition_walk, documents, matching, profile, recursion, schema_graph
from structmine.plans import mining

ORDER_SCHEMA = """{"$schema":"https://json-schema.org/draft/2020-12/schema","type":"object",
 "properties":{"billing":{"$ref":"#/$defs/Address"},"shipping":{"$ref":"#/$defs/Address"},
  "lines":{"type":"array","items":{"$ref":"#/$defs/Line"}},"code":{"$ref":"#/$defs/Code"},
  "contacts":{"type":"object","additionalProperties":{"$ref":"#/$defs/Party"}}},
 "$defs":{"Address":{"type":"object","properties":{"street":{"type":"string"},"city":{"type":"string"}}},
  "Party":{"type":"object","properties":{"home":{"$ref":"#/$defs/Address"}}},
  "Line":{"type":"object","properties":{"sku":{"type":"string"}}},"Code":{"type":"string"}}}"""
ORDER_LINES = [
    '{"billing":{"street":"a","city":"x"},"shipping":{"street":"b","city":"y"},"lines":[{"sku":"1"},{"sku":"2"}],'
    '"contacts":{"ann":{"home":{"street":"c","city":"z"}},"bob":{"home":{"street":"d","city":"w"}}}}',
    '{"billing":{"street":"e"},"code":"k"}',
    '{"unrelated":1}',
    '[{"billing":{"street":"f","city":"q"}},{"zzz":1},7]',
    '"str"',
    "{bad",
]
CORNER_SCHEMA = """{"patternProperties":{"^x":{"$ref":"#/$defs/A"}},"prefixItems":[{"$ref":"#/$defs/A"},true],
 "contains":{"$ref":"#/$defs/A"},"anyOf":[{"$ref":"#/$defs/A"},{"properties":{"q":{"not":{"$ref":"#/$defs/A"}}}}],
 "properties":{"p":{"$ref":"#/properties/q"},"u":true,"w":{"$ref":"#/a/b/c"},"v":{"$ref":"other.json"}},
 "$defs":{"A":{"type":"object","properties":{}}}}"""


def text_table(spark, column, pairs):
    return spark.createDataFrame(pairs, f"dataset string, {column} string")


@pytest.fixture(scope="module")
def orders(spark):
    lines = text_table(spark, "line", [("o", line) for line in ORDER_LINES] + [("c", '{"p":1}')])
    schemas = text_table(
        spark, "schema", [("o", ORDER_SCHEMA), ("c", CORNER_SCHEMA), ("bad", "{"), ("plain", '{"type":"object"}')]
    )
    return lines, schemas, mining.mine(lines, schemas)


def test_documents_are_matched_and_unnested(orders):
    lines, schemas, _ = orders
    docs = documents.documents(lines, schemas.where("dataset = 'o'"))
    assert docs.count() == 3


def test_profile(orders):
    lines, schemas, _ = orders
    found = profile.path_profile(documents.path_counts(lines, schemas.where("dataset = 'o'")))
    totals = profile.path_totals(found)
    assert rows(totals, "path", "parent_frequency") == {
        ("$", 7), ("$.billing", 5), ("$.shipping", 2), ("$.contacts", 2), ("$.contacts.ann.home", 2),
        ("$.contacts.bob.home", 2), (f"$.lines.{A}", 2), ("$.contacts.ann", 1), ("$.contacts.bob", 1),
    }
    assert rows(profile.infrequent_paths(totals), "path") == {("$.contacts.ann",), ("$.contacts.bob",)}
    by_object = profile.path_totals(found, documents.path_counts(lines, schemas.where("dataset = 'o'")))
    assert ("$", 3) in rows(by_object, "path", "parent_frequency")
    assert ("$.billing", 3) in rows(by_object, "path", "parent_frequency")


def test_summary_and_schema_text(orders):
    mined = orders[2]
    got = rows(mined.summary, "path", "nesting_depth", "datatype_entropy", "num_nested_keys", "key_entropy")
    assert got == {
        ("$", 0, 1, 5, 1.48), ("$.billing", 1, 0, 2, 0.67), ("$.shipping", 1, 0, 2, 0.69),
        ("$.contacts", 1, 0, 2, 0.69), ("$.contacts.ann.home", 3, 0, 2, 0.69), ("$.contacts.bob.home", 3, 0, 2, 0.69),
    }
    text = {tuple(r["path"]): r["schema"] for r in profile.schema_text(mined.properties, mined.summary).collect()}
    assert '"street":{"frequency":0.6,"type":["string"]}' in text[("$", "billing")]


def test_truth_and_status(orders):
    mined = orders[2]
    assert rows(mined.truth, "ref", "path") == {
        ("#/$defs/Address", p) for p in ("$.billing", "$.shipping", "$.contacts.ann.home", "$.contacts.bob.home")
    }
    assert rows(mined.status, "dataset", "status") == {
        ("o", "ok"), ("c", "object_defn"), ("bad", "load"), ("plain", "ref_defn"),
    }


def test_evaluation(orders):
    result = mining.evaluate(orders[2])
    assert result.candidates.count() == 6
    assert rows(result.scores, "dataset", "tp", "fp", "fn", "f1_score") == {("o", 6, 0, 0, 1.0)}
    assert rows(result.average, "average_precision") == {(1.0,)}


def test_pairs_of_an_evaluation_need_no_clusters(orders, monkeypatch):
    monkeypatch.setattr(clusters, "connected_components", lambda *a: pytest.fail("clusters were not asked for"))
    assert mining.evaluate(orders[2]).candidates.count() == 6


def test_lines_of_a_dataset_are_counted_together(spark):
    lines = [(f"d{i % 50}", '{"a": {"b": 1}}') for i in range(2000)]
    table = spark.createDataFrame(lines, "dataset string, line string").repartition(8)
    walk = documents.path_counts(table)._jdf.queryExecution().analyzed().toString()
    assert "RebalancePartitions" in walk
    met = {(r["dataset"], r["key"]): r["n"] for r in documents.path_counts(table).collect()}
    assert met == {(f"d{i}", k): 40 for i in range(50) for k in ("$", "a", "b")}


def test_only_telling_members_make_facts(spark):
    schema = '{"$defs": {"A": {"type": "object", "title": "t", "properties": {"x": {"title": "u"}}}}}'
    nodes = schema_graph.schema_nodes(text_table(spark, "schema", [("c", schema)]))
    assert rows(schema_graph._object_facts(nodes), "ptr", "says_object") == {("$defs.A", True)}


def test_training_and_classifier(orders, tmp_path):
    mined = orders[2]
    data = mining.training_data(mined)
    labels = sorted(r["label"] for r in data.pairs.collect())
    assert labels == [0] * 6 + [1] * 6
    classify.save_classifier(mining.train(mined, data), str(tmp_path / "model"))
    result = mining.evaluate(mined, classify.load_classifier(str(tmp_path / "model")), data.records)
    assert result.clusters.count() == 4


def test_corner_keywords(spark):
    nodes = schema_graph.schema_nodes(text_table(spark, "schema", [("c", CORNER_SCHEMA)]))
    found = schema_graph.reference_paths(nodes)
    assert rows(found, "ref", "path") == {
        *{("#/$defs/A", p) for p in ("$.pattern_key", f"$.{A}", "$.contains", "$", "$.q")},
        ("#/properties/q", "$.p"), ("#/a/b/c", "$.w"),
    }
    assert ("#/$defs/A", "$.pattern_key^x") in rows(schema_graph.reference_paths(nodes, True), "ref", "path")
    assert rows(schema_graph.definition_references(found), "ref") == {("#/$defs/A",), ("#/properties/q",)}


def test_recursive_definition_unrolls_nine_times(spark):
    schema = '{"properties":{"root":{"$ref":"#/$defs/N"}},"$defs":{"N":{"type":"object","properties":{"kid":{"$ref":"#/$defs/N"}}}}}'
    nodes = schema_graph.schema_nodes(text_table(spark, "schema", [("r", schema)]))
    expanded = schema_graph.strip_definition_keywords(schema_graph.expand_nested(schema_graph.reference_paths(nodes)))
    assert rows(expanded, "path") == {("$.root" + ".kid" * n,) for n in range(10)}


def test_object_like_through_branches_and_cycles(spark):
    schema = """{"$defs":{"Plain":{"type":"object","additionalProperties":true},"Branch":{"oneOf":[{"type":"null"},{"allOf":[{"$ref":"#/$defs/Plain"}]}]},
     "Alias":{"$ref":"#/$defs/Branch"},"Loop":{"$ref":"#/$defs/Loop"},"Empty":{"type":"object","properties":{}},"Text":{"type":"string"},
     "Masked":{"$ref":"#/$defs/Text","type":"object","properties":{"a":{}}}}}"""
    nodes = schema_graph.schema_nodes(text_table(spark, "schema", [("b", schema)]))
    assert rows(schema_graph.object_like_definitions(nodes), "name") == {("Plain",), ("Branch",), ("Alias",)}


def test_wildcards_and_patterns(spark):
    refs = spark.createDataFrame(
        [("d", "any", path("$.m.additional_key.x")), ("d", "pat", path("$.m.pattern_keya+.x")), ("d", "empty", path("$.m.pattern_key"))],
        "dataset string, ref string, path array<string>",
    )
    data = spark.createDataFrame(
        [("d", path(p)) for p in ("$.m.aa.x", "$.m.ab.x", "$.m.aa", f"$.m.{A}.x", "$.m.aa.x.y")] + [("d", ["$", "m", ""])],
        "dataset string, path array<string>",
    )
    assert rows(matching.match_paths(refs, data), "ref", "path") == {
        ("any", "$.m.aa.x"), ("any", "$.m.ab.x"), ("any", f"$.m.{A}.x"), ("pat", "$.m.aa.x"), ("empty", "$.m."),
    }


def test_shared_single_paths_stay(spark):
    matched = spark.createDataFrame(
        [("d", "two", path("$.a")), ("d", "two", path("$.b")), ("d", "one", path("$.a")), ("d", "lone", path("$.c"))],
        "dataset string, ref string, path array<string>",
    )
    frequent, single = matching.frequent_definitions(matched)
    assert rows(frequent, "ref", "path") == {("two", "$.a"), ("two", "$.b")}
    assert rows(single, "path") == {("$.c",)}


def test_attribution(spark):
    choice = '{"properties":{"a":{"anyOf":[{"type":"null"},{"$ref":"#/$defs/Z"}]},"t":{"type":"array","prefixItems":[{"type":"null"},{"$ref":"#/$defs/Y"}],"items":{"$ref":"#/$defs/Z"}}},"$defs":{"Z":{},"Y":{}}}'
    loop = '{"properties":{"n":{"$ref":"#/definitions/L"}},"definitions":{"L":{"$ref":"#/definitions/M"},"M":{"$ref":"#/definitions/L"}}}'
    nodes = schema_graph.schema_nodes(text_table(spark, "schema", [("o", ORDER_SCHEMA), ("z", choice), ("l", loop)]))
    expected = {
        ("o", "$.billing"): "#/$defs/Address", ("o", "$.contacts.ann"): "#/$defs/Party",
        ("o", "$.contacts.ann.home"): "#/$defs/Address", ("o", f"$.lines.{A}"): "#/$defs/Line",
        ("o", f"$.lines.{A}.sku"): None, ("o", "$.nowhere.x"): None, ("z", "$.a"): None,
        ("z", "$.a.anything"): "#/$defs/Z", ("z", f"$.t.{A}"): "#/$defs/Y", ("l", "$.n.x"): None, ("l", "$.n"): "#/definitions/L",
    }
    asked = spark.createDataFrame([(d, path(p)) for d, p in expected], "dataset string, path array<string>")
    got = rows(definition_walk.attribute_paths(nodes, asked), "dataset", "path", "ref")
    assert got == {(d, p, ref) for (d, p), ref in expected.items()}


def test_recursion_depth(spark):
    tree = '{"$ref":"#/definitions/node","definitions":{"node":{"type":"object","properties":{"children":{"type":"array","items":{"$ref":"#/definitions/node"}}}}}}'
    chain = '{"properties":{"node":{"$ref":"#/definitions/node"}},"definitions":{"node":{"type":"object","properties":{"node":{"$ref":"#/definitions/node"}}}}}'
    nodes = schema_graph.schema_nodes(text_table(spark, "schema", [("t", tree), ("c", chain)]))
    lines = text_table(spark, "line", [("t", '{"children":[{"children":[]}]}'), ("c", '{"node":{"node":{"node":{}}}}')])
    refs = recursion.recursive_references(nodes)
    depth = lambda strip: rows(
        recursion.recursion_depth(recursion.usage_paths(nodes, refs, strip), documents.container_paths(lines)),
        "dataset", "ref_path", "max_depth",
    )
    assert depth(False) == {("t", "", 4), ("t", "node.children.*", 0), ("c", "node", 3), ("c", "node.node", 2)}
    assert depth(True) == {("t", "", 4), ("t", "children.*", 1), ("c", "node", 3)}


def test_dereference(spark):
    flat = '{"properties":{"a":{"$ref":"#/$defs/T"}},"$defs":{"T":{"type":"string"}}}'
    loop = '{"properties":{"a":{"$ref":"#/$defs/T"}},"$defs":{"T":{"properties":{"b":{"$ref":"#/$defs/T"}}}}}'
    gone = '{"properties":{"a":{"$ref":"#/$defs/U"}},"$defs":{"T":{"type":"string"}}}'
    nodes = schema_graph.schema_nodes(text_table(spark, "schema", [("flat", flat), ("loop", loop), ("gone", gone)]))
    resolved, status = schema_graph.dereference(nodes)
    assert rows(status, "dataset", "status") == {("flat", "ok"), ("loop", "max_depth"), ("gone", "dangling")}
    assert ("properties.a.type", "string") in rows(resolved.where("dataset = 'flat'"), "ptr", "value")
    assert rows(resolved, "dataset") == {("flat",)}


def test_type_names(spark):
    texts = ["1", "1.0", "1e3", "9" * 23, "9" * 42, "true", "null", "{}", '[1,"a"]', "NaN", '"x"']
    lines = text_table(spark, "line", [("t", '{"k%02d":%s}' % (i, t)) for i, t in enumerate(texts)] + [("t", '{"dup":1,"dup":"x"}'), ("t", "")])
    found = profile.path_profile(documents.path_counts(lines)).where("dataset = 't'")
    types = {r["key"]: r["types"] for r in found.collect()}
    names = ["integer", "number", "number", "integer", "integer", "boolean", "null", "object", "array", "number", "string"]
    assert types == {f"k{i:02d}": [n] for i, n in enumerate(names)} | {"dup": ["string"]}


def test_deep_documents_keep_every_level(spark):
    depth = 400
    lines = text_table(spark, "line", [("d", '{"a":' * depth + "1" + "}" * depth)])
    assert profile.path_profile(documents.path_counts(lines)).count() == depth


def test_clusters_and_scores(spark):
    edge = "dataset string, path1 array<string>, path2 array<string>"
    chain = [("c", [f"{i:03d}"], [f"{i + 1:03d}"]) for i in range(63)]
    found = clusters.connected_components(spark.createDataFrame(chain + [("d", ["A"], ["B"]), ("d", ["C"], ["D"])], edge))
    sizes = found.groupBy("dataset", "cluster_id").count()
    assert rows(sizes, "dataset", "cluster_id", "count") == {("c", "000", 64), ("d", "A", 2), ("d", "C", 2)}
    actual = spark.createDataFrame(
        [("d", "r", [p]) for p in "ABC"] + [("e", "r", [p]) for p in "AB"] + [("e", "s", [p]) for p in "ABC"],
        "dataset string, ref string, path array<string>",
    )
    scores = clusters.cluster_scores(actual, found, actual)
    got = {(r["dataset"], r["tp"], r["fp"], r["fn"], round(r["f1_score"], 9)) for r in scores.collect()}
    assert got == {("d", 1, 1, 2, 0.4), ("e", 0, 0, 3, 0.0)}


def test_unreadable_pattern_costs_its_own_dataset(spark):
    """A pattern that is no regular expression, and a key that only looks like a wildcard."""
    bad = ORDER_SCHEMA.replace('"additionalProperties":{"$ref"', '"patternProperties":{"(x":{"$ref"').replace('Party"}}},\n', 'Party"}}}},\n')
    schemas = text_table(spark, "schema", [("good", ORDER_SCHEMA), ("bad", bad)])
    lines = text_table(spark, "line", [(d, line) for d in ("good", "bad") for line in ORDER_LINES])
    status = lambda **options: {r["dataset"]: r["status"] for r in mining.mine(lines, schemas, **options).status.collect()}
    assert status(keep_pattern=True) == {"good": status()["good"], "bad": "error"}
    assert status()["bad"] != "error"


def test_recursion_depth_equals_brute_force(spark):
    dice = random.Random(5)
    word = lambda most: [dice.choice(["a", "b", "*"]) for _ in range(dice.randrange(most + 1))]
    containers = {(d, tuple(word(12))) for d in "xyz" for _ in range(60)} | {("x", ("a",) * 900)}
    usages = {(d, f"r{i % 3}", tuple(word(4))) for d in "xyw" for i in range(40)} | {("x", "r", ("a",) * 899), ("y", "r", ("q",))}
    got = recursion.recursion_depth(
        spark.createDataFrame([(d, r, list(u)) for d, r, u in usages], "dataset string, ref string, ref_path array<string>"),
        spark.createDataFrame([(d, list(p)) for d, p in containers], "dataset string, path array<string>"),
    ).collect()
    fits = lambda p, u: sum(p[i : i + len(u)] == u for i in range(len(p) - len(u) + 1))
    want = {(d, r, u, max(fits(p, u) for e, p in containers if e == d)) for d, r, u in usages if d != "w"}
    assert {(x["dataset"], x["ref"], tuple(x["ref_path"]), x["max_depth"]) for x in got} == want and len(got) == len(want)


def test_clusters_survive_ids_that_collide(spark, monkeypatch):
    poor = lambda salt, path: F.size(path).cast("long") if salt < 2 else F.xxhash64(F.lit(salt), F.col(path))
    edges = spark.createDataFrame(
        [("d", [a], [b]) for a, b in ("AB", "BC", "DE")] + [("d", ["F"], ["F"])], "dataset string, path1 array<string>, path2 array<string>"
    )
    want = rows(clusters.connected_components(edges), "cluster_id", "path")
    assert want == {("A", "A"), ("A", "B"), ("A", "C"), ("D", "D"), ("D", "E")}
    monkeypatch.setattr(clusters, "_node_id", poor)
    assert rows(clusters.connected_components(edges), "cluster_id", "path") == want


def test_schemas_of_one_file_are_dealt_over_tasks(spark, monkeypatch):
    schema = '{"properties":{"a":{"$ref":"#/$defs/A"}},"$defs":{"A":{"type":"object","properties":{"x":{}}}}}'
    together = spark.createDataFrame([(f"d{i}", schema) for i in range(40)], "dataset string, schema string").coalesce(1)
    monkeypatch.setattr(session, "SPREAD_CHARS", 4 * len(schema))
    dealt = session.spread(together, "schema")
    assert dealt.rdd.getNumPartitions() == 11 and rows(dealt, "dataset") == {(f"d{i}",) for i in range(40)}
    assert session.spread(together.limit(0), "schema").count() == 0

    seen = []
    made = schema_graph.schema_nodes
    monkeypatch.setattr(schema_graph, "schema_nodes", lambda given: seen.append(given.rdd.getNumPartitions()) or made(given))
    lines = spark.createDataFrame([(f"d{i}", '{"a":{"x":1}}') for i in range(40)], "dataset string, line string")
    assert mining.mine(lines, together).status.count() == 40
    assert seen == [11]
