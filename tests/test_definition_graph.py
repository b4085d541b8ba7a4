"""Cycles and unrolling bounds of definitions against plain Python over random graphs."""

import random
from collections import Counter

import pytest
from conftest import path, rows

from structmine.operators import definition_graph, schema_graph


def random_edges(seed, nodes, edges):
    r = random.Random(seed)
    return {(r.choice("ab"), f"n{r.randrange(nodes)}", f"n{r.randrange(nodes)}") for _ in range(edges)}


def components(edges):
    reach = {}
    for d, a, b in edges:
        reach.setdefault((d, a), set()).add(b)
    changed = True
    while changed:
        changed = False
        for (d, _), to in reach.items():
            more = {c for b in to for c in reach.get((d, b), ())} - to
            to |= more
            changed |= bool(more)
    return {(d, a, min(b for b in to if a in reach.get((d, b), ()))) for (d, a), to in reach.items() if a in to}, reach


@pytest.mark.parametrize("seed, nodes, edges", [(2, 30, 40), (3, 6, 20)])
def test_strong_components(spark, seed, nodes, edges):
    graph = random_edges(seed, nodes, edges)
    table = spark.createDataFrame(sorted(graph) * 2, "dataset string, source string, target string")
    want, reach = components(graph)
    assert rows(definition_graph.strong_components(table), "dataset", "node", "component") == want
    on_cycle = {(d, a) for d, a, _ in want}
    endless = {(d, a) for (d, a), to in reach.items() if any((d, b) in on_cycle for b in to)}
    assert rows(definition_graph.reaching_cycles(table), "dataset", "source") == endless


def test_no_cycles_and_no_edges(spark):
    schema = "dataset string, source string, target string"
    assert definition_graph.strong_components(spark.createDataFrame([], schema)).count() == 0
    chain = spark.createDataFrame([("d", f"n{i}", f"n{i + 1}") for i in range(15)] + [("d", "n15", None)], schema)
    assert definition_graph.strong_components(chain).count() == 0


def walks(references, limit):
    """Per dataset the walks that end, those cut and those that dangle, one by one."""
    heads = set()
    for d, ref, p in references:
        nested = len(p) >= 3 and p[1] in ("$defs", "definitions")
        heads.add((d, ref, f"#/{p[1]}/{p[2]}" if nested else None, ".".join(p[3:] if nested else p)))
    steps, count = {}, Counter()
    for d, ref, target, rest in heads:
        steps.setdefault((d, ref), []).append((target, rest))
    frontier = [(d, t) for d, _, t, _ in heads]
    for turn in range(limit + 1):
        following = []
        for d, t in frontier:
            if t is None:
                count[d, "expected"] += 1
            elif (d, t) not in steps:
                count[d, "dangling"] += 1
            elif turn == limit:
                count[d, "cut"] += 1
            else:
                following += [(d, n) for n, _ in steps[d, t]]
        frontier = following
    return count


@pytest.mark.parametrize("limit", [1, 9])
def test_expansion_bounds(spark, limit):
    r = random.Random(limit)
    names = [f"D{i}" for i in range(7)]
    table = []
    for d in "abc":
        for i, name in enumerate(names[: 3 if d == "c" else 7]):
            table.append((d, f"#/$defs/{name}", path(f"$.p{i}")))
            for _ in range(2):  # dataset c has no cycles
                to = names[i + 1] if d == "c" else r.choice([*names, "Nobody"])
                table.append((d, f"#/$defs/{name}", path(f"$.$defs.{to}.k{r.randrange(9)}")))
    refs = spark.createDataFrame(table, "dataset string, ref string, path array<string>")
    want = walks(table, limit)
    for x in definition_graph.expansion_bounds(refs, limit).collect():
        d = x["dataset"]
        assert (x["paths_expected"], x["paths_cut"], x["paths_dangling"]) == tuple(want[d, h] for h in ("expected", "cut", "dangling"))
        assert x["unrolled"] == (want[d, "cut"] == 0)
    assert rows(definition_graph.expansion_bounds(refs, limit).where("cyclic"), "dataset") <= {("a",), ("b",)}


def test_many_walks_are_counted_and_none_vanishes(spark):
    fan = [("d", "#/$defs/A", path("$.a"))] + [("d", "#/$defs/A", path(f"$.$defs.A.k{i}")) for i in range(100)]
    refs = spark.createDataFrame(fan, "dataset string, ref string, path array<string>")
    bound = definition_graph.expansion_bounds(refs, 4).first()
    assert (bound["paths_expected"], bound["paths_cut"], bound["cyclic"]) == (1 + 100 + 100**2 + 100**3 + 100**4, 100**5, True)
    assert definition_graph.expansion_bounds(refs).first()["paths_cut"] is None  # 100 to the tenth
    paths, left = schema_graph.expanded_and_left(refs, 1)
    assert paths.count() == 101 and rows(left, "ref", "target") == {("#/$defs/A", "#/$defs/A")} and left.count() == 100**2


def test_endless_object_tests(spark):
    schema = """{"$defs":{"Plain":{"type":"object","additionalProperties":true},"Loop":{"$ref":"#/$defs/Loop"},"Into":{"oneOf":[{"$ref":"#/$defs/Loop"}]},
     "Way":{"anyOf":[{"$ref":"#/$defs/Way"},{"$ref":"#/$defs/Plain"}]},"Text":{"type":"string"},"Empty":{}}}"""
    nodes = schema_graph.schema_nodes(spark.createDataFrame([("x", schema)], "dataset string, schema string"))
    got = rows(definition_graph.definition_flags(nodes), "name", "object_like", "cyclic")
    assert got == {
        ("Plain", True, False), ("Loop", False, True), ("Into", False, True), ("Way", True, True), ("Text", False, False), ("Empty", False, False),
    }
