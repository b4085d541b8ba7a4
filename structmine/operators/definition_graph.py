"""Which definitions refer to each other in circles, and how far unrolling them goes.

All datasets are walked at once; the graphs hold definitions, not documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structmine.operators import schema_graph
from structmine.session import stored

#: Beyond this a count of walks is no longer exact and is reported as null.
EXACT = float(1 << 53)


def _without(edges: DataFrame, end: str, other: str) -> DataFrame:
    """Edges whose ``end`` node is the ``other`` end of an edge too, round by round until all are."""
    left = edges.count()
    while left:
        nodes = edges.select("dataset", F.col(other).alias(end)).distinct()
        edges = stored(edges.join(nodes, ["dataset", end], "left_semi"))
        now = edges.count()
        if now == left:
            break
        left = now
    return edges


def reaching_cycles(edges: DataFrame) -> DataFrame:
    """(dataset, source) of the nodes from which a cycle can be reached."""
    return _without(edges, "target", "source").select("dataset", "source").distinct()


def _spread(table: DataFrame, edges: DataFrame) -> DataFrame:
    """The smallest ``colour`` from which each node can be reached."""
    while True:
        arriving = table.withColumnRenamed("node", "source").join(edges, ["dataset", "source"])
        best = (
            table.unionByName(arriving.select("dataset", F.col("target").alias("node"), "colour"))
            .groupBy("dataset", "node")
            .agg(F.min("colour").alias("colour"))
        )
        before = table.select("dataset", "node", F.col("colour").alias("before"))
        moved = stored(best.join(before, ["dataset", "node"]))
        table = moved.drop("before")
        if moved.where("colour < before").isEmpty():
            return table


def strong_components(edges: DataFrame) -> DataFrame:
    """(dataset, node, component) of the nodes that lie on a cycle; a component has the name of its first node.

    Each node takes the least node that reaches it as its colour.  Those that reach that node back, inside the
    colour, are its component; they leave, and what is left and may still be on a cycle is coloured again.
    ``edges`` has ``dataset``, ``source`` and ``target``; repeated edges count once.
    """
    rest = stored(edges.select("dataset", "source", "target").where("target is not null").distinct())
    found = None
    while True:
        rest = _without(_without(rest, "target", "source"), "source", "target")
        if rest.isEmpty():
            break
        nodes = rest.select("dataset", F.explode(F.array("source", "target")).alias("node")).distinct()
        colours = _spread(nodes.withColumn("colour", F.col("node")), rest)
        by_end = lambda end, name: colours.select("dataset", F.col("node").alias(end), F.col("colour").alias(name))
        inside = (
            rest.join(by_end("source", "a"), ["dataset", "source"])
            .join(by_end("target", "b"), ["dataset", "target"])
            .where("a = b")
            .select("dataset", F.col("target").alias("source"), F.col("source").alias("target"))
        )
        inside = stored(inside)
        members = frontier = stored(colours.where("node = colour"))
        while not frontier.isEmpty():
            frontier = stored(
                frontier.withColumnRenamed("node", "source")
                .join(inside, ["dataset", "source"])
                .select("dataset", F.col("target").alias("node"), "colour")
                .distinct()
                .join(members, ["dataset", "node"], "left_anti")
            )
            members = members.unionByName(frontier)
        members = stored(members)
        size = members.groupBy("dataset", "colour").agg(F.count(F.lit(1)).alias("size"))
        loops = rest.where("source = target").select("dataset", F.col("source").alias("node"), F.lit(True).alias("loop"))
        cyclic = members.join(size, ["dataset", "colour"]).join(loops, ["dataset", "node"], "left").where("size > 1 or loop")
        cyclic = cyclic.select("dataset", "node", F.col("colour").alias("component"))
        found = cyclic if found is None else found.unionByName(cyclic)
        for end in ("source", "target"):
            rest = rest.join(members.select("dataset", F.col("node").alias(end)), ["dataset", end], "left_anti")
        rest = stored(rest)
    if found is None:
        return rest.select("dataset", F.col("source").alias("node"), F.col("target").alias("component"))
    return stored(found)


def definition_cycles(references: DataFrame) -> DataFrame:
    """(dataset, ref, component): definitions that, followed from one to the next, lead back to themselves."""
    steps = schema_graph.definition_steps(references)
    return strong_components(steps.select("dataset", F.col("ref").alias("source"), "target")).withColumnRenamed("node", "ref")


def expansion_bounds(references: DataFrame, limit: int = schema_graph.MAX_SUBSTITUTIONS) -> DataFrame:
    """Per dataset what unrolling its nested definitions gives, counted instead of unrolled.

    ``paths_expected`` walks end at a data path within ``limit`` substitutions, ``paths_cut`` would need more,
    ``paths_dangling`` lead to a definition that nothing refers to; ``unrolled`` says that none was cut.
    A recurrence over (dataset, definition) carries the number of open walks, so graphs whose walks
    multiply cost no more than others.  Different walks may give the same path.  Counts above 2 to the 53 are null.
    """
    steps = stored(schema_graph.definition_steps(references), "dataset")
    count = F.count(F.lit(1)).cast("double")
    moves = stored(steps.groupBy("dataset", F.col("ref").alias("at"), "target").agg(count.alias("ways")), "dataset", like=steps)
    known = moves.select("dataset", "at").distinct()
    state = stored(steps.groupBy("dataset", "target").agg(count.alias("n")), "dataset", like=steps)
    ended = state.where("target is null").select("dataset", F.lit("expected").alias("how"), "n")
    for turn in range(limit + 1):
        state = state.where("target is not null").withColumnRenamed("target", "at")
        dangling = state.join(known, ["dataset", "at"], "left_anti")
        ended = ended.unionByName(dangling.select("dataset", F.lit("dangling").alias("how"), "n"))
        state = state.join(known, ["dataset", "at"], "left_semi")
        if turn == limit:
            ended = ended.unionByName(state.select("dataset", F.lit("cut").alias("how"), "n"))
            break
        if state.isEmpty():
            break
        state = stored(
            state.join(moves, ["dataset", "at"]).groupBy("dataset", "target").agg(F.sum(F.col("n") * F.col("ways")).alias("n")),
            "dataset",
            like=steps,
        )
        ended = ended.unionByName(state.where("target is null").select("dataset", F.lit("expected").alias("how"), "n"))
    total = lambda how: F.coalesce(F.sum(F.when(F.col("how") == how, F.col("n"))), F.lit(0.0))
    names = ("expected", "cut", "dangling")
    sums = ended.groupBy("dataset").agg(*[total(h).alias(h) for h in names])
    cyclic = definition_cycles(references).select("dataset", F.lit(True).alias("cyclic")).distinct()
    return sums.join(cyclic, "dataset", "left").select(
        "dataset", F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        *[F.when(F.col(h) < EXACT, F.col(h).cast("long")).alias(f"paths_{h}") for h in names],
        (F.col("cut") == 0).alias("unrolled"),
    )


def definition_flags(nodes: DataFrame) -> DataFrame:
    """(dataset, name, object_like, cyclic) of every definition.

    ``cyclic`` marks those whose test for an object would follow references and branches for ever; without an
    answer on the way they are no objects.
    """
    named = schema_graph.named_definitions(nodes)
    facts = stored(schema_graph._object_facts(nodes), "dataset", like=nodes)
    stated = stored(schema_graph.object_edges(nodes, facts), "dataset", like=nodes)
    objects = schema_graph.object_like_definitions(nodes, facts, stated).withColumn("object_like", F.lit(True))
    edges = stated.select("dataset", F.col("ptr").alias("source"), F.col("child").alias("target"))
    endless = reaching_cycles(edges).select("dataset", F.col("source").alias("ptr"), F.lit(True).alias("endless"))
    return (
        named.join(objects, ["dataset", "name"], "left")
        .join(endless, ["dataset", "ptr"], "left")
        .select(
            "dataset", "name", F.coalesce("object_like", F.lit(False)).alias("object_like"),
            F.coalesce("endless", F.lit(False)).alias("cyclic"),
        )
    )
