"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Seeds are what four exact rules find (e-mail and IP addresses, card and telephone numbers).  The words
around them are lexical patterns: the word before, the two before, the ones before and after, the
two after.  Whatever else looks like an identifier (holds a digit, ``@``, ``_`` or a spelt-out ``[at]``) stands
in patterns as well.  Patterns and instances form a graph that is scored in rounds:

* A pattern's confidence in a kind is the share of that kind among its distinct instances; other
  kinds count against it in full, unknown instances with ``UNKNOWN`` of their missing score, and
  ``DOUBT`` instances always.  So a pattern needs eight instances of a kind at least, and is trusted at ``CONFIDENT``.
* An unknown instance scores the mean, over its distinct contexts, of the best trusted pattern there.

From the second round on, what was discovered speaks for patterns too.  Instances that score ``LEAST`` are added to
the seeds' spans wherever they stand.  Neighbouring identifiers one space apart are one instance.

A text is read once; after that only its mentions move.  Mentions are placed by sums over a document, graph edges are
distinct rows with partial aggregation, and joins on a pattern or an instance are salted, so a frequent one is no
single task's.  The longest group in one task is one document's mentions.

Edge cases: a null or empty text has no spans.  Repeated rows, null ids included, are answered each and count as one
instance and one context.  Patterns of the rules take time in proportion to the text, whatever it holds.
Other columns are ignored; an empty table gives no rows.  Where a pattern is as sure of two kinds, the earlier in ``KINDS`` is taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structmine.llm.shared import kept, texts_of

KINDS = ("email", "ip", "card", "phone")
#: The place after the kinds: identifiers of no kind yet.
OTHER = len(KINDS)

# The rules' expressions.  Possessive forms and look-behinds leave what they match as it
# is and keep them from trying again inside a run.
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_TO_255 = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?+"
_TOKEN = r"[^\s=:,;\"'<>\x02]"
_OTHER = rf"(?<!{_TOKEN})(?={_TOKEN}*[0-9@_]|{_TOKEN}*[\[({{]at[\])}}]){_TOKEN}++"
#: One of these stands in whatever a rule or the look for identifiers can match.
_TELLING = r"[0-9@_\[({]"
#: Stands in no match, nor does what it is replaced by where a text holds it.
MARK, OTHER_MARK = "\x01", "\x02"
_TRIMMED = ".!?()"
_WORD = r"[\p{L}0-9@]+|[#^]"

CONTEXT = 64
ROUNDS = 3
CONFIDENT = 0.8
LEAST = 0.4
UNKNOWN = 0.25
DOUBT = 2.0
SALTS = 16


def _holds(kind: str, hit: Column) -> Column:
    if kind == "email":
        return hit.isNotNull()
    if kind == "ip":
        return hit.rlike(r"^" + r"\.".join([_TO_255] * 4) + "$")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15)


def _told(kind: str, number: int, gap: str, hit: str, after: str) -> Column:
    """One entry a match: its length and that of the text since the last one, and the words around it."""

    def entry(z: Column, i: Column) -> Column:
        valid = F.lit(True) if number == OTHER else _holds(kind, z[hit])
        before = F.concat(F.when(i == 0, "^ ").otherwise("# "), z[gap])
        behind = F.concat(z[after], F.lit(" #"))
        return F.struct(
            F.lit(number).alias("kind"), i.alias("i"), F.length(z[gap]).alias("gap"), F.length(z[hit]).alias("size"),
            valid.alias("valid"), (z[gap] == " ").alias("glued"), F.when(valid, z[hit]).alias("hit"),
            F.when(valid, F.right(before, F.lit(CONTEXT))).alias("left"),
            F.when(valid, F.left(behind, F.lit(CONTEXT))).alias("right"),
        )

    return F.transform(F.filter(F.arrays_zip(gap, hit, after), lambda z: z[hit].isNotNull()), entry)


def _mentions(docs: DataFrame) -> DataFrame:
    """One row a text: everything the rules and the look for identifiers meet, with the text around it.

    A rule is read over the texts that hold a character it can't do without.  Its matches are put between
    two ``MARK``s, so that splitting at these gives the text between matches and the matches by turns.
    """
    kinds = [*EXPRESSIONS.items(), ("other", _OTHER)]
    needs = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    texts = texts_of(docs).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.replace("text", F.lit(MARK), F.lit(OTHER_MARK)).alias("text"),
        F.col("text").rlike(_TELLING).alias("telling"),
    )
    parts = texts.select(
        "row", "doc_id",
        *[
            F.when(F.col("telling") & needs.get(k, F.lit(True)), F.split(F.regexp_replace("text", rule, f"{MARK}$0{MARK}"), MARK, -1))
            .otherwise(F.array().cast("array<string>")).alias(k)
            for k, rule in kinds
        ],
    )
    met = []
    for number, (kind, _) in enumerate(kinds):
        gap, hit, after = f"gap_{kind}", f"hit_{kind}", f"after_{kind}"
        parts = parts.withColumns(
            {gap: F.filter(kind, lambda _, i: i % 2 == 0), hit: F.filter(kind, lambda _, i: i % 2 == 1)}
        ).withColumn(after, F.slice(gap, 2, F.size(gap)))
        met.append(_told(kind, number, gap, hit, after))
    return parts.select("row", "doc_id", F.concat(*met).alias("met"))


def _placed(found: DataFrame) -> DataFrame:
    """One row a mention that holds, with its place in code points; identifiers that touch a seed are left out."""
    so_far = Window.partitionBy("row", "kind").orderBy("i")
    rows = (
        found.select("row", F.explode("met").alias("m"))
        .select("row", "m.*")
        .repartition("row")
        .withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("long"))
        .withColumn("start", F.col("end") - F.col("size"))
        .where("valid")
    )
    bare = F.ltrim("hit", F.lit(_TRIMMED))
    trimmed = F.rtrim(bare, F.lit(_TRIMMED))
    other = F.col("kind") == OTHER
    rows = rows.withColumns({
        "start": F.when(other, F.col("start") + F.length("hit") - F.length(bare)).otherwise(F.col("start")),
        "end": F.when(other, F.col("end") - F.length(bare) + F.length(trimmed)).otherwise(F.col("end")),
        "whole": F.length("hit") == F.length(trimmed),
        "hit": F.when(other, trimmed).otherwise(F.col("hit")),
    })
    onward = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(~other, F.col("end"))).over(onward)
    following = F.min(F.when(~other, F.col("start"))).over(backward)
    rows = rows.withColumns({"reach": reach, "following": following})
    touches = (F.coalesce("reach", F.lit(-1)) > F.col("start")) | (F.col("following") < F.col("end"))
    return rows.withColumn("free", ~other | ~F.coalesce(touches, F.lit(False)))


def _joined_up(rows: DataFrame) -> DataFrame:
    """Seeds, and identifiers of no kind with direct neighbours made one."""
    before = Window.partitionBy("row", "kind").orderBy("i")
    goes_on = F.col("glued") & F.lag(F.col("free") & F.col("whole"), 1, False).over(before) & (F.col("kind") == OTHER)
    marked = rows.withColumn("opens", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("opens").over(before))
    member = F.struct("start", "end", "hit", "left", "right")
    grouped = marked.where("free").groupBy("row", "kind", "run").agg(F.sort_array(F.collect_list(member)).alias("all"))
    first, last = F.get("all", F.lit(0)), F.get("all", F.size("all") - 1)
    text = F.array_join(F.transform("all", lambda m: m["hit"]), " ")
    return grouped.select(
        "row", "kind", first["start"].alias("start"), last["end"].alias("end"), F.md5(F.lower(text)).alias("instance"),
        _patterns(first["left"], last["right"]).alias("patterns"),
    )


def _patterns(left: Column, right: Column) -> Column:
    words = lambda c: F.transform(
        F.regexp_extract_all(F.lower(c), F.lit(_WORD), F.lit(0)), lambda w: F.when(w.rlike("[0-9@]"), "#").otherwise(w)
    )
    at = lambda c, i: F.try_element_at(words(c), F.lit(i))
    one, two = at(left, -1), at(left, -2)
    return F.array_compact(
        F.array(
            F.concat(F.lit("before "), one),
            F.concat(F.lit("before "), two, F.lit(" "), one),
            F.concat(F.lit("between "), one, F.lit(" "), at(right, 1)),
            F.concat(F.lit("after "), at(right, 1), F.lit(" "), at(right, 2)),
        )
    )


def _looked_up(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` joined to ``table`` on ``key``; a frequent key's rows are dealt over ``SALTS`` tasks by another column."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "salt"]).drop("salt")


def _confidence(counted: DataFrame, learned: DataFrame | None) -> DataFrame:
    """Trusted patterns with their kind.  ``counted`` has one column of instances a kind, ``learned`` added scores."""
    columns = [f"n{k}" for k in range(len(KINDS))]
    scored = counted
    if learned is not None:
        scored = counted.join(learned, "pattern", "left").na.fill(0.0)
        scored = scored.withColumns({c: F.col(c) + F.col(f"more_{c}") for c in columns} | {
            "others": F.col("others") - reduce(lambda a, b: a + b, [F.col(f"more_{c}") for c in columns])
        })
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns]) + UNKNOWN * F.col("others") + DOUBT
    best = F.greatest(*[F.struct((F.col(c) / total).alias("confidence"), F.lit(-k).alias("rank")) for k, c in enumerate(columns)])
    return (
        scored.select("pattern", best.alias("best"))
        .where(F.col("best.confidence") >= CONFIDENT)
        .select("pattern", (-F.col("best.rank")).alias("kind"), F.col("best.confidence").alias("confidence"))
    )


def bootstrap(mentions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``instance``, ``kind`` and ``score`` of the identifiers discovered.

    ``mentions`` has ``kind`` (``OTHER`` where unknown), ``instance`` and ``patterns`` a row.
    """
    contexts = mentions.groupBy("kind", "instance", "patterns").agg(F.count(F.lit(1)).alias("n"))
    edges = contexts.select("kind", "instance", F.explode("patterns").alias("pattern")).distinct()
    columns = [F.count_if(F.col("kind") == k).cast("double").alias(f"n{k}") for k in range(len(KINDS))]
    others = F.count_if(F.col("kind") == OTHER).cast("double").alias("others")
    counted = edges.groupBy("pattern").agg(*columns, others).where(F.col("others") > 0)
    # no pattern with fewer instances is ever trusted, however sure all of them are
    enough = reduce(lambda a, b: a + b, [F.col(c) for c in counted.columns[1:]]) >= DOUBT * CONFIDENT / (1 - CONFIDENT)
    counted = kept(counted.where(enough), "private-patterns")

    unknown = contexts.where(F.col("kind") == OTHER).withColumn("context", F.md5(F.array_join("patterns", "\n")))
    every = unknown.groupBy("instance").agg(F.count(F.lit(1)).alias("contexts"))
    open_edges = _looked_up(
        unknown.select("instance", "context", F.explode("patterns").alias("pattern")), counted.select("pattern"), "pattern", "instance"
    )
    near = open_edges.select("instance").distinct()
    every = every.join(near, "instance", "left_semi")
    open_edges, every = kept(open_edges, "private-edges"), kept(every, "private-contexts")

    learned, found = None, None
    for _ in range(rounds):
        trusted = kept(_confidence(counted, learned), "private-trusted")
        best = (
            _looked_up(open_edges, trusted, "pattern", "instance")
            .groupBy("instance", "context")
            .agg(F.max(F.struct("confidence", (-F.col("kind")).alias("rank"))).alias("best"))
            .groupBy("instance", (-F.col("best.rank")).alias("kind"))
            .agg(F.sum("best.confidence").alias("sum"))
        )
        scored = best.join(every, "instance").select("instance", "kind", (F.col("sum") / F.col("contexts")).alias("score"))
        winner = scored.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("rank"))).alias("best"))
        found = kept(
            winner.select("instance", (-F.col("best.rank")).alias("kind"), F.col("best.score").alias("score")), "private-instances"
        )
        more = [F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(f"more_n{k}") for k in range(len(KINDS))]
        edges_of = open_edges.select("instance", "pattern").distinct()
        learned = _looked_up(edges_of, found, "instance", "pattern").groupBy("pattern").agg(*more)
    return found.where(F.col("score") >= LEAST)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.sort_array(spans), shown), ",")


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: spans by kind, those of the rules digested, and all of them.

    ``spans`` lists ``kind:start:end`` by start, then kind; places are code points, ends exclusive.
    """
    read = kept(_mentions(docs), "private-read")
    mentions = kept(_joined_up(_placed(read)), "private-mentions")
    discovered = _looked_up(
        mentions.where(F.col("kind") == OTHER).select("row", "start", "end", "instance"),
        bootstrap(mentions).select("instance", "kind"), "instance", "row",
    )
    seeds = mentions.where(F.col("kind") < OTHER).select("row", "start", "end", "kind", F.lit(True).alias("base"))
    span = F.struct("start", "kind", "end")
    of_row = (
        seeds.unionByName(discovered.select("row", "start", "end", "kind", F.lit(False).alias("base")))
        .groupBy("row")
        .agg(
            *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{name}") for k, name in enumerate(KINDS)],
            F.count_if(~F.col("base")).alias("n_discovered"),
            F.collect_list(F.when(F.col("base"), span)).alias("seeds"),
            F.collect_list(span).alias("all"),
        )
        .withColumns({"base_listed": _listed(F.col("seeds")), "spans": _listed(F.col("all"))})
        .drop("seeds", "all")
    )
    counts = [f"n_{k}" for k in KINDS]
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return (
        read.select("row", "doc_id")
        .join(of_row, "row", "left")
        .select(
            "doc_id", *[zero(c) for c in counts], F.sha2(F.coalesce("base_listed", F.lit("")), 256).alias("base_sha256"),
            F.coalesce("spans", F.lit("")).alias("spans"), zero("n_discovered"),
        )
    )
