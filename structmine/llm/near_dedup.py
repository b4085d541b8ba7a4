"""Near-duplicates by order MinHash, verified by banded alignment.

Words are lower-cased runs of letters and digits; a document is the sequence of its k-mers of five words,
each labelled by how often it stood before in the document (a document of fewer words is one k-mer).

1. Documents of equal text are one class from the start; below, a document is one of distinct text.
2. Order MinHash: each of ``SKETCHES`` hash functions takes the ``TAKEN`` smallest labelled k-mers and keeps
   them in text order.  Two documents share a sketch with about the ``TAKEN``-th power of their similarity.
   Documents of few k-mers (``SHORT``) have further sketches of ``FEW`` k-mers: there, one k-mer more changes
   nearly every sketch of five.
3. Documents that share a sketch are compared: all of them where a group is small.  Larger groups are
   compared with their most central document, and also split by the following sketches and the parts
   compared in the same way; families of large groups whose documents are then in different classes are
   compared in blocks of bounded size, those outside a family's largest class with all.  So no pair of a
   group is left out but those already in one class, and a large group of copies costs a few comparisons
   a document.
4. Verification aligns two documents within a band around the diagonal.  The longest chain of equal k-mers in
   order anchors the alignment; the words between anchors are aligned by edit distance.  Documents are alike
   where at most a tenth of the longer one's words are edited (``EDITS``), or where the chain is 0.8 or more of
   all k-mers of both less the chain, which with no part moved is the Jaccard similarity of their shingles.
5. Classes are the connected components of the links.

At a shingle similarity of 0.8 two documents share no group in at most one case of 10,000 (28 sketches of
five, and 28 of two where both are short), at 0.7 in one of 170, at 0.63 in 5 of 100, at 0.5 in 41 of 100.  One edited
word changes five shingles, so a twentieth of words edited all over a text leaves 0.63, and fewer edits leave more.
Between the classes of a large family only shingles are compared (step 3 is whole for them): there, documents
that are alike by edits alone are found by their central documents and small groups.

Edge cases: a null text is empty; texts without a word are only in a class with equal texts; rows with a
null id are in no class and are kept; rows with equal id and text are one document; an empty table gives
no rows; other columns are carried along by ``select``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structmine.llm import spans
from structmine.llm.components import components
from structmine.llm.shared import kept

WORDS = 5
SIMILARITY = 0.8
#: Edits, as a share of the longer document's words, up to which documents are alike.
EDITS = 0.1
SKETCHES = 28
TAKEN = 5
#: Documents of so many labelled k-mers have as many sketches again, of ``FEW`` of them; with fewer, only equal lists are alike.
SHORT = (4, 20)
FEW = 2
#: Groups up to this size are compared pair by pair.
SMALL = 12
#: Labelled k-mers in a block of documents outside their family's largest class, and of all of a family.
BLOCK_KMERS = (1 << 17, 1 << 18)
#: A larger group is also split by so many of the following sketches.
SPLITS = 5
#: A pair lies within the band where its places differ by less than this share of the longer document.
BAND = 0.5

_rng = np.random.Generator(np.random.PCG64(77))
_FACTORS = _rng.integers(1, 1 << 62, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _rng.integers(1, 1 << 63, SKETCHES, dtype=np.uint64)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the words of a text column."""
    found = spans.texts(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    words = spans.runs(found, spans.ALPHANUMERIC)
    return spans.Hasher(found.data).of(words.start, words.end), words.row


def labelled(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labelled k-mers and their rows, in text order.  ``hashes`` may be of 32 or 64 bits."""
    hashes = hashes & np.uint64(0xFFFFFFFF)
    kmers, owner = spans.grams(hashes, row, WORDS)
    inside = owner >= 0
    kmers, owner = kmers[inside], owner[inside]
    count = np.bincount(row) if len(row) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        starts = np.searchsorted(row, short)
        extra = []
        for a, n in zip(starts, count[short]):
            extra.append(spans.grams(hashes[a : a + n], np.zeros(n, np.int64), int(n))[0][0] + np.uint64(n))
        kmers, owner = np.concatenate([kmers, np.array(extra, np.uint64)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        kmers, owner = kmers[order], owner[order]
    key = spans.keyed(kmers, owner)
    order = np.argsort(key, kind="stable")
    before = np.zeros(len(key), np.int64)
    before[order] = spans.numbered(key[order])
    again = before > 0
    kmers[again] = spans.mix(kmers[again] + before[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return kmers, owner


def sketches(kmers: np.ndarray) -> np.ndarray:
    """The order MinHash sketches of one document's labelled k-mers."""
    found = _sketches(kmers, TAKEN)
    return np.concatenate([found, _sketches(kmers, FEW)]) if SHORT[0] <= len(kmers) <= SHORT[1] else found


def _sketches(kmers: np.ndarray, most: int) -> np.ndarray:
    n, out = len(kmers), []
    step = max(1, min(SKETCHES, (1 << 21) // max(n, 1)))
    for a in range(0, SKETCHES, step):
        keys = (kmers[None, :] ^ _SEEDS[a : a + step, None]) * _FACTORS[a : a + step, None]
        if n > most:
            places = np.sort(np.argpartition(keys, most - 1, axis=1)[:, :most], axis=1)
        else:
            places = np.broadcast_to(np.arange(n), (len(keys), n))
        taken, value = kmers[places], np.zeros(len(keys), np.uint64)
        for i in range(taken.shape[1]):
            value = spans.mix(value + taken[:, i])
        out.append(value)
    return np.concatenate(out)


def _anchors(first: np.ndarray, second: np.ndarray, band: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the longest chain of equal elements in order, within the band; elements are distinct."""
    _, i, j = np.intersect1d(first, second, assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    inside = np.abs(i - j) <= band * max(len(first), len(second))
    i, j = i[inside], j[inside]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return i, j
    ends: list[int] = []
    last: list[int] = []
    before = []
    for k, x in enumerate(j.tolist()):
        at = bisect_left(ends, x)
        before.append(last[at - 1] if at else -1)
        ends[at : at + 1] = [x]
        last[at : at + 1] = [k]
    picked, k = [], last[-1]
    while k >= 0:
        picked.append(k)
        k = before[k]
    picked = np.array(picked[::-1])
    return i[picked], j[picked]


def chain(first: np.ndarray, second: np.ndarray, band: float = BAND) -> int:
    """Length of the longest chain of equal elements in order, within the band; elements are distinct."""
    return len(_anchors(first, second, band)[0])


def _edits(a: np.ndarray, b: np.ndarray) -> int:
    """Words inserted, left out or replaced between two stretches."""
    if not len(a) or not len(b) or len(a) == len(b) == 1:
        return max(len(a), len(b))
    places = np.arange(len(b) + 1)
    row = places
    for x in a:
        best = np.empty_like(row)
        best[0] = row[0] + 1
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.minimum.accumulate(best - places) + places
    return int(row[-1])


def edit_similarity(one: np.ndarray, two: np.ndarray, i: np.ndarray, j: np.ndarray, most: float = EDITS) -> float:
    """The share of words an alignment through the anchors leaves as they are; 0 beyond ``most`` edits.

    An anchor is a k-mer that starts at word ``i`` of one text and word ``j`` of the other.
    """
    longer = max(len(one), len(two))
    allowed, spent, at, to = int(most * longer), 0, 0, 0
    new = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)])) if len(i) else np.zeros(0, np.int64)
    blocks = list(zip(i[new].tolist(), j[new].tolist(), i[np.append(new[1:], len(i)) - 1].tolist())) if len(i) else []
    for a, b, a_last in [*blocks, (len(one), len(two), len(one) - WORDS)]:
        # anchors may share words with those before
        late = max(at - a, to - b, 0)
        end = a_last + WORDS
        if a + late > end:
            continue
        gap = one[at : a + late], two[to : b + late]
        # a stretch without a common k-mer takes an edit in every k-mer
        if spent + max(abs(len(gap[0]) - len(gap[1])), (max(map(len, gap)) - WORDS + 1) // WORDS) > allowed:
            return 0.0
        spent += _edits(*gap)
        if spent > allowed:
            return 0.0
        at, to = end, b + end - a
    return 1 - spent / longer


def similarity(one: np.ndarray, two: np.ndarray, first: np.ndarray, second: np.ndarray) -> float:
    """Of two documents' words and labelled k-mers: of their shingles or their words, whichever makes them alike, else 0."""
    if not len(first) or not len(second):
        return 0.0
    i, j = _anchors(first, second, BAND)
    shared = len(i)
    if shared >= SIMILARITY * (len(first) + len(second) - shared):
        return shared / (len(first) + len(second) - shared)
    longer = max(len(one), len(two))
    # an edit changes ``WORDS`` k-mers at most
    if min(len(one), len(two)) < WORDS or shared < max(1, longer - WORDS + 1 - WORDS * int(EDITS * longer)):
        return 0.0
    return edit_similarity(one, two, i, j)


# -- tables ----------------------------------------------------------------------------------------


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_kmers, sketches`` of every row with an id."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches, "text"):
            kmers, owner = labelled(*words_of(batch.column("text")))
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            found = [sketches(kmers[a:b]).view(np.int64) if b > a else None for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_key"), pa.array(np.diff(ends).astype(np.int64)),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_key", "n_kmers", "sketches"],
            )

    text = F.coalesce("text", F.lit(""))
    wanted = docs.where("doc_id is not null").select("doc_id", text.alias("text"), F.md5(text).alias("text_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return wanted.mapInArrow(sketch, f"doc_id {kind}, text_key string, n_kmers long, sketches array<bigint>")


def _groups(rows: DataFrame, *more: Column) -> DataFrame:
    """``rows`` (key, ...) of keys that two documents or more have, with the group's ``size``."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *more).where("size > 1")
    return rows.join(sizes, "key")


def _pairs(rows: DataFrame) -> DataFrame:
    """All pairs of a group; for small groups."""
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.doc") < F.col("b.doc")))


def _comparable() -> Column:
    """Documents of too different length can't reach the similarity."""
    least, most = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    return least >= SIMILARITY * most


def _ends() -> list[Column]:
    return [F.col("a.doc").alias("doc1"), F.col("b.doc").alias("doc2")]


def candidates(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs to verify, and for documents of large groups those they are compared with (doc, n, hub).

    ``texts`` (doc, n, sketches) is one row a distinct text.
    """
    own = F.posexplode("sketches").alias("place", "value")
    rows = texts.where("n > 0").select("doc", "n", "sketches", own)
    narrow = rows.select(F.xxhash64("place", "value").alias("key"), "doc", "n", "place")
    groups = kept(_groups(narrow), "sketch-groups")
    small = _pairs(groups.where(F.col("size") <= SMALL)).where(_comparable()).select(*_ends())

    # a document's large groups side by side: at most one a sketch
    own = F.collect_list(F.struct("place", "key")).alias("own")
    large = groups.where(F.col("size") > SMALL).groupBy("doc").agg(own).join(texts.select("doc", "n", "sketches"), "doc")
    # sketches of one kind follow each other in a ring
    ring = lambda o, step: o["place"] - o["place"] % SKETCHES + (o["place"] + step) % SKETCHES
    following = lambda o, step: F.xxhash64(o["key"], F.lit(step), F.element_at("sketches", ring(o, step) + 1))
    # the whole group too: a document may share none of the following sketches
    keys = F.flatten(F.transform("own", lambda o: F.array(o["key"], *[following(o, i + 1) for i in range(SPLITS)])))
    rank = F.struct(F.size("own").alias("groups"), F.xxhash64("doc"), "doc", "n").alias("rank")
    split = large.select("doc", "n", rank, F.explode(keys).alias("key"))
    # the most central document is the one in most large groups
    parts = kept(_groups(split, F.max("rank").alias("hub")).drop("rank"), "split-groups")
    few = parts.where(F.col("size") <= SMALL)
    small = small.unionByName(_pairs(few).where(_comparable()).select(*_ends()))
    large = parts.where(F.col("size") > SMALL)
    a, b = F.least("doc", "hub.doc"), F.greatest("doc", "hub.doc")
    near = F.least("n", "hub.n") >= SIMILARITY * F.greatest("n", "hub.n")
    to_hub = large.where((F.col("doc") != F.col("hub.doc")) & near).select(a.alias("doc1"), b.alias("doc2"))
    return small.unionByName(to_hub).distinct(), large.select("doc", "n", F.col("hub.doc").alias("hub")).distinct()


def _kmers(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A document's words and its labelled k-mers."""
    hashes = np.frombuffer(words, "<u4").astype(np.uint64)
    return hashes, labelled(hashes, np.zeros(len(hashes), np.int64))[0]


def words_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc, words`` (32-bit hashes) of the documents in ``wanted`` (doc); nothing else moves."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches, "text"):
            hashes, row = words_of(batch.column("text"))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            low = (hashes & np.uint64(0xFFFFFFFF)).astype("<u4")
            words = pa.array([low[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), words], ["doc", "text_key", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text"), F.md5(text).alias("text_key"))
    ends = wanted.select(F.col("doc").alias("doc_id"), "text_key")
    own = own.join(ends, ["doc_id", "text_key"], "left_semi")
    found = own.mapInArrow(hashed, f"doc {kind}, text_key string, words binary")
    return kept(found.dropDuplicates(["doc"]).drop("text_key"), "words")


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``doc1, doc2, similarity`` of the pairs that their alignment shows to be alike."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, (np.zeros(0, np.uint64),) * 2
        for batch in batches:
            values = []
            for one, two, other in zip(batch.column("doc2").to_pylist(), batch.column("words1"), batch.column("words2")):
                if one != last:
                    last, known = one, _kmers(other.as_py())
                text, kmers = _kmers(two.as_py())
                values.append(similarity(text, known[0], kmers, known[1]))
            found = pa.array(values, pa.float64())
            batch = pa.RecordBatch.from_arrays([batch.column("doc1"), batch.column("doc2"), found], ["doc1", "doc2", "similarity"])
            yield batch.filter(pc.greater(found, 0))

    kind = words.schema["doc"].dataType.simpleString()
    both = pairs.join(words.toDF("doc1", "words1"), "doc1").join(words.toDF("doc2", "words2"), "doc2")
    return both.select("doc1", "doc2", "words1", "words2").mapInArrow(align, f"doc1 {kind}, doc2 {kind}, similarity double")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, class_id`` (the smallest id of the class) and ``n_verified_links`` of every document.

    ``n_verified_links`` counts the verified links of the document's text to other texts.  Comparisons between
    documents already in one class are left out, so a large class has fewer links than similar pairs
    and the column is no count of similar texts.
    """
    documents = kept(sketched(docs), "sketches")
    texts = documents.groupBy("text_key").agg(
        F.min("doc_id").alias("doc"), F.first("n_kmers").alias("n"), F.first("sketches").alias("sketches")
    )
    texts = kept(texts, "distinct-texts")
    pairs, large = candidates(texts)
    pairs, large = kept(pairs, "pairs"), kept(large, "hubs")
    ends = [pairs.select(F.col(c).alias("doc")) for c in ("doc1", "doc2")]
    wanted = ends[0].unionByName(ends[1]).unionByName(large.select("doc")).distinct()
    words = words_table(docs, wanted.join(texts.select("doc", "text_key"), "doc"))
    links = kept(verified(pairs, words), "links")
    found = components(links.select("doc1", "doc2"))
    apart = _apart(large, found)
    if not apart.isEmpty():
        links = kept(links.unionByName(_between(apart, words)), "links")
        found = components(links.select("doc1", "doc2"))
    ends = links.select(F.col("doc1").alias("doc")).unionByName(links.select(F.col("doc2").alias("doc")))
    counted = ends.groupBy("doc").agg(F.count(F.lit(1)).alias("n_verified_links"))
    named = (
        texts.select("text_key", "doc")
        .join(found, "doc", "left")
        .join(counted, "doc", "left")
        .select(
            "text_key",
            F.coalesce("component", "doc").alias("class_id"),
            F.coalesce("n_verified_links", F.lit(0)).alias("n_verified_links"),
        )
    )
    return documents.select("doc_id", "text_key").join(named, "text_key").select("doc_id", "text_key", "class_id", "n_verified_links")


def _apart(large: DataFrame, found: DataFrame) -> DataFrame:
    """``family, doc, n, part, stray`` and the numbers of blocks, for families of more than one class.

    A family is what the large groups and their central documents connect.
    """
    families = components(large.select("doc", "hub")).withColumnRenamed("component", "family")
    placed = (
        large.select("doc", "n").distinct().join(families, "doc").join(found, "doc", "left")
        .select("family", "doc", "n", F.coalesce("component", "doc").alias("part"))
    )
    parts = placed.groupBy("family", "part").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("kmers"))
    best = F.max(F.struct("docs", "part", "kmers"))
    sizes = parts.groupBy("family").agg(best.alias("main"), F.sum("kmers").alias("kmers"), F.count(F.lit(1)).alias("parts"))
    blocks = sizes.where("parts > 1").select(
        "family",
        F.col("main.part").alias("main"),
        F.ceil((F.col("kmers") - F.col("main.kmers")) / BLOCK_KMERS[0]).cast("int").alias("stray_blocks"),
        F.ceil(F.col("kmers") / BLOCK_KMERS[1]).cast("int").alias("all_blocks"),
    )
    return kept(placed.join(blocks, "family").withColumn("stray", F.col("part") != F.col("main")), "apart")


def _between(apart: DataFrame, words: DataFrame) -> DataFrame:
    """Links between classes of a family: blocks of strays against blocks of all."""
    kind = words.schema["doc"].dataType.simpleString()
    block = lambda salt, n: F.pmod(F.xxhash64("doc", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    strays = apart.where("stray").select(
        "family", block(1, "stray_blocks").alias("row"), each("all_blocks").alias("column"), F.lit(True).alias("stray"), "doc", "part"
    )
    others = apart.select(
        "family", each("stray_blocks").alias("row"), block(2, "all_blocks").alias("column"), F.lit(False).alias("stray"), "doc", "part"
    )

    def compare(block: pa.Table) -> pa.Table:
        doc, part = block.column("doc").to_numpy(), block.column("part").to_numpy()
        stray = block.column("stray").to_numpy()
        kmers = [_kmers(x.as_py())[1] for x in block.column("words")]
        own, rest = np.flatnonzero(stray), np.flatnonzero(~stray)
        pool = np.concatenate([np.zeros(0, np.uint64), *(kmers[i] for i in own)])
        owner = np.repeat(np.arange(len(own)), [len(kmers[i]) for i in own])
        order = np.argsort(pool, kind="stable")
        pool, owner = pool[order], owner[order]
        size = np.array([len(kmers[i]) for i in own])
        out = []
        for i in rest if len(own) else []:
            a, b = np.searchsorted(pool, kmers[i], "left"), np.searchsorted(pool, kmers[i], "right")
            n = b - a
            at = np.arange(n.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            shared = np.bincount(owner[at], minlength=len(own))
            # more k-mers in common than a chain can have
            near = shared >= SIMILARITY * (size + len(kmers[i]) - shared)
            near &= (part[own] != part[i]) & (shared > 0)
            for j in own[near]:
                common = chain(kmers[j], kmers[i])
                value = common / (len(kmers[j]) + len(kmers[i]) - common)
                if value >= SIMILARITY:
                    out.append((min(doc[i], doc[j]), max(doc[i], doc[j]), value))
        arrow = block.schema.field("doc").type
        columns = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(x, k) for x, k in zip(columns, (arrow, arrow, pa.float64()))], ["doc1", "doc2", "similarity"])

    dealt = strays.unionByName(others).join(words, "doc")
    found = dealt.groupBy("family", "row", "column").applyInArrow(compare, f"doc1 {kind}, doc2 {kind}, similarity double")
    return found.dropDuplicates(["doc1", "doc2"])


def select(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the smallest id, with its columns."""
    first = classes(docs).where("doc_id = class_id").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text"))
    text = F.md5(F.coalesce("text", F.lit("")))
    marked = docs.withColumn("__text", text)
    whole = marked.where("doc_id is not null").join(
        first.distinct(), (F.col("doc_id") == F.col("__id")) & (marked["__text"] == first["__text"]), "left_semi"
    )
    return whole.dropDuplicates(["doc_id", "__text"]).unionByName(marked.where("doc_id is null")).drop("__text")
