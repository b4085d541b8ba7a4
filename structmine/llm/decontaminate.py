"""Benchmark decontamination by SimHash of item-sized windows.

Words are lower-cased runs of letters and digits.  An item of ``n`` words is a bag of its shingles of
five words (of ``n`` words where it has fewer).  A window of ``n`` words of a document, or the whole of a document of fewer
words, matches the item where their weighted similarity, the sum of the lesser counts over the sum of the greater, is 0.8 or
more.

1. Windows of the items' sizes get a 64-bit SimHash of their shingles.  Windows that can't reach the
   similarity, as too few of their shingles stand in any item, are passed over first; that loses none.
2. Multi-index Hamming lookup: fingerprints are cut into four blocks of 16 bits; two fingerprints within
   ``RADIUS`` = 19 bits agree in some block but for four bits, so a table of every block's values within
   four bits of the items' finds all items within the radius.
3. The exact weighted similarity of each window and item found decides.
4. A document of fewer words than an item is one window for it: such documents with enough shingles in the items
   get the exact similarity to all items that share one, so none is missed.

At a similarity of 0.8 fingerprints differ by 10 bits on average (standard deviation 3), beyond the radius
in less than one case of a thousand.  Items are a query set: they are taken in blocks of ``BLOCK_ITEMS``, so what is
sent to the tasks is bounded, and documents are read once a block and never shuffled.

Edge cases: a null or empty text or item matches nothing; items of equal text are reported each; repeated
rows of documents are reported each; without items or documents the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structmine.llm import spans

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS, NEAR = 4, 16, 4
RADIUS = BLOCKS * (NEAR + 1) - 1
BLOCK_ITEMS = 1000
#: Shingles of windows whose bits are added up at a time.
AT_ONCE = 1 << 19


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    found = spans.texts(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    words = spans.runs(found, spans.ALPHANUMERIC)
    return spans.Hasher(found.data).of(words.start, words.end), words.row, found.rows


def simhash(shingles: np.ndarray) -> np.ndarray:
    """One fingerprint a row of shingle hashes: a bit is set where most shingles have it."""
    rows, n = shingles.shape
    out = np.zeros(rows, np.uint64)
    step = max(1, AT_ONCE // max(n, 1))
    for a in range(0, rows, step):
        part = np.ascontiguousarray(shingles[a : a + step])
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), n, 8), axis=2).sum(axis=1, dtype=np.int64)
        out[a : a + step] = np.packbits(2 * bits > n, axis=1).reshape(-1).view(np.uint64)
    return out


def _near_masks() -> np.ndarray:
    """All values of a block with at most ``NEAR`` bits set."""
    masks = [sum(1 << b for b in bits) for k in range(NEAR + 1) for bits in combinations(range(BLOCK_BITS), k)]
    return np.array(masks, np.int64)


class ItemIndex:
    """The items of one block: bags of shingles, fingerprints and the block tables."""

    def __init__(self, ids: list, texts: list[str | None], similarity: float):
        self.similarity = similarity
        hashes, row, rows = _hashed(pa.array(texts, pa.large_string()))
        size = np.bincount(row, minlength=rows)
        ends = np.concatenate([[0], np.cumsum(size)])
        known = [i for i in range(rows) if size[i]]
        self.ids = [ids[i] for i in known]
        self.words = size[known].astype(np.int64)
        self.bags, prints = [], []
        for i in known:
            own = hashes[ends[i] : ends[i + 1]]
            shingles, _ = spans.grams(own, np.zeros(len(own), np.int64), min(SHINGLE, len(own)))
            self.bags.append(np.unique(shingles, return_counts=True))
            prints.append(simhash(shingles[None, :])[0])
        self.prints = np.array(prints, np.uint64)
        self.sizes = np.unique(self.words)
        # shingles by how many words they have: shorter items have shorter ones
        self.shingles = {
            k: np.unique(np.concatenate([b[0] for b, w in zip(self.bags, self.words) if min(w, SHINGLE) == k]))
            for k in sorted({min(int(w), SHINGLE) for w in self.words})
        }
        self.tables = [self._table(b) for b in range(BLOCKS)]
        # the items of each shingle of five words, and how often they have it
        five = [i for i, w in enumerate(self.words) if w > SHINGLE]
        kinds, counts = (np.concatenate([np.zeros(0, t), *(self.bags[i][k] for i in five)]) for k, t in ((0, np.uint64), (1, np.int64)))
        items = np.repeat(np.array(five, np.int64), [len(self.bags[i][0]) for i in five])
        order = np.argsort(kinds, kind="stable")
        self.postings = kinds[order], items[order], counts[order]

    def _block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def _table(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        masks = _near_masks()
        values = (self._block(self.prints, b)[:, None] ^ masks[None, :]).ravel()
        order = np.argsort(values, kind="stable")
        starts = np.searchsorted(values[order], np.arange((1 << BLOCK_BITS) + 1))
        return starts, (order // len(masks)).astype(np.int32)

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (print, item) of all items within the radius of each fingerprint."""
        pairs = []
        for b, (starts, items) in enumerate(self.tables):
            value = self._block(prints, b)
            first, n = starts[value], starts[value + 1] - starts[value]
            at = np.arange(n.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            pairs.append(np.repeat(np.arange(len(prints)), n) * len(self.ids) + items[at])
        window, item = np.divmod(np.unique(np.concatenate(pairs)), max(len(self.ids), 1))
        near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[near], item[near]

    def weighted_similarity(self, shingles: np.ndarray, item: int) -> float:
        kinds, counts = self.bags[item]
        own, n = np.unique(shingles, return_counts=True)
        _, i, j = np.intersect1d(kinds, own, assume_unique=True, return_indices=True)
        shared = np.minimum(counts[i], n[j]).sum()
        return float(shared / (counts.sum() + n.sum() - shared))

    def matches(self, column: pa.Array) -> dict[tuple[int, int], tuple[float, int, int, int]]:
        """By (row, item): the best similarity, its window's first word and distance in bits, and the windows that match."""
        found: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        hashes, row, _ = _hashed(column)
        place = spans.numbered(row)
        for k, known in self.shingles.items():
            shingles, owner = spans.grams(hashes, row, k)
            if not len(shingles):
                continue
            at = np.searchsorted(known, shingles)
            hit = (known[np.minimum(at, len(known) - 1)] == shingles) & (owner >= 0)
            if not hit.any():
                continue
            hits = np.concatenate([[0], np.cumsum(hit)])
            for words in self.sizes[np.minimum(self.sizes, SHINGLE) == k]:
                self._windows(int(words), k, shingles, hashes, row, hits, place, found)
            if k == SHINGLE:
                self._whole(shingles, row, hits, found)
        return found

    def _windows(self, words, k, shingles, hashes, row, hits, place, found) -> None:
        n = words - k + 1
        if len(hashes) < words:
            return
        # a share s of two bags of n means at least 2 n s / (1 + s) shared shingles
        enough = np.ceil(2 * n * self.similarity / (1 + self.similarity) - 1e-9)
        start = np.flatnonzero((hits[n:] - hits[:-n] >= enough) & (row[: len(hashes) - words + 1] == row[words - 1 :]))
        for a in range(0, len(start), max(1, AT_ONCE // n)):
            first = start[a : a + max(1, AT_ONCE // n)]
            bags = shingles[first[:, None] + np.arange(n)]
            prints = simhash(bags)
            for w, item in zip(*(x.tolist() for x in self.within_radius(prints))):
                if self.words[item] != words:
                    continue
                similarity = self.weighted_similarity(bags[w], item)
                if similarity >= self.similarity:
                    key = (int(row[first[w]]), item)
                    best = found.get(key, (0.0, 0, 0, 0))
                    bits = int(np.bitwise_count(prints[w] ^ self.prints[item]))
                    own = (similarity, int(place[first[w]]), bits)
                    found[key] = (*(own if similarity > best[0] else best[:3]), best[3] + 1)


    def _whole(self, shingles, row, hits, found) -> None:
        """Texts of fewer words than an item, each as one window."""
        rows, first, words = np.unique(row, return_index=True, return_counts=True)
        n = words - SHINGLE + 1
        # the next larger item has one shingle more at least
        enough = np.ceil((2 * n + 1) * self.similarity / (1 + self.similarity) - 1e-9)
        short = np.flatnonzero((n > 0) & (words < self.words.max()))
        short = short[hits[first[short] + n[short]] - hits[first[short]] >= enough[short]]
        kinds, items, counts = self.postings
        for i in short:
            own = shingles[first[i] : first[i] + n[i]]
            each, times = np.unique(own, return_counts=True)
            a = np.searchsorted(kinds, each, "left")
            held = np.searchsorted(kinds, each, "right") - a
            at = np.arange(held.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(held)[:-1]]), held)
            shared = np.bincount(items[at], np.minimum(counts[at], np.repeat(times, held)), len(self.ids))
            similarity = shared / (np.maximum(self.words - SHINGLE + 1, 1) + n[i] - shared)
            near = np.flatnonzero((self.words > words[i]) & (shared > 0) & (similarity >= self.similarity))
            if len(near):
                bits = np.bitwise_count(simhash(own[None, :])[0] ^ self.prints[near])
                for item, b in zip(near.tolist(), bits.tolist()):
                    found[int(rows[i]), item] = (float(similarity[item]), 0, b, 1)


def item_indexes(items: DataFrame, similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS) -> Iterator[ItemIndex]:
    """The items in blocks that are bounded whatever their number."""
    items = items.select("item_id", "text")
    blocks = max(1, -(-items.count() // block_items))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        rows = sorted(dealt.where(F.col("block") == b).collect(), key=lambda r: (str(r["item_id"]), r["text"] or ""))
        yield ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], similarity)


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, bits, n_windows`` of every document and item that match."""
    doc_kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (items, "item_id")))
    schema = f"doc_id {doc_kind}, item_id {item_kind}, similarity double, first_word long, bits int, n_windows long"
    arrow_kind = docs.sparkSession.createDataFrame([], f"item_id {item_kind}").toArrow().schema.field(0).type
    wanted = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = None
    for index in item_indexes(items, similarity):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in spans.slices(batches, "text"):
                rows = sorted(own.matches(batch.column("text")).items())
                if rows:
                    ids = pa.array([own.ids[item] for (_, item), _ in rows], arrow_kind)
                    values = [list(x) for x in zip(*(v for _, v in rows))]
                    kinds = (pa.float64(), pa.int64(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take([r for (r, _), _ in rows]), ids, *map(pa.array, values, kinds)],
                        ["doc_id", "item_id", "similarity", "first_word", "bits", "n_windows"],
                    )

        part = wanted.mapInArrow(match, schema)
        found = part if found is None else found.unionByName(part)
    return found


def select(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that match no item, with their columns."""
    for index in item_indexes(items, similarity):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in spans.slices(batches, "text"):
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, _ in sent.value.matches(batch.column("text"))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
