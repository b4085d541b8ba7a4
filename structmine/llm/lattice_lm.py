"""Language-model scores by the likelihood of the subword lattice.

The pieces of an existing subword vocabulary weight every way of cutting a word into pieces; the sum over
all of them, by forward recursion in log space, is the word's probability under the pieces.  Words are
lower-cased (A-Z) runs of characters other than white space, each with a word start before it; a document
is its words and one end.  Pieces never reach over a word's ends, so a distinct word is scored once and a
document's log-probability is the sum over its words.  A word met in training is one more edge over its
whole lattice, weighted by its count less ``DISCOUNT``; what the discounts leave goes to the pieces:

    P(word) = max(c - DISCOUNT, 0) / N + (DISCOUNT * distinct words / N) * P(word by pieces)
    P(end) = training documents / N

with ``c`` and ``N`` counted over the training documents.  All words and the end sum to 1.

Piece probabilities start from the vocabulary's scores (a rank, so 1 / (rank + 10)) and are re-estimated
by ``ROUNDS`` rounds of expectation-maximisation over all distinct training words, each counted once, as
the pieces stand in for words seldom or never met; what meets in the driver is one number a piece, bounded
by the vocabulary.  Every single byte is a piece, so every word has a probability.

How it runs: tasks cut their documents into chunks of ``CHUNK_BYTES`` of text and write each chunk's
distinct words and each document's word numbers and counts.  Words are counted over all chunks, scored,
and joined back to the chunks, so a frequent word moves once a chunk and not once an occurrence; texts
never move.

Edge cases: a null or empty text is its end alone; a null id belongs to the training documents; without
training documents the base score has only its smoothing (N = V = 0), and words and the end have the
probabilities of the pieces alone, the end that of one in ``FIRST_END``; repeated rows are scored each; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structmine.llm import spans
from structmine.llm.shared import kept

CHUNK_BYTES = 32 * 1024 * 1024
ROUNDS = 2
DISCOUNT = 0.75
FIRST_END = 500
#: Longer words go through the recursion one at a time.
LONG_WORD = 128
WORDS_AT_ONCE = 4096
_BASE = np.uint64(0xA24BAED4963EE407)
_START = 32  # a word start stands for the byte of a space, which no word holds


class Pieces(NamedTuple):
    """Pieces by hash, in order; ``first`` are their probabilities from the vocabulary's scores."""

    hashes: np.ndarray
    lengths: np.ndarray
    first: np.ndarray

    @property
    def longest(self) -> int:
        return int(self.lengths.max())


def pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece file as bytes, with a word start at most in front."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    size, mark = model.get_piece_size(), "▁"
    weight = {bytes([b]): 1 / (size + 10) for b in range(256)}
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or mark in piece[1:]:
            continue
        own = (b" " if piece[0] == mark else b"") + piece.removeprefix(mark).encode()
        weight[own] = weight.get(own, 0) + 1 / (max(0.0, -model.get_score(i)) + 10)
    texts = sorted(weight)
    hashes = np.array([_hash(t) for t in texts], np.uint64)
    order = np.argsort(hashes)
    first = np.array([weight[t] for t in texts])
    return Pieces(hashes[order], np.array([len(t) for t in texts])[order], (first / first.sum())[order])


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _hash(text: bytes) -> int:
    value = 0
    for byte in text:
        value = (value * int(_BASE) + byte + 1) & 0xFFFFFFFFFFFFFFFF
    return value


class Lattice:
    """The lattices of words of one length: ``words`` is one row of bytes a word, the word start first."""

    def __init__(self, known: Pieces, words: np.ndarray):
        self.rows, self.n = words.shape
        self.edges: list[tuple[int, np.ndarray, np.ndarray]] = []  # by length: piece at each start, and whether there is one
        rolled = np.zeros((self.rows, self.n + 1), np.uint64)
        for i in range(self.n):
            rolled[:, i + 1] = rolled[:, i] * _BASE + words[:, i].astype(np.uint64) + np.uint64(1)
        up = _powers(self.n)
        for length in range(1, min(self.n, known.longest) + 1):
            value = rolled[:, length:] - rolled[:, : self.n + 1 - length] * up[length]
            at = np.minimum(np.searchsorted(known.hashes, value), len(known.hashes) - 1)
            self.edges.append((length, at, (known.hashes[at] == value) & (known.lengths[at] == length)))

    def forward(self, logs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Log of the summed probability of all ways to each place, and the edges' logs."""
        weights = [np.where(there, logs[at], -np.inf) for _, at, there in self.edges]
        alpha = np.full((self.rows, self.n + 1), -np.inf)
        alpha[:, 0] = 0
        for t in range(1, self.n + 1):
            for (length, _, _), weight in zip(self.edges, weights):
                if length > t:
                    break
                alpha[:, t] = np.logaddexp(alpha[:, t], alpha[:, t - length] + weight[:, t - length])
        return alpha, weights

    def expected(self, logs: np.ndarray, count: np.ndarray) -> np.ndarray:
        """How often each piece is used over all ways, weighted by the words' counts."""
        alpha, weights = self.forward(logs)
        beta = np.full((self.rows, self.n + 1), -np.inf)
        beta[:, self.n] = 0
        for t in range(self.n - 1, -1, -1):
            for (length, _, _), weight in zip(self.edges, weights):
                if t + length > self.n:
                    break
                beta[:, t] = np.logaddexp(beta[:, t], beta[:, t + length] + weight[:, t])
        out = np.zeros(len(logs))
        for (length, at, there), weight in zip(self.edges, weights):
            share = np.exp(alpha[:, : self.n + 1 - length] + weight + beta[:, length:] - alpha[:, -1:])
            used = share * count[:, None]
            out += np.bincount(at[there], weights=used[there], minlength=len(logs))
        return out


def _long(known: Pieces, word: np.ndarray, logs: np.ndarray, count: float | None):
    """The same for one long word, edge by edge: its log-probability, or the expected counts."""
    lattice = Lattice(known, word[None, :])
    found = [np.stack([np.flatnonzero(there[0]), np.full(there.sum(), length), at[0][there[0]]]) for length, at, there in lattice.edges]
    start, length, piece = np.concatenate(found, axis=1)
    order = np.argsort(start + length, kind="stable")
    edges = list(zip(start[order].tolist(), (start + length)[order].tolist(), piece[order].tolist()))
    n, add = len(word), np.logaddexp
    alpha = [0.0] + [-np.inf] * n
    for a, b, p in edges:
        alpha[b] = float(add(alpha[b], alpha[a] + logs[p]))
    if count is None:
        return alpha[n]
    beta, out = [-np.inf] * n + [0.0], np.zeros(len(logs))
    for a, b, p in sorted(edges, key=lambda e: -e[0]):
        beta[a] = float(add(beta[a], beta[b] + logs[p]))
    for a, b, p in edges:
        out[p] += count * np.exp(alpha[a] + logs[p] + beta[b] - alpha[n])
    return out


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of words of equal length, and the words as bytes with the word start in front."""
    found = spans.texts(column)
    size = np.diff(found.offsets)
    order = np.argsort(size, kind="stable")
    limits = np.flatnonzero(np.diff(size[order])) + 1
    for rows in np.split(order, limits):
        for a in range(0, len(rows), WORDS_AT_ONCE):
            part = rows[a : a + WORDS_AT_ONCE]
            words = np.full((len(part), (size[part[0]] if len(part) else 0) + 1), _START, np.uint8)
            words[:, 1:] = found.data[found.offsets[part][:, None] + np.arange(words.shape[1] - 1)]
            yield part, words


def log_probabilities(known: Pieces, logs: np.ndarray, column: pa.Array) -> np.ndarray:
    """Natural log of each word's probability, the end not counted."""
    out = np.zeros(len(column))
    for rows, words in _by_length(column):
        if words.shape[1] > LONG_WORD:
            out[rows] = [_long(known, w, logs, None) for w in words]
        elif len(rows):
            out[rows] = Lattice(known, words).forward(logs)[0][:, -1]
    return out


def expected_counts(known: Pieces, logs: np.ndarray, column: pa.Array, count: np.ndarray) -> np.ndarray:
    out = np.zeros(len(logs))
    for rows, words in _by_length(column):
        if words.shape[1] > LONG_WORD:
            for row, word in zip(rows, words):
                out += _long(known, word, logs, float(count[row]))
        elif len(rows):
            out += Lattice(known, words).expected(logs, count[rows])
    return out


# -- tables ----------------------------------------------------------------------------------------

_CHUNKS = (
    "chunk long, number int, word string, n_train long, held_out boolean, n_words long, numbers binary, counts binary"
)


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """For each chunk a row a distinct word (number, word, n_train) and a row a document (doc_id, held_out,
    n_words, and the numbers and counts of its distinct words)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        chunk, parts, size = 0, [], 0
        for batch in spans.slices(batches, "text"):
            found = spans.texts(batch.column("text"), lower=True)
            parts.append(_slice(found, batch))
            size += len(found.data)
            if size >= chunk_bytes:
                yield from _chunk((task << 32) + chunk, parts)
                chunk, parts, size = chunk + 1, [], 0
        if parts:
            yield from _chunk((task << 32) + chunk, parts)

    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10))
    wanted = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(remainder == 0, F.lit(False)).alias("held_out")
    )
    return wanted.mapInArrow(cut, f"doc_id {kind}, {_CHUNKS}")


def _slice(found: spans.Texts, batch: pa.RecordBatch):
    """Distinct words of a slice with their training counts, and (document, word) cells with counts."""
    words = spans.runs(found, spans.NOT_SPACE)
    which, _, distinct = spans.coded(found, words.start, words.end)
    training = ~batch.column("held_out").to_numpy(zero_copy_only=False)
    n_train = np.bincount(which, weights=training[words.row], minlength=len(distinct)).astype(np.int64)
    cell, count = np.unique(words.row * max(len(distinct), 1) + which, return_counts=True)
    row, word = np.divmod(cell, max(len(distinct), 1))
    return batch.select(["doc_id", "held_out"]), distinct, n_train, row, word, count, spans.count_rows(words.row, found.rows)


def _chunk(chunk: int, parts: list) -> Iterator[pa.RecordBatch]:
    coded = pa.concat_arrays([p[1] for p in parts]).dictionary_encode()
    which, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    n_train = np.bincount(which, weights=np.concatenate([p[2] for p in parts]), minlength=len(distinct))
    texts = distinct.view(pa.large_string())
    id_kind = parts[0][0].schema.field("doc_id").type
    names = ["doc_id", *(c.split(" ")[0] for c in _CHUNKS.split(", "))]
    kinds = [id_kind, pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]

    def made(n: int, **columns) -> pa.RecordBatch:
        columns["chunk"] = pa.array(np.full(n, chunk))
        arrays = [columns[x].cast(k) if x in columns else pa.nulls(n, k) for x, k in zip(names, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names)

    step = 50_000
    for a in range(0, len(distinct), step):
        b = min(a + step, len(distinct))
        yield made(b - a, number=pa.array(np.arange(a, b)), word=texts[a:b], n_train=pa.array(n_train[a:b].astype(np.int64)))
    at = 0
    for docs, own, _, row, word, count, n_words in parts:
        numbers = which[at : at + len(own)][word].astype("<u4")
        at += len(own)
        ends = np.searchsorted(row, np.arange(docs.num_rows + 1)).tolist()
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())  # noqa: E731, B023
        yield made(
            docs.num_rows, doc_id=docs.column("doc_id"), held_out=docs.column("held_out"), n_words=pa.array(n_words),
            numbers=cut(numbers), counts=cut(count.astype("<u4")),
        )


class Model(NamedTuple):
    """Logs of the pieces' probabilities, which sum to 1; counts of training tokens and distinct words, and
    log-probabilities of the end and of leaving a word to the pieces."""

    known: Pieces
    logs: np.ndarray
    n: int
    end: float
    rest: float

    def words(self, column: pa.Array, c: np.ndarray) -> np.ndarray:
        """Natural logs of the words' probabilities, by their training counts."""
        own = np.log(np.maximum(c - DISCOUNT, 0) / max(self.n, 1), out=np.full(len(c), -np.inf), where=c > 0)
        return np.logaddexp(own, self.rest + log_probabilities(self.known, self.logs, column))


def train(counts: DataFrame, known: Pieces, n: int, distinct: int, ends: int, rounds: int = ROUNDS) -> Model:
    """From ``counts`` (word, c): ``n`` training tokens with ``ends`` ends, and ``distinct`` words."""
    sc, logs = counts.sparkSession.sparkContext, np.log(known.first)
    for _ in range(rounds if distinct else 0):
        sent = sc.broadcast((known, logs))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, at = sent.value
            total = np.zeros(len(at))
            for batch in batches:
                total += expected_counts(own, at, batch.column("word"), np.ones(batch.num_rows))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

        used = counts.where("c > 0").select("word").mapInArrow(expect, "piece long, n double")
        rows = used.groupBy("piece").agg(F.sum("n").alias("n")).collect()
        total = np.zeros(len(logs))
        total[[r["piece"] for r in rows]] = [r["n"] for r in rows]
        # the vocabulary's own probabilities count as a hundredth of the pieces seen
        total += known.first * (0.01 * total.sum() + 1)
        logs = np.log(total / total.sum())
    if not ends:
        return Model(known, logs, 0, float(-np.log(FIRST_END)), float(np.log1p(-1 / FIRST_END)))
    rest = DISCOUNT * distinct / n if distinct else 1e-9
    return Model(known, logs, n, float(np.log(ends / n)), float(np.log(rest)))


def score(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = kept(chunked(docs), "lattice-chunks")
    words = rows.where("word is not null").select("chunk", "number", "word", "n_train")
    documents = rows.where("word is null").select("chunk", "doc_id", "held_out", "n_words", "numbers", "counts")
    counts = kept(words.groupBy("word").agg(F.sum("n_train").alias("c")), "word-counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = documents.where("not held_out").count()
    n, v = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
    model = train(counts, pieces(vocabulary), n, totals["v"], ends, rounds)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            logs = pa.array(own.words(batch.column("word"), batch.column("c").to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), logs], ["word", "c", "log"])

    weighed = counts.mapInArrow(weigh, "word string, c long, log double")
    back = words.select("chunk", "number", "word").join(weighed, "word").select("chunk", "number", "c", "log")
    smooth, of_end = n + 0.1 * (v + 1), float(np.log10((ends + 0.1) / (n + 0.1 * (v + 1))))

    def add_up(own: pa.Table, weights: pa.Table) -> pa.Table:
        size = weights.num_rows
        base, logs, seen = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
        number, c = weights.column("number").to_numpy(), weights.column("c").to_numpy()
        base[number], logs[number], seen[number] = np.log10((c + 0.1) / smooth), weights.column("log").to_numpy(), c > 0
        numbers, counts = own.column("numbers").to_pylist(), own.column("counts").to_pylist()
        sums = np.zeros((own.num_rows, 3))
        for i, (x, k) in enumerate(zip(numbers, counts)):
            x, k = np.frombuffer(x, "<u4"), np.frombuffer(k, "<u4").astype(float)
            sums[i] = k @ base[x], k @ logs[x], k @ seen[x]
        rows = own.num_rows
        return pa.table(
            {
                "doc_id": own.column("doc_id"),
                "held_out": own.column("held_out"),
                "n_tokens": pa.array(own.column("n_words").to_numpy() + 1),
                "n_known": pa.array(sums[:, 2].astype(np.int64) + (ends > 0)),
                "train_tokens": pa.array(np.full(rows, n, np.int64)),
                "base_score": pa.array(sums[:, 0] + of_end),
                "score": pa.array((sums[:, 1] + sent.value.end) / np.log(10)),
            }
        )

    schema = (
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    documents = documents.withColumn("own_chunk", F.col("chunk")).drop("chunk")
    return documents.groupBy("own_chunk").cogroup(back.groupBy("chunk")).applyInArrow(add_up, schema)
