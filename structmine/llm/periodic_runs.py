"""Periodic runs of words, found by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal) and
at least ``max(LEAST, 2 * q)`` words, which no neighbouring word extends.  All runs of every text are found:

* Periods up to ``DIRECT``: the text is compared with itself at each lag.
* Longer ones: a scale covers the periods above ``p`` and up to ``2 * p``.  Its k-mers have a quarter of
  ``p`` words and its windows together span ``p``, so the k-mer that is a window's minimum in the
  run's first period is one again a period later.  Pairs of equal minimizers at such a distance are seeds.
* K-mers that are periodic themselves stand in shorter runs, which are known by then, and are no
  minimizers.  A run whose period holds nothing else joins two such shorter runs; one of them
  ends with a k-mer that has its equal a period away.  Those pairs are seeds as well.
* Each seed is extended word by word; a stretch that a divisor of its lag repeats in is no run of that lag.

Words are told apart by their bytes; hashes only propose seeds.  The non-periodic k-mers that are equal lie
half a k-mer apart at least, so there are at most some dozen partners a minimizer, whatever the text.

Edge cases: a null or blank text has no words and no runs.  Repeated rows are answered each.  A very long
text is one batch.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from structmine.llm import spans
from structmine.llm.shared import texts_of

LEAST = 12
DIRECT = 64

SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, n_kept long, collapsed_sha256 string"
)

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Runs(NamedTuple):
    """Runs ``start[i]:end[i]`` of period ``period[i]``."""

    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


def _stretches(ids: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of at least ``least`` words that repeat at a lag."""
    same = np.zeros(len(ids) - lag + 2, np.int8)
    same[1:-1] = ids[lag:] == ids[:-lag]
    edges = np.flatnonzero(same[1:] != same[:-1])
    start, end = edges[0::2], edges[1::2] + lag
    long = end - start >= least
    return start[long], end[long]


def _prime_factors(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] * (n > 1)


def _within(start: np.ndarray, end: np.ndarray, outer: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which stretches lie in one of ``outer``, whose starts and ends both rise."""
    at = np.searchsorted(outer[0], start, side="right") - 1
    return (at >= 0) & (np.append(outer[1], 0)[at] >= end)


def _direct(ids: np.ndarray, most: int) -> list[Runs]:
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    found = []
    for q in range(1, min(most, len(ids) // 2) + 1):
        start, end = known[q] = _stretches(ids, q, max(LEAST, 2 * q))
        own = np.ones(len(start), bool)
        for p in _prime_factors(q):
            own &= ~_within(start, end, known[q // p])
        if own.any():
            found.append(Runs(start[own], end[own], np.full(int(own.sum()), q, np.int64)))
    return found


def _slide(values: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """The best of every ``width`` neighbours, by doubling."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values = best(values[:-step], values[step:])
        span += step
    return values


def _kmer_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """One hash a k-mer, by doubling: equal k-mers have equal hashes."""
    whole, done = None, 0
    part, size = spans.mix(ids.astype(np.uint64)), 1
    while True:
        if k & size:
            if whole is None:
                whole, done = part, size
            else:
                shared = len(ids) - done - size + 1
                whole = spans.mix(whole[:shared] * _MULTIPLIER + part[done : done + shared])
                done += size
        if done == k:
            return whole
        part, size = spans.mix(part[:-size] * _MULTIPLIER + part[size:]), size * 2


def _close_pairs(key: np.ndarray, at: np.ndarray, near: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places with equal keys, more than ``near`` and at most ``far`` apart."""
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) * (at.max() + far + 1) + at
    first = np.searchsorted(group, group + near, side="right")
    n = np.searchsorted(group, group + far, side="right") - first
    left = np.repeat(np.arange(len(at)), n)
    right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return at[left], at[right]


def _seeds(ids: np.ndarray, known: list[Runs], low: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags to look for runs of periods above ``low`` and up to twice that."""
    k = low // 4
    hashes = _kmer_hashes(ids, k)
    n = len(hashes)
    inside = [(r.start[i], r.end[i] - k) for r in known for i in np.flatnonzero((2 * r.period <= k) & (r.end - r.start >= k))]
    periodic = np.zeros(n + 1, np.int64)
    for first, last in inside:
        periodic[first] += 1
        periodic[last + 1] -= 1
    periodic = np.cumsum(periodic)[:-1] > 0

    value = np.where(periodic, _NONE, hashes)
    width = low - k + 1
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.pad(_slide(value, width, np.minimum), width - 1)
    chosen = np.flatnonzero((_slide(least, width, np.maximum) == value) & ~periodic)
    left, right = _close_pairs(hashes[chosen], chosen, low, 2 * low) if len(chosen) else (chosen, chosen)
    places, lags = [left], [right - left]

    if len(inside) > 1:
        members = np.flatnonzero(periodic)
        order = members[np.lexsort((members, hashes[members]))]
        keys = hashes[order]
        for first, last in inside:
            same = order[np.searchsorted(keys, hashes[last]) : np.searchsorted(keys, hashes[last], side="right")]
            around = np.concatenate([_between(same, last - 2 * low, last - low), _between(same, last + low + 1, last + 2 * low + 1)])
            around = around[(around < first) | (around > last)]
            places.append(np.minimum(around, last))
            lags.append(np.abs(around - last))
    return np.concatenate(places), np.concatenate(lags)


def _between(ordered: np.ndarray, low: int, high: int) -> np.ndarray:
    return ordered[np.searchsorted(ordered, low) : np.searchsorted(ordered, high)]


def _run_of_equals(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal."""
    n, done, step = min(len(a), len(b)), 0, 64
    while done < n:
        differ = a[done : min(n, done + step)] != b[done : min(n, done + step)]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + step, step * 4
    return n


def _reach(sums: np.ndarray, powers: np.ndarray, place: np.ndarray, lag: np.ndarray, way: int) -> np.ndarray:
    """How far words a lag apart have equal hashes, from each place on or back: never less than words are equal."""
    most = len(sums) - 1 - lag - place if way > 0 else place
    done = np.zeros(len(place), np.int64)
    step = 1 << int(most.max(initial=0)).bit_length()
    while step:
        tried = np.minimum(done + step, most)
        a, b = (place, place + tried) if way > 0 else (place - tried, place)
        done = np.where((sums[b] - sums[a]) * powers[lag] == sums[b + lag] - sums[a + lag], tried, done)
        step >>= 1
    return done


def _promising(ids: np.ndarray, places: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """Seeds whose words can repeat for a whole period, by lag, then place."""
    if not len(places):
        return places
    powers = np.full(len(ids) + 1, _MULTIPLIER)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(spans.mix(ids.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    order = np.lexsort((places, lags))
    place, lag = places[order], lags[order]
    return order[_reach(sums, powers, place, lag, 1) + _reach(sums, powers, place, lag, -1) >= lag]


def _extended(ids: np.ndarray, places: np.ndarray, lags: np.ndarray) -> Runs:
    """The runs that the seeds lie in."""
    order = _promising(ids, places, lags)
    found: list[tuple[int, int, int]] = []
    lag, end = 0, 0
    for place, q in zip(places[order].tolist(), lags[order].tolist()):
        if q != lag:
            lag, end = q, 0
        if place < end - q:
            continue
        ahead = _run_of_equals(ids[place:], ids[place + q :])
        back = _run_of_equals(ids[:place][::-1], ids[: place + q][::-1][: place])
        start, end = place - back, place + ahead + q
        if end - start >= max(LEAST, 2 * q) and not any(
            _run_of_equals(ids[start:end], ids[start + q // p : end]) == end - start - q // p for p in _prime_factors(q)
        ):
            found.append((start, end, q))
    columns = np.array(found, np.int64).reshape(-1, 3)
    return Runs(columns[:, 0], columns[:, 1], columns[:, 2])


def _chosen(n: np.ndarray, first: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the sequences chosen, each with the separator after it."""
    size = n[which] + 1
    return np.arange(size.sum()) + np.repeat(first[which] - (np.cumsum(size) - size), size)


def runs_of(parts: list[np.ndarray], direct: int = DIRECT) -> list[Runs]:
    """All runs of each of several sequences of word numbers, by start, then period.

    They are searched as one array in which a number of its own ends each, so no run leaves its sequence;
    a scale takes those that are long enough for it.
    """
    n = np.array([len(p) for p in parts], np.int64)
    first = np.cumsum(n + 1) - (n + 1)
    whole = np.concatenate([x for i, p in enumerate(parts) for x in (p, [-1 - i])]).astype(np.int64)
    longest = int(n.max())
    found = _direct(whole, min(direct, longest // 2))
    low = direct
    while 2 * (low + 1) <= longest:
        which = np.flatnonzero(n >= 2 * (low + 1))
        places = _chosen(n, first, which)
        moved = np.cumsum(n[which] + 1) - (n[which] + 1) - first[which]
        known = []
        for r in found:
            owner = np.searchsorted(first, r.start, side="right") - 1
            at = np.minimum(np.searchsorted(which, owner), len(which) - 1)
            here = which[at] == owner
            known.append(Runs(r.start[here] + moved[at[here]], r.end[here] + moved[at[here]], r.period[here]))
        ids = whole[places]
        new = _extended(ids, *_seeds(ids, known, low))
        found.append(Runs(places[new.start], places[new.end - 1] + 1, new.period))
        low *= 2
    every = Runs(*(np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found))) if found else Runs(*[np.zeros(0, np.int64)] * 3)
    order = np.lexsort((every.period, every.start))
    start, end, period = (c[order] for c in every)
    cuts = np.searchsorted(start, np.append(first, len(whole)))
    return [Runs(start[a:b] - f, end[a:b] - f, period[a:b]) for a, b, f in zip(cuts[:-1], cuts[1:], first)]


def kept_words(n: int, found: Runs) -> np.ndarray:
    """Which words stay where every run keeps its first period only."""
    drop = np.zeros(n + 1, np.int64)
    np.add.at(drop, found.start + found.period, 1)
    np.add.at(drop, found.end, -1)
    return np.cumsum(drop)[:-1] == 0


def _row(ids: np.ndarray, words: list[bytes], found: Runs) -> tuple:
    length = found.end - found.start
    listing = "".join(f"{s},{n},{q}\n" for s, n, q in zip(found.start.tolist(), length.tolist(), found.period.tolist()))
    kept = kept_words(len(ids), found) if len(length) else np.ones(len(ids), bool)
    collapsed = b" ".join([words[i] for i in ids[kept].tolist()])
    best: tuple = (None,) * 4
    if len(length):
        i = np.lexsort((found.period, found.start, -length))[0]
        start, size, q = int(found.start[i]), int(length[i]), int(found.period[i])
        best = (start, size, q, 1000 * size // q)
    return (len(length), *best, sha256(listing.encode()).hexdigest(), int(kept.sum()), sha256(collapsed).hexdigest())


def find(docs: DataFrame, order: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """Runs of each text: their number, the longest, and digests of all of them and of the text without repeats.

    ``order`` takes ``(doc_id, n_words)`` and may give word numbers to read the text's words by instead of
    from first to last.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches, "text"):
            found = spans.texts(batch.column("text"))
            words = spans.runs(found, spans.NOT_SPACE)
            coded = spans.cut_out(found, words.start, words.end).dictionary_encode()
            known, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.searchsorted(words.row, np.arange(found.rows + 1))
            docs_here, parts = batch.column("doc_id").to_pylist(), []
            for i, doc in enumerate(docs_here):
                own = ids[first[i] : first[i + 1]]
                index = order(doc, len(own)) if order and len(own) else None
                parts.append(own if index is None else own[index])
            rows = [(doc, len(own), *_row(own, known, r)) for doc, own, r in zip(docs_here, parts, runs_of(parts))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*rows)], _NAMES
            )

    return texts_of(docs).mapInArrow(scan, SCHEMA)


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
