"""Licence scans by a positional index of rare words.

Words are lower-cased (A-Z) runs of letters and digits.  Licence templates are indexed by word and
position.  A file is looked up by its highest-IDF words of a template: their postings are intersected by
relative position (file position less template position), places where at least two of them agree are
candidates, and a candidate counts where each of the template's mandatory key phrases stands nearby.
Inverse document frequencies of the templates' words are counted over all documents.

Beside that, ``BASE`` phrases give labels wherever their words stand consecutively.  The score of a
document is the largest IDF-weighted share of a template's words that stand at their places, 0.5 where
only a base phrase was found, 0 where nothing was.

Two passes read the texts and neither shuffles them; what meets in the driver is one number for each
template word.  Edge cases: a null or empty text has no words and empty labels; repeated rows are scanned
each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structmine.llm import spans

# Phrases and labels of the base scan.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Notices of common licences, with the label and the key phrases that must stand there.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the terms of the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files to deal in the software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license",
        ("apache license", "except in compliance with the license"),
    ),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    (
        "gpl",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation",
        ("gnu general public license", "free software foundation"),
    ),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        ("redistribution and use in source and binary forms", "conditions are met"),
    ),
    ("bsd", "licensed under the bsd 3 clause license", ("bsd 3 clause",)),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license", "source code form"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "for any purpose with or without fee"),
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    (
        "cc-by-nc",
        "licensed under the creative commons attribution noncommercial 4 0 international license",
        ("creative commons attribution noncommercial",),
    ),
    (
        "cc-by",
        "licensed under the creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0",),
    ),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
)

#: Highest-IDF words of a template that a file is looked up by, and how many must agree on a place.
ANCHORS, AGREE = 4, 2
#: Words a key phrase may lie before or behind its template's place.
NEARBY = 10


class Template(NamedTuple):
    label: str
    words: np.ndarray
    phrases: tuple[np.ndarray, ...]


class LicenceIndex:
    """Words by number, templates as numbers, postings by word."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        texts = [t for _, text, phrases in templates for t in (text, *phrases)] + [p for p, _ in base]
        self.vocabulary = sorted({w for t in texts for w in t.split()})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        numbers = lambda text: np.array([number[w] for w in text.split()], np.int64)
        self.templates = [Template(label, numbers(text), tuple(map(numbers, phrases))) for label, text, phrases in templates]
        self.base = [(numbers(p), label) for p, label in base]
        self.idf = np.ones(len(self.vocabulary))
        hashes = self._hash(pa.array(self.vocabulary))[0]
        self._order = np.argsort(hashes)
        self._hashes = hashes[self._order]

    @staticmethod
    def _hash(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
        found = spans.texts(column, lower=True)
        words = spans.runs(found, spans.ALPHANUMERIC)
        return spans.Hasher(found.data).of(words.start, words.end), words.row, found.rows

    def numbers(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of the texts its number, or -1, and its row; and the words by row."""
        hashes, row, rows = self._hash(column)
        at = np.minimum(np.searchsorted(self._hashes, hashes), len(self._hashes) - 1)
        known = np.where(self._hashes[at] == hashes, self._order[at], -1)
        return known, row, spans.count_rows(row, rows)

    def present(self, known: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        found = np.zeros((rows, len(self.vocabulary)), bool)
        found[row[known >= 0], known[known >= 0]] = True
        return found

    def places(self, known: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """Where the words of a phrase stand consecutively within a text; looked up by its rarest word."""
        rarest = int(np.argmax(self.idf[phrase]))
        start = np.flatnonzero(known == phrase[rarest]) - rarest
        start = start[(start >= 0) & (start + len(phrase) <= len(known))]
        for i, word in enumerate(phrase):
            start = start[known[start + i] == word]
        return start[row[start] == row[start + len(phrase) - 1]]

    def template_labels(self, known: np.ndarray, row: np.ndarray, ends: np.ndarray) -> dict[int, dict[str, float]]:
        """By row, the labels of templates that are there and their best scores."""
        out: dict[int, dict[str, float]] = {}
        present = self.present(known, row, len(ends) - 1)
        for template in self.templates:
            # a file without all words of the key phrases can't pass the last step
            keys = np.unique(np.concatenate(template.phrases))
            for r in np.flatnonzero(present[:, keys].all(axis=1)):
                score = self._best(known[ends[r] : ends[r + 1]], present[r], template)
                if score > 0:
                    own = out.setdefault(int(r), {})
                    own[template.label] = max(score, own.get(template.label, 0.0))
        return out

    def _best(self, known: np.ndarray, present: np.ndarray, template: Template) -> float:
        words = np.unique(template.words)
        words = words[present[words]]
        anchors = words[np.lexsort((words, -self.idf[words]))][:ANCHORS]
        shifts = []
        for word in anchors:
            at, posting = np.flatnonzero(known == word), np.flatnonzero(template.words == word)
            shifts.append(np.unique(at[:, None] - posting[None, :]))
        place, agreed = np.unique(np.concatenate(shifts), return_counts=True)
        row = np.zeros(len(known), np.int64)
        best, weight = 0.0, self.idf[template.words]
        phrases = [self.places(known, row, p) for p in template.phrases] if (agreed >= AGREE).any() else []
        for shift in place[agreed >= AGREE]:
            near = [((p >= shift - NEARBY) & (p <= shift + len(template.words) + NEARBY)).any() for p in phrases]
            if all(near):
                at = shift + np.arange(len(template.words))
                inside = (at >= 0) & (at < len(known))
                there = inside.copy()
                there[inside] = known[at[inside]] == template.words[inside]
                best = max(best, float((weight * there).sum() / weight.sum()))
        return best


def weighed(docs: DataFrame, index: LicenceIndex) -> LicenceIndex:
    """The index with inverse document frequencies of its words over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(index.vocabulary), np.int64), 0
        for batch in spans.slices(batches, "text"):
            known, row, size = index.numbers(batch.column("text"))
            total += index.present(known, row, len(size)).sum(axis=0)
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.append(rows, total))], ["word", "n"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    found = texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in found}
    seen = np.array([n.get(i, 0) for i in range(len(index.vocabulary))])
    index.idf = np.log((n.get(-1, 0) + 1) / (seen + 1)) + 1e-3
    return index


def scan(docs: DataFrame, index: LicenceIndex | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weighed(docs, index or LicenceIndex()))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in spans.slices(batches, "text"):
            known, row, n_words = own.numbers(batch.column("text"))
            rows, ends = len(n_words), np.concatenate([[0], np.cumsum(n_words)])
            hits = [(own.places(known, row, phrase), label) for phrase, label in own.base]
            at = np.concatenate([p for p, _ in hits])
            owner, place = row[at], at - ends[row[at]]
            n_base = np.bincount(owner, minlength=rows)
            first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
            np.minimum.at(first, owner, place)
            np.maximum.at(last, owner, place)
            base = [set() for _ in range(rows)]
            for places, label in hits:
                for r in np.unique(row[places]):
                    base[r].add(label)
            more = own.template_labels(known, row, ends)
            labels = [sorted(base[r] | more.get(r, {}).keys()) for r in range(rows)]
            scores = [max([0.5 if base[r] else 0.0, *more.get(r, {}).values()]) for r in range(rows)]
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n_words), pa.array(n_base), pa.array(first, mask=none),
                    pa.array(last, mask=none), pa.array([",".join(sorted(b)) for b in base]),
                    pa.array([",".join(x) for x in labels]), pa.array(scores, pa.float64()),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        look,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double",
    )
