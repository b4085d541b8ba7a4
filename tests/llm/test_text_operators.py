"""Classifier, toxicity, rules and licences: held-out accuracy, brute force and edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from structmine.llm import licence_scan, ordinal, quality_classifier, quality_rules, spans, toxicity

from .conftest import EDGES, MORSE, TWIN

RANDOM = random.Random(5)
WORDS = ["the", "of", "river", "stone", "Winter", "light,", "walks", "home.", "été", "grün", "many", "birds"]


def prose(n):
    return " ".join(RANDOM.choice(WORDS) for _ in range(n))


def junk(n):
    return " ".join(RANDOM.choice(WORDS) + "$$$" for _ in range(n))


def test_words_lines_and_hashes():
    texts = ["", "A b\n\nc", None, "é x\x1cy  z ", "A b"]
    found = spans.texts(pa.array(texts))
    words = spans.runs(found, spans.NOT_SPACE)
    cut = [bytes(found.data[a:b]).decode() for a, b in zip(words.start, words.end)]
    assert cut == ["A", "b", "c", "é", "x\x1cy", "z", "A", "b"] and words.row.tolist() == [1, 1, 1, 3, 3, 3, 4, 4]
    hashes = spans.Hasher(found.data).of(words.start, words.end)
    assert hashes[0] == hashes[6] and hashes[1] == hashes[7] and len(set(hashes.tolist())) == 6
    lines = spans.lines(found)
    assert Counter(lines.row.tolist()) == {0: 1, 1: 3, 2: 1, 3: 1, 4: 1}


def test_quality_classifier(documents, spark):
    rows = [(i, junk(60) if i % 3 == 0 else prose(60) + (" idiot fool" if i % 3 == 1 else "")) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 1)) for i in range(120)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    model = quality_classifier.train(docs, labels)
    assert model.grades.tolist() == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    held_out = [r for r in quality_classifier.score(docs, model).collect() if r["doc_id"] >= 120]
    assert all(r["selected"] == (r["doc_id"] % 3 != 0) for r in held_out)
    mean = lambda k: np.mean([r["expected_grade"] for r in held_out if r["doc_id"] % 3 == k])
    assert mean(0) < mean(1) < mean(2)
    kept = quality_classifier.select(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] % 3 for r in kept.collect()} == {1, 2}


def test_toxicity(documents, spark):
    rows = [(i, prose(80) + (" idiot scum" if i % 5 == 0 else "")) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    scored = toxicity.score(docs, toxicity.train(docs, labels)).where("doc_id >= 400").collect()
    assert all(r["toxic"] == (r["doc_id"] % 5 == 0) for r in scored) and len(scored) == 200


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_classifiers_edges(module, documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = module.train(documents(EDGES), none)
    assert module.score(documents(EDGES), model).count() == len(EDGES)
    one = spark.createDataFrame([(4, 1, 0), (2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert module.score(documents([]), module.train(documents(EDGES), one)).count() == 0


def test_no_ratings_keep_all(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(EDGES)
    assert quality_classifier.select(docs, quality_classifier.train(docs, none)).count() == len(EDGES)


def test_thresholds_follow_shares():
    """Without features, the fitted thresholds are the logits of the grades' shares."""
    grade = np.repeat([0, 1, 2], [20, 30, 50])
    none = np.zeros(0)
    model = ordinal.fit(none.astype(int), none.astype(int), none, grade, 4)
    assert np.allclose(model.thresholds, [np.log(0.2 / 0.8), np.log(0.5 / 0.5)], atol=0.02)


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return [len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)]


def test_rule_statistics_by_brute_force():
    texts = [t for _, t in EDGES[:4]] + ["".join(RANDOM.choice("ab\n \t#é|\x1c日") for _ in range(n)) for n in range(0, 300, 7)]
    texts += [" ".join(RANDOM.choice("abc") for _ in range(n)) for n in (7, 8, 9, 40, 90)]
    texts += [f"{MORSE}\n{TWIN}\n{MORSE}", " ".join([*"abcdefg", MORSE, *"abcdefg", TWIN] * 2), f"{MORSE} {TWIN}"]
    found = quality_rules.statistics(spans.texts(pa.array(texts)))
    got = [[int(found[s][i]) for s in quality_rules.STATISTICS[:5]] for i in range(len(texts))]
    assert got == [brute_statistics(t) for t in texts]


def test_rules_judge_and_select(documents):
    rows = [(i, prose(70) + f"\nline {i}") for i in range(60)] + [(i, junk(70)) for i in range(60, 80)]
    rows += [(i, " ".join(["again"] * 90)) for i in range(80, 90)]
    docs = documents(rows)
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
    assert [verdict[i] for i in range(60)] == [True] * 60 and not any(verdict[i] for i in range(60, 90))
    kept = quality_rules.select(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(60))


def test_rules_edges(documents):
    judged = quality_rules.judge(documents(EDGES))
    assert judged.count() == len(EDGES) and judged.where("n_words = 0").count() == 3
    assert quality_rules.judge(documents([])).count() == 0 and quality_rules.select(documents([])).count() == 0
    assert quality_rules.select(documents(EDGES)).where("doc_id = 5").count() == 0


def test_estimate_finds_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.7
    right = np.array([0.9, 0.8, 0.7, 0.85])
    votes = np.where(rng.random((20_000, 4)) < right, good[:, None], ~good[:, None]).astype(int)
    votes[rng.random((20_000, 4)) < 0.2] = 2
    pattern, count = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.estimate(pattern, count.astype(float), prior=0.001)
    assert abs(model.good - 0.7) < 0.05 and np.allclose(model.right[:, 1], right, atol=0.05)


def test_licences(documents):
    rows = [
        (1, "x Released UNDER the MIT License. and again under the mit license"),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "the public general license gnu of version 3"),
        (4, "words before. Licensed under the Apache License, Version 2.0 (the License)"),
        (5, "CC BY-NC 4.0"),
        *[(i, prose(50)) for i in range(10, 40)],
        (50, None), (51, ""),
    ]
    found = {r["doc_id"]: r for r in licence_scan.scan(documents(rows)).collect()}
    one = found[1]
    assert (one["n_words"], one["n_base"], one["first_word"], one["last_word"]) == (12, 2, 2, 8)
    assert [found[i]["labels"] for i in (1, 2, 3, 4, 5, 10)] == ["mit", "gpl-3", "", "apache-2", "cc-by-nc", ""]
    assert found[4]["base_labels"] == "apache-2" and found[4]["score"] == 1.0 and found[10]["score"] == 0.0
    assert licence_scan.scan(documents(EDGES)).count() == len(EDGES)
    assert licence_scan.scan(documents([])).count() == 0
