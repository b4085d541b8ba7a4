"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at a statistic of the text and votes 0 (bad), 1 (good) or abstains (2).  A document's
quality is a hidden class; given the class, rules vote independently, each with an accuracy for good
and one for bad documents.  Accuracies and the share of good documents are estimated from all
documents: votes are counted by pattern (at most ``3 ** rules`` rows, whatever the input), and the
estimation runs over the pattern counts.  A document is kept where its posterior probability of being
good reaches ``LEAST``.

Edge cases: a null or empty text has no words; its rules for few words vote bad and the others
abstain.  Repeated rows count and are judged each.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structmine.llm import spans
from structmine.llm.shared import kept

LEAST = 0.5
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[list(b"!?")] = True

STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_lower", "n_shouts", "n_same_words", "n_distinct_words", "n_symbol_words",
)


def statistics(found: spans.Texts) -> dict[str, np.ndarray]:
    """What the rules look at, for each text."""
    rows, data, offsets = found.rows, found.data, found.offsets
    words = spans.runs(found, spans.NOT_SPACE)
    codes = spans.coded(found, words.start, words.end)[0]
    inside = spans.NOT_SPACE[data]

    lines = spans.lines(found)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=filled[1:])
    worded = filled[lines.end] > filled[lines.start]
    line_row = lines.row[worded]
    line_codes = spans.coded(found, lines.start[worded], lines.end[worded])[0]
    _, first_line = np.unique(spans.of_row(line_codes, line_row), return_index=True)

    _, first_word = np.unique(spans.of_row(codes, words.row), return_index=True)
    n_words, n_lines = spans.count_rows(words.row, rows), spans.count_rows(line_row, rows)
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=marks[1:])
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (words.row[1:] == words.row[:-1])
    return {
        "n_words": n_words,
        "word_chars": spans.per_row(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": spans.per_row(_SYMBOL[data], offsets),
        "n_dup_lines": n_lines - spans.count_rows(line_row[first_line], rows),
        "n_repeat_words": spans.count_rows(words.row[_repeated(codes, words.row)], rows),
        "n_lines": n_lines,
        "n_upper": spans.per_row(_UPPER[data], offsets),
        "n_lower": spans.per_row(_LOWER[data], offsets),
        "n_shouts": spans.per_row(_SHOUT[data], offsets),
        "n_same_words": spans.count_rows(words.row[same], rows),
        "n_distinct_words": spans.count_rows(words.row[first_word], rows),
        "n_symbol_words": spans.count_rows(words.row[marks[words.end] > marks[words.start]], rows),
    }


def _repeated(codes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of eight words that its text holds twice or more."""
    covered = np.zeros(len(codes) + 1, np.int64)
    window, owner = spans.gram_codes(codes, row, WINDOW)
    at = np.flatnonzero(owner >= 0)
    _, group, count = np.unique(spans.of_row(window[at], owner[at]), return_inverse=True, return_counts=True)
    twice = at[count[group] > 1]
    covered[twice] += 1
    covered[twice + WINDOW] -= 1
    return np.cumsum(covered)[:-1] > 0


class Rule(NamedTuple):
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else not at all.

    Both take the statistics by name, as arrays over the documents.
    """

    name: str
    bad: Callable[[dict[str, np.ndarray]], np.ndarray]
    good: Callable[[dict[str, np.ndarray]], np.ndarray]


def _share(part: str, whole: str) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
    """``part / whole``; not a number, and so in no comparison, where ``whole`` is 0."""
    return lambda s: np.divide(s[part], s[whole], out=np.full(len(s[part]), np.nan), where=s[whole] > 0)


_repeats, _symbols, _length = (_share(x, "n_words") for x in ("n_repeat_words", "n_symbols", "word_chars"))
_shouts, _same, _distinct = (_share(x, "n_words") for x in ("n_shouts", "n_same_words", "n_distinct_words"))
_marked, _dense = _share("n_symbol_words", "n_words"), _share("n_symbols", "word_chars")
_dup_lines, _capitals = _share("n_dup_lines", "n_lines"), _share("n_upper", "n_letters")

RULES = (
    Rule("length", lambda s: s["n_words"] < 20, lambda s: s["n_words"] >= 50),
    Rule("repeats", lambda s: _repeats(s) > 0.3, lambda s: (s["n_words"] >= 20) & (_repeats(s) < 0.05)),
    Rule("symbols", lambda s: _symbols(s) > 0.1, lambda s: _symbols(s) < 0.01),
    Rule("marked words", lambda s: _marked(s) > 0.2, lambda s: _marked(s) < 0.05),
    Rule("symbol density", lambda s: _dense(s) > 0.03, lambda s: _dense(s) < 0.01),
    Rule("lines", lambda s: _dup_lines(s) > 0.3, lambda s: (s["n_lines"] >= 2) & (s["n_dup_lines"] == 0)),
    Rule("word length", lambda s: (_length(s) < 2) | (_length(s) > 15), lambda s: (_length(s) >= 3) & (_length(s) <= 10)),
    Rule("capitals", lambda s: _capitals(s) > 0.5, lambda s: _capitals(s) < 0.2),
    Rule("shouts", lambda s: _shouts(s) > 0.2, lambda s: _shouts(s) < 0.02),
    Rule("stutter", lambda s: _same(s) > 0.2, lambda s: (s["n_words"] >= 20) & (_same(s) < 0.05)),
    Rule("variety", lambda s: (s["n_words"] >= 50) & (_distinct(s) < 0.1), lambda s: _distinct(s) > 0.3),
)


def vote(stats: dict[str, np.ndarray], voters: Sequence[Rule] = RULES) -> np.ndarray:
    """One row a document and one column a rule: 0 bad, 1 good, 2 abstained."""
    stats = stats | {"n_letters": stats["n_upper"] + stats["n_lower"]}
    columns = [np.where(r.bad(stats), 0, np.where(r.good(stats), 1, 2)) for r in voters]
    return np.stack(columns, axis=1).astype(np.uint8)


class LabelModel(NamedTuple):
    """``right[rule, class]``: how often a rule that votes is right about a bad (0) or good (1) document."""

    good: float
    right: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """P(good) for rows of votes, one column a rule."""
        voted, said = pattern != 2, pattern == 1
        bad, good = self.right[:, 0], self.right[:, 1]
        for_good = np.where(said, np.log(good), np.log1p(-good)) * voted
        for_bad = np.where(said, np.log1p(-bad), np.log(bad)) * voted
        odds = np.log(self.good) - np.log1p(-self.good) + (for_good - for_bad).sum(axis=1)
        return 0.5 * (1 + np.tanh(0.5 * odds))


#: Before any data: a good document is rarely voted bad, a bad one passes most rules.
BELIEF = np.array([0.4, 0.95])
BELIEF_GOOD = 0.8


def estimate(pattern: np.ndarray, count: np.ndarray, rounds: int = 200, prior: float = 0.2) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns, from ``BELIEF``.

    ``prior`` is the weight of ``BELIEF`` as a share of all documents; it keeps the classes from
    changing places and accuracies off 0 and 1.
    """
    n = max(float(count.sum()), 1.0)
    weight = prior * n
    model = LabelModel(BELIEF_GOOD, np.tile(BELIEF, (pattern.shape[1], 1)))
    voted = pattern != 2
    for _ in range(rounds):
        good = model.posterior(pattern)
        share = np.stack([(1 - good) * count, good * count])
        correct = np.stack([share[0] @ (pattern == 0), share[1] @ (pattern == 1)], axis=1)
        total = np.stack([share[0] @ voted, share[1] @ voted], axis=1)
        right = (correct + BELIEF * weight) / (total + weight)
        found = LabelModel(float((share[1].sum() + BELIEF_GOOD * weight) / (n + weight)), right)
        done = np.abs(found.right - model.right).max() < 1e-9
        model = found
        if done:
            break
    return model


def measured(docs: DataFrame, voters: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id``, the statistics and the votes (a digit a rule) of every text, in one pass without a shuffle."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches, "text"):
            found = statistics(spans.texts(batch.column("text")))
            digits = (vote(found, voters) + ord("0")).view(f"S{len(voters)}").ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(found[s]) for s in STATISTICS), pa.array(digits.astype(str))],
                ["doc_id", *STATISTICS, "votes"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return wanted.mapInArrow(measure, f"doc_id {kind}, " + ", ".join(f"{s} long" for s in STATISTICS) + ", votes string")


def label_model(voted: DataFrame, n_rules: int = len(RULES)) -> LabelModel:
    """The model of all documents' votes; the patterns that meet in the driver are at most ``3 ** n_rules``."""
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    pattern = np.array([[int(c) for c in r["votes"]] for r in patterns], int).reshape(-1, n_rules)
    return estimate(pattern, np.array([r["n"] for r in patterns], float))


def judge(docs: DataFrame, voters: Sequence[Rule] = RULES, least: float = LEAST) -> DataFrame:
    """``doc_id``, statistics, votes, ``p_good`` and ``kept`` for every row.

    Statistics are kept in the shared folder, as the estimate needs all of them before any verdict.
    """
    voted = kept(measured(docs, voters), "rule-statistics")
    model = label_model(voted, len(voters))
    return voted.withColumn("p_good", _posterior(model)).withColumn("kept", F.col("p_good") >= least)


def _posterior(model: LabelModel) -> Column:
    """The posterior as an expression over the votes."""
    odds = F.lit(float(np.log(model.good) - np.log1p(-model.good)))
    for i, (bad, good) in enumerate(model.right):
        said = F.substring("votes", i + 1, 1)
        up, down = float(np.log(good) - np.log1p(-bad)), float(np.log1p(-good) - np.log(bad))
        odds = odds + F.when(said == "1", up).when(said == "0", down).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def select(docs: DataFrame, voters: Sequence[Rule] = RULES, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the posterior, with their columns.

    A first pass counts vote patterns for the model; the second decides row by row, so nothing is joined
    and repeated ids keep their own verdicts.
    """
    model = label_model(measured(docs, voters), len(voters))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches, "text"):
            found = statistics(spans.texts(batch.column("text")))
            passed = (found["n_words"] >= 20) & (100 * found["n_repeat_words"] <= 30 * found["n_words"])
            yield batch.filter(pa.array(passed & (model.posterior(vote(found, voters)) >= least)))

    return docs.mapInArrow(keep, docs.schema)
