"""Periodic runs against a search over all lags."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from structmine.llm import periodic_runs, queries

from .conftest import EDGES, MORSE, TWIN


def brute_force(x):
    n, found = len(x), set()
    for q in range(1, n // 2 + 1):
        j = 0
        while j + q < n:
            start = j
            while j + q < n and x[j] == x[j + q]:
                j += 1
            part = x[start : j + q]
            if j > start and len(part) >= max(12, 2 * q):
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    found.add((start, len(part), q))
            j += j == start
    return sorted(found)


def sequences(seed):
    r = random.Random(seed)
    kind = seed % 6
    if kind == 0:  # two words only
        return [r.randrange(2) for _ in range(r.randrange(300))]
    if kind == 1:  # one block, repeated and broken off
        p = [r.randrange(3) for _ in range(r.randrange(1, 90))]
        return [r.randrange(9) for _ in range(40)] + p * r.randrange(2, 6) + p[: r.randrange(len(p) + 1)]
    if kind == 2:  # runs within the period of a run, which nothing but their seam tells
        a = [0, 1] * r.randrange(30, 80) + [0]
        return a + a + [0, 1] * r.randrange(1, 60)
    if kind == 3:
        u = [w for _ in range(r.randrange(2, 8)) for w in [r.randrange(3)] * r.randrange(1, 60)]
        return u * r.randrange(2, 4)
    if kind == 4:  # a Fibonacci word: runs of many periods
        f, g = [0], [0, 1]
        for _ in range(r.randrange(5, 12)):
            f, g = g, g + f
        return g[:400]
    u = [0] * r.randrange(100) + [1]
    v = u * r.randrange(1, 4) + [0] * r.randrange(70)
    return v + v + v[: r.randrange(1, 30)]


@pytest.mark.parametrize("direct", [8, 16, 64])
def test_all_runs(direct):
    parts = [sequences(seed) for seed in range(120)]
    for x, found in zip(parts, periodic_runs.runs_of([np.array(x, np.int64) for x in parts], direct)):
        assert list(zip(found.start.tolist(), (found.end - found.start).tolist(), found.period.tolist())) == brute_force(x)


def answer(doc, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_force(words)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda f: (-f[1], f[0], f[2]), default=(None,) * 3)
    listing = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *best, best[1] and 1000 * best[1] // best[2], sha(listing), sha(kept))


def test_query(spark, folder):
    r = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["é", "x\x1cy", MORSE, TWIN]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(400)))) for i in range(150)]
    rows += [(500 + i, " ".join(["same", "line", "again\n"] * 30 + [r.choice(words)] * i)) for i in range(20)]
    rows += [x for x in EDGES if x[0] != 5] + [(7, " ".join([MORSE, words[-1]] * 3 + [MORSE] * 7))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = queries.op13_periodic_runs(spark, folder(documents=docs)).collect()
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted(((doc, *answer(doc, text)) for doc, text in rows), key=str)
    assert sorted(((x["doc_id"], *[x[c] for c in columns]) for x in got), key=str) == want
    assert sum(w[1] > 0 for w in want) > 30


def test_long_and_no_texts(spark, documents):
    long = " ".join(f"w{i % 17_000}" for i in range(50_000))
    found = {x["doc_id"]: x for x in periodic_runs.find(documents([(1, "wort " * 60_000), (2, long), (None, None)])).collect()}
    assert (found[1]["length"], found[1]["period"], found[1]["n_kept"]) == (60_000, 1, 1)
    assert (found[2]["length"], found[2]["period"], found[2]["n_kept"]) == (50_000, 17_000, 17_000)
    assert found[None]["n_runs"] == 0 and found[None]["start"] is None
    assert periodic_runs.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
