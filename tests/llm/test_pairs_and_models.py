"""Decontamination, near-duplicates and the language model against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from structmine.llm import components, decontaminate, lattice_lm, near_dedup

from .conftest import EDGES, MORSE, TWIN

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n)]


def bag(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    n = min(5, len(found))
    return Counter(tuple(found[i : i + n]) for i in range(len(found) - n + 1)) if found else Counter()


def alike(a, b):
    shared = sum((a & b).values())
    return shared / max(sum(a.values()) + sum(b.values()) - shared, 1)


def test_hamming_lookup_is_complete():
    texts = [" ".join(words(30, i)) for i in range(50)]
    index = decontaminate.ItemIndex(list(range(50)), texts, 0.8)
    rng = np.random.default_rng(1)
    prints = index.prints[rng.integers(0, 50, 300)].copy()
    for i in range(300):
        for bit in rng.choice(64, rng.integers(0, 26), replace=False):
            prints[i] ^= np.uint64(1) << np.uint64(bit)
    want = np.argwhere(np.bitwise_count(prints[:, None] ^ index.prints[None, :]) <= decontaminate.RADIUS)
    assert {*zip(*(x.tolist() for x in index.within_radius(prints)))} == {tuple(x) for x in want.tolist()}


def test_contaminated_by_brute_force(documents, spark):
    items = [(i, " ".join(words(n, 100 + i))) for i, n in enumerate((3, 5, 12, 25, 40, 59))] + [(6, None), (7, ""), (8, "...")]
    items.append((9, items[3][1]))
    docs = []
    for i in range(60):
        own = words(80, i)
        item = items[i % 6][1].split()
        if i % 3 == 0:
            own[20:20] = item if i % 2 else [w.upper() + "," for w in item]
        elif i % 3 == 1 and len(item) > 20:
            own[10:10] = [*item[: len(item) // 2], "changed", *item[len(item) // 2 + 1 :]]
        docs.append((i, " ".join(own)))
    want = set()
    for d, text in docs:
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        for i, item in items:
            n = len((item or "").split()) if bag(item) else 0
            if n and any(alike(bag(" ".join(found[k : k + n])), bag(item)) >= 0.8 for k in range(len(found) - n + 1)):
                want.add((d, i))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(documents(docs), table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    blocks = decontaminate.item_indexes(table, block_items=4)
    assert sum(len(b.ids) for b in blocks) == 7
    clean = decontaminate.select(documents(docs), table)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_truncated_items_by_brute_force(documents, spark):
    """Texts shorter than the item: its first or last words, some with a word changed, some with repeats."""
    items = [(i, " ".join(words(n, 300 + i))) for i, n in enumerate((6, 9, 10, 25, 50, 59))]
    items += [(6, items[4][1]), (7, " ".join(words(6, 310) * 5)), (8, "one two"), (9, None)]
    docs = []
    for _, item in items[:8]:
        own = item.split()
        for less in range(1, 16):
            docs += [own[:-less], own[less:], ["changed", *own[less + 1 :]]]
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    want = {}
    for d, text in docs:
        found = text.split()
        for i, item in items:
            n = len((item or "").split())
            windows = [found] if len(found) < n else [found[k : k + n] for k in range(len(found) - n + 1)]
            best = max((alike(bag(" ".join(w)), bag(item)) for w in windows), default=0) if n else 0
            if best >= 0.8:
                want[d, i] = best
    assert any(len(docs[d][1].split()) == 48 and i == 4 for d, i in want)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(documents(docs), table).collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in got} == pytest.approx(want) and len(got) == len(want)
    clean = decontaminate.select(documents(docs), table)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_contaminated_edges(documents, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(documents(EDGES), none).count() == 0
    assert decontaminate.select(documents(EDGES), none).count() == len(EDGES)
    one = spark.createDataFrame([(1, "wort wort wort wort wort wort")], "item_id long, text string")
    assert decontaminate.contaminated(documents(EDGES), one).count() == 1
    assert decontaminate.contaminated(documents([]), one).count() == 0


def near_rows():
    """Unrelated texts, exact copies, near copies, near misses and a large group of near copies."""
    rng, rows = random.Random(9), []
    for i in range(40):
        rows.append((i, " ".join(words(120, i))))
    rows += [(40 + i, rows[0][1]) for i in range(5)]
    for i in range(10):
        changed = rows[i][1].split()
        changed[rng.randrange(120)] = "other"
        rows.append((50 + i, " ".join(changed)))
    for i in range(10, 20):
        changed = rows[i][1].split()
        for k in range(5, 120, 9):
            changed[k] = "swapped"
        rows.append((60 + i, " ".join(changed)))
    base = words(150, 999)
    for i in range(60):
        changed = list(base)
        for k in rng.sample(range(150), 1 + i % 4):
            changed[k] = f"edit{i}"
        rows.append((200 + i, " ".join(changed)))
    return rows


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for k, y in enumerate(b):
            new.append(min(row[k + 1] + 1, new[k] + 1, row[k] + (x != y)))
        row = new
    return row[-1]


def test_edit_similarity_never_exceeds_the_true_one_and_finds_spread_edits():
    rng = random.Random(11)
    found = total = 0
    for trial in range(150):
        one = [rng.randrange(60 if trial % 2 else 3000) for _ in range(rng.randrange(30, 150))]
        two = list(one)
        for _ in range(rng.randrange(0, len(one) // 8)):
            at = rng.randrange(len(two))
            two[at : at + rng.choice([0, 1, 1, 2])] = [rng.randrange(3000)] * rng.choice([0, 1, 1])
        a, b = (np.array(x, np.uint64) for x in (one, two))
        kmers = [near_dedup.labelled(x, np.zeros(len(x), np.int64))[0] for x in (a, b)]
        truth = 1 - edit_distance(one, two) / max(len(one), len(two))
        got = near_dedup.edit_similarity(a, b, *near_dedup._anchors(*kmers, near_dedup.BAND))
        assert got == 0 or got <= truth + 1e-12
        alike_too = near_dedup.similarity(a, b, *kmers) > 0
        assert alike_too or truth < 0.95
        total += truth >= 0.9
        found += alike_too and truth >= 0.9
    assert found >= 0.97 * total > 60


def test_near_duplicates_by_brute_force(documents):
    rows = near_rows() + [(300, "a b"), (301, "a b"), (302, "a c"), (303, None), (304, "")]
    bags, parent = {d: bag(t) for d, t in rows}, {d: d for d, _ in rows}
    texts = {d: t or "" for d, t in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            own = texts[a].split(), texts[b].split()
            close = a < b and bool(bags[a] & bags[b]) and edit_distance(*own) <= 0.1 * max(map(len, own))
            if a < b and (texts[a] == texts[b] or alike(bags[a], bags[b]) >= 0.8 or close):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    docs = documents(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert got == {d: root(d) for d in texts}
    kept = near_dedup.select(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({root(d) for d in texts})


def test_large_groups_lose_no_pair(documents, spark):
    """Texts that share one sketch and none of the following; the first two are alike."""
    rows = [(i, " ".join(words(60, 500 + i))) for i in range(1, 20)]
    rows = [(0, rows[0][1] + " more"), *rows]
    docs = documents(rows)
    key = {r["doc_id"]: r["text_key"] for r in near_dedup.sketched(docs).collect()}
    made = [(d, key[d], 56 + (d == 0), [7] + [1000 * d + k for k in range(1, near_dedup.SKETCHES)]) for d, _ in rows]
    texts = spark.createDataFrame(made, "doc long, text_key string, n long, sketches array<bigint>")
    pairs, large = near_dedup.candidates(texts)
    assert {r["doc"] for r in large.collect()} == {d for d, _ in rows} and pairs.count() <= len(rows)
    table = near_dedup.words_table(docs, texts.select("doc", "text_key"))
    links = near_dedup.verified(pairs, table)
    apart = near_dedup._apart(large, components.components(links.select("doc1", "doc2")))
    links = links.unionByName(near_dedup._between(apart, table)).collect()
    assert {(r["doc1"], r["doc2"]) for r in links} == {(0, 1)}


def test_short_near_duplicates_by_brute_force(documents):
    """Texts of 8 and 9 words with a word before or after, and of 13 with one changed at an end."""
    rows = []
    for i in range(40):
        own = words(13 if i % 4 == 3 else 8 + i % 2, 700 + i)
        other = ([*own, "more"], ["more", *own])[i // 2 % 2] if i % 4 < 3 else [*own[:-1], "more"]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
    bags = {d: bag(t) for d, t in rows}
    want = {(a, b) for a in bags for b in bags if a < b and alike(bags[a], bags[b]) >= 0.8}
    assert want == {(2 * i, 2 * i + 1) for i in range(40)}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(documents(rows)).collect()}
    assert got == {d: d - d % 2 for d in bags}


def test_near_duplicates_edges(documents):
    assert near_dedup.classes(documents([])).count() == 0 and near_dedup.select(documents([])).count() == 0
    assert near_dedup.classes(documents(EDGES)).count() == len(EDGES) - 1
    kept = [r["doc_id"] for r in near_dedup.select(documents(EDGES)).collect()]
    assert sorted(kept, key=str) == sorted([1, 3, 4, 5, 6, None], key=str)


def test_links_are_named_for_what_they_count(documents):
    """Forty texts, each alike to most others; which links are verified depends on the groups."""
    base = words(150, 998)
    rows = [(i, " ".join([*base[: 3 * i], f"edit{i}", *base[3 * i + 1 :]])) for i in range(40)]
    got = near_dedup.classes(documents(rows))
    assert got.columns == ["doc_id", "text_key", "class_id", "n_verified_links"]
    counts = [r["n_verified_links"] for r in got.collect()]
    assert min(counts) >= 1 and sum(counts) <= 40 * 39


def test_chain_is_the_longest_in_order():
    a = np.array([5, 1, 9, 7, 3], np.uint64)
    assert near_dedup.chain(a, a) == 5 and near_dedup.chain(a, a[::-1].copy(), band=1) == 1
    assert near_dedup.chain(a, np.array([1, 5, 9, 3], np.uint64), band=1) == 3


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (20, 20)]
    links += [(100 + i, 101 + i) for i in range(40)]
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    got = {r["doc"]: r["component"] for r in found.collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10} | {100 + i: 100 for i in range(41)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lattice_by_brute_force():
    known = lattice_lm.pieces(VOCABULARY)
    logs, at = np.log(known.first), {int(h): i for i, h in enumerate(known.hashes)}
    assert abs(known.first.sum() - 1) < 1e-9

    def ways(word):
        if not word:
            return 1.0
        found = (at.get(lattice_lm._hash(word[:n])) for n in range(1, len(word) + 1))
        return sum(known.first[i] * ways(word[n:]) for n, i in enumerate(found, 1) if i is not None)

    texts = ["the", "ciónes", "x", "日本", "\x1c$$", "walkings"]
    got = lattice_lm.log_probabilities(known, logs, pa.array(texts))
    assert np.allclose(got, [math.log(ways(b" " + t.encode())) for t in texts], rtol=1e-9)
    long = "abcdefghij" * 30
    assert abs(lattice_lm.log_probabilities(known, logs, pa.array([long]))[0]) > 100
    used = lattice_lm.expected_counts(known, logs, pa.array([*texts, long]), np.ones(7))
    assert abs((used * known.lengths).sum() - sum(len(t.encode()) + 1 for t in [*texts, long])) < 1e-6


def test_words_of_equal_hashes_are_counted_apart(documents):
    docs = documents([(1, f"{MORSE} {TWIN} {MORSE}"), (3, TWIN)])
    counted = Counter()
    for r in lattice_lm.chunked(docs).where("word is not null").collect():
        counted[r["word"]] += r["n_train"]
    assert counted == {MORSE: 2, TWIN: 2}


def test_language_model(documents):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["The", "river", "runs", "été", "fast"]) for _ in range(20 + i))) for i in range(40)]
    rows += [*EDGES[:5], (90, "unmet zzzz")]
    got = lattice_lm.score(documents(rows), VOCABULARY).collect()
    lower = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    counts = Counter(w for d, t in rows if not held(d) for w in [*lower(t), None])
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*lower(t), None])
    want = sorted((d, held(d), len(lower(t)) + 1, round(base(t), 6), n) for d, t in rows)
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], round(r["base_score"], 6), r["train_tokens"]) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    by = {r["doc_id"]: r["score"] / r["n_tokens"] for r in got}
    assert by[90] < min(by[i] for i in range(40))
    assert lattice_lm.score(documents([]), VOCABULARY).count() == 0
    assert lattice_lm.score(documents([(10, "a"), (None, None)]), VOCABULARY).count() == 2
