"""The pipeline over planted documents: what each stage keeps is known beforehand."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline

public_tokenizers = pytest.importorskip("public_tokenizers")


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def tables(spark, folder):
    clean = {i: prose(90, i) + "\nA last line " + prose(9, 5000 + i) for i in range(150)}
    junk = {i: " ".join(w + "$$$" for w in prose(80, i).split()) for i in range(200, 260)}
    short = {300: "only a few words", 301: None, 302: ""}
    item = prose(40, 777)
    copies = {400: clean[3], 401: clean[4].replace(clean[4].split()[20], "swapped", 1)}
    leaks = {500: prose(50, 901) + "\n" + item + "\n" + prose(50, 902)}
    rows = [(i, t) for part in (clean, junk, short, copies, leaks) for i, t in part.items()]
    docs = spark.createDataFrame([(i, t, "en", None, 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 200), 0) for i in [*range(0, 150, 2), *range(200, 260, 2)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(rows), set(clean) | {500}, set(junk), set(short)


def test_stages(spark, tmp_path):
    texts, clean, junk, short = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        seen[name] = docs.collect()
        assert n == 4 or docs.columns == columns
    ids = {name: {r["doc_id"] for r in rows} for name, rows in seen.items()}
    assert not ids["quality classifier"] & junk and ids["quality classifier"] >= clean | {400, 401}
    assert ids["quality rules"] == clean | {400, 401}
    assert ids["near-duplicates"] == clean
    assert ids["benchmark decontamination"] == clean - {500}

    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER)), set()
    for i in clean - {500}:
        found = np.array([*library.encode(texts[i], add_special_tokens=False).ids, corpus_pipeline.END_ID], "<u4")
        want.add((i, 0, 0, len(found), zlib.crc32(found.tobytes())))
    shown = lambda rows: {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows}
    assert shown(seen["best-fit packing"]) == want
    assert shown(corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_stages_take_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path))
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
