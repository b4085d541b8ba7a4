"""Token store, packing and archives: round trips and brute force."""

import gzip
import hashlib
import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from structmine.llm import packing, spans, token_ids, token_store, warc_source

from .conftest import EDGES, MORSE, TWIN

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]


def test_parts_encode_as_the_whole():
    rng = random.Random(3)
    letters = [*"ab's\n\t   é1٣.,'!;:?<|>\x1c\x85 　 漢Z", "  ", "'re", "\r\n", " \n", "\n\n", "don't. "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(4000)]
    texts += ["a <|endoftext|> b", "", " ", "\n", *[t or "" for _, t in EDGES], MORSE, TWIN, f"{TWIN} {MORSE}"]
    coder = token_ids.Encoder(TOKENIZER)
    for a in range(0, len(texts), 200):
        ids, ends = coder.encode(spans.texts(pa.array(texts[a : a + 200])))
        assert [ids[x:y].tolist() for x, y in zip(ends, ends[1:])] == library_ids(texts[a : a + 200])


def test_parts_of_a_batch_are_told_apart_together():
    """A word of both texts is encoded once, though they are 6 MB; parts leave no byte out."""
    texts = pa.array([" ".join(f"word{chr(97 + i % 26)}" for i in range(600_000))[: 3 << 20]] * 2)
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    slices = list(spans.slices([batch], "text", token_ids.AT_ONCE))
    assert [s.num_rows for s in slices] == [2]
    found = spans.texts(slices[0].column("text"))
    cut = token_ids.parts(found)
    assert cut.start[0] == 0 and cut.end[-1] == len(found.data) and (cut.start[1:] == cut.end[:-1]).all()
    coder, seen = token_ids.Encoder(TOKENIZER), []
    whole = coder._whole
    coder._whole = lambda given: seen.extend(given) or whole(given)
    ids, ends = coder.encode(found)
    assert sum(map(len, seen)) < 1000
    assert ids[: ends[1]].tolist() == ids[ends[1] :].tolist()
    assert [x.tolist() for x in coder.encode(spans.texts(pa.array(["", None], pa.string())))] == [[], [0, 0, 0]]


def test_token_store(documents, spark, tmp_path):
    rows = [(i * 7 % 101, f"text {i} " * (i % 13)) for i in range(101)] + [(200 + (d or 9), t) for d, t in EDGES if d != 4] + [(300, MORSE), (301, TWIN)]
    token_store.write(documents(rows), str(tmp_path / "t"), TOKENIZER, 2, shard_bytes=20_000)
    stored = token_store.read(spark, str(tmp_path / "t"))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.digests(stored).collect()}
    want, start = {}, 0
    for d, ids in sorted(zip((d for d, _ in rows), library_ids([t or "" for _, t in rows]))):
        ids = np.array([*ids, 2], "<u4")
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want
    assert stored.select("shard").distinct().count() > 1
    token_store.write(documents([]), str(tmp_path / "e"), TOKENIZER, 2)
    assert token_store.digests(token_store.read(spark, str(tmp_path / "e"))).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        i = bisect_left(gaps, length)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        n += gap == capacity
        insort(gaps, gap - length)
        gaps = gaps[1:] if gaps[0] == 0 else gaps
    return n


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 300])
    lengths = sorted((rng.randrange(1, capacity // rng.choice([1, 3]) + 1) for _ in range(rng.randrange(0, 400))), reverse=True)
    runs, used = packing.plan(Counter(lengths), capacity), defaultdict(list)
    for rank, length in enumerate(lengths):
        run = [r for r in runs if r.rank <= rank][-1]
        assert run.length == length
        sequence, slot = divmod(rank - run.rank, run.each)
        used[run.sequence + sequence].append((run.offset + slot * length, length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) == best_fit_decreasing(lengths, capacity)


def test_packing(documents):
    rng = random.Random(1)
    rows = [(i, "some words here " * rng.randrange(0, 60)) for i in range(150)] + [(i, "equal text") for i in range(150, 250)]
    rows += [(300 + (d or 9), t) for d, t in EDGES if d != 4]
    got = packing.pack(packing.pieces(documents(rows), TOKENIZER, 0, 128), 128).collect()
    ids = {d: np.array([*x, 0], "<u4") for (d, _), x in zip(rows, library_ids([t or "" for _, t in rows]))}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, own in by_doc.items():
        at = 0
        for i, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (i, at) and 0 < r["length"] <= 128
            assert r["ids_crc32"] == zlib.crc32(ids[d][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[d]) and len(own) == -(-at // 128)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert by_doc.keys() == ids.keys()
    assert len(by_sequence) == best_fit_decreasing([r["length"] for r in got], 128)
    assert packing.pack(packing.pieces(documents([]), TOKENIZER, 0)).count() == 0


PAGES = [
    (1, "http://a/1", "<p>" + "x" * 2000), (2, "http://a/2", "<p>" + "x" * 2000), (9, None, "<p>" + "x" * 2000),
    (3, "http://a/3\r\nX: y", "short"), (4, "http://a/4", "short"), (5, "http://a/5", None), (6, "http://a/6", ""),
    (7, "http://ä/7", "é" * 499 + "e"), (8, "http://a/8", "é" * 500), (10, "http://a/10", "é" * 500),
    (11, "http://a/11", "\r\n\r\nWARC/1.1\r\n" * 9000), (12, "http://a/12", "z" * 300_000),
]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives(spark, tmp_path, compression):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    folder = str(tmp_path / "w")
    warc_source.write(warc_source.dedupe(pages), folder, compression=compression, file_bytes="4000")
    rows = {int(r["record_id"].split(":")[-1]): r for r in warc_source.read(spark, folder).collect()}
    assert rows.keys() == {p for p, _, _ in PAGES}
    revisits = {1: 9, 2: 9, 8: 10}
    for page, url, html in PAGES:
        body, r = (html or "").encode(), rows[page]
        assert r["payload_length"] == len(body) and r["payload_digest"] == hashlib.sha1(body).hexdigest()
        if page in revisits:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", f"urn:page:{revisits[page]}", None)
        else:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, body)
    assert rows[9]["target_uri"] is None and "\n" not in rows[3]["target_uri"]
    only = warc_source.read(spark, folder, ["record_id", "record_type"]).where("record_type = 'revisit'")
    assert {r["record_id"] for r in only.collect()} == {f"urn:page:{p}" for p in revisits}
    if compression == "gzip":
        data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("*.warc.gz")))
        assert data.count(b"WARC-Type: ") == len(PAGES)


def test_predicates_skip_blocks(tmp_path):
    row = {"record_type": "response", "payload": b"p" * 500_000, "payload_length": 500_000, "payload_digest": "00" * 20}
    row |= {"record_id": "urn:page:1", "date": None, "target_uri": "u", "refers_to": None}
    plain = warc_source.record_bytes(row)
    # a member without its length is read through
    (tmp_path / "a.warc.gz").write_bytes(warc_source.member(plain) + gzip.compress(plain) + warc_source.member(plain))
    reader = warc_source.WarcReader({"path": str(tmp_path)}, ["record_id", "payload_length"])
    from pyspark.sql.datasource import EqualTo, GreaterThan

    other = GreaterThan(("payload_length",), 3)
    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), other])) == [other]
    parts = reader.partitions()
    found = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert found == [{"record_id": "urn:page:1", "payload_length": 500_000}] * 3
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit")])) == []
    assert [r for p in parts for b in reader.read(p) for r in b.to_pylist()] == []


def test_archives_edges(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc_source.write(warc_source.dedupe(none), str(tmp_path / "w"))
    assert warc_source.read(spark, str(tmp_path / "w")).count() == 0
    assert warc_source.read(spark, str(tmp_path / "not there")).count() == 0


def archive_record(kind, block, content_type=None):
    lines = ["WARC/1.1", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:x>", *([f"Content-Type: {content_type}"] if content_type else [])]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("suffix", ["warc", "warc.gz"])
def test_payloads_of_all_record_types(tmp_path, suffix):
    http = b"HTTP/1.1 200 OK\r\nX-Long: " + b"x" * 40_000 + b"\r\nContent-Length: 5\r\n\r\n"
    records = [
        (archive_record("conversion", b"hello world", "text/plain"), 11, b"hello world"),
        (archive_record("resource", b"a\r\n\r\nb"), 6, b"a\r\n\r\nb"),
        (archive_record("warcinfo", b"", "application/warc-fields"), 0, b""),
        (archive_record("response", http + b"12345", "application/http; msgtype=response"), 5, b"12345"),
        (archive_record("response", b"dns: 1.2.3.4", "text/dns"), 12, b"dns: 1.2.3.4"),
        (archive_record("response", b"HTTP/1.1 200 OK\r\n\r\n" + b"z" * 9), 9, b"z" * 9),
        (archive_record("response", b"HTTP/1.1 200 OK\r\n", "application/http"), 0, b""),
        (archive_record("revisit", http, "application/http"), 5, None),
        (archive_record("revisit", b"", "application/http"), None, None),
    ]
    pack = (lambda r: r) if suffix == "warc" else warc_source.member
    (tmp_path / f"a.{suffix}").write_bytes(b"".join(pack(r) for r, _, _ in records))
    for columns in (["payload_length", "payload"], ["payload_length"], ["payload"]):
        reader = warc_source.WarcReader({"path": str(tmp_path)}, columns)
        found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        want = [{"payload_length": n, "payload": p} for _, n, p in records]
        assert found == [{c: w[c] for c in columns} for w in want]


def test_unwanted_payloads_are_not_decoded(tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"page " * 7_000
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(warc_source.member(archive_record("response", block, "application/http")) for _ in range(20)))
    with open(path, "rb") as file:
        archive = warc_source._Compressed(file, path.stat().st_size)
        assert sum(1 for _ in archive.heads()) == 20
        assert archive.decoded <= 20 * warc_source.STEP_BYTES


def test_given_up_writes_leave_nothing(tmp_path):
    row = {"record_type": "response", "payload": b"p", "payload_length": 1, "payload_digest": "00" * 20}
    row |= {"record_id": "urn:page:1", "date": None, "target_uri": "u", "refers_to": None}

    def breaks():
        yield row
        raise RuntimeError("lost")

    writer = warc_source.WarcWriter({"path": str(tmp_path)})
    done = writer.write(iter([row]))
    with pytest.raises(RuntimeError):
        writer.write(breaks())
    writer.abort([done, None])
    assert list(tmp_path.iterdir()) == []
    again = warc_source.WarcWriter({"path": str(tmp_path)})
    again.commit([again.write(iter([row])), again.write(iter([]))])
    assert [f.suffix for f in tmp_path.iterdir()] == [".gz"]
