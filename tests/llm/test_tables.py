import hashlib
import io
import struct

import brute
import numpy as np
import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from rasterlake.llm import queries, token_shards, topk, warc
from rasterlake.llm.common import scratch


def exact(rows, queries_, k=10):
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in [x for x in ok if queries_(x[0])]:
        found = sorted((-int(a @ b), 2**63 if i is None else i) for i, b in ok if i != q and len(b) == len(a))[:k]
        out += [(q, r + 1, None if i == 2**63 else i, -s) for r, (s, i) in enumerate(found)]
    return out


def test_top_k(spark):
    r = np.random.default_rng(4)
    rows = [(k, [float(x) for x in np.float32(r.normal(size=24))]) for k in range(400)]
    rows += [(500 + k, rows[7][1]) for k in range(15)] + [(600, None), (601, []), (602, [1.0, None]), (603, [float("nan")] * 24), (604, [float("inf")] * 24), (None, rows[0][1]), (5, rows[9][1]), (605, [1.0, 2.0]), (606, [3.0, 1.0])]
    table = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int").repartition(3)
    for block in (1 << 14, 9):
        got = topk.top_k(table, table.where("vec_id % 5 = 0"), block=block)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        want = exact(rows, lambda i: i is not None and i % 5 == 0)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert topk.top_k(table.limit(0), table).count() == topk.top_k(table, table.limit(0)).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(2)
    a, b = r.normal(size=(2, 200, 20))
    for s in topk.LEVELS:
        assert (np.einsum("ij,ij->i", a, b) <= np.einsum("ij,ij->i", topk.segment_statistics(a, s), topk.segment_statistics(b, s)) + 1e-9).all()


def test_large_components(spark):
    rows = [(0, [1e15, 1.0]), (1, [1e15, -2.0]), (2, [-1e15, 0.5])]
    got = topk.top_k(t := spark.createDataFrame(rows, "vec_id long, embedding array<double>"), t.where("vec_id = 0")).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (2, -(2**63))]


PAGES = [(1, "http://a/ä b", "x" * 100), (2, None, "x" * 100), (3, "u\r\nv", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (2, "again", "é" * 60), (9, "u", "é" * 60), (2, "once more", "é" * 60), (None, "n", "x" * 100), (None, "n", "z" * 200), (12, "l", "long " * 200_000)]


def described(rows):
    out = []
    for i, _, p in rows:
        raw = (p or "").encode()
        same = [j for j, _, q in rows if (q or "") == (p or "") and j is not None]
        revisit = len(raw) >= 100 and same and min(same) != i
        out.append((i, len(raw), brute.sha(raw), "revisit" if revisit else "response", min(same) if revisit else None))
    return out


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*r, 0, 0) for r in PAGES], "page_id long, url string, html string, digest int, n int").repartition(3)
    for size in (256 << 20, 1000):
        got = warc.round_trip(pages, archive_bytes=size)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, described(PAGES)))
    assert warc.round_trip(pages.limit(0)).count() == 0
    folder = scratch(spark, "warc-test")
    listed = warc.write_archives(pages, folder)
    full = warc.read_archives(spark, listed, folder, payloads=True).where("record_type = 'response'").collect()
    assert {r.page_id: bytes(r.payload).decode() for r in full if r.page_id}[12] == "long " * 200_000


def test_warc_layout(spark):
    folder = scratch(spark, "warc-test")
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<html>page {k} {'common words ' * 20}</html>") for k in range(300)], "page_id long, url string, html string").coalesce(1)
    (name,) = [r.archive for r in warc.write_archives(pages, folder).collect()]
    files, root = fs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{root}/{name}") as stream:
        raw = stream.read()
    magic, size = struct.unpack("<II", raw[:8])
    known = zstandard.ZstdCompressionDict(zstandard.decompress(raw[8 : 8 + size]))
    assert magic == 0x184D2A5D and size > 0
    rest, n = raw[8 + size :], 0
    while rest:
        frame = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        record = frame.decompress(rest)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and record.count(b"WARC-Type:") == 1
        rest, n = frame.unused_data, n + 1
    assert n == 301 and len(raw) < 0.6 * sum(len(r.html) for r in pages.collect())
    assert [k for k, _, _ in warc.records(io.BytesIO(raw))][:2] == ["warcinfo", "response"]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    p, q = token_shards.Permutation(n, 5), token_shards.Permutation(n, 6)
    slots = p.slot(np.arange(n))
    assert sorted(slots) == list(range(n)) and (p.sequence(slots) == np.arange(n)).all()
    assert n < 64 or (slots != q.slot(np.arange(n))).any()


def test_token_shards(spark):
    import public_tokenizers

    encoder = token_shards.Encoder.load(queries.tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = brute.texts(9, 80) + [(99, "long text " * 20_000)]
    path = scratch(spark, "docs")
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, shard int").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    folder = scratch(spark, "shards")
    listed, m = token_shards.write_shards(docs, folder, encoder, length=16, per_shard=32)
    stream = np.concatenate([np.array([*encoder.encode(r.text), encoder.end], "<u2") for r in docs.collect()])
    whole = np.full(m["sequences"] * 16, encoder.end, "<u2")
    whole[: len(stream)] = stream
    order = token_shards.Permutation(m["sequences"], m["key"])
    back = list(token_shards.read_from(folder))
    assert m["ids"] == len(stream) and [s for s, _ in back] == list(range(m["sequences"]))
    assert all((ids == whole[16 * k : 16 * k + 16]).all() for (_, ids), k in zip(back, order.sequence(np.arange(m["sequences"]))))
    for start in (1, 31, 32, m["sequences"] - 1):
        assert [s for s, _ in token_shards.read_from(folder, start)] == list(range(start, m["sequences"]))
    got = token_shards.read_shards(spark, listed, folder, m)
    assert got.agg(F.sum("n_ids")).first()[0] == len(stream) and got.count() == m["sequences"]
    one = got.where("slot = 7").first()
    assert one.ids_sha256 == hashlib.sha256(back[7][1].tobytes()).hexdigest() and one.byte_offset == 7 * 32
    again, _ = token_shards.write_shards(docs, scratch(spark, "shards"), encoder, length=16, per_shard=32)
    assert {r.sha256 for r in again.collect()} == {r.sha256 for r in listed.collect()}
    empty, m = token_shards.write_shards(docs.limit(0), scratch(spark, "shards"), encoder)
    assert empty.count() == 0 and m["sequences"] == 0
