import brute
import corpus_pipeline
import sentencepiece

from rasterlake.llm import quality, queries
from rasterlake.llm.common import scratch

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    """Each stage against a plain version on its own input."""
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = source, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        path = scratch(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = before, docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == source.columns
    pairs = lambda rows: [(r[0], r[1]) for r in rows]
    bag = lambda rows: sorted(map(repr, rows))

    before, after = seen["quality"]
    scored = quality.score(source, quality.train(source, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert bag(pairs(after)) == bag((r.doc_id, r.text) for r in scored if r.predicted) and 0 < len(after) < len(before)
    before, after = seen["line_dedup"]
    assert bag(pairs(after)) == bag(zip([r[0] for r in before], brute.lines(pairs(before))))
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["near_dedup"]
    assert bag(pairs(after)) == bag(pairs(before)[i] for i in brute.near(pairs(before), 80)[1])
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert bag(pairs(after)) == bag(r for r, h in zip(pairs(before), brute.hits(pairs(before), items)) if not h[2])
    before, after = seen["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    texts = dict(pairs(before))
    assert len(after) == len(before)
    for r in after:
        ids = library.encode(texts[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded_sha256 == brute.sha(library.decode(ids).encode())
    assert bag((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()) == bag((r.doc_id, r.n_tokens) for r in after)


def test_shape():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]


LEAK = "one two three four five six seven eight nine ten eleven twelve"
PLAIN = " ".join(f"letter{k} of{k}" for k in range(30))


def folder(spark, path, rows):
    """A folder with these documents, one benchmark item and no labels."""
    data = [(i, t, "en", "web", len(t or ""), 7, 8) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, `__row` int, score int").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("item", LEAK)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, ties and clashing columns; without labels nothing is rejected for its quality."""
    rows = [(1, None), (2, ""), (2, ""), (3, PLAIN), (3, PLAIN), (None, PLAIN), (4, "before " + LEAK), (5, "a b"), (None, None)]
    got = corpus_pipeline.run(spark, folder(spark, tmp_path, rows)).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    want = [(1, 0), (2, 0), (2, 0), (3, len(library.encode(PLAIN))), (5, len(library.encode("a b"))), (None, 0)]
    assert sorted(map(repr, ((r.doc_id, r.n_tokens) for r in got))) == sorted(map(repr, want))


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [])).collect() == []
