import os
import re
import time
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.llm import decontam, line_dedup, near_dedup, pieces, quality, queries, suffix_dedup, toxicity

SF = "/root/testdata/sf0.01"
#: columns with names that outputs and helpers use
EXTRA = ["n", "row", "score", "ids", "label", "bucket", "n_lines", "first"]


def frame(spark, rows, parts=3):
    """rows with EXTRA columns; with one part in the order of rows."""
    data = [(i, t, *range(len(EXTRA))) for i, t in rows]
    df = spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in EXTRA)).coalesce(1)
    return df.repartition(parts) if parts > 1 else df


def bag(rows):
    return sorted(map(repr, rows))


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return brute.texts(request.param)


def test_suffix_dedup(spark, rows):
    got = suffix_dedup.suffix_dedup_report(frame(spark, rows)).collect()
    assert bag(tuple(r) for r in got) == bag(brute.substrings(rows))
    hot = suffix_dedup.suffix_dedup_report(frame(spark, rows), block_bytes=2000, hot=1).collect()
    assert bag(tuple(r) for r in hot) == bag(brute.substrings(rows))
    kept = suffix_dedup.suffix_dedup(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", *EXTRA] and kept.count() == len(rows)


def test_suffix_dedup_deletes_shuffles_it_no_longer_needs(spark, rows):
    manager = spark._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f: os.path.getsize(f) for f in re.findall(r"/\S*?/shuffle_\d+_\d+_0\.data", manager.getAllFiles().mkString(" ")) if os.path.exists(f)}
    docs, before = frame(spark, rows), files()
    report = suffix_dedup.suffix_dedup_report(docs)
    until = time.time() + 2  # executors delete them in the background
    left = lambda: sum(n for f, n in files().items() if f not in before)
    while left() > 1000 and time.time() < until:  # a sum over the blocks stays
        time.sleep(0.1)
    assert left() <= 1000
    assert bag(tuple(r) for r in report.collect()) == bag(brute.substrings(rows))


def test_segments_are_packed_whole_and_small():
    r = np.random.default_rng(4)
    group, count = r.integers(0, 1 << 63, 500).astype(np.uint64), r.integers(1, 27, 500)
    least, text = r.integers(10**9, 10**9 + 700, 500), r.integers(97, 113, int((count + 49).sum())).astype(np.uint8)
    least[:2] = suffix_dedup.NULL_ID, -5
    packed = suffix_dedup.pack_segments(group, least, count, text)
    got = suffix_dedup.unpack_segments(packed, 500, 14 * 500 + len(text))
    want = group & np.uint64((1 << 40) - 1), least, count, text
    assert all(x.tolist() == y.tolist() for x, y in zip(got, want))
    assert len(packed) < 0.95 * len(suffix_dedup._pack(group, least, count.astype(np.uint8), text))


def test_equal_stretches_by_tries():
    r = np.random.default_rng(0)
    windows = np.zeros((500, 56), np.uint8)
    windows[:, :50] = 97
    for k in range(500):
        windows[k, r.integers(0, 50)] = r.integers(97, 100)
    number = suffix_dedup.equal_stretches(windows)
    want = {b: k for k, b in enumerate(sorted({w.tobytes() for w in windows}))}
    assert number.tolist() == [want[w.tobytes()] for w in windows]


@pytest.mark.parametrize("few", [1, 8, 1024])
def test_multikey_quicksort(monkeypatch, few):
    monkeypatch.setattr(suffix_dedup, "FEW", few)
    r = np.random.default_rng(9)
    for n, kinds in ((0, 2), (1, 2), (2, 1), (500, 1), (500, 3), (3000, 40), (3000, 1 << 40)):
        words = r.integers(0, kinds, (n, 4)).astype(np.uint64)
        order, new = suffix_dedup.shallow_sort(words, 2)
        pairs = [tuple(w[:2]) for w in words[order].tolist()]
        assert sorted(order.tolist()) == list(range(n)) and pairs == sorted(pairs)
        assert new.tolist() == [k == 0 or pairs[k] != pairs[k - 1] for k in range(n)]


def test_segments_of_equal_hash_are_told_apart():
    """Were all hashes of a block's segments equal, classes would still hold equal bytes alone."""
    r = np.random.default_rng(10)
    texts = [r.integers(97, 123, 300).astype(np.uint8).tobytes() for _ in range(4)]
    texts += [texts[0], texts[1][:200] + texts[2][100:]]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in texts])))

    class Block(suffix_dedup.Block):
        def __init__(self):
            self.texts, self.at, self.ids = data, at.astype(np.int64), np.arange(len(texts))

        def segments(self, length):
            s = super().segments(length)
            s.hashes.of = lambda begin, end: np.zeros(len(begin), np.uint64)
            return s

    s = Block().segments(50)
    buckets = [{"bucket": k, "flags": suffix_dedup._pack(np.ones(len(np.unique(s.anchor[s.bucket(3) == k])), np.uint8))} for k in range(3)]
    c = suffix_dedup.Chosen(Block(), buckets, 3, 50)
    by = {}
    for k in range(len(c.begin)):
        raw = data[c.begin[k] : c.begin[k] + c.count[k] + 49].tobytes()
        assert by.setdefault(c.number[k], raw) == raw
    assert len(set(by.values())) == len(by) > 4


def test_near_dedup(spark, rows):
    want, first = brute.near(rows, 85)
    got = near_dedup.near_dedup_report(frame(spark, rows), percent=85).collect()
    assert bag((r.doc_id, r.n_shingles, r.component_id) for r in got) == bag(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    want, first = brute.near(rows, 80)
    kept = near_dedup.near_dedup(frame(spark, rows, 1))
    assert kept.columns == ["doc_id", "text", *EXTRA]
    assert bag((r.doc_id, r.text) for r in kept.collect()) == bag(rows[i] for i in first)


def test_near_dedup_family_in_large_buckets(spark, monkeypatch):
    """A group of near copies in which many are linked with few others, forced through all rounds of leaders."""
    import random

    r = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(90):
        t = list(base)
        for _ in range(r.randint(0, 9)):
            t[r.randrange(150)] = r.choice([f"v{r.randrange(12)}", f"u{k}"])
        rows.append((k, " ".join(t)))
    want, _ = brute.near(rows, 85)
    for small in (256, 4):
        monkeypatch.setattr(near_dedup, "SMALL", small)
        got = near_dedup.near_dedup_report(frame(spark, rows), percent=85).collect()
        assert bag((x.doc_id, x.n_shingles, x.component_id) for x in got) == bag(want)


def test_min_max_signature_estimates_similarity():
    r = np.random.default_rng(1)
    both, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (600, 150, 150))
    sets = [np.sort(np.concatenate((both, x))) for x in (a, b)]
    s = near_dedup.signatures(np.concatenate(sets), np.array([0, 750, 1500]), 500)
    assert abs((s[0] == s[1]).mean() - 600 / 900) < 0.05


def test_decontamination(spark, rows):
    items = [(k, t) for k, (_, t) in enumerate(rows[:12])] + [(50, "word"), (51, None), (52, "..."), (None, rows[20][1]), (3, rows[3][1])]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n int")
    want = bag(brute.hits(rows, items))
    for how in ({}, {"block_bytes": 300}):
        got = decontam.find_hits(frame(spark, rows), bench, keep=["doc_id"], **how).collect()
        assert bag((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == want
    kept = decontam.decontaminate(frame(spark, rows), bench)
    assert kept.columns == ["doc_id", "text", *EXTRA]
    assert bag((r.doc_id, r.text) for r in kept.collect()) == bag(rows[i] for i, h in enumerate(brute.hits(rows, items)) if not h[2])
    assert decontam.find_hits(frame(spark, rows), bench.limit(0), keep=["doc_id"]).agg(F.sum("n_hit")).first()[0] == 0


def test_longest_matches(spark):
    item = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "a b " + " ".join(f"W{k}" for k in range(4, 21)) + " c"), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = decontam.longest_matches(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, "9", 2, 4, 17)]


def test_windows_of_many_items_are_bounded():
    """A full block of items: memory and time stay small, and equal items count once."""
    import time
    import tracemalloc

    r = np.random.default_rng(2)
    texts = [" ".join(map(str, r.integers(0, 50_000, 200))) for _ in range(1500)]
    tracemalloc.start()
    begin = time.time()
    windows = decontam.Windows([*range(1500), *range(1500)], texts * 2, 10)
    assert time.time() - begin < 60 and tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
    assert len(windows.rows) == 1500 * 191 and windows.ids[3] == ["3"]


def test_line_dedup(spark, rows):
    want = brute.lines(rows)
    got = line_dedup.line_dedup(frame(spark, rows, 1))
    assert got.columns == ["doc_id", "text", *EXTRA]
    assert bag((r.doc_id, r.text) for r in got.collect()) == bag((i, t) for (i, _), t in zip(rows, want))
    report = line_dedup.line_dedup_report(frame(spark, rows, 1)).collect()
    n = lambda t: 0 if t is None else t.count("\n") + 1
    assert bag((r.doc_id, r.n_lines, r.kept_sha256) for r in report) == bag((i, n(t), brute.sha((k or "").encode())) for (i, t), k in zip(rows, want))
    assert all(0 <= r.n_removed <= r.n_lines for r in report)


def test_line_dedup_plan_is_native(spark, rows):
    plan = line_dedup.line_dedup_report(frame(spark, rows, 1))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow(?!EvalNone)", plan)


@pytest.fixture(scope="module")
def model():
    return queries.tokenizer("piece_bpe_32k.model")


def test_pieces_equal_the_library(spark, rows, model):
    import random

    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=model), pieces.Pieces.load(model)
    r = random.Random(3)
    alphabet = list("aeiouthen ssdr  \n\t▁.,:;!?é中文😀\x00<>0x1A/{}()'\"") + ["ing", "▁the", "https", "    "]
    cases = ["", " ", "▁", "  a", "a" * 3000, "the" * 999, " " * 77, "<s></s><0x0A><unk>"] + [t for _, t in rows if t]
    cases += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(1500)]
    for text in cases:
        ids = library.encode(text)
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids)
    for _ in range(1500):
        ids = [r.randrange(32_000) if r.random() < 0.5 else r.randrange(300) for _ in range(6)]
        assert own.decode(ids) == library.decode(ids)
    encoded = pieces.encode(frame(spark, rows), model)
    assert encoded.columns == ["doc_id", "text", *[c for c in EXTRA if c != "ids"], "ids"]
    decoded = pieces.decode(encoded, model).collect()
    assert all(r.decoded == library.decode(list(r.ids)) and list(r.ids) == library.encode(r.text or "") for r in decoded)
    digests = pieces.digests(frame(spark, rows), model, keep=["doc_id"]).collect()
    want = [(i, len(x := library.encode(t or "")), brute.sha(",".join(map(str, x)).encode()), brute.sha(library.decode(x).encode())) for i, t in rows]
    assert bag(tuple(d) for d in digests) == bag(want)


def auc(score, truth):
    rank = np.argsort(np.argsort(score)) + 1
    n = truth.sum()
    return (rank[truth == 1].sum() - n * (n + 1) / 2) / (n * (len(truth) - n))


@pytest.mark.parametrize(("query", "label", "least"), [(queries.op7_quality, "quality", 0.97), (queries.op3_toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, query, label, least):
    found = query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]).all()
    held = found[found.held_out]
    assert auc(held.score.to_numpy(), held[label].to_numpy()) >= least


@pytest.mark.parametrize(("module", "label", "cut"), [(quality, "quality", 0.5), (toxicity, "toxic", 0.7)])
def test_classifiers_on_odd_rows(spark, rows, module, label, cut):
    some = [(i, k % 2, k % 2) for k, (i, _) in enumerate(rows)] + [(None, 1, 1), (5, None, None), (8, 0, 1)]
    labels = spark.createDataFrame(some, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        found = module.score(docs, module.train(docs, known))
        assert found.columns == ["doc_id", "text", *[c for c in EXTRA if c != "score"], "score", "predicted"]
        got = found.collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in got)
        by_text = {}
        assert all(by_text.setdefault(r.text, r.score) == r.score for r in got)


def test_empty_tables(spark, model):
    docs, labels = frame(spark, [], 1), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (suffix_dedup.suffix_dedup_report(docs), near_dedup.near_dedup_report(docs), near_dedup.near_dedup(docs), decontam.find_hits(docs, bench, keep=["doc_id"]), line_dedup.line_dedup_report(docs), pieces.encode(docs, model), quality.score(docs, quality.train(docs, labels)), toxicity.score(docs, toxicity.train(docs, labels))):
        assert df.count() == 0


def test_long_text(spark, model):
    long = " ".join(f"word{k % 977} {k}" for k in range(60_000))
    rows = [(1, long), (2, long[1000:]), (3, long)]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup_report(frame(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == got[2].n_bytes and got[3].n_removed == got[3].n_bytes
    assert {r.component_id for r in near_dedup.near_dedup_report(frame(spark, rows)).collect()} == {1}
    assert all(r.n_tokens > 100_000 for r in pieces.digests(frame(spark, rows), model, keep=["doc_id"]).collect())


def test_anchors_of_long_text(monkeypatch):
    """The same stretches have the same anchors wherever they stand, beyond 2^24 bytes and across steps too."""
    r = np.random.default_rng(6)
    passage = r.integers(97, 123, 400).astype(np.uint8)
    shared = {int(a) for a in suffix_dedup.Segments(passage, np.array([0, 400]), 50).anchor[1:-1]}
    data = r.integers(97, 123, (1 << 24) + 5000).astype(np.uint8)
    places = (1000, (1 << 23) - 200, (1 << 24) - 200, (1 << 24) + 4000)
    for p in places:
        data[p : p + 400] = passage
    s = suffix_dedup.Segments(data, np.array([0, len(data)]), 50)
    for p in places:
        inner = (s.begin > p) & (s.begin + s.count + 49 < p + 400)
        assert set(s.anchor[inner].tolist()) >= shared
    small = suffix_dedup.Segments(data[:5000], np.array([0, 3000, 5000]), 50)
    monkeypatch.setattr(suffix_dedup, "STEP", 70)
    steps = suffix_dedup.Segments(data[:5000], np.array([0, 3000, 5000]), 50)
    assert all((getattr(small, k) == getattr(steps, k)).all() for k in ("begin", "count", "anchor", "text"))


def test_suffix_dedup_beyond_16_mib(spark):
    r = np.random.default_rng(7)
    passage = r.integers(97, 123, 300).astype(np.uint8).tobytes().decode()
    long = r.integers(97, 123, (1 << 24) + 9000).astype(np.uint8).tobytes().decode()
    long = long[: (1 << 24) + 777] + passage + long[(1 << 24) + 777 :]
    got = {x.doc_id: x for x in suffix_dedup.suffix_dedup_report(frame(spark, [(1, "before " + passage), (2, long)])).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans) == (0, 300, 1)


def exact_weights(texts, words):
    """What each word weighs under models counted in dicts from (text, class) pairs."""
    import math
    from collections import Counter

    spelt = lambda w: [(b" " * 5 + w + b" ")[k : k + 6] for k in range(len(w) + 1)]
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", t.translate(brute.LOWER).encode())
    level = [Counter(g for t, c in texts if c == k for w in split(t) for g in spelt(w)) for k in (0, 1)]
    levels = {6: level}
    for order in range(5, 0, -1):
        level = [Counter(g[1:] for g in x) for x in level]
        level = [level[0] + level[1], Counter()] if order == 2 else level
        levels[order] = level

    def p(g, c):
        out = 1 / 256
        for order in range(1, 7):
            table = levels[order][0 if order <= 2 else c]
            around = [n for h, n in table.items() if h[:-1] == g[6 - order : -1]]
            if around:
                out = (max(table[g[6 - order :]] - 0.75, 0) + 0.75 * len(around) * out) / sum(around)
        return out

    ratio = lambda w: sum(math.log(p(g, 1) + 1e-12) - math.log(p(g, 0) + 1e-12) for g in spelt(w.encode()))
    return {w: math.log(0.99 + 0.01 * math.exp(ratio(w))) for w in words}


def test_kneser_ney_by_hand():
    """One word of one letter in each class; all numbers from the definition, on paper."""
    import math

    pack = lambda s: int.from_bytes(s.encode(), "big")
    # toxic "b" four times, ordinary "a" four times: n-grams "     a", "    a ", "     b", "    b "
    tables = toxicity.Tables(np.array([pack(g) for g in ("     a", "    a ", "     b", "    b ")]), np.array([4, 4, 0, 0]), np.array([0, 0, 4, 4]))
    # order 1: kinds of what stands before: " " after a and b (2), a (1), b (1); order 2 the same, shared: " a", "a ", " b", "b " once each
    one = (1 - 0.75) / 4 + 0.75 * 3 / 4 / 256
    two = (1 - 0.75) / 2 + 0.75 * 2 / 2 * one  # after a blank: a or b, each once
    high = low = two
    for n in (1, 1, 1, 4):  # orders 3 to 5 count kinds, order 6 tokens; the own class saw the letter, the other only the context
        high, low = (n - 0.75) / n + 0.75 / n * high, 0.75 / n * low
    want = math.log(high + 1e-12) - math.log(low + 1e-12)
    got = tables.log_ratio(np.array([pack("     b"), pack("     a")])) / toxicity.SCALE
    assert got == pytest.approx([want, -want], abs=1e-5)


def test_toxicity_counts_tell_all_grams_apart(spark, monkeypatch):
    """Evidence equals that of exact counts, by tables and by joins, and doesn't depend on how rows are split."""
    r = np.random.default_rng(8)
    bad = "qzxvkjw"
    found = sorted({"".join(x) for x in r.choice(list("abcdefghiklmnoprstu"), (30, 6))})
    texts = [(f"{bad} plain words here", 1)] * 3 + [(" ".join([*found, "plain words here"]), 0)] * 40 + [("other words, Ähnlich", 0)]
    rows = [(k, t) for k, (t, _) in enumerate(texts)]
    labels = spark.createDataFrame([(k, c) for k, (_, c) in enumerate(texts)], "doc_id long, y long")
    asked = [(0, bad), (1, f"{found[0]} here"), (2, None), (3, f"{bad} {bad.upper()} unseen ähnlich plain"), (4, ""), (5, "words " * 300_000)]
    words = {w for _, t in asked for w in (t or "").lower().split()}
    weight = exact_weights(texts, words)
    assert weight[bad] > 1 > weight["words"]
    few = lambda w: (sum(weight[x] for x in w) + 4 * np.log(0.99)) / (len(w) + 4)
    want = {i: few((t or "").lower().split()) for i, t in asked}
    for most in (toxicity.BROADCAST, 0):
        monkeypatch.setattr(toxicity, "BROADCAST", most)
        counts = toxicity.gather(toxicity.count_letters(frame(spark, rows).join(labels, "doc_id"), "text", "y").cache())
        assert isinstance(counts, toxicity.Counts) == (most == 0)
        split = []
        for parts in (1, 5):
            got = toxicity.with_evidence(frame(spark, asked, parts), counts, "text", ["doc_id"], "x double", lambda x: [x])
            assert got.columns == ["doc_id", "x"]
            split.append({x.doc_id: x.x for x in got.collect()})
        assert split[0] == split[1]
        assert split[0] == pytest.approx(want, abs=1e-5)


def test_toxicity_counts_all_rows_outside_fold_1(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BROADCAST", 0)
    ids = spark.range(200).where("pmod(xxhash64(id), 10) = 0 and crc32(encode(cast(id as string), 'utf-8')) % 3 <> 1").collect()
    rows = [(k, "plain words") for k in range(200)] + [(r.id, "zqxjkv") for r in ids]
    labels = spark.createDataFrame([(k, int(k in {r.id for r in ids})) for k in range(200)], "doc_id long, toxic int")
    for sample in (20_000, 2):
        top = toxicity.train(frame(spark, rows), labels, sample=sample).counts.levels[-1]
        found = top.where(F.col("gram") == int.from_bytes(b"zqxjkv", "big")).collect()
        assert len(ids) > 2 and [(r.ordinary, r.toxic) for r in found] == [(0, len(ids))]


def walk(model, x):
    """Margin of one row of statistics, tree by tree from its root."""
    margin = model.base
    for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
        node = 0
        for _ in range(model.depth):
            node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
        margin += leaf[node - len(feature)]
    return margin


def test_boosted_trees_equal_plain_ones():
    """Trees grown by trying every cut of every column on the rows themselves."""
    trees, depth, rate, bins, least, shrink = 4, 3, 0.15, 64, 5.0, 1.0
    r = np.random.default_rng(8)
    x = r.normal(size=(150, 4))
    y = (x[:, 0] * x[:, 1] + 0.3 * r.normal(size=150) > 0).astype(float)
    model = quality.fit(x, y, trees=trees, depth=depth, rate=rate, bins=bins, least=least, shrink=shrink)
    share = (y.sum() + 1) / (len(y) + 2)
    margin = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess, step = p - y, p * (1 - p), np.zeros(len(y))

        def gain(rows):
            return grad[rows].sum() ** 2 / (hess[rows].sum() + shrink)

        def grow(rows, level):
            if level == depth:
                step[rows] = -rate * grad[rows].sum() / (hess[rows].sum() + shrink)
                return
            best = (1e-6, rows, rows[:0])
            for column in x.T:
                for cut in np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])):
                    low, high = rows[column[rows] <= cut], rows[column[rows] > cut]
                    if hess[low].sum() >= least / 4 and hess[high].sum() >= least / 4:
                        best = max(best, (gain(low) + gain(high) - gain(rows), low, high), key=lambda b: b[0])
            for part in best[1:]:
                if len(part):
                    grow(part, level + 1)

        grow(np.arange(len(y)), 0)
        margin += step
    assert np.allclose([walk(model, row) for row in x], margin)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-margin)))


def test_quality_query_equals_a_walk_through_its_trees(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in queries.op7_quality(spark, SF).collect():
        raw = texts[r.doc_id]
        x = quality.statistics(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        assert np.isclose(r.score, 1 / (1 + np.exp(-walk(model, x)))) and r.predicted == (r.score >= 0.5)


def test_quality_sample_with_repeated_ids(spark):
    """The bounded sample doesn't follow the order or the partitions of the documents."""
    rows = [(k % 40, f"{'words ' * (k % 7)}{k} text, {'A' * (k % 5)}") for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    models = [quality.train(frame(spark, part, n), labels, sample=30) for part, n in ((rows, 1), (rows[::-1], 5))]
    for name in ("base", "feature", "cut", "leaf"):
        assert np.array_equal(getattr(models[0], name), getattr(models[1], name))


def test_signatures_are_of_32_bits_and_sets_ascend(monkeypatch):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 64, 900, dtype=np.uint64)
    s = near_dedup.signatures(np.concatenate((values[:800], values[100:])), np.array([0, 800, 800, 1600]), 600)
    assert s.dtype == np.uint32 and not s[1].any()
    assert abs((s[0] == s[2]).mean() - 7 / 9) < 0.06
    monkeypatch.setattr(near_dedup, "hashes", lambda data, begin, end, lane: np.uint64(1 << 63) + (7 * begin % 16).astype(np.uint64))
    one, two, at = near_dedup.shingle_sets(np.frombuffer(b"a b c d e f g hi j k", np.uint8), np.array([0, 11, 11, 20]), 1)
    assert at[1] == at[2] and at[3] == len(one) and all((np.diff(one[a:b].astype(object)) > 0).all() for a, b in zip(at[:-1], at[1:]))
