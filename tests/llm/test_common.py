import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.llm import common, decontam, line_dedup, near_dedup, suffix_dedup


def thue_morse(n):
    """Two unlike words of 2 ** n letters whose polynomial hashes modulo 2 ** 64 are equal for any odd base."""
    word = "a"
    for _ in range(n):
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_unlike_words_that_polynomials_confuse(spark):
    one, other = thue_morse(10)
    docs = spark.createDataFrame([(1, f"{one} b c d e f"), (2, f"{other} b c d e f")], "doc_id long, text string")
    assert sorted(r.component_id for r in near_dedup.near_dedup_report(docs, percent=50).collect()) == [1, 2]
    bench = spark.createDataFrame([(9, one)], "item_id long, text string")
    assert {r.doc_id: list(r["items"]) for r in decontam.find_hits(docs, bench, keep=["doc_id"]).collect()} == {1: ["9"], 2: []}


def test_hashes_depend_on_the_stretch_alone():
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 4000).astype(np.uint8)
    begin = r.integers(0, 3900, 3000)
    end = begin + r.integers(0, 90, 3000)
    for lane in (0, 1):
        by = {}
        for a, b, h in zip(begin, end, common.hashes(data, begin, end, lane)):
            assert by.setdefault(data[a:b].tobytes(), h) == h
        assert len(set(by.values())) == len(by)
    assert (common.hashes(data, begin, end) != common.hashes(data, begin, end, 1)).all()


def test_row_numbers_dont_follow_the_splits(spark, tmp_path):
    """The same file read in other splits: every row keeps its number."""
    path = str(tmp_path / "rows.parquet")
    spark.range(50_000).selectExpr("id AS doc_id", "concat('t ', id) AS text").repartition(3).write.parquet(path)
    seen = []
    try:
        for n in ("2", "8"):
            spark.conf.set("spark.sql.files.minPartitionNum", n)
            rows = common.with_row_id(spark.read.parquet(path).where("doc_id >= 0").select("doc_id"), "n")
            seen.append({r.doc_id: r.n for r in rows.collect()})
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 50_000


def test_clashing_names(spark):
    """Columns named like the operators' own pass through unharmed."""
    names = ["__row", "__text", "__kept", "__lines", "__gaps", "__tail", "__path", "__place", "__number", "node", "row", "key", "a.b", "with space"]
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(k, f"{text}\n{k}", *[f"{c}{k}" for c in range(len(names))]) for k in (5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    bench = spark.createDataFrame([(1, "nothing of that")], "item_id long, text string")
    for out in (suffix_dedup.suffix_dedup(docs), near_dedup.near_dedup(docs, percent=99), line_dedup.line_dedup(docs), decontam.decontaminate(docs, bench), decontam.decontaminate(docs, bench, block_bytes=1)):
        assert out.columns == docs.columns
        assert sorted(tuple(r)[2:] for r in out.collect()) == sorted(r[2:] for r in rows)


def test_no_silent_local_folder(spark, monkeypatch):
    class Context:
        applicationId = "x"

        def __init__(self, master):
            self.master = master

        def getConf(self):
            return {"spark.master": self.master}

    class Session:
        conf = {}

        def __init__(self, master):
            self.sparkContext = Context(master)

    with pytest.raises(ValueError):
        common.shared_dir(Session("spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_dir(Session("local-cluster[3,2,1000]"))
    assert common.shared_dir(Session("local[4]")) == common.shared_dir(Session("local[4]"))


def test_release(spark):
    kept = common.materialise(spark.range(3), "kept")
    gone = common.materialise(spark.range(3), "gone")
    common.release(gone)
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(gone._scratch_path)


def test_picked_beyond_the_broadcast(spark, monkeypatch):
    rows, few = spark.range(10), common.materialise(spark.range(3, 6), "few")
    for most in (100, 0):
        monkeypatch.setattr(common, "PICKED", most)
        assert sorted(r.id for r in common.picked(rows, few, "id").collect()) == [3, 4, 5]
        assert common.picked(rows, few, "id", "left_anti").agg(F.count("*")).first()[0] == 7
