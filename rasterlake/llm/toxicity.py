"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

One interpolated Kneser-Ney model of order ORDER is kept for toxic and one for ordinary documents. Orders above SHARED have
counts of their own class; the orders up to SHARED, on which rare expressions fall back, are continuation counts that both
classes share. A word is spelled from blanks to its end. As toxic texts are mostly ordinary words, a word of a toxic text comes
from the toxic model with probability OWN and else from the ordinary one. A text's log-likelihood under either class is the sum
over its words; both are normalised by the number of words (with FEW ordinary words added, so that very short texts aren't
decided by one odd word), and their difference is the evidence. A logistic curve, fitted on labelled rows that the counts have
not seen, makes it a probability.

Counts come from the labelled rows outside fold 1 (crc32(id) mod 3), by distributed aggregation of exact n-grams, and grow with
the corpus. Up to BROADCAST distinct n-grams the tables are packed on the driver, broadcast, and looked up by binary search;
beyond that the distinct words of the documents are spelled out, joined with the counts order by order, and the words' weights
joined with the documents. Both ways use all counts and give the same sums, up to one unit of 1 / SCALE a letter.
The curve alone is fitted on a bounded sample (``sample`` rows of smallest id hash among a tenth), under counts of all other
rows; then the sample's n-grams are counted too. All weights are whole units, so a score doesn't depend on how rows are split.

Limit: no context crosses a word, so a phrase of ordinary words has no evidence.

Defined cases: null and empty texts, or texts without a word, have the evidence of ordinary words; long texts are scored whole;
null ids are not held out and never labelled; null labels are left out and of several labels of an id the largest holds; without
labels, or with labels of one class, each score is the smoothed share of label 1. Repeated rows are scored alike. Extra columns
pass through, except those named as an output, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PICKED, Shared, byte_set, chunks, flat, fold_of, fresh, hashes, lower_ascii, map_texts, materialise, quoted, release, small_batches, tidy, with_row_id, words_in

ORDER, SHARED, DISCOUNT = 6, 2, 0.75
#: The share of a toxic text's words that the toxic model makes; ordinary words added to each text.
OWN, FEW = 0.01, 4
LETTERS = byte_set((48, 57), (97, 122), (128, 255))
#: Log ratios are summed in whole units of 1 / SCALE nats, so that the order of rows doesn't matter. A task remembers about SEEN words that it has sent.
SCALE, BROADCAST, SEEN = 1 << 28, 1_500_000, 500_000


def grams(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each letter of each word and its end: it and the ORDER - 1 before it as one number, blanks before the word; and the number of letters of each word, its end included."""
    size = end - begin + 1
    room = size + ORDER - 1
    first = np.cumsum(room) - room + ORDER - 1
    letters = np.full(int(room.sum()), 32, np.int64)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    place = np.repeat(first, size) + within
    inner = within < np.repeat(size - 1, size)
    letters[place[inner]] = data[(np.repeat(begin, size) + within)[inner]]
    packed = np.zeros(len(place), np.int64)
    for k in range(ORDER):
        packed |= letters[place - k] << (8 * k)
    return packed, size


def distinct_words(data: np.ndarray, at: np.ndarray):
    """Lower-cased bytes, begin, end and hash of each distinct word, by rising hash; of each word the number of its distinct word, and n + 1 offsets of the texts' words."""
    data = lower_ascii(data)
    begin, end, words = words_in(data, at, LETTERS)
    key, first, which = np.unique(hashes(data, begin, end), return_index=True, return_inverse=True)
    return data, begin[first], end[first], key, which, words


def weight(ratio: np.ndarray) -> np.ndarray:
    """Log-likelihood of a word in a toxic text less that in an ordinary one, in units, from the log ratio of both letter models in units."""
    return np.rint(np.logaddexp(np.log1p(-OWN), np.log(OWN) + ratio / SCALE) * SCALE).astype(np.int64)


class Tables:
    """Both models as flat arrays, from the exact counts (gram, ordinary, toxic) of all n-grams of ORDER. Of each order: the n-grams, ascending; of each class what its own count gives, and the share that the n-gram's context leaves to the shorter one."""

    def __init__(self, gram: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray):
        order = np.argsort(gram)
        gram, counts = gram[order], [ordinary[order], toxic[order]]
        self.levels = []
        for n in range(ORDER, 0, -1):
            if n < ORDER:
                gram, which = np.unique(gram & ((1 << 8 * n) - 1), return_inverse=True)
                counts = [np.bincount(which[c > 0], minlength=len(gram)) for c in counts]
                if n == SHARED:
                    counts = [counts[0] + counts[1]] * 2
            _, context = np.unique(gram >> 8, return_inverse=True)
            parts = []
            for c in counts:
                total, kinds = np.bincount(context, c), np.bincount(context, c > 0)
                parts.append((np.maximum(c - DISCOUNT, 0) / np.maximum(total, 1)[context]))
                parts.append(np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1)[context])
            self.levels.insert(0, (gram, [x.astype(np.float32) for x in parts]))

    def log_ratio(self, gram: np.ndarray) -> np.ndarray:
        """log p(toxic) - log p(ordinary) of the last letter of each n-gram of ORDER, in units of 1 / SCALE."""
        p = [np.full(len(gram), 1 / 256), np.full(len(gram), 1 / 256)]
        for n, (known, parts) in enumerate(self.levels, 1):
            if not len(known):
                continue
            asked = gram & ((1 << 8 * n) - 1)
            place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            same = known[place] == asked
            # a gram of the same context stands next to where the asked one would
            place = np.where((known[place] >> 8 != asked >> 8) & (place > 0), place - 1, place)
            context = known[place] >> 8 == asked >> 8
            for k in (0, 1):
                own = np.where(same, parts[2 * k][place], 0)
                p[k] = own + np.where(context, parts[2 * k + 1][place], 1) * p[k]
        return np.rint((np.log(p[1] + 1e-12) - np.log(p[0] + 1e-12)) * SCALE).astype(np.int64)

    def weights(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The weight of each word."""
        packed, size = grams(data, begin, end)
        distinct, which = np.unique(packed, return_inverse=True)
        total = np.concatenate(([0], np.cumsum(self.log_ratio(distinct)[which])))
        stop = np.cumsum(size)
        return weight(total[stop] - total[stop - size])


class Counts:
    """For counts of any size: of each order, from 1 on, a table (gram, ordinary, toxic) of exact counts; the orders up to SHARED have them in ``ordinary``."""

    def __init__(self, top: DataFrame):
        self.levels = [top]
        for order in range(ORDER - 1, 0, -1):
            shorter = F.col("gram").bitwiseAND((1 << 8 * order) - 1)
            level = self.levels[0].groupBy(shorter.alias("gram")).agg(*(F.count_if(F.col(c) > 0).alias(c) for c in ("ordinary", "toxic")))
            if order == SHARED:
                level = level.select("gram", (F.col("ordinary") + F.col("toxic")).alias("ordinary"), F.lit(0).cast("long").alias("toxic"))
            self.levels.insert(0, materialise(level, f"toxicity-level-{order}"))

    def log_ratio(self, wanted: DataFrame) -> DataFrame:
        """(gram, ratio): as Tables.log_ratio, of distinct n-grams, by joins."""
        suffix = lambda order: F.col("gram").bitwiseAND((1 << 8 * order) - 1)
        asked = [wanted.select("gram")]
        for order in range(ORDER - 1, 0, -1):
            asked.insert(0, asked[0].select(suffix(order).alias("gram")).distinct())
        known = None
        for order, (rows, level) in enumerate(zip(asked, self.levels), 1):
            names = ("ordinary",) if order <= SHARED else ("ordinary", "toxic")
            context = F.shiftright("gram", 8).alias("context")
            contexts = level.groupBy(context).agg(*[F.sum(c).alias("n_" + c) for c in names], *[F.count_if(F.col(c) > 0).alias("k_" + c) for c in names])
            rows = rows.select("gram", context, suffix(order - 1).alias("shorter")).join(level, "gram", "left").join(contexts, "context", "left")
            rows = rows.withColumns({"p_ordinary": F.lit(1 / 256), "p_toxic": F.lit(1 / 256)}) if known is None else rows.join(known, "shorter")
            p = []
            for c in names:
                n, kinds, count = (F.coalesce(F.col(x), F.lit(0)) for x in ("n_" + c, "k_" + c, c))
                seen = (F.greatest(count - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * F.col("p_" + c)) / F.greatest(n, F.lit(1))
                p.append(F.when(n > 0, seen).otherwise(F.col("p_" + c)))
            known = rows.select(F.col("gram").alias("shorter"), p[0].alias("p_ordinary"), p[-1].alias("p_toxic"))
        ratio = F.log(F.col("p_toxic") + 1e-12) - F.log(F.col("p_ordinary") + 1e-12)
        return known.select(F.col("shorter").alias("gram"), F.round(ratio * SCALE).cast("long").alias("ratio"))

    def lexicon(self, docs: DataFrame, text_col: str) -> DataFrame:
        """(word, weight): the hashes of the distinct words of docs, and their weights."""
        spelled = spell(materialise(words_of(docs, text_col), "toxicity-words"))
        ratios = self.log_ratio(materialise(spelled.select("gram").distinct(), "toxicity-grams"))
        r = F.col("r") / SCALE
        value = F.when(r > 0, r + F.log(F.exp(-r) * (1 - OWN) + OWN)).otherwise(F.log(F.exp(r) * OWN + (1 - OWN)))
        words = spelled.join(ratios, "gram").groupBy("word").agg(F.sum("ratio").alias("r"))
        return materialise(words.select("word", F.round(value * SCALE).cast("long").alias("weight")), "toxicity-lexicon")


def words_of(docs: DataFrame, text_col: str) -> DataFrame:
    """(letters): the distinct words of docs, lower-cased."""

    @tidy
    def run(batches):
        seen = np.zeros(0, np.uint64)
        for whole in batches:
            for batch in chunks(whole, "t"):
                data, begin, end, key, _, _ = distinct_words(*flat(batch.column("t")))
                new = ~np.isin(key, seen)
                begin, size = begin[new], (end - begin)[new]
                seen = np.concatenate((seen if len(seen) < SEEN else seen[:0], key[new]))
                edge = np.concatenate(([0], np.cumsum(size)))
                letters = data[np.arange(edge[-1]) + np.repeat(begin - edge[:-1], size)]
                yield pa.RecordBatch.from_arrays([pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(letters)]).cast(pa.binary())], names=["letters"])

    small_batches(docs.sparkSession)
    return docs.select(quoted(text_col).alias("t")).mapInArrow(run, "letters binary").distinct()


def spell(words: DataFrame) -> DataFrame:
    """(word, gram): the hash of each word and each n-gram of ORDER in it, as often as it stands there."""

    @tidy
    def run(batches):
        for batch in batches:
            data, at = flat(batch.column("letters"))
            packed, size = grams(data, at[:-1], at[1:])
            word = hashes(data, at[:-1], at[1:]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(word, size)), pa.array(packed)], names=["word", "gram"])

    return words.mapInArrow(run, "word long, gram long")


def evidence(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of each text, from its words' weights in sum and its number of words: the difference of its length-normalised log-likelihoods."""
    return (total / SCALE + FEW * np.log1p(-OWN)) / (words + FEW)


def with_evidence(docs: DataFrame, counts: Tables | Counts, text_col: str, keep: list[str], fields: str, work) -> DataFrame:
    """docs' columns ``keep`` and ``fields`` that ``work(evidence)`` returns."""
    if isinstance(counts, Counts):
        return _joined_evidence(docs, counts.lexicon(docs, text_col), text_col, keep, fields, work)
    shared = Shared(docs.sparkSession, counts)

    def run(data, at, batch):
        data, begin, end, _, which, words = distinct_words(data, at)
        total = np.concatenate(([0], np.cumsum(shared.value.weights(data, begin, end)[which])))
        return work(evidence(total[words[1:]] - total[words[:-1]], np.diff(words)))

    return map_texts(docs, text_col, keep, fields, run)


def _joined_evidence(docs: DataFrame, lexicon: DataFrame, text_col: str, keep: list[str], fields: str, work) -> DataFrame:
    """with_evidence for a lexicon of any size: each text's distinct words are joined with it."""
    row, total = fresh(docs, "__row", "__total")

    @tidy
    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "t"):
                _, _, _, key, which, words = distinct_words(*flat(batch.column("t")))
                text = np.repeat(np.arange(batch.num_rows), np.diff(words))
                pair, times = np.unique(text * len(key) + which, return_counts=True)
                rows = batch.column("row").to_numpy()[pair // max(len(key), 1)]
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(key.view(np.int64)[pair % max(len(key), 1)]), pa.array(times)], names=["row", "word", "times"])

    rows = with_row_id(docs, row)
    words = rows.select(quoted(row).alias("row"), quoted(text_col).alias("t")).mapInArrow(run, "row long, word long, times long")
    sums = words.join(lexicon, "word").groupBy(F.col("row").alias(row)).agg(F.sum(F.col("times") * F.col("weight")).alias(total))
    last = lambda data, at, batch: work(evidence(batch.column(total).fill_null(0).to_numpy(zero_copy_only=False), np.diff(words_in(lower_ascii(data), at, LETTERS)[2])))
    return map_texts(rows.join(sums, row, "left"), text_col, [*keep, total], fields, last).drop(total)


def count_letters(rows: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(gram, ordinary, toxic): how often each n-gram of ORDER stands in the texts of each class."""

    def count(data, at, label):
        data, begin, end, _, which, words = distinct_words(data, at)
        packed, size = grams(data, begin, end)
        text = np.repeat(np.arange(len(at) - 1), np.diff(words))
        times = [np.bincount(which[label[text] == c], minlength=len(size)) for c in (0, 1)]
        kind, where = np.unique(packed, return_inverse=True)
        return kind, *(np.bincount(where, np.repeat(t, size), len(kind)).astype(np.int64) for t in times)

    @tidy
    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "t"):
                found = count(*flat(batch.column("t")), batch.column("y").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["gram", "ordinary", "toxic"])

    small_batches(rows.sparkSession)
    rows = rows.select(quoted(text_col).alias("t"), quoted(label_col).cast("long").alias("y"))
    return rows.mapInArrow(run, "gram long, ordinary long, toxic long").groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def gather(top: DataFrame) -> Tables | Counts:
    """The model from a table of exact n-gram counts of ORDER; shorter ones have the number of kinds of letters before them."""
    if top.count() > BROADCAST:
        return Counts(top)
    found = top.toArrow()
    return Tables(*(found[c].to_numpy() for c in ("gram", "ordinary", "toxic")))


def fit_curve(x: np.ndarray, y: np.ndarray, pull: float = 1e-6) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by damped Newton steps on standardised evidence with a slight pull to slope 0."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        return 0.0, float(np.log(share / (1 - share)))
    middle, width = x.mean(), x.std() + 1e-12
    z, w = np.stack([(x - middle) / width, np.ones(len(x))], 1), np.zeros(2)
    ridge = np.diag([pull * len(x), 1e-9])
    loss = lambda w: (np.logaddexp(0, z @ w) - y * (z @ w)).sum() + w @ ridge @ w / 2
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge + 1e-12 * np.eye(2), z.T @ (p - y) + ridge @ w)
        while loss(w - step) > loss(w) and abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / width), float(w[1] - w[0] * middle / width)


class Model:
    def __init__(self, counts: Tables | Counts, slope: float, offset: float):
        self.counts, self.slope, self.offset = counts, slope, offset


def _labelled(texts: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """texts with the labels of the table ``rows``, which is broadcast if it is small, so that the texts aren't shuffled."""
    return texts.join(F.broadcast(rows) if rows.count() <= PICKED else rows.hint("merge"), id_col)


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000) -> Model:
    """The curve from at most ``sample`` of the labelled ids outside fold 1, under counts of the others; the model's counts from all of them."""
    apart = F.pmod(F.xxhash64("i"), F.lit(10)) == 0
    known = labels.select(quoted(id_col).alias("i"), quoted(label_col).alias("y")).where(F.col("y").isNotNull() & (fold_of(F.col("i")) != 1)).groupBy("i").agg(F.max("y").cast("long").alias("y"))
    texts = docs.select(quoted(id_col).alias("i"), quoted(text_col).alias("t"))
    some = materialise(known.where(apart).orderBy(F.xxhash64("i"), "i").limit(sample), "toxicity-apart")
    rest = materialise(known.join(F.broadcast(some.select("i")), "i", "left_anti"), "toxicity-known")
    top = materialise(count_letters(_labelled(texts, rest, "i"), "t", "y"), "toxicity-counts")
    own = materialise(texts.join(F.broadcast(some), "i"), "toxicity-curve")
    found = with_evidence(own, gather(top), "t", ["i", "y"], "x double", lambda x: [x])
    held = found.groupBy("i").agg(F.max("y").alias("y"), F.max("x").alias("x")).orderBy("i").toArrow()  # a row an id, at most ``sample``
    every = top.unionByName(count_letters(own, "t", "y")).groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("ordinary", "toxic")])
    every = materialise(every, "toxicity-counts")
    counts = gather(every)
    release(some, rest, top, own)
    if isinstance(counts, Tables):
        release(every)
    return Model(counts, *fit_curve(held["x"].to_numpy(), held["y"].to_numpy().astype(float)))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None, cut: float = 0.7) -> DataFrame:
    """docs (or their columns ``keep``) with ``score`` and ``predicted``."""
    slope, offset = model.slope, model.offset

    def work(x):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -40, 40)))
        return p, (p >= cut).astype(np.int32)

    return with_evidence(docs, model.counts, text_col, docs.columns if keep is None else keep, "score double, predicted int", work)
