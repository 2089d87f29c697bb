"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown here in numpy on binned features, then flattened to arrays, so that a batch of documents goes down all trees
at once. The fit sees at most ``sample`` labelled rows (those of smallest id hash), a documented bound; every document is
scored. Labels are only taken from rows whose crc32(id) mod 3 is not 1; a score depends on the text alone.

Defined cases: a null or empty text has all statistics 0 and still gets a score; null ids are not held out and never
labelled; null labels are left out and of several labels of an id the smallest holds; without labels, or with labels of one
class, each score is the smoothed share of label 1; repeated rows are scored alike. Extra columns pass through, except those
named as an output, which are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, byte_set, fold_of, hashes, map_texts, mixed, quoted, words_in

SPACE = byte_set((32, 32), (9, 13))
NEWLINE = byte_set((10, 10))
CLASSES = (
    byte_set((65, 90)),
    byte_set((97, 122)),
    byte_set((48, 57)),
    SPACE,
    byte_set((128, 255)),
    byte_set((44, 44), (46, 46)),
    byte_set((33, 43), (45, 45), (47, 47), (58, 64), (91, 96), (123, 126)),
    byte_set((124, 124)),
)
N_STATISTICS = 24


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return sums[at[1:]] - sums[at[:-1]]


def _repeats(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each key has been seen before in its text."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.argsort(mixed(keys + mixed(text.astype(np.uint64))), kind="stable")
    k, t = keys[order], text[order]
    again = np.zeros(len(keys), bool)
    again[order[1:]] = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    return again


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """N_STATISTICS numbers for each text."""
    n = np.diff(at).astype(np.float64)
    begin, end, words = words_in(data, at, ~SPACE)
    lines_begin, lines_end, lines = words_in(data, at, ~NEWLINE)
    word, line = hashes(data, begin, end), hashes(data, lines_begin, lines_end)
    n_words, n_lines = np.diff(words).astype(np.float64), np.diff(lines).astype(np.float64)
    share = lambda x, of: np.divide(x, of, out=np.zeros_like(of), where=of > 0)
    same = np.zeros(len(word), bool)
    same[1:] = word[1:] == word[:-1]
    same[words[:-1][n_words > 0]] = False
    run = np.ones(len(data), bool)
    run[1:] = data[1:] != data[:-1]
    run[at[:-1][n > 0]] = True
    triple = word.copy()
    triple[2:] = mixed(word[2:] * np.uint64(3) + mixed(word[1:-1] * np.uint64(5) + mixed(word[:-2])))
    for early in (0, 1):  # no words of the text before
        few = words[:-1][n_words > early] + early
        triple[few] = word[few]
    length = (end - begin).astype(np.float64)
    last, first = data[end - 1] if len(end) else data[:0], data[begin] if len(begin) else data[:0]
    again = _repeats(line, lines)
    columns = [
        np.log1p(n),
        np.log1p(n_words),
        share(_per_text(length, words), n_words),
        share(_per_text(length**2, words), n_words),
        *(share(_per_text(c[data], at), n) for c in CLASSES),
        share(_per_text(~_repeats(word, words), words), n_words),
        share(_per_text(same, words), n_words),
        share(_per_text(~_repeats(triple, words), words), n_words),
        np.log1p(n_lines),
        share(n, n_lines),
        share(_per_text(again, lines), n_lines),
        share(_per_text(np.where(again, lines_end - lines_begin, 0), lines), n),
        share(_per_text(CLASSES[6][last] | CLASSES[7][last], words), n_words),
        share(_per_text(CLASSES[0][first], words), n_words),
        share(_per_text(length <= 2, words), n_words),
        share(_per_text(length >= 12, words), n_words),
        share(_per_text(~run, at), n),
    ]
    return np.stack(columns, 1)


class Boosted:
    """Gradient-boosted trees of full depth as flat arrays: node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, depth: int):
        self.base, self.feature, self.cut, self.leaf, self.depth = base, feature, cut, leaf, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            margin += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, shrink: float = 1.0) -> Boosted:
    """Logistic boosting; every split is chosen from histograms of gradients over quantile bins."""
    share = (y.sum() + 1) / (len(y) + 2)
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if len(y) == 0 or y.min() == y.max():
        return Boosted(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), depth)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    f, margin = x.shape[1], np.full(len(y), base)
    flat_bin = binned + np.arange(f) * bins
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node, feature, cut, level_cut = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = ((node - first) * f * bins)[:, None] + flat_bin
            hist = [np.bincount(slot.ravel(), np.repeat(v, f), width * f * bins).reshape(width, f, bins) for v in (grad, hess)]
            left = [np.cumsum(h, 2) for h in hist]
            total = [v[:, :, -1:] for v in left]
            right = [t - v for t, v in zip(total, left)]
            gain = left[0] ** 2 / (left[1] + shrink) + right[0] ** 2 / (right[1] + shrink) - total[0] ** 2 / (total[1] + shrink)
            gain[(left[1] < least / 4) | (right[1] < least / 4)] = -1
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[first + k], cut[first + k], level_cut[first + k] = j, cuts[j][b], b
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > level_cut[node])
        at = node - inner
        value = -rate * np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + shrink)
        margin += value[at]
        features.append(feature)
        thresholds.append(cut)
        leaves.append(value)
    return Boosted(base, np.array(features), np.array(thresholds), np.array(leaves), depth)


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000) -> Boosted:
    """Fitted on at most ``sample`` labelled documents outside fold 1, those of least id hash; of repeated ids each row counts, with the id's least label."""
    lone = labels.select(quoted(id_col).alias("i"), quoted(label_col).alias("y")).where(F.col("y").isNotNull() & (fold_of(F.col("i")) != 1))
    chosen = lone.groupBy("i").agg(F.min("y").cast("double").alias("y")).withColumn("h", F.xxhash64("i")).orderBy("h", "i").limit(sample)
    rows = docs.select(quoted(id_col).alias("i"), quoted(text_col).alias("t")).join(F.broadcast(chosen), "i")
    names = [f"s{k}" for k in range(N_STATISTICS)]
    work = lambda data, at, batch: [x for x in statistics(data, at).T]
    found = map_texts(rows, "t", ["h", "y"], ", ".join(f"{s} double" for s in names), work)
    # ids may stand in several rows: the sample is those of least hash, the same on each run
    found = found.orderBy("h", "y", *names).limit(sample).select("y", *names).toArrow()
    table = np.stack([c.to_numpy() for c in found.columns], 1).reshape(-1, N_STATISTICS + 1)
    table = table[np.lexsort(table.T)]
    return fit(table[:, 1:], table[:, 0])


def score(docs: DataFrame, model: Boosted, *, text_col: str = "text", keep: list[str] | None = None, cut: float = 0.5) -> DataFrame:
    """docs (or their columns ``keep``) with ``score`` and ``predicted``."""
    shared = Shared(docs.sparkSession, model)

    def work(data, at, batch):
        p = shared.value.score(statistics(data, at))
        return p, (p >= cut).astype(np.int32)

    return map_texts(docs, text_col, docs.columns if keep is None else keep, "score double, predicted int", work)
