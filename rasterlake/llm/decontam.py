"""Benchmark decontamination with suffix arrays of the training texts.

The documents are taken in shards of some MB. Of a shard's words only runs that occur in the test items' vocabulary can match,
so the shard's suffix array holds the suffixes of those runs, ordered by prefix doubling to the depth of a window. Every test
window is binary-searched in it, and places on one diagonal join to the longest verbatim matches with their locations. These
say which words are hit, which items occur, and so which documents go. Words are found by hashes and compared byte by byte.

The test items, equal ones once, are broadcast in blocks of about ``block_bytes`` of text (some ten times that in a task's
memory): usually one; a larger set is searched block by block, each a pass over the documents, and each document's hits are
merged afterwards. A single longer item is a block.

Words are maximal runs of digits, letters and characters beyond ASCII, A-Z in lower case. A window is ``window`` consecutive
words of an item; an item of fewer words, but not none, is one window. Defined cases: null and empty texts have no words and
no hits; items without words match nothing; items with a null id hit words but aren't listed; equal item ids are listed once;
repeated documents are judged alike, each in its own row; with an empty benchmark nothing is hit. Extra columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, byte_set, chunks, flat, fresh, hashes, lower_ascii, map_texts, quoted, small_batches, spread, tidy, unlike, with_row_id, words_in

LETTERS = byte_set((48, 57), (97, 122), (128, 255))


def split_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, begin and end of each word, and n + 1 offsets of the texts' words."""
    data = lower_ascii(data)
    return data, *words_in(data, at, LETTERS)


class Windows:
    """The distinct windows of a block of items, as rows of word numbers (from 1; 0 beyond a short window's end). Items of equal text are one, with several ids."""

    def __init__(self, ids: list, texts: list, window: int):
        by_text: dict[str, set] = {}
        for i, text in zip(ids, texts):
            by_text.setdefault(text or "", set()).update([] if i is None else [str(i)])
        self.ids = [sorted(x) for x in by_text.values()]
        raw = [x.encode() for x in by_text]
        at = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        data, begin, end, words = split_words(np.frombuffer(b"".join(raw), np.uint8), at)
        for self.lane in range(64):  # the first under which no two words of the items share a hash
            self.vocabulary, first, number = np.unique(hashes(data, begin, end, self.lane), return_index=True, return_inverse=True)
            size = end - begin
            if (size == size[first][number]).all() and not unlike(data, begin, end, data, begin[first][number]).any():
                break
        else:
            raise ValueError("the items' words can't be told apart")
        self.size = size[first]
        self.begin = np.cumsum(self.size) - self.size
        self.letters = data[spread(begin[first], end[first])[0]]
        n = np.diff(words)
        start, item = spread(words[:-1], words[:-1] + np.where(n > 0, np.maximum(n - window + 1, 1), 0))
        length = np.minimum(words[item + 1] - start, window)
        inside = np.arange(window) < length[:, None]
        table = np.zeros((len(start), window), np.int32)
        table[inside] = (number[np.minimum(start[:, None] + np.arange(window), max(len(number) - 1, 0))] + 1)[inside] if len(number) else 0
        whole = table.view([("", np.void, 4 * window)]).ravel()
        order = np.argsort(whole, kind="stable") if len(whole) else np.zeros(0, np.int64)
        new = np.ones(len(order), bool)
        new[1:] = (table[order[1:]] != table[order[:-1]]).any(1)
        self.rows = table[order[new]]
        self.length = length[order[new]]
        self.item, self.place = item[order], (start - words[item])[order]
        self.first = np.append(np.flatnonzero(new), len(order))

    def numbers(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word in the vocabulary; 0 for others."""
        out = np.zeros(len(begin), np.int64)
        if len(self.vocabulary) and len(begin):
            key = hashes(data, begin, end, self.lane)
            near = np.minimum(np.searchsorted(self.vocabulary, key), len(self.vocabulary) - 1)
            same = np.flatnonzero((self.vocabulary[near] == key) & (self.size[near] == end - begin))
            same = same[~unlike(data, begin[same], end[same], self.letters, self.begin[near[same]])]
            out[same] = near[same] + 1
        return out


def suffix_array(numbers: np.ndarray, depth: int) -> np.ndarray:
    """The places of ``numbers`` in the order of what follows to ``depth`` numbers, by prefix doubling; 0 ends a suffix."""
    n = len(numbers)
    ranks, done, rank = {1: numbers}, 1, numbers
    shifted = lambda r, k: np.concatenate((r[k:], np.zeros(min(k, n), r.dtype)))[:n]
    while done < depth:
        step = min(done, depth - done)
        step = max(k for k in ranks if k <= step)
        following = shifted(ranks[step], done)
        _, rank = np.unique(rank.astype(np.int64) << 32 | following, return_inverse=True)
        done += step
        ranks[done] = rank = rank.astype(np.int64)
    return np.argsort(rank, kind="stable")


def intervals(numbers: np.ndarray, order: np.ndarray, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a window's numbers the part of the suffix array that begins with it, by binary search of all at once."""
    padded = np.concatenate((numbers, np.zeros(rows.shape[1], numbers.dtype)))
    inside = np.arange(rows.shape[1]) < length[:, None]

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(order))
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            there = padded[order[middle][:, None] + np.arange(rows.shape[1])]
            unlike = (there != rows[open_]) & inside[open_]
            at = unlike.argmax(1)
            sign = np.where(unlike.any(1), np.sign(there[np.arange(len(at)), at] - rows[open_][np.arange(len(at)), at]), 0)
            right = sign < 0 if not upper else sign <= 0
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        return low

    return bound(False), bound(True)


def occurrences(windows: Windows, known: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word at which each occurrence of a window begins in the shard, whose words have the numbers ``known``, and the window's row."""
    none = np.zeros(0, np.int64)
    if not len(windows.rows) or not len(known):
        return none, none
    numbers = np.zeros(len(known) + len(words), np.int64)
    text = np.repeat(np.arange(len(words) - 1), np.diff(words))
    slot = np.arange(len(known)) + text
    numbers[slot] = known
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (numbers > 0).view(np.int8), [0]))))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= windows.length.min()
    places, _ = spread(begin[long], end[long] + 1)
    if not len(places):
        return none, none
    part = numbers[np.minimum(places, len(numbers) - 1)]
    part[places >= len(numbers)] = 0
    order = suffix_array(part, windows.rows.shape[1])
    low, high = intervals(part, order, windows.rows, windows.length)
    found, row = spread(low, high)
    back = np.zeros(len(numbers) + 1, np.int64)
    back[slot] = np.arange(len(known))
    return back[places[order[found]]], row


def matches(windows: Windows, data: np.ndarray, at: np.ndarray):
    """n + 1 offsets of the texts' words, and the longest verbatim matches: text, item, first word in the shard and in the item, number of words."""
    data, begin, end, words = split_words(data, at)
    place, row = occurrences(windows, windows.numbers(data, begin, end), words)
    each, source = spread(windows.first[row], windows.first[row + 1])
    place, length, item, spot = place[source], windows.length[row][source], windows.item[each], windows.place[each]
    text = np.searchsorted(words, place, "right") - 1
    order = np.lexsort((place, place - spot, item, text))
    place, length, item, spot, text = place[order], length[order], item[order], spot[order], text[order]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (spot[1:] != spot[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place))[: len(first)] - 1
    return words, text[first], item[first], place[first], spot[first], place[last] + length[last] - place[first]


def _runs(windows: Windows, data: np.ndarray, at: np.ndarray):
    """Per text, from its longest matches: number of words, begins and ends of runs of hit words, ids of the items that hit."""
    words, source, item, place, _, length = matches(windows, data, at)
    n = len(at) - 1
    marks = np.zeros(words[-1] + 1, np.int64)
    np.add.at(marks, place, 1)
    np.add.at(marks, place + length, -1)
    hit = np.concatenate((np.cumsum(marks)[:-1] > 0, [False]))
    start, stop = hit.copy(), np.zeros(len(hit) + 1, bool)
    start[1:] &= ~hit[:-1]
    cut = words[words < words[-1]]
    start[cut] = hit[cut]
    stop[1:] = hit & np.concatenate((~hit[1:] | start[1:], [True]))
    begin, end = np.flatnonzero(start), np.flatnonzero(stop)
    text = np.searchsorted(words, begin, "right") - 1
    sizes = np.bincount(text, minlength=n)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    base = words[text]
    listed: list[set] = [set() for _ in range(n)]
    for t, k in np.unique(np.stack([source, item], 1), axis=0).tolist():
        listed[t].update(windows.ids[k])
    return (
        pa.array(np.diff(words), pa.int64()),
        pa.ListArray.from_arrays(offsets, pa.array(begin - base, pa.int32())),
        pa.ListArray.from_arrays(offsets, pa.array(end - base, pa.int32())),
        pa.array([sorted(s) for s in listed], pa.list_(pa.string())),
    )


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int):
    """The benchmark's windows, block by block, each collected under its checked size; equal items once."""
    rows = benchmark.select(quoted(item_col).alias("i"), quoted(text_col).alias("t")).distinct()
    total = rows.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).toArrow()
        yield n, Windows(got["i"].to_pylist(), got["t"].to_pylist(), window)


def find_hits(docs: DataFrame, benchmark: DataFrame, *, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """Columns ``keep`` of docs with n_words, n_hit (words inside an occurrence of a window), items (sorted ids that occur) and runs (array of begin, end in words)."""
    fields = "n_words long, __begin array<int>, __end array<int>, items array<string>"
    found = None
    for n, windows in _blocks(benchmark, item_col, item_text_col, window, block_bytes):
        if n > 1 and found is None:
            (row,) = fresh(docs, "__row")
            docs = with_row_id(docs, row)
        shared = Shared(docs.sparkSession, windows)
        part = map_texts(docs, text_col, [row] if n > 1 else keep, fields, lambda data, at, batch, s=shared: _runs(s.value, data, at))
        found = part if found is None else found.unionByName(part)
    if n > 1:
        lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) if c == "items" else F.flatten(F.collect_list(c)).alias(c) for c in ("__begin", "__end", "items")]
        merged = found.groupBy(row).agg(F.max("n_words").alias("n_words"), *lists)
        found = docs.select(row, *map(quoted, keep)).join(merged, row)
    runs = F.array_sort(F.arrays_zip("__begin", "__end"))
    count = F.aggregate(
        runs,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach")),
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["__end"] - F.greatest(s["reach"], r["__begin"]))).alias("n"), F.greatest(s["reach"], r["__end"]).alias("reach")),
    )
    return found.select(*map(quoted, keep), "n_words", count["n"].alias("n_hit"), "items", runs.alias("runs"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without those of which a word is hit."""
    return find_hits(docs, benchmark, keep=docs.columns, **how).where("n_hit = 0").select(*map(quoted, docs.columns))


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """One row a verbatim match that can't be made longer: doc id, item id (as text; items of null id aren't listed), first word in both, number of words."""
    out = None
    small_batches(docs.sparkSession)
    for _, windows in _blocks(benchmark, item_col, item_text_col, window, block_bytes):
        shared = Shared(docs.sparkSession, windows)

        @tidy
        def run(batches, shared=shared):
            for whole in batches:
                for batch in chunks(whole, "t"):
                    w = shared.value
                    words, text, item, place, spot, size = matches(w, *flat(batch.column("t")))
                    each = np.repeat(np.arange(len(item)), [len(w.ids[k]) for k in item.tolist()])
                    name = pa.array([i for k in item.tolist() for i in w.ids[k]], pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[each])), name, pa.array((place - words[text])[each]), pa.array(spot[each]), pa.array(size[each])], names=["i", "item_id", "doc_word", "item_word", "n_words"])

        kind = docs.select(quoted(id_col).alias("i")).schema.add("item_id", "string").add("doc_word", "long").add("item_word", "long").add("n_words", "long")
        part = docs.select(quoted(id_col).alias("i"), quoted(text_col).alias("t")).mapInArrow(run, kind).withColumnRenamed("i", id_col)
        out = part if out is None else out.unionByName(part)
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hits AS (SELECT dw.doc_id, dw.p, dw.k, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
