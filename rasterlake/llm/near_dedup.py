"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct shingles of ``size`` words. Under each hash function both the least and the greatest value
are kept, so half as many functions give the signature; ROWS values make a band, and there are so many bands that a pair at the
threshold meets in none with a probability below MISS. Documents of equal sets become one node at once.

Nodes that meet in a band form a bucket; no bucket's pairs are written out.

1. A bucket names as leader the member that meets most others, and all members are compared with it, on the full sets, which
   are made anew from the texts. Linked members join its component.
2. Buckets with members of several components left, up to SMALL members, are settled: one byte of each signature value tells
   which members may be linked at all (a pair at the threshold is passed over with a probability below PASSED). Members that
   may be linked form clusters, the same cluster of several bands once, and a cluster's sets are compared in one task, in
   blocks of BLOCK_BYTES of text.
3. Larger buckets are split: what the comparison tells - how much a member shares with the leader, and what it has besides -
   decides exactly which members can still be linked with each other. They meet again in narrower buckets, each for one
   shingle outside the leader, which go through the same steps.

So work grows with the members of buckets, and buckets have no cap. A shingle is told from others by 128 bits of hashes.

Defined cases: null and empty texts, or texts without a word, have an empty set and are linked with nothing; fewer than ``size``
words are one shingle; repeated rows are copies. Null ids come after all others; a component of null ids alone has a null id.
Extra columns pass through ``near_dedup``, which keeps the first row (by id, then place) of each component. Long texts are
taken whole: a task holds at most two blocks' sets, or those of two texts that are longer than a block.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, byte_set, flat, fresh, hashes, integers, lower_ascii, map_texts, materialise, mixed, picked, quoted, release, small_batches, tidy, with_row_id, words_in

ROWS, MISS, PASSED = 6, 3e-7, 1e-7
#: Buckets of so many members at most are settled after the first comparison, their sets in blocks of so many bytes of text.
SMALL, BLOCK_BYTES = 1024, 4 << 20
WORD = byte_set((32, 32), (9, 13), invert=True)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def n_bands(percent: int) -> int:
    """Bands, rounded up to whole functions, that a pair at the threshold misses with probability MISS at most."""
    bands = math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))
    return bands + bands % 2


def least_equal(percent: int) -> int:
    """Of a pair at the threshold fewer signature values than these are equal with probability PASSED at most."""
    n, p, below = n_bands(percent) * ROWS, percent / 100, 0.0
    if p >= 1:
        return n
    for k in range(n + 1):
        below += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
        if below > PASSED:
            return k
    return n


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each text's distinct shingles, ascending, and n + 1 offsets."""
    data = lower_ascii(data)
    begin, end, words = words_in(data, at, WORD)
    n = np.diff(words)
    left = np.repeat(words[1:], n) - np.arange(len(begin))
    short = words[:-1][(n > 0) & (n < size)]
    full, keep = max(len(begin) - size + 1, 0), left >= size
    keep[short] = True
    text = np.repeat(np.arange(len(n)), n)[keep]
    lanes = []
    for lane in (0, 1):
        word = hashes(data, begin, end, lane)
        whole, few = word.copy(), word[short]
        for step in range(1, size):
            whole[:full] = mixed(whole[:full] * GOLDEN + word[step : step + full])
            on = np.flatnonzero(left[short] > step)
            few[on] = mixed(few[on] * GOLDEN + word[short[on] + step])
        whole[short] = few
        lanes.append(whole[keep])
    one, two = lanes
    bits = np.uint64(max(len(n).bit_length(), 1))
    order = np.argsort(text.astype(np.uint64) << (np.uint64(64) - bits) | one >> bits)
    one, two = one[order], two[order]  # text stays, being ascending
    within = text[1:] == text[:-1]
    if (within & (one[1:] < one[:-1])).any():  # alike in all bits but the last few
        order = np.lexsort((one, text))
        one, two = one[order], two[order]
    same = within & (one[1:] == one[:-1])
    if (same & (two[1:] != two[:-1])).any():
        order = np.lexsort((two, one, text))
        one, two = one[order], two[order]
        same = within & (one[1:] == one[:-1])
    new = np.ones(len(one), bool)
    new[1:] = ~same | (two[1:] != two[:-1])
    one, two, text = one[new], two[new], text[new]
    return one, two, np.searchsorted(text, np.arange(len(n) + 1))


def signatures(whole: np.ndarray, at: np.ndarray, functions: int) -> np.ndarray:
    """Least and greatest value, of 32 bits, of each set under each function, side by side: n x 2 functions; of non-empty sets. Unlike shingles that are alike in 32 bits can only add to what is compared."""
    seeds = mixed(np.arange(1, 2 * functions + 1, dtype=np.uint64)).astype(np.uint32)
    out = np.zeros((len(at) - 1, 2 * functions), np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        starts, given, value = at[:-1][full], (whole >> np.uint64(32)).astype(np.uint32), np.empty(len(whole), np.uint32)
        for f in range(functions):
            np.bitwise_xor(given, seeds[2 * f], out=value)
            value *= seeds[2 * f + 1] | np.uint32(1)
            out[full, 2 * f] = np.minimum.reduceat(value, starts)
            out[full, 2 * f + 1] = np.maximum.reduceat(value, starts)
    out ^= out >> np.uint32(16)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A hash of each band of ROWS values: the least values of ROWS functions, or their greatest."""
    grouped = np.concatenate((values[:, 0::2], values[:, 1::2]), 1).reshape(len(values), -1, ROWS)
    key = np.broadcast_to(np.arange(grouped.shape[1], dtype=np.uint64) + np.uint64(1), grouped.shape[:2])
    for r in range(ROWS):
        key = mixed(key * GOLDEN + grouped[:, :, r])
    return key


def _fixed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as a binary value."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _sketch(docs: DataFrame, text_col: str, keep: list[str], percent: int, size: int) -> DataFrame:
    """``keep`` with n (set size), name (128-bit name of the set), bands and signature (a byte a value)."""
    bands = n_bands(percent)

    def work(data, at, batch):
        one, two, sets = shingle_sets(data, at, size)
        n = np.diff(sets)
        text = np.repeat(np.arange(len(n)), n)
        name = np.zeros((len(n), 2), np.uint64)
        np.add.at(name[:, 0], text, mixed(one))
        np.add.at(name[:, 1], text, mixed(two))
        name = mixed(name + n[:, None].astype(np.uint64))
        values = signatures(one, sets, bands * ROWS // 2)
        keys = band_keys(values).view(np.int64)
        return pa.array(n), _fixed(name), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(keys.ravel())), _fixed(values.astype(np.uint8))

    return map_texts(docs, text_col, keep, "n long, name binary, bands array<long>, signature binary", work)


@tidy
def _compress(batches):
    for batch in batches:
        data, at = flat(batch.column("t"))
        raw = data.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([zstandard.compress(raw[a:b], 3) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()), pa.array(np.diff(at))], names=["node", "packed", "n_bytes"])


def _sets(packed: list[bytes], n_bytes: list[int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shingle_sets of packed texts, made from CHUNK_BYTES of text at a time."""
    found, begin = [], 0
    while begin < len(packed):
        end, room = begin, 0
        while end < len(packed) and (end == begin or room + n_bytes[end] <= CHUNK_BYTES):
            room += n_bytes[end]
            end += 1
        raw = [zstandard.decompress(p, max_output_size=n) if n else b"" for p, n in zip(packed[begin:end], n_bytes[begin:end])]
        at = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        found.append(shingle_sets(np.frombuffer(b"".join(raw), np.uint8), at, size))
        begin = end
    one, two = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return one, two, np.concatenate(([0], np.cumsum(np.concatenate([np.diff(f[2]) for f in found]))))


def _least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n members the least member of its component under the links (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _clusters(least: int):
    """From rows (key, node, label, signature) in order of key: of each key the clusters of members of several labels that at least ``least`` equal signature bytes may link, as (cluster, node, label), the cluster named after its members."""

    def settle(table: pa.Table):
        key, node, label = (integers(table[c].combine_chunks()) for c in ("key", "node", "label"))
        data, at = flat(table["signature"])
        signature = data.reshape(len(key), -1)
        stop = np.searchsorted(key, key, "right")
        place, i, j = np.arange(len(key)), [], []
        for d in range(1, int((stop - place).max(initial=0))):
            a = np.flatnonzero(place + d < stop)
            a = a[label[a] != label[a + d]]
            for s in range(0, len(a), 8192):
                part = a[s : s + 8192]
                near = part[(signature[part] == signature[part + d]).sum(1) >= least]
                i.append(near)
                j.append(near + d)
        if not i or not sum(map(len, i)):
            return
        i, j = np.concatenate(i), np.concatenate(j)
        group = _least_labels(len(key), i, j)
        inside = np.unique(np.concatenate((i, j)))
        inside = inside[np.lexsort((node[inside], group[inside]))]
        edge = np.flatnonzero(np.concatenate(([True], np.diff(group[inside]) != 0, [True])))
        name = np.repeat([int.from_bytes(hashlib.blake2b(node[inside[a:b]].tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip(edge[:-1], edge[1:])], np.diff(edge))
        yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(node[inside]), pa.array(label[inside])], names=["cluster", "node", "label"])

    @tidy
    def run(batches):
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kept = table if kept is None else pa.concat_tables([kept, table])
            if kept.num_rows < 4 * SMALL:
                continue
            key = integers(kept["key"].combine_chunks())
            whole = int(np.searchsorted(key, key[-1], "left"))  # what belongs to the last key waits
            yield from settle(kept.slice(0, whole))
            kept = kept.slice(whole).combine_chunks()
        if kept is not None:
            yield from settle(kept)

    return run


def _links_within(percent: int, size: int):
    """Labels that the members of one or two blocks link, from the product of their shingle indicators; of a component's links only a tree leaves the task."""

    def run(table: pa.Table) -> pa.Table:
        one, two, at = _sets(table["packed"].to_pylist(), table["n_bytes"].to_pylist(), size)
        n = np.diff(at)
        member = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        token = np.concatenate(([0], np.cumsum((one[1:] != one[:-1]) | (two[1:] != two[:-1]))))[: len(one)]
        member, times = member[order], np.bincount(token)
        often = np.flatnonzero(times > 1)
        place = np.full(len(times), -1)
        place[often] = np.arange(len(often))
        both = np.zeros((len(n), len(n)), np.float32)
        for a in range(0, len(often), 4096):
            low, high = np.searchsorted(token, [often[a], often[min(a + 4096, len(often)) - 1]])
            high = np.searchsorted(token, often[min(a + 4096, len(often)) - 1], "right")
            on = slice(low, high)
            mine = place[token[on]] >= 0
            part = np.zeros((len(n), min(4096, len(often) - a)), np.float32)
            part[member[on][mine], place[token[on]][mine] - a] = 1
            both += part @ part.T
        both = both.astype(np.int64)
        i, j = np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n - both), 1))
        label = integers(table["label"].combine_chunks())
        _, number = np.unique(label, return_inverse=True)
        name = np.zeros(number.max(initial=-1) + 1, np.int64)
        name[number] = label
        root = _least_labels(len(name), number[i], number[j])
        moved = np.flatnonzero(root != np.arange(len(name)))
        return pa.table({"la": pa.array(name[root[moved]]), "lb": pa.array(name[moved])})

    return tidy(run)


def _compared(percent: int, size: int):
    """Of each pair (leader a, member b): whether the full sets reach the threshold, the sizes, how many shingles both have, and of pairs in ``large`` buckets those of b outside a, ascending, that a set linked with b must have some of."""

    def slices(batch):
        """Rows of about CHUNK_BYTES of text, a leader's text counted once."""
        a, n_a, n_b = (integers(batch.column(c)) for c in ("a", "na", "nb"))
        begin = room = 0
        for k in range(len(a)):
            more = int(n_b[k]) + (int(n_a[k]) if k == begin or a[k] != a[k - 1] else 0)
            if k > begin and room + more > CHUNK_BYTES:
                yield batch.slice(begin, k - begin)
                begin, room, more = k, 0, int(n_a[k] + n_b[k])
            room += more
        if len(a):
            yield batch.slice(begin)

    @tidy
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                left, first = batch.column("a").to_pylist(), {}
                for i, a in enumerate(left):
                    first.setdefault(a, i)
                place = {a: j for j, a in enumerate(first)}
                chosen = pa.array(list(first.values()))
                x1, x2, x_at = _sets(batch.column("pa").take(chosen).to_pylist(), batch.column("na").take(chosen).to_pylist(), size)
                y1, y2, y_at = _sets(batch.column("pb").to_pylist(), batch.column("nb").to_pylist(), size)
                found = []
                for i, (a, large) in enumerate(zip(left, batch.column("large").to_pylist())):
                    j = place[a]
                    x, z, y, w = x1[x_at[j] : x_at[j + 1]], x2[x_at[j] : x_at[j + 1]], y1[y_at[i] : y_at[i + 1]], y2[y_at[i] : y_at[i + 1]]
                    near = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    inside = (x[near] == y) & (z[near] == w)
                    both = int(inside.sum())
                    more = y[~inside] if large else y[:0]
                    short = -(-percent * len(y) // 100) - both
                    found.append((100 * both >= percent * (len(x) + len(y) - both), both, len(x), len(y), more[: max(0, len(more) - max(short, 1) + 1)].view(np.int64)))
                linked, both, n_a, n_b, more = zip(*found)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(m) for m in more]))), pa.int32()), pa.array(np.concatenate(more)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "la", "lb", "large")), pa.array(linked), *(pa.array(v, pa.int64()) for v in (both, n_a, n_b)), lists], names=["a", "b", "la", "lb", "large", "linked", "both", "n_a", "n_b", "more"])

    return run


COMPARED = "a long, b long, la long, lb long, large boolean, linked boolean, both long, n_a long, n_b long, more array<long>"


def _merge_labels(links: DataFrame) -> DataFrame:
    """(old, new): each label that occurs in links (la, lb) with the least label of its component. Each step takes the least label next to it, then the label's own label, so a chain shrinks by half."""
    edges = links.select(F.col("la").alias("x"), F.col("lb").alias("y"))
    edges = materialise(edges.union(edges.select("y", "x")).distinct(), "near-edges")
    labels = edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("old"), F.least("x", "m").alias("new"))
    labels = materialise(labels, "near-labels")
    while True:
        near = edges.join(labels, edges.y == labels.old).groupBy("x").agg(F.min("new").alias("m"))
        step = labels.join(near, labels.old == near.x).select("old", F.least("new", "m").alias("new"), F.col("new").alias("was"))
        jump = labels.select(F.col("old").alias("j"), F.col("new").alias("to"))
        step = materialise(step.join(jump, step.new == jump.j, "left").select("old", F.least("new", F.coalesce("to", "new")).alias("new"), "was"), "near-labels")
        release(labels)
        if not step.where("new != was").limit(1).count():
            release(edges)
            return step
        labels = step


def _linked(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after links (la, lb)."""
    links = materialise(links.where("la != lb").select(F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb")).distinct(), "near-links")
    if links.limit(1).count():
        moved = _merge_labels(links)
        old, labels = labels, materialise(labels.join(moved.select("old", "new"), labels.label == moved.old, "left").select("node", F.coalesce("new", "label").alias("label")), "near-components")
        release(moved, old)
    release(links)
    return labels


def _settled(buckets: DataFrame, known: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (la, lb) within buckets (key, node, label) of at most SMALL members; ``known`` has packed, n_bytes and signature of each node."""
    rows = buckets.join(known.select("node", "signature"), "node").select("key", "node", "label", "signature")
    rows = rows.repartition("key").sortWithinPartitions("key", "node")
    clusters = materialise(rows.mapInArrow(_clusters(least_equal(percent)), "cluster long, node long, label long").distinct(), "near-clusters")
    filled = F.sum("n_bytes").over(Window.partitionBy("cluster").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sized = clusters.join(known.select("node", "n_bytes"), "node").withColumn("block", F.floor((filled - F.col("n_bytes")) / BLOCK_BYTES))
    sized = sized.withColumn("last", F.max("block").over(Window.partitionBy("cluster")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), "last"), lambda k: F.struct(F.least("block", k).alias("p"), F.greatest("block", k).alias("q")))
    placed = sized.select("cluster", "node", "label", "last", F.explode(pairs).alias("at")).select("cluster", "at.p", "at.q", "node", "label", "last")
    placed = placed.where("p != q or last = 0").drop("last")
    groups = placed.join(known.select("node", "packed", "n_bytes"), "node")
    found = materialise(groups.groupBy("cluster", "p", "q").applyInArrow(_links_within(percent, size), "la long, lb long"), "near-within")
    release(clusters)
    return found


def _components(nodes: DataFrame, texts, percent: int, size: int) -> DataFrame | None:
    """(node, label) for the nodes that share a bucket; None if there are none. ``texts(candidates)`` gives packed texts by node."""
    bands = nodes.select("node", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = materialise(bands.join(shared, "key").select("key", "node", "m"), "near-buckets")
    rank = materialise(members.groupBy("node").agg(F.sum(F.log2("m")).alias("met")), "near-nodes")
    if not rank.limit(1).count():
        return None
    small_batches(nodes.sparkSession)
    known = materialise(texts(rank).join(picked(nodes.select("node", "signature"), rank, "node"), "node"), "near-texts")
    labels = materialise(rank.select("node", F.col("node").alias("label")), "near-components")
    right = known.select(F.col("node").alias("b"), F.col("packed").alias("pb"), F.col("n_bytes").alias("nb"))
    left = known.select(F.col("node").alias("a"), F.col("packed").alias("pa"), F.col("n_bytes").alias("na"))
    active = members.select("key", "node")
    done = [members]
    while True:
        lead = F.max_by("node", F.struct("met", "node"))
        stars = active.join(rank, "node").groupBy("key").agg(lead.alias("a"), (F.count("*") > SMALL).alias("large"))
        active = materialise(active.join(stars, "key").join(labels, "node").select("key", "node", "label", "a", "large"), "near-open")
        led = active.where("node != a").groupBy("a", F.col("node").alias("b"), F.col("label").alias("lb")).agg(F.max("large").alias("large"))
        pairs = led.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").where("large or la != lb")
        checked = pairs.join(right, "b").join(left, "a").select("a", "b", "la", "lb", "large", "pa", "na", "pb", "nb")
        checked = materialise(checked.mapInArrow(_compared(percent, size), COMPARED), "near-compared")
        labels = _linked(labels, checked.where("linked").select("la", "lb"))
        now = active.select("key", "node", "large").join(labels, "node")
        open_ = now.groupBy("key").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p != q").select("key")
        now = materialise(now.join(open_, "key").select("key", "node", "label", "large"), "near-left")
        release(active, *done)
        within = _settled(now.where("not large").select("key", "node", "label"), known, percent, size)
        labels = _linked(labels, within)
        large = now.where("large")
        if not large.limit(1).count():
            release(rank, checked, known, now, within)
            return labels
        apart = checked.where("large").join(large.select(F.col("node").alias("b")).distinct(), "b")
        active = materialise(_narrower(apart, percent), "near-buckets")
        release(now, within, checked)
        done = [active]


def _narrower(checked: DataFrame, percent: int) -> DataFrame:
    """(key, node): the buckets in which two members of a leader's star still have to meet.

    Two sets that both have been compared with leader a share at most min(both, both') shingles within a. They can be linked only
    if they share some outside a as well - by prefix filter one of ``more``, which becomes a bucket - or if that minimum is enough,
    which asks for sets smaller than a's; these meet in a bucket of their own. Members of all buckets that a leads are taken together:
    all of them rank below a, so the highest rank falls from round to round and the rounds end.
    """
    split = checked.select("a", F.col("b").alias("node"), F.explode("more").alias("t"))
    part = percent / (100 + percent) * (1 - 1e-12)
    close = checked.where((100 * F.col("both") >= percent * F.col("n_b")) & (~F.col("linked") | (F.col("n_b") < F.col("n_a")))).select("a", F.col("b").alias("node"), "both", "n_b", "linked")
    least = close.groupBy("a").agg(F.min("n_b").alias("least"), F.count_if(~F.col("linked")).alias("apart"))
    close = close.join(least, "a").where((F.col("apart") > 0) & (F.col("both") >= part * (F.col("n_b") + F.col("least")))).select("a", "node", F.lit(None).cast("long").alias("t"))
    rows = split.unionByName(close)
    rows = rows.select(F.xxhash64("a", "t").alias("key"), "node").distinct()
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "key")


def _solve(docs: DataFrame, id_col: str, text_col: str, row: str, percent: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(row, id, n, name) of each document, and (name, first) with the first (id is null, id, row) of its component."""
    named = docs.select(quoted(row).alias("row"), quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    rows = materialise(_sketch(named, "text", ["row", "id"], percent, size), "near-sketch")
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    nodes = rows.where("n > 0").groupBy("name").agg(F.min(first).alias("first"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    nodes = materialise(nodes.select(F.col("first.row").alias("node"), "name", "first", "bands", "signature"), "near-sets")

    def texts(chosen: DataFrame) -> DataFrame:
        wanted = picked(named.select(F.col("row").alias("node"), F.col("text").alias("t")), chosen, "node")
        return wanted.mapInArrow(_compress, "node long, packed binary, n_bytes long")

    labels = _components(nodes, texts, percent, size)
    found = nodes.select("node", "name", "first")
    if labels is not None:
        label = found.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        best = label.groupBy("label").agg(F.min("first").alias("best"))
        found = materialise(label.join(best, "label").select("name", F.col("best").alias("first")), "near-first")
        release(nodes, labels)
    else:
        found = found.select("name", "first")
    return rows.select("row", "id", "n", "name"), found


def near_dedup_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = 5) -> DataFrame:
    """One row a document: id, n_shingles, component_id (least id of its component) and kept (whether that is its own id)."""
    (row,) = fresh(docs, "__row")
    rows, found = _solve(with_row_id(docs.select(quoted(id_col), quoted(text_col)), row), id_col, text_col, row, percent, size)
    joined = rows.join(found, "name", "left")
    best = F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), best.alias("component_id"), F.col("id").eqNullSafe(best).alias("kept"))


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = 5) -> DataFrame:
    """docs without the rows of each component but the first."""
    (row,) = fresh(docs, "__row")
    named = with_row_id(docs, row)
    rows, found = _solve(named, id_col, text_col, row, percent, size)
    gone = materialise(rows.where("n > 0").join(found, "name").where(F.col("first.row") != F.col("row")).select(F.col("row").alias(row)), "near-gone")
    return picked(named, gone, row, "left_anti").select(*map(quoted, docs.columns))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * k >= 85 * (a.n + b.n - k)),
c AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN m ON d.doc_id = m.doc_id
"""
