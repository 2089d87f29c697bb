"""Exact-substring dedup with suffix arrays: bytes covered by a stretch of ``length`` bytes that also starts in a document of smaller id.

1. Documents are packed in blocks of some MB. In a block each stretch of ``length`` bytes has an anchor, the leftmost of its
   K-byte strings with the least hash, which depends on the stretch alone: equal stretches have equal anchors. Runs of
   stretches with one anchor are segments, one per about 14 bytes.
2. Blocks send each distinct anchor's hash, packed by buckets of hashes; a bucket answers which anchors may stand in several
   documents, and which are so frequent that their segments are to be taken apart (``hot``).
3. Blocks send the bytes of segments with such anchors, each distinct one with the smallest id in the block, bucketed by
   anchor; of hot anchors each stretch alone, bucketed by its own bytes, so no bucket gathers all that stands around a
   frequent passage. A bucket sorts the suffixes of its segments to ``length`` bytes: deep-shallow, by multikey quicksort on
   words of eight bytes to SHALLOW bytes, then by blind tries for the groups still equal. Equal neighbours in that suffix
   array are the same stretch, whose smallest id is spread; each segment gets a bit for each of its stretches.
4. Blocks join their answers, mark covered bytes and merge them into spans.

Hashes only choose what is compared: segments of a block count as one after their bytes have been compared, and stretches of
several blocks are found equal on their bytes in the suffix array. Matches never cross documents.

Defined cases: null and empty texts have no bytes; a null id counts as larger than all others; rows of equal id are not
"smaller", so none of them loses bytes to the other; texts shorter than ``length`` stay whole. Removal may cut a character:
texts are returned with broken characters replaced. Extra columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Rolling, chunks, flat, fresh, hashes, integers, materialise, mixed, quoted, small_batches, spread, stretches, tidy, unlike, with_row_id

K, SHALLOW, FEW, HOT, BUCKET_BYTES = 24, 16, 1 << 14, 2000, 8 << 20
ANCHOR_BITS = 40
#: Anchors are searched in STEP stretches at a time; a step's places fit in PLACE_BITS.
PLACE_BITS, STEP = 24, 1 << 23


def _pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), level)


def _five(short: np.ndarray) -> np.ndarray:
    """The five bytes of each number below 2 ** ANCHOR_BITS."""
    return short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def _from_five(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view("<u8").ravel()


def pack_segments(group: np.ndarray, least: np.ndarray, count: np.ndarray, text: np.ndarray) -> bytes:
    """Per segment five bytes of its group, its smallest id, by byte planes as most are alike, and its number of stretches; then their bytes."""
    low = group & np.uint64((1 << ANCHOR_BITS) - 1)  # of a bucket; groups that share them are compared in vain
    return _pack(_five(low), least.astype("<i8").view(np.uint8).reshape(-1, 8).T, count.astype(np.uint8), text, level=3)


def unpack_segments(packed: bytes, n: int, n_raw: int) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(zstandard.decompress(packed, max_output_size=n_raw), np.uint8)
    least = np.ascontiguousarray(raw[5 * n : 13 * n].reshape(8, n).T).view("<i8").ravel()
    return _from_five(raw[: 5 * n]), least, raw[13 * n : 14 * n].astype(np.int64), raw[14 * n :]


def _anchors(hashes: Rolling, n: int, w: int) -> np.ndarray:
    """Of each of n stretches where its anchor begins: the leftmost least of the hashes of its w strings of K bytes."""
    anchor = np.empty(n, np.int64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    for a in range(0, n, STEP):  # places count from a, so they fit their bits however long the text is
        m = min(STEP, n - a)
        least = hashes.each(a, a + m + w - 1, K)
        least &= ~low
        least |= np.arange(len(least), dtype=np.uint64)
        done = 1
        while done < w:
            step = min(done, w - done)
            least = np.minimum(least[: len(least) - step], least[step:])
            done += step
        anchor[a : a + m] = (least & low).view(np.int64)
        anchor[a : a + m] += a
    return anchor


def cut(data: np.ndarray, at: np.ndarray, length: int) -> bytes:
    """The segments of a block, two bytes each: the number of stretches, and where behind the segment's begin the anchor is; in order of begin. They follow each other without gaps within a text."""
    n = len(data) - length + 1
    if n <= 0:
        return b""
    anchor = _anchors(Rolling(data), n, length - K + 1)
    valid = np.arange(n) + length <= np.repeat(at[1:], np.diff(at))[:n]
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    begin = np.flatnonzero(new)
    count = np.diff(np.concatenate((np.cumsum(valid)[begin] - 1, [valid.sum()])))
    return np.concatenate((count, anchor[begin] - begin)).astype(np.uint8).tobytes()


class Segments:
    """The segments of a block, from what cut() returned if that is given: begin, number of stretches, anchor hash, text; in order of begin."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int, cuts: bytes | None = None):
        self.hashes = Rolling(data)
        cuts = cut(data, at, length) if cuts is None else cuts
        self.count, behind = np.frombuffer(cuts, np.uint8).reshape(2, -1).astype(np.int64)
        stretches_before = np.concatenate(([0], np.cumsum(np.maximum(np.diff(at) - length + 1, 0))))
        number = np.cumsum(self.count) - self.count
        self.text = np.searchsorted(stretches_before, number, "right") - 1
        self.begin = at[self.text] + number - stretches_before[self.text]
        where = self.begin + behind
        self.anchor = mixed(self.hashes.of(where, where + K) + np.uint64(77))

    def bucket(self, n: int) -> np.ndarray:
        """Of each segment, from its anchor's upper bits."""
        return ((self.anchor >> np.uint64(ANCHOR_BITS)) % np.uint64(n)).astype(np.int64)

    @property
    def short(self) -> np.ndarray:
        return self.anchor & np.uint64((1 << ANCHOR_BITS) - 1)


def _distinct(keys: np.ndarray, ids: np.ndarray):
    """First place of each distinct key, its smallest id, whether it has another id, and each key's number."""
    order = np.lexsort((ids, keys))
    k, i = keys[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    last = np.concatenate((first[1:], [len(k)])) - 1 if len(k) else first
    number = np.empty(len(k), np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(k)])))) if len(k) else first
    return order[first], i[first], i[last] != i[first], number


def _log_code(n: np.ndarray) -> np.ndarray:
    """Counts in one byte, to an eighth of a power of two, rounded up."""
    return np.minimum(np.ceil(8 * np.log2(np.maximum(n, 1))), 255).astype(np.uint8)


class Block:
    """Documents packed in one row: ids, row numbers and texts, and the cuts of their segments, which are made anew where there are none."""

    cuts = None

    def __init__(self, row: dict):
        self.texts = np.frombuffer(zstandard.decompress(row["texts"], max_output_size=row["n_bytes"]) if row["n_bytes"] else b"", np.uint8)
        self.ids, self.rows, self.at = (np.frombuffer(row[c], np.int64) for c in ("ids", "rows", "offsets"))
        self.cuts = zstandard.decompress(row["cuts"], max_output_size=row["n_cuts"]) if row["n_cuts"] else b""

    def segments(self, length: int) -> Segments:
        return Segments(self.texts, self.at, length, self.cuts)


BLOCK = "block long, n_bytes long, n_cuts long, texts binary, ids binary, rows binary, offsets binary, cuts binary"


def pack_blocks(docs: DataFrame, id_col: str, text_col: str, row_col: str, length: int, block_bytes: int) -> DataFrame:
    """Rows of BLOCK; a block is named after its first row and holds its segments' cuts, made once for all steps. A text longer than a block is a block of its own."""
    small_batches(docs.sparkSession)

    @tidy
    def run(batches):
        kept, size = [], 0

        def block():
            table = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            data, at = flat(table.column("t"))
            rows = integers(table.column("r"))
            cuts = cut(data, at, length)
            numbers = (int(rows[0]), len(data), len(cuts))
            packed = (zstandard.compress(data.tobytes(), 3), integers(table.column("i")).tobytes(), rows.tobytes(), at.tobytes(), zstandard.compress(cuts, 3))
            values = [pa.array([x], pa.int64()) for x in numbers] + [pa.array([x], pa.binary()) for x in packed]
            return pa.RecordBatch.from_arrays(values, names=["block", "n_bytes", "n_cuts", "texts", "ids", "rows", "offsets", "cuts"])

        for whole in batches:
            for batch in chunks(whole, "t", block_bytes // 4):
                n = int(flat(batch.column("t"))[1][-1])
                if kept and size + n > block_bytes:
                    yield block()
                    kept, size = [], 0
                kept.append(batch)
                size += n
        if kept:
            yield block()

    return docs.select(quoted(id_col).cast("long").alias("i"), quoted(row_col).alias("r"), quoted(text_col).alias("t")).mapInArrow(run, BLOCK)


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _send_anchors(n_buckets: int, length: int):
    """Per block and bucket the sorted distinct anchors, five bytes each, and the number of unlike segments, its sign bit set for several ids."""

    @tidy
    def run(batches):
        for row in _rows(batches):
            block = Block(row)
            s = block.segments(length)
            if not len(s.begin):
                continue
            ids, bucket = block.ids[s.text], s.bucket(n_buckets)
            content = s.hashes.of(s.begin, s.begin + s.count + length - 1)
            one, _, _, _ = _distinct(mixed(content + s.anchor), ids)
            first, _, several, number = _distinct(s.anchor, ids)
            unlike = np.bincount(number[one], minlength=len(first))
            order = np.lexsort((s.short[first], bucket[first]))
            first, several, unlike = first[order], several[order], _log_code(unlike[order])
            b, short = bucket[first], s.short[first]
            edge = np.searchsorted(b, np.arange(n_buckets + 1))
            for k in np.flatnonzero(np.diff(edge)):
                part = slice(edge[k], edge[k + 1])
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([int(edge[k + 1] - edge[k])], pa.int32()), pa.array([_pack(_five(short[part]), unlike[part], several[part])], pa.binary())], names=["bucket", "block", "n", "anchors"])

    return run


def _answer_anchors(hot: int):
    """Per block of a bucket one byte an anchor: 1 if it may stand in several documents, 2 more if it is hot."""

    @tidy
    def run(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        shorts, codes, several = [], [], []
        for n, packed in zip(sizes, table["anchors"].to_pylist()):
            raw = np.frombuffer(zstandard.decompress(packed, max_output_size=7 * n), np.uint8)
            shorts.append(_from_five(raw[: 5 * n]))
            codes.append(raw[5 * n : 6 * n])
            several.append(raw[6 * n :] > 0)
        short, code, several = (np.concatenate(x) for x in (shorts, codes, several))
        order = np.argsort(short, kind="stable")
        s = short[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        size = np.diff(np.concatenate((first, [len(s)])))
        repeated = (size > 1) | np.logical_or.reduceat(several[order], first)
        total = np.add.reduceat(2.0 ** (code[order] / 8), first)
        flag = np.empty(len(s), np.uint8)
        flag[order] = np.repeat(repeated.astype(np.uint8) + 2 * (repeated & (total > hot)).astype(np.uint8), size)
        edge = np.cumsum([0, *sizes])
        return pa.table({"block": table["block"], "bucket": table["bucket"], "flags": pa.array([_pack(flag[a:b]) for a, b in zip(edge[:-1], edge[1:])], pa.binary())})

    return run


class Chosen:
    """What of a block is compared: segments with anchors in several documents, hot ones as single stretches; deterministic from the block and the flags."""

    def __init__(self, block: Block, flags: list[dict] | None, n_buckets: int, length: int):
        s = block.segments(length)
        bucket = s.bucket(n_buckets)
        first, _, _, number = _distinct(s.anchor, block.ids[s.text])
        order = np.lexsort((s.short[first], bucket[first]))
        flag = np.zeros(len(first), np.uint8)
        got = {f["bucket"]: f["flags"] for f in flags or []}
        edge = np.searchsorted(bucket[first][order], np.arange(n_buckets + 1))
        for k, packed in got.items():
            flag[order[edge[k] : edge[k + 1]]] = np.frombuffer(zstandard.decompress(packed, max_output_size=int(edge[k + 1] - edge[k])), np.uint8)
        flag = flag[number]
        plain, hot = np.flatnonzero(flag == 1), np.flatnonzero(flag == 3)
        each = np.repeat(hot, s.count[hot])
        within = np.arange(len(each)) - np.repeat(np.cumsum(s.count[hot]) - s.count[hot], s.count[hot])
        self.begin = np.concatenate((s.begin[plain], s.begin[each] + within))
        self.count = np.concatenate((s.count[plain], np.ones(len(each), np.int64)))
        self.text = np.concatenate((s.text[plain], s.text[each]))
        self.ids = block.ids[self.text]
        end = self.begin + self.count + length - 1
        own = s.hashes.of(self.begin, end)
        key = np.concatenate((s.anchor[plain], own[len(plain) :]))
        for lane in range(64):  # the first under which segments of equal hash have equal bytes
            found = mixed(own + key) if not lane else hashes(block.texts, self.begin, end, lane, 128)
            self.first, self.least, self.several, self.number = _distinct(found, self.ids)
            same = self.first[self.number]
            others = np.flatnonzero(same != np.arange(len(same)))
            if (self.count == self.count[same]).all() and not unlike(block.texts, self.begin[others], end[others], block.texts, self.begin[same[others]]).any():
                break
        else:
            raise ValueError("segments can't be told apart")
        self.group = key[self.first]
        self.bucket = (mixed(self.group) % np.uint64(n_buckets)).astype(np.int64)
        self.order = np.lexsort((self.group, self.bucket))
        self.edge = np.searchsorted(self.bucket[self.order], np.arange(n_buckets + 1))


def _send_segments(n_buckets: int, length: int):
    @tidy
    def run(batches):
        for row in _rows(batches):
            block = Block(row)
            c = Chosen(block, row["flags"], n_buckets, length)
            for k in np.flatnonzero(np.diff(c.edge)):
                part = c.order[c.edge[k] : c.edge[k + 1]]
                at, count = c.begin[c.first[part]], c.count[c.first[part]]
                size = count + length - 1
                place = np.arange(int(size.sum())) + np.repeat(at - np.cumsum(size) + size, size)
                raw = pack_segments(c.group[part], c.least[part], count, block.texts[place])
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([len(part)], pa.int32()), pa.array([int(14 * len(part) + size.sum())], pa.int64()), pa.array([raw], pa.binary())], names=["bucket", "block", "n", "n_raw", "segments"])

    return run


def shallow_sort(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort on the first ``depth`` words of each row, all open groups a round: a group is split in three by one word of its middle row; rows below and above go on with that word, equal ones with the next. Groups of at most FEW rows are finished together by a plain sort. The order, and where in it groups of rows equal to that depth begin."""
    n = len(words)
    order, new = np.arange(n), np.zeros(n, bool)
    new[:1] = True
    depth = min(depth, words.shape[1])
    start, size, at = np.array([0]), np.array([n]), np.zeros(1, np.int64)
    few_start, few_size = [], []
    while len(start):
        few = (size > 1) & (size <= FEW)
        few_start.append(start[few])
        few_size.append(size[few])
        open_ = size > FEW
        if not open_.any():
            break
        start, size, at = start[open_], size[open_], at[open_]
        first = np.cumsum(size) - size
        group = np.repeat(np.arange(len(start)), size)
        where = np.arange(len(group)) + (start - first)[group]
        rows = order[where]
        key, pivot = words[rows, at[group]], words[order[start + size // 2], at][group]
        parts = [key < pivot, key == pivot, key > pivot]
        counts = [np.add.reduceat(p, first, dtype=np.int64) for p in parts]
        begin = start
        for part, count in zip(parts, counts):  # stable: each part keeps its order
            chosen = np.flatnonzero(part)
            g = group[chosen]
            order[begin[g] + np.arange(len(chosen)) - (np.cumsum(count) - count)[g]] = rows[chosen]
            new[begin[count > 0]] = True
            begin = begin + count
        start = np.concatenate((start, start + counts[0], start + counts[0] + counts[1]))
        size, at = np.concatenate(counts), np.concatenate((at, at + 1, at))
        size[at >= depth] = 0
    where, group = spread(start := np.concatenate(few_start), start + np.concatenate(few_size))
    if len(where):
        rows = order[where]
        rank = np.lexsort((*(words[rows, d] for d in range(depth - 1, -1, -1)), group))
        order[where] = rows = rows[rank]
        new[where[1:]] |= (words[rows[1:], :depth] != words[rows[:-1], :depth]).any(1) | (group[1:] != group[:-1])
    return order, new


def blind_tries(words: np.ndarray, order: np.ndarray, new: np.ndarray, done: int) -> tuple[np.ndarray, np.ndarray]:
    """Orders the groups left by shallow_sort. Each group's trie is built in bulk: all members are compared with one of them, their branch is the first unlike word and its value there, and members of one branch form a subtrie, built in the next round. Returns the order and which rows begin a class of equal rows."""
    order, new = order.copy(), new.copy()
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate((start, [len(order)])))
    open_ = size > 1
    start, size = start[open_], size[open_]
    while len(start):
        where = np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)
        group = np.repeat(np.arange(len(start)), size)
        rows, pivot = order[where], order[(start + size // 2)][group]
        unlike = words[rows, done:] != words[pivot, done:]
        differs = unlike.any(1)
        at = unlike.argmax(1) + done
        value = words[rows, at]
        above = differs & (value > words[pivot, at])
        # in order: below the pivot by rising branch depth, the pivot and its equals, above it by falling depth
        level = np.where(differs, np.where(above, 2 * words.shape[1] - at, at), words.shape[1])
        rank = np.lexsort((np.where(differs, value, 0), level, group))
        order[where] = rows[rank]
        g, lv, v, df = group[rank], level[rank], value[rank], differs[rank]
        split = np.ones(len(where), bool)
        split[1:] = (g[1:] != g[:-1]) | (lv[1:] != lv[:-1]) | (df[1:] & (v[1:] != v[:-1]))
        new[where] |= split
        first = np.flatnonzero(split)
        n = np.diff(np.concatenate((first, [len(where)])))
        more = (n > 1) & df[first]
        start, size = where[first[more]], n[more]
    return order, new


def equal_stretches(windows: np.ndarray) -> np.ndarray:
    """The number of each row's class of equal rows, classes numbered in the order of the suffix array; rows hold whole words of eight bytes."""
    words = windows.view(">u8").astype(np.uint64)
    order, new = shallow_sort(words, SHALLOW // 8)
    order, new = blind_tries(words, order, new, SHALLOW // 8)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number


def _answer_segments(length: int):
    """Per block of a bucket a 32-bit mask a segment: bit i is set if stretch i also starts in a document of smaller id."""
    wide = -(-length // 8) * 8

    @tidy
    def run(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        packets = [unpack_segments(packed, n, n_raw) for n, n_raw, packed in zip(sizes, table["n_raw"].to_pylist(), table["segments"].to_pylist())]
        group, least, count, text = (np.concatenate(x) for x in zip(*packets))
        begin = np.cumsum(count + length - 1) - count - length + 1
        stretch = np.lib.stride_tricks.sliding_window_view(text, length)
        # groups with one block's entry of one text only have nothing to compare with
        _, which, members = np.unique(group, return_inverse=True, return_counts=True)
        compared = np.flatnonzero(members[which] > 1)
        mask = np.zeros(len(group), np.uint32)
        begin_step = 0
        order = compared[np.argsort(which[compared], kind="stable")]
        ends = np.cumsum(count[order])
        while begin_step < len(order):  # some groups at a time, each whole
            end = int(np.searchsorted(ends, (ends[begin_step - 1] if begin_step else 0) + 150_000, "right"))
            end = max(end, begin_step + 1)
            while end < len(order) and which[order[end]] == which[order[end - 1]]:
                end += 1
            part = order[begin_step:end]
            begin_step = end
            seg = np.repeat(np.arange(len(part)), count[part])
            within = np.arange(len(seg)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
            windows = np.zeros((len(seg), wide), np.uint8)
            windows[:, :length] = stretch[begin[part][seg] + within]
            number = equal_stretches(windows)
            smallest = np.full(number.max() + 1, NULL_ID)
            np.minimum.at(smallest, number, least[part][seg])
            found = smallest[number] < least[part][seg]
            np.bitwise_or.at(mask, part[seg[found]], np.uint32(1) << within[found].astype(np.uint32))
        edge = np.cumsum([0, *sizes])
        return pa.table({"block": table["block"], "bucket": table["bucket"], "masks": pa.array([_pack(mask[a:b]) for a, b in zip(edge[:-1], edge[1:])], pa.binary())})

    return run


def _covered(block: Block, flags, masks, n_buckets: int, length: int) -> np.ndarray:
    """Whether each byte of the block goes."""
    c = Chosen(block, flags, n_buckets, length)
    mask = np.zeros(len(c.first), np.uint32)
    for m in masks or []:
        k = m["bucket"]
        mask[c.order[c.edge[k] : c.edge[k + 1]]] = np.frombuffer(zstandard.decompress(m["masks"], max_output_size=4 * int(c.edge[k + 1] - c.edge[k])), np.uint32)
    mine = np.where(c.ids > c.least[c.number], np.uint32(0xFFFFFFFF), mask[c.number])
    seg = np.repeat(np.arange(len(mine)), c.count)
    within = np.arange(len(seg)) - np.repeat(np.cumsum(c.count) - c.count, c.count)
    on = (mine[seg] >> within.astype(np.uint32) & np.uint32(1)) > 0
    at = c.begin[seg[on]] + within[on]
    n = len(block.texts) + 1
    return np.cumsum(np.bincount(at, minlength=n) - np.bincount(at + length, minlength=n))[:-1] > 0


def _results(n_buckets: int, length: int, texts: bool):
    names = ["row", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]

    @tidy
    def run(batches):
        for row in _rows(batches):
            block = Block(row)
            gone = _covered(block, row["flags"], row["masks"], n_buckets, length)
            sums = np.concatenate(([0], np.cumsum(gone)))
            removed = sums[block.at[1:]] - sums[block.at[:-1]]
            spans, shas, kept = [], [], []
            for a, b, n in zip(block.at[:-1].tolist(), block.at[1:].tolist(), removed.tolist()):
                raw = (block.texts[a:b][~gone[a:b]] if n else block.texts[a:b]).tobytes()
                spans.append(len(stretches(gone[a:b])[0]) if n else 0)
                shas.append(hashlib.sha256(raw).hexdigest())
                if texts:
                    kept.append(raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(block.rows), pa.array(block.ids, mask=block.ids == NULL_ID), pa.array(np.diff(block.at)), pa.array(removed), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), *([pa.array(kept, pa.string())] if texts else [])], names=names)

    return run


def _solve(docs: DataFrame, id_col: str, text_col: str, row_col: str, length: int, block_bytes: int, hot: int, texts: bool) -> DataFrame:
    if not K < length <= K + 31:
        raise ValueError(f"length must be from {K + 1} to {K + 31}")
    blocks = materialise(pack_blocks(docs, id_col, text_col, row_col, length, block_bytes), "suffix-blocks", tidied=True)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    n = max(64, -(-total // BUCKET_BYTES))
    anchors = blocks.mapInArrow(_send_anchors(n, length), "bucket int, block long, n int, anchors binary")
    flags = anchors.groupBy("bucket").applyInArrow(_answer_anchors(hot), "block long, bucket int, flags binary")
    flags = flags.groupBy("block").agg(F.collect_list(F.struct("bucket", "flags")).alias("flags"))
    flagged = materialise(flags, "suffix-flags", tidied=True)
    joined = blocks.join(flagged.hint("merge"), "block", "left")
    segments = joined.mapInArrow(_send_segments(n, length), "bucket int, block long, n int, n_raw long, segments binary")
    masks = segments.groupBy("bucket").applyInArrow(_answer_segments(length), "block long, bucket int, masks binary")
    masks = materialise(masks.groupBy("block").agg(F.collect_list(F.struct("bucket", "masks")).alias("masks")), "suffix-masks", tidied=True)
    return joined.join(masks.hint("merge"), "block", "left").mapInArrow(_results(n, length, texts), "row long, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * texts)


def suffix_dedup_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, block_bytes: int = 2 << 20, hot: int = HOT) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))  # numbers that only name blocks, which are written at once
    found = _solve(rows, "id", "text", "row", length, block_bytes, hot, False)
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, block_bytes: int = 2 << 20, hot: int = HOT) -> DataFrame:
    """docs, each text without the bytes that go."""
    row, kept = fresh(docs, "__row", "__kept")
    rows = with_row_id(docs, row)
    found = _solve(rows, id_col, text_col, row, length, block_bytes, hot, True).select(F.col("row").alias(row), F.col("kept").alias(kept))
    out = rows.join(found, row)
    return out.select(*[F.when(quoted(c).isNotNull(), F.col(kept)).alias(c) if c == text_col else quoted(c) for c in docs.columns])


ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, hex(b) AS x, octet_length(b) AS n FROM d),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS p FROM h WHERE n >= 50)),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM w),
f AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM m WHERE first < doc_id),
i AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM f),
r AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY 1, 2),
g AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM r UNION ALL SELECT h.doc_id, coalesce(max(z), 0), any_value(h.n) FROM h LEFT JOIN r ON h.doc_id = r.doc_id GROUP BY 1),
t AS (SELECT g.doc_id, string_agg(substr(h.x, 2 * g.a + 1, 2 * (g.z - g.a)), '' ORDER BY g.a) AS kept FROM g JOIN h ON g.doc_id = h.doc_id GROUP BY 1),
c AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM r GROUP BY 1)
SELECT h.doc_id, h.n::BIGINT AS n_bytes, coalesce(c.removed, 0)::BIGINT AS n_removed, coalesce(c.spans, 0)::BIGINT AS n_spans, sha256(unhex(t.kept)) AS kept_sha256
FROM h LEFT JOIN c ON h.doc_id = c.doc_id LEFT JOIN t ON h.doc_id = t.doc_id
"""
