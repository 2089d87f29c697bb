"""Exact nearest-two matching of descriptors by L1 distance, with ratio and mutual tests.

Matching runs per pair of images: the descriptors of both sides are dealt over cells of bounded size, each cell a group of its own,
so pairs of any size spread over tasks. A cell's distances are taken roughly first, of whole numbers of 16 bits or in single precision; those that may be among
the nearest two, by the bound of that rounding, are taken again in double. Each cell keeps the two nearest of each descriptor. Of equal
descriptors of a side a cell compares the two with the least ids; the others have the same nearest and are nobody's nearest two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Descriptors of a side that a cell holds, about; rows whose distances from all columns are taken together; distances taken again together.
CELL, ROWS, AGAIN = 8192, 64, 1 << 15
#: Partitions that cells are dealt over at least: a cell takes long, and few partitions get unlike numbers of cells.
TASKS = 64
#: Longer vectors have too few steps in whole numbers of 16 bits.
STEPPED = 256


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, e: s + e)


def _cells(left: DataFrame, right: DataFrame, keys: list[str], id_col: str, vector: str) -> DataFrame:
    """(keys, side, id, v, i, j): each row of left (side 0) in all cells (i, j) of its i, each of right (side 1) in all of its j."""
    rows = [df.select(*keys, F.lit(side).alias("side"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).dropna(subset=keys) for side, df in enumerate((left, right))]
    rows = rows[0].unionByName(rows[1])
    parts = [F.ceil(F.count_if(F.col("side") == side) / CELL).cast("int").alias(f"g{side}") for side in (0, 1)]
    large = rows.drop("v", "id").groupBy(*keys).agg(*parts).where("g0 > 1 or g1 > 1")  # few: each has more than CELL rows
    g0, g1 = (F.greatest(F.coalesce(f"g{side}", F.lit(1)), F.lit(1)) for side in (0, 1))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, g0).otherwise(g1)).cast("int")
    dealt = rows.join(F.broadcast(large), keys, "left").withColumns({"_own": own, "_other": F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, g1).otherwise(g0) - 1))})
    return dealt.select(*keys, "side", "id", "v", F.when(F.col("side") == 0, F.col("_own")).otherwise(F.col("_other")).alias("i"), F.when(F.col("side") == 0, F.col("_other")).otherwise(F.col("_own")).alias("j"))


def rounded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Both sides' columns for rough(), and how much its distances may be off, in their unit; infinite if that can't be told."""
    n = a.shape[1]
    low, high = np.minimum(a.min(0), b.min(0)), np.maximum(a.max(0), b.max(0))
    if not (np.isfinite(low).all() and np.isfinite(high).all() and max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) < 1e30):
        return a.T, b.T, np.inf
    sides = [x - (low + high) / 2 for x in (a, b)]
    if n <= STEPPED:
        widest = max(np.abs(x).max(initial=0) for x in sides)
        scale = 65535 // (2 * max(n, 1)) / widest if widest > 1e-30 else 1.0
        steps = [np.rint(x * scale) for x in sides]
        off = sum(np.abs(x * scale - y).sum(1).max() for x, y in zip(sides, steps))
        return *(np.ascontiguousarray(y.T, dtype=np.int16) for y in steps), off + 1e-6
    off = 2 * (n + 4) * 2.0**-24 * sum(np.abs(x).sum(1).max() for x in sides)
    return *(np.ascontiguousarray(x.T, dtype=np.float32) for x in sides), off + 1e-30


def rough(a: np.ndarray, b: np.ndarray, kept: list[np.ndarray] | None = None) -> np.ndarray:
    """Distances of a's columns from b's, in their precision; sums of whole numbers reach 65535. ``kept`` holds the arrays that are used again, so the last distances are gone with the next call."""
    kind = np.uint16 if a.dtype == np.int16 else a.dtype
    kept = [] if kept is None else kept
    if not kept:
        kept += np.empty((a.shape[1], b.shape[1]), kind), np.empty((a.shape[1], b.shape[1]), a.dtype)
    out, part = (x[: a.shape[1]] for x in kept)
    out[:] = 0
    for x, y in zip(a, b):
        np.subtract(x[:, None], y, out=part)
        np.abs(part, out=part)
        out += part.view(kind)
    return out


def copies(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two of least ids of each group of equal rows, and for each row where among them the group's first is."""
    bits = np.ascontiguousarray(rows).view(np.uint64)
    mixed = bits @ (np.random.default_rng(0).integers(1 << 63, size=bits.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    if len(np.unique(mixed)) == len(rows):
        return np.arange(len(rows)), np.arange(len(rows))
    _, group = np.unique(bits.view(f"V{8 * bits.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    third = np.zeros(len(order), bool)
    third[2:] = group[order[2:]] == group[order[:-2]]
    kept = order[~third]
    return kept, np.searchsorted(group[kept], group)


def _spread(own: np.ndarray, other: np.ndarray, d: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """What is found for places in what copies() keeps, for all rows: each has what its group's first has."""
    order = np.argsort(own, kind="stable")
    begin, end = np.searchsorted(own[order], first), np.searchsorted(own[order], first, "right")
    n = end - begin
    take = order[np.repeat(end - np.cumsum(n), n) + np.arange(n.sum())]
    return np.repeat(np.arange(len(first)), n), other[take], d[take]


def _exactly(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.abs(a[i[k : k + AGAIN]] - b[j[k : k + AGAIN]]).sum(1) for k in range(0, len(i), AGAIN)] or [np.zeros(0)])


def _two(own: np.ndarray, ids: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the two of least (d, ids) of each own."""
    order = np.lexsort((ids, d, own))
    third = np.zeros(len(order), bool)
    third[2:] = own[order[2:]] == own[order[:-2]]
    return order[~third]


def _second(d: np.ndarray) -> np.ndarray:
    """At least the second least of each row, from the least of strides; of a single one itself."""
    n = d.shape[1] // 64 * 64
    if n >= 128:
        d = np.minimum.reduce(d[:, :n].reshape(len(d), 64, -1), 1)
    return np.partition(d, 1, 1)[:, 1] if d.shape[1] > 1 else d[:, 0]


def _limit(second: np.ndarray, off: float) -> np.ndarray:
    """What a rough distance is at most if the true one may be among the nearest two."""
    if second.dtype == np.uint16:
        return np.minimum(second + np.int64(np.ceil(2 * off)), 65535).astype(np.uint16)
    return second.astype(float) + 2 * off


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few that are true, in order; eight are looked at together."""
    flat = mask.ravel()
    n = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:n].view(np.uint64))
    which, within = np.nonzero(flat[:n].reshape(-1, 8)[words])
    return np.divmod(np.concatenate((8 * words[which] + within, n + np.flatnonzero(flat[n:]))), mask.shape[1])


def cell_nearest(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, both: bool) -> list[tuple[np.ndarray, ...]]:
    """Of each row of a (and with both, of each of b) the nearest two of the other side: places in a and in b and the distance."""
    (a_kept, a_first), (b_kept, b_first) = copies(a, a_ids), copies(b, b_ids)
    found = _compared(a[a_kept], b[b_kept], a_ids[a_kept], b_ids[b_kept], both)
    i, j, d = _spread(*found[0], a_first)
    out = [(i, b_kept[j], d)]
    if both:
        i, j, d = found[1]
        j, i, d = _spread(j, i, d, b_first)
        out.append((a_kept[i], j, d))
    return out + [()] * (not both)


def _compared(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, both: bool) -> list[tuple[np.ndarray, ...]]:
    """cell_nearest(), each row for itself."""
    left, right, off = rounded(a, b)
    there, near, first, second, arrays = [], [], None, None, []

    def kept(i, j, own, ids):
        d = _exactly(a, b, i, j)
        best = _two(own, ids, d)
        return i[best], j[best], d[best]

    if np.isinf(off):
        for k in range(0, len(a), ROWS):
            i, j = np.indices((min(ROWS, len(a) - k), len(b))).reshape(2, -1)
            there.append(kept(i + k, j, i, b_ids[j]))
        for k in range(0, len(b) if both else 0, ROWS):
            j, i = np.indices((min(ROWS, len(b) - k), len(a))).reshape(2, -1)
            near.append(kept(i, j + k, j, a_ids[i]))
        return [tuple(np.concatenate(x) for x in zip(*f)) for f in (there, near)]
    for k in range(0, len(a), ROWS):
        d = rough(left[:, k : k + ROWS], right, arrays)
        i, j = _where(d <= _limit(_second(d), off)[:, None])
        there.append(kept(i + k, j, i, b_ids[j]))
        if both:  # the least two so far of each of b, of different blocks of rows
            low = d.min(0)
            first, second = (low, np.full_like(low, 65535 if low.dtype == np.uint16 else np.inf)) if first is None else (np.minimum(first, low), np.minimum(second, np.maximum(first, low)))
            limit = _limit(second, off)
            i, j = _where(d <= limit)
            near.append((i + k, j, d[i, j]))
            if sum(len(x[0]) for x in near[1:]) > 64 * AGAIN or k + ROWS >= len(a):
                i, j, d = (np.concatenate(x) for x in zip(*near))
                on = d <= limit[j]
                near = [(i[on], j[on], d[on])]
    if both:
        near = [kept(*near[0][:2], near[0][1], a_ids[near[0][0]])]
    return [tuple(np.concatenate(x) for x in zip(*f)) for f in (there, near)]


def _nearest(left: DataFrame, right: DataFrame, keys: list[str], id_col: str, vector: str, both: bool) -> DataFrame:
    """(keys, side, a, b, d, rank): nearest_two() of left (side 0) and, with both, of right (side 1), from the same distances."""
    cells = _cells(left, right, keys, id_col, vector)
    cells = cells.repartition(max(TASKS, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys, "i", "j")
    schema = cells.select(*keys).schema.add("side", "integer").add("a", "long").add("b", "long").add("d", "double")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, ids = table["side"].to_numpy(), table["id"].to_numpy()
        vectors = table["v"].combine_chunks()
        vectors = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        (a, b), (a_ids, b_ids) = ([x[side == s] for s in (0, 1)] for x in (vectors, ids))
        found = [np.zeros(0, np.int32), *[np.zeros(0, np.int64)] * 2, np.zeros(0)]
        if len(a) and len(b):
            there, back = cell_nearest(a, b, a_ids, b_ids, both)
            found = [np.zeros(len(there[0]), np.int32), a_ids[there[0]], b_ids[there[1]], there[2]]
            if both:
                found = [np.concatenate(x) for x in zip(found, (np.ones(len(back[0]), np.int32), b_ids[back[1]], a_ids[back[0]], back[2]))]
        same = [pa.array([table[k][0].as_py()] * len(found[0]), table[k].type) for k in keys]
        return pa.Table.from_arrays([*same, *map(pa.array, found)], names=[*keys, "side", "a", "b", "d"])

    rank = F.row_number().over(Window.partitionBy(*keys, "side", "a").orderBy("d", "b"))
    return cells.groupBy(*keys, "i", "j").applyInArrow(run, schema).withColumn("rank", rank).where("rank <= 2")


def nearest_two(left: DataFrame, right: DataFrame, keys=("pair_id",), id_col: str = "kp_id", vector: str = "desc") -> DataFrame:
    """(keys, a, b, d, rank): for each row of left the nearest two rows of right within the keys, ties to the smaller id."""
    return _nearest(left, right, list(keys), id_col, vector, False).drop("side")


def ratio_matches(nearest: DataFrame, ratio: float = 0.7, keys=("pair_id",), inclusive: bool = False) -> DataFrame:
    """(keys, a, b, d, ratio): nearest rows clearly nearer than the second. If the second distance is 0 the ratio counts as 1; inclusive admits equality and rejects that case. A lone candidate has no second and is rejected."""
    two = nearest.groupBy(*keys, "a").agg(F.min_by("b", "rank").alias("b"), F.min("d").alias("d"), F.max(F.when(F.col("rank") == 2, F.col("d"))).alias("d2"))
    r = F.when(F.col("d2") == 0, None if inclusive else F.lit(1.0)).otherwise(F.col("d") / F.when(F.col("d2") != 0, F.col("d2")))
    scored = two.withColumn("ratio", r).drop("d2")
    return scored.where(F.col("ratio") <= ratio if inclusive else F.col("ratio") < ratio)


def mutual_matches(left: DataFrame, right: DataFrame, ratio: float = 0.7, keys=("pair_id",), id_col: str = "kp_id", vector: str = "desc") -> DataFrame:
    """(keys, a, b, d, ratio) of matches that hold from both sides, both by ratio."""
    found = ratio_matches(_nearest(left, right, list(keys), id_col, vector, True), ratio, [*keys, "side"], inclusive=True)
    own = F.col("side") == 0
    ends = found.select(*keys, "side", F.when(own, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(own, F.col("b")).otherwise(F.col("a")).alias("b"), F.when(own, F.struct("d", "ratio")).alias("s"))
    return ends.groupBy(*keys, "a", "b").agg(F.max("s").alias("s"), F.count_distinct("side").alias("n")).where("n = 2").select(*keys, "a", "b", "s.d", "s.ratio")


def neighbours(described: DataFrame, seq: str = "seq", group=()) -> tuple[DataFrame, DataFrame]:
    """Left and right side of all pairs of an image with the next in sequence; pair_id is the earlier one's number."""
    return described.withColumn("pair_id", F.col(seq)), described.withColumn("pair_id", F.col(seq) - 1)


def coordinates(matches: DataFrame, left: DataFrame, right: DataFrame, keys=("pair_id",)) -> DataFrame:
    """matches with y1, x1 (left) and y2, x2 (right) of their keypoints."""
    side = lambda df, k, n: df.select(*keys, F.col("kp_id").alias(k), F.col("y").cast("double").alias(f"y{n}"), F.col("x").cast("double").alias(f"x{n}"))
    return matches.join(side(left, "a", 1), [*keys, "a"]).join(side(right, "b", 2), [*keys, "b"])
