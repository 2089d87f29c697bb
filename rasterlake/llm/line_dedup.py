"""Line dedup by overlapping three-line windows, in DataFrame functions alone.

Every window of ``window`` consecutive lines is hashed to 128 bits. Windows that occur more than once anywhere are found by
one aggregation with map-side combine; every occurrence but the first (by id, then row, then line) is removed, and covered
positions of overlapping windows are merged into runs before the text is cut.

Defined cases: a null text stays null and has no lines; an empty text has one empty line; a text of fewer lines than a window
is left as it is; a null id comes after all others; repeated rows count as separate documents, the first read being kept; a
text whose lines all go becomes empty. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted, with_row_id


def _later_windows(rows: DataFrame, window: int) -> DataFrame:
    """(row, p) of each window of lines that an earlier one equals."""
    n = F.size("l")
    parts = lambda i: [F.get("l", i + k) for k in range(window)]
    windows = rows.where(n >= window).select(
        "row",
        "id",
        F.explode(F.transform(F.sequence(F.lit(0), n - window), lambda i: F.struct(i.alias("p"), F.xxhash64(*parts(i)).alias("h"), F.xxhash64(F.lit(window), *parts(i)).alias("g")))).alias("w"),
    )
    windows = windows.select("row", "id", "w.p", "w.h", "w.g")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "p")
    repeated = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    return windows.join(repeated.select("h", "g", "first"), ["h", "g"]).where((F.col("first.row") != F.col("row")) | (F.col("first.p") != F.col("p"))).select("row", "p")


def _kept_lines(docs: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, F.Column, F.Column]:
    """docs with helping columns, and from them the arrays of all lines and of those kept."""
    row, lines, gap, tail = fresh(docs, "__row", "__lines", "__gaps", "__tail")
    docs = with_row_id(docs, row)
    rows = docs.select(F.col(row).alias("row"), quoted(id_col).alias("id"), F.split(quoted(text_col), "\n").alias("l"))
    order = Window.partitionBy("row").orderBy("p")
    before = F.coalesce(F.lag("p").over(order) + window, F.lit(0))
    gaps = _later_windows(rows, window).select("row", "p", before.alias("free"))
    gaps = gaps.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("p") > F.col("free"), F.struct("free", "p")))).alias(gap), (F.max("p") + window).alias(tail))
    piece = lambda begin, end: F.slice(lines, begin + 1, end - begin)
    kept = F.concat(F.flatten(F.transform(gap, lambda g: piece(g["free"], g["p"]))), piece(F.col(tail), F.size(lines)))
    joined = docs.join(gaps.withColumnRenamed("row", row), row, "left").withColumn(lines, F.split(quoted(text_col), "\n"))
    return joined, F.col(lines), F.when(F.col(tail).isNull(), F.col(lines)).otherwise(kept)


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """docs, each text without the lines that repeat an earlier window of ``window`` lines."""
    out, _, kept = _kept_lines(docs, id_col, text_col, window)
    return out.select(*[F.array_join(kept, "\n").alias(c) if c == text_col else quoted(c) for c in docs.columns])


def line_dedup_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """One row a document: id, n_lines, n_removed and the SHA-256 of the text that is kept (of "" for null)."""
    out, lines, kept = _kept_lines(docs.select(quoted(id_col), quoted(text_col)), id_col, text_col, window)
    out = out.select(quoted(id_col), lines.alias("lines"), kept.alias("kept"))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return out.select(
        quoted(id_col),
        size("lines").cast("long").alias("n_lines"),
        (size("lines") - size("kept")).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(F.array_join("kept", "\n"), F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE = """
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(l) - 2)) AS p, l FROM lines WHERE len(l) >= 3),
k AS (SELECT doc_id, p, row_number() OVER (PARTITION BY l[p + 1], l[p + 2], l[p + 3] ORDER BY doc_id, p) AS n FROM w),
gone AS (SELECT DISTINCT doc_id, p + d AS p FROM k, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1),
each AS (SELECT doc_id, unnest(range(0, len(l))) AS p, l FROM lines),
kept AS (SELECT e.doc_id, string_agg(e.l[e.p + 1], chr(10) ORDER BY e.p) AS t, count(*) AS n FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p WHERE g.p IS NULL GROUP BY 1)
SELECT a.doc_id, coalesce(len(a.l), 0)::BIGINT AS n_lines, (coalesce(len(a.l), 0) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM lines a LEFT JOIN kept k ON a.doc_id = k.doc_id
"""
