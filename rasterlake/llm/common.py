"""What the operators share: scratch tables, Arrow batches as flat byte arrays, word splitting, rolling hashes."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import sys
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at a time.
CHUNK_BYTES = 1 << 20
P64 = np.uint64(0x9E3779B97F4A7C15 | 1)
NULL_ID = np.iinfo(np.int64).max


#: Row numbers that are broadcast at most, to pick rows of another table; more are joined by a shuffle.
PICKED = 2_000_000
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset a local session gets a temporary folder; on a cluster it is an error, as executors wouldn't see each other's files."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not found:
        if not (conf.get("spark.master") or "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        found = _local_dirs.setdefault(key, "") or "file://" + tempfile.mkdtemp(prefix="rasterlake-")
        _local_dirs[key] = found
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a query deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, tidied: bool = False) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: it cuts the lineage and fixes the rows. With ``tidied`` the shuffle files that made it are deleted at once, else when the driver's JVM next collects its garbage."""
    path, conf = scratch(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    if tidied:
        conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidied:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the tables behind frames that materialise() returned; nothing that is still to be computed may read them."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches, where they are larger, to few rows and bytes, so that long texts don't fill a Python worker. The settings stay, as results are computed later."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 500), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 * CHUNK_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def tidy(work):
    """work, a function of an iterator of batches or of a table, with trim() after each task or table."""

    @functools.wraps(work)
    def run(given):
        try:
            if isinstance(given, pa.Table):
                return work(given)
            return over(given)
        finally:
            if isinstance(given, pa.Table):
                trim()

    def over(batches):
        try:
            yield from work(batches)
        finally:
            trim()

    return run


class Shared:
    """A model of bounded size, broadcast with its class's code; each worker process unpacks it once and keeps the last one."""

    def __init__(self, spark: SparkSession, value):
        self.packed, self.key = spark.sparkContext.broadcast(zlib.compress(cloudpickle.dumps(value), 1)), uuid.uuid4().hex

    @property
    def value(self):
        kept = sys.__dict__.setdefault("_rasterlake_shared", {})
        if self.key not in kept:
            kept.clear()
            kept[self.key] = cloudpickle.loads(zlib.decompress(self.packed.value))
        return kept[self.key]


def quoted(name: str) -> F.Column:
    """The column of that very name, whatever letters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many underscores behind it as make it unlike every column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _is_scan(df: DataFrame) -> bool:
    """Whether df only reads, filters and projects Parquet files, so that each row has a file and a place in it."""

    def plain(node) -> bool:
        children = node.children()
        if children.isEmpty():
            return node.toString().startswith("Relation") and node.toString().strip().endswith("parquet")
        return node.nodeName() in ("Project", "Filter", "SubqueryAlias", "View") and plain(children.head())

    return "_metadata" not in df.columns and plain(df._jdf.queryExecution().analyzed())


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """A number for each row, from its file, in order of paths, and its place there: the same whenever and however the files are split for reading. What isn't read from Parquet files is written to the shared folder first."""
    df = df if _is_scan(df) else materialise(df, "rows")
    path, place, number = fresh(df, "__path", "__place", "__number")
    files = df.select(F.col("_metadata.file_path").alias(path)).distinct()
    files = files.withColumn(number, F.row_number().over(Window.orderBy(path)).cast("long"))
    rows = df.select(*map(quoted, df.columns), F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
    row = F.shiftleft(number, 40).bitwiseOR(F.col(place))
    return rows.join(F.broadcast(files), path).select(*map(quoted, df.columns), row.alias(name))


def picked(df: DataFrame, rows: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """df's rows whose number is among those of the table ``rows`` (or, with left_anti, isn't); up to PICKED numbers are broadcast, so that df isn't shuffled."""
    few = rows.count() <= PICKED
    return df.join(F.broadcast(rows.select(on)) if few else rows.select(on).hint("merge"), on, how)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind).fill_null(b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        at = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def integers(column: pa.Array) -> np.ndarray:
    """An integer column; null becomes NULL_ID."""
    return column.cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text; a longer text comes alone."""
    if not batch.num_rows:
        return
    _, at = flat(batch.column(text))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def crc_fold(doc_id: np.ndarray) -> np.ndarray:
    """crc32 of the id as text, modulo 3."""
    return np.fromiter((zlib.crc32(b"%d" % x) % 3 for x in doc_id.tolist()), np.int64, len(doc_id))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x reaches every bit of the result."""
    x = x.astype(np.uint64, copy=True)
    high = np.empty_like(x)
    x ^= np.right_shift(x, np.uint64(30), out=high)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=high)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=high)
    return x


#: Stretches of more bytes than this are hashed one by one, unless another bound is given.
LONG = 64


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lane: int = 0, long: int = LONG) -> np.ndarray:
    """A 64-bit hash of each stretch data[begin:end]; equal stretches have equal hashes, and those of unlike lanes are independent. Stretches are taken in words of eight bytes, each mixed into all bits before the next, so that no sum of powers can cancel; long ones by BLAKE2."""
    size = end - begin
    out = mixed(size.astype(np.uint64) + np.uint64(0x51 + 0x9E3779B97F4A7C15 * (lane + 1) % (1 << 64)))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    active, done = np.flatnonzero((size > 0) & (size <= long)), 0
    while len(active):
        word = np.ascontiguousarray(words[begin[active] + done]).view("<u8").ravel() & masks[np.minimum(size[active] - done, 8)]
        out[active] = mixed(out[active] ^ word)
        done += 8
        active = active[size[active] > done]
    key = b"%d" % lane
    for k in np.flatnonzero(size > long).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[begin[k] : end[k]], digest_size=8, key=key).digest(), "little")
    return out


def powers(n: int, base: np.uint64 = P64) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, int(base)
    while done < len(out):
        more = min(done, len(out) - done)
        np.multiply(out[:more], np.uint64(step), out=out[done : done + more])
        done, step = done + more, step * step % (1 << 64)
    return out


INVERSE = np.uint64(pow(int(P64), -1, 1 << 64))


class Rolling:
    """Polynomial hashes of any stretches of a byte array, from running sums. They only say where to look: unlike stretches may share one."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n)[:n], out=self.sums[1:])
        self.back = powers(n + 1, INVERSE)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of data[begin:end], mixed; equal stretches of unlike place have equal hashes."""
        return mixed((self.sums[end] - self.sums[begin]) * self.back[begin])

    def each(self, begin: int, end: int, size: int) -> np.ndarray:
        """Of the stretches of ``size`` bytes that begin from begin to end - 1, as ``of`` gives them."""
        return mixed((self.sums[begin + size : end + size] - self.sums[begin:end]) * self.back[begin:end])


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [low, high), and the range of each."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - low, size), which


def unlike(data: np.ndarray, begin: np.ndarray, end: np.ndarray, other: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Whether each stretch data[begin:end] differs from the bytes of ``other`` from ``there`` on; about CHUNK_BYTES are compared at a time."""
    out = np.zeros(len(begin), bool)
    part = np.cumsum(end - begin) // CHUNK_BYTES
    edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(edge[:-1], edge[1:]):
        place, which = spread(begin[a:b], end[a:b])
        out[a + which[data[place] != other[place + (there[a:b] - begin[a:b])[which]]]] = True
    return out


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words_in(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of word bytes, none across texts, and n + 1 offsets of the texts' words."""
    flags = np.zeros(len(data) + 1, bool)
    flags[:-1] = is_word[data]
    starts = flags.copy()
    starts[1:] &= ~flags[:-1]
    inner = at[(at < len(data))]
    starts[inner] = flags[inner]
    begin = np.flatnonzero(starts)
    stops = np.zeros(len(data) + 1, bool)
    stops[1:] = flags[:-1] & (~flags[1:] | starts[1:])
    edge = at[at > 0]
    stops[edge] = flags[edge - 1]
    end = np.flatnonzero(stops)
    return begin, end, np.searchsorted(begin, at)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def byte_set(*ranges: tuple[int, int], invert: bool = False) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return ~out if invert else out


def map_texts(docs: DataFrame, text_col: str, keep: list[str], fields: str, work) -> DataFrame:
    """docs' columns ``keep`` and new ones (``fields``, as DDL) that ``work(data, at, batch)`` returns as arrays; it gets the texts' bytes end to end, their n + 1 offsets and the batch, in which the texts come last. A kept column of a new one's name is left out."""
    small_batches(docs.sparkSession)
    added = docs.sparkSession.createDataFrame([], fields).schema
    keep = [c for c in keep if c not in added.names]
    names = [*keep, *fresh(docs, "__text")]
    rows = docs.select(*map(quoted, keep), quoted(text_col).alias(names[-1]))
    plain = rows.toDF(*[f"c{k}" for k in range(len(names))])  # mapInArrow can't take names with dots
    schema = plain.drop(plain.columns[-1]).schema
    for f in added.fields:
        schema = schema.add("new_" + f.name, f.dataType)

    @tidy
    def run(batches):
        for whole in batches:
            for batch in chunks(whole.rename_columns(names), names[-1]):
                data, at = flat(batch.column(names[-1]))
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in work(data, at, batch)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*keep, *added.names)


def fold_of(column) -> F.Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.encode(column.cast("string"), "utf-8")) % 3
