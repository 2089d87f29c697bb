"""Token ids in training order: fixed-stride binary shards under a keyed permutation.

Texts are encoded, each followed by an end id, and laid end to end in the order in which the table is read; every ``length``
ids are a sequence, the last filled up with the end id. A keyed Feistel permutation over the least even number of bits, walked
along its cycle until it falls among the sequences, gives each sequence a global slot: the training order. Range partitions
of slots are the shards: files of ``per_shard`` sequences of equal stride, so slot k lies at byte (k mod per_shard) * stride of
file k div per_shard, and reading can stop and resume at any slot. A manifest holds all that a reader needs.

The encoded texts are written once, with their place in their partition; the partitions' totals, one number each, go to the
driver. Shards are written whole under a name of the task and renamed, with bytes that depend on the table, its splits and the
key alone, so a repeated task replaces a file by its equal.

Defined cases: a null or empty text is an end id alone; repeated rows are encoded each; an empty table gives a manifest
without shards; long texts are encoded whole. Only the text column is read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, chunks, materialise, mixed, scratch, small_batches

ROUNDS = 6
DTYPE = np.dtype("<u2")


class Permutation:
    """A keyed bijection of 0 .. n - 1."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) + mixed(np.array([key & (2**64 - 1)], np.uint64)))
        self.mask = np.uint64((1 << self.half) - 1)

    def _network(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & self.mask)
        return right << np.uint64(self.half) | left

    def _walk(self, x: np.ndarray, keys) -> np.ndarray:
        out = self._network(np.asarray(x, np.uint64), keys)
        while len(far := np.flatnonzero(out >= np.uint64(self.n))):
            out[far] = self._network(out[far], keys)
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, self.keys)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        """The inverse: the output's halves are crossed, so the same network undoes it with the keys from last to first."""
        return self._walk(slot, self.keys[::-1])


class Encoder:
    """A byte-level BPE vocabulary of at most 65,535 ids, shipped by value; the end id is the first free one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.end, self._made = ranks, pattern, max(ranks.values()) + 1, None
        if self.end > np.iinfo(DTYPE).max:
            raise ValueError("ids don't fit two bytes")

    @staticmethod
    def load(path: str, pattern: str) -> Encoder:
        with open(path, "rb") as lines:
            return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def encode(self, text: str | None) -> list[int]:
        if self._made is None:
            import tiktoken

            self._made = tiktoken.Encoding("shards", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self._made.encode_ordinary(text or "")


def _encode(shared: Shared):
    """Per slice of texts: partition, place of its first id in the partition, number of ids, ids."""

    def run(batches):
        place, part = 0, TaskContext.get().partitionId()
        for whole in batches:
            for batch in chunks(whole, "t"):
                encoder = shared.value
                ids = np.concatenate([np.array([*encoder.encode(t), encoder.end], DTYPE) for t in batch.column("t").to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([zstandard.compress(ids.tobytes(), 3)], pa.binary())], names=["part", "place", "n", "ids"])
                place += len(ids)

    return run


def _deal(bases: Shared, manifest: dict):
    """Per slice and shard the pieces of sequences: sequence, place in it and length of each, and their ids."""

    def run(batches):
        length, order = manifest["length"], Permutation(manifest["sequences"], manifest["key"])
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(zstandard.decompress(row["ids"], max_output_size=2 * row["n"]), DTYPE)
                start = bases.value[row["part"]] + row["place"]
                sequence = np.arange(start // length, (start + len(ids) - 1) // length + 1)
                begin = np.maximum(sequence * length, start)
                end = np.minimum((sequence + 1) * length, start + len(ids))
                shard = order.slot(sequence) // manifest["per_shard"]
                rank = np.argsort(shard, kind="stable")
                edge = np.flatnonzero(np.concatenate(([True], np.diff(shard[rank]) > 0, [True])))
                for a, b in zip(edge[:-1], edge[1:]):
                    k = rank[a:b]
                    raw = np.stack([sequence[k], begin[k] - sequence[k] * length, end[k] - begin[k]]).tobytes()
                    raw += b"".join(ids[x - start : y - start].tobytes() for x, y in zip(begin[k], end[k]))
                    yield pa.RecordBatch.from_arrays([pa.array([int(shard[k[0]])], pa.int64()), pa.array([len(k)], pa.int32()), pa.array([len(raw)], pa.int64()), pa.array([zstandard.compress(raw, 3)], pa.binary())], names=["shard", "n", "n_raw", "pieces"])

    return run


def _write(folder: str, manifest: dict):
    """One shard: at most per_shard sequences, put at their slots."""

    def run(table: pa.Table) -> pa.Table:
        shard, length = table["shard"][0].as_py(), manifest["length"]
        first = shard * manifest["per_shard"]
        out = np.full((min(manifest["per_shard"], manifest["sequences"] - first), length), manifest["end"], DTYPE)
        order = Permutation(manifest["sequences"], manifest["key"])
        for n, n_raw, packed in zip(*(table[c].to_pylist() for c in ("n", "n_raw", "pieces"))):
            raw = zstandard.decompress(packed, max_output_size=n_raw)
            sequence, at, size = np.frombuffer(raw, np.int64, 3 * n).reshape(3, n)
            ids, used = np.frombuffer(raw, DTYPE, offset=24 * n), 0
            for row, a, k in zip((order.slot(sequence) - first).tolist(), at.tolist(), size.tolist()):
                out[row, a : a + k] = ids[used : used + k]
                used += k
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        name, own = shard_name(shard), f"{root}/.{uuid.uuid4().hex}"
        with files.open_output_stream(own) as stream:
            stream.write(out.tobytes())
        files.move(own, f"{root}/{name}")
        return pa.table({"shard": [shard], "file": [name], "slots": pa.array([len(out)], pa.int64()), "sha256": [hashlib.sha256(out.tobytes()).hexdigest()]})

    return run


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(docs: DataFrame, folder: str, encoder: Encoder, *, text_col: str = "text", length: int = 2048, per_shard: int = 1024, key: int = 20240229) -> tuple[DataFrame, dict]:
    """Writes shards and manifest.json under ``folder``, a URI that all executors reach; (shard, file, slots, sha256) and the manifest."""
    spark = docs.sparkSession
    small_batches(spark)
    encoded = materialise(docs.select(F.col(text_col).alias("t")).mapInArrow(_encode(Shared(spark, encoder)), "part int, place long, n long, ids binary"), "shards-encoded")
    totals = {r["part"]: r["n"] for r in encoded.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    size = np.zeros(max(totals, default=-1) + 2, np.int64)
    for part, n in totals.items():
        size[part + 1] = n
    bases = np.cumsum(size)
    manifest = {"ids": int(bases[-1]), "sequences": -(-int(bases[-1]) // length), "length": length, "per_shard": per_shard, "key": key, "end": encoder.end, "dtype": DTYPE.str}
    pieces = encoded.mapInArrow(_deal(Shared(spark, bases), manifest), "shard long, n int, n_raw long, pieces binary")
    listed = materialise(pieces.groupBy("shard").applyInArrow(_write(folder, manifest), "shard long, file string, slots long, sha256 string"), "shards-list")
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/manifest.json") as stream:
        stream.write(json.dumps(manifest).encode())
    return listed, manifest


def read_from(folder: str, slot: int = 0):
    """(slot, ids) one after the other from ``slot`` on, in training order."""
    files, root = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{root}/manifest.json") as stream:
        m = json.loads(stream.read())
    stride = m["length"] * np.dtype(m["dtype"]).itemsize
    while slot < m["sequences"]:
        with files.open_input_file(f"{root}/{shard_name(slot // m['per_shard'])}") as stream:
            stream.seek(slot % m["per_shard"] * stride)
            while raw := stream.read(stride):
                yield slot, np.frombuffer(raw, m["dtype"])
                slot += 1


def read_shards(spark: SparkSession, listed: DataFrame, folder: str, manifest: dict) -> DataFrame:
    """One row a slot, read back from the files: slot, sequence, shard, byte_offset, n_ids without filling, first_id and ids_sha256."""
    stride = manifest["length"] * DTYPE.itemsize

    def run(batches):
        order = Permutation(manifest["sequences"], manifest["key"])
        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_stream(f"{root}/{row['file']}") as stream:
                    raw = stream.read()
                if hashlib.sha256(raw).hexdigest() != row["sha256"] or len(raw) != row["slots"] * stride:
                    raise ValueError(f"{row['file']} is damaged")
                slot = row["shard"] * manifest["per_shard"] + np.arange(row["slots"])
                sequence = order.sequence(slot)
                parts = [raw[k * stride : (k + 1) * stride] for k in range(row["slots"])]
                n = np.minimum(manifest["ids"] - sequence * manifest["length"], manifest["length"])
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(sequence), pa.array(np.full(len(slot), row["shard"])), pa.array(np.arange(len(slot)) * stride), pa.array(n), pa.array([int(np.frombuffer(p, DTYPE, 1)[0]) for p in parts], pa.int32()), pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())], names=["slot", "sequence", "shard", "byte_offset", "n_ids", "first_id", "ids_sha256"])

    return listed.repartition(max(1, min(listed.count(), 10_000))).mapInArrow(run, "slot long, sequence long, shard long, byte_offset long, n_ids long, first_id int, ids_sha256 string")


def round_trip(docs: DataFrame, encoder: Encoder, **how) -> DataFrame:
    """The shards of docs, written to the shared folder and read back slot by slot."""
    folder = scratch(docs.sparkSession, "shards")
    listed, manifest = write_shards(docs, folder, encoder, **how)
    return read_shards(docs.sparkSession, listed, folder, manifest)
