"""SentencePiece encoding and decoding for models of merge type (BPE), exact and without the library at run time.

A text, blanks written as the mark U+2581 and one put before it, falls into units between letters that no piece has side by
side, so that no merge can cross them. A unit is encoded
by backtracking: an Aho-Corasick automaton gives the longest piece at each place; a piece may follow another only if merging
the letters of both anew gives just these two; a piece that may not is shortened to the longest piece that begins it, then
the one before it is taken back; a bitfield of places from which no way leads on keeps the search linear. Characters without
a piece become byte pieces. Units met often are kept in a cache of at most CACHE units, which only saves time.

Defined cases: null and empty texts have no ids and decode to the empty text; ids of control pieces decode to nothing, runs
of byte pieces that aren't UTF-8 to replacement characters, one a byte. Texts are encoded whole, however long. Extra columns
pass through, except those named as an output, which are replaced; repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib
import heapq
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Shared, map_texts

MARK, UNKNOWN, CACHE, CACHED_LENGTH = "▁", " ⁇ ", 200_000, 48


class Pieces:
    """The vocabulary: (piece, score, kind) by id; kind is "piece", "byte", "unknown" or "none"."""

    def __init__(self, vocabulary: list[tuple[str, float, str]]):
        self.vocabulary = vocabulary
        self._ready = False

    @staticmethod
    def load(path: str) -> Pieces:
        """From a model file, read on the driver."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else "none" if m.is_control(i) else "piece"
        return Pieces([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())])

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "_ready": False}

    def prepare(self) -> None:
        """Builds the automaton, the tables of lengths and of shorter pieces, and the empty caches."""
        if self._ready:
            return
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.vocabulary) if kind == "piece"}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.vocabulary) if kind == "byte"}
        self.score = [s for _, s, _ in self.vocabulary]
        self.length = [len(p) for p, _, _ in self.vocabulary]
        self.shorter = [-1] * len(self.vocabulary)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, i)
            self.shorter[i] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), -1)
        self.automaton.make_automaton()
        self.n = len(self.vocabulary)
        inner = sorted({p for piece in self.ids for p in piece if len(piece) > 1})
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(x) for x in inner]] = np.arange(1, len(inner) + 1)
        self.kinds = len(inner) + 1
        self.beside = np.zeros(self.kinds**2, bool)
        for piece in self.ids:
            at = self.kind[[ord(x) for x in piece]]
            self.beside[at[:-1] * self.kinds + at[1:]] = True
        self.letters = {p for p in self.ids if len(p) == 1}
        self.decimal = [str(i) for i in range(len(self.vocabulary))]
        self.surface = [p.replace(MARK, " ") if kind == "piece" else UNKNOWN if kind == "unknown" else "" for p, _, kind in self.vocabulary]
        self.is_byte = {i for i, (_, _, kind) in enumerate(self.vocabulary) if kind == "byte"}
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, tuple] = {}
        self._ready = True

    def merge(self, text: str) -> list[str]:
        """The pieces into which merging the letters ends, best score first, the leftmost of equals."""
        part = list(text)
        after = list(range(1, len(part))) + [-1]
        before = list(range(-1, len(part) - 1))
        ids, score, heap = self.ids, self.score, []

        def offer(i: int, j: int) -> None:
            if (k := ids.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-score[k], i, j, self.length[k]))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, n = heapq.heappop(heap)
            if not part[i] or not part[j] or after[i] != j or len(part[i]) + len(part[j]) != n:
                continue
            part[i] += part[j]
            part[j] = ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in part if p]

    def agree(self, a: int, b: int) -> bool:
        """Whether the pieces a and b, merged anew from their letters, stay as they are."""
        found = self.pairs.get(a * self.n + b)
        if found is None:
            if len(self.pairs) >= 600_000:
                self.pairs.clear()
            p, q = self.vocabulary[a][0], self.vocabulary[b][0]
            found = self.pairs[a * self.n + b] = self.merge(p + q) == [p, q]
        return found

    def backtrack(self, unit: str) -> list[int]:
        """The ids of a stretch of letters that all have pieces."""
        n, count, length, shorter, pairs = len(unit), self.n, self.length, self.shorter, self.pairs
        longest = [-1] * (n + 1)
        for end, k in self.automaton.iter(unit):
            longest[end + 1 - length[k]] = k
        failed, any_failed, out, at, k, last = bytearray((n >> 3) + 1), False, [], 0, longest[0], -1
        while at < n:
            if k < 0:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                k = out.pop()
                at -= length[k]
                k, last = shorter[k], out[-1] if out else -1
                continue
            end = at + length[k]
            fits = not (any_failed and failed[end >> 3] >> (end & 7) & 1)
            if fits and last >= 0 and (fits := pairs.get(last * count + k)) is None:
                fits = self.agree(last, k)
            if fits:
                out.append(k)
                at, last, k = end, k, longest[end]
            else:
                k = shorter[k]
        return out

    def unit(self, unit: str) -> list[int]:
        if self.letters.issuperset(unit):
            return self.backtrack(unit)
        out, begin = [], 0
        for at, letter in enumerate(unit):
            if letter not in self.letters:
                if begin < at:
                    out += self.backtrack(unit[begin:at])
                out += [self.bytes[b] for b in letter.encode()]
                begin = at + 1
        return out + self.backtrack(unit[begin:]) if begin < len(unit) else out

    def _known(self, unit: str) -> tuple:
        """(ids, ids in decimal joined by commas, decoded text) of a unit."""
        ids = self.unit(unit)
        known = (ids, ",".join([self.decimal[i] for i in ids]), self._joined(ids))
        if len(unit) <= CACHED_LENGTH:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[unit] = known
        return known

    def units(self, text: str) -> list[tuple]:
        """What is known of the text's units: it is cut between letters that stand side by side in no piece."""
        self.prepare()
        if not text:
            return []
        marked = (MARK + text).replace(" ", MARK)
        kind = self.kind[np.frombuffer(marked.encode("utf-32-le"), np.uint32)]
        cuts = (np.flatnonzero(~self.beside[kind[:-1] * self.kinds + kind[1:]]) + 1).tolist()
        get, known = self.cache.get, self._known
        return [get(u := marked[a:b]) or known(u) for a, b in zip([0, *cuts], [*cuts, len(marked)])]

    def encode(self, text: str | None) -> list[int]:
        return [i for ids, _, _ in self.units(text or "") for i in ids]

    def _joined(self, ids: list[int]) -> str:
        surface = self.surface
        if self.is_byte.isdisjoint(ids):
            return "".join([surface[i] for i in ids])
        out, raw = [], bytearray()
        for i in ids:
            if i in self.is_byte:
                raw.append(int(self.vocabulary[i][0][3:5], 16))
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            out.append(surface[i])
        return "".join(out) + (_utf8(raw) if raw else "")

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the blank that encoding put before it goes."""
        self.prepare()
        first = next((i for i in ids if self.vocabulary[i][2] != "none"), None)
        marked = first is not None and self.vocabulary[first][2] == "piece" and self.vocabulary[first][0][0] == MARK
        return self._joined(ids)[marked:]


def _utf8(raw: bytearray) -> str:
    """raw as text; each byte that isn't part of a character becomes a replacement character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


def encode(docs: DataFrame, model: str, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns ``keep``) with ``ids``; ``model`` is the path of a model file, read on the driver."""
    shared = Shared(docs.sparkSession, Pieces.load(model))

    def work(data, at, batch):
        found = [shared.value.encode(t) for t in batch.columns[-1].to_pylist()]
        flat_ids = np.fromiter((i for x in found for i in x), np.int32)
        return [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32()), pa.array(flat_ids))]

    return map_texts(docs, text_col, docs.columns if keep is None else keep, "ids array<int>", work)


def round_trip(docs: DataFrame, model: str, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``ids`` of each text and ``decoded``, the text that these ids decode to; one pass, so a task holds one vocabulary."""
    shared = Shared(docs.sparkSession, Pieces.load(model))

    def work(data, at, batch):
        own = shared.value
        found = [own.encode(t) for t in batch.columns[-1].to_pylist()]
        flat_ids = np.fromiter((i for x in found for i in x), np.int32)
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32()), pa.array(flat_ids))
        return ids, pa.array([own.decode(x) for x in found], pa.string())

    return map_texts(docs, text_col, keep, "ids array<int>, decoded string", work)


def decode(rows: DataFrame, model: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null ids give the empty text."""
    shared = Shared(rows.sparkSession, Pieces.load(model))
    keep = [c for c in rows.columns if c != out_col]
    schema = rows.select(*keep).schema.add(out_col, "string")

    def run(batches):
        for batch in batches:
            texts = [shared.value.decode(x or []) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, out_col])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """Columns ``keep`` with n_tokens, ids_sha256 and decoded_sha256 of each text, encoded and decoded unit by unit."""
    shared = Shared(docs.sparkSession, Pieces.load(model))

    ids, decimal, decoded = map(itemgetter, range(3))

    def work(data, at, batch):
        counts, ids_sha, decoded_sha = [], [], []
        for text in batch.columns[-1].to_pylist():
            units = shared.value.units(text or "")
            counts.append(sum(map(len, map(ids, units))))
            ids_sha.append(hashlib.sha256(",".join(map(decimal, units)).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256("".join(map(decoded, units)).removeprefix(" ").encode()).hexdigest())
        return pa.array(counts, pa.int64()), ids_sha, decoded_sha

    return map_texts(docs, text_col, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda *a: [x if isinstance(x, pa.Array) else pa.array(x, pa.string()) for x in work(*a)])
