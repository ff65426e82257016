"""SentencePiece (byte-pair) encoding through tables of distinct marked words, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridrecon.llm.bpe import _texts

MARK = "▁"
#: A marked word: markers and what follows up to the next ones (or what stands before the first).
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
# Fixed values of the model format: kinds of pieces, and the text of an unknown piece.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNKNOWN_TEXT = " ⁇ "


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message."""

    def varint() -> int:
        nonlocal i
        v = s = 0
        while True:
            c = b[i]
            i, v, s = i + 1, v | (c & 127) << s, s + 7
            if c < 128:
                return v

    i = 0
    while i < len(b):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, b[i : i + n]
            i += n


class Model:
    """Pieces of a byte-pair model file with byte fallback and without normalisation; other models raise ValueError.

    Words are kept once segmented, up to KEEP of them and LONGEST characters each.
    """

    KEEP, LONGEST, FEW = 400_000, 64, 40

    def __init__(self, file: bytes):
        pieces, trainer, norm = [], {}, {}
        for k, v in fields(file):
            if k == 1:
                p = dict(fields(v))
                pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif k == 2:
                trainer = dict(fields(v))
            elif k == 3:
                norm = dict(fields(v))
        kinds = {kind for *_, kind in pieces}
        if trainer.get(3) != 2 or BYTE not in kinds or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE} or norm.get(2) or norm.get(4, 1) or not norm.get(5, 1) or trainer.get(24):
            raise ValueError("only byte-pair models with byte fallback, marked prefixes and no normalisation can be read")
        self.prefix = MARK if norm.get(3, 1) else ""
        self.end = next(i for i, p in enumerate(pieces) if p[0] == trainer.get(47, b"</s>").decode())
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.byte = {int(p[3:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        order = {s: r for r, s in enumerate(sorted({s for _, s, kind in pieces if kind == NORMAL}, reverse=True))}
        self.rank = {p: order[s] for p, s, kind in pieces if kind == NORMAL}
        #: Whether words may be segmented apart: no piece goes on over a marker.
        self.apart = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.text = [b"" if kind == CONTROL else bytes([int(p[3:-1], 16)]) if kind == BYTE else UNKNOWN_TEXT.encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.kind = [kind for *_, kind in pieces]
        self.number = [str(i) for i in range(len(pieces))]
        self.known: dict[str, list[int]] = {}

    def merged(self, word: str) -> list[str]:
        """The word's pieces: neighbours of best rank merge, leftmost first, until no two make a piece; n log n in the length."""
        get, n = self.rank.get, len(word)
        if n <= self.FEW:
            parts, none = list(word), len(self.rank) + 1
            pair = [get(x + y, none) for x, y in zip(parts, parts[1:])]
            while pair and (low := min(pair)) != none:
                i = pair.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del pair[i]
                if i:
                    pair[i - 1] = get(parts[i - 1] + parts[i], none)
                if i < len(pair):
                    pair[i] = get(parts[i] + parts[i + 1], none)
            return parts
        # stop[i]: where the part that begins at i ends (0: merged into another); back[i]: where the part before begins
        stop, back = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = stop[i]
            if not j or j >= n or stop[j] != to:
                continue
            stop[i], stop[j] = to, 0
            if to < n:
                back[to] = i
                if (r := get(word[i : stop[to]])) is not None:
                    heapq.heappush(heap, (r, i, stop[to]))
            if (h := back[i]) >= 0 and (r := get(word[h:to])) is not None:
                heapq.heappush(heap, (r, h, to))
        out, i = [], 0
        while i < n:
            out.append(word[i : stop[i]])
            i = stop[i]
        return out

    def segment(self, word: str) -> list[int]:
        """Ids of a marked word; characters that are no piece as their bytes."""
        out = self.known.get(word)
        if out is None:
            out = []
            for p in self.merged(word):
                k = self.ids.get(p)
                out += [self.byte[c] for c in p.encode()] if k is None else [k]
            if len(word) <= self.LONGEST:
                if len(self.known) >= self.KEEP:
                    self.known.clear()
                self.known[word] = out
        return out

    def encode(self, texts: list[str], end: bool = True) -> list[np.ndarray]:
        """Ids of whole texts: their marked words in order, a table of the distinct ones segmented once, ids joined back by position."""
        words, size = [], []
        for t in texts:
            t = self.prefix + t.replace(" ", MARK) if t else ""
            got = CHUNK.findall(t) if self.apart else [t] if t else []
            words += got
            size.append(len(got))
        table = pa.array(words, pa.large_string()).dictionary_encode()
        at = table.indices.to_numpy()
        ids = [self.segment(w) for w in table.dictionary.to_pylist()]
        length = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(length.sum()))
        start, n = np.cumsum(length) - length, length[at] if len(at) else np.zeros(0, np.int64)
        stops = np.r_[0, np.cumsum(n)]
        all_ids = flat[np.repeat(start[at] - stops[:-1], n) + np.arange(stops[-1])] if len(at) else flat
        cut = stops[np.r_[0, np.cumsum(size)].astype(np.int64)]
        last = np.array([self.end] if end else [], np.int32)
        return [np.r_[all_ids[a:b], last] for a, b in zip(cut, cut[1:])]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: markers are spaces but for one at the front, bytes are read as UTF-8 (what is none as U+FFFD), the end id is nothing."""
        while ids and ids[-1] == self.end:
            ids = ids[:-1]
        text, kind = self.text, self.kind
        b = b"".join([text[i] for i in ids])
        if ids and self.prefix and kind[ids[0]] == NORMAL and b.startswith(b" "):
            b = b[1:]
        try:
            out = b.decode()
        except UnicodeDecodeError:
            out = None
        return out if out is not None and all(map({NORMAL, BYTE}.__contains__, {kind[i] for i in ids})) else self.slowly(ids)

    def slowly(self, ids: list[int]) -> str:
        """decode() for runs of bytes that are no text, and for control and unknown ids in between."""
        out, run, front = [], b"", bool(self.prefix)

        def flush() -> None:
            nonlocal run
            while run:
                n = next((k for k in (1, 2, 3, 4) if _whole(run[:k], k)), 0)
                out.append(run[:n].decode() if n else "�")
                run = run[n or 1 :]

        for i in ids:
            if self.kind[i] == BYTE:
                run += self.text[i]
                continue
            flush()
            t = self.text[i].decode()
            if front and not any(out) and self.kind[i] == NORMAL and t.startswith(" "):
                t, front = t[1:], False
            out.append(t)
        flush()
        return "".join(out)


def _whole(b: bytes, n: int) -> bool:
    try:
        return len(b) == n and len(b.decode()) == 1
    except UnicodeDecodeError:
        return False


_models: dict[bytes, Model] = {}


def model_of(file: bytes) -> Model:
    key = hashlib.sha256(file).digest()
    if key not in _models:
        _models.clear()
        _models[key] = Model(file)
    return _models[key]


def read_model(spark: SparkSession, path: str):
    """The model file as a broadcast: a vocabulary, of fixed size whatever the input."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model, text_col: str = "text", end: bool = True) -> DataFrame:
    """docs with ids array<int> added (a column of this name is replaced): the whole text's tokens (null: as empty), with an end id.

    Repeated rows are encoded alike; an empty table gives an empty table. Runs of texts of about two million characters share one table of
    distinct words (a longer text has its own), so a task's memory is bounded by its longest text.
    """
    docs = docs.drop("ids")
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model.value)
        for b in batches:
            for first, texts in _texts(b, at):
                yield pa.RecordBatch.from_arrays([*b.slice(first, len(texts)).columns, pa.array(m.encode(texts, end), pa.list_(pa.int32()))], [*names, "ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, model, ids_col: str = "ids") -> DataFrame:
    """encoded with decoded string added: the text of its ids (null: null)."""
    encoded = encoded.drop("decoded")
    names, at = encoded.columns, encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model.value)
        for b in batches:
            out = [None if x is None else m.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def round_trip(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of encoding every whole text, with an end id, and decoding the ids.

    Ids and decoded text are digested where they arise. Nulls, repeats and empty tables as in encode; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model.value)
        for b in batches:
            for first, texts in _texts(b, 1):
                n, sha, back = [], [], []
                for x in m.encode(texts):
                    ids = x.tolist()
                    n.append(len(ids))
                    sha.append(hashlib.sha256(" ".join([m.number[i] for i in ids]).encode()).hexdigest())
                    back.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
                cols = [b.column(0).slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
