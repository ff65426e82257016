"""Byte-level BPE: pre-tokenisation by scans over code-point classes, cached merging, decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points of white space, and the contractions, by their letters, that are pieces of their own.
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SHORT, LONG = "stmd", ("re", "ve", "ll")

# Symbols read by the scan, and states: what the open piece is.
L, N, O, SHORT_C, LONG_C, LAST_SPACE, LAST_WHITE, INNER_WHITE = range(8)
IN_L, IN_N, IN_O, AFTER_SPACE, IN_WHITE, CLOSED, ONE_LEFT, TWO_LEFT = range(8)
#: State that a piece opened by a symbol leaves; a symbol + 8 opens a text, whatever went before.
OPENS = np.array([IN_L, IN_N, IN_O, ONE_LEFT, TWO_LEFT, AFTER_SPACE, CLOSED, IN_WHITE], np.uint8)
BLOCK = 64


def _rules() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and opens[symbol, state] (the symbol starts a piece)."""
    to, opens = np.repeat(OPENS[:, None], 8, 1), np.ones((8, 8), bool)

    def stay(symbols, state, then):
        for s in symbols:
            to[s, state], opens[s, state] = then if isinstance(then, int) else then[s], False

    kind = {L: IN_L, N: IN_N, O: IN_O, SHORT_C: IN_O, LONG_C: IN_O}
    stay([L], IN_L, IN_L)
    stay([N], IN_N, IN_N)
    stay([O, SHORT_C, LONG_C], IN_O, IN_O)
    stay(list(kind), AFTER_SPACE, kind)
    stay([INNER_WHITE], IN_WHITE, IN_WHITE)
    stay(range(8), TWO_LEFT, ONE_LEFT)
    stay(range(8), ONE_LEFT, CLOSED)
    return np.concatenate([to, np.repeat(OPENS[:, None], 8, 1)]), np.concatenate([opens, np.ones((8, 8), bool)])


NEXT, OPEN = _rules()


def code_point_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space (INNER_WHITE) or other."""
    c = np.full(0x110000, O, np.uint8)
    for i in range(0x110000):
        k = unicodedata.category(chr(i))[0]
        if k in "LN":
            c[i] = L if k == "L" else N
    c[list(WHITE)] = INNER_WHITE
    return c


_classes: list[np.ndarray] = []


def symbols(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols of concatenated texts; first: where a text begins."""
    if not _classes:
        _classes.append(code_point_classes())
    s = _classes[0][cp]
    n = len(s)
    ends = np.r_[first[1:], True]  # the text ends here
    follows = np.r_[s[1:] != INNER_WHITE, False] & ~ends  # a character that isn't white space comes next
    white = s == INNER_WHITE
    s[white & follows] = LAST_WHITE
    s[(cp == 0x20) & follows] = LAST_SPACE
    for i in np.flatnonzero(cp == 0x27):
        if i + 1 < n and not first[i + 1]:
            a = chr(cp[i + 1])
            if a in SHORT:
                s[i] = SHORT_C
            elif i + 2 < n and not first[i + 2] and a + chr(cp[i + 2]) in LONG:
                s[i] = LONG_C
    s[first] += 8
    return s


def boundaries(s: np.ndarray) -> np.ndarray:
    """Whether each symbol starts a piece.

    A symbol is a function from state to state. Functions of a block are composed for all blocks side by side, the
    blocks' functions by doubling strides (composition is associative), and with each block's first state known
    one more pass reads off the starts.
    """
    n = len(s)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, INNER_WHITE, np.uint8)
    grid[:n] = s
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    flat, opens = NEXT.ravel(), OPEN.ravel()
    f = np.repeat(np.arange(8, dtype=np.uint8)[None], blocks, 0)
    for row in grid:
        f = flat[(row[:, None].astype(np.intp) << 3) | f]
    stride = 1
    while stride < blocks:
        f[stride:] = np.take_along_axis(f[stride:], f[:-stride].copy(), 1)
        stride *= 2
    state = np.r_[np.uint8(CLOSED), f[:-1, CLOSED]]
    out = np.empty((BLOCK, blocks), bool)
    for t, row in enumerate(grid):
        at = (row.astype(np.intp) << 3) | state
        out[t], state = opens[at], flat[at]
    return out.T.ravel()[:n]


def pieces(texts: list[str]) -> list[tuple[str, list[int]]]:
    """Of each text the offsets (code points) at which its pieces start, with its length at the end."""
    cps = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    n = np.array([len(c) for c in cps], np.int64)
    begin = np.cumsum(n) - n
    total = int(n.sum())
    if not total:
        return [(t, [0]) for t in texts]
    first = np.zeros(total, bool)
    first[begin[n > 0]] = True
    at = np.flatnonzero(boundaries(symbols(np.concatenate(cps), first)))
    cut = np.searchsorted(at, np.r_[begin, total])
    return [(t, [*(at[a:b] - o).tolist(), len(t)]) for t, a, b, o in zip(texts, cut, cut[1:], begin.tolist())]


class Merges(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers; keeps what it has merged, within limits."""

    KEEP, LONGEST = 400_000, 64

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        b = piece.encode()
        r = self.ranks.get(b)
        ids = r.to_bytes(4, "little") if r is not None else b"".join(x.to_bytes(4, "little") for x in (self.short(b) if len(b) <= self.LONGEST else self.merge(b)))
        if len(piece) <= self.LONGEST:
            if len(self) >= self.KEEP:
                self.clear()
            self[piece] = ids
        return ids

    def short(self, b: bytes) -> list[int]:
        """merge() for a few bytes, without a heap."""
        get = self.ranks.get
        parts = [b[i : i + 1] for i in range(len(b))]
        none = len(self.ranks) + 1
        pair = [get(x + y, none) for x, y in zip(parts, parts[1:])]
        while pair and (low := min(pair)) != none:
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], none)
        return [get(x) for x in parts]

    def merge(self, b: bytes) -> list[int]:
        """Merge the neighbours of lowest rank, leftmost first, until no pair has a rank; n log n in the length."""
        n, get = len(b), self.ranks.get
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(b[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = end[i]
            if j <= i or j >= n or get(b[i : end[j]]) != r:
                continue  # one of the two has been merged meanwhile
            k = end[i] = end[j]
            end[j] = -1
            if k < n:
                prev[k] = i
                if (q := get(b[i : end[k]])) is not None:
                    heapq.heappush(heap, (q, i))
            if (p := prev[i]) >= 0 and (q := get(b[p:k])) is not None:
                heapq.heappush(heap, (q, p))
        out, i = [], 0
        while i < n:
            out.append(get(b[i : end[i]]))
            i = end[i]
        return out


class Tokenizer:
    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(r) for a, r in map(bytes.split, rank_file.splitlines()) if a}
        self.merges = Merges(self.ranks)
        self.bytes_of = {r: b for b, r in self.ranks.items()}

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[int]]]:
        """(ids, offsets of the pieces) of each whole text."""
        get = self.merges.__getitem__
        for text, at in pieces(texts):
            yield np.frombuffer(b"".join([get(text[a:b]) for a, b in zip(at, at[1:])]), "<u4"), at

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_tokenizers: dict[bytes, Tokenizer] = {}


def tokenizer(rank_file: bytes) -> Tokenizer:
    key = hashlib.sha256(rank_file).digest()
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer(rank_file)
    return _tokenizers[key]


def read_ranks(spark: SparkSession, path: str):
    """The rank file as a broadcast: a vocabulary, of fixed size whatever the input."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _texts(b: pa.RecordBatch, at: int, chars: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch (null: empty) in runs of about so many characters; a long text is a run of its own."""
    run, size, first = [], 0, 0
    for i, t in enumerate(b.column(at).cast(pa.string()).to_pylist()):
        run.append(t or "")
        size += len(run[-1])
        if size >= chars:
            yield first, run
            run, size, first = [], 0, i + 1
    if run:
        yield first, run


def encode(docs: DataFrame, ranks, text_col: str = "text") -> DataFrame:
    """docs with ids array<int> and offsets array<int> added (columns of these names are replaced).

    ids: tokens of the whole text (null: as empty), without special tokens; offsets: where its pieces start, in code
    points, and its length. Repeated rows are encoded alike; an empty table gives an empty table.
    """
    docs = docs.drop("ids", "offsets")
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks.value)
        for b in batches:
            for first, texts in _texts(b, at):
                got = list(tok.encode(texts))
                new = [pa.array([x[k] for x in got], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*b.slice(first, len(texts)).columns, *new], [*names, "ids", "offsets"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "offsets"))]))


def decode(encoded: DataFrame, ranks, ids_col: str = "ids") -> DataFrame:
    """encoded with decoded binary added: the bytes of its ids (null: null)."""
    encoded = encoded.drop("decoded")
    names, at = encoded.columns, encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks.value)
        for b in batches:
            out = [None if x is None else tok.decode(np.array(x, np.int64)) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, ranks, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_pieces: digests of encoding every whole text and decoding the ids.

    Ids and decoded bytes are digested where they arise, without passing through Spark. Nulls, repeats and empty
    tables as in encode; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks.value)
        for b in batches:
            for first, texts in _texts(b, 1):
                rows = [
                    (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids)).hexdigest(), len(at) - 1)
                    for ids, at in tok.encode(texts)
                ]
                n, i, d, p = zip(*rows)
                cols = [b.column(0).slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(i), pa.array(d), pa.array(p, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_pieces"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces long")
