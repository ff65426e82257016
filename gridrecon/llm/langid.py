"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the training sample: texts of a language, characters after which no further text is taken, and characters of a
#: text that may be picked (texts are learned whole, and languages from about equally much, so that their phrases compare).
TEXTS, CHARS, LONGEST = 64, 40_000, 4_000
#: Texts are parsed from many places at once, this many symbols apart; the parts are then joined to the one parse from the start.
PIECE, ROUNDS = 512, 4
#: Entries of all languages' tables of common symbols; transitions on rarer symbols are kept as a sorted list.
DENSE = 1 << 24
#: Characters of whole texts that are parsed together.
TOGETHER = 1 << 20
SPACE, OTHER = 0, 1


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of one sequence; state 0 is the root, to which none leads."""
    link, length, moves, last = [-1], [0], [{}], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class Phrases:
    """Greedy parses of symbol sequences into longest matches with one sample; a symbol the sample lacks is a phrase."""

    def __init__(self, codes: np.ndarray, symbols: int, room: int):
        counts = np.bincount(codes[codes != OTHER], minlength=symbols)
        order = np.argsort(-counts, kind="stable")[: max(1, int((counts > 0).sum()))]
        self.rank = np.full(symbols, len(order), np.int32)  # by falling frequency; the last one occurs nowhere
        self.rank[order] = np.arange(len(order))
        self.rank[OTHER] = len(order)
        self.count = len(order) + 1
        moves = automaton([c for c in self.rank[codes].tolist() if c < len(order)])
        self.width = int(min(self.count, max(1, room // len(moves))))
        self.table = np.zeros((len(moves), self.width), np.int32)
        rare = []
        for s, m in enumerate(moves):
            for c, t in m.items():
                if c < self.width:
                    self.table[s, c] = t
                else:
                    rare.append((s * self.count + c, t))
        self.table = self.table.ravel()
        self.keys, self.to = np.array(sorted(rare) or [(-1, 0)], np.int64).T
        self.norm = math.log2(max(2, len(codes)))

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        if self.width == self.count:
            return self.table[state * self.width + c]
        common = c < self.width
        out = np.where(common, self.table[state * self.width + np.where(common, c, 0)], 0)
        some = np.flatnonzero(~common)
        if len(some):
            key = state[some] * self.count + c[some]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[some] = np.where(self.keys[at] == key, self.to[at], 0)
        return out

    def parse(self, own: np.ndarray, at: np.ndarray, limit: np.ndarray, end: np.ndarray, cut: np.ndarray, follow: bool) -> tuple[np.ndarray, np.ndarray]:
        """From phrase starts at, all at once: (first phrase start at or after limit, phrases that start before it).

        Starts before limit are marked in cut; or, if follow, a parse ends where it meets a mark. end: of the text.
        """
        out, count = end.copy(), np.ones(len(at), np.int64)
        lane = np.flatnonzero(at < end)
        pos, last, lim = at[lane], end[lane], limit[lane]
        if not follow:
            cut[pos] = True
        state = self.step(np.zeros(len(lane), np.int64), own[pos])
        pos = pos + 1
        while len(lane):
            going = pos < last
            if not going.all():
                lane, pos, last, lim, state = (x[going] for x in (lane, pos, last, lim, state))
                if not len(lane):
                    break
            c = own[pos]
            to = self.step(state, c)
            broke = np.flatnonzero((to == 0) | (state == 0))
            if len(broke):
                q = pos[broke]
                over = q >= lim[broke]
                if follow:
                    over |= cut[q]
                else:
                    cut[q[~over]] = True
                to[broke] = self.step(np.zeros(len(broke), np.int64), c[broke])
                out[lane[broke[over]]] = q[over]
                count[lane[broke[~over]]] += 1
                if over.any():
                    stay = np.ones(len(lane), bool)
                    stay[broke[over]] = False
                    lane, pos, last, lim, to = (x[stay] for x in (lane, pos, last, lim, to))
            state, pos = to, pos + 1
        return out, count

    def one(self, own: np.ndarray) -> int:
        """Phrases of one sequence, symbol by symbol."""
        table, width, rare = memoryview(self.table), self.width, dict(zip(self.keys.tolist(), self.to.tolist()))
        state, count = 0, 0
        for c in own.tolist():
            if c < width:
                to = table[state * width + c] if state else 0
                if not to:
                    count += 1
                    to = table[c]
            else:
                to = rare.get(state * self.count + c, 0) if state else 0
                if not to:
                    count += 1
                    to = rare.get(c, 0)
            state = to
        return count

    def counts(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Phrases of each of the sequences of length n that lie one after the other in codes.

        Every piece is parsed from its own start first. The true parse enters a piece where that of the piece before
        leaves; from there it soon meets a start of the piece's own parse and then agrees with it. Texts where
        parts still change after ROUNDS are parsed symbol by symbol.
        """
        own = self.rank[codes]
        first = np.cumsum(n) - n
        pieces = -(-n // PIECE)
        text = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, end = first[text] + nth * PIECE, (first + n)[text]
        limit = np.minimum(start + PIECE, end)
        cut = np.zeros(len(own) + 1, bool)
        leave, count = self.parse(own, start, limit, end, cut, False)
        marks = np.r_[0, np.cumsum(cut)]
        alone, entered, wrong = leave.copy(), start.copy(), np.zeros(len(n), bool)
        for k in range(ROUNDS + 1):
            enter = np.where(nth > 0, np.r_[0, leave[:-1]], start) if len(start) else start
            todo = np.flatnonzero(enter != entered)
            if k == ROUNDS:
                wrong[text[todo]] = True
            if k == ROUNDS or not len(todo):
                break
            e, lim = enter[todo], limit[todo]
            entered[todo] = e
            inside = e < lim
            met, seen = e.copy(), np.zeros(len(todo), np.int64)
            fresh = np.flatnonzero(inside & ~cut[e])
            if len(fresh):
                met[fresh], seen[fresh] = self.parse(own, e[fresh], lim[fresh], end[todo][fresh], cut, True)
            agreed = met < lim
            leave[todo] = np.where(agreed, alone[todo], met)
            count[todo] = seen + np.where(agreed, marks[lim] - marks[np.minimum(met, lim)], 0)
        out = np.bincount(text, count, len(n)).astype(np.int64)
        for t in np.flatnonzero(wrong):
            out[t] = self.one(own[first[t] : first[t] + n[t]])
        return out


_alphabetic: list[np.ndarray] = []


def alphabetic() -> np.ndarray:
    """Whether each code point is a letter; made once in a process."""
    if not _alphabetic:
        _alphabetic.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alphabetic[0]


class Parser:
    """Counts the phrases of texts in each language; built once in each worker from the sample."""

    def __init__(self, sample: dict[str, str]):
        self.langs = sorted(sample)
        letters = Counter(c for t in sample.values() for c in t.lower() if c.isalpha())
        known = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))]
        self.lut = np.where(alphabetic(), OTHER, SPACE).astype(np.int32)
        for k, c in enumerate(known):
            self.lut[ord(c)] = k + 2
            if len(c.upper()) == 1 and c.upper().lower() == c:
                self.lut[ord(c.upper())] = k + 2
        self.tables = [Phrases(self.codes(sample[name])[0], len(known) + 2, DENSE // len(self.langs)) for name in self.langs]

    def codes(self, text: str) -> tuple[np.ndarray, bool]:
        """Symbols of a whole text: letters without case, each run of anything else one space; any letter there?"""
        c = self.lut[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if len(c):
            c = c[~((c == SPACE) & np.r_[True, c[:-1] == SPACE])]
        return c, bool(c.any())

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(normalised phrases [text, language] in bits a symbol, whether a text has letters)."""
        parts = [self.codes(t or "") for t in texts]
        n = np.array([len(c) for c, _ in parts], np.int64)
        codes = np.concatenate([c for c, _ in parts] or [np.zeros(0, np.int32)])
        bits = np.array([t.counts(codes, n) * t.norm / np.maximum(n, 1) for t in self.tables]).reshape(len(self.langs), len(n)).T
        return bits, np.array([x for _, x in parts], bool)


_parsers: dict[tuple, Parser] = {}


def parser(sample: tuple) -> Parser:
    if sample not in _parsers:
        _parsers.clear()
        _parsers[sample] = Parser(dict(sample))
    return _parsers[sample]


def sample(docs: DataFrame, learn: Column, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> tuple:
    """((language, text), ...): whole texts of each language, from rows where learn holds and lang and text are not null.

    Only texts of up to LONGEST characters are picked, unless a language has no other. Counts cover all rows; a hash of
    id and text then picks about TEXTS of each language, taken in its order until CHARS are reached. Rows that repeat count
    once, so what reaches the driver is bounded by languages x TEXTS texts, however often an id, a null id or a text occurs.
    """
    d = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("h"), learn.alias("learn"))
    d = d.where("learn and lang is not null and text <> ''").withColumn("short", F.length("text") <= LONGEST)
    size = {(r.lang, r.short): r.n for r in d.groupBy("lang", "short").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not size:
        return ()
    share = {k: min(1.0, (TEXTS if k[1] else 4) / max(1, n)) for k, n in size.items() if k[1] or (k[0], True) not in size}
    at = F.create_map(*(F.lit(x) for (lang, short), p in share.items() for x in (f"{int(short)}:{lang}", p)))
    place = F.pmod("h", F.lit(1 << 30))
    picked = d.where(place < at[F.concat(F.col("short").cast("int").cast("string"), F.lit(":"), "lang")] * (1 << 30)).select("lang", place.alias("h"), "text").distinct()
    out: dict[str, list[str]] = {}
    for r in sorted(picked.collect()):
        if sum(map(len, mine := out.setdefault(r.lang, []))) < CHARS:
            mine.append(r.text)
    return tuple((k, " ".join(v)) for k, v in sorted(out.items()))


def identify(docs: DataFrame, learned: tuple, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score added (columns of these names are replaced).

    The language whose cross-parsing needs fewest normalised phrases wins; ties go to the first by name. score is
    the runner-up's share of the two smallest counts (0.5: a tie; 1: only one language is known). A text that is
    null or has no letter is und with score 0, as is every text if nothing was learned. Whole texts are parsed.
    """
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    at = names.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(learned)
        for b in batches:
            size = np.cumsum(pa.compute.utf8_length(b.column(at).cast(pa.string())).fill_null(0).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(size // TOGETHER, prepend=0)), b.num_rows])
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = b.slice(a, z - a)
                texts = part.column(at).cast(pa.string()).to_pylist()
                bits, letters = p.phrases(texts) if p.langs else (np.zeros((len(texts), 1)), np.zeros(len(texts), bool))
                best = bits.argmin(1)
                two = np.sort(bits, axis=1)[:, :2]
                score = two[:, 1] / np.maximum(two.sum(1), 1e-12) if two.shape[1] == 2 else np.ones(len(texts))
                pred = [p.langs[k] if ok else "und" for k, ok in zip(best, letters)]
                new = [pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
