"""Spelling variants: words one edit apart through a trie of letter-group counts, and the commonest form of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrecon.llm.common import written

RUN, SHORTEST, FEWEST, SIMULATED = "[A-Za-zÀ-ÿ]", 5, 3, 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters counted together, a level of the trie each; all other code points are the last group.
GROUPS = ("e", "a", "i", "n", "r", "s", "t", "o", "l", "u", "dm", "cgk", "bpfv", "hjqw", "xyz")
DEPTH = len(GROUPS) + 1
GROUP_OF = np.full(256, DEPTH - 1, np.uint8)
for _g, _letters in enumerate(GROUPS):
    GROUP_OF[[ord(c) for c in _letters]] = _g
#: Words of a shard; words of one subtree: a 1,024th of all, within these bounds; rounds of subtree counting take so many levels at once.
SHARD, LEAST, MOST, LEVELS = 16_384, 256, 262_144, 4
#: States held of a search before its deeper half goes on alone; words up to so long are compared as rows of a matrix.
FRONT, WIDE = 1 << 17, 40
ROOT = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xD6E8FEB86659FD93)


# --- words -----------------------------------------------------------------------------------------------------------


def simulated(doc_id: Column, run: Column) -> Column:
    """The run, less one code point where the checksum of id and run says so."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(SIMULATED)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least five code points and three occurrences in whole texts (null: none)."""
    # shorter runs cannot give a word of five; the pattern is greedy, so what it finds is a maximal run
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{RUN}{{{SHORTEST},}}"), F.lit(0))
    run = F.translate("run", UPPER, LOWER)
    each = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run")).select("id", run.alias("run")).select(simulated(F.col("id"), F.col("run")).alias("word"))
    return each.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= FEWEST)


class Words:
    """Words as one run of code points with their starts; counts by letter group; hashes of any part at once."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        total = len(self.flat)
        owner = np.repeat(np.arange(len(texts)), self.length)
        group = np.where(self.flat < 256, GROUP_OF[np.minimum(self.flat, 255)], DEPTH - 1)
        self.counts = np.bincount(owner * DEPTH + group, minlength=len(texts) * DEPTH).reshape(-1, DEPTH)
        up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(total, ODD)])
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(total, inverse)])
        self.sums = np.r_[np.uint64(0), np.cumsum((self.flat.astype(np.uint64) + np.uint64(1)) * up[:-1])]

    def hashes(self, i: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hash of n code points of word i, skip code points on; the same for equal parts wherever they stand."""
        a = self.start[i] + skip
        return (self.sums[a + n] - self.sums[a]) * self.down[a]


def mixed(key: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The key of the node that the path `key` reaches by the count x."""
    k = (key ^ (x.astype(np.uint64) + ROOT)) * ODD
    return k ^ (k >> np.uint64(29))


# --- upper levels: which shards hold which subtrees --------------------------------------------------------------------


def steps(q: np.ndarray, up: np.ndarray, down: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The counts a search may go on with: the same, one more (spends the surplus) or one less (spends the deficit).

    Each as (which states, count, surplus left, deficit left).
    """
    every, more, less = np.arange(len(q)), np.flatnonzero(up), np.flatnonzero(down & (q > 0))
    return [(every, q, up, down), (more, q[more] + 1, up[more] & False, down[more]), (less, q[less] - 1, up[less], down[less] & False)]


def own_subtree(counts: np.ndarray, large: list[np.ndarray]) -> np.ndarray:
    """Key of the subtree each word lies in: its path down to the first node that is not large."""
    key = np.full(len(counts), ROOT)
    inside = np.ones(len(counts), bool)
    for level, nodes in enumerate(large):
        inside &= np.isin(key, nodes)
        if level == DEPTH or not inside.any():
            break
        key[inside] = mixed(key[inside], counts[inside, level])
    return key


def subtrees(counts: np.ndarray, large: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(word, key of a subtree it must be looked for in): the search in the levels of large nodes, as many as there are."""
    who, key = np.arange(len(counts)), np.full(len(counts), ROOT)
    up = down = np.ones(len(counts), bool)
    found = []
    for level in range(DEPTH + 1):
        inside = np.isin(key, large[level]) if level < len(large) else np.zeros(len(key), bool)
        if level == DEPTH:
            inside[:] = False
        found.append((who[~inside], key[~inside]))
        who, key, up, down = who[inside], key[inside], up[inside], down[inside]
        if not len(who):
            break
        nxt = [(who[s], mixed(key[s], x), u, d) for s, x, u, d in steps(counts[who, level], up, down)]
        who, key, up, down = (np.concatenate(c) for c in zip(*nxt))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def large_nodes(vocabulary: DataFrame, most: int) -> tuple[list[np.ndarray], dict[int, int]]:
    """By level the keys of the nodes above more than `most` words, and of leaves among them into how many deals they go.

    There are at most n / most nodes a level; some levels are counted at a time.
    """
    large: list[np.ndarray] = []
    deals: dict[int, int] = {}
    while len(large) <= DEPTH:
        first, known = len(large), list(large)
        last = min(first + LEVELS, DEPTH + 1)

        def run(batches: Iterator[pa.RecordBatch], first=first, last=last, known=known) -> Iterator[pa.RecordBatch]:
            for b in batches:
                counts = Words(b.column(0).to_pylist()).counts
                key, inside = np.full(len(counts), ROOT), np.ones(len(counts), bool)
                for level in range(last):
                    if level >= first:
                        k, n = np.unique(key[inside], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), level, np.int32)), pa.array(k.view(np.int64)), pa.array(n)], ["level", "key", "n"])
                    elif level < len(known):
                        inside &= np.isin(key, known[level])
                    if level < DEPTH:
                        key = mixed(key, counts[:, level])

        found = vocabulary.select("word").mapInArrow(run, "level int, key long, n long").groupBy("level", "key").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()
        for level in range(first, last):
            large.append(np.array([r.key for r in found if r.level == level], np.int64).view(np.uint64))
            if level == DEPTH:
                deals = {r.key % (1 << 64): -(-r.n // most) for r in found if r.level == level}
            if not len(large[-1]):
                return large, deals
    return large, deals


# --- a shard's trie ----------------------------------------------------------------------------------------------------


class Trie:
    """Words by their counts of successive letter groups; a leaf is a vector of counts.

    The words of a leaf are filed under their first and their last half: of two words one edit apart one half is the same. So a crowded leaf
    is not compared word by word either.
    """

    def __init__(self, texts: list[str], n: np.ndarray):
        self.w, self.n = Words(texts), n
        node = np.zeros(len(texts), np.int64)
        self.levels = []
        for level in range(DEPTH):
            keys, node = np.unique(node * (1 << 32) + self.w.counts[:, level], return_inverse=True)
            self.levels.append(keys)
        every = np.arange(len(texts))
        parts = [mixed(self.half(self.w, every, self.w.length // 2 if kind else (self.w.length - 1) // 2, side), node * 4 + kind * 2 + side) for kind in (0, 1) for side in (0, 1)]
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], np.tile(every, 4)[order]
        self.rows = matrix(texts)

    @staticmethod
    def half(w: Words, i: np.ndarray, n: np.ndarray, side: int) -> np.ndarray:
        return w.hashes(i, w.length[i] - n if side else np.zeros(len(i), np.int64), n)

    def candidates(self, q: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) pairs: depth-first over blocks of states, each with a budget of one surplus and one deficit."""
        stack = [(0, np.arange(len(q.texts)), np.zeros(len(q.texts), np.int64), *(np.ones(len(q.texts), bool),) * 2)]
        while stack:
            level, who, node, up, down = stack.pop()
            if level == DEPTH:
                yield from self.leaves(q, who, node, up, down)
                continue
            if len(who) > FRONT:
                mid = len(who) // 2
                stack += [(level, *(c[part] for c in (who, node, up, down))) for part in (slice(mid, None), slice(mid))]
                continue
            keys, nxt = self.levels[level], []
            for s, x, u, d in steps(q.counts[who, level], up, down):
                want = node[s] * (1 << 32) + x
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                nxt.append((who[s][hit], at[hit], u[hit], d[hit]))
            stack.append((level + 1, *(np.concatenate(c) for c in zip(*nxt))))

    def leaves(self, q: Words, who, node, up, down) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of the leaves that share a half with the query, each pair once."""
        length = q.length[who]
        longer = (~up).astype(np.int64) - (~down).astype(np.int64)  # of the leaf's words
        half = (length + np.minimum(longer, 0)) // 2
        pairs = []
        for side in (0, 1):
            # the shorter word's half: a leaf word files it as its own, or as that of one letter less
            key = mixed(self.half(q, who, half, side), node * 4 + (longer <= 0) * 2 + side)
            a, b = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
            pairs.append((a, b - a))
        first, count = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        who = np.tile(who, 2)
        ends = np.cumsum(count)
        done = 0
        while done < len(count):  # a block of candidates at a time
            to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + FRONT, "right")))
            c = count[done:to]
            offset = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            yield np.repeat(who[done:to], c), self.at[np.repeat(first[done:to], c) + offset]
            done = to

    def near(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of all pairs one edit apart."""
        q, rows = Words(texts), matrix(texts)
        out = [np.zeros((0, 2), np.int64)]
        for a, b in self.candidates(q):
            ok = one_edit(q, rows, a, self.w, self.rows, b)
            out.append(np.c_[a[ok], b[ok]])
        got = np.unique(np.concatenate(out), axis=0)
        return got[:, 0], got[:, 1]


def matrix(texts: list[str]) -> np.ndarray:
    """The first WIDE code points of each word, zeros behind."""
    return np.array([t[:WIDE] for t in texts], f"U{WIDE}").view(np.uint32).reshape(-1, WIDE) if texts else np.zeros((0, WIDE), np.uint32)


def one_edit(q: Words, q_rows: np.ndarray, a: np.ndarray, w: Words, w_rows: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b differ by exactly one inserted, deleted or replaced code point."""
    la, lb = q.length[a], w.length[b]
    out = np.zeros(len(a), bool)
    short = np.maximum(la, lb) <= WIDE
    same, shift = short & (la == lb), short & (abs(la - lb) == 1)
    out[same] = (q_rows[a[same]] != w_rows[b[same]]).sum(1) == 1
    x, y = q_rows[a[shift]], w_rows[b[shift]]
    swap = (la < lb)[shift, None]
    longer, shorter = np.where(swap, y, x), np.where(swap, x, y)
    first = (longer != shorter).argmax(1)  # up to here both agree; the rest must agree with one code point skipped
    rest = np.arange(WIDE - 1) >= first[:, None]
    out[shift] = ~((longer[:, 1:] != shorter[:, :-1]) & rest).any(1)
    for i in np.flatnonzero(~short & (abs(la - lb) < 2)):
        out[i] = _one_edit(q.texts[a[i]], w.texts[b[i]])
    return out


def _one_edit(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:])


# --- on Spark ----------------------------------------------------------------------------------------------------------


def placed(vocabulary: DataFrame, large: list[np.ndarray], deals: dict[int, int], shards: int) -> DataFrame:
    """(shard, role, word, n): a member (role 0) in the shard of its subtree, a query (role 1) in each shard that a near word may be in.

    A search reaches a number of subtrees that depends on the number of groups alone. A leaf that is still large is dealt by word, and
    searches that reach it go to all its deals (1,024 of all leaves together, until deals are of MOST words).
    """
    crowded, parts = np.array(list(deals), np.uint64), np.array(list(deals.values()), np.int64)
    crowded, parts = crowded[np.argsort(crowded)], parts[np.argsort(crowded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                w = Words(part.column(0).to_pylist())
                own = own_subtree(w.counts, large)
                dealt = np.isin(own, crowded)
                some = np.flatnonzero(dealt)
                deal = w.hashes(some, np.zeros(len(some), np.int64), w.length[some])
                own[some] = mixed(own[some], deal % parts[np.searchsorted(crowded, own[some])].astype(np.uint64))
                who, key = subtrees(w.counts, large)
                full = np.isin(key, crowded)
                times = parts[np.searchsorted(crowded, key[full])]
                each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                who = np.r_[who[~full], np.repeat(who[full], times)]
                key = np.r_[key[~full], mixed(np.repeat(key[full], times), each)]
                goes = (key % np.uint64(shards)).astype(np.int64)
                who, goes = np.unique(np.c_[who, goes], axis=0).T
                rows = np.r_[np.arange(len(own)), who]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[(own % np.uint64(shards)).astype(np.int32), goes.astype(np.int32)]), pa.array(np.r_[np.zeros(len(own), np.int8), np.ones(len(who), np.int8)]),
                     part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows))],
                    ["shard", "role", "word", "n"],
                )

    return vocabulary.select("word", "n").mapInArrow(run, "shard int, role byte, word string, n long")


def searched(rows: DataFrame, shards: int) -> DataFrame:
    """(word, n_near, near_n, near): of each query of a shard how many of the shard's members are near, and the commonest of them."""

    def flush(members: list[pd.DataFrame]) -> Trie | None:
        return Trie(pd.concat(m.word for m in members).tolist(), pd.concat(m.n for m in members).to_numpy()) if members else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, members, trie = None, [], None
        for b in batches:
            whole = b.to_pandas()
            for (s, role), part in whole.groupby(["shard", "role"], sort=True):
                if s != shard:
                    shard, members, trie = s, [], None
                if role == 0:
                    members.append(part)
                    continue
                if members:
                    trie, members = flush(members), []
                if trie is None:
                    continue
                texts = part.word.tolist()
                q, w = trie.near(texts)
                if not len(q):
                    continue
                name = np.array(trie.w.texts, object)[w]
                best = pd.DataFrame({"q": q, "n": -trie.n[w], "near": name}).sort_values(["q", "n", "near"])
                head = best.drop_duplicates("q")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([texts[i] for i in head.q]), pa.array(best.groupby("q").size().to_numpy()), pa.array(-head.n.to_numpy()), pa.array(head.near.tolist())],
                    ["word", "n_near", "near_n", "near"],
                )

    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "role").mapInArrow(run, "word string, n_near long, near_n long, near string")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, least: int = LEAST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the whole texts.

    Words are near if one inserted, deleted or replaced code point apart; form is the near word of largest n (ties: the first in code-point
    order) if that is at least twice the word's own; root is where following forms ends (counts double at each step, so it ends). Null texts
    have no words, a null id counts as empty text, repeated rows count as often as they occur, an empty table gives no rows. Words may have
    any length.
    """
    vocabulary = written(words(docs, id_col, text_col), "words")
    n = vocabulary.count()
    shards = max(1, -(-n // shard))
    large, deals = large_nodes(vocabulary, min(max(least, n // 1024), MOST)) if shards > 1 else ([], {})
    best = searched(placed(vocabulary, large, deals, shards), shards).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("b")
    )
    out = vocabulary.join(best, "word", "left").withColumn("near_n", -F.col("b.n"))
    found = F.col("near_n") >= 2 * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(found, F.col("b.near")).alias("form"), F.when(found, F.col("near_n")).alias("form_n"))
    out = written(out, "forms")
    return out.join(roots(out.where("form is not null").select("word", "form")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by pointers that double each round."""
    at = forms.withColumnRenamed("form", "root")
    while True:
        nxt = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(nxt, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = bool(at.where("moved").head(1))
        at = at.select("word", "root")
        if not moved:
            return at
