"""Joins that reconcile requested items with estimated ones. Items: doc, ord, item_key, unit, quantity (null: blank), ref."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as pa_type

from gridrecon.functions import rules, text
from gridrecon.operators.stored import has_group_over, written

SIDES = ("item_key", "quantity", "unit")
GREEDY = "doc long, key string, req_ord long, est_ord long, how string, req_quantity double, req_unit string, est_quantity double, est_unit string"


def positional(req: DataFrame, est: DataFrame) -> DataFrame:
    """Full outer join on the position within a document (unique on each side), with the status of each pair.

    Both sides go into one order, in which a requested row stands before the estimated one of its place, so they are shuffled and sorted once.
    """
    cols = ["ord", "item_key", "quantity", "unit", "name", "plain", "unit_norm"]

    def tagged(df, side):
        return rules.named(df).select("doc", F.col("ord").alias("at"), F.lit(side).alias("side"), F.struct(*cols).alias("x"))

    both, here = tagged(req, 0).unionByName(tagged(est, 1)), W.partitionBy("doc", "at").orderBy("side")
    none = F.lit(None).cast(both.schema["x"].dataType)
    both = both.withColumn("after", F.lead("x").over(here)).withColumn("second", F.row_number().over(here) > 1).where("not second")
    both = both.select("doc", "at", F.when(F.col("side") == 0, F.col("x")).otherwise(none).alias("r"), F.when(F.col("side") == 0, F.col("after")).otherwise(F.col("x")).alias("e"))
    return both.select(
        "doc", F.col("at").alias("ord"), *(F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("r", "req"), ("e", "est")) for c in SIDES),
        *(c.alias(k) for k, c in rules.compare().items()),
    )


def greedy(req: DataFrame, est: DataFrame) -> DataFrame:
    """One-to-one matching within (doc, ref key), in row order: first free exact name, else all tokens, else any token.

    doc, key, req_ord, est_ord, how (exact, all, any, missing, extra), and quantity and unit of both rows. A missing row carries
    the free row it might have been, at its own place or else the first, which stays free. Names are made before the groups meet,
    tokens only for rows without an exact partner, so a group (one subtable) holds only what the order of matching needs.
    """

    def prepared(df, side):
        plain = F.when(F.col("plain") != F.col("name"), F.col("plain")).alias("plain")  # names with pipes only
        return rules.named(df).select("doc", text.ref_key(F.col("ref")).alias("key"), F.lit(side).alias("side"), F.col("ord").cast("long").alias("ord"), "name", plain, F.col("quantity").cast("double").alias("quantity"), "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group, requested before estimated, each in order."""
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        for (doc, key), group in groupby(rows, lambda r: r[:2]):
            req, est = {}, {}
            for _, _, side, o, n, plain, quantity, unit in group:
                (est if side else req)[o] = (n, n if plain is None else plain, quantity, unit)
            for r, e, how in _pair_up([(o, x[0], x[1]) for o, x in req.items()], [(o, x[0]) for o, x in est.items()]):
                out.append((doc, key, r, e, how, *req.get(r, (None,) * 4)[2:], *est.get(e, (None,) * 4)[2:]))
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    both = prepared(req, 0).unionByName(prepared(est, 1))
    return both.repartition("doc", "key").sortWithinPartitions("doc", "key", "side", "ord").mapInArrow(run, GREEDY)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in GREEDY.split(", ")])


_RUNS = re.compile(r"\d{2,}|\D{2,}")


def _tokens(n: str) -> list[str]:
    """text.tokens_of() of one name."""
    return sorted({n[i : i + 2] for i in range(len(n) - 1)} | set(_RUNS.findall(n)))


def _pair_up(req: list[tuple], est: list[tuple]) -> list[tuple]:
    """(req ord, est ord, how) of one subtable: rows (ord, name, plain name), (ord, name). Only rows without an exact partner walk the free rows."""
    free: dict[int, str] = dict(est)
    named: dict[str, list[int]] = {}
    for o, n in reversed(est):
        named.setdefault(n, []).append(o)
    out = []
    for at, (o, n, plain) in enumerate(req):
        same = named.get(n, [])
        while same and same[-1] not in free:
            same.pop()
        if same:
            hit, how = same.pop(), "exact"
        else:
            tokens = _tokens(plain)
            hit, how = next((e for e, x in free.items() if all(t in x for t in tokens)), None), "all"
            if hit is None:
                hit, how = next((e for e, x in free.items() if any(t in x for t in tokens)), None), "any"
        if hit is None:
            own = est[at][0] if at < len(est) and est[at][0] in free else next(iter(free), None)
            out.append((o, own, "missing"))
        else:
            del free[hit]
            out.append((o, hit, how))
    return out + [(None, o, "extra") for o in free]


def subtable_status(matched: DataFrame) -> DataFrame:
    """greedy()'s rows with the status of each pair; only exact names are certain (confidence 1)."""
    m = matched
    qty = rules.quantity_differs(F.col("req_quantity"), F.col("est_quantity"))
    unit = text.unit(F.col("req_unit")) != text.unit(F.col("est_unit"))
    status = (
        F.when(F.col("how").isin("missing", "extra"), F.upper("how")).when(qty, "QUANTITY_MISMATCH").when(unit, "UNIT_MISMATCH")
        .when(F.col("how") != "exact", "NAME_MISMATCH").otherwise("OK")
    )
    return m.select("doc", "key", "req_ord", "est_ord", "how", status.alias("status"), F.when(F.col("how") == "exact", 1.0).otherwise(0.0).alias("match_confidence"))


def missing_by_name(req: DataFrame, est: DataFrame) -> DataFrame:
    """Requested items whose name occurs nowhere in the estimate of the document; blank names are not reported."""
    n = text.item_name(F.col("item_key"))
    r = req.withColumn("name", n).where("name <> ''")
    return r.join(est.select("doc", n.alias("name")).distinct(), ["doc", "name"], "left_anti")


def _names_match(a, b):
    near = (F.length(a) > 10) & (F.length(b) > 10) & (F.abs(F.length(a) - F.length(b)) <= 2) & (F.substring(a, 1, 10) == F.substring(b, 1, 10))
    return F.contains(a, b) | F.contains(b, a) | near


def extra_simplified(req: DataFrame, est: DataFrame) -> DataFrame:
    """Estimated items without a requested one of like name, equal unit and quantity within the tolerance.

    Document and unit are join keys, and the quantity's thousandth with its two neighbours, so no pair outside a
    narrow cell is compared. Blank quantities count as 0; an empty name is contained in every name.
    """

    def prepared(df):
        q = F.coalesce("quantity", F.lit(0.0))
        return df.withColumn("_n", text.item_name(F.col("item_key"))).withColumn("_u", text.unit(F.col("unit"))).withColumn("_q", q).withColumn("_b", F.floor(q * 1000).cast("long"))

    e = prepared(est).alias("e")
    r = prepared(req).withColumn("_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1))).alias("r")
    on = [F.col(f"e.{c}") == F.col(f"r.{c}") for c in ("doc", "_u", "_b")]
    on += [F.abs(F.col("e._q") - F.col("r._q")) < rules.TOLERANCE, _names_match(F.col("r._n"), F.col("e._n"))]
    return e.join(r, on, "left_anti").select(*est.columns)


#: Rows of a document that one task may pair up in memory; larger documents go by joins.
LARGEST = 100_000


def token_overlap(req: DataFrame, est: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(doc, req_ord, est_ord, shared): pairs of a document whose names share a character pair.

    Names are shuffled, not their pairs: a task holds a document's index of character pairs. Where a document has more than largest rows,
    all go by an equi-join on the pair.
    """
    return _overlaps(req, est, None, largest)


def best_candidate(req: DataFrame, est: DataFrame, k: int = 1, largest: int = LARGEST) -> DataFrame:
    """The k estimated items that share most pairs with each requested one; ties go to the earlier."""
    return _overlaps(req, est, k, largest)


def _overlaps(req: DataFrame, est: DataFrame, k: int | None, largest: int) -> DataFrame:
    names = lambda df, side: df.select("doc", F.lit(side).alias("side"), F.col("ord").alias("ord"), text.name(F.col("item_key")).alias("name"))
    both = written(names(est, 0).unionByName(names(req, 1)), "names")  # read to find large documents and to pair
    kind = both.schema["ord"].dataType
    doc, ord_ = both.schema["doc"].dataType.simpleString(), kind.simpleString()
    if not has_group_over(both, ["doc"], largest):
        types = [pa_type(both.schema["doc"].dataType), pa_type(kind), pa_type(kind), pa.int64(), pa.int32()][: 5 if k else 4]
        columns = ["doc", "req_ord", "est_ord", "shared", "rank"][: len(types)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by document, estimated before requested."""
            out: list[tuple] = []
            at, index = None, {}
            for b in batches:
                for d, side, o, n in zip(*(c.to_pylist() for c in b.columns)):
                    if d != at:
                        at, index = d, {}
                    pairs = {n[i : i + 2] for i in range(len(n) - 1)}
                    if not side:
                        for p in pairs:
                            index.setdefault(p, []).append(o)
                        continue
                    found = Counter(chain.from_iterable(index[p] for p in pairs if p in index))
                    if k is None:
                        out += [(d, o, e, c) for e, c in found.items()]
                    else:
                        out += [(d, o, e, c, i) for i, (e, c) in enumerate(nsmallest(k, found.items(), lambda x: (-x[1], x[0])), 1)]
                    while len(out) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[:10_000]), types)], columns)
                        del out[:10_000]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], columns)

        schema = f"doc {doc}, req_ord {ord_}, est_ord {ord_}, shared long" + ", rank int" * bool(k)
        return both.where("doc is not null").repartition("doc").sortWithinPartitions("doc", "side").mapInArrow(run, schema)
    pair = F.explode(_duos(text.tokens_of(F.col("name")))).alias("pair")
    r = both.where("side = 1").select("doc", F.col("ord").alias("req_ord"), pair)
    e = both.where("side = 0").select("doc", F.col("ord").alias("est_ord"), pair)
    out = r.join(e, ["doc", "pair"]).groupBy("doc", "req_ord", "est_ord").agg(F.count("*").alias("shared"))
    if k is None:
        return out
    w = W.partitionBy("doc", "req_ord").orderBy(F.col("shared").desc(), "est_ord")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _prefixes(names: DataFrame, alphabet: DataFrame, least: float) -> DataFrame:
    """doc, name, m, c, k: of each name so many of its rarest characters (c for the k-th time) that a name of that ratio shares one of them."""
    sorted_ = F.array_sort(F.split("name", ""))
    marked = F.transform(sorted_, lambda c, i: F.struct(c.alias("c"), (i + 2 - F.array_position(sorted_, c)).cast("int").alias("k")))
    each = names.where("name <> ''").withColumn("m", F.length("name")).select("doc", "name", "m", F.explode(marked).alias("x")).select("doc", "name", "m", "x.*")
    each = each.join(F.broadcast(alphabet), "c")  # a row a code point at most
    place = F.row_number().over(W.partitionBy("doc", "name").orderBy("f", "c", "k"))
    shared = F.greatest(F.lit(1), F.ceil(F.col("m") * least / (200 - least) - 1e-9))
    return each.withColumn("place", place).where(F.col("place") <= F.col("m") - shared + 1).drop("place", "f")


def similar(left: DataFrame, right: DataFrame, least: float = 80.0) -> DataFrame:
    """doc, name, other, ratio: all pairs of distinct names (doc, name) of a document whose ratio is at least least (above 0).

    Two names of that ratio have so many characters in common that their rarest ones, as many as least leaves open, meet; only pairs that
    meet there and whose lengths allow the ratio are formed and verified. The ratio is the share, in percent, of both texts that a longest
    common subsequence covers; empty names are like nothing.
    """
    l, r = left.select("doc", "name").distinct(), right.select("doc", "name").distinct()
    alphabet = l.unionByName(r).select(F.explode(F.split("name", "")).alias("c")).groupBy("c").agg(F.count("*").alias("f"))
    alphabet = written(alphabet, "alphabet")
    other = _prefixes(r, alphabet, least).withColumnRenamed("name", "other").withColumnRenamed("m", "n")
    both = _prefixes(l, alphabet, least).join(other, ["doc", "c", "k"])
    high, low = F.greatest("m", "n"), F.least("m", "n")
    pairs = both.where(low * (200 - least) >= high * least - 1e-6).select("doc", "name", "other").distinct()
    return pairs.withColumn("ratio", text.ratio(F.col("name"), F.col("other"))).where(F.col("ratio") >= least)


def _best(r: DataFrame, e: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc, req_ord, est_ord, ratio: of rows r (doc, req_ord, name) the best of similar()'s pairs, the first row e (doc, other, est_ord) of equals."""
    first = e.groupBy("doc", "other").agg(F.min("est_ord").alias("est_ord"))
    top = pairs.join(first, ["doc", "other"]).groupBy("doc", "name").agg(F.max(F.struct("ratio", (-F.col("est_ord")).alias("o"))).alias("x"))
    return r.join(top, ["doc", "name"]).select("doc", "req_ord", (-F.col("x.o")).alias("est_ord"), F.col("x.ratio").alias("ratio"))


def fuzzy_best(req: DataFrame, est: DataFrame, least: float = 80.0) -> DataFrame:
    """Best estimated name of the document by ratio (percent, at least least) for names without an exact partner; the first of equals."""
    n = text.item_name(F.col("item_key"))
    r = written(req.select("doc", F.col("ord").alias("req_ord"), n.alias("name")), "requested")
    e = written(est.select("doc", F.col("ord").alias("est_ord"), n.alias("other")), "estimated")
    r = r.join(e.select("doc", F.col("other").alias("name")).distinct(), ["doc", "name"], "left_anti")
    return _best(r, e, similar(r, e.withColumnRenamed("other", "name"), least))


def containing(r: DataFrame, e: DataFrame) -> DataFrame:
    """doc, req_ord, est_ord: the first row e (doc, est_ord, other) whose name holds all tokens of a row r (doc, req_ord, tokens).

    Names are looked up by the character pair of r that is rarest in the document's names, and only what is found there is verified. A
    name without tokens is held by any, so by the document's first row.
    """
    index = e.select("doc", "est_ord", "other", F.explode(_duos(text.tokens_of(F.col("other")))).alias("duo"))
    often = index.groupBy("doc", "duo").agg(F.count("*").alias("n"))
    asked = r.select("doc", "req_ord", "tokens", F.explode(_duos(F.col("tokens"))).alias("duo")).join(often, ["doc", "duo"], "left")
    rare = asked.groupBy("doc", "req_ord").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "duo")).alias("x"), F.first("tokens").alias("tokens"))
    rare = rare.where("x.n > 0").select("doc", "req_ord", "tokens", F.col("x.duo").alias("duo"))
    held = rare.join(index, ["doc", "duo"]).where(rules.all_tokens(F.col("tokens"), F.col("other"))).groupBy("doc", "req_ord").agg(F.min("est_ord").alias("est_ord"))
    first = e.groupBy("doc").agg(F.min("est_ord").alias("est_ord"))
    return held.unionByName(r.where(F.size("tokens") == 0).join(first, "doc").select("doc", "req_ord", "est_ord"))


def _duos(tokens):
    return F.filter(tokens, lambda t: F.length(t) == 2)


#: Ratios at which the nearest name of a missing row is looked for, one after the other; the last asks for any common character.
RATIOS = (60.0, 30.0, 1e-6)


def nearest(r: DataFrame, e: DataFrame) -> DataFrame:
    """doc, req_ord, est_ord: of rows r (doc, req_ord, name) the row e (doc, est_ord, other) of best ratio, the first of equals.

    Joins at falling ratios: a row leaves with the first one that finds a name, which then is the best. A name that has no character in
    common with any of the document gets its first row; a document without rows e has none.
    """
    names, found = e.select("doc", F.col("other").alias("name")), []
    for least in RATIOS:
        r = written(r, "open")
        found.append(written(_best(r, e, similar(r, names, least)).drop("ratio"), "nearest"))
        r = r.join(found[-1], ["doc", "req_ord"], "left_anti")
    found.append(r.join(e.groupBy("doc").agg(F.min("est_ord").alias("est_ord")), "doc").select("doc", "req_ord", "est_ord"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def cascade(req: DataFrame, est: DataFrame) -> DataFrame:
    """doc, req_ord, est_ord, how, status: for each requested item the first estimated one of the document that fits best.

    how: exact (equal names) or folded (equal but for width, case and spaces), whose status is that of the pair; all or any (tokens in the
    name), a NAME_MISMATCH; missing, with the row of best ratio beside it. Rows may be found more than once. Each kind is looked for only
    for rows that the kinds before did not find: by name, by folded name, by the rarest character pair, by any pair (of which only
    the first row is kept), by ratio.
    """
    r = rules.prepared(req).select("doc", F.col("ord").alias("req_ord"), "name", "tokens", text.strict_name(F.col("item_key")).alias("folded"), F.col("quantity").alias("rq"), F.col("unit").alias("ru"))
    e = rules.prepared(est).select("doc", F.col("ord").alias("est_ord"), F.col("name").alias("other"), text.strict_name(F.col("item_key")).alias("folded"), F.col("quantity").alias("eq"), F.col("unit").alias("eu"))
    r, e = written(r, "requested"), written(e, "estimated")  # each is read by every kind of match
    first = lambda df, *key: df.groupBy("doc", *key).agg(F.min("est_ord").alias("est_ord"))
    kinds = {
        "exact": lambda left: left.join(first(e.withColumnRenamed("other", "name"), "name"), ["doc", "name"]),
        "folded": lambda left: left.join(first(e, "folded"), ["doc", "folded"]),
        "all": lambda left: containing(left, e),
        "any": lambda left: left.select("doc", "req_ord", F.explode(_duos(F.col("tokens"))).alias("duo"))
        .join(first(e.select("doc", "est_ord", F.explode(_duos(text.tokens_of(F.col("other")))).alias("duo")), "duo"), ["doc", "duo"]),
        "missing": lambda left: nearest(left.select("doc", "req_ord", "name"), e.select("doc", "est_ord", "other")),
    }
    left, done = r, None
    for how, find in kinds.items():
        hit = find(left).groupBy("doc", "req_ord").agg(F.min("est_ord").alias("est_ord")).withColumn("how", F.lit(how))
        hit = written(hit, how)
        done = hit if done is None else done.unionByName(hit)
        if how != "missing":
            left = written(left.join(hit, ["doc", "req_ord"], "left_anti"), "left")
    out = r.select("doc", "req_ord", "rq", "ru").join(done, ["doc", "req_ord"], "left").join(e.select("doc", "est_ord", "eq", "eu"), ["doc", "est_ord"], "left")
    how = F.coalesce("how", F.lit("missing"))
    status = F.when(how == "missing", "MISSING").when(how.isin("all", "any"), "NAME_MISMATCH").otherwise(rules.pair_status(F.col("rq"), F.col("eq"), F.col("ru"), F.col("eu")))
    return out.select("doc", "req_ord", "est_ord", how.alias("how"), status.alias("status"))


def title_mismatches(joined: DataFrame) -> DataFrame:
    """titles()'s rows of both sides that do not match, those that could not be compared (match null) among them."""
    return joined.where("side = 'both' and not coalesce(match, false)").withColumn("reason", F.when(F.col("match").isNull(), "skipped").otherwise("differs"))


def titles(req: DataFrame, est: DataFrame) -> DataFrame:
    """Full outer join of subtables on (doc, key): side is both, left or right. First left row and last right row speak.

    Rows: doc, ref, ord, title, unit, quantity. match compares the right title with the left unit and quantity; null
    where either side lacks them (a third state, not a mismatch).
    """

    def one(df, order):
        key = text.title_ref_key(F.col("ref"))
        w = W.partitionBy("doc", "key").orderBy(order)
        return df.withColumn("key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    r, e = one(req, F.col("ord").asc()).alias("r"), one(est, F.col("ord").desc()).alias("e")
    both = r.join(e, (F.col("r.doc") == F.col("e.doc")) & (F.col("r.key") == F.col("e.key")), "full_outer")
    side = F.when(F.col("e.doc").isNull(), "left").when(F.col("r.doc").isNull(), "right").otherwise("both")
    able = F.col("e.title").isNotNull() & F.col("r.unit").isNotNull() & F.col("r.quantity").isNotNull()
    return both.select(
        F.coalesce("r.doc", "e.doc").alias("doc"), F.coalesce("r.key", "e.key").alias("key"), side.alias("side"),
        F.when((side == "both") & able, text.title_has(F.col("e.title"), F.col("r.quantity"), F.col("r.unit"))).alias("match"),
    )


def number_duplicates(items: DataFrame) -> DataFrame:
    """item_key made unique within a document: the k-th repeat of a name gets _dup_k."""
    n = text.item_name(F.col("item_key"))
    w = W.partitionBy("doc", "name").orderBy("ord")
    d = items.select("doc", "ord", n.alias("name")).withColumn("k", F.row_number().over(w) - 1)
    return d.select("doc", "ord", F.when(F.col("k") == 0, F.col("name")).otherwise(F.concat("name", F.lit("_dup_"), F.col("k").cast("string"))).alias("unique_name"))
