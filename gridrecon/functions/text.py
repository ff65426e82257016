"""Normalisers of names, units, references and quantities as Column expressions (no Python at run time)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FULL = "".join(chr(i) for i in range(0xFF01, 0xFF5F))
_HALF = "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F))
_KANA = "".join(chr(i) for i in range(0xFF61, 0xFFA0))
#: Java's (?U)\s as a plain class, which is much faster.
BLANKS = "\\t-\\r\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
_SPACE = f"[{BLANKS}]"
# What a name keeps: word characters, kana, kanji and these signs.
_KEEP = "(?U)[^\\w\\u3040-\\u309F\\u30A0-\\u30FF\\u4E00-\\u9FAF\\uFF61-\\uFF9FφΦ×✕*～〜,，、。]"

# Spellings of units.
UNITS = {
    "m2": "㎡", "m²": "㎡", "平方メートル": "㎡", "m3": "㎥", "m³": "㎥", "立方メートル": "㎥", "メートル": "m", "センチメートル": "cm",
    "ミリメートル": "mm", "キログラム": "kg", "グラム": "g", "リットル": "l", "ℓ": "l",
}


def half_width(x: Column) -> Column:
    """Full-width ASCII as ASCII."""
    return F.translate(x, _FULL, _HALF)


def full_kana(x: Column) -> Column:
    """Half-width kana as full-width; a voice mark joins the kana before it."""
    plain = x
    joined = [(k + mark, j) for mark in "ﾞﾟ" for k in _KANA if len(j := unicodedata.normalize("NFKC", k + mark)) == 1]
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in joined))  # one literal, not a call each in every plan
    x = F.aggregate(pairs, x, lambda t, p: F.replace(t, p["a"], p["b"]))
    x = F.translate(x, _KANA, "".join(unicodedata.normalize("NFKC", k)[0] if k not in "ﾞﾟ" else "゛゜"["ﾞﾟ".index(k)] for k in _KANA))
    return F.when(plain.rlike("[\uFF61-\uFF9F]"), x).otherwise(plain)  # most names hold none


def name(x: Column) -> Column:
    """Comparison form of a name. Drops . - / : and brackets, so 1.5 and 15 become equal; null is empty."""
    plain = F.coalesce(x, F.lit(""))
    x = F.lower(half_width(full_kana(plain)))
    x = F.regexp_replace(F.regexp_replace(x, "(?U)\\s*\\+\\s*", ""), _SPACE, "")
    x = F.regexp_replace(x, _KEEP, "")
    for noise in ("(?U)^第\\d+号", "当り$", "当たり$"):
        x = F.regexp_replace(x, noise, "")
    return F.when(plain.rlike("^[A-Za-z0-9_ ]*\\z"), F.replace(F.lower(plain), F.lit(" "), F.lit(""))).otherwise(x)  # names without any sign to fold or drop


def item_name(x: Column, plain: Column | None = None) -> Column:
    """name() of each part between pipes; empty parts go. plain: name(x) where it has been made before."""
    parts = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\\|"), name), lambda p: p != "")
    return F.when(F.contains(x, F.lit("|")), F.array_join(parts, "|")).otherwise(name(x) if plain is None else plain)


def tokens(x: Column) -> Column:
    """Distinct character pairs and digit or non-digit runs of two or more of the name; one character has none."""
    return F.element_at(F.transform(F.array(name(x)), tokens_of), 1)  # the name is made once, not for every pair


def tokens_of(n: Column) -> Column:
    """tokens() of a name that has been made before."""
    pairs = F.when(F.length(n) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.length(n), F.lit(2)) - 1), lambda i: F.substring(n, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    runs = F.filter(F.regexp_extract_all(n, F.lit("(?U)\\d+|\\D+"), F.lit(0)), lambda p: F.length(p) >= 2)
    return F.array_sort(F.array_union(pairs, runs))


def strict_name(x: Column) -> Column:
    """Width and case folded, white space dropped, all else kept."""
    return F.lower(F.regexp_replace(half_width(x), _SPACE, ""))


def compact(x: Column) -> Column:
    """Width of letters and digits folded, white space dropped, case kept."""
    letters = "".join(c for c in _FULL if unicodedata.normalize("NFKC", c).isalnum())
    return F.regexp_replace(F.translate(F.coalesce(x, F.lit("")), letters, unicodedata.normalize("NFKC", letters)), _SPACE, "")


def unit(x: Column) -> Column:
    u = F.lower(half_width(F.regexp_replace(F.coalesce(x, F.lit("")), "(?U)^\\s+|\\s+$", "")))
    table = F.create_map(*(F.lit(v) for kv in UNITS.items() for v in kv))
    return F.coalesce(F.element_at(table, u), u)


def _key(r: Column) -> Column:
    a, b = "^第?(\\d+)号([一-龯])$", "^([一-龯])(\\d+)号$"
    return (
        F.when(r.rlike(a), F.concat(F.regexp_extract(r, a, 2), F.lit(":"), F.regexp_extract(r, a, 1)))
        .when(r.rlike(b), F.concat(F.regexp_extract(r, b, 1), F.lit(":"), F.regexp_extract(r, b, 2)))
        .otherwise(r)
    )


def ref_key(x: Column) -> Column:
    """Key of a reference number: no blanks, no repeat suffix, 第3号明 like 明3号."""
    return _key(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "[ 　]", ""), "-\\d+$", ""))


def title_ref_key(x: Column) -> Column:
    """As ref_key, but a repeat suffix stays: titles of repeats are subtables of their own."""
    return _key(F.regexp_replace(F.coalesce(x, F.lit("")), "[ 　]", ""))


def references(x: Column) -> Column:
    """All reference numbers of a page's text, without spaces: those of the form 第3号明 first, then 内3号 and the like.

    Digits may be full-width, parts apart. A bare 第3号 is left out where a longer reference begins with it.
    """
    t = F.translate(F.coalesce(x, F.lit("")), "０１２３４５６７８９", "0123456789")

    def found(pattern):
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda r: F.regexp_replace(r, _SPACE, ""))

    def of(long):
        bare = F.filter(found("(?U)[一-龯々]+\\s*[0-9]+\\s*号"), lambda r: ~(F.startswith(r, F.lit("第")) & F.exists(long, lambda q: F.startswith(q, r))))
        return F.array_distinct(F.concat(long, bare))

    return F.element_at(F.transform(F.array(found("(?U)第\\s*[0-9]+\\s*号\\s*[一-龯]")), of), 1)


def is_reference(x: Column) -> Column:
    return F.coalesce(compact(x).rlike("^[一-龯]+-?\\d+号$"), F.lit(False))


def quantity(x: Column) -> Column:
    """First run of digits and dots, commas dropped; 0 if it is no number."""
    t = F.regexp_replace(half_width(F.coalesce(x, F.lit(""))), ",", "")
    return F.coalesce(F.regexp_extract(t, "[\\d.]+", 0).try_cast("double"), F.lit(0.0))


def amount(x: Column) -> Column:
    """A whole cell as a number, commas dropped; 0 on failure."""
    t = F.trim(F.regexp_replace(half_width(F.coalesce(x, F.lit(""))), ",", ""))
    return F.coalesce(F.when(t.rlike("^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"), t).try_cast("double"), F.lit(0.0))


def is_description(x: Column) -> Column:
    """Whether a cell beside a quantity is words (Latin letters, =, brackets, 号 or 明) and no part of it."""
    return F.coalesce(x, F.lit("")).rlike("[A-Za-z=()号明]")


def split_quantity(whole: Column, left: Column, right: Column) -> Column:
    """A whole number with the decimals of its left, else right, neighbour cell (0.5, .5, or up to three digits).

    Neighbours that are words are passed over. Commas end the number: 1,234 is 1.
    """
    base = F.regexp_extract(half_width(unspaced(whole)), "\\d+(\\.\\d+)?", 0)

    def part(c):
        plain = half_width(unspaced(c))
        found = F.regexp_extract(plain, "0?\\.(\\d+)", 1)
        return F.when(is_description(unspaced(c)), None).when(found != "", found).when(plain.rlike("^\\d{1,3}$"), plain)

    decimals = F.coalesce(part(left), part(right))
    joined = F.when(F.contains(base, F.lit(".")) | decimals.isNull(), base).otherwise(F.concat(base, F.lit("."), decimals))
    return F.coalesce(joined.try_cast("double"), F.lit(0.0))


def signed_quantity(whole: Column, left: Column, right: Column) -> Column:
    """As split_quantity, but as text, with a sign, commas dropped and no decimals added to a number that has some."""
    plain = F.regexp_replace(half_width(unspaced(whole)), ",", "")
    base = F.regexp_extract(plain, "[+-]?\\d+(\\.\\d+)?", 0)

    def part(c):
        c = half_width(unspaced(c))
        return F.when(c.rlike("^0?\\.\\d+$"), F.regexp_extract(c, "\\.(\\d+)$", 1)).when(c.rlike("^\\d{1,3}$"), c)

    decimals = F.coalesce(part(left), part(right))
    return F.nullif(F.when((base == "") | F.contains(base, F.lit(".")) | decimals.isNull(), base).otherwise(F.concat(base, F.lit("."), decimals)), F.lit(""))


def quantity_text(x: Column) -> Column:
    """Commas, trailing zeros after the point and a trailing point dropped."""
    t = F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), "[,，]", "")
    return F.when(F.contains(t, F.lit(".")), F.regexp_replace(F.regexp_replace(t, "0+$", ""), "\\.$", "")).otherwise(t)


def title_has(title: Column, qty: Column, unit_: Column) -> Column:
    """Whether the title holds quantity and unit side by side, the quantity with or without commas."""
    t, u = compact(title), unit(unit_)
    t = F.regexp_replace(F.regexp_replace(t, "m2|m²", "㎡"), "m3|m³", "㎥")
    q = F.regexp_replace(compact(qty), "[,，]", "")
    comma = F.when(F.length(q) >= 4, F.concat(F.expr("''"), F.substring(q, F.lit(1), F.length(q) - 3), F.lit(","), F.substring(q, F.length(q) - 2, F.lit(3)))).otherwise(q)
    hit = F.contains(t, F.concat(compact(qty), u)) | F.contains(t, F.concat(q, u)) | F.contains(t, F.concat(comma, u))
    return F.coalesce((q != "") & (u != "") & hit, F.lit(False))


def level(x: Column) -> Column:
    """Number of leading ideographic spaces."""
    x = F.coalesce(x, F.lit(""))
    return F.length(x) - F.length(F.regexp_replace(x, "^　+", ""))


def level_total(x: Column) -> Column:
    return F.length(F.coalesce(x, F.lit(""))) - F.length(F.replace(F.coalesce(x, F.lit("")), F.lit("　"), F.lit("")))


#: What clean_cell changes: blanks but single spaces inside, and zero-width characters (a plain class, much faster than (?U)).
_UNCLEAN = "[\\t-\\r\\x85\\xA0\\u1680\\u2000-\\u200D\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]|^ |  | $"


def clean_cell(x: Column) -> Column:
    """Blanks of any kind made one space, zero-width characters dropped, trimmed."""
    plain = F.coalesce(x, F.lit(""))
    x = F.regexp_replace(plain, "[\\u200B-\\u200D\\uFEFF]", "")
    x = F.trim(F.regexp_replace(F.translate(x, "　 ", "  "), _SPACE + "+", " "))
    return F.when(plain.rlike(_UNCLEAN), x).otherwise(plain)  # most cells are clean


def dotted_level(x: Column) -> Column:
    """Dots (one to three) that open an item of a dotted list; 0 for any other row."""
    return F.length(F.regexp_extract(F.coalesce(x, F.lit("")), "(?U)^\\s*([・･]{1,3})(?![・･])", 1))


def is_total(x: Column, kitakami: bool = False) -> Column:
    c = compact(x)
    return F.contains(c, F.lit("合計")) | (c == "計" if kitakami else F.lit(False))


def field(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match over lines, null if none."""
    return F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), f"(?sm){pattern}", group), F.lit(""))


def item_key(*cells: Column, spec: Column) -> Column:
    """First non-blank of the cells, with the specification behind it."""
    first = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cells))
    return F.trim(F.concat_ws(" ", first, F.nullif(F.trim(spec), F.lit(""))))


def similarity(a: Column, b: Column) -> Column:
    """Characters of a that occur in b, over the longer length; 0 for two empty texts."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, F.size(F.filter(F.split(a, ""), lambda c: (c != "") & F.contains(b, c))) / longer).otherwise(0.0)


@F.pandas_udf(T.StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def nfkc(x: Column) -> Column:
    """Compatibility form (Spark has no function for it, so texts go through Arrow once); null is empty."""
    return _nfkc(F.coalesce(x, F.lit("")))


def simple(x: Column) -> Column:
    """Compatibility form without white space and commas."""
    return F.regexp_replace(nfkc(x), "(?U)[\\s,，]", "")


def field_text(x: Column) -> Column:
    """Compatibility form without white space."""
    return F.regexp_replace(nfkc(x), _SPACE, "")


def unspaced(x: Column) -> Column:
    """White space dropped, all else kept; null is empty."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), _SPACE, "")


def cell(x: Column, keep: bool = False) -> Column:
    """Text of a cell: empty for null or not a number, trimmed unless keep (the leading spaces that tell a level)."""
    x = F.coalesce(F.when(F.lower(x) != "nan", x), F.lit(""))
    return x if keep else F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")


def ratio(a: Column, b: Column) -> Column:
    """Share, in percent, of the two texts that a longest common subsequence covers."""
    return _ratio(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        if not x and not y:
            return 100.0
        where, v, full = {}, (1 << len(y)) - 1, (1 << len(y)) - 1
        for j, c in enumerate(y):
            where[c] = where.get(c, 0) | (1 << j)
        for c in x:
            u = v & where.get(c, 0)
            v = ((v + u) | (v - u)) & full
        return 200.0 * (len(y) - v.bit_count()) / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def longest_reference(row: Column, refs: Column) -> Column:
    """Of the references those that the row's text holds, parts apart or not, the longest, the first of equals; null if none."""
    t = F.regexp_replace(compact(row), "[,，]", "")
    held = F.filter(refs, lambda r: F.contains(t, r))
    best = F.array_max(F.transform(held, lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("at"), r.alias("ref"))))
    return best["ref"]
