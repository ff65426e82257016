"""Surrogates for personal data, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridrecon.llm.common import written

# Titles by gender, given names by script and gender.
TITLES = {
    "m": r"Mr|Herr|Monsieur|Señor|Sr|Signor|Г-н|Господин|Κύριος",
    "f": r"Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Signora|Г-жа|Госпожа|Κυρία",
    "n": r"Dr|Prof",
}
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Niels Oscar Paul",
    ("latin", "f"): "Anna Berta Clara Diana Emma Flora Greta Helena Irene Julia Karla Laura Maria Nora Olga Paula",
    ("latin", "n"): "Alex Andrea Chris Dominique Jo Kim Kris Lou Nicola Noel Pat Robin Rene Sam Sascha Toni",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Ирина Лидия",
    ("cyrillic", "n"): "Женя Саша Валя Слава",
    ("greek", "m"): "Γιώργος Νίκος Κώστας Πέτρος",
    ("greek", "f"): "Άννα Ελένη Μαρία Σοφία",
    ("greek", "n"): "Φώτης Χρύσα Άρης Ίρις",
}
CONSONANTS = {"latin": "bdfgklmnprstvzhj", "cyrillic": "бвгдзклмнпрстфхж", "greek": "βγδζθκλμνξπρστφχ"}
VOWELS = {"latin": "aeioaeiuaeioaeuo", "cyrillic": "аеиоуаеиоуаеиоуа", "greek": "αεηιοαεηιοαεηιου"}
ENDINGS = {("latin", "m"): "n", ("latin", "f"): "a", ("cyrillic", "m"): "н", ("cyrillic", "f"): "а", ("greek", "m"): "ος", ("greek", "f"): "α"}

_ANY = "|".join(TITLES.values())
#: A name begins with a capital and may hold more, hyphens and apostrophes; a possessive s is not part of it.
_NAME = r"\p{Lu}(?:[\p{L}\p{M}]|['’-](?=\p{L})(?!s(?!\p{L})))++"
#: What may stand before a name and stays: lower-case particles and initials.
_BEFORE = r"(?:(?:von|vom|van|vander|der|den|de|la|le|las|los|du|da|das|dos|do|di|dei|del|della|des|zu|zum|zur|ter|ten|te|af|av|al|el|bin|ibn|y|e) |d['’]|\p{Lu}\. ?)*"
_TITLES = rf"(?:(?:{_ANY})\.? )+"
_TITLE = rf"(?<![\p{{L}}\p{{N}}])(?=[{''.join(sorted({t[0] for t in _ANY.split('|')}))}]){_TITLES}{_BEFORE}"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Patterns in order of precedence; each starts at a place where no run of its own characters is under way.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+)(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]*[0-9])(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\p{{L}}\p{{N}}:])",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\d-])",
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,5}(?!\d)"
    r"|(?<![\p{L}\p{N}(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
    # national, with a trunk 0: 9 to 12 digits in groups, no date
    r"|(?<![\p{L}\p{N}.,:+/(-])(?=\(?0[1-9])(?!0[1-9][./ -]\d{2}[./ -](?:19|20)\d{2}(?!\d))(?=(?:[ /.()-]{0,3}\d){9,12}(?![ /.-]?\d))\(?0[1-9]\d{0,4}\)?(?:(?: ?[/–-] ?|[ .])\d{2,8}){1,5}(?!\d)",
    "name": rf"{_TITLE}{_NAME}(?: {_BEFORE}{_NAME})*+",
}
#: A name where no title stands: only one that the same text names with a title is exchanged.
WORD = rf"(?<![\p{{L}}\p{{N}}]){_NAME}"
# Country codes of one and two digits; the others have three.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
#: Group 1 holds what matched as a title with names.
PATTERN = "|".join(f"({p})" if k == "name" else p for k, p in KINDS.items())
#: Each name of such a match, the first with its title.
PIECE = rf"(?:^{_TITLES}{_BEFORE})?{_NAME}"
#: What any match holds: a cheap first look.
HINT = rf"[0-9@]|{_TITLE}\p{{Lu}}"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _script(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").when(x.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _units(ents: DataFrame) -> DataFrame:
    """(ent, is_given) with kind and canon: mentions of one canon are one entity."""
    ent = F.col("ent")
    kind = F.when(F.col("is_given"), "given")
    for k, p in KINDS.items():
        if k != "name":
            kind = kind.when(ent.rlike(f"^(?:{p})$"), k)
    df = ents.withColumn("kind", kind.otherwise("family"))
    title = F.regexp_extract(ent, rf"^{_TITLES}", 0)
    gender = F.lit("n")
    for g in ("m", "f"):
        gender = F.when(title.rlike(rf"(?<!\p{{L}})(?:{TITLES[g]})\.? "), g).otherwise(gender)
    name = F.regexp_replace(ent, rf"^{_TITLES}{_BEFORE}", "")
    df = df.withColumn("gender", F.when(F.col("kind") == "given", gender).otherwise("n")).withColumn("name", name)
    canon = (
        F.when(F.col("kind") == "email", F.lower(ent))
        .when(F.col("kind") == "secret", F.lower(ent))
        .when(F.col("kind") == "iban", F.regexp_replace(ent, " ", ""))
        .when(F.col("kind") == "ip", ent)
        .when(F.col("kind") == "ipv6", F.lower(ent))
        .when(F.col("kind") == "given", F.concat("gender", F.lit(":"), "name"))
        .when(F.col("kind") == "family", F.col("name"))
        .when(F.startswith(ent, F.lit("+")), F.concat(F.lit("+"), _digits(ent)))
        .otherwise(_digits(ent))
    )
    return df.withColumn("canon", canon)


def _nibble(h: Column, i: Column) -> Column:
    """i-th (from 0, cyclic) hex digit of h as a number."""
    return F.conv(F.substring(h, F.pmod(i, F.lit(128)) + 1, F.lit(1)), 16, 10).cast("int")


def _byte(h: Column, i: Column) -> Column:
    return F.conv(F.substring(h, F.pmod(i * 2, F.lit(128)) + 1, F.lit(2)), 16, 10).cast("int")


def _pick(chars: str, n: Column) -> Column:
    return F.substring(F.lit(chars), F.pmod(n, F.lit(len(chars))) + 1, F.lit(1))


def _like(x: Column, h: Column) -> Column:
    """x with every letter and digit exchanged for one of the same script and case; the rest stays."""
    chars = F.split(x, "")

    def one(c, i):
        b = _byte(h, i)
        out = F.when(c.rlike("[0-9]"), _pick("0123456789", b))
        for letters, up, low in (
            ("A-Za-z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
            (r"\p{IsCyrillic}", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШ", "абвгдежзиклмнопрстуфхцчш"),
            (r"\p{IsGreek}", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "αβγδεζηθικλμνξοπρστυφχψω"),
            (r"\p{L}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        ):
            out = out.when(c.rlike(f"[{letters}]"), F.when(c.rlike(r"\p{Lu}"), _pick(up, b)).otherwise(_pick(low, b)))
        return out.otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _fill(x: Column, digits: Column) -> Column:
    """x with its digits, one after the other, exchanged for those of digits."""

    def one(c, i):
        nth = F.length(_digits(F.substring(x, F.lit(1), i + 1)))
        return F.when(c.rlike("[0-9]"), F.substring(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(x, ""), one), "")


def _luhn(d: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    rev = F.split(F.reverse(d), "")

    def add(acc, i):
        n = F.coalesce(rev[i].cast("int"), F.lit(0))
        return acc + F.when(i % 2 == 1, F.floor(n * 2 / 10).cast("int") + n * 2 % 10).otherwise(n)

    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(d), F.lit(1)) - 1), F.lit(0), add) % 10


def _iban(country: Column, account: Column) -> Column:
    """An IBAN with the check digits that make it 1 modulo 97."""

    def add(acc, c):
        return F.when(c.rlike("[0-9]"), acc * 10 + c.try_cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97

    rest = F.aggregate(F.filter(F.split(F.concat(account, country, F.lit("00")), ""), lambda c: c != ""), F.lit(0), add)
    return F.concat(country, F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), account)


def _syllables(h: Column, script: Column, ending: Column | None = None) -> Column:
    def word(s):
        return F.concat(*(_pick((CONSONANTS if i % 2 == 0 else VOWELS)[s], _nibble(h, F.lit(i + 3))) for i in range(6)), *(_pick(CONSONANTS[s], _nibble(h, F.lit(i))) for i in (11,)))

    def more(s):
        return F.transform(longer, lambda i: F.when(i % 2 == 1, _pick(VOWELS[s], _nibble(h, i + 20))).otherwise(_pick(CONSONANTS[s], _nibble(h, i + 20))))

    longer = _longer()
    by_script = lambda f: F.when(script == "cyrillic", f("cyrillic")).when(script == "greek", f("greek")).otherwise(f("latin"))
    out = F.concat(by_script(word), F.array_join(by_script(more), ""))
    return F.initcap(F.concat(out, ending) if ending is not None else out)


def _longer() -> Column:
    """1 to the number of letters by which a name or a mailbox is longer than its form: none in the first draws, then one more in each."""
    n = F.col("attempt") - SAME_LENGTH + 1
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def _range(canon: Column) -> Column:
    """Addresses of private, local and link ranges stay in their range."""
    return F.regexp_extract(canon, r"^(?:10|127|192\.168|169\.254|172(?=\.(?:1[6-9]|2\d|3[01])\.))\.", 0)


def _range6(canon: Column) -> Column:
    return F.regexp_extract(canon, "^(?:fe80|f[cd][0-9a-f]{2})", 0)


def _form() -> Column:
    """What a surrogate of a kind without longer forms keeps: country, range, length, valid check digits."""
    canon, kind = F.col("canon"), F.col("kind")
    part = (
        F.when(kind == "ip", _range(canon)).when(kind == "ipv6", _range6(canon)).when(kind == "iban", F.substring(canon, 1, 2))
        .when(kind == "card", (_luhn(canon) == 0).cast("string")).when(kind == "phone", F.regexp_extract(canon, rf"^(?:\+(?:{COUNTRY})|0)", 0)).otherwise("")
    )
    return F.concat_ws("|", kind, part, F.when(kind.isin("ip", "ipv6"), "").otherwise(F.length(canon).cast("string")))


def _surrogate(key: str) -> Column:
    """Canonical surrogate of (kind, canon, gender, attempt): keyed, of the kind's own form."""
    canon, kind = F.col("canon"), F.col("kind")
    h = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canon, F.col("attempt").cast("string")), 512)
    script = _script(F.col("name"))
    digits = F.substring(F.translate(h, "abcdef", "012345"), F.lit(1), F.length(canon))
    luhn = F.concat(F.substring(digits, F.lit(1), F.length(canon) - 1), F.pmod(F.lit(10) - _luhn(F.concat(F.substring(digits, F.lit(1), F.length(canon) - 1), F.lit("0"))), F.lit(10)).cast("string"))
    email = F.concat(
        _like(F.substring_index(canon, "@", 1), h), F.substring(F.translate(h, "0123456789", "ghijklmnop"), F.lit(1), F.size(_longer())), F.lit("@"),
        _like(F.regexp_extract(canon, r"@(.*)\.[^.]*$", 1), F.reverse(h)), F.lit("."), F.substring_index(canon, ".", -1),
    )
    own = _range(canon)
    part = [(_byte(h, F.lit(i)) % 254 + 1).cast("string") for i in range(4)]
    ip = (
        F.when(F.length(own) == 0, F.concat_ws(".", *part)).when(own == "172.", F.concat(own, F.concat_ws(".", (_byte(h, F.lit(0)) % 16 + 16).cast("string"), *part[1:3])))
        .otherwise(F.concat(own, F.concat_ws(".", F.when(own.isin("10.", "127."), part[1]), *part[2:])))
    )
    kept = F.coalesce(F.nullif(_range6(canon), F.lit("")), F.substring(h, 1, 4))
    code = F.regexp_extract(canon, rf"^\+({COUNTRY})", 1)
    given, ending = F.lit(None).cast("string"), F.lit("")
    for (s, g), names in GIVEN.items():
        names = names.split()
        here = (script == s) & (F.col("gender") == g)
        given = F.when(here, F.element_at(F.array(*map(F.lit, names)), _byte(h, F.lit(0)) % len(names) + 1)).otherwise(given)
        ending = F.when(here, ENDINGS.get((s, g), "")).otherwise(ending)
    given = F.when(F.col("attempt") == 0, given).otherwise(_syllables(h, script, ending))
    return (
        F.when(kind == "email", email)
        .when(kind == "secret", F.substring(h, F.lit(1), F.length(canon)))
        .when(kind == "iban", _iban(F.substring(canon, 1, 2), _like(F.substring(canon, F.lit(5), F.length(canon)), h)))
        .when(kind == "ip", ip)
        .when(kind == "ipv6", F.concat_ws(":", kept, *(F.substring(h, 4 * i + 1, 4) for i in range(1, 8))))
        .when(kind == "given", F.concat("gender", F.lit(":"), given))
        .when(kind == "family", _syllables(h, script))
        .when((kind == "card") & (_luhn(canon) == 0), luhn)
        .when((kind == "phone") & F.startswith(canon, F.lit("+")), F.concat(F.lit("+"), code, F.substring(digits, F.length(code) + 2, F.length(canon))))
        .when((kind == "phone") & canon.rlike("^0[1-9]"), F.concat(F.lit("0"), F.pmod(F.substring(digits, 2, 1).cast("int"), F.lit(9)) + 1, F.substring(digits, F.lit(3), F.length(canon))))
        .otherwise(digits)
    )


def _render() -> Column:
    """The surrogate in the form of the mention: its spacing, punctuation, case and title."""
    ent, kind, sur = F.col("ent"), F.col("kind"), F.col("surrogate")
    title = F.substring(ent, F.lit(1), F.length(ent) - F.length("name"))
    upper = ent == F.upper(ent)
    grouped = F.when(F.instr(ent, " ") > 0, F.trim(F.regexp_replace(sur, "(.{4})", "$1 "))).otherwise(sur)
    return (
        F.when(kind.isin("email", "secret"), F.when(upper, F.upper(sur)).otherwise(sur))
        .when(kind == "iban", grouped)
        .when(kind.isin("ip", "ipv6"), sur)
        .when(kind == "given", F.concat(title, F.substring(sur, F.lit(3), F.length(sur))))
        .when(kind == "family", F.concat(title, sur))
        .otherwise(_fill(ent, _digits(sur)))
    )


#: Draws in which names and mailboxes keep their length; draws after which a form without room is permuted; entities of one part of a permutation.
SAME_LENGTH, DRAWS, PART = 3, 12, 10_000


def _permuted(units: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """units with those of the forms in full given each other's place: in a keyed order each takes the next one's canonical form.

    So surrogates differ by construction; each is another entity of the input, which itself is replaced. Large forms are dealt by hash into
    parts of about PART entities, so no task sorts a form. An entity that is alone in its form keeps what it drew.
    """
    sizes = units.join(full, "form", "left_semi").groupBy("form").agg(F.count("*").alias("n")).withColumn("parts", F.greatest(F.lit(1), F.floor(F.col("n") / PART)).cast("long"))
    some = units.join(sizes, "form").withColumn("turn", F.sha2(F.concat_ws("\u0001", F.lit(key), "kind", "canon"), 256))
    by = W.partitionBy("form", F.pmod(F.xxhash64("turn"), F.col("parts")))
    nxt = F.coalesce(F.lead("canon").over(by.orderBy("turn")), F.first("canon").over(by.orderBy("turn").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    some = some.withColumn("next", nxt).withColumn("surrogate", F.when(F.col("next") == F.col("canon"), F.col("surrogate")).otherwise(F.col("next")))
    return units.join(full, "form", "left_anti").unionByName(some.select(*units.columns))


def dictionary(ents: DataFrame, key: str, draws: int = DRAWS) -> DataFrame:
    """(ent, is_given, kind, replacement, name, new_name) for all distinct mentions; the last two are null but for names.

    Surrogates of one kind are all different and none is an entity of the input: of those that clash the smallest keeps its surrogate, the
    others draw again. From the fourth draw on names and mailboxes grow by a letter a draw, so they always find room. Forms that
    cannot grow (numbers, codes and addresses) and still clash after the given draws have too little room beside their entities: in
    these all entities of the form exchange places, so a surrogate there may be another entity's text.
    """
    mentions = written(_units(ents), "mentions")
    units = mentions.groupBy("kind", "canon", "gender").agg(F.min("name").alias("name")).withColumn("attempt", F.lit(0)).withColumn("form", _form())
    real = mentions.select("kind", F.col("canon").alias("surrogate")).distinct()
    grows, attempt = F.col("kind").isin("email", "given", "family"), 0
    while True:
        units = written(units.drop("surrogate").withColumn("surrogate", _surrogate(key)), "units")
        live = units if attempt < draws else units.where(grows)
        taken = live.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "canon")).alias("first")).where("n > 1")
        clash = live.alias("u").join(taken.alias("t"), ["kind", "surrogate"]).where("struct(u.attempt, u.canon) <> t.first").select("kind", "canon", "form")
        clash = clash.unionByName(live.join(real, ["kind", "surrogate"]).select("kind", "canon", "form")).distinct()
        clash = written(clash.withColumn("again", F.lit(1)), "clash")
        if attempt == draws - 1:  # what cannot grow is settled now
            full = clash.where(~grows).select("form").distinct()
        if clash.isEmpty() or (attempt >= draws - 1 and clash.where(grows).isEmpty()):
            break
        attempt += 1
        units = units.join(clash.drop("form"), ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again")
    if attempt >= draws - 1:
        units = written(_permuted(units, full, key), "units")
    full = mentions.join(units.select("kind", "canon", "gender", "surrogate"), ["kind", "canon", "gender"])
    new = F.when(F.col("kind") == "given", F.substring("surrogate", F.lit(3), F.length("surrogate"))).when(F.col("kind") == "family", F.col("surrogate"))
    return written(full.select("ent", "is_given", "kind", _render().alias("replacement"), F.when(new.isNotNull(), F.col("name")).alias("name"), new.alias("new_name")), "dictionary")


def _follow(segment: Column, names: Column) -> Column:
    """A stretch of text with the names (a map) that stand in it without a title exchanged; struct (text, n)."""
    parts, words = F.split(segment, WORD, -1), F.regexp_extract_all(segment, F.lit(WORD), F.lit(0))
    new = F.transform(words, lambda w: F.coalesce(names[w], w))
    text = F.array_join(F.flatten(F.zip_with(parts, new, lambda b, r: F.array(b, F.coalesce(r, F.lit(""))))), "")
    return F.struct(text.alias("text"), F.size(F.filter(words, lambda w: names[w].isNotNull())).alias("n"))


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with text_col rewritten and n_entities, kinds (array of kinds found) added (columns of these names are replaced).

    E-mail addresses, secrets, IBANs, social security numbers, IP addresses, card or account numbers, telephone
    numbers (international, US, or national with a leading 0) and all names after a title (not its initials and particles) are
    exchanged for keyed surrogates: one entity has one surrogate everywhere, different entities have different ones (dictionary() says
    what happens where a form has no room for new ones; nothing raises). Where the
    same text has such a name again without a title, it gets the same surrogate. Country codes, private address ranges
    and valid check digits are kept. Rows without a match, null and empty texts come through as they are with n_entities 0. Repeated
    rows stay; an empty table gives an empty table; other columns, whatever their names, come through.

    The patterns run over all texts once; what they found is kept beside the rows in a table of the shared folder.
    """
    docs = docs.drop("n_entities", "kinds")
    text = F.col("doc").getField(text_col)  # the row stays together, so no name of a column can clash
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    scanned = docs.select(F.struct(*docs.columns).alias("doc"))
    scanned = written(scanned.withColumn("found", F.coalesce(found, F.array().cast("array<string>"))), "scanned")
    hits = scanned.where(F.size("found") > 0).withColumn("named", F.regexp_extract_all(text, F.lit(PATTERN), F.lit(1)))
    hits = hits.withColumn("between", F.split(text, PATTERN, -1)).withColumn("row", F.monotonically_increasing_id())
    # of a title with several names each name is an entity, and what stands between them stays
    hits = hits.withColumn("pieces", F.zip_with("found", "named", lambda f, n: F.when(n != "", F.regexp_extract_all(f, F.lit(PIECE), F.lit(0))).otherwise(F.array(f))))
    inner = F.zip_with("found", "pieces", lambda f, p: F.when(F.size(p) > 1, F.slice(F.split(f, PIECE, -1), 2, F.size(p) - 1)).otherwise(F.array().cast("array<string>")))
    after = F.zip_with(inner, F.slice("between", 2, F.size("found")), lambda i, b: F.concat(i, F.array(b)))
    hits = hits.withColumn("between", F.concat(F.slice("between", 1, 1), F.flatten(after)))
    hits = hits.withColumn("given", F.flatten(F.transform("pieces", lambda p: F.transform(p, lambda _, i: (i == 0) & (F.size(p) > 1)))))
    hits = written(hits.withColumn("found", F.flatten("pieces")).drop("named", "pieces"), "hits")
    each = F.array_distinct(F.arrays_zip(F.col("found").alias("ent"), F.col("given").alias("is_given")))
    pairs = hits.select("row", F.explode(each).alias("x")).select("row", F.col("x.ent").alias("ent"), F.col("x.is_given").alias("is_given"))
    words = dictionary(pairs.select("ent", "is_given").distinct(), key)
    of_row = pairs.join(words, ["ent", "is_given"]).groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.col("is_given").cast("string"), F.lit(":"), "ent"), "replacement"))).alias("new"),
        # of a name that is a given and a family name the latter speaks
        F.array_sort(F.collect_set(F.when(F.col("name").isNotNull(), F.struct("name", (F.col("kind") == "given").alias("given"), "new_name")))).alias("names"),
        F.sort_array(F.collect_set("kind")).alias("kinds"),
    )
    first = F.filter("names", lambda x, i: (i == 0) | (x["name"] != F.col("names")[F.greatest(i - 1, F.lit(0))]["name"]))
    done = hits.join(of_row, "row").withColumn("names", F.map_from_entries(F.transform(first, lambda x: F.struct(x["name"].alias("k"), x["new_name"].alias("v")))))
    followed = F.transform("between", lambda b: F.when(F.size("names") > 0, _follow(b, F.col("names"))).otherwise(F.struct(b.alias("text"), F.lit(0).alias("n"))))
    done = done.withColumn("followed", followed)
    new = F.zip_with("found", "given", lambda e, g: F.col("new")[F.concat(g.cast("string"), F.lit(":"), e)])
    new = F.array_join(F.flatten(F.zip_with("followed", new, lambda b, r: F.array(b["text"], F.coalesce(r, F.lit(""))))), "")
    count = F.size("found") + F.aggregate("followed", F.lit(0), lambda acc, b: acc + b["n"])
    done = done.select(F.col("doc").withField(text_col, new).alias("doc"), count.cast("long").alias("n_entities"), "kinds")
    rest = scanned.where(F.size("found") == 0).select("doc", F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    return rest.unionByName(done).select("doc.*", "n_entities", "kinds")
