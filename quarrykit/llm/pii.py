r"""Format-preserving pseudonyms for validated numbers and dates, by a keyed Feistel network, on the JVM only.

A value becomes a list of symbols, each with a radix (a digit 10, an octet 256, a
letter 26, ...).  The list is halved; in every round one half gets, symbol by symbol, keyed hashes of
the other half added modulo the radix.  So each format's values are permuted among
themselves: a pseudonym has the format of its value, passes the same validation, equal
values have equal pseudonyms in all documents however they are punctuated, different ones
different, and the key's holder can undo it (`inverse`; of a date with slashes that is one as D/M/Y
only, the order is not known afterwards and it may come back as another date).

Every start of a run of numbers is tried with every end at a number's end, and what
validates is replaced, the leftmost first, so a value beside another number is found.  At one
start the order is that of the patterns, then 16 and 15 digits of a card before other lengths and national numbers
of the American plan before other phones; a card of another length or a phone that holds a value of a stricter
kind gives way to it.  Where numbers stand side by side, a pseudonym may validate together with its neighbour; `inverse`
then may not give the text back.

kind    accepted                                              permuted
card    13 to 19 digits, single spaces or dashes, Luhn         all digits; the last is computed
iban    country, two check digits, 11 to 30 more, in one or in groups of four, modulo 97    what follows; check digits are computed
ssn     3-2-4 digits in issued ranges                          the three numbers
date    Y-M-D, D.M.Y, M/D/Y (D/M/Y if only that is a date), years 1000 to 2999    the day; 1904 to 2099 stay among themselves
ip      four octets                                           the octets
phone   ten digits of the American plan, or + and 8 to 15     national digits; all but the first three
email   local@domain                                          letters and digits of the local part

The keyed hash is HMAC-SHA-256.  The key has no default: who calls gives it, from where the site keeps its secrets.  Spark shows
literals in plans, so event logs of such jobs are to be kept as safe as the key.

Defined cases: null text stays null, with count 0; values that fail validation stay;
repeated rows are treated alike, and of values that start alike the first in the order above is taken; a very long text is one
row's work and is rewritten whole; an empty table gives an empty result; a null doc_id is kept; other columns
are not touched, and where docs has a column `pii` the new one is `pii_`, with as many underscores as it takes.  An
address with octets that begin with 0 comes back with three digits in each octet.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("card", "iban", "ssn", "date", "ip", "phone", "email")

#: The patterns of the kinds, in the order in which they are tried. All but email begin with BEFORE.
BEFORE = r"(?<![0-9A-Za-z_.+@-])"
_E = r"(?![0-9A-Za-z_])"
PATTERNS = {
    "email": r"(?<![0-9A-Za-z._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)" + _E,
    "date": r"(?:[12][0-9]{3}-[01][0-9]-[0-3][0-9]|[0-3][0-9](?:/[0-3][0-9]/|\.[0-3][0-9]\.)[12][0-9]{3})" + _E,
    "ip": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}" + r"(?![0-9A-Za-z_]|\.[0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + r"(?![0-9A-Za-z_-])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}" + _E,
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}" + _E,
}


_A = r"(?![A-Za-z_])"
#: A start and, looked at only, the longest run of numbers, or of an IBAN's groups, from there. Cards and phones may also begin after a number and a dash.
RUNS = rf"(?:{BEFORE}|(?<=[0-9]-))(?=[0-9A-Z+(])(?=((?:\+?\(?[0-9]++{_A}(?:(?:\)[ .-]?|[ .-]?\(|[ ./-])[0-9]++{_A}){{0,18}}|[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}{_E}|(?: [A-Z0-9]{{1,4}}{_E}){{3,8}}))))"
#: What may not follow a card or a phone: the rest of a date, of a social security number or of an address that it would end in.
_REST = (
    r"(?!-[0-9]{2}-[0-9]{2,4}(?![0-9])|/[0-9]{2}/[0-9]{4}|\.[0-9]{2}\.[0-9]{4}|(?:\.[0-9]{1,3}){3}(?![0-9])"
    r"|(?<=[0-9]{3}-[0-9]{2})-[0-9]{2,4}(?![0-9])|(?<=[0-9]{2}/[0-9]{2})/[0-9]{4}|(?<=[0-9]{2}\.[0-9]{2})\.[0-9]{4}"
    r"|(?<= [0-9]{1,3}\.[0-9]{1,3})(?:\.[0-9]{1,3}){2}(?![0-9])|(?<= [0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\.[0-9]{1,3}(?![0-9]))"
)
_DASHED = rf"(?:{BEFORE}|(?<=[0-9]-))"
#: What stands before and after a value of each kind.
BOUNDS = {
    "email": (r"(?<![0-9A-Za-z._%+-])", r"(?![A-Za-z0-9])"),
    "iban": (BEFORE, _E),
    "date": (BEFORE, _E),
    "ip": (BEFORE, r"(?![0-9A-Za-z_]|\.[0-9])"),
    "ssn": (BEFORE, r"(?![0-9A-Za-z_-])"),
    "card": (_DASHED, _E + _REST),
    "phone": (_DASHED, _E + _REST),
}


def let(value: Column, use) -> Column:
    """use(value), with the value computed once and named, so expressions don't grow with each mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keyed(message: Column, key: str) -> Column:
    """HMAC-SHA-256 of a string under the key, in hex."""
    raw = key.encode("utf-8")
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def feistel(symbols: Column, radices: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """The symbols (0 up to their radix) after the keyed rounds; the same radices give a permutation."""
    half = F.floor(F.size(symbols) / 2).cast("int")
    n = F.size(symbols)
    left = F.slice(symbols, 1, half)
    right = F.slice(symbols, half + 1, n - half)
    # A single symbol has an empty left half; its right half is then shifted by keyed constants.
    start = F.struct(left.alias("l"), right.alias("r"))

    def shifted(own: Column, other: Column, offset: Column, i: Column) -> Column:
        seed = F.concat_ws("|", F.lit(kind), i.cast("string"), n.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))

        def one(x: Column, j: Column) -> Column:
            radix = F.element_at(radices, j + offset + 1)
            f = F.conv(F.substring(keyed(F.concat_ws("|", seed, j.cast("string")), key), 1, 12), 16, 10).cast("long")
            return F.pmod(x - F.pmod(f, radix) if inverse else x + F.pmod(f, radix), radix).cast("int")

        return F.transform(own, one)

    def turn(s: Column, i: Column) -> Column:
        odd = F.pmod(i, F.lit(2)) == 1
        # l and r of the struct are replaced in turns.
        return F.struct(F.when(odd, s["l"]).otherwise(shifted(s["l"], s["r"], F.lit(0), i)).alias("l"), F.when(odd, shifted(s["r"], s["l"], half, i)).otherwise(s["r"]).alias("r"))

    order = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(F.reverse(order) if inverse else order, start, turn, lambda s: F.concat(s["l"], s["r"]))


def _code(c: Column) -> Column:
    return F.ascii(c)


def _radix(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(0)


def _base(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).otherwise(65)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _permuted_chars(s: Column, key: str, kind: str, inverse: bool) -> Column:
    """Letters and digits permuted within their classes, all else in place."""

    def moved(moving: Column) -> Column:
        symbols = F.transform(moving, lambda c: (_code(c) - _base(c)).cast("int"))
        return F.array_join(F.zip_with(moving, feistel(symbols, F.transform(moving, _radix), key, kind, inverse), lambda c, v: F.char((_base(c) + v).cast("int"))), "")

    return let(F.filter(_chars(s), lambda c: _radix(c) > 0), moved)


def _laid(template: Column, symbols: Column, skip: Column | int = 0) -> Column:
    """The characters of `symbols` in place of the letters and digits of the template, after the first `skip` ones."""


    def laid(v: Column) -> Column:
        chars = v["chars"]
        before = lambda i: F.size(F.filter(F.slice(chars, 1, i), lambda c: _radix(c) > 0)) - v["skip"]
        return F.array_join(F.transform(chars, lambda c, i: F.when((_radix(c) == 0) | (before(i) < 0), c).otherwise(F.substr(v["symbols"], before(i) + 1, F.lit(1)))), "")

    skip = skip if isinstance(skip, Column) else F.lit(skip)
    return let(F.struct(_chars(template).alias("chars"), symbols.alias("symbols"), skip.alias("skip")), laid)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _number(s: Column) -> Column:
    return s.cast("int")


def _luhn_sum(digits: Column, shift: int) -> Column:
    """Luhn's sum; the digits are doubled at even places from the right if shift is 0, odd ones if 1 (place 1 is the last)."""
    parts = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(F.pmod(i + shift, F.lit(2)) == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def luhn(digits: Column) -> Column:
    return F.pmod(_luhn_sum(digits, 0), F.lit(10)) == 0


def _card(m: Column, key: str, inverse: bool) -> Column:
    d = _digits(m)
    check = lambda body: F.pmod(10 - F.pmod(_luhn_sum(body, 1), F.lit(10)), F.lit(10)).cast("string")
    whole = let(_permuted_chars(F.substr(d, F.lit(1), F.length(d) - 1), key, "card", inverse), lambda body: F.concat(body, check(body)))
    return F.when(luhn(d) & d.rlike("[1-9]"), _laid(m, whole))


def _mod97(s: Column) -> Column:
    return F.aggregate(_chars(s), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), F.pmod(a * 10 + _code(c) - 48, F.lit(97))).otherwise(F.pmod(a * 100 + _code(c) - 55, F.lit(97))).cast("int"))


def _iban(shown: Column, key: str, inverse: bool) -> Column:
    return let(F.translate(shown, " ", ""), lambda m: F.when(F.length(m).between(15, 34), let(_iban_of(m, key, inverse), lambda v: F.when(v.isNotNull(), _laid(shown, v)))))


def _iban_of(m: Column, key: str, inverse: bool) -> Column:
    country, rest = F.substring(m, 1, 2), F.substr(m, F.lit(5))
    check = lambda body: F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    made = let(_permuted_chars(rest, key, "iban", inverse), lambda body: F.concat(country, check(body), body))
    return F.when(_mod97(F.concat(rest, F.substring(m, 1, 4))) == 1, made)


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    p = F.split(m, "-")
    a, b, c = (_number(F.get(p, i)) for i in range(3))
    ok = a.between(1, 899) & (a != 666) & (b > 0) & (c > 0)
    moved = feistel(F.array(F.when(a > 666, a - 2).otherwise(a - 1), b - 1, c - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn", inverse)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    area = lambda v: F.when(v[0] >= 665, v[0] + 2).otherwise(v[0] + 1)
    return F.when(ok, let(moved, lambda v: F.concat_ws("-", pad(area(v), 3), pad(v[1] + 1, 2), pad(v[2] + 1, 4))))


def _date(m: Column, key: str, inverse: bool) -> Column:
    iso = m.contains("-")
    sep = F.substring(m, 3, 1)
    p = F.split(m, r"[-./]")
    as_date = lambda y, mo, d: F.concat_ws("-", y, mo, d).try_cast("date")
    dmy, mdy = as_date(F.get(p, 2), F.get(p, 1), F.get(p, 0)), as_date(F.get(p, 2), F.get(p, 0), F.get(p, 1))
    day_first = F.when(sep == ".", F.lit(True)).otherwise(mdy.isNull())
    day = F.when(iso, as_date(F.get(p, 0), F.get(p, 1), F.get(p, 2))).when(day_first, dmy).otherwise(mdy)
    earliest, first = (F.lit(x).cast("date") for x in ("1000-01-01", "1904-01-01"))

    def shown(x: Column) -> Column:
        part = lambda p: F.date_format(x["new"], p)
        joined = lambda *p: F.concat(part(p[0]), sep, part(p[1]), sep, part(p[2]))
        return F.when(iso, part("yyyy-MM-dd")).when(x["day_first"], joined("dd", "MM", "yyyy")).otherwise(joined("MM", "dd", "yyyy"))

    def moved(n: Column, radix: int, other: int, kind: str) -> Column:
        symbols = F.array(F.floor(n / other).cast("int"), F.pmod(n, F.lit(other)))
        return let(feistel(symbols, F.array(F.lit(radix), F.lit(other)), key, kind, inverse), lambda v: v[0] * other + v[1])

    def made(x: Column) -> Column:
        # 1904 to 2099 has 49 spans of 1461 days, 147 x 487 in all; 1000 to 2999 has 730485, so the others are 848 x 777.
        usual, before = 147 * 487, F.datediff(first, earliest)
        near = F.date_add(first, moved(x["n"], 147, 487, "date"))
        rest = F.when(x["n"] < 0, x["n"] + before).otherwise(x["n"] + before - usual)
        far = let(moved(rest, 848, 777, "far date"), lambda v: F.date_add(earliest, F.when(v < before, v).otherwise(v + usual)))
        new = F.when(x["n"].between(0, usual - 1), near).otherwise(far)
        return F.when(x["n"].isNotNull(), let(F.struct(new.alias("new"), x["day_first"].alias("day_first")), shown))

    return let(F.struct(F.datediff(day, first).alias("n"), day_first.alias("day_first")), made)


def _ip(m: Column, key: str, inverse: bool) -> Column:
    octets = F.transform(F.split(m, r"\."), _number)
    ok = F.forall(octets, lambda x: x <= 255)
    padded = m.rlike(r"(^|\.)0[0-9]")
    shown = F.transform(feistel(octets, F.array_repeat(F.lit(256), 4), key, "ip", inverse), lambda x: F.when(padded, F.lpad(x.cast("string"), 3, "0")).otherwise(x.cast("string")))
    return F.when(ok, F.array_join(shown, "."))


def _american(m: Column) -> Column:
    d = _digits(m)
    return F.when(m.startswith("+"), d.rlike("^1[2-9][0-9]{2}[2-9][0-9]{6}$")).otherwise(d.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$") & m.rlike("[^0-9]"))


def _phone(m: Column, key: str, inverse: bool) -> Column:
    d = _digits(m)
    plus = m.startswith("+")
    national = F.substr(d, F.length(d) - 9)
    american = _american(m)
    limits = (8, 10, 10, 8, 10, 10, 10, 10, 10, 10)
    radices = F.array(*map(F.lit, limits))
    low = F.array(*(F.lit(10 - x) for x in limits))
    symbols = F.zip_with(F.transform(_chars(national), _number), low, lambda x, b: x - b)
    moved = F.array_join(F.zip_with(feistel(symbols, radices, key, "phone", inverse), low, lambda x, b: (x + b).cast("string")), "")
    other = _permuted_chars(F.substr(d, F.lit(4)), key, "phone", inverse)
    return F.when(american, _laid(m, moved, F.length(d) - 10)).when(plus & F.length(d).between(8, 15), _laid(m, other, 3))


def _email(m: Column, key: str, inverse: bool) -> Column:
    p = F.split(m, "@")
    return F.concat(_laid(p[0], _permuted_chars(p[0], key, "email", inverse)), F.lit("@"), p[1])


_MAKERS = {"card": _card, "iban": _iban, "ssn": _ssn, "date": _date, "ip": _ip, "phone": _phone, "email": _email}


def pseudonym(match: Column, key: str, kinds: tuple[str, ...] = KINDS, inverse: bool = False) -> Column:
    """(kind, value) of a string found by the kinds' patterns; kind is null if it fails validation."""
    nothing = F.struct(F.lit(None).cast("string").alias("kind"), match.alias("value"))
    out = nothing
    for k in reversed([k for k in PATTERNS if k in kinds]):
        # A string that has the form of several kinds is the first whose validation it passes.
        own = F.when(match.rlike(f"^(?:{PATTERNS[k]})$"), F.struct(F.lit(k).alias("kind"), _MAKERS[k](match, key, inverse).alias("value")))
        out = F.coalesce(let(own, lambda v: F.when(v["value"].isNotNull(), v)), out)
    return out


def _starts(run: Column) -> Column:
    """The run's parts from its start to the end of each of its numbers."""
    return let(F.regexp_extract_all(run, F.lit("[^0-9A-Z]*[0-9A-Z]+"), F.lit(0)), lambda p: F.transform(p, lambda x, i: F.array_join(F.slice(p, F.lit(1), i + 1), "")))


def values(text: Column, key: str, kinds: tuple[str, ...], inverse: bool) -> Column:
    """The distinct values in a text, wherever they start and end, as (rank, less, match, kind, value) in the order in which they are tried at one start."""
    rest = [PATTERNS[k] for k in PATTERNS if k in kinds and k != "email"]
    some = []
    if rest:
        whole = "^(?:" + "|".join(f"(?:{p})" for p in rest) + ")$"
        runs = F.array_distinct(F.regexp_extract_all(text, F.lit(RUNS), F.lit(1)))
        some.append(F.filter(F.flatten(F.transform(runs, _starts)), lambda m: m.rlike(whole)))
    if "email" in kinds:
        some.append(F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0)))
    order = list(PATTERNS)

    def ranked(m: Column) -> Column:
        def one(v: Column) -> Column:
            n = F.length(_digits(m))
            usual = F.when(v["kind"] == "card", F.when(n == 16, 0).when(n == 15, 1).otherwise(2)).when(v["kind"] == "phone", F.when(_american(m), 0).otherwise(1)).otherwise(0)
            kind = F.coalesce(*(F.when(v["kind"] == k, F.lit(10 * i)) for i, k in enumerate(order)))
            return F.struct((kind + usual).alias("rank"), (-F.length(m)).alias("less"), m.alias("match"), v["kind"].alias("kind"), v["value"].alias("value"))

        return let(pseudonym(m, key, kinds, inverse), one)

    loose = 10 * order.index("card") + 2
    held = lambda v, all_: F.exists(all_, lambda w: w["rank"].between(10, loose - 1) & v["match"].contains(w["match"]))
    known = F.filter(F.transform(F.array_distinct(F.concat(*some)), ranked), lambda v: v["kind"].isNotNull())
    return let(known, lambda all_: F.sort_array(F.filter(all_, lambda v: (v["rank"] < loose) | ~held(v, all_))))


def _quoted(v: Column) -> Column:
    """The pattern of a value with what may stand around it."""
    side = lambda i: F.coalesce(*(F.when(v["kind"] == k, F.lit(b[i])) for k, b in BOUNDS.items()))
    return F.concat(side(0), F.lit("\\Q"), v["match"], F.lit("\\E"), side(1))


def pseudonymised(docs: DataFrame, key: str, kinds: tuple[str, ...] = KINDS, inverse: bool = False) -> DataFrame:
    """docs with text rewritten, and a last column `pii` (or `pii_` and so on): an array of (kind, value), value being the pseudonym."""
    name = "pii"
    while name in docs.columns:
        name += "_"
    known = docs.withColumn("__pii_known", F.when(F.col("text").rlike("[0-9]|@"), values(F.col("text"), key, kinds, inverse)))
    found = known.withColumn("__pii_at", F.when(F.size("__pii_known") > 0, F.array_join(F.transform("__pii_known", _quoted), "|")))
    found = found.withColumn("__pii_match", F.regexp_extract_all("text", F.col("__pii_at"), F.lit(0)))
    of = lambda m: let(F.filter("__pii_known", lambda v: v["match"] == m), lambda v: F.struct(v[0]["kind"].alias("kind"), v[0]["value"].alias("value")))
    made = found.withColumn("__pii", F.transform("__pii_match", of))
    gaps = F.split(F.col("text"), F.col("__pii_at"), -1)
    joined = F.array_join(F.zip_with(gaps, F.col("__pii"), lambda g, v: F.concat(g, F.coalesce(v["value"], F.lit("")))), "")
    text = F.when(F.size("__pii_match") > 0, joined).otherwise(F.col("text"))
    none = F.expr("cast(array() as array<struct<kind:string,value:string>>)")
    return made.withColumn("text", text).withColumn(name, F.coalesce("__pii", none)).drop("__pii", "__pii_known", "__pii_at", "__pii_match")


def report(docs: DataFrame, key: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """doc_id, n_<kind> of each kind, n_pii, pseudonyms (as found, separated by |), text of every row of docs (doc_id, text)."""
    out = pseudonymised(docs.select("doc_id", "text"), key, kinds)
    count = lambda k: F.size(F.filter("pii", lambda v: v["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return out.select("doc_id", *counts, F.size("pii").cast("long").alias("n_pii"), F.array_join(F.transform("pii", lambda v: v["value"]), "|").alias("pseudonyms"), "text")
