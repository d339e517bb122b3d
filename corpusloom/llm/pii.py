"""Format-preserving pseudonyms for personal data (operator 1), in DataFrame expressions only.

Validated values are permuted under a key by alternating Feistel rounds within their own
format: a card number stays a Luhn-valid number of its length and grouping, a date stays a
date of the calendar in its notation, an address of four octets stays one. The permutation
depends on the key and the value alone, so equal values stay linked across documents and
different values of a kind stay different; nothing is joined, shuffled or remembered.

Kinds and their domains:
  email   local part: its letters and digits in base 36, ten at a time; lower case; domain kept
  phone   North America, with +1 or without: area and exchange codes from 200 to 999; elsewhere, with +: all digits after
          the country's calling code
  ip      four octets, the whole of 2**32
  card    13 to 19 digits that pass Luhn's check; check digit made anew
  ssn     areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999
  date    1900-01-01 to 2099-12-31 as y-m-d, d.m.y, d/m/y, or m/d/y where the second number can't be a month (kept so)

What fails its validation stays as it is; addresses of eight groups, dates with names of months and bare national
numbers of other countries are no kind. Null texts stay null with counts of zero.

Rounds mix by HMAC-SHA256. The key's two pads reach the rows by scalar subqueries over a local table, so that no plan,
event log or page of the UI shows them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.base import quoted, without

KINDS = ("email", "phone", "ip", "card", "ssn", "date")
ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+"
IP = rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
DATE = r"(?<![0-9A-Za-z./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|(?:[0-9]{2}\.[0-9]{2}\.|[0-9]{2}/[0-9]{2}/)(?:19|20)[0-9]{2})(?![0-9A-Za-z]|[./-][0-9])"
#: A value ends before a number that follows it: an unbroken run of digits is tried before groups, +1 in its own shape before others.
_END = r"(?![0-9A-Za-z]|\.[0-9])"
CARD = rf"(?<![0-9A-Za-z])(?:[0-9]{{13,19}}{_END}|[0-9](?:[ -]?[0-9]){{12,18}}{_END})"
PHONE = rf"(?<![0-9A-Za-z+])\+(?:1[ .-]?(?:\([2-9][0-9]{{2}}\)|[2-9][0-9]{{2}})[ .-]?[2-9][0-9]{{2}}[ .-]?[0-9]{{4}}{_END}|[1-9][0-9]{{0,2}}[ .-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})(?:[ .-]?[0-9]{{2,4}}){{2,4}}{_END})"
_NA = r"(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}"
#: A number of North America without +1 needs its separators.
PHONE_NA = rf"(?<![0-9A-Za-z+(.-]){_NA}(?![0-9A-Za-z]|[.-][0-9])"
ANY = "|".join((EMAIL, PHONE, PHONE_NA, IP, SSN, DATE, CARD))
#: Fixed: the calling codes of one and two digits (E.164); all others have three, and no code begins another.
CALLING = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
DAYS = 73_049  # 1900-01-01 to 2099-12-31
_DATE_SIDES = (271, 270)  # their product is the least of its kind over DAYS


@dataclass(frozen=True)
class Key:
    """HMAC-SHA256 as expressions: the padded keys are binary columns."""

    inner: Column
    outer: Column

    def digest(self, message: Column) -> Column:
        return F.sha2(F.concat(self.outer, F.unhex(F.sha2(F.concat(self.inner, message.cast("binary")), 256))), 256)


def pads(secret: str) -> tuple[bytes, bytes]:
    """HMAC's inner and outer key blocks."""
    own = secret.encode("utf-8")
    own = (hashlib.sha256(own).digest() if len(own) > 64 else own).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in own), bytes(b ^ 0x5C for b in own)


def keyed(df: DataFrame, secret: str) -> tuple[DataFrame, Key]:
    """``df`` with the key's pads in two further columns."""
    inner, outer = pads(secret)
    table = df.sparkSession.sql("SELECT i, o FROM VALUES (:i, :o) AS t(i, o)", args={"i": inner, "o": outer})
    return df.select("*", table.select("i").scalar().alias("__inner"), table.select("o").scalar().alias("__outer")), Key(F.col("__inner"), F.col("__outer"))


def _mix(key: Key, tweak: Column, turn: Column, value: Column, mod: Column | int) -> Column:
    digest = key.digest(F.concat_ws("|", tweak, turn.cast("string"), value.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(mod) if isinstance(mod, int) else mod)


def feistel(x: Column, left: Column | int, right: Column | int, key: Key, tweak: Column) -> Column:
    """A keyed permutation of 0 to left * right - 1: rounds add a digest of one side to the other."""
    left, right = (F.lit(s).cast("bigint") if isinstance(s, int) else s for s in (left, right))
    start = F.struct(F.call_function("div", x, right).alias("l"), F.pmod(x, right).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        new_l = F.pmod(s["l"] + _mix(key, tweak, i, s["r"], left), left)
        new_r = F.pmod(s["r"] + _mix(key, tweak, i, s["l"], right), right)
        return F.when(i % 2 == 1, F.struct(new_l.alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), new_r.alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * right + s["r"])


def _only(x: Column, pattern: str) -> Column:
    return F.regexp_replace(x, pattern, "")


def _digits(x: Column) -> Column:
    return _only(x, "[^0-9]")


def _power(base: int, n: Column) -> Column:
    """base ** n as a long, for the few n that occur."""
    return F.element_at(F.array(*[F.lit(base**i).cast("bigint") for i in range(10)]), n.cast("int") + 1)


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _fill(template: Column, chars: Column, slot: str) -> Column:
    """``template`` with its characters of class ``slot`` replaced, in turn, by those of ``chars``."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"), chars.alias("c"))

    def put(a: Column, c: Column) -> Column:
        new = F.when(c.rlike(slot), F.struct(F.substr(a["c"], a["i"], F.lit(1)).alias("s"), F.lit(1).alias("i"))).otherwise(F.struct(c.alias("s"), F.lit(0).alias("i")))
        return _let(new, lambda n: F.struct(F.concat(a["s"], n["s"]).alias("s"), (a["i"] + n["i"]).alias("i"), a["c"].alias("c")))

    return F.aggregate(F.split(template, "(?!^)"), start, put, lambda a: a["s"])


def _permute_digits(digits: Column, key: Key, tweak: Column) -> Column:
    """Of 1 to 18 digits, as many."""
    n = F.length(digits)
    low = F.floor(n / 2)
    return F.lpad(feistel(digits.cast("bigint"), _power(10, n - low), _power(10, low), key, tweak).cast("string"), n, F.lit("0"))


def _email(x: Column, key: Key) -> Column:
    local = F.lower(F.substring_index(x, "@", 1))
    alnum = _only(local, "[^a-z0-9]")
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.call_function("div", F.length(alnum) - 1, F.lit(10)), F.lit(0)).cast("int")),
        lambda i: F.substr(alnum, i * 10 + 1, F.lit(10)),
    )

    def one(p: Column, i: Column) -> Column:
        n = F.length(p)
        low = F.floor(n / 2)
        before = F.substr(alnum, F.lit(1), i * 10)
        y = feistel(F.conv(p, 36, 10).cast("bigint"), _power(36, n - low), _power(36, low), key, F.concat(F.lit("email"), before))
        return F.when(n == 0, p).otherwise(F.lpad(F.lower(F.conv(y.cast("string"), 10, 36)), n, F.lit("0")))

    return F.concat(_fill(local, F.array_join(F.transform(parts, one), ""), "[a-z0-9]"), F.lit("@"), F.substring_index(x, "@", -1))


def _country(x: Column) -> Column:
    """Digits of the calling code: none without +."""
    return F.when(x.startswith("+"), F.length(F.regexp_extract(_digits(x), CALLING, 0))).otherwise(F.lit(0))


def _phone(x: Column, key: Key) -> Column:
    d, n = _digits(x), _country(x)
    own = F.substr(d, n + 1, F.lit(20))
    code = F.substr(d, F.lit(1), n)
    number = own.cast("bigint")
    area, exchange, line = F.call_function("div", number, F.lit(10_000_000)), F.pmod(F.call_function("div", number, F.lit(10_000)), F.lit(1000)), F.pmod(number, F.lit(10_000))
    y = feistel((area - 200) * 8_000_000 + (exchange - 200) * 10_000 + line, 800, 8_000_000, key, F.lit("phone1"))
    valid = (code.isin("", "1")) & (F.length(own) == 10) & (area >= 200) & (exchange >= 200)
    parts = _let(y, lambda v: F.concat((F.call_function("div", v, F.lit(8_000_000)) + 200).cast("string"), (F.pmod(v, F.lit(8_000_000)) + 2_000_000).cast("string")))
    new = F.when(valid, parts).otherwise(_permute_digits(own, key, F.concat(F.lit("phone"), code)))
    return _fill(x, F.concat(code, new), "[0-9]")


def _ip(x: Column, key: Key) -> Column:
    number = F.aggregate(F.split(x, r"\."), F.lit(0).cast("bigint"), lambda a, o: a * 256 + o.cast("bigint"))
    y = feistel(number, 65_536, 65_536, key, F.lit("ip"))
    return _let(y, lambda v: F.concat_ws(".", *[F.pmod(F.call_function("div", v, F.lit(1 << s)), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))


def _card(x: Column, key: Key) -> Column:
    d = _digits(x)
    body = _permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, F.lit("card"))
    checks = _let(body, lambda own: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(own, c.cast("string"))))
    return _fill(x, F.element_at(F.filter(checks, lambda s: F.call_function("luhn_check", s)), 1), "[0-9]")


def _ssn(x: Column, key: Key) -> Column:
    d = _digits(x)
    area, group, serial = (F.substring(d, a, n).cast("bigint") for a, n in ((1, 3), (4, 2), (6, 4)))
    number = (area - 1 - (area > 666).cast("bigint")) * (99 * 9999) + (group - 1) * 9999 + serial - 1
    y = feistel(number, 898, 99 * 9999, key, F.lit("ssn"))

    def parts(v: Column) -> Column:
        area = F.call_function("div", v, F.lit(99 * 9999)) + 1
        group = F.pmod(F.call_function("div", v, F.lit(9999)), F.lit(99)) + 1
        area = area + (area >= 666).cast("bigint")
        return F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in ((area, 3), (group, 2), (F.pmod(v, F.lit(9999)) + 1, 4))])

    return _let(y, parts)


def _month_first(x: Column) -> Column:
    """Whether the second number between slashes can only be a day."""
    return (x.substr(3, 1) == "/") & (x.substr(4, 2).cast("int") > 12)


def _date_iso(x: Column) -> Column:
    day, month = x.substr(1, 2), x.substr(4, 2)
    own = F.when(x.substr(5, 1) == "-", x).when(_month_first(x), F.concat_ws("-", x.substr(7, 4), day, month)).otherwise(F.concat_ws("-", x.substr(7, 4), month, day))
    return F.try_to_date(own, "yyyy-MM-dd")


def _date(x: Column, key: Key) -> Column:
    first = F.lit("1900-01-01").cast("date")
    day = F.datediff(_date_iso(x), first).cast("bigint")
    month_first = _month_first(x)
    kind = F.when(month_first, "date m").otherwise("date")

    def whole(a: Column) -> Column:
        """A day of the calendar, and one that keeps the order of day and month told."""
        return (a < DAYS) & (~month_first | (F.day(F.date_add(first, a.cast("int"))) > 12))

    # Walk the cycle until the value is such a day again: a step leaves the calendar once in 600, the months' later days twice in five.
    y = F.aggregate(F.sequence(F.lit(1), F.lit(80)), feistel(day, *_DATE_SIDES, key, kind), lambda a, _: F.when(whole(a), a).otherwise(feistel(a, *_DATE_SIDES, key, kind)))
    sep = x.substr(3, 1)

    def shown(new: Column) -> Column:
        d, m, y = (F.date_format(new, f) for f in ("dd", "MM", "yyyy"))
        return F.when(x.substr(5, 1) == "-", F.concat_ws("-", y, m, d)).when(month_first, F.concat_ws("/", m, d, y)).otherwise(F.concat_ws("", d, sep, m, sep, y))

    return _let(F.date_add(first, y.cast("int")), shown)


def _kind(x: Column) -> Column:
    """The kind of a match, null where its validation fails."""
    d = _digits(x)
    ssn = x.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    date = x.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$")
    phone = (F.length(d) - _country(x)).between(6, 18)
    return (
        F.when(x.contains("@"), F.when(x.rlike("^[^@]*[A-Za-z0-9]"), F.lit("email")))
        .when(x.startswith("+") | x.rlike(f"^{_NA}$"), F.when(phone, F.lit("phone")))
        .when(x.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), F.lit("ip"))
        .when(ssn, F.when(x.rlike("^(?!000|666|9)...-(?!00)..-(?!0000)"), F.lit("ssn")))
        .when(date, F.when(_date_iso(x).isNotNull(), F.lit("date")))
        .when(F.call_function("luhn_check", d) & (F.length(d) >= 13), F.lit("card"))
    )


def _pseudonym(kind: Column, x: Column, key: Key) -> Column:
    made = {"email": _email, "phone": _phone, "ip": _ip, "card": _card, "ssn": _ssn, "date": _date}
    out = F.when(kind == "email", _email(x, key))
    for name in KINDS[1:]:
        out = out.when(kind == name, made[name](x, key))
    return out.otherwise(x)


def _count(kind: str) -> Column:
    of_kind = F.filter("__hits", lambda h: h["kind"] == kind)
    return F.when(F.col("__hits").isNull(), F.lit(0)).otherwise(F.size(of_kind)).cast("bigint")


def pseudonymize(df: DataFrame, key: str, text: str = "text", counts: bool = True) -> DataFrame:
    """``df`` with validated values in ``text`` pseudonymised; ``counts`` adds ``n_<kind>`` (long) for each kind.

    Narrow: one pass, no shuffle, no Python. Columns of ``df`` called like the counts are replaced.
    """
    added = [f"n_{k}" for k in KINDS] if counts else []
    kept = without(df, added)
    names = {c: f"__c_{i}" for i, c in enumerate(kept)}  # a column may be called like one of ours
    own, secret = keyed(df.select(*[quoted(c).alias(n) for c, n in names.items()]), key)
    at = next(n for c, n in names.items() if c.lower() == text.lower())
    source = F.col(at)
    hits = F.when(source.rlike("[0-9@]"), F.regexp_extract_all(source, F.lit(ANY), F.lit(0)))
    found = own.withColumn("__hits", F.transform(hits, lambda m: F.struct(_kind(m).alias("kind"), m.alias("value"))))
    new = F.transform("__hits", lambda h: _pseudonym(h["kind"], h["value"], secret))
    joined = F.array_join(F.zip_with(F.split(source, ANY, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    clean = F.when(F.exists("__hits", lambda h: h["kind"].isNotNull()), joined).otherwise(source)
    numbers = [_count(k) for k in KINDS] if counts else []
    return found.select(*[(clean if n == at else F.col(n)).alias(c) for c, n in names.items()], *[n.alias(a) for n, a in zip(numbers, added)])
