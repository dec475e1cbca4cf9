"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values found in a text - cards (Luhn), IBANs (mod 97), dates, IP addresses, UUIDs, phone numbers, social security numbers,
e-mail addresses and secrets - are replaced by others of the same format: a keyed Feistel network permutes the values of
a format, so equal values get equal pseudonyms in all documents, and different ones different; with the key and a
pseudonym's kind original() undoes it. A card or IBAN is linked whether or not spaces or dashes stand between its parts, an
IPv6 address whether groups of zeros are left out or not, in either case (undone in lower case if its pseudonym has no letter).

The network's symbols are a value's digits and letters, each of its own radix; other characters stay. In each round the
symbols at even (then odd) places are shifted by a keyed hash of those at the others. A card's last digit and an IBAN's
check digits are computed anew, so pseudonyms pass the same checks. A date is permuted as year and day of the year,
within 1900-2099 or outside it; 29 February stays one, in another leap year. An e-mail address keeps its top-level
domain and a phone number its country code. A group of an IPv6 address keeps its number of digits without leading zeros,
so zeros stay and it can be written as it was.

Null texts stay null and hold nothing. Numbers that fail their check aren't touched. Repeated rows are changed alike.
An empty table gives no rows. Extra columns are kept by pseudonymized(), whatever their names, but one named n_pii: the
number of values replaced takes its place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import IPV6
from .common import docs_table
from .mixing import let

ROUNDS = 8
#: The query's key; pseudonymized() has none of its own.
DEMONSTRATION_KEY = "veilframe-demonstration-key"
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# The formats. Each begins where no longer value of its kind can and so is tried once a word; repeats
# without a bound are possessive, so that the matcher neither goes back nor recurses over a long text.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
SECRET = r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[opusr]_[A-Za-z0-9]{20,}+|sk-(?:live|test)-[A-Za-z0-9]{16,}+|xox[abps]-[A-Za-z0-9-]{10,}+|(?<=token = \")[A-Za-z0-9]{16,}+|(?<=password=)[A-Za-z0-9]{8,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+|(?<=Bearer\s{1,8})[A-Za-z0-9._~+/=-]{16,}+|(?<=(?i:api[_-]?key)\s{0,8}[:=]\s{0,8}['\"]?)[A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9_-])"
IBAN = _L + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _R
UUID = _L + r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}" + _R
PHONE = r"(?<![A-Za-z0-9_+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\([0-9]{3}\) ?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[\s.-][0-9]{3}[\s.-][0-9]{4}|\+[0-9][0-9\s().-]{6,18}[0-9]|(?:91|0)?[6-9][0-9]{9})" + _R
SSN = _L + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _R
DATE = _L + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?![A-Za-z0-9_])|(?=T[0-9]))|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![A-Za-z0-9_])|(?<![0-9][/-])[0-9]{1,2}[/-][0-9]{1,2}[/-](?:[0-9]{4}|[0-9]{2})(?![A-Za-z0-9_]|[/-][0-9]))"
IPV4 = r"(?<![A-Za-z0-9_.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9_]|\.[0-9])"
IP6 = r"(?<![A-Za-z0-9_:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)(?!::(?![0-9A-Fa-f]))" + IPV6[1:-1] + r"(?![A-Za-z0-9_]|:[0-9A-Fa-f:]|\.[0-9])"
CARD = _L + r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _R
KINDS = {"email": EMAIL, "secret": SECRET, "uuid": UUID, "iban": IBAN, "ssn": SSN, "date": DATE, "ip6": IP6, "ip": IPV4, "phone": PHONE, "card": CARD}
ANY = "|".join(KINDS.values())
#: What every value holds; texts without it aren't searched further.
GATE = r"[0-9]{2}|:[0-9A-Fa-f]{0,4}:|[0-9A-Fa-f]{8}-|[0-9]\.[0-9]{1,3}\.[0-9]|\+[0-9]|eyJ|Bearer|(?i:api[_-]?key)|@|gh[opusr]_|xox[abps]-|sk-|AKIA|token = \"|password="


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def prf(key: str, kind: str, *parts: Column) -> Column:
    """A keyed number below 2**48."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts]), 256), 1, 12), 16, 10).cast("long")


def feistel(symbols: Column, key: str, kind: str, back: bool = False) -> Column:
    """symbols, an array of struct<base, radix, value>, permuted by rounds of keyed shifts; back: what they were."""

    def turn(acc: Column, k: Column) -> Column:
        # hashed once, so that a long value costs no more a symbol than a short one
        others = F.sha2(F.concat_ws(",", F.transform(F.filter(acc, lambda x, i: i % 2 != k % 2), lambda x: x["value"].cast("string"))), 256)

        def shift(seen: Column) -> Callable:
            return lambda x, i: F.struct(x["base"].alias("base"), x["radix"].alias("radix"), F.when(i % 2 == k % 2, F.pmod(x["value"] + (-1 if back else 1) * prf(key, kind, k, i, seen), x["radix"]).cast("int")).otherwise(x["value"]).alias("value"))

        return let(others, lambda seen: F.transform(acc, shift(seen)))

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(F.reverse(rounds) if back else rounds, symbols, turn)


def permuted(s: Column, key: str, kind: str, back: bool = False) -> Column:
    """A string with its digits and letters permuted within their places' alphabets."""

    def symbol(c: Column) -> Column:
        a = F.ascii(c)
        base = F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65).otherwise(a)
        radix = F.when(c.between("0", "9"), 10).when(c.between("a", "z") | c.between("A", "Z"), 26).otherwise(1)
        return F.struct(base.cast("int").alias("base"), radix.cast("int").alias("radix"), (a - base).cast("int").alias("value"))

    return F.array_join(F.transform(feistel(F.transform(chars(s), symbol), key, kind, back), lambda x: F.char(x["base"] + x["value"])), "")


def apart(s: Column, change: Callable[[Column], Column]) -> Column:
    """What change makes of a value without its spaces and dashes, with these put back; so a value is linked across the ways it is written."""

    def put_back(new: Column) -> Column:
        nth = lambda i: F.length(F.regexp_replace(F.substring(s, F.lit(1), i + 1), "[ -]", F.lit("")))
        return F.array_join(F.transform(chars(s), lambda c, i: F.when(c.isin(" ", "-"), c).otherwise(F.substring(new, nth(i), F.lit(1)))), "")

    return let(F.regexp_replace(s, "[ -]", F.lit("")), lambda bare: let(change(bare), put_back))


def uuid(s: Column, key: str, back: bool = False) -> Column:
    """Hex digits, each of radix 16; upper case where the value has an upper-case letter."""
    digit = lambda c: F.struct(F.lit(0).alias("base"), F.lit(16).alias("radix"), F.conv(c, 16, 10).cast("int").alias("value"))
    new = lambda bare: F.array_join(F.transform(feistel(F.transform(chars(bare), digit), key, "uuid", back), lambda x: F.conv(x["value"].cast("string"), 10, 16)), "")
    return let(apart(s, new), lambda v: F.when(s.rlike("[A-F]"), v).otherwise(F.lower(v)))


def mod97(s: Column) -> Column:
    """An IBAN's remainder: letters count as 10 to 35."""
    step = lambda r, c: F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars(s), F.lit(0), lambda r, c: step(r, c).cast("int"))


def luhn(s: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(s, "[^0-9]", F.lit("")))


def card(s: Column, key: str, back: bool = False) -> Column:
    """Digits but the last permuted, whatever stands between them; the last makes the check right."""

    def new(bare: Column) -> Column:
        body = permuted(F.substring(bare, F.lit(1), F.length(bare) - 1), key, "card", back)
        return let(body, lambda b: F.concat(b, F.filter(F.array(*[F.lit(str(i)) for i in range(10)]), lambda c: luhn(F.concat(b, c)))[0]))

    return apart(s, new)


def iban(s: Column, key: str, back: bool = False) -> Column:
    """What follows country and check digits permuted, printed in groups or not; the check digits made right."""

    def new(bare: Column) -> Column:
        country = F.substring(bare, 1, 2)
        body = permuted(F.substring(bare, F.lit(5), F.length(bare)), key, "iban", back)
        return let(body, lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))

    return apart(s, new)


def ip(s: Column, key: str, back: bool = False) -> Column:
    octets = F.transform(F.split(s, "\\."), lambda x: F.struct(F.lit(0).alias("base"), F.lit(256).alias("radix"), x.cast("int").alias("value")))
    return F.array_join(F.transform(feistel(octets, key, "ip", back), lambda x: x["value"].cast("string")), ".")


def ip6(s: Column, key: str, back: bool = False) -> Column:
    """The eight groups permuted, each among those of as many digits, and written in the places that s writes, octets where s has them."""
    dotted = s.contains(".")
    octets = F.transform(F.split(F.element_at(F.split(s, ":"), -1), "\\."), lambda x: x.try_cast("int"))
    two = lambda i: F.lower(F.hex(F.get(octets, F.lit(i)) * 256 + F.get(octets, F.lit(i + 1))))
    plain = F.when(dotted, F.concat(F.regexp_extract(s, "^(.*:)", 1), two(0), F.lit(":"), two(2))).otherwise(s)

    def symbol(group: Column) -> Column:
        v = F.conv(group, 16, 10).cast("int")
        low = F.when(v == 0, 0).when(v < 16, 1).when(v < 256, 16).when(v < 4096, 256).otherwise(4096)
        return F.struct(low.cast("int").alias("base"), F.greatest(15 * low, F.lit(1)).cast("int").alias("radix"), (v - low).cast("int").alias("value"))

    def whole(sides: Column) -> Column:
        left, right = sides[0], F.coalesce(F.get(sides, F.lit(1)), F.expr("cast(array() as array<string>)"))
        groups = F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)

        def write(new: Column) -> Column:
            text = lambda x, width: F.lpad(F.conv((x["base"] + x["value"]).cast("string"), 10, 16), width, "0")
            side = lambda of, first: F.array_join(F.transform(of, lambda g, i: text(F.get(new, first + i), F.length(g))), ":")
            return F.concat(side(left, F.lit(0)), F.when(F.size(sides) == 2, F.concat(F.lit("::"), side(right, 8 - F.size(right)))).otherwise(""))

        return let(feistel(F.transform(groups, symbol), key, "ip6", back), write)

    def with_octets(new: Column) -> Column:
        number = lambda i: F.conv(F.element_at(F.split(new, ":"), i), 16, 10).cast("int")
        quad = F.concat_ws(".", *[part.cast("string") for i in (-2, -1) for part in (F.shiftright(number(i), 8), number(i) % 256)])
        shown = F.when(s.rlike("[A-F]"), new).otherwise(F.lower(new))
        return F.when(dotted, F.concat(F.regexp_extract(shown, "^(.*:)[^:]+:[^:]+$", 1), quad)).otherwise(shown)

    sides = F.transform(F.split(plain, "::"), lambda half: F.filter(F.split(half, ":"), lambda g: g != ""))
    return let(let(sides, whole), with_octets)


def email(s: Column, key: str, back: bool = False) -> Column:
    parts = r"^(.*)(\.[^.]*)$"
    return F.concat(permuted(F.regexp_extract(s, parts, 1), key, "email", back), F.regexp_extract(s, parts, 2))


def phone(s: Column, key: str, back: bool = False) -> Column:
    head = r"(?s)^(\+[0-9]{1,3}(?=[ .(-])|\+[0-9])?(.*)$"
    return F.concat(F.regexp_extract(s, head, 1), permuted(F.regexp_extract(s, head, 2), key, "phone", back))


def original(s: Column, kind: str, key: str) -> Column:
    """The value that a pseudonym of that kind stands for. Dates, whose day and month can't be told apart in all forms, aren't undone."""
    undo = {"email": email, "ip": ip, "ip6": ip6, "card": card, "iban": iban, "phone": phone, "uuid": uuid}
    return undo[kind](s, key, True) if kind in undo else permuted(s, key, kind, True)


def ymd(s: Column) -> Column:
    """Year, month and day of a date's text; month first where the year is last, unless only day first fits. A year of two digits is of 2000-2099."""
    p = F.transform(F.split(s, "[-/]"), lambda x: x.cast("int"))
    iso = s.rlike("^[0-9]{4}-")
    short = ~iso & s.rlike("[/-][0-9]{2}$")
    swap = ~iso & (p[0] > 12)
    y, m, d = F.when(iso, p[0]).when(short, p[2] + 2000).otherwise(p[2]), F.when(iso, p[1]).when(swap, p[1]).otherwise(p[0]), F.when(iso, p[2]).when(swap, p[0]).otherwise(p[1])
    return F.struct(y.alias("y"), m.alias("m"), d.alias("d"), iso.alias("iso"), swap.alias("swap"), short.alias("short"), F.regexp_extract(s, "^[0-9]+([/-])", 1).alias("a"), F.regexp_extract(s, "([/-])[0-9]+$", 1).alias("b"))


def is_date(s: Column) -> Column:
    return let(ymd(s), lambda x: F.coalesce(F.try_make_timestamp(F.greatest(x["y"], F.lit(1)), x["m"], x["d"], F.lit(0), F.lit(0), F.lit(0)).isNotNull(), F.lit(False)))


def date(s: Column, key: str) -> Column:
    leap_day = lambda x: (x["m"] == 2) & (x["d"] == 29)

    def index(x: Column) -> Column:
        near = x["y"].between(1900, 2099)
        year = F.when(x["short"], x["y"] - 2000).when(near, x["y"] - 1900).when(x["y"] < 1900, x["y"]).otherwise(x["y"] - 200)
        # day of a year without 29 February
        day = F.dayofyear(F.make_date(F.lit(2001), x["m"], F.when(leap_day(x), 28).otherwise(x["d"]))) - 1
        return F.array(
            F.struct(F.lit(0).alias("base"), F.when(x["short"], 100).when(near, 200).otherwise(9800).cast("int").alias("radix"), year.cast("int").alias("value")),
            F.struct(F.lit(0).alias("base"), F.lit(365).alias("radix"), day.cast("int").alias("value")),
        )

    def text(x: Column, y: Column, m: Column, d: Column) -> Column:
        two, four = (lambda v: F.lpad(v.cast("string"), 2, "0")), F.lpad(y.cast("string"), 4, "0")
        last = F.when(x["short"], two(y % 100)).otherwise(four)
        return F.when(x["iso"], F.concat_ws("-", four, two(m), two(d))).when(x["swap"], F.concat(two(F.greatest(d, F.lit(1))), x["a"], two(m), x["b"], last)).otherwise(F.concat(two(m), x["a"], two(d), x["b"], last))

    def whole(x: Column) -> Column:
        def back(v: Column) -> Column:
            year = F.when(x["short"], v[0]["value"] + 2000).when(x["y"].between(1900, 2099), v[0]["value"] + 1900).when(v[0]["value"] < 1900, v[0]["value"]).otherwise(v[0]["value"] + 200)
            on = F.date_add(F.to_date(F.lit("2001-01-01")), v[1]["value"])
            return text(x, year, F.month(on), F.dayofmonth(on))

        # leap years of 1904-2096 (of two digits: 2000-2096) in turn
        leap = F.when(x["short"], ((F.floor((x["y"] - 2000) / 4) + prf(key, "leap")) % 25) * 4 + 2000).otherwise(((F.floor((x["y"] - 1904) / 4) + prf(key, "leap")) % 49) * 4 + 1904)
        return F.when(leap_day(x), text(x, leap, F.lit(2), F.lit(29))).otherwise(let(feistel(index(x), key, "date"), back))

    return let(ymd(s), whole)


def pseudonym(s: Column, key: str) -> Column:
    """kind and pseudonym of a value found; the kind is null and the value as it was if it fails its check."""
    of = {k: s.rlike(f"^(?:{p})$") for k, p in KINDS.items() if k != "secret"}
    low = F.forall(F.split(s, "\\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    bare = F.regexp_replace(s, " ", F.lit(""))
    kind = (
        F.when(of["email"], "email")
        .when(of["ip"], F.when(low, "ip"))
        .when(of["ip6"], "ip6")
        .when(of["date"], F.when(is_date(s), "date"))
        .when(of["ssn"], "ssn")
        .when(of["card"], F.when(luhn(s), "card").when(of["phone"], "phone"))
        .when(of["uuid"], "uuid")
        .when(of["iban"] & (F.length(bare) <= 34), F.when(mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1, "iban"))
        .when(of["phone"], "phone")
        .when(s.rlike("^[A-Za-z0-9._~+/=-]+$"), "secret")
    )
    new = {"email": email(s, key), "uuid": uuid(s, key), "ip": ip(s, key), "ip6": ip6(s, key), "date": date(s, key), "ssn": permuted(s, key, "ssn"), "card": card(s, key), "iban": iban(s, key), "phone": phone(s, key), "secret": permuted(s, key, "secret")}

    def made(k: Column) -> Column:
        value = F.when(k.isNull(), s)
        for name, v in new.items():
            value = value.when(k == name, v)
        return F.struct(k.alias("kind"), value.alias("value"))

    return let(kind, made)


def pseudonymized(docs: DataFrame, key: str) -> DataFrame:
    """docs with personal data in text replaced, and n_pii, the number of values replaced."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "n_pii"]).alias("row"), "text")
    rows = rows.withColumn("found", F.when(F.col("text").rlike(GATE), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    some = F.size("found") > 0
    rows = rows.withColumn("new", F.when(some, F.transform("found", lambda s: pseudonym(s, key))))
    gaps = F.split("text", ANY, -1)
    values = F.concat(F.transform("new", lambda x: x["value"]), F.array(F.lit("")))
    text = F.when(some, F.array_join(F.flatten(F.zip_with(gaps, values, lambda g, v: F.array(g, v))), "")).otherwise(F.col("text"))
    n = F.when(some, F.size(F.filter("new", lambda x: x["kind"].isNotNull()))).otherwise(0).cast("long")
    return rows.select(F.col("row").withField("text", text).alias("row"), n.alias("n_pii")).select("row.*", "n_pii")


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents with pseudonyms; the key is a fixed one for demonstration, so reruns agree."""
    return pseudonymized(docs_table(spark, sf_dir).select("doc_id", "text"), DEMONSTRATION_KEY)
