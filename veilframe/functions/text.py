"""Checks, trims and boundary tests of matches, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", F.lit(""))


def luhn_ok(s: Column) -> Column:
    """13 to 19 ASCII digits whose Luhn sum ends in 0."""
    d = ascii_digits(s)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def iban_ok(s: Column) -> Column:
    """15 to 34 characters; first four moved to the end, letters from A = 10 on, remainder 1 by 97."""
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    chars = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(moved, i, F.lit(1)))

    def step(r: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97).cast("int")

    return F.length(s).between(15, 34) & s.rlike("^[A-Z0-9]+$") & (F.aggregate(chars, F.lit(0), step) == 1)


def ipv4_ok(s: Column) -> Column:
    parts = F.split(s, "\\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^[0-9]{1,3}$") & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))


_H, _V4 = "[0-9A-Fa-f]{1,4}", r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _ipv6_grammar() -> str:
    """The text forms of an IPv6 address: eight groups, the last two maybe as IPv4, one run of groups maybe left out."""
    tail = f"(?:{_H}:{_H}|{_V4})"
    forms = [f"(?:{_H}:){{6}}{tail}"]
    for before in range(8):
        head = f"{_H}(?::{_H}){{{before - 1}}}" if before else ""
        most = 7 - before
        ends = [""]
        if most >= 1:
            ends.append(f"{_H}(?::{_H}){{0,{most - 1}}}")
        if most >= 2:
            ends.append(f"(?:{_H}:){{0,{most - 2}}}{_V4}")
        forms.append(f"{head}::(?:{'|'.join(ends)})")
    return "^(?:" + "|".join(forms) + ")$"


IPV6 = _ipv6_grammar()


def ipv6_ok(s: Column) -> Column:
    return s.rlike(IPV6)


def phone_ok(s: Column) -> Column:
    return F.length(ascii_digits(s)).between(7, 15)


def date_ok(s: Column) -> Column:
    """Three numbers; year first if the first has four characters, else month first; month to 12 and day to 31."""
    parts = F.split(s, F.when(s.contains("-"), F.lit("-")).otherwise(F.lit("/")))
    whole = (F.size(parts) == 3) & F.forall(parts, lambda p: p.rlike("^[0-9]{1,9}$"))
    number = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0))
    first = F.octet_length(F.get(parts, F.lit(0))) == 4
    month, day = F.when(first, number(1)).otherwise(number(0)), F.when(first, number(2)).otherwise(number(1))
    return F.coalesce(whole & month.between(1, 12) & day.between(1, 31), F.lit(False))


CHECKS = {"luhn": luhn_ok, "iban": iban_ok, "ipv4": ipv4_ok, "ipv6": ipv6_ok, "phone": phone_ok, "date": date_ok}

# What may be trimmed from a match's end.
_PUNCT, _URL_PUNCT = ".,;:!?)]}'\"", ".,;:!?]}'\""


def trim_end(s: Column, chars: str) -> Column:
    return F.rtrim(s, F.lit(chars))


def trim_punct(s: Column) -> Column:
    return trim_end(s, _PUNCT)


def trim_url(s: Column) -> Column:
    """Trailing marks go, and closing brackets as long as there are more of them than opening ones."""
    count = lambda t, c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    drop = lambda t, i: F.when(t.endswith(")") & (count(t, "(") < count(t, ")")), trim_end(F.substring(t, F.lit(1), F.length(t) - 1), _URL_PUNCT)).otherwise(t)
    turns = count(s, ")")
    once = trim_end(s, _URL_PUNCT)
    return F.when(turns == 0, once).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(turns, F.lit(1))), once, drop))


TRIMS = {"url": trim_url, "punct": trim_punct, "card": lambda s: trim_end(s, " -")}


def ascii_boundary(text: Column, start: Column, end: Column) -> Column:
    """No ASCII letter, digit, @ or . before, and no ASCII letter or digit after."""
    return _edges(text, start, end, "[A-Za-z0-9@.]", "[A-Za-z0-9]")


def word_boundary(text: Column, start: Column, end: Column) -> Column:
    """No Unicode letter or number on either side."""
    return _edges(text, start, end, r"[\p{IsAlphabetic}\p{N}]", r"[\p{IsAlphabetic}\p{N}]")


def _edges(text: Column, start: Column, end: Column, before: str, after: str) -> Column:
    # a substring from 0 would begin at 1
    head = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise(F.lit(""))
    return ~head.rlike(before) & ~F.substring(text, end + 1, F.lit(1)).rlike(after)
