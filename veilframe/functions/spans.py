"""Find-all with offsets, and the resolution of overlapping finds, as native expressions.

A span is struct<start, end, kind, priority, det, seq>: code points, end exclusive, the detector's order and the find's
number. Spark has no find-all with offsets, but matches set between marks by one replacement, and split there, alternate
with the gaps between them, so starts are running sums.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import ANY_CASE, DETECTORS, DIGIT, TERM_ORDER, TERM_PRIORITY, Detector
from .text import CHECKS, TRIMS, ascii_boundary, let, word_boundary

SPAN = "struct<start: int, end: int, kind: string, priority: int, det: int, seq: int>"
SPANS = f"array<{SPAN}>"
EMPTY = f"cast(array() as {SPANS})"
FOUND = "array<struct<start: int, end: int, value: string>>"


#: Marks round a match and before its group: code points that no character has. Where a text holds one, a replacement character stands for it in the search, which no pattern tells from it.
MARK, INNER, STAND_IN = "\uffff", "\ufffe", "\ufffd"


def find_all(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """start, end and value of each match, or of its group, which occurs once in the match and after what precedes it. The pattern runs once."""
    clean = F.when(text.contains(MARK) | text.contains(INNER), F.translate(text, MARK + INNER, STAND_IN * 2)).otherwise(text)
    shown = f"{MARK}$0{INNER}${group}{MARK}" if group else f"{MARK}$0{MARK}"
    parts = F.split(F.regexp_replace(clean, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(shown)), MARK, -1)

    def step(acc: Column, x: Column) -> Column:
        whole = F.substring_index(x, INNER, 1) if group else x
        inner = F.substring_index(x, INNER, -1) if group else x
        own = acc["pos"] + (F.instr(whole, inner) - 1 if group else 0)
        found = F.struct(own.cast("int").alias("start"), (own + F.length(inner)).cast("int").alias("end"), inner.alias("value"))
        return F.struct((acc["pos"] + F.length(whole)).cast("int").alias("pos"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("inside"), F.expr(f"cast(array() as {FOUND})").alias("out"))
    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def _span(start: Column, end: Column, kind: str, priority: int, det: int, seq: Column) -> Column:
    return F.struct(start.alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), F.lit(det).alias("det"), seq.cast("int").alias("seq"))


def detected(text: Column, d: Detector) -> Column:
    """The spans that a detector finds: trimmed, checked, and free on both sides."""
    trim = TRIMS.get(d.trim, lambda s: s)
    found = F.transform(find_all(text, d.pattern, d.group), lambda x: let(trim(x["value"]), lambda v: F.struct(x["start"].alias("start"), (x["start"] + F.length(v)).alias("end"), v.alias("value"))))

    def sound(x: Column) -> Column:
        free = ascii_boundary(text, x["start"], x["end"]) & (x["end"] > x["start"])
        return CHECKS[d.check](x["value"]) & free if d.check else free

    spans = F.transform(F.filter(found, sound), lambda x, i: _span(x["start"], x["end"], d.kind, d.priority, d.order, i))
    none = F.expr(EMPTY)
    return F.when(holds_any(text, d.needs), F.when(text.rlike(d.gate), spans).otherwise(none)).otherwise(none)


def holds_any(text: Column, needs: tuple[str, ...]) -> Column:
    """Whether a text holds one of some strings: far cheaper than a pattern, and the same for many detectors."""
    test = None
    for n in needs:
        if n == DIGIT:
            one = text.rlike(r"[0-9]") | text.rlike(r"(?U)[\d&&[^0-9]]")
        elif n.startswith(ANY_CASE):
            one = F.lower(text).contains(n.removeprefix(ANY_CASE))
        else:
            one = text.contains(n)
        test = one if test is None else test | one
    return test


def quoted(term: str) -> str:
    """A term as a literal in Java's dialect."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", term)


def terms_found(text: Column, terms: list[str]) -> Column:
    """Spans of always-terms, whatever their case; of terms that begin together the longest in bytes is tried first."""
    if not terms:
        return F.expr(EMPTY)
    pattern = "(?iu)(?:" + "|".join(quoted(t) for t in sorted(terms, key=lambda t: -len(t.encode()))) + ")"
    free = F.filter(find_all(text, pattern), lambda x: word_boundary(text, x["start"], x["end"]))
    spans = F.transform(free, lambda x, i: _span(x["start"], x["end"], "TERM", TERM_PRIORITY, TERM_ORDER, i))
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(EMPTY))


#: ASCII letters, and the code points that a pattern takes for one whatever its case, and the letters that they stand for.
_LETTERS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\u0130\u0131\u017f\u212a", "abcdefghijklmnopqrstuvwxyziisk"


def never_found(text: Column, terms: list[str]) -> Column:
    """start and end of each never-term, each looked for by itself in texts that hold it.

    Which ASCII terms a text holds whatever their case is a plain search of the text in small letters; no pattern is made
    for those that it lacks. The other terms are tried one by one in texts that hold any of them.
    """
    none = F.expr(f"cast(array() as {FOUND})")
    plain, others = [t for t in terms if t.isascii()], [t for t in terms if not t.isascii()]

    def places(held: Column) -> Column:
        return F.flatten(F.transform(held, lambda t: F.filter(find_all(text, F.concat(F.lit("(?iu)"), t)), lambda x: word_boundary(text, x["start"], x["end"]))))

    out = []
    if plain:
        every = F.array(*[F.struct(F.lit(t.lower()).alias("t"), F.lit(quoted(t)).alias("q")) for t in plain])
        held = let(F.translate(text, _LETTERS, _SMALL), lambda small: F.filter(every, lambda t: F.contains(small, t["t"])))
        out.append(places(F.transform(held, lambda t: t["q"])))
    if others:
        some = "(?iu)(?:" + "|".join(quoted(t) for t in others) + ")"
        held = F.filter(F.array(*[F.lit(quoted(t)) for t in others]), lambda t: F.rlike(text, F.concat(F.lit("(?iu)"), t)))
        out.append(F.when(text.rlike(some), places(held)).otherwise(none))
    return F.coalesce(F.concat(*out), none) if out else none


def all_spans(text: Column, always: list[str] = (), money_dates: bool = False, kinds: set[str] | None = None) -> Column:
    """Spans of all detectors, unresolved, in their order."""
    used = [d for d in DETECTORS if (money_dates or not d.opt_in) and (kinds is None or d.kind in kinds)]
    return F.concat(*[detected(text, d) for d in used], terms_found(text, list(always)))


def resolved(spans: Column, never: Column | None = None) -> Column:
    """Spans without those inside a never-term, in order, overlapping ones merged.

    A merged span covers all of both. It takes the later one's kind if that begins with it and ends later, or ends later
    and has a higher priority. Spans that touch stay apart.
    """
    if never is not None:
        # never-terms are looked for once, and only beside spans
        kept = lambda own, ranges: F.filter(own, lambda s: ~F.exists(ranges, lambda m: (s["start"] >= m["start"]) & (s["end"] <= m["end"])))
        spans = let(spans, lambda own: F.when(F.size(own) > 0, let(never, lambda ranges: kept(own, ranges))).otherwise(own))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["priority"]).alias("p"), s["det"].alias("det"), s["seq"].alias("seq"), s["end"].alias("end"), s["kind"].alias("kind")))

    def fold(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = s["end"] > last["end"]
        takes = longer & ((s["start"] == last["start"]) | (s["p"] < last["p"]))
        both = F.struct(
            last["start"].alias("start"),
            F.when(takes, s["p"]).otherwise(last["p"]).alias("p"),
            F.when(takes, s["det"]).otherwise(last["det"]).alias("det"),
            F.when(takes, s["seq"]).otherwise(last["seq"]).alias("seq"),
            F.greatest(s["end"], last["end"]).alias("end"),
            F.when(takes, s["kind"]).otherwise(last["kind"]).alias("kind"),
        )
        overlaps = (F.size(acc) > 0) & (s["start"] < F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(-1)))
        return F.when(overlaps, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(acc, F.array(s)))

    start = F.expr("cast(array() as array<struct<start: int, p: int, det: int, seq: int, end: int, kind: string>>)")
    merged = F.aggregate(F.array_sort(keyed), start, fold)
    return F.transform(merged, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), (-s["p"]).alias("priority")))


def rewritten(text: Column, pieces: Column) -> Column:
    """text with pieces (start, end, value; in order, disjoint) put in the place of what they cover."""

    def step(acc: Column, x: Column) -> Column:
        kept = F.substring(text, acc["pos"] + 1, x["start"] - acc["pos"])
        return F.struct(x["end"].alias("pos"), F.concat(acc["out"], F.array(kept, x["value"])).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<string>)").alias("out"))
    whole = F.aggregate(pieces, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(pieces) > 0, whole).otherwise(text)
