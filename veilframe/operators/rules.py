"""Rules: terms that are always or never replaced, and whether amounts and dates are."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_TERMS, SHORTEST, LONGEST = 500, 2, 200


class BadRule(ValueError):
    """A term is too short or too long, or a list has too many."""


class ConflictingRule(ValueError):
    """A term is in both lists."""


def cleaned(terms: list[str]) -> list[str]:
    """Terms trimmed, empty ones dropped, each once whatever its case."""
    out: dict[str, str] = {}
    for term in (t.strip() for t in terms):
        if not term:
            continue
        if not SHORTEST <= len(term) <= LONGEST:
            raise BadRule("length")
        out.setdefault(term.lower(), term)
    if len(out) > MOST_TERMS:
        raise BadRule("number")
    return list(out.values())


@dataclass(frozen=True)
class Rules:
    """Lists of terms and the switch for amounts and dates. Made by checked()."""

    always: list[str] = field(default_factory=list)
    never: list[str] = field(default_factory=list)
    money_dates: bool = False

    @classmethod
    def checked(cls, always: list[str] = (), never: list[str] = (), money_dates: bool = False) -> "Rules":
        a, n = cleaned(list(always)), cleaned(list(never))
        if {t.lower() for t in a} & {t.lower() for t in n}:
            raise ConflictingRule("term in both lists")
        return cls(a, n, bool(money_dates))

    def with_drafts(self, drafts: list[str]) -> "Rules":
        """For one call: more always-terms, which win over equal never-terms."""
        more = cleaned(list(drafts))
        low = {t.lower() for t in more}
        return Rules(self.always + more, [t for t in self.never if t.lower() not in low], self.money_dates)


# --- the same over tables of lists: (list_id, pos, term) --------------------------------------------------------------


def cleaned_lists(terms: DataFrame) -> DataFrame:
    """list_id, pos, term of the terms that lists keep: trimmed, not empty, the first of those that differ in case only."""
    t = terms.withColumn("term", F.regexp_replace("term", r"(?U)^\s+|\s+$", F.lit(""))).where("term <> ''")
    nth = F.row_number().over(Window.partitionBy("list_id", F.lower("term")).orderBy("pos"))
    return t.withColumn("_nth", nth).where("_nth = 1").select("list_id", "pos", "term")


def list_status(terms: DataFrame) -> DataFrame:
    """list_id, status and terms kept of each list: ok, or bad_length or bad_number, which refuse it whole."""
    size = F.length("term")
    per = cleaned_lists(terms).groupBy("list_id").agg(F.count("*").alias("terms"), F.bool_or(~size.between(SHORTEST, LONGEST)).alias("_odd"))
    return per.select("list_id", F.when(F.col("_odd"), "bad_length").when(F.col("terms") > MOST_TERMS, "bad_number").otherwise("ok").alias("status"), "terms")


def _low(terms: DataFrame) -> DataFrame:
    return cleaned_lists(terms).select("list_id", F.lower("term").alias("_low")).distinct()


def conflicts(always: DataFrame, never: DataFrame) -> DataFrame:
    """list_id and conflict of each list of always-terms: whether a term is in the never-terms of the same list_id, whatever its case."""
    both = _low(always).join(_low(never), ["list_id", "_low"]).select("list_id", F.lit(True).alias("conflict")).distinct()
    return always.select("list_id").distinct().join(both, "list_id", "left").select("list_id", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def without_drafts(never: DataFrame, drafts: DataFrame) -> DataFrame:
    """The never-terms that hold in a call with draft always-terms: those that no draft equals, whatever their case."""
    n = cleaned_lists(never).withColumn("_low", F.lower("term"))
    return n.join(_low(drafts), ["list_id", "_low"], "left_anti").select("list_id", "pos", "term")


def term_problem(term: Column, own: list[str], other: list[str]) -> Column:
    """Why a term can't be added to a list, or null: length, own (it is there), other (it is in the other list), number."""
    low = F.lower(term)
    held = lambda terms: F.array_contains(F.array(*[F.lit(t.lower()) for t in terms]).cast("array<string>"), low)
    return F.when(~F.length(term).between(SHORTEST, LONGEST), "length").when(held(own), "own").when(held(other), "other").when(F.lit(len(own) >= MOST_TERMS), "number")


#: What a list's owner is told. Fixed values.
MESSAGES = {
    "length": f"Use between {SHORTEST} and {LONGEST} characters.",
    "own": "This term is already in this list.",
    "other": "This term is in the other list. Remove it there first.",
    "number": f"This list has reached its {MOST_TERMS}-term limit.",
}


def term_error(term: str, kind: str, rules: Rules) -> str | None:
    """What is wrong with adding a term to the list `always` or `never`, or None."""
    lists = {"always": rules.always, "never": rules.never}
    own = {t.lower() for t in lists.pop(kind)}
    other = {t.lower() for terms in lists.values() for t in terms}
    checks = {"length": not SHORTEST <= len(term) <= LONGEST, "own": term.lower() in own, "other": term.lower() in other, "number": len(own) >= MOST_TERMS}
    return next((MESSAGES[code] for code, wrong in checks.items() if wrong), None)
