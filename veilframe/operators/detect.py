"""Documents to spans: guards first, then all detectors, then resolution."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import ALIAS, MAX_BYTES
from ..functions.spans import EMPTY, all_spans, never_found, resolved
from .rules import Rules

OK, TOO_LARGE, COLLISION = "ok", "input_too_large", "collision"


def status(text: Column) -> Column:
    """Why a text is refused, or ok: its size first, then text that looks like an alias."""
    return F.when(F.octet_length(text) > MAX_BYTES, TOO_LARGE).when(text.contains("_") & text.rlike(ALIAS), COLLISION).otherwise(OK)


def with_status(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("status", status(F.col(text)))


def with_spans(docs: DataFrame, rules: Rules = Rules(), text: str = "text", kinds: set[str] | None = None, tagged: Column | None = None) -> DataFrame:
    """docs with status and spans (resolved; none for refused texts). tagged: spans of a name tagger to be resolved with the rest."""
    own = tuple(rules.always), tuple(rules.never), rules.money_dates, None if kinds is None else frozenset(kinds)
    spans = _spans(text, *own) if tagged is None else _resolved(text, *own, tagged)
    # exploding an array of one keeps the optimizer from copying the detection to each place where spans are used
    return with_status(docs, text).select("*", F.explode_outer(F.array(spans)).alias("spans"))


def _resolved(text: str, always: tuple[str, ...], never: tuple[str, ...], money_dates: bool, kinds: frozenset[str] | None, tagged: Column | None = None) -> Column:
    t = F.col(text)
    found = all_spans(t, list(always), money_dates, kinds)
    if tagged is not None:
        found = F.concat(found, F.coalesce(tagged, F.expr(EMPTY)))
    return F.when(status(t) == OK, resolved(found, never_found(t, list(never)) if never else None)).otherwise(resolved(F.expr(EMPTY)))


#: The expression of a column's name and rules, made once: its thousands of nodes cost the driver seconds, and nothing in it depends on the table.
_spans = lru_cache(maxsize=32)(_resolved)


def exploded(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, ord, start, end, kind and original of each span of docs (spans, text)."""
    e = docs.select(*keys, F.col(text).alias("_text"), F.posexplode("spans").alias("ord", "s"))
    original = F.substring(F.col("_text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return e.select(*keys, "ord", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"), original.alias("original"))


def kind_counts(docs: DataFrame, *by: str) -> DataFrame:
    """Spans and documents of each kind; counts only, so fit for a report."""
    e = docs.select(*by, F.explode(kinds_summary(F.col("spans"))).alias("k"))
    return e.groupBy(*by, F.col("k.kind").alias("kind")).agg(F.sum("k.count").alias("spans"), F.count("*").alias("documents"))


def kinds_summary(spans: Column) -> Column:
    """kind and count, in the order in which kinds first appear."""
    kinds = F.transform(spans, lambda s: s["kind"])
    return F.transform(F.array_distinct(kinds), lambda k: F.struct(k.alias("kind"), F.size(F.filter(kinds, lambda x: x == k)).alias("count")))
