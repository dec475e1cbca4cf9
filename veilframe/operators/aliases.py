"""Aliases: each distinct original of a session gets KIND_n, numbered per kind by first appearance.

The sequential process - look an original up, else count its kind up - is the numbering of first appearances within
(session, kind). The key is the original alone, so its first appearance's kind names it for good. Calls are in the order
of seq; those without one come last, and tie (the start of the text's MD5) orders those that share one. Numbers are
running sums over range partitions (operators.ordered), so a session of all documents is numbered by as many tasks as its
originals need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from . import ordered


def order(seq: str = "seq", tie: str = "tie") -> list[Column]:
    """By seq, unknown ones last; calls that share one by tie."""
    return [F.col(seq).isNull().alias("none"), F.col(seq).alias("seq"), F.col(tie).alias("tie")]


def first_seen(found: DataFrame, *more: str) -> DataFrame:
    """session, original, kind, seq, tie and ord of each original's first appearance. found: session, seq, tie, ord, kind, original, and row, if rows alike in all else are to be told apart."""
    row = [c for c in ("row",) if c in found.columns]
    x = F.min(F.struct(*order(), "ord", "kind", *row)).alias("x")
    return found.groupBy("session", *more, "original").agg(x).select("session", *more, "original", "x.seq", "x.tie", "x.ord", "x.kind", *[f"x.{c}" for c in row])


def numbered(firsts: DataFrame, kind: str = "kind") -> DataFrame:
    """firsts with n, the place of a row among its session's and kind's by (seq, tie, ord)."""
    return ordered.numbered(firsts, ["session", kind], [*order(), F.col("ord")])


def token(kind: Column, n: Column) -> Column:
    return F.concat_ws("_", F.upper(kind), n.cast("string"))


def assign(found: DataFrame) -> DataFrame:
    """session, original, token, kind, seq, tie, ord: the alias of each original, with where it was made."""
    n = numbered(first_seen(found))
    return n.select("session", "original", token(F.col("kind"), F.col("n")).alias("token"), "kind", "seq", "tie", "ord", *[c for c in ("row",) if c in n.columns])


def within(finds: Column) -> Column:
    """ord, start, end, value (the token), original, kind and new (whether it makes the alias) of each of finds (start, end, kind, original; in order) of one text, in a session that holds nothing else. A text's finds are bounded by its size, which detection limits."""

    def made(firsts: Column) -> Column:
        of_kind = lambda k: F.transform(F.filter(firsts, lambda f: f["kind"] == k), lambda f, i: F.struct(f["original"], F.struct(token(k, i + 1).alias("token"), k.alias("kind"))))
        return F.map_from_entries(F.flatten(F.transform(F.array_distinct(F.transform(firsts, lambda f: f["kind"])), of_kind)))

    def named(originals: Column) -> Column:
        firsts = F.transform(F.array_distinct(originals), lambda v: F.struct(v.alias("original"), F.get(finds, F.array_position(originals, v).cast("int") - 1)["kind"].alias("kind")))
        return let(let(firsts, made), lambda names: F.transform(finds, lambda x, i: let(F.element_at(names, x["original"]), lambda a: F.struct(
            i.alias("ord"), x["start"].alias("start"), x["end"].alias("end"), a["token"].alias("value"), x["original"].alias("original"), a["kind"].alias("kind"),
            (F.array_position(originals, x["original"]) == i + 1).alias("new"),
        ))))

    return let(F.transform(finds, lambda x: x["original"]), named)


def over_capacity(aliases: DataFrame, most: int) -> DataFrame:
    """session and seq of the first call that would bring a session's live originals over its capacity, where nothing expires: that of the original numbered most + 1 in its session."""
    more = [F.col(c) if c in aliases.columns else F.lit(v).alias(c) for c, v in (("tie", ""), ("ord", 0))]
    firsts = numbered(aliases.select("session", "seq", *more).withColumn("_one", F.lit("")), "_one")
    return firsts.where(F.col("n") == most + 1).select("session", "seq")
