"""Always- and never-terms as tables: lists of any number and size, each text with the terms of its list.

Which terms of a list a text may hold is a join of words: the first word of a term with the distinct words of the text.
Only those few are then looked for in the text, as one alternation for always-terms and each for itself for never-terms,
by the same rules as rules of one call. Where the table of terms is small Spark broadcasts it and the texts aren't
shuffled; else only words are.

A text is searched for no term whose first word it doesn't hold as a word; so what begins or ends inside a word, and so
is no find, takes no other find's place here, while a list given as rules lets it (functions.spans.terms_found). Words
are runs of letters and digits and are compared whatever their case. Terms without any are looked for in all texts of
their list. Null lists, terms and texts match nothing; repeated terms count once.

Finds inside a never-term go by a sweep: sorted by start, a find lies in some never-term that begins with it or before
if the farthest end of these reaches its own. That takes time in proportion to finds plus never-terms, however many of
them a text has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import TERM_ORDER, TERM_PRIORITY
from ..functions.spans import _LETTERS, _SMALL, EMPTY, _span, find_all
from ..functions.text import let, word_boundary
from .ordered import running

WORD = r"[\p{IsAlphabetic}\p{N}]+"
SPECIAL = r"([\\^$.|?*+()\[\]{}])"


def folded(text: Column) -> Column:
    """What texts that differ in case only share."""
    return F.lower(F.upper(text))


def quoted(term: Column) -> Column:
    """A term as a literal in Java's dialect."""
    return F.regexp_replace(term, F.lit(SPECIAL), F.lit(r"\\$1"))


def candidates(docs: DataFrame, terms: DataFrame, row: str) -> DataFrame:
    """row and terms: those of the text's list whose first word the text holds. docs: row (unique), list_id, text; terms: list_id, term."""
    word = F.regexp_extract(folded(F.col("term")), WORD, 0)
    t = terms.where("list_id IS NOT NULL AND term <> ''").select("list_id", "term").distinct().select("list_id", "term", word.alias("word"))
    # every text holds the empty word, which is that of terms without any
    words = F.concat(F.array_distinct(F.regexp_extract_all(folded(F.col("text")), F.lit(WORD), F.lit(0))), F.array(F.lit("")))
    d = docs.select(row, "list_id", F.explode(words).alias("word"))
    return d.join(t, ["list_id", "word"]).groupBy(row).agg(F.collect_set("term").alias("terms"))


def held(text: Column, terms: Column) -> Column:
    """Of terms those that may occur in a text: ASCII ones by a plain search, whatever their case, the others all. A pattern tries every term at every place; a plain search passes over a text far faster."""
    # four letters beside ASCII's are taken for one of those by a pattern, but not by lower()
    odd = text.contains(_LETTERS[-4]) | text.contains(_LETTERS[-3]) | text.contains(_LETTERS[-2]) | text.contains(_LETTERS[-1])
    small = F.when(odd, F.translate(text, _LETTERS, _SMALL)).otherwise(F.lower(text))
    return let(small, lambda s: F.filter(terms, lambda t: t.rlike(r"[^\x00-\x7F]") | F.contains(s, F.lower(t))))


def always_spans(docs: DataFrame, terms: DataFrame, row: str) -> DataFrame:
    """docs with found: the spans of its list's terms, whatever their case; of terms that begin together the longest in bytes is tried first, and what a match covers isn't searched again."""
    by_size = F.transform(F.array_sort(F.transform("terms", lambda t: F.struct((-F.octet_length(t)).alias("n"), t.alias("t")))), lambda x: quoted(x["t"]))
    pattern = F.concat(F.lit("(?iu)(?:"), F.array_join(by_size, "|"), F.lit(")"))
    d = docs.join(candidates(docs, terms, row), row, "left").withColumn("terms", held(F.col("text"), F.col("terms"))).withColumn("_pattern", pattern)
    free = F.filter(find_all(F.col("text"), F.col("_pattern")), lambda x: word_boundary(F.col("text"), x["start"], x["end"]))
    spans = F.transform(free, lambda x, i: _span(x["start"], x["end"], "TERM", TERM_PRIORITY, TERM_ORDER, i))
    found = F.when(F.size("terms") > 0, spans).otherwise(F.expr(EMPTY))
    # exploding an array of one keeps the optimizer from searching again for each filter on what is found
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode_outer(F.array(found)).alias("found"))


def never_ranges(docs: DataFrame, terms: DataFrame, row: str) -> DataFrame:
    """row, start and end of every place of every never-term of a text's list."""
    d = docs.join(candidates(docs, terms, row), row).select(row, "text", F.explode("terms").alias("term"))
    found = F.filter(find_all(F.col("text"), F.concat(F.lit("(?iu)"), quoted(F.col("term")))), lambda x: word_boundary(F.col("text"), x["start"], x["end"]))
    return d.select(row, F.explode(found).alias("x")).select(row, "x.start", "x.end")


def unsuppressed(spans: DataFrame, ranges: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """spans (keys, start, end, ...) without those that lie wholly inside a range (keys, start, end) of the same keys."""
    held = F.struct(*[F.col(f"`{c}`") for c in spans.columns])
    mine = spans.select(*keys, F.col("start").alias("_start"), F.lit(None).cast("int").alias("_reach"), F.lit(1).alias("_side"), held.alias("_span"))
    theirs = ranges.select(*keys, F.col("start").alias("_start"), F.col("end").cast("int").alias("_reach"), F.lit(0).alias("_side"), F.lit(None).cast(mine.schema["_span"].dataType).alias("_span"))
    swept = running(mine.unionByName(theirs), keys, [F.col("_start"), F.col("_side")], highest={"_far": F.col("_reach")}, rows=rows)
    return swept.where("_side = 1").where(F.coalesce(F.col("_far") < F.col("_span.end"), F.lit(True))).select("_span.*")
