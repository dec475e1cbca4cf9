"""Replacing sensitive text by aliases, and putting it back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import ALIAS, IDLE_SECONDS, MAX_BYTES, MAX_UNKNOWN
from ..functions.spans import find_all, rewritten
from ..functions.text import let
from ..plans.storage import materialize
from .aliases import assign, within
from .detect import OK, TOO_LARGE, exploded, kinds_summary, with_spans
from .ordered import asof
from .rules import Rules


INCOMPLETE = "incomplete"


def _held(docs: DataFrame, session: str | None, *more: Column) -> DataFrame:
    """docs with each row packed as _doc, so that no name of its columns meets one of ours, and its _session."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), (F.col(f"`{session}`").cast("string") if session else F.lit("all")).alias("_session"), *more)


def protect(docs: DataFrame, rules: Rules = Rules(), session: str | None = None, seq: str = "doc_id", text: str = "text", tagged: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Protected documents and the aliases made.

    docs' rows are the calls of a session, in the order of seq; rows without a seq come last, and rows that share one are
    ordered by their texts. A null session is one like any other. Protected: docs' columns with text rewritten, status,
    count, kinds (kind and count by first appearance) and mappings (those made by the call, in order), which take the
    place of columns of those names; any other name is free. A refused text is null, and contributes nothing. Detection
    runs once; its result is written with a number for each row, by which the pieces of a text come back to it; a text
    that lacks any of them would be refused, not shown. Null texts are ok and stay null. An empty table gives no rows.
    tagged: spans of a name tagger. What is written holds the texts: storage.scratch() removes it.
    """
    columns = [c for c in docs.columns if c not in ("status", "count", "kinds", "mappings")]
    t = F.col(f"`{text}`")
    own = _held(docs, session, F.col(f"`{seq}`").cast("long").alias("_seq"), F.substring(F.md5(t.cast("binary")), 1, 16).alias("_tie"), t.alias("_text"), *([tagged.alias("_tagged")] if tagged is not None else []))
    own = own.withColumn("_row", F.monotonically_increasing_id())
    found = with_spans(own, rules, "_text", tagged=None if tagged is None else F.col("_tagged"))
    found = materialize(found.drop("_text", "_tagged"), "spans").withColumn("_text", F.col(f"_doc.`{text}`"))
    calls = found.where(F.size("spans") > 0).select(F.col("_row").alias("row"), F.col("_session").alias("session"), F.col("_seq").alias("seq"), F.col("_tie").alias("tie"), "_text", "spans")
    cut = exploded(calls, "row", "session", "seq", "tie", text="_text")
    # of rows alike in seq and text, which are alike in all they hold, the first makes the alias
    aliases = assign(cut)
    made = aliases.select(F.col("session").alias("_s"), F.col("original").alias("_o"), "token", F.col("row").alias("_made_in"), F.col("ord").alias("_made_at"), F.col("kind").alias("made_kind"))
    named = cut.join(made, F.col("session").eqNullSafe(F.col("_s")) & (F.col("original") == F.col("_o")))
    new = (F.col("row") == F.col("_made_in")) & (F.col("ord") == F.col("_made_at"))
    piece = F.struct("ord", "start", "end", F.col("token").alias("value"), "original", F.col("made_kind").alias("kind"), new.alias("new"))
    pieces = named.select(F.col("row").alias("_row"), piece.alias("p")).groupBy("_row").agg(F.array_sort(F.collect_list("p")).alias("_pieces"))
    out = found.join(pieces, "_row", "left")
    none = F.expr("cast(array() as array<struct<ord: int, start: int, end: int, value: string, original: string, kind: string, new: boolean>>)")
    return _shown(out.withColumn("_pieces", F.coalesce("_pieces", none)), columns, text), aliases.drop("row")


def protect_each(docs: DataFrame, rules: Rules = Rules(), text: str = "text", tagged: Column | None = None) -> DataFrame:
    """docs protected as by protect(), each row a session of its own: its mappings are all the aliases that there are. All of a session is in one row, so nothing is shuffled, joined or written."""
    columns = [c for c in docs.columns if c not in ("status", "count", "kinds", "mappings")]
    own = _held(docs, None, F.col(f"`{text}`").alias("_text"), *([tagged.alias("_tagged")] if tagged is not None else []))
    found = with_spans(own, rules, "_text", tagged=None if tagged is None else F.col("_tagged"))
    original = lambda s: F.substring(F.col("_text"), s["start"] + 1, s["end"] - s["start"])
    finds = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), original(s).alias("original")))
    # as in with_spans(), so that the pieces are worked out once
    return _shown(found.select("*", F.explode_outer(F.array(let(finds, within))).alias("_pieces")), columns, text)


def _shown(out: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The protected columns of _doc, _text, status, spans and _pieces."""
    out = out.withColumn("_status", F.when((F.col("status") == OK) & (F.size("_pieces") != F.size("spans")), INCOMPLETE).otherwise(F.col("status")))
    ok = F.col("_status") == OK
    mappings = F.transform(F.filter("_pieces", lambda p: p["new"]), lambda p: F.struct(p["value"].alias("token"), p["original"].alias("original"), p["kind"].alias("kind")))
    # worked out before docs' columns are named again: a name of theirs would be taken for one of ours
    out = out.select("_doc", F.when(ok, rewritten(F.col("_text"), F.col("_pieces"))).alias("_new"), "_status", F.when(ok, F.size("spans")).alias("_count"), F.when(ok, kinds_summary(F.col("spans"))).alias("_kinds"), F.when(ok, mappings).alias("_mappings"))
    kept = [F.col("_new" if c == text else f"_doc.`{c}`").alias(c) for c in columns]
    return out.select(*kept, *[F.col(f"_{c}").alias(c) for c in ("status", "count", "kinds", "mappings")])


RESULTS = ("status", "known", "unknown", "unknown_tokens")


def upper(token: Column) -> Column:
    """In upper case, ASCII letters only."""
    return F.translate(token, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def marks(text: Column) -> Column:
    """start, end and value of what looks like an alias."""
    return find_all(text, ALIAS)


def _restored(docs: DataFrame, session: str | None, text: str, look_up: Callable[[DataFrame], DataFrame], *more: Column) -> DataFrame:
    """docs with marks put back. look_up adds original, null if unknown, to marks (_row, _session, ord, start, end, value, _token, more)."""
    columns = [c for c in docs.columns if c not in RESULTS]
    own = _held(docs, session, F.col(f"`{text}`").alias("_text"), *more)
    t = F.col("_text")
    small = F.coalesce(F.octet_length(t) <= MAX_BYTES, F.lit(True))
    holds = F.coalesce(small & t.contains("_") & t.rlike(ALIAS), F.lit(False))
    none = F.expr("cast(array() as array<string>)")
    plain = own.where(~holds).select("_doc", F.when(small, t).alias("_new"), F.when(small, OK).otherwise(TOO_LARGE).alias("_status"), F.when(small, 0).alias("_known"), F.when(small, 0).alias("_unknown"), F.when(small, none).alias("_unknown_tokens"))
    rows = materialize(own.where(holds).drop("_text").withColumn("_row", F.monotonically_increasing_id()), "marked").withColumn("_text", F.col(f"_doc.`{text}`"))
    names = [c for c in own.columns if c not in ("_doc", "_text", "_session")]
    found = rows.select("_row", "_session", *names, F.posexplode(marks(t)).alias("ord", "x")).select("_row", "_session", *names, "ord", "x.*")
    known = look_up(found.withColumn("_token", upper(F.col("value"))))
    piece = F.struct("ord", "start", "end", F.coalesce("original", F.col("value")).alias("value"), F.col("original").isNotNull().alias("known"))
    pieces = known.groupBy("_row").agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
    missing = F.transform(F.filter("_pieces", lambda p: ~p["known"]), lambda p: p["value"])
    out = rows.join(pieces, "_row").select(
        "_doc", rewritten(t, F.col("_pieces")).alias("_new"), F.lit(OK).alias("_status"), F.size(F.filter("_pieces", lambda p: p["known"])).alias("_known"),
        F.size(missing).alias("_unknown"), F.slice(F.array_distinct(missing), 1, MAX_UNKNOWN).alias("_unknown_tokens"),
    )
    # docs' columns are named again last, as in protect()
    return plain.unionByName(out).select(*[F.col("_new" if c == text else f"_doc.`{c}`").alias(c) for c in columns], *[F.col(f"_{c}").alias(c) for c in RESULTS])


def restore(docs: DataFrame, aliases: DataFrame, session: str | None = None, seq: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with aliases put back: text, status, known, unknown and unknown_tokens.

    Text that looks like an alias is looked up in upper case. Known ones are replaced and not searched again; unknown
    ones stay. The list of unknown ones has each spelling once, in order, 20 at most. Rows that share a seq, or have
    none, are restored each for itself; null texts stay null. Columns of docs named like the results give way to them;
    any other name is free. All aliases are known, whenever they were made: restore_asof() asks what lived.
    """
    of = aliases.select(F.col("session").alias("_s"), F.col("token").alias("_t"), "original")
    return _restored(docs, session, text, lambda found: found.join(of, F.col("_session").eqNullSafe(F.col("_s")) & (F.col("_token") == F.col("_t")), "left"))


def restore_asof(docs: DataFrame, touches: DataFrame, clears: DataFrame, ts: str, session: str | None = None, text: str = "text", idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """docs restored each as of its ts, as restore() does it, without renewing anything: an alias is known while its last touch until then is younger than the idle time and its session wasn't cleared since.

    touches: session, token, original and ts of every touch of an alias; clears: session and ts. A document without a ts
    knows none. An as-of join finds the last touch of each mark's alias, another the last clearing of its session.
    """
    at = F.col(f"`{ts}`").cast("timestamp_ntz").alias("_ts")
    last = touches.select(F.col("session").cast("string").alias("_session"), F.col("token").alias("_token"), F.col("ts").cast("timestamp_ntz").alias("_ts"), "original")
    gone = clears.select(F.col("session").cast("string").alias("_session"), F.col("ts").cast("timestamp_ntz").alias("_ts"))

    def look_up(found: DataFrame) -> DataFrame:
        dated = asof(found.where("_ts IS NOT NULL"), last, ["_session", "_token"], ["_ts"], "_touch")
        dated = dated.select(*[c for c in found.columns if c != "_token"], F.col("_touch._ts").alias("_touched"), F.col("_touch.original").alias("original"))
        dated = asof(dated, gone, ["_session"], ["_ts"], "_clear")
        age = F.unix_micros(F.col("_ts").cast("timestamp")) - F.unix_micros(F.col("_touched").cast("timestamp"))
        lives = (age < idle_seconds * 1_000_000) & ~F.coalesce(F.col("_clear._ts") > F.col("_touched"), F.lit(False))
        dated = dated.select(*found.columns[:-1], F.when(lives, F.col("original")).alias("original"))
        return dated.unionByName(found.where("_ts IS NULL").drop("_token").withColumn("original", F.lit(None).cast("string")))

    return _restored(docs, session, text, look_up, at)


def restore_touches(docs: DataFrame, aliases: DataFrame, ts: str, session: str | None = None, seq: str = "doc_id", text: str = "text") -> DataFrame:
    """What restoring asks for, as events (session, ts, seq, original, kind, type, token): one for each alias found. Their type is restore, so they renew an entry that lives (fold.settled()) and make none."""
    t = F.col(f"`{text}`")
    rows = _held(docs, session, F.col(f"`{ts}`").alias("ts"), F.col(f"`{seq}`").cast("long").alias("seq"), t.alias("_t")).where((F.octet_length("_t") <= MAX_BYTES) & F.col("_t").rlike(ALIAS))
    found = rows.select(F.col("_session").alias("session"), "ts", "seq", F.explode(marks(F.col("_t"))["value"]).alias("value"))
    of = aliases.select(F.col("session").alias("_s"), "token", "original", "kind")
    return found.join(of, F.col("session").eqNullSafe(F.col("_s")) & (upper(F.col("value")) == F.col("token"))).select("session", "ts", "seq", "original", "kind", F.lit("restore").alias("type"), "token")


def round_trip(docs: DataFrame, rules: Rules = Rules(), seq: str = "doc_id", text: str = "text") -> DataFrame:
    """seq of accepted documents that don't come back as they were, none of whose spans touch an underscore."""
    shown, aliases = protect(docs.select(seq, text), rules, seq=seq, text=text)
    aliases = materialize(aliases, "aliases")
    back = restore(shown.where(F.col("status") == OK).select(seq, text), aliases, seq=seq, text=text)
    spans = with_spans(docs.select(seq, text), rules, text)
    touches = F.exists("spans", lambda s: (F.substring(F.col(text), s["end"] + 1, F.lit(1)) == "_") | ((s["start"] > 0) & (F.substring(F.col(text), s["start"], F.lit(1)) == "_")))
    was = spans.where((F.col("status") == OK) & ~touches).select(seq, F.col(text).alias("_was"))
    return back.join(was, seq).where(~F.col(text).eqNullSafe(F.col("_was"))).select(seq)
