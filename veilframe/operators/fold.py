"""What depends on all that came before in a session: renewals by restores, and the limit of live aliases.

Restoring an alias renews its entry if that lives, and does nothing otherwise; whether it lives depends on earlier
restores, and whether an original's next touch makes a new alias, and so which numbers later aliases get, does too. That
is a fold over a session's events in order. What is folded is little: touches of one original, and restores of one
alias, that follow each other within the idle time and without a clearing between are one run, found by windows over all
events; a run lives or dies as one, but for restores that begin before their alias is made. A task reads a session's runs
as they come, sorted, and holds the entries that live at that moment.

The limit is one of calls: a call that would bring a session's live entries over it fails whole, and its touches count
for nothing, but what had expired by then is gone. At a clearing, or where no call came for the idle time, nothing lives,
so the calls between are judged alone, in parallel; those whose originals together are within the limit can't fail and
aren't folded.

Events are ordered by (ts, seq), clearings first among those of one ts. A null session is one like any other; null
originals and tokens are nothing. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import IDLE_SECONDS, MAX_LIVE
from ..plans.storage import materialize
from .ordered import running

TOUCH, RESTORE, CLEAR, PROTECT = "touch", "restore", "clear", "protect"
OK, LIMIT = "ok", "mapping_limit_reached"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


class Live:
    """The entries of a session that live, and restores that wait for their alias to be made."""

    def __init__(self, idle: int):
        self.idle, self.counters = idle, Counter()
        self.clear()

    def clear(self) -> None:
        self.entries: dict[str, list] = {}  # original: token, time until which it lives
        self.of: dict[str, str] = {}  # token: original
        self.waiting: dict[str, tuple] = {}  # token: run, its last event
        self.swept = 1024

    def sweep(self, now: int) -> None:
        """Forget what is dead, when as much may have died as lives."""
        if len(self.entries) + len(self.waiting) <= self.swept:
            return
        self.entries = {o: e for o, e in self.entries.items() if now < e[1]}
        self.of = {e[0]: o for o, e in self.entries.items()}
        self.waiting = {t: w for t, w in self.waiting.items() if w[1][0] >= now}
        self.swept = 1024 + 2 * (len(self.entries) + len(self.waiting))

    def touch(self, at: tuple, original: str, kind: str, last: tuple) -> tuple[str, bool, tuple | None]:
        """The alias, whether it is new, and the restores that waited for it."""
        entry = self.entries.get(original)
        if entry and at[0] < entry[1]:
            entry[1] = max(entry[1], last[0] + self.idle)
            return entry[0], False, None
        if entry:
            self.of.pop(entry[0], None)
        name = (kind or "").upper()
        self.counters[name] += 1
        token = f"{name}_{self.counters[name]}"
        waited = self.waiting.pop(token, None)
        if waited and waited[1] <= at:
            waited = None
        self.entries[original] = [token, max(last[0], waited[1][0] if waited else 0) + self.idle]
        self.of[token] = original
        return token, True, waited

    def restore(self, at: tuple, token: str, run: int, last: tuple) -> str | None:
        original = self.of.get(token)
        if original is None:
            self.waiting[token] = (run, last)
            return None
        entry = self.entries[original]
        if at[0] >= entry[1]:
            return None
        entry[1] = max(entry[1], last[0] + self.idle)
        return original


FOLDED = "session string, type string, what string, run long, token string, original string, made boolean, from_t long, from_seq long"


def settled(events: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Touches and restores of events (session, ts, seq, type, original, kind, token) with what became of them: session, ts, seq, type, original, token, and made, whether the touch made the alias.

    A touch has the alias that it made or renewed. A restore has the original of its alias if that lived, which it
    renewed; else null.
    """
    idle = idle_seconds * 1_000_000
    clear = F.col("type") == CLEAR
    what = F.when(F.col("type") == TOUCH, F.col("original")).when(F.col("type") == RESTORE, F.col("token"))
    e = events.select(F.col("session").cast("string").alias("session"), "ts", micros(F.col("ts")).alias("t"), F.col("seq").cast("long").alias("seq"), "type", "kind", what.alias("what"))
    e = running(e, ["session"], [F.col("t"), ~clear], last={"cleared": F.when(clear, F.col("t"))})
    own = Window.partitionBy("session", "type", "what").orderBy("t", "seq")
    e = e.where("what IS NOT NULL").withColumn("_last", F.lag("t").over(own))
    fresh = F.col("_last").isNull() | (F.col("t") - F.col("_last") >= idle) | F.coalesce(F.col("cleared") > F.col("_last"), F.lit(False))
    e = materialize(e.withColumn("run", F.sum(fresh.cast("long")).over(own)).drop("_last", "cleared"), "runs")
    at = F.struct("t", "seq")
    runs = e.groupBy("session", "type", "what", "run").agg(F.min(at).alias("a"), F.max(at).alias("z"), F.min_by("kind", at).alias("kind"))
    runs = runs.select("session", "a.*", "type", "what", "kind", "run", F.col("z.t").alias("last_t"), F.col("z.seq").alias("last_seq"))
    clears = events.where(clear).select(F.col("session").cast("string").alias("session"), micros(F.col("ts")).alias("t")).distinct().withColumn("type", F.lit(CLEAR))
    rows = runs.unionByName(clears, allowMissingColumns=True)
    names = ["session", "type", "what", "run", "token", "original", "made", "from_t", "from_seq"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
    columns = ["session", "t", "seq", "type", "what", "kind", "run", "last_t", "last_seq"]

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, live = (), None
        for b in it:
            out = []
            for session, t, seq, type_, what, kind, run, last_t, last_seq in zip(*(b[c].to_pylist() for c in columns), strict=True):
                if of != (session,):
                    of, live = (session,), Live(idle)
                live.sweep(t)
                if type_ == CLEAR:
                    live.clear()
                    continue
                order, last = (t, seq if seq is not None else -(1 << 63)), (last_t, last_seq if last_seq is not None else -(1 << 63))
                if type_ == TOUCH:
                    token, made, waited = live.touch(order, what, kind, last)
                    out.append((session, TOUCH, what, run, token, what, made, t, seq))
                    if waited:
                        out.append((session, RESTORE, token, waited[0], token, what, False, t, seq))
                elif original := live.restore(order, what, run, last):
                    out.append((session, RESTORE, what, run, what, original, False, t, seq))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    inner = rows.repartition("session").sortWithinPartitions("session", "t", F.col("type") != CLEAR, "seq", "type", "what").select(*columns).mapInArrow(fold, FOLDED)
    f = inner.select(*[F.col(c).alias(f"_{c}") for c in names])
    same = F.col("session").eqNullSafe(F.col("_session")) & (F.col("type") == F.col("_type")) & (F.col("what") == F.col("_what")) & (F.col("run") == F.col("_run"))
    after = F.struct("t", "seq") >= F.struct("_from_t", "_from_seq")
    touch = F.col("type") == TOUCH
    return e.join(f, same, "left").select(
        "session", "ts", "seq", "type", F.when(touch, F.col("what")).when(after, F.col("_original")).alias("original"), F.when(touch, F.col("_token")).otherwise(F.col("what")).alias("token"),
        (touch & F.col("_made") & (F.col("t") == F.col("_from_t")) & F.col("seq").eqNullSafe(F.col("_from_seq"))).alias("made"),
    )


def within_capacity(calls: DataFrame, most: int = MAX_LIVE, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """session, ts, seq, type and status of calls (session, ts, seq, type, originals): ok, or that the limit of live entries was reached.

    type: protect (originals are touched, or made, in this order, or none of them), restore (those that live are
    renewed) or clear.
    """
    idle = idle_seconds * 1_000_000
    clear = F.col("type") == CLEAR
    c = calls.select(F.col("session").cast("string").alias("session"), "ts", micros(F.col("ts")).alias("t"), F.col("seq").cast("long").alias("seq"), "type", F.array_distinct(F.filter("originals", lambda x: x.isNotNull())).alias("originals"))
    order = [F.col("t"), ~clear, F.col("seq")]
    c = running(c, ["session"], order, previous={"before": F.col("t")})
    fresh = F.col("before").isNull() | (F.col("t") - F.col("before") >= idle) | clear
    c = materialize(running(c, ["session"], order, total={"part": fresh.cast("long")}), "calls")
    sums = c.groupBy("session", "part").agg(F.sum(F.when(F.col("type") == PROTECT, F.coalesce(F.size("originals"), F.lit(0))).otherwise(0)).alias("_most"))
    sums = sums.select(F.col("session").alias("_s"), F.col("part").alias("_p"), "_most")
    c = c.join(sums, F.col("session").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
    columns = ["session", "part", "t", "seq", "type", "originals"]

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, live = None, OrderedDict()  # original: last touch, the oldest first
        for b in it:
            status = []
            for session, part, t, _, type_, originals in zip(*(b[x].to_pylist() for x in columns), strict=True):
                if of != (session, part):
                    of, live = (session, part), OrderedDict()
                while live and t - next(iter(live.values())) >= idle:
                    live.popitem(last=False)
                ok = True
                if type_ == PROTECT:
                    ok = len(live) + sum(o not in live for o in originals or ()) <= most
                if ok and type_ in (PROTECT, RESTORE):
                    for o in originals or ():
                        if type_ == PROTECT or o in live:
                            live[o] = t
                            live.move_to_end(o)
                status.append(OK if ok else LIMIT)
            yield pa.RecordBatch.from_arrays([b["session"], b["ts"], b["seq"], b["type"], pa.array(status, pa.string())], ["session", "ts", "seq", "type", "status"])

    crowded = c.where(F.col("_most") > most).select(*columns, "ts").repartition("session", "part").sortWithinPartitions("session", "part", "t", F.col("type") != CLEAR, "seq")
    kind = c.schema["ts"].dataType.simpleString()
    judged = crowded.mapInArrow(fold, f"session string, ts {kind}, seq long, type string, status string")
    return c.where(F.col("_most") <= most).select("session", "ts", "seq", "type", F.lit(OK).alias("status")).unionByName(judged)
