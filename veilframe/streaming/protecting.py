"""Protecting a stream of texts: aliases as state, idle ones expire, counters don't.

Each session is a group of transformWithStateInPandas: a map state from original to alias with a time to live, renewed
at each use - a protected or a restored text - and a map state of counters without one. A call's op is protect, restore
or clear, which drops the aliases and keeps the counters; where the stream has no op, all calls protect. A text is protected in the order of its arrival; one that would
bring a session over its capacity changes nothing and is refused. Batch operators find the spans before the state is
asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.patterns import ALIAS, IDLE_SECONDS, MAX_LIVE
from ..functions.spans import FOUND, find_all
from ..operators.detect import OK, TOO_LARGE, with_spans
from ..operators.rules import Rules

#: Letters of ASCII in upper case.
UPPER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
OUT = "session string, seq long, text string, status string, count int"


class Aliasing(StatefulProcessor):
    """State of one session."""

    def __init__(self, idle_seconds: int = IDLE_SECONDS, most: int = MAX_LIVE):
        self.idle_ms, self.most = idle_seconds * 1000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.aliases = handle.getMapState("aliases", "original string", "token string", self.idle_ms)
        self.counters = handle.getMapState("counters", "kind string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        live = {k[0]: v[0] for k, v in self.aliases.iterator()}
        counts = {k[0]: v[0] for k, v in self.counters.iterator()}
        for part in rows:
            out = []
            for r in part.sort_values("seq", kind="stable").itertuples(index=False):
                if r.op == "clear":
                    self.aliases.clear()
                    live = {}
                    out.append((key[0], r.seq, None, OK, 0))
                    continue
                if r.op == "restore":
                    if r.status == TOO_LARGE:
                        out.append((key[0], r.seq, None, r.status, None))
                        continue
                    of, pieces, at, known = {t: o for o, t in live.items()}, [], 0, 0
                    for m in r.marks:
                        original = of.get(r.text[m["start"] : m["end"]].translate(UPPER))
                        if original is not None:
                            pieces += [r.text[at : m["start"]], original]
                            at, known = m["end"], known + 1
                            self.aliases.updateValue((original,), (live[original],))
                    out.append((key[0], r.seq, "".join(pieces) + r.text[at:], OK, known))
                    continue
                if r.status != OK:
                    out.append((key[0], r.seq, None, r.status, None))
                    continue
                made, now, used, pieces, at = {}, dict(counts), set(), [], 0
                for s in r.spans:
                    original = r.text[s["start"] : s["end"]]
                    token = live.get(original) or made.get(original)
                    if token is None:
                        kind = s["kind"].upper()
                        now[kind] = now.get(kind, 0) + 1
                        token = made[original] = f"{kind}_{now[kind]}"
                    used.add(original)
                    pieces += [r.text[at : s["start"]], token]
                    at = s["end"]
                if len(live) + len(made) > self.most:
                    out.append((key[0], r.seq, None, "mapping_limit_reached", None))
                    continue
                live.update(made)
                for kind, n in now.items():
                    if n != counts.get(kind):
                        self.counters.updateValue((kind,), (n,))
                counts = now
                for original in used:  # a write renews the time to live
                    self.aliases.updateValue((original,), (live[original],))
                out.append((key[0], r.seq, "".join(pieces) + r.text[at:], OK, len(r.spans)))
            yield pd.DataFrame(out, columns=["session", "seq", "text", "status", "count"])

    def close(self) -> None:
        pass


def protect_stream(texts: DataFrame, rules: Rules = Rules(), idle_seconds: int = IDLE_SECONDS, most: int = MAX_LIVE) -> DataFrame:
    """A stream (session, seq, text, and op where it has one) protected, restored and cleared; needs the RocksDB state store. count: spans replaced, or aliases put back."""
    op = F.col("op") if "op" in texts.columns else F.lit("protect")
    rows = texts.select("session", "seq", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(op, F.lit("protect")).alias("op"))
    marks = F.when(F.col("op") == "restore", find_all(F.col("text"), ALIAS)).otherwise(F.expr(f"cast(array() as {FOUND})"))
    found = with_spans(rows, rules).withColumn("marks", marks)
    return found.groupBy("session").transformWithStateInPandas(Aliasing(idle_seconds, most), outputStructType=OUT, outputMode="append", timeMode="processingTime")
