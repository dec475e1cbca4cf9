"""Sessions in time against a plain simulation, event by event; nothing left behind, and no name of a column in the way."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators import fold, protect, session
from veilframe.operators.rules import Rules
from veilframe.plans import storage

START = datetime.datetime(2024, 1, 1)
EVENTS = "session string, ts timestamp_ntz, seq long, type string, original string, kind string, token string"


class Simulated:
    """A session by a list of entries."""

    def __init__(self, idle):
        self.idle, self.live, self.counters, self.tokens = idle, [], {}, ["K0_1", "K0_2"]

    def step(self, ts, type_, original, kind, token):
        self.live = [] if type_ == "clear" else [e for e in self.live if ts - e["ts"] < self.idle]
        if type_ == "touch":
            e = next((e for e in self.live if e["o"] == original), None)
            made = e is None
            if made:
                self.counters[kind] = self.counters.get(kind, 0) + 1
                self.live.append(e := {"o": original, "t": f"{kind}_{self.counters[kind]}"})
                self.tokens += [e["t"], f"{kind}_{self.counters[kind] + 1}"]  # made, and yet to be made
            e["ts"] = ts
            return type_, original, e["t"], made
        if type_ == "restore":
            e = next((e for e in self.live if e["t"] == token), None)
            if e:
                e["ts"] = ts
            return type_, e and e["o"], token, False
        return None


def events(seed, n=1500):
    """Events in order, and what each finds."""
    rng = random.Random(seed)
    at, out, want = START, [], {}
    sessions = {s: Simulated(datetime.timedelta(minutes=30)) for s in ("a", None)}
    for i in range(n):
        at += datetime.timedelta(minutes=rng.choice([0, 1, 5, 10, 15, 30]))
        type_ = "clear" if rng.random() < 0.02 else rng.choice(["touch"] * 5 + ["restore"] * 8)
        at += datetime.timedelta(microseconds=type_ == "clear")  # clearings come first among events of one moment
        s = rng.choice(["a", None])
        row = (type_, f"o{rng.randrange(4)}", f"K{i // 300}", rng.choice(sessions[s].tokens[-8:]))
        out.append((s, at, i, *row))
        want[i] = sessions[s].step(at, *row)
    return out, {i: w for i, w in want.items() if w}


@pytest.mark.parametrize("seed", range(3))
def test_restores_renew_what_lives_and_nothing_else(spark, seed):
    rows, want = events(seed)
    df = spark.createDataFrame(rows, EVENTS).repartition(5)
    got = {r.seq: (r.type, r.original, r.token, r.made) for r in fold.settled(df).collect()}
    assert got == want
    hits = sum(w[0] == "restore" and w[1] is not None for w in want.values())
    assert 100 < hits < sum(w[0] == "restore" for w in want.values()) - 100


def test_a_run_of_restores_finds_an_alias_made_in_its_middle(spark):
    at = lambda m: START + datetime.timedelta(minutes=m)
    rows = [("s", at(m), m, "restore", None, None, "K_1") for m in (0, 20, 40, 60, 80)] + [("s", at(50), 50, "touch", "x", "k", None), ("s", at(109), 109, "touch", "x", "k", None), ("s", at(140), 140, "restore", None, None, "K_1")]
    got = {r.seq: (r.original, r.token) for r in fold.settled(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {0: (None, "K_1"), 20: (None, "K_1"), 40: (None, "K_1"), 50: ("x", "K_1"), 60: ("x", "K_1"), 80: ("x", "K_1"), 109: ("x", "K_1"), 140: (None, "K_1")}


def test_a_restore_after_expiry_makes_nothing(spark):
    at = lambda h: START + datetime.timedelta(hours=h)
    e = spark.createDataFrame([("s", at(10), 1, "touch", "x@y.zz", "EMAIL", None)], EVENTS)
    known = spark.createDataFrame([("s", "EMAIL_1", "x@y.zz", "EMAIL")], "session string, token string, original string, kind string")
    docs = spark.createDataFrame([(5, "s", at(12), "to EMAIL_1")], "doc_id long, s string, at timestamp_ntz, text string")
    asked = protect.restore_touches(docs, known, "at", session="s")
    every = e.unionByName(asked)
    assert [(r.token, str(r.last_touch)) for r in session.lives(every).collect()] == [("EMAIL_1", "2024-01-01 10:00:00")]
    assert {r.seq: r.original for r in fold.settled(every).collect()} == {1: "x@y.zz", 5: None}
    back = protect.restore_asof(docs, session.touched(e), every.where("type = 'clear'"), "at", session="s").first()
    assert (back.text, back.known, back.unknown, back.unknown_tokens) == ("to EMAIL_1", 0, 1, ["EMAIL_1"])


def test_restores_as_of_a_moment(spark):
    at = lambda m: None if m is None else START + datetime.timedelta(minutes=m)
    touches = spark.createDataFrame([("s", "A_1", "one", at(0)), ("s", "A_1", "one", at(20)), (None, "A_1", "other", at(0))], "session string, token string, original string, ts timestamp_ntz")
    clears = spark.createDataFrame([(None, at(10))], "session string, ts timestamp_ntz")
    cases = [("s", -1, False), ("s", 0, True), ("s", 29, True), ("s", 49, True), ("s", 50, False), (None, 9, True), (None, 10, False), (None, 11, False), ("t", 5, False), ("s", None, False)]
    docs = spark.createDataFrame([(i, s, at(m), "a_1 A_01") for i, (s, m, _) in enumerate(cases)], "doc_id long, s string, at timestamp_ntz, text string")
    got = {r.doc_id: r for r in protect.restore_asof(docs, touches, clears, "at", session="s").collect()}
    assert [got[i].known for i in range(len(cases))] == [int(k) for *_, k in cases]
    assert got[2].text == "one A_01" and got[5].text == "other A_01" and got[4].text == "a_1 A_01"
    assert protect.restore_asof(docs.limit(0), touches, clears, "at", session="s").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_calls_over_the_limit_fail_whole(spark, seed):
    rng = random.Random(seed)
    rows, at = [], START
    for i in range(900):
        at += datetime.timedelta(minutes=rng.choice([0, 1, 2, 5, 12, 31]))
        rows.append((rng.choice(["a", "a", "a", "b", None]), at, i, rng.choice(["protect"] * 7 + ["restore", "clear"]), rng.choices(["p", "q", "r", "u", "v", "w", "x", None], k=rng.randrange(4)) or None))
    idle = datetime.timedelta(minutes=30)
    want, state = {}, {}
    for s, ts, seq, type_, originals in sorted(rows, key=lambda r: (r[1], r[3] != "clear", r[2])):
        live = {o: t for o, t in state.get(s, {}).items() if ts - t < idle}
        status, trial = "ok", dict(live)  # touches are made on a copy, which a failing call throws away
        for o in originals or []:
            if o is None:
                continue
            if type_ == "protect" and o not in trial and len(trial) >= 4:
                status = "mapping_limit_reached"
                break
            if type_ == "protect" or (type_ == "restore" and o in trial):
                trial[o] = ts
        state[s] = {} if type_ == "clear" else trial if status == "ok" else live
        want[seq] = status
    df = spark.createDataFrame(rows, "session string, ts timestamp_ntz, seq long, type string, originals array<string>").repartition(4)
    got = {r.seq: r.status for r in fold.within_capacity(df, most=4).collect()}
    assert got == want
    assert 20 < list(want.values()).count("mapping_limit_reached") < 700


def test_the_limit_of_the_specification(spark):
    many = [("s", START, 0, "protect", [f"item-{i}" for i in range(9_999)])]
    rows = [*many, ("s", START, 1, "protect", ["one@example.com", "two@example.com"]), ("s", START, 2, "protect", ["one@example.com"]), ("s", START, 3, "protect", ["two@example.com"])]
    df = spark.createDataFrame(rows, "session string, ts timestamp_ntz, seq long, type string, originals array<string>")
    assert [r.status for r in fold.within_capacity(df).orderBy("seq").collect()] == ["ok", "mapping_limit_reached", "ok", "mapping_limit_reached"]


def test_folds_of_empty_tables(spark):
    e = spark.createDataFrame([], EVENTS)
    assert fold.settled(e).count() == 0
    assert fold.within_capacity(e.withColumn("originals", F.array("original"))).count() == 0


CLASHING = ["spans", "_row", "_pieces", "_session", "_seq", "_tie", "_doc", "_text", "_status", "row", "session", "token", "original", "a b"]


def test_columns_of_any_name_pass_through(spark):
    d = spark.createDataFrame([(1, "to a@b.io"), (2, None), (3, "x EMAIL_1")], "doc_id long, text string").select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHING])
    shown, made = protect.protect(d)
    assert [c for c in shown.columns if c in d.columns] == d.columns
    got = {r.doc_id: r for r in shown.collect()}
    assert got[1].text == "to EMAIL_1" and got[2].text is None and got[3].text is None
    assert all(r[c] == f"mine {c}" for r in got.values() for c in CLASHING)
    back = {r.doc_id: r for r in protect.restore(d.withColumn("text", F.lit("see EMAIL_1")), made).collect()}
    assert all(r.text == "see a@b.io" and r[c] == f"mine {c}" for r in back.values() for c in CLASHING)


def test_nothing_written_stays_after_scratch(spark):
    folder = storage.shared_dir(spark).removeprefix("file://")
    was = set(os.listdir(folder))
    with storage.scratch(spark):
        d = spark.createDataFrame([(1, "to a@b.io"), (2, "and c@d.io")], "doc_id long, text string")
        shown, made = protect.protect(d, Rules())
        rows = shown.select("doc_id", "text").collect()
        back = protect.restore(spark.createDataFrame(rows), made).collect()
        assert set(os.listdir(folder)) > was
    assert sorted(r.text for r in back) == ["and c@d.io", "to a@b.io"]
    assert set(os.listdir(folder)) == was
    with pytest.raises(ZeroDivisionError), storage.scratch(spark):
        storage.materialize(spark.range(3), "x")
        raise ZeroDivisionError
    assert set(os.listdir(folder)) == was
