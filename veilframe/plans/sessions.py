"""Queries of sessions in time: restores as of a moment, restores that renew, the limit of live aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fold, protect, session
from . import storage
from .queries import _SQL_EPOCHS, _touches, query, table

_ASOF = f"""{_SQL_EPOCHS},
l AS (SELECT session, original, epoch, min(event_id) AS e0, arg_min(kind, event_id) AS kind FROM ep GROUP BY 1, 2, 3),
n AS (SELECT *, kind || '_' || CAST(row_number() OVER (PARTITION BY session, kind ORDER BY e0) AS STRING) AS token FROM l),
u AS (SELECT ep.session, n.token, ep.original, ep.ts, ep.event_id FROM ep JOIN n USING (session, original, epoch))"""


@query(f"""WITH {_ASOF},
d AS (SELECT event_id, session, ts + to_minutes(CAST(event_id % 45 AS INT)) AS ts, token FROM u),
a AS (SELECT d.event_id, d.session, d.ts, d.token, u.original, u.ts AS touched FROM d ASOF LEFT JOIN u ON d.session = u.session AND d.token = u.token AND d.ts >= u.ts),
k AS (SELECT a.*, c.ts AS cleared FROM a ASOF LEFT JOIN c ON a.session = c.session AND a.ts >= c.ts),
r AS (SELECT *, ts - touched < INTERVAL 30 MINUTE AND NOT coalesce(cleared > touched, false) AS known FROM k)
SELECT event_id, 're ' || CASE WHEN known THEN original ELSE lower(token) END || ', not NO_1' AS text, CAST(CASE WHEN known THEN 1 ELSE 0 END AS INT) AS known, CAST(CASE WHEN known THEN 1 ELSE 2 END AS INT) AS unknown FROM r""")
def restore_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with the alias of each event's user, restored some time later: what has expired or was cleared by then stays."""
    e = _touches(spark, sf)
    touches = session.touched(e)
    later = F.col("ts") + F.make_dt_interval(mins=(F.col("seq") % 45).cast("int"))
    docs = touches.select(F.col("seq").alias("event_id"), F.col("session").alias("s"), later.alias("at"), F.concat(F.lit("re "), F.lower("token"), F.lit(", not NO_1")).alias("text"))
    return protect.restore_asof(docs, touches, e.where("type = 'clear'"), "at", session="s").select("event_id", "text", "known", "unknown")


_FOLD = """SELECT CAST(user_id % 4 AS STRING) AS session, ts, event_id AS seq, CASE WHEN event_type = 'signup' AND event_id % 10 = 0 THEN 'clear' WHEN event_type IN ('view', 'error') THEN 'restore' ELSE 'touch' END AS type,
'u' || CAST(user_id % 3 AS STRING) AS original, 'D' || CAST(day(ts) AS STRING) AS kind,
'D' || CAST(day(ts) AS STRING) || '_' || CAST(CAST(floor(0.4 * row_number() OVER (PARTITION BY user_id % 4, day(ts) ORDER BY ts, event_id)) AS BIGINT) + event_id % 3 AS STRING) AS token FROM events"""


@query(f"""WITH RECURSIVE ev AS ({_FOLD}),
o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, type <> 'clear', seq) AS rn FROM ev),
f AS (SELECT session, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(o VARCHAR, t VARCHAR, x TIMESTAMP)[]) AS live, CAST('' AS VARCHAR) AS kind, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS original, CAST(NULL AS VARCHAR) AS token, false AS made FROM (SELECT DISTINCT session FROM o)
UNION ALL
SELECT session, rn, CASE WHEN type = 'clear' THEN [] WHEN made THEN list_append(live, {{'o': original, 't': token, 'x': ts + INTERVAL 30 MINUTE}})
    ELSE list_transform(live, lambda e: CASE WHEN e.t = token THEN {{'o': e.o, 't': e.t, 'x': ts + INTERVAL 30 MINUTE}} ELSE e END) END, kind, n, seq, original, token, made
FROM (SELECT session, rn, type, live, kind, ts, seq, made, CASE WHEN made THEN n + 1 ELSE n END AS n, CASE WHEN type = 'restore' THEN hit.o ELSE original END AS original, CASE WHEN type = 'restore' THEN token WHEN made THEN kind || '_' || CAST(n + 1 AS STRING) ELSE hit.t END AS token
    FROM (SELECT *, list_filter(live, lambda e: CASE WHEN type = 'restore' THEN e.t = token ELSE e.o = original END)[1] AS hit, type = 'touch' AND len(list_filter(live, lambda e: e.o = original)) = 0 AS made
        FROM (SELECT o.session, o.rn, o.type, o.original, o.kind, o.token, o.ts, o.seq, CASE WHEN o.kind = f.kind THEN f.n ELSE 0 END AS n, list_filter(f.live, lambda e: o.ts < e.x) AS live FROM f JOIN o ON o.session = f.session AND o.rn = f.rn + 1))))
SELECT f.session, f.seq, ev.type, f.original, f.token, f.made FROM f JOIN ev ON ev.session = f.session AND ev.seq = f.seq WHERE ev.type <> 'clear'""")
def restore_touches_live(spark: SparkSession, sf: str) -> DataFrame:
    """Touches and restores in one life: a restore renews what lives and finds nothing else, and what it renewed is not made again."""
    e = table(spark, sf, "events").selectExpr("cast(user_id % 4 as string) AS session", "ts", "event_id AS seq", "event_type", "concat('u', user_id % 3) AS original", "day(ts) AS d",
        "row_number() OVER (PARTITION BY user_id % 4, day(ts) ORDER BY ts, event_id) AS r")
    e = e.selectExpr("session", "ts", "seq", "CASE WHEN event_type = 'signup' AND seq % 10 = 0 THEN 'clear' WHEN event_type IN ('view', 'error') THEN 'restore' ELSE 'touch' END AS type",
        "original", "concat('D', d) AS kind", "concat('D', d, '_', cast(floor(0.4 * r) as bigint) + seq % 3) AS token")
    return fold.settled(e).select("session", "seq", "type", "original", "token", "made")


_CALLS = """SELECT CAST(user_id % 3 AS STRING) AS session, ts, event_id AS seq, CASE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'clear' WHEN event_type = 'error' THEN 'restore' ELSE 'protect' END AS type,
{} AS originals FROM events"""
_ORIGINALS = "'u' || CAST(user_id % 50 AS STRING)", "'w' || CAST(event_id % 4 AS STRING)", "'x' || CAST(event_id % 3 AS STRING)"


@query(f"""WITH RECURSIVE ev AS ({_CALLS.format(f"[{', '.join(_ORIGINALS)}]")}),
o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, type <> 'clear', seq) AS rn FROM ev),
f AS (SELECT session, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(o VARCHAR, x TIMESTAMP)[]) AS live, CAST(NULL AS BIGINT) AS seq, true AS ok FROM (SELECT DISTINCT session FROM o)
UNION ALL
SELECT session, rn, CASE WHEN type = 'clear' THEN [] WHEN NOT ok THEN live ELSE list_concat(list_filter(live, lambda e: NOT list_contains(originals, e.o)),
    list_transform(list_filter(originals, lambda v: type = 'protect' OR list_contains(list_transform(live, lambda e: e.o), v)), lambda v: {{'o': v, 'x': ts + INTERVAL 30 MINUTE}})) END, seq, ok
FROM (SELECT *, type <> 'protect' OR len(live) + len(list_filter(originals, lambda v: NOT list_contains(list_transform(live, lambda e: e.o), v))) <= 6 AS ok
    FROM (SELECT o.session, o.rn, o.type, o.originals, o.ts, o.seq, list_filter(f.live, lambda e: o.ts < e.x) AS live FROM f JOIN o ON o.session = f.session AND o.rn = f.rn + 1)))
SELECT session, seq, CASE WHEN ok THEN 'ok' ELSE 'mapping_limit_reached' END AS status FROM f WHERE rn > 0""")
def alias_capacity_atomic(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of three originals each in sessions of at most six live ones: those that fail leave nothing behind but what had expired."""
    calls = table(spark, sf, "events").selectExpr("cast(user_id % 3 as string) AS session", "ts", "event_id AS seq", "CASE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'clear' WHEN event_type = 'error' THEN 'restore' ELSE 'protect' END AS type",
        "array(concat('u', user_id % 50), concat('w', event_id % 4), concat('x', event_id % 3)) AS originals")
    return fold.within_capacity(calls, most=6).select("session", "seq", "status")


@query("""SELECT seq, token, original FROM (SELECT c_custkey AS seq, 'EMAIL_' || CAST(c_custkey AS STRING) AS token, c_name || ' ' || c_mktsegment AS original FROM customer)
WHERE contains(lower(concat_ws(' ', token, 'EMAIL', 'Email', original)), 'mer#00000') ORDER BY seq LIMIT 50 OFFSET 50""")
def mapping_search_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of a search of all customers' mappings, by an index of their grams."""
    m = table(spark, sf, "customer").selectExpr("'all' AS session", "c_custkey AS seq", "0 AS ord", "concat('EMAIL_', c_custkey) AS token", "'EMAIL' AS kind", "concat(c_name, ' ', c_mktsegment) AS original")
    path = storage.new_path(spark, "index")
    session.write_search_index(m, path)
    first = session.search_pages(spark, path, "MER#00000")
    last = first.orderBy(F.desc("seq")).first()
    return session.search_pages(spark, path, "MER#00000", after=tuple(last[:4]) if last else None).select("seq", "token", "original")
