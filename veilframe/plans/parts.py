"""Queries of sources, rules, images, names and sessions, and SQL that gives the same rows. Registered beside those of queries.py."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import all_spans, never_found, resolved
from ..operators import aliases, audit, images, layout, names, protect, rules, screenshots, session
from ..operators.rules import Rules
from ..sources import readers
from .queries import _SQL_ALIASES, _SQL_EPOCHS, _spans, _touches, documents, query, table
from .storage import spread

# --- resolution and protection ----------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT l_orderkey, l_partkey % 50 AS a, l_partkey % 50 + 1 + l_suppkey % 9 AS b FROM lineitem WHERE NOT (l_partkey % 50 >= 10 AND l_partkey % 50 + 1 + l_suppkey % 9 <= 30)),
m AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR a >= before THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT l_orderkey, CAST(min(a) AS INT) AS start, CAST(max(b) AS INT) AS stop FROM i GROUP BY l_orderkey, island
""")
def res_never(spark: SparkSession, sf: str) -> DataFrame:
    """Spans inside a never-term go before the others are merged."""
    never = F.expr("array(named_struct('start', 10, 'end', 30, 'value', 'x'))")
    e = _spans(spark, sf).select("l_orderkey", F.explode(resolved(F.col("spans"), never)).alias("s"))
    return e.select("l_orderkey", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


@query("""
WITH t AS (SELECT c_custkey, length(concat('mail a', CAST(c_custkey AS STRING), '@ex.com or ')) AS q, length(CAST(c_custkey AS STRING)) AS n, c_custkey % 10 AS b FROM customer)
SELECT c_custkey, CAST(5 AS INT) AS start, CAST(13 + n AS INT) AS stop FROM t UNION ALL SELECT c_custkey, CAST(q AS INT), CAST(q + 9 AS INT) FROM t WHERE b > 4
""")
def never_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Of 500 never-terms five occur, in another case."""
    text = F.concat(F.lit("mail a"), F.col("c_custkey").cast("string"), F.lit("@ex.com or b"), (F.col("c_custkey") % 10).cast("string"), F.lit("@ex.com"))
    terms = [f"B{i}@EX.com" for i in range(5)] + [f"unheard term {i}" for i in range(495)]
    df = spread(table(spark, sf, "customer")).select("c_custkey", text.alias("text"))
    e = df.select("c_custkey", F.explode(resolved(all_spans(F.col("text"), kinds={"EMAIL"}), never_found(F.col("text"), terms))).alias("s"))
    return e.select("c_custkey", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


@query(f"WITH {_SQL_ALIASES} SELECT id AS doc_id, token, v AS original, kind FROM al")
def protect_mappings(spark: SparkSession, sf: str) -> DataFrame:
    """The aliases that each call made."""
    shown = protect.protect(documents(spark, sf, "doc_id", "text"))[0]
    return shown.select("doc_id", F.explode("mappings").alias("m")).select("doc_id", "m.token", "m.original", "m.kind")


_AWKWARD = "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey / 10 AS BIGINT) END"


@query(f"""
WITH t AS (SELECT {_AWKWARD.replace("c_custkey / 10", "c_custkey // 10")} AS call, concat('no ', CAST(c_custkey AS STRING), ': a', CAST(c_custkey % 7 AS STRING), '@ex.com b', CAST(c_custkey % 5 AS STRING), '@ex.com') AS text, c_custkey % 7 AS a, c_custkey % 5 AS b FROM customer),
o AS (SELECT *, row_number() OVER (ORDER BY call NULLS LAST, substr(md5(text), 1, 16)) AS n FROM t),
e AS (SELECT 'a' || a AS v, n * 2 AS q FROM o UNION ALL SELECT 'b' || b, n * 2 + 1 FROM o),
al AS (SELECT v, 'EMAIL_' || CAST(row_number() OVER (ORDER BY min(q)) AS STRING) AS token FROM e GROUP BY v)
SELECT o.call, regexp_extract(text, '^no [0-9]+: ') || x.token || ' ' || y.token AS text, 'ok' AS status, CAST(2 AS INT) AS count FROM o JOIN al x ON x.v = 'a' || a JOIN al y ON y.v = 'b' || b
""")
def protect_awkward(spark: SparkSession, sf: str) -> DataFrame:
    """Calls that share a number, or have none, are protected each for itself."""
    key = "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey div 10 END AS call"
    text = "concat('no ', c_custkey, ': a', c_custkey % 7, '@ex.com b', c_custkey % 5, '@ex.com') AS text"
    return protect.protect(spread(table(spark, sf, "customer")).selectExpr(key, text), seq="call")[0].select("call", "text", "status", "count")


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE strlen(text) <= 100000")
def restore_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Every accepted document, protected and restored."""
    shown, made = protect.protect(documents(spark, sf, "doc_id", "text"))
    return protect.restore(shown.where("status = 'ok'").select("doc_id", "text"), made).select("doc_id", F.md5("text").alias("digest"))


@query("SELECT session, CAST(o_orderkey AS BIGINT) AS seq FROM (SELECT CAST(o_custkey % 5 AS STRING) AS session, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS n FROM orders) WHERE n = 101")
def alias_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """The call of each session that would make one alias too many."""
    found = table(spark, sf, "orders").selectExpr("cast(o_custkey % 5 as string) AS session", "o_orderkey AS seq", "'' AS tie", "0 AS ord", "'EMAIL' AS kind", "concat('u', o_orderkey) AS original")
    return aliases.over_capacity(aliases.assign(found), 100)


@query("SELECT CAST(c_custkey % 4 AS STRING) AS session, c_custkey AS seq, 'user' || CAST(c_custkey % 9 AS STRING) AS original FROM customer WHERE c_custkey % 9 BETWEEN 1 AND 5")
def restore_touches(spark: SparkSession, sf: str) -> DataFrame:
    """What restoring touches."""
    docs = table(spark, sf, "customer").selectExpr("cast(c_custkey % 4 as string) AS s", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "c_custkey", "concat('to email_', c_custkey % 9, ' or PERSON_1') AS text")
    known = spark.range(20).selectExpr("cast(id % 4 as string) AS session", "concat('EMAIL_', 1 + id div 4) AS token", "concat('user', 1 + id div 4) AS original", "'EMAIL' AS kind")
    return protect.restore_touches(docs, known, "ts", session="s", seq="c_custkey").select("session", "seq", "original")


@query(f"""WITH {_SQL_EPOCHS}, l AS (SELECT session, original, epoch, max(ts) AS last_touch, min(event_id) AS e0, arg_min(kind, event_id) AS kind FROM ep WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1, 2, 3),
n AS (SELECT *, kind || '_' || CAST(row_number() OVER (PARTITION BY session, kind ORDER BY e0) AS STRING) AS token FROM l)
SELECT session, token, original, CAST(row_number() OVER (PARTITION BY session ORDER BY e0) AS INT) AS nth FROM n
WHERE TIMESTAMP '2024-01-15 12:00:00' - last_touch < INTERVAL 30 MINUTE AND NOT EXISTS (SELECT 1 FROM c WHERE c.session = n.session AND c.ts >= n.last_touch AND c.ts <= TIMESTAMP '2024-01-15 12:00:00')""")
def session_list(spark: SparkSession, sf: str) -> DataFrame:
    """Live entries in the order in which they were made."""
    now = "2024-01-15 12:00:00"
    e = _touches(spark, sf).where(F.col("ts") <= F.lit(now).cast("timestamp_ntz"))
    live = session.live_at(session.lives(e), e.where("type = 'clear'"), now)
    per = session.listed(live).groupBy("session").agg(F.collect_list(F.struct("token", "original")).alias("l"))
    return per.select("session", F.posexplode("l").alias("p", "x")).select("session", "x.token", "x.original", (F.col("p") + 1).alias("nth"))


# --- rules ------------------------------------------------------------------------------------------------------------

_TERM = "CASE WHEN p_partkey % 11 = 0 THEN '  ' WHEN p_partkey % 13 = 0 THEN upper(p_name) WHEN p_partkey % 17 = 0 THEN concat('  ', p_name, ' ') ELSE p_name END"


def _terms(spark: SparkSession, sf: str, where: str = "true") -> DataFrame:
    return table(spark, sf, "part").where(where).selectExpr("p_brand AS list_id", "p_partkey AS pos", f"{_TERM} AS term")


@query(f"SELECT list_id, pos, term FROM (SELECT p_brand AS list_id, p_partkey AS pos, trim({_TERM}) AS term, row_number() OVER (PARTITION BY p_brand, lower(trim({_TERM})) ORDER BY p_partkey) AS r FROM part) WHERE r = 1 AND term <> ''")
def rules_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The terms that each brand's list keeps."""
    return rules.cleaned_lists(_terms(spark, sf))


@query(f"SELECT list_id, CASE WHEN bool_or(length(t) NOT BETWEEN 2 AND 200) THEN 'bad_length' WHEN count(DISTINCT t) > 500 THEN 'bad_number' ELSE 'ok' END AS status, CAST(count(DISTINCT t) AS BIGINT) AS terms FROM (SELECT CASE WHEN p_size % 3 = 0 THEN 'all' ELSE p_brand END AS list_id, lower(trim(concat({_TERM}, CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey AS STRING) ELSE '' END, CASE WHEN p_partkey % 97 = 1 THEN repeat('x', 200) ELSE '' END))) AS t FROM part) WHERE t <> '' GROUP BY list_id")
def rules_status(spark: SparkSession, sf: str) -> DataFrame:
    """Lists that are refused whole: a term too long, or too many of them."""
    t = f"concat({_TERM}, CASE WHEN p_size % 3 = 0 THEN cast(p_partkey as string) ELSE '' END, CASE WHEN p_partkey % 97 = 1 THEN repeat('x', 200) ELSE '' END)"
    return rules.list_status(table(spark, sf, "part").selectExpr("CASE WHEN p_size % 3 = 0 THEN 'all' ELSE p_brand END AS list_id", "p_partkey AS pos", f"{t} AS term"))


@query(f"WITH t AS (SELECT p_brand AS list_id, lower(trim({_TERM})) AS t, p_size % 5 = 0 AS n FROM part) SELECT DISTINCT list_id, EXISTS (SELECT 1 FROM t a JOIN t b ON a.list_id = b.list_id AND a.t = b.t WHERE a.list_id = x.list_id AND NOT a.n AND b.n AND a.t <> '') AS conflict FROM t x WHERE NOT n")
def rules_conflict(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of which a term is in the other list as well."""
    return rules.conflicts(_terms(spark, sf, "p_size % 5 <> 0"), _terms(spark, sf, "p_size % 5 = 0"))


@query(f"WITH t AS (SELECT p_brand AS list_id, p_partkey AS pos, trim({_TERM}) AS term, p_size % 5 = 0 AS n FROM part) SELECT list_id, pos, term FROM (SELECT *, row_number() OVER (PARTITION BY list_id, lower(term) ORDER BY pos) AS r FROM t WHERE n AND term <> '') x WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM t d WHERE NOT d.n AND d.list_id = x.list_id AND lower(d.term) = lower(x.term))")
def rules_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Never-terms that hold beside draft terms."""
    return rules.without_drafts(_terms(spark, sf, "p_size % 5 = 0"), _terms(spark, sf, "p_size % 5 <> 0"))


@query("SELECT c_custkey, CASE WHEN length(t) NOT BETWEEN 2 AND 200 THEN 'length' WHEN lower(t) IN ('building', 'machinery') THEN 'own' WHEN lower(t) = 'furniture' THEN 'other' END AS problem FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'x' WHEN c_custkey % 7 = 1 THEN lower(c_mktsegment) ELSE c_mktsegment END AS t FROM customer)")
def rules_term_problem(spark: SparkSession, sf: str) -> DataFrame:
    """Why a term can't be added to a list."""
    t = table(spark, sf, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 7 = 0 THEN 'x' WHEN c_custkey % 7 = 1 THEN lower(c_mktsegment) ELSE c_mktsegment END AS t")
    return t.select("c_custkey", rules.term_problem(F.col("t"), ["Building", "machinery"], ["FURNITURE"]).alias("problem"))


# --- sources ----------------------------------------------------------------------------------------------------------

_URL = "CASE o_orderkey % 4 WHEN 0 THEN 'data:image/png;base64,' WHEN 1 THEN 'data:image/x-ms-bmp;base64,' WHEN 2 THEN 'data:text/plain;base64,' ELSE 'data:image/gif;base64,' END"


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN NULL ELSE p END AS payload, CASE WHEN o_orderkey % 4 <> 2 AND o_orderkey % 5 <> 0 THEN md5(CAST(o_orderkey AS STRING)) END AS content
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN substr(to_base64(CAST(md5(CAST(o_orderkey AS STRING)) AS BLOB)), 2) ELSE to_base64(CAST(md5(CAST(o_orderkey AS STRING)) AS BLOB)) END AS p FROM orders)
""")
def src_data_url(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of images' data URLs, and their bytes where they are sound base64."""
    b64 = "base64(cast(md5(cast(o_orderkey as string)) as binary))"
    url = table(spark, sf, "orders").selectExpr("o_orderkey", f"concat({_URL}, CASE WHEN o_orderkey % 5 = 0 THEN substr({b64}, 2) ELSE {b64} END) AS u")
    p = url.select("o_orderkey", readers.data_url_payload(F.col("u")).alias("payload"))
    return p.select("o_orderkey", "payload", readers.from_base64(F.col("payload")).cast("string").alias("content"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 4 = 3 AND c_custkey % 100 <> 99")
def src_selections(spark: SparkSession, sf: str) -> DataFrame:
    """Selected texts that aren't blank, hold no NUL and aren't too long."""
    t = "CASE c_custkey % 4 WHEN 0 THEN ' \\t\\n' WHEN 1 THEN concat('a', char(0), 'b') WHEN 2 THEN NULL ELSE IF(c_custkey % 100 = 99, repeat('x', 100001), c_name) END AS text"
    return readers.selections(table(spark, sf, "customer").selectExpr("c_custkey", t)).select("c_custkey")


@query("SELECT n_name AS piece, n_nationkey AS id FROM nation")
def src_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of a vocabulary by their lines' numbers."""
    return readers.vocabulary(table(spark, sf, "nation").selectExpr("n_nationkey AS line_no", "concat(' ', n_name, ' ') AS value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN md5(CAST(o_orderkey AS STRING)) END AS hex FROM orders")
def src_hex(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of hex digits of either case, null where their number is odd."""
    h = table(spark, sf, "orders").selectExpr("o_orderkey", "substr(upper(md5(cast(o_orderkey as string))), 1, 32 - CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS h")
    return h.select("o_orderkey", F.lower(F.hex(readers.bytes_of_hex(F.col("h")))).alias("hex"))


_PACKS = "('whole'), ('tampered'), ('missing'), ('extra'), ('short')"


@query(f"""
WITH f AS (SELECT pack, n_name AS name, CASE WHEN pack = 'tampered' AND n_nationkey = 3 THEN upper(n_name) || '!' WHEN pack = 'short' AND n_nationkey = 4 THEN '' ELSE n_name END AS content FROM nation, (VALUES {_PACKS}) p(pack) WHERE NOT (pack = 'missing' AND n_nationkey = 5)
  UNION ALL SELECT 'extra', 'more', 'x' UNION ALL SELECT 'unlisted', 'more', 'x'),
m AS (SELECT pack, n_name AS name, sha256(n_name) AS s, strlen(n_name) AS b FROM nation, (VALUES {_PACKS}, ('empty')) p(pack))
SELECT coalesce(m.pack, f.pack) AS pack, bool_and(coalesce(sha256(content) = s AND strlen(content) = b, false)) AS ok FROM m FULL JOIN f ON m.pack = f.pack AND m.name = f.name GROUP BY 1
""")
def manifest_check(spark: SparkSession, sf: str) -> DataFrame:
    """Packs whole, tampered with, lacking a file, with one more, with one emptied, without files and without a manifest."""
    packs = lambda *p: F.explode(F.array(*[F.lit(x) for x in p])).alias("pack")
    nation = table(spark, sf, "nation")
    some = nation.select(packs("whole", "tampered", "missing", "extra", "short"), "n_nationkey", "n_name")
    content = "CASE WHEN pack = 'tampered' AND n_nationkey = 3 THEN concat(upper(n_name), '!') WHEN pack = 'short' AND n_nationkey = 4 THEN '' ELSE n_name END"
    files = some.where("not (pack = 'missing' and n_nationkey = 5)").selectExpr("pack", "n_name AS name", f"cast({content} as binary) AS content")
    files = files.union(spark.createDataFrame([("extra", "more", b"x"), ("unlisted", "more", b"x")], files.schema))
    wanted = nation.select(packs("whole", "tampered", "missing", "extra", "short", "empty"), F.col("n_name").alias("name"), F.upper(F.sha2("n_name", 256)).alias("sha256"), F.octet_length("n_name").alias("bytes"))
    return audit.manifest_status(files, wanted)


@query("SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 2, 3) AS forbidden FROM orders")
def audit_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that a source tree must not hold."""
    path = "concat(CASE o_orderkey % 6 WHEN 0 THEN 'a/node_modules/b' WHEN 1 THEN 'x/.ENV.local' WHEN 2 THEN 'src-tauri/models/m' WHEN 3 THEN 'src-tauri/runtime/r' WHEN 4 THEN 'src-tauri/models/manifest.json' ELSE 'src/targets/t' END, IF(o_orderkey % 6 = 2, cast(o_orderkey as string), '')) AS path"
    return table(spark, sf, "orders").selectExpr("o_orderkey", path).select("o_orderkey", audit.path_forbidden(F.col("path")).alias("forbidden"))


# --- layout and images ------------------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, least(w4, 200 - bx) AS w, least(h4, 100 - byy) AS h, bx AS x, byy AS y FROM (SELECT l_orderkey, l_linenumber, CAST(floor((l_partkey % 40) / 0.5) AS INT) AS bx, CAST(floor((l_suppkey % 30) / 0.5) AS INT) AS byy,
  CAST(greatest(floor((l_partkey % 7) / 0.5), 4) AS INT) AS w4, CAST(greatest(floor((l_partkey % 90) / 0.5), 4) AS INT) AS h4 FROM lineitem)
""")
def box_rescale(spark: SparkSession, sf: str) -> DataFrame:
    """A detector's boxes in the image's pixels."""
    li = table(spark, sf, "lineitem")
    box = layout.rescaled(F.col("l_partkey") % 40, F.col("l_suppkey") % 30, F.col("l_partkey") % 7, F.col("l_partkey") % 90, F.lit(0.5), F.lit(200), F.lit(100))
    return li.select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@query("""
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY k, i) - 1 AS INT) AS word_ix, word AS text, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(40 AS INT) AS w, CAST(10 AS INT) AS h
FROM (SELECT l_orderkey AS image_id, l_linenumber * 1000000 + l_partkey * 20 + l_suppkey % 20 AS k, i, word, (l_linenumber % 4) * 20 AS x, 100 - (l_linenumber % 5 + 1) * 10 AS y FROM (SELECT *, unnest(range(1, 3)) AS i FROM lineitem), LATERAL (SELECT CASE i WHEN 1 THEN l_returnflag || '.' ELSE l_linestatus END AS word))
""")
def ocr_native_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of observations from the lower left to pixels from the upper left."""
    o = "l_orderkey AS image_id", "l_linenumber * 1000000 + l_partkey * 20 + l_suppkey % 20 AS obs_ix", "concat(' ', l_returnflag, '.  ', l_linestatus, ' ') AS text", "(l_linenumber % 4) * 0.125D AS min_x", "(l_linenumber % 5) * 0.1D AS min_y", "(l_linenumber % 4) * 0.125D + 0.25D AS max_x", "(l_linenumber % 5 + 1) * 0.1D AS max_y", "0.9D AS conf", "160 AS width", "100 AS height"
    return layout.native_words(table(spark, sf, "lineitem").selectExpr(*o)).select("image_id", "word_ix", "text", "x", "y", "w", "h")


@query("""
WITH w AS (SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ix, l_partkey % 3 = 0 AS mail, l_partkey % 20 AS u FROM lineitem),
t AS (SELECT image_id, u, 'EMAIL_' || CAST(row_number() OVER (PARTITION BY image_id ORDER BY min(ix)) AS STRING) AS token FROM w WHERE mail GROUP BY image_id, u),
b AS (SELECT image_id, string_agg(token || ':' || CAST(greatest(ix * 200 - 2, 0) AS STRING) || ',3,34,14', ';' ORDER BY token, ix) AS keys FROM w JOIN t USING (image_id, u) WHERE mail GROUP BY image_id)
SELECT image_id, CAST(count(*) FILTER (WHERE mail) AS INT) AS count, CAST(count(DISTINCT u) FILTER (WHERE mail) AS INT) AS redactions, coalesce(any_value(keys), '') AS keys FROM w LEFT JOIN b USING (image_id) GROUP BY image_id
""")
def ocr_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Recognised words joined, protected and mapped to boxes."""
    ix = "row_number() OVER (PARTITION BY image_id ORDER BY l_linenumber, l_partkey, l_suppkey) - 1"
    text = "CASE WHEN l_partkey % 3 = 0 THEN concat('u', l_partkey % 20, 'z@ex.com') ELSE 'word' END AS text"
    words = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "image_id").selectExpr("image_id", f"{ix} AS word_ix", text, "30 AS w", "10 AS h", "0.9F AS conf").withColumn("x", F.col("word_ix") * 200).withColumn("y", F.lit(5))
    d = screenshots.detected_words(words)
    keys = F.transform("redactions", lambda r: F.transform(r["boxes"], lambda b: F.concat(r["token"], F.lit(":"), F.concat_ws(",", b["x"], b["y"], b["w"], b["h"]))))
    return d.select("image_id", "count", F.size("redactions").alias("redactions"), F.array_join(F.flatten(keys), ";").alias("keys"))


def _png(spark: SparkSession, sf: str) -> DataFrame:
    """image_id and content of a small PNG for each part."""

    def run(it):
        import pyarrow as pa

        for b in it:
            made = [images.encode_png(np.full((6, 8, 4), (k % 200, 7, 9, 255), np.uint8)) for k in b["p_partkey"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["p_partkey"], pa.array(made, pa.binary())], ["image_id", "content"])

    return table(spark, sf, "part").select("p_partkey").mapInArrow(run, "image_id long, content binary")


@query("SELECT p_partkey AS image_id, 'ok' AS status, CAST(8 AS INT) AS width, CAST(6 AS INT) AS height, CAST(x AS INT) AS black FROM (SELECT p_partkey, least(p_partkey % 8 + 2, 8) - p_partkey % 8 AS w, least(p_partkey % 6 + 3, 6) - p_partkey % 6 AS h FROM part), LATERAL (SELECT w * h AS x)")
def png_redact(spark: SparkSession, sf: str) -> DataFrame:
    """PNG files decoded, boxes blacked out, encoded, and read again."""
    box = F.expr("array(named_struct('x', cast(image_id % 8 as int), 'y', cast(image_id % 6 as int), 'w', 2, 'h', 3))")
    done = images.redacted(images.normalised(_png(spark, sf)).select("image_id", "content").withColumn("boxes", box))

    def run(it):
        import pyarrow as pa

        for b in it:
            px = [images.decode_png(c) for c in b["content"].to_pylist()]
            black = [int((p == (0, 0, 0, 255)).all(axis=2).sum()) for p in px]
            yield pa.RecordBatch.from_arrays([b["image_id"], b["status"], pa.array([p.shape[1] for p in px], pa.int32()), pa.array([p.shape[0] for p in px], pa.int32()), pa.array(black, pa.int32())], ["image_id", "status", "width", "height", "black"])

    return done.mapInArrow(run, "image_id long, status string, width int, height int, black int")


# --- names ------------------------------------------------------------------------------------------------------------

_LABELS = ["O", "B-PERSON", "I-PERSON", "B-ORGANIZATION", "I-ORGANIZATION", "B-LOCATION", "I-LOCATION"]
_SQL_LABELS = "[" + ", ".join(f"'{x}'" for x in _LABELS) + "]"


@query(f"""
WITH RECURSIVE t AS (SELECT vec_id // 8 AS doc_id, vec_id % 8 AS ix, list_transform(embedding[1:7], lambda v: CAST(v AS DOUBLE) * 60) AS l FROM embeddings),
b AS (SELECT doc_id, ix, row_number() OVER (PARTITION BY doc_id ORDER BY ix) AS n, ({_SQL_LABELS})[list_position(l, list_max(l))] AS label, 1 / list_sum(list_transform(l, lambda v: exp(v - list_max(l)))) AS p FROM t),
f AS (SELECT doc_id, n, CASE WHEN label LIKE 'B-%' AND p >= 0.8 THEN 1 ELSE 0 END AS g, label LIKE 'B-%' AND p >= 0.8 AS o, substr(label, 3) AS ty, ix * 5 AS s, ix * 5 + 4 AS e FROM b WHERE n = 1
  UNION ALL SELECT b.doc_id, b.n, CASE WHEN NOT (f.o AND b.label = 'I-' || f.ty AND b.p >= 0.5) AND b.label LIKE 'B-%' AND b.p >= 0.8 THEN f.g + 1 ELSE f.g END,
    (f.o AND b.label = 'I-' || f.ty AND b.p >= 0.5) OR (b.label LIKE 'B-%' AND b.p >= 0.8),
    CASE WHEN NOT (f.o AND b.label = 'I-' || f.ty AND b.p >= 0.5) AND b.label LIKE 'B-%' AND b.p >= 0.8 THEN substr(b.label, 3) ELSE f.ty END,
    CASE WHEN NOT (f.o AND b.label = 'I-' || f.ty AND b.p >= 0.5) AND b.label LIKE 'B-%' AND b.p >= 0.8 THEN b.ix * 5 ELSE f.s END,
    CASE WHEN (f.o AND b.label = 'I-' || f.ty AND b.p >= 0.5) OR (b.label LIKE 'B-%' AND b.p >= 0.8) THEN b.ix * 5 + 4 ELSE f.e END
  FROM f JOIN b ON b.doc_id = f.doc_id AND b.n = f.n + 1)
SELECT doc_id, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", CASE ty WHEN 'PERSON' THEN 'PERSON' WHEN 'ORGANIZATION' THEN 'ORG' ELSE 'LOC' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY n DESC) AS r FROM f WHERE g > 0) WHERE r = 1
""")
def ner_bio_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Names by the logits of tokens."""
    e = table(spark, sf, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 7), lambda v: v.cast("double") * 60)
    at = (F.col("vec_id") % 8).cast("int")
    tokens = e.select(F.floor(F.col("vec_id") / 8).alias("doc_id"), F.lit(0).alias("window_ix"), at.alias("token_ix"), (at * 5).alias("start"), (at * 5 + 4).alias("end"), logits.alias("logits"))
    texts = tokens.select("doc_id").distinct().withColumn("text", F.lit("anna bert carl dora emil fred gina hugo"))
    return names.bio_decoded(tokens, _LABELS, texts)


@query("SELECT c_custkey AS doc_id, true AS ner_active, CAST(11 AS INT) AS start, CAST(11 + length(c_mktsegment) AS INT) AS stop, 'ORG' AS kind FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def ner_model(spark: SparkSession, sf: str) -> DataFrame:
    """Windows, pieces, a model's logits and their decoding, by a model that marks the words of its vocabulary."""
    vocab = {"[UNK]": 100, "[CLS]": 101, "[SEP]": 102, "i": 1, "work": 2, "for": 3, "a": 4, "b": 5, "f": 6, "h": 7, "##uto": 8, "##uild": 9, "##ur": 10, "##ouse": 11, "##mobile": 12, "##ing": 13, "##niture": 14, "##hold": 15, ".": 16}

    def run(ids: np.ndarray, mask: np.ndarray, types: np.ndarray) -> np.ndarray:
        out = np.zeros((1, ids.shape[1], len(_LABELS)))
        out[0, np.isin(ids[0], (4, 5, 6, 7)), 3] = 9
        out[0, (ids[0] >= 8) & (ids[0] <= 15), 4] = 9
        return out

    docs = spread(table(spark, sf, "customer")).selectExpr("c_custkey AS doc_id", "concat('I work for ', c_mktsegment, '.') AS text")
    tagged = names.tagged(docs, names.model_tagger(vocab, _LABELS, run))
    return tagged.select("doc_id", "ner_active", F.explode("tagged").alias("s")).select("doc_id", "ner_active", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "s.kind")


@query("SELECT c_custkey AS doc_id, 'I work for ORG_' || CAST(n AS STRING) AS text FROM customer JOIN (SELECT c_mktsegment, row_number() OVER (ORDER BY min(c_custkey)) AS n FROM customer GROUP BY 1) USING (c_mktsegment)")
def protect_names(spark: SparkSession, sf: str) -> DataFrame:
    """A tagger's spans protected with the others."""
    docs = spread(table(spark, sf, "customer")).selectExpr("c_custkey AS doc_id", "concat('I work for ', c_mktsegment) AS text")
    found = names.tagged(docs, lambda texts: [[(11, len(t), "ORG")] for t in texts])
    return protect.protect(found, Rules(), tagged=F.col("tagged"))[0].select("doc_id", "text")
