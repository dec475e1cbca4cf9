"""Queries of term lists and never-terms held as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import resolved
from ..operators import terms
from .queries import _spans, query, table

_LISTED = "concat(text, ' We sell a ', p_name, ', ', upper(p_name), 's, un', p_name, ' (', upper(p_name), ') and ', p_name, 'é or é.', p_name)"


@query(f"""WITH d AS (SELECT doc_id, p_brand AS list_id, {_LISTED} AS text FROM documents JOIN part ON p_partkey = doc_id % 2000 + 1 WHERE text IS NOT NULL),
l AS (SELECT list_id, '(?i)(?:' || string_agg(term, '|' ORDER BY length(term) DESC, term) || ')' AS pattern FROM (SELECT DISTINCT p_brand AS list_id, p_name AS term FROM part) GROUP BY list_id),
f AS (SELECT doc_id, text, regexp_extract_all(text, pattern) AS m, string_split_regex(text, pattern) AS g FROM d JOIN l USING (list_id)),
x AS (SELECT doc_id, text, m[i] AS v, list_sum(list_transform(g[1:i], lambda a: length(a))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda a: length(a))), 0) AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f))
SELECT doc_id, CAST(start AS INT) AS start, v AS value FROM x WHERE NOT regexp_matches(substr(text, CAST(start AS BIGINT), 1), '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(substr(text, CAST(start AS BIGINT) + length(v) + 1, 1), '[\\p{{L}}\\p{{N}}]')""")
def det_term_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The names of a brand's parts, a list for each brand, in documents that speak of one."""
    part = table(spark, sf, "part")
    # a document's remainder is in this range, so no other part joins; the lists are of all parts
    spoken_of = F.broadcast(part.where("p_partkey BETWEEN -1998 AND 2000"))
    docs = table(spark, sf, "documents").where("text IS NOT NULL").join(spoken_of, F.expr("p_partkey = doc_id % 2000 + 1")).select("doc_id", F.col("p_brand").alias("list_id"), F.expr(_LISTED).alias("text"))
    found = terms.always_spans(docs, part.select(F.col("p_brand").alias("list_id"), F.col("p_name").alias("term")), "doc_id")
    e = found.select("doc_id", "text", F.explode("found").alias("s"))
    return e.select("doc_id", F.col("s.start").alias("start"), F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))


@query("""
WITH n AS (SELECT l_orderkey AS k, l_suppkey % 40 AS a, l_suppkey % 40 + 4 + l_partkey % 16 AS b FROM lineitem WHERE l_linenumber <= 3),
s AS (SELECT l_orderkey, l_partkey % 50 AS a, l_partkey % 50 + 1 + l_suppkey % 9 AS b FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM n WHERE k = l_orderkey AND n.a <= l_partkey % 50 AND n.b >= l_partkey % 50 + 1 + l_suppkey % 9)),
m AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR a >= before THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT l_orderkey, CAST(min(a) AS INT) AS start, CAST(max(b) AS INT) AS stop FROM i GROUP BY l_orderkey, island
""")
def res_never_table(spark: SparkSession, sf: str) -> DataFrame:
    """Spans inside a never-term's place, of a table of places, go before the others are merged."""
    ranges = table(spark, sf, "lineitem").where("l_linenumber <= 3").selectExpr("l_orderkey", "cast(l_suppkey % 40 as int) AS start", "cast(l_suppkey % 40 + 4 + l_partkey % 16 as int) AS end")
    spans = _spans(spark, sf).select("l_orderkey", F.explode("spans").alias("s")).select("l_orderkey", "s.*")
    left = terms.unsuppressed(spans, ranges, ["l_orderkey"]).groupBy("l_orderkey").agg(F.collect_list(F.struct("start", "end", "kind", "priority", "det", "seq")).alias("spans"))
    e = left.select("l_orderkey", F.explode(resolved(F.col("spans"))).alias("s"))
    return e.select("l_orderkey", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))
