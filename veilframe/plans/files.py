"""Queries of what is written to files and read back, of responses and of choices of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, layout, protect
from ..operators.detect import with_spans
from ..operators.rules import Rules
from ..sources import readers, writers
from .queries import _SQL_PROTECTED, documents, query, table
from .storage import new_path


@query(f"WITH {_SQL_PROTECTED} SELECT doc_id, CASE WHEN strlen(d.text) > 100000 THEN NULL ELSE coalesce(t.text, d.text) END AS text, CASE WHEN strlen(d.text) > 100000 THEN 'input_too_large' ELSE 'ok' END AS status, CASE WHEN strlen(d.text) > 100000 THEN NULL ELSE CAST(coalesce(n, 0) AS INT) END AS count FROM documents d LEFT JOIN t ON t.id = d.doc_id")
def snk_protected(spark: SparkSession, sf: str) -> DataFrame:
    """Protected texts written without their mappings: all columns of what was written."""
    path = new_path(spark, "protected")
    writers.protected(protect.protect(documents(spark, sf, "doc_id", "text"))[0], path, "doc_id")
    return spark.read.parquet(path)


@query("SELECT s_suppkey || '.PNG' AS name, CAST(strlen(s_name || s_nationkey) AS BIGINT) AS length, md5(s_name || s_nationkey) AS digest FROM supplier WHERE s_suppkey % 10 <> 3")
def snk_image_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files written all or none, then found by their names; rows without content have none."""
    path = f"{new_path(spark, 'files')}/images"
    rows = table(spark, sf, "supplier").selectExpr("concat(s_suppkey, '.PNG') AS name", "CASE WHEN s_suppkey % 10 <> 3 THEN cast(concat(s_name, s_nationkey) as binary) END AS content")
    writers.png_files(rows, path)
    return readers.image_files(spark, path, "*.PNG").select(F.element_at(F.split("image_id", "/"), -1).alias("name"), "length", F.md5("content").alias("digest"))


@query("SELECT p_partkey, CASE WHEN p_brand <> 'Brand#11' THEN 'made by ' || p_brand END AS found FROM part")
def src_rules_file(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of all brands stored over older ones and read again; what they find in texts on parts. One brand is a never-term."""
    path = f"{new_path(spark, 'files')}/rules"
    brands = sorted(r[0] for r in table(spark, sf, "part").select("p_brand").distinct().limit(400).collect())
    writers.rules(spark, Rules.checked(always=["made"]), path)
    writers.rules(spark, Rules.checked(always=[f"made by {b}" for b in brands if b != "Brand#11"], never=["made by Brand#11"]), path)
    texts = table(spark, sf, "part").selectExpr("p_partkey", "concat('A thing made by ', p_brand, ', new') AS text")
    found = with_spans(texts, readers.rules_file(spark, path))
    return found.select("p_partkey", F.get("spans", F.lit(0)).alias("s"), "text").select("p_partkey", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("found"))


@query("""
WITH f AS (SELECT r_regionkey AS pack, n_name AS name, CASE WHEN r_regionkey < 2 AND n_nationkey = 7 + r_regionkey THEN 'x' ELSE n_name END AS content FROM nation, region WHERE NOT (r_regionkey = 2 AND n_nationkey = 5)),
ok AS (SELECT pack, bool_and(content = name) AND count(*) = (SELECT count(*) FROM nation) AS ok FROM f GROUP BY pack)
SELECT CAST(min(pack) AS INT) AS pack FROM ok WHERE ok
""")
def src_model_place(spark: SparkSession, sf: str) -> DataFrame:
    """The first of the regions' packs of files that is whole: two hold a changed file each, one lacks a file."""
    nation, packs = table(spark, sf, "nation"), table(spark, sf, "region").selectExpr("cast(r_regionkey as int) AS pack", "r_regionkey AS nth")
    every = nation.select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pack"), "n_nationkey", "n_name")
    content = "CASE WHEN pack < 2 AND n_nationkey = 7 + pack THEN 'x' ELSE n_name END"
    files = every.where("NOT (pack = 2 AND n_nationkey = 5)").selectExpr("pack", "n_name AS name", f"cast({content} as binary) AS content")
    wanted = every.select("pack", F.col("n_name").alias("name"), F.sha2("n_name", 256).alias("sha256"), F.octet_length("n_name").alias("bytes"))
    return audit.first_sound(packs, files, wanted)


@query("""
WITH a AS (SELECT DISTINCT l_orderkey AS image_id, CAST(l_partkey % 7 AS STRING) || ',1,4,4' AS key FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT DISTINCT l_orderkey AS image_id, CAST(l_suppkey % 7 AS STRING) || ',1,4,4' AS key FROM lineitem WHERE l_linenumber >= 2)
(SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)
""")
def box_toggle(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen boxes, of which changes take some away and add others."""
    key = lambda c, where: table(spark, sf, "lineitem").where(where).selectExpr("l_orderkey AS image_id", f"concat({c} % 7, ',1,4,4') AS key")
    return layout.toggled(key("l_partkey", "l_linenumber <= 3"), key("l_suppkey", "l_linenumber >= 2"))


@query("""
SELECT o_orderkey AS image_id, CAST(w AS INT) AS word_ix, CASE w WHEN 0 THEN o_orderpriority ELSE 'b' END AS text, CAST(o_custkey % 20 AS INT) AS x, CAST(w * 9 AS INT) AS y, CAST(12 AS INT) AS w, CAST(8 AS INT) AS h
FROM (SELECT *, unnest([0, 1]) AS w FROM orders) WHERE o_orderkey % 9 IN (0, 8)
""")
def ocr_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Words of JSON responses: malformed, of another size, with more fields, outside the image, blank, too sure, or without words give none."""
    word = "'{{\"text\":\"', {t}, '\",\"x\":', {x}, ',\"y\":', {y}, ',\"w\":12,\"h\":8,\"conf\":', {c}, '}}'"
    first = word.format(t="CASE WHEN k = 4 THEN '  ' ELSE o_orderpriority END", x="CASE WHEN k = 3 THEN 90 ELSE o_custkey % 20 END", y="0", c="CASE WHEN k = 5 THEN '1.5' ELSE '0.5' END")
    second = word.format(t="'b'", x="o_custkey % 20", y="9", c="1")
    body = f"concat('{{\"width\":', CASE WHEN k = 1 THEN 101 ELSE 100 END, ',\"height\":50,', CASE WHEN k = 2 THEN '\"more\":1,' ELSE '' END, '\"words\":', CASE WHEN k = 6 THEN 'null' ELSE concat('[', {first}, ',', {second}, ']') END, CASE WHEN k = 7 THEN '' ELSE '}}' END)"
    d = table(spark, sf, "orders").withColumn("k", F.expr("o_orderkey % 9")).selectExpr("o_orderkey AS image_id", f"{body} AS body", "100 AS width", "50 AS height")
    return layout.decoded_responses(d).select("image_id", "word_ix", "text", "x", "y", "w", "h")
