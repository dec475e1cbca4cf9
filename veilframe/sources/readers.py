"""Inputs: texts, images in several wrappings, rules, manifests, vocabularies and labels."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import BadRule, ConflictingRule, Rules

MOST_IMAGE_BYTES = 20 * 1024 * 1024
MOST_BASE64 = -(-MOST_IMAGE_BYTES // 3) * 4
DATA_URL = r"^data:image/(?:png|jpeg|gif|webp|bmp|x-ms-bmp);base64,(.+)$"


def texts(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A table of texts: Parquet (or another table format) as it is, or text files of which each is one row (path, text)."""
    if kind == "text":
        return spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"))
    return spark.read.format(kind).load(path)


def selections(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text isn't blank, has no NUL and isn't over the limit; the others were never selected."""
    t = F.col(text)
    return df.where(t.rlike(r"(?U)\S") & ~t.contains("\0") & (F.octet_length(t) <= 100_000))


def image_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """image_id (path), content and length of image files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("image_id"), "content", "length")


def rasters(spark: SparkSession, path: str) -> DataFrame:
    """image_id (path), width, height, channels and raster of image files that Spark's own image source decodes: PNG, JPEG, BMP, and the first frame of GIF. Others are left out."""
    d = spark.read.format("image").option("dropInvalid", True).load(path)
    return d.select(F.col("image.origin").alias("image_id"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("raster"))


def from_base64(s: Column) -> Column:
    """Bytes of strict base64, null if it is malformed or too long."""
    whole = (F.length(s) % 4 == 0) & ~s.rlike(r"[^A-Za-z0-9+/=]")
    return F.when(whole & (F.length(s) <= MOST_BASE64), F.try_to_binary(s, F.lit("base64")))


def data_url_payload(s: Column) -> Column:
    """The base64 part of an image's data URL, else null."""
    return F.nullif(F.regexp_extract(s, DATA_URL, 1), F.lit(""))


def rules_file(spark: SparkSession, path: str) -> Rules:
    """Rules of a JSON file, or of the version that CURRENT names in a folder of versions; the default ones if it can't be read or its rules are refused."""
    whole = lambda p: "\n".join(r[0] for r in spark.read.option("wholetext", True).text(p).collect())
    try:
        try:
            path = f"{path}/{whole(f'{path}/CURRENT').strip()}"
        except Exception as e:  # no folder of versions
            if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e) and "Not a directory" not in str(e) and "not a directory" not in str(e):
                raise
        raw = json.loads(whole(path))
        return Rules.checked(raw.get("always", []), raw.get("never", []), raw.get("moneyDates", raw.get("money_dates", False)))
    except (BadRule, ConflictingRule, ValueError, AttributeError, TypeError):
        return Rules()
    except Exception as e:  # a missing file is an analysis error of Spark's
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return Rules()
        raise


def manifest(spark: SparkSession, text: str) -> DataFrame:
    """name, sha256, bytes and remote of a JSON manifest."""
    kind = "files map<string, struct<sha256: string, bytes: bigint, remote: string>>"
    one = spark.createDataFrame([(text,)], "body string").select(F.from_json("body", kind).alias("m"))
    return one.select(F.explode("m.files").alias("name", "v")).select("name", "v.*")


def vocabulary(lines: DataFrame) -> DataFrame:
    """piece and id of a vocabulary (line_no from 0, value)."""
    return lines.select(F.trim("value").alias("piece"), F.col("line_no").cast("int").alias("id"))


def labels(spark: SparkSession, text: str) -> list[str]:
    """Label names of a model's JSON configuration, in the order of their numbers."""
    one = spark.createDataFrame([(text,)], "body string").select(F.from_json("body", "id2label map<string, string>")["id2label"].alias("m"))
    pairs = F.transform(F.map_entries("m"), lambda e: F.struct(e["key"].cast("int").alias("k"), e["value"].alias("v")))
    return one.select(F.transform(F.array_sort(pairs), lambda e: e["v"])).first()[0]


def bytes_of_hex(s: Column) -> Column:
    """Bytes of an even number of hex digits, else null."""
    return F.when((F.length(s) % 2 == 0) & ~s.rlike("[^0-9A-Fa-f]"), F.unhex(s))
