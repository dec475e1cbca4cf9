"""Fill-in-middle: a text cut in three at token borders, its middle moved to the end.

A text is decoded to an array of code points (UTF-32); a code point is a letter of A-Z or a-z or it isn't. A border is
where two neighbours aren't both letters, so tokens are runs of letters and single other code points. The borders are
what flatnonzero() gives of one comparison of the array with itself shifted; the two drawn ranks index them, and the
three slices are encoded again. Draws come from the SHA-256 of a salt and doc_id, so they are the same in every run and
in every partition. A row is worked on alone: no shuffle, and no more memory than a batch of rows and one text's array.

Prefix-suffix-middle (psm) or suffix-prefix-middle (spm), each part behind its mark; a text that is empty, holds a mark
itself or is drawn to stay is plain, as it was. restored() undoes it: no text between the marks holds one, nor does one
arise where parts and marks meet, as a mark begins and ends with characters that occur in it once.

Null texts count as empty and become so; an empty text has no tokens. A null doc_id is drawn as an empty one. Rows that
share an id are cut at the same ranks, each in its own text. An empty table gives no rows. Extra columns are kept; one
named fim gives way to the operator's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import docs_table, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
FIM = T.StructType().add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long")


def borders(codes: np.ndarray) -> np.ndarray:
    """Where tokens begin and end: the first token's start, each border, the end of the last."""
    letter = (codes | 32) - np.uint32(97) < 26
    inner = np.flatnonzero(~(letter[1:] & letter[:-1])) + 1
    return np.concatenate([[0], inner, [len(codes)]]) if len(codes) else np.zeros(1, dtype=np.int64)


def draws(doc_id: int | None, salt: str = "1") -> list[int]:
    """Four unsigned 32-bit numbers from the salt and the id."""
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def transformed(text: str, drawn: list[int], moved_percent: int = 90, spm_percent: int = 20) -> tuple[str, int, str, int | None, int | None]:
    """The output of a text, its number of tokens, form, and code points of prefix and middle."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    at = borders(codes)
    n = len(at) - 1
    if not n or PREFIX in text or SUFFIX in text or MIDDLE in text or drawn[2] % 100 >= moved_percent:
        return text, n, PLAIN, None, None
    a, b = sorted(int(at[h % (n + 1)]) for h in drawn[:2])
    prefix, middle, suffix = (part.tobytes().decode("utf-32-le") for part in (codes[:a], codes[a:b], codes[b:]))
    if drawn[3] % 100 < spm_percent:
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", n, SPM, a, b - a
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", n, PSM, a, b - a


def fill_in_middle(docs: DataFrame, salt: str = "1", moved_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """docs (doc_id, text, ...) with text transformed, and fim: n (tokens), form, prefix_chars and middle_chars (null if plain)."""
    columns = [c for c in docs.columns if c != "fim"]
    others = [F.col(f"`{c}`") for c in columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [transformed(t or "", draws(i, salt), moved_percent, spm_percent) for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True)]
            text, *parts = zip(*got, strict=True) if got else [[]] * 5
            fim = pa.StructArray.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds, strict=True)], FIM.names)
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(text, pa.string()), fim], ["row", "text", "fim"])

    schema = T.StructType([rows.schema["row"], rows.schema["text"], T.StructField("fim", FIM)])
    out = small_batches(rows).mapInArrow(run, schema)
    return out.select(*["text" if c == "text" else F.col(f"row.`{c}`") for c in columns], "fim")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    back = lambda *order: F.concat(*[F.get(parts, i) for i in order])
    return F.when(form == PLAIN, output).when(form == SPM, back(2, 3, 1)).otherwise(back(1, 3, 2))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, transformed, and restored from the output."""
    made = fill_in_middle(docs_table(spark, sf_dir).select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "fim.*", sha(F.col("text")).alias("output_sha256"), sha(restored(F.col("text"), F.col("fim.form"))).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '(?s)[A-Za-z]+|[^A-Za-z]') AS k,
    [CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS r FROM d),
c AS (SELECT *, len(k) AS n, least(r[1] % (len(k) + 1), r[2] % (len(k) + 1)) AS a, greatest(r[1] % (len(k) + 1), r[2] % (len(k) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
        WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(k[1:a], '') AS x, array_to_string(k[a + 1:b], '') AS y, array_to_string(k[b + 1:n], '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM p
"""
