"""The corpus operators' queries: those with SQL against it, all with the columns that they owe."""

import duckdb
import pytest

from veilframe.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
OWED = {
    "op1_source_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op4_embedding_near_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_pii_pseudonyms": {"doc_id": "bigint", "text": "string", "n_pii": "bigint"},
    "op6_ngram_jaccard_join": {"doc_id": "bigint", "class_id": "bigint", "component_id": "bigint", "n_links": "bigint", "kept": "boolean"},
    "op7_class_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op8_benchmark_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op11_pattern_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op12_embedding_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op13_fill_in_middle": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
}
#: Rows for each row of the table, where it isn't one; None where a document has several.
ROWS = {"op11_pattern_packing": None, "op12_embedding_whitening": 8}


@pytest.mark.parametrize("name", sorted(OWED))
def test_query(spark, name):
    got = queries()[name](spark, SF)
    assert OWED[name].items() <= dict(got.dtypes).items()
    rows = [r.asDict() for r in got.collect()]
    source = "embeddings" if "embedding" in name else "documents"
    n, each = spark.read.parquet(f"{SF}/{source}.parquet").count(), ROWS.get(name, 1)
    assert len(rows) == each * n if each else len(rows) >= n
    if name in oracle_sql():
        duck = duckdb.connect()
        for t in ("documents", "embeddings", "benchmark"):
            duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = duck.sql(oracle_sql()[name])
        assert sorted(repr([r[c] for c in want.columns]) for r in rows) == sorted(repr(list(r)) for r in want.fetchall())
