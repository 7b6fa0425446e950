"""The registered queries against their SQL, and what every one of them returns."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from docgrain.llm import queries

COLUMNS = {
    "op1_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_topk": ["query_id", "rank", "vec_id", "score"],
    "op3_substrings": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op4_contamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op5_token_counts": ["source", "lang", "tokenizer", "docs", "tokens"],
    "op6_simhash": ["doc_id", "fingerprint", "component_id"],
    "op7_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op8_mix": ["doc_id", "source", "block", "slot", "position"],
    "op9_lm_scores": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op11_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op12_licenses": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op13_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op10_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf, name):
    ok, message, _, _ = compare(spark, connect(sf), sf, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message
    assert message.endswith("rows "), message


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_rows_and_plan(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    if COLUMNS[name][0] == "doc_id":
        assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_all_are_registered():
    assert set(COLUMNS) == set(queries.QUERIES)
    assert {*COLUMNS, "pipeline"} <= set(entry.queries())
