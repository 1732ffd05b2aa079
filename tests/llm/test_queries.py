"""The thin queries over whole tables: rows, columns and types of their contracts."""

import os

import pytest

from cuewright.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")

COLUMNS = {
    "op1_syncmers": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op2_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op3_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op6_licenses": {"doc_id": "bigint", "n_licenses": "bigint", "license": "string", "coverage": "double"},
    "op7_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8_suffixes": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op9_sharding": {"doc_id": "bigint", "shard": "string", "shard_rows": "bigint", "n_bytes": "bigint"},
    "op10_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op11_lines": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op12_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    "op13_fim": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_contract(spark, name):
    out = Q.queries()[name](spark, SMALL)
    assert COLUMNS[name].items() <= dict(out.dtypes).items()
    if name == "op12_trie":  # a row for each node: see the statement
        return
    source = "pages" if name == "op2_html" else "documents"
    key = "page_id" if name == "op2_html" else "doc_id"
    want = sorted(r[0] for r in spark.read.parquet(f"{SMALL}/{source}.parquet").select(key).collect())
    assert sorted(r[0] for r in out.select(key).collect()) == want


def test_all_are_registered():
    import __spark_entry__ as entry

    assert {*COLUMNS, "pipeline", *Q.oracle_sql()} == set(Q.queries()) and set(Q.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_statement(spark, name):
    import duckdb

    con = duckdb.connect()
    for source in ("documents", "conversations"):
        con.execute(f"create view {source} as select * from '{SMALL}/{source}.parquet'")
    found = con.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, Q.queries()[name](spark, SMALL).select(*columns).collect()), key=order) == sorted(found.fetchall(), key=order)
