"""The registered queries: names, columns and one row per row of their table."""

import pytest

import __spark_entry__ as E
from logweave.llm import queries as Q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string",
                        "spans": "string"},
    "op4_benchmark_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint",
                                      "items_sha256": "string", "contaminated": "boolean"},
    "op8_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op9_simhash_neardup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op11_prefix_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint",
                         "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    "op12_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint",
                     "sequence_id": "bigint", "offset": "bigint"},
    "op13_fill_in_middle": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint",
                            "output_sha256": "string", "restored_sha256": "string"},
    "op10_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
}
TABLE = {"op8_html_extraction": "pages"}


def test_one_query_for_each_operator_and_the_pipeline():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries()
    assert set(Q.SQL) <= set(names)


@pytest.mark.parametrize("name", COLUMNS)
def test_contract_columns(spark, name):
    df = Q.QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    if name not in ("op10_ann", "op11_prefix_trie", "op12_packing"):
        assert df.count() == spark.read.parquet(f"{SF}/{TABLE.get(name, 'documents')}.parquet").count()
