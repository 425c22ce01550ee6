"""The registered queries on the smallest driver tables: columns, rows, and SQL where there is any."""

import os

import compare
import pytest

import corpus_pipeline
from quillrank.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op2_": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op3_": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op4_": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op5_": "doc_id bigint, score double",
    "op6_": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op7_": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op8_": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op9_": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_": "doc_id bigint, lossless boolean",
    "op11_": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op12_": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op13_": "item_id bigint, rank int, doc_id bigint, score bigint",
}
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables are not here")


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    found = queries.QUERIES[name](spark, SF)
    kinds = dict(found.dtypes)
    for column in COLUMNS[name.split("_")[0] + "_"].split(", "):
        column, kind = column.split()
        assert kinds[column] == kind
    rows = compare.rows_of_spark(found)
    if name in queries.ORACLES:
        assert compare.difference(rows, compare.rows_of_sql(compare.duck(SF), queries.ORACLES[name])) is None


def test_pipeline_keeps_clean_documents_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == columns
        assert kept.join(docs, columns, "left_anti").count() == 0
        assert 0 < kept.count() <= docs.count()
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
