"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing names, and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillrank.llm import (
    covertree,
    fingerprints,
    licenses,
    mixing,
    neardup,
    packing,
    quality,
    segmentation,
    sharding,
    toxicity,
)

OPERATORS = {
    "near_duplicates": lambda d, _: neardup.near_duplicates(d),
    "fingerprints": lambda d, _: fingerprints.compared(fingerprints.fingerprint(d)),
    "licenses": lambda d, _: licenses.summary(licenses.scan(d)),
    "quality": lambda d, _: quality.classify(d),
    "mixing": lambda d, _: mixing.score(d),
    "sharding": lambda d, _: sharding.shuffle_to_shards(d, 4, shard_col="to_shard", slot_col="to_slot"),
    "toxicity": lambda d, y: toxicity.score(d, y),
    "segmentation": lambda d, _: segmentation.decode(segmentation.encode(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(awkward, labels, awkward_rows, name):
    found = OPERATORS[name](awkward, labels).select("doc_id").collect()
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(str(i) for i, _ in awkward_rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nothing, labels, name):
    assert OPERATORS[name](nothing, labels).count() == 0


def test_packing(awkward, nothing, awkward_rows):
    found = packing.pack(awkward).collect()
    assert sum(r.length for r in found) == sum(r.doc_tokens for r in found if not r.start)
    assert sum(not r.start for r in found) == len(awkward_rows)
    assert packing.pack(nothing).count() == 0


def test_representatives(awkward, nothing, awkward_rows):
    found = neardup.representatives(awkward)
    assert found.columns == awkward.columns
    kept = [(r.doc_id, r.text) for r in found.collect()]
    # All rows without words, and one row of each other text.
    empty = [r for r in awkward_rows if not (r[1] or "").strip()]
    worded = {r[1] for r in awkward_rows if (r[1] or "").strip()}
    assert len(kept) == len(empty) + len(worded)
    assert neardup.representatives(nothing).count() == 0


def test_vectors(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None),
        (5, None, 1), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [None, 1.0], 1),
        (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (0, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (12, [-1.0, 0.0], 1),
    ]
    vectors = spark.createDataFrame(
        [(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, node string, root string"
    )
    found = covertree.near_duplicate_vectors(vectors).collect()
    assert len(found) == len(rows)
    links = {r.vec_id: (r.n_links, r.component_id) for r in found}
    assert links[0] == links[1] == links[2] == (3, 0)
    assert all(links[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, None))
    assert covertree.near_duplicate_vectors(vectors.where("false")).count() == 0


def test_pipeline_stages_keep_columns_and_values(awkward, nothing, labels, spark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    decided = {
        "quality classifier": {r[:2] for r in quality.classify(awkward.select("doc_id", "text")).where(
            F.col("quality_score") >= quality.THRESHOLD).select("doc_id", "text").collect()},
        "toxicity": {r[:2] for r in toxicity.score(awkward.select("doc_id", "text"), labels).where(
            F.col("toxicity") < toxicity.THRESHOLD).select("doc_id", "text").collect()},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, awkward, str(tmp_path))
        assert kept.columns == awkward.columns
        assert kept.join(awkward.distinct(), [kept[c].eqNullSafe(awkward[c]) for c in awkward.columns], "left_anti").count() == 0
        if name in decided:
            assert {(r.doc_id, r.text) for r in kept.collect()} == decided[name]
        assert stage(spark, nothing, str(tmp_path)).columns == awkward.columns
        assert stage(spark, nothing, str(tmp_path)).count() == 0
    assert corpus_pipeline.packed(spark, nothing, str(tmp_path)).count() == 0
