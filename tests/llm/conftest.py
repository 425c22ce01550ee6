import pytest
from texts import prose

CLASHING = ("node", "root", "shard", "slot", "text_hash", "n", "next", "hashes", "toxicity", "word", "row", "chunk", "quality_score")


@pytest.fixture(scope="session")
def awkward_rows():
    """Rows with nulls, empty and long texts, ties, repeated rows."""
    texts = [None, "", " \t\n", "one", "one two", prose(1), prose(1), prose(2, 3000), "x" * 20_000, "é▁ 日本 \x00 ok",
             "ALL RIGHTS RESERVED", "<|endoftext|> idiot"]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (5, prose(1)), (5, prose(1)), (None, prose(3)), (None, None)]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    """The rows with columns whose names the operators use themselves."""
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *CLASHING) for r in awkward_rows], schema)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(i, i % 2, int(i % 5 == 0)) for i in range(12)] + [(3, 1, 1), (None, 1, 1), (4, None, None)],
        "doc_id long, quality int, toxic int",
    )
