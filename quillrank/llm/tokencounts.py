"""Token counts (operator 12): a cache of counts by digest.

A text's content is its UTF-8 bytes, null as empty: the only normalisation that changes no count.
Its key is SHA-256 of the content, beside a digest of the tokenizer's version (the bytes of its
file and the library's version). Contents whose key is stored are not encoded. Of the others one
text per key is encoded, and the counts are appended to the cache.

The texts are shuffled once, by key, after each task has merged its equal texts; when the cache
holds something, keys alone are compared first and only texts that miss are moved. No row is
dropped or cut. Repeated rows, null and clashing columns: one result per row of `docs`, with its
doc_id as it is (null stays null). Null and empty texts have no bytes and the count of the empty
text. An empty table gives no rows and adds nothing to the cache.

A cache may be filled by several jobs at once: rows are only appended, and readers merge rows of
equal keys, which hold equal counts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank import scale
from quillrank.llm import batches
from quillrank.session import scratch, stored

LIMIT = 512
CACHED = "digest binary, n_tokens long"
# Runs of white space, each with what follows; only the last may have nothing behind it.
RUNS = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
MEMO = 400_000
AT_ONCE = 2048


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def library(path: str):
    """The library that reads the tokenizer's file."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece
    import tokenizers

    return tokenizers


def version(path: str) -> str:
    """Digest of everything that decides a count: the tokenizer's file and the library."""
    made = library(path)
    own = f"{made.__name__} {made.__version__} ".encode()
    return hashlib.sha256(own + Path(path).read_bytes()).hexdigest()


def cuts_at_spaces(path: str) -> bool:
    """Whether no token of this vocabulary crosses from other characters to white space, whatever stands around.

    So it is for byte-level vocabularies cut by the usual pattern, without a normaliser, a prefix
    or added tokens that take white space in.
    """
    if not path.endswith(".json"):
        return False
    made = json.loads(Path(path).read_text())
    cut = made["pre_tokenizer"] or {}
    return (
        made["normalizer"] is None and made["post_processor"] is None and made["truncation"] is None
        and cut.get("type") == "ByteLevel" and cut.get("use_regex") is True and cut.get("add_prefix_space") is False
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in made["added_tokens"])
    )


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of a list of texts, as the tokenizer's library gives them, nothing added, nothing cut off."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    import tokenizers

    model = tokenizers.Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def whole(texts: list[str]) -> list[int]:
        return [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    if not cuts_at_spaces(path):
        return whole
    memo: dict[str, int] = {}

    def by_runs(texts: list[str]) -> list[int]:
        runs = [RUNS.findall(text) for text in texts]
        if len(memo) > MEMO:
            memo.clear()
        fresh = list({run for found in runs for run in found} - memo.keys())
        for at in range(0, len(fresh), AT_ONCE):
            memo.update(zip(fresh[at : at + AT_ONCE], whole(fresh[at : at + AT_ONCE]), strict=True))
        return [sum(map(memo.__getitem__, found)) for found in runs]

    return by_runs


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame | None:
    """(digest, n_tokens) of one tokenizer's version, one row per digest; None where nothing is stored."""
    try:
        rows = spark.read.schema(CACHED).parquet(f"{cache}/tokenizer={version(tokenizer)}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def add_missing(contents: DataFrame, cache: str, tokenizer: str) -> None:
    """Encode what the cache lacks of `contents` (digest, content), once per digest, and append the counts."""
    known = read_cache(contents.sparkSession, cache, tokenizer)
    missing = None
    if known is not None:
        # Keys are compared before any text moves.
        asked = contents.select("digest").distinct()
        missing = stored(asked.join(known, "digest", "left_anti"), "missing-digests")
        if missing.isEmpty():
            return
        if scale.estimated_bytes(missing) <= scale.broadcast_bytes(missing):
            contents, missing = contents.join(F.broadcast(missing), "digest", "left_semi"), None
    each = contents.groupBy("digest").agg(F.first("content").alias("content"))
    if missing is not None:
        each = each.join(missing, "digest", "left_semi")

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        # Spark has already dealt the texts out to the cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = counter(tokenizer)
        for part in batches.slices(parts, "content"):
            counts = count(part.column("content").to_pylist())
            yield pa.record_batch([part.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    each.mapInArrow(encode, CACHED).write.mode("append").parquet(f"{cache}/tokenizer={version(tokenizer)}")


def count_tokens(
    docs: DataFrame,
    *,
    cache: str | None = None,
    tokenizer: str | None = None,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of `docs`; see the module.

    `cache` is a folder that all executors share and that outlives the job; without one a fresh
    folder is used, and every distinct text is encoded. `tokenizer` is a `.json` file of the
    tokenizers library or a `.model` file of sentencepiece, at a path that all executors have.
    """
    path = tokenizer or default_tokenizer()
    cache = (cache or scratch(docs.sparkSession, "token-counts")).rstrip("/")
    content = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), content.alias("content")).withColumn(
        "digest", F.unhex(F.sha2(F.col("content").cast("binary"), 256))
    )
    add_missing(keyed.select("digest", "content"), cache, path)
    known = read_cache(docs.sparkSession, cache, path)
    if known is None:  # nothing was asked and nothing is stored
        known = docs.sparkSession.createDataFrame([], CACHED)
    # Written, so that the join reads plain exchanges and adaptive execution can split a hot digest.
    known = stored(known, "token-counts")
    sized = keyed.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), "digest")
    return sized.join(known, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
