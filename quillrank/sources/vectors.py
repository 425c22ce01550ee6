"""Vector tables and the content-addressed embedding cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank import scale
from quillrank.operators.labels import upsert
from quillrank.session import stored as stored_once


def subject_namespaces(subjects: Column, prefix: str) -> Column:
    return F.array_distinct(F.transform(subjects, lambda s: F.concat(F.lit(prefix + "-"), s)))


def fan_out(records: DataFrame, subjects: str = "subjects", prefix: str = "corpus") -> DataFrame:
    """A copy of each record in the default namespace and in each of its subjects'."""
    spaces = F.concat(F.array(F.lit(None).cast("string")), subject_namespaces(F.col(subjects), prefix))
    return records.withColumn("namespace", F.explode(spaces))


def last_records(records: DataFrame, order: str = "seq") -> DataFrame:
    """Last write per (namespace, id); only the newest row of a key leaves each task."""
    keys = ["namespace", "id"]
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def upsert_vectors(table: DataFrame, records: DataFrame, order: str = "seq") -> DataFrame:
    """Table after a batch of writes."""
    new = last_records(records, order)
    if order not in table.columns:
        new = new.drop(order)
    # Either side has one row per key by now.
    return upsert(table, new.select(*table.columns), ["namespace", "id"], F.lit(0))


def _folder(namespace: Column) -> Column:
    """Folder name of a namespace. The letter keeps names like 01 texts and sets the default apart."""
    return F.coalesce(F.concat(F.lit("n"), namespace), F.lit("default"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """A new table: one folder per namespace, so that a query reads only the namespaces it names.

    Rows are gathered by namespace into files of even size; a large namespace has several.
    """
    _write_generation(vectors, path, 1, "overwrite", None)


def _write_generation(vectors: DataFrame, path: str, generation: int, mode: str, spaces: DataFrame | None) -> None:
    """Write the rows, then name their folders (`spaces`, or all) as the newest ones of their namespaces.

    Readers see the new folders by the second step only, which is one small write. Folders of a
    writer that was lost before it are never named; its number is used again.
    """
    spark = vectors.sparkSession
    placed = vectors.withColumn("space", _folder(F.col("namespace"))).withColumn("generation", F.lit(generation)).drop("namespace")
    rows = placed.hint("rebalance", "space").write.partitionBy("generation", "space")
    if mode == "append":
        rows = rows.option("partitionOverwriteMode", "dynamic")
    rows.mode("overwrite").parquet(f"{path}/rows")
    if spaces is None:
        spaces = _folders(spark, path).where(F.col("generation") == generation).select("space").distinct()
    spaces.select("space", F.lit(generation).alias("generation")).coalesce(1).write.mode(mode).parquet(f"{path}/named")


def _folders(spark, path: str) -> DataFrame:
    """Rows of all generations. Names of namespaces stay texts."""
    stored = spark.read.parquet(f"{path}/rows")
    kept = [f for f in stored.schema.fields if f.name not in ("space", "generation")]
    schema = T.StructType([*kept, T.StructField("generation", T.IntegerType()), T.StructField("space", T.StringType())])
    return spark.read.schema(schema).parquet(f"{path}/rows")


def _newest(spark, path: str) -> DataFrame:
    """(space, generation) as readers should see them: one row per namespace."""
    named = spark.read.schema("space string, generation int").parquet(f"{path}/named")
    # The comparison holds always; with it the optimizer prunes folders by this table while a query runs.
    return named.groupBy("space").agg(F.max("generation").alias("generation")).where(F.col("generation") > 0)


def merge_vectors(spark, path: str, records: DataFrame, order: str = "seq") -> None:
    """Upsert a batch into the stored table, reading and writing the namespaces it touches only.

    Other namespaces keep their files. Old folders of a namespace stay for readers that have
    begun with them. One writer at a time.
    """
    new = stored_once(last_records(records, order), "vector-batch")
    touched = new.select(_folder(F.col("namespace")).alias("space")).distinct()
    newest = _newest(spark, path)
    last = newest.agg(F.max("generation")).first()[0] or 0
    if new.isEmpty():
        return
    old = _named(_current(spark, path, newest.join(touched, "space", "left_semi")))
    if order not in old.columns:
        new = new.drop(order)
    after = upsert(old, new.select(*old.columns), ["namespace", "id"], F.lit(0))
    _write_generation(after, path, last + 1, "append", touched)


def _current(spark, path: str, newest: DataFrame) -> DataFrame:
    return _folders(spark, path).join(F.broadcast(newest) if _few(newest) else newest, ["space", "generation"]).drop("generation")


def _few(names: DataFrame) -> bool:
    return scale.estimated_bytes(names) <= scale.broadcast_bytes(names)


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("namespace", F.when(F.col("space") != "default", F.substring("space", 2, 1 << 20))).drop("space")


def read_vectors(spark, path: str, namespaces: list[str | None] | None = None) -> DataFrame:
    """The newest rows, of the named namespaces if any are named."""
    newest = _newest(spark, path)
    if namespaces is not None:
        newest = newest.where(F.col("space").isin(["default" if n is None else f"n{n}" for n in namespaces]))
    return _named(_current(spark, path, newest))


def cache_key(embedding_id: Column, text: Column) -> Column:
    return F.sha2(F.concat(embedding_id, F.lit("\n"), text), 256)


def lookup(texts: DataFrame, cache: DataFrame, embedding_id: str, text: str = "text") -> DataFrame:
    """Texts with their key, `hit`, and the cached vector or null. A key may be in the cache repeatedly."""
    keyed = texts.withColumn("key", cache_key(F.lit(embedding_id), F.col(text)))
    known = cache.groupBy("key").agg(F.first("embedding").alias("values"))
    return keyed.join(known, "key", "left").withColumn("hit", F.col("values").isNotNull())


def missing_texts(texts: DataFrame, cache: DataFrame, embedding_id: str, text: str = "text") -> DataFrame:
    """Distinct (key, text) that the cache lacks; repeated texts are embedded once."""
    keyed = texts.select(cache_key(F.lit(embedding_id), F.col(text)).alias("key"), F.col(text).alias("text"))
    return keyed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.any_value("text").alias("text"))


def fill_cache(texts: DataFrame, cache: DataFrame, provider, path: str, text: str = "text") -> None:
    """Embed what the cache lacks and append it."""
    from quillrank.operators.knn import embed

    found = embed(missing_texts(texts, cache, provider.embedding_id, text), provider, out="embedding")
    found.select("key", F.lit(provider.embedding_id).alias("model"), "embedding").write.mode("append").parquet(path)
