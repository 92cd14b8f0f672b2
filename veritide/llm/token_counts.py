"""Token counts by a digest cache."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.llm.shared import exists, lean, new_path, read, ship, written
from veritide.llm.tokens import encoder, file_digest

CACHE_SCHEMA = "digest binary, n_tokens long"


def normalised(text: Column) -> Column:
    """Content whose digest is the cache key.  Only null becomes empty: any other change could change a count."""
    return F.coalesce(text.cast("string"), F.lit(""))


def representatives(keyed: DataFrame, rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows (_id, _text, _digest) of one id for each digest that ``known`` (column digest) lacks.

    rows: (_id, _digest) of ``keyed``.  Ids are picked without their texts and combined before the shuffle,
    so that a text shared by a third of the rows is neither moved nor gathered more than once.  Rows
    repeated with their id all stay.
    """
    pick = rows.groupBy("_digest").agg(F.min("_id").alias("_pick")).withColumnRenamed("_digest", "_want")
    pick = pick.join(known, F.col("_want") == F.col("digest"), "left_anti")
    same = (F.col("_digest") == F.col("_want")) & F.col("_id").eqNullSafe(F.col("_pick"))
    return keyed.join(pick.hint("shuffle_hash"), same, "left_semi")


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Counts stored under ``path`` for one tokenizer version; none where nothing is stored yet."""
    here = f"{path}/tokenizer={version}"
    if not exists(spark, here):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(here).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    cache: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; new counts are appended to the Parquet cache.

    tokenizer: path of a tokenizer file, there on every executor.  cache: folder that all executors
    share; a tokenizer's counts lie below its file's digest, so another version never meets them.
    Null text counts as empty: 0 bytes, 0 tokens.  Repeated rows and ids each get their row; a null id
    stays null.  An empty table gives no rows.  Columns other than id and text are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    version = file_digest(tokenizer)[:32]
    text = normalised(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn(
        "_digest", F.unhex(F.sha2(F.col("_text"), 256))
    )
    stored = read_cache(spark, cache, version)

    def encode(batches):
        enc = encoder(tokenizer, "counts")
        for b in batches:
            counts = list(enc.counts(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    rows = written(keyed.select("_id", "_digest", F.octet_length("_text").cast("long").alias("n_bytes")), "keys")
    new = representatives(keyed, rows, stored).select("_digest", "_text").mapInArrow(lean(encode, encodes=True), CACHE_SCHEMA)
    new.write.mode("append").parquet(f"{cache}/tokenizer={version}")
    # Both sides of the join are plain tables, so that Spark can split the rows of a digest that many share.
    counts = written(read_cache(spark, cache, version), "counts")
    return rows.join(counts, F.col("_digest") == F.col("digest")).select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all ``documents``, from an empty cache in the shared folder."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "token-cache"))
