"""The corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last
return the columns of ``documents``; every stage's result is written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.llm.decontaminate import leaks
from veritide.llm.near_dup import near_duplicates
from veritide.llm.packing import digest_columns, pack
from veritide.llm.quality import score, train
from veritide.llm.secrets import redact
from veritide.llm.shared import made, new_path, read, ship, sweep, unused, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _own_ids(docs: DataFrame) -> bool:
    """Whether every row has an id that no other row has."""
    return docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty()


def _one_of_each(rows: DataFrame) -> DataFrame:
    """One row of each id and text; rows with neither id nor words are nothing's copy and all stay."""
    loose = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rest = [c for c in rows.columns if c not in ("doc_id", "text")]
    held = unused(rows, "rest")
    one = rows.where(~loose).groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias(held))
    return one.select("doc_id", "text", f"{held}.*").select(*rows.columns).unionByName(rows.where(loose))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; null ids are kept if their text passes."""
    ship(spark)
    machine = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, machine, keep=docs.columns, accepted=True)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group at similarity 0.8 or more: that with the smallest id, any if none has an id.

    Rows are told apart by their ids; where some are null or repeated, by a hash of id and text.
    """
    if _own_ids(docs):
        copy = unused(docs, "copy")
        copies = near_duplicates(docs, percent=80).where("NOT kept").select(F.col("doc_id").alias(copy)).distinct()
        return docs.join(copies, F.col("doc_id") == F.col(copy), "left_anti")
    key, keep = unused(docs, "key"), unused(docs, "keep")
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    groups = near_duplicates(rows, percent=80, id_col=key).select(F.col(key).alias("of"), "component_id").distinct()
    ids = rows.select(F.col(key).alias("key"), "doc_id").distinct().join(groups, F.col("key") == F.col("of"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    kept = written(ids.groupBy("component_id").agg(first.alias("f")).select(F.col("f.key").alias(keep)), "kept")
    return _one_of_each(rows.join(kept, F.col(key) == F.col(keep), "left_semi").select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item within its error budget, by their texts, whatever their ids."""
    key, leak = unused(docs, "text_of"), unused(docs, "leak")
    rows = docs.withColumn(key, F.unhex(F.sha2("text", 256)))
    found = leaks(rows, read(spark, sf_dir, "benchmark"), id_col=key)
    found = written(found.select(F.col(key).alias(leak)).distinct(), "leaks")
    return rows.join(found, F.col(key) == F.col(leak), "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by a mark; n_chars of changed texts is counted again."""
    before = unused(docs, "before")
    clean = redact(docs.withColumn(before, F.xxhash64("text")), new_path(spark, "secret-ledger"))
    changed = F.xxhash64("text") != F.col(before)
    n = F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of 2048 tokens; one row for each piece."""
    return digest_columns(pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: No stage but the secrets can be expressed in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages wrote besides is deleted once the next one has been written."""
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    own = made()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep(spark, [p for p in made()[:-1] if p not in own])
    return docs
