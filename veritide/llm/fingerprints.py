"""Merkle fingerprints of documents, in DataFrame functions alone.

A text is cut into sections (after a blank line), paragraphs (after a line feed) and leaves (sentences,
or 160 characters where none ends).  The pieces of each level concatenate to the text, and each node
hashes its children's digests, so equal roots mean equal texts and differing branches locate edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritide.llm.shared import drop, integer_ids, read, written

LEAF = r"[^.!?\n]{1,160}+[.!?]*+ *+\n?+|[.!?]++ *+\n?+|\n"
NODE, SHORT = 12, 10


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of ``text``: root, then |section;paragraph,leaf,leaf... in shortened digests.

    An empty text has a root and one empty section and paragraph; null must be made empty before.
    """

    def paragraphs(section: Column) -> Column:
        return F.transform(
            F.split(section, r"(?<=\n)(?!$)"),
            lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda leaf: F.sha2(leaf, 256)),
        )

    def paragraph(leaves: Column) -> Column:
        short = F.array_join(F.transform(leaves, lambda d: F.concat(F.lit(","), F.substring(d, 1, SHORT))), "")
        return F.struct(F.sha2(F.concat(F.lit("p"), F.array_join(leaves, "")), 256).alias("d"), short.alias("l"))

    def section(inner: Column) -> Column:
        short = F.transform(inner, lambda p: F.concat(F.lit(";"), F.substring(p["d"], 1, NODE), p["l"]))
        whole = F.array_join(F.transform(inner, lambda p: p["d"]), "")
        return F.struct(F.sha2(F.concat(F.lit("s"), whole), 256).alias("d"), F.array_join(short, "").alias("l"))

    df = df.withColumn("_m1", F.transform(F.split(F.col(text), r"(?<=\n\n)(?!$)"), paragraphs))
    df = df.withColumn("_m2", F.transform("_m1", lambda s: F.transform(s, paragraph))).drop("_m1")
    df = df.withColumn("_m3", F.transform("_m2", section)).drop("_m2")
    branches = F.transform("_m3", lambda s: F.concat(F.lit("|"), F.substring(s["d"], 1, NODE), s["l"]))
    root = F.sha2(F.concat(F.lit("r"), F.array_join(F.transform("_m3", lambda s: s["d"]), "")), 256)
    return df.withColumn(out, F.concat(root, F.array_join(branches, ""))).drop("_m3")


def leaves(fingerprint: Column) -> Column:
    return F.regexp_extract_all(fingerprint, F.lit(f",([0-9a-f]{{{SHORT}}})"), F.lit(1))


def likeness(a: Column, b: Column) -> Column:
    """Twice the common distinct leaves over all distinct leaves of both; 1 for equal roots, 0 without a common leaf."""
    x, y = F.array_distinct(leaves(a)), F.array_distinct(leaves(b))
    share = 2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).otherwise(share)


def changed_leaves(a: Column, b: Column) -> Column:
    """Positions (from 0) of the leaves of ``a`` that ``b`` lacks: where an edit lies."""
    own, other = leaves(a), leaves(b)
    at = F.transform(own, lambda d, i: F.when(~F.array_contains(other, d), i))
    return F.filter(at, lambda i: i.isNotNull())


def followers(keys: DataFrame, spread: int = 16) -> DataFrame:
    """(_id, _h, _n, next): for each distinct key the next in descending id, cyclic; no task sees more than some ranges.

    There are up to ``spread`` ranges for each shuffle partition, so that they fall evenly on the tasks.
    """
    down = [F.col("_id").desc_nulls_last(), F.col("_h")]
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(spread * partitions, 1 + keys.count() // 1000)
    ranged = written(keys.repartitionByRange(ranges, *down).withColumn("_pid", F.spark_partition_id()), "ranges")
    key = F.struct("_id", "_h")
    inside = ranged.withColumn("_lead", F.lead(key).over(Window.partitionBy("_pid").orderBy(*down)))
    # One row for each range: its first key belongs behind the last key of the range before, cyclic.
    order = F.struct(F.col("_id").isNull().alias("z"), F.bitwise_not("_id").alias("d"), F.col("_h").alias("h"))
    heads = ranged.groupBy("_pid").agg(F.min_by(key, order).alias("_head"))
    whole = Window.partitionBy(F.lit(0)).orderBy("_pid")
    after = heads.select(
        "_pid", F.coalesce(F.lead("_head").over(whole), F.first("_head").over(whole)).alias("_after")
    )
    return inside.join(F.broadcast(after), "_pid").select("_id", "_h", "_n", F.coalesce("_lead", "_after").alias("next"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses, as the contract words it.

    Null texts are empty.  Rows that repeat with id and text are one document in the order, and each gets
    its result; equal ids with different texts follow each other in the order of their hashes; a null id
    comes last.  A single document is its own next.  Ids must be integers (else TypeError).  An empty table
    gives no rows; other columns are ignored.
    """
    integer_ids(docs, id_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_h", F.xxhash64("_text"))
    keys = written(
        rows.select("_id", "_h", F.char_length("_text").cast("long").alias("_n")).groupBy("_id", "_h", "_n").count(), "keys"
    )
    repeated = keys.where("count > 1").limit(1).count() > 0
    order = written(followers(keys.drop("count")), "followers")
    drop(keys)
    before = order.select(
        F.col("next._id").alias("_k"), F.col("next._h").alias("_kh"),
        F.col("_id").alias("_prev"), F.col("_h").alias("_prev_h"), F.floor(F.col("_n") / 3).cast("int").alias("_take"),
    )
    full = with_fingerprint(rows, "_text", "_fp")
    own = full.join(before.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_kh")))
    give = own.select(F.col("_prev").alias("_to"), F.col("_prev_h").alias("_to_h"), F.substr("_text", F.lit(1), F.col("_take")).alias("_piece"), F.col("_fp").alias("_next_fp"))
    if repeated:
        give = give.dropDuplicates(["_to", "_to_h"])
    n = F.char_length("_text")
    both = own.join(give.hint("merge"), F.col("_id").eqNullSafe(F.col("_to")) & (F.col("_h") == F.col("_to_h"))).select(
        "_id", n.cast("long").alias("n_chars"), "_fp", "_next_fp",
        F.concat(F.substr("_text", F.lit(1), (n - F.floor(n / 3)).cast("int")), "_piece").alias("_edited"),
    )
    both = with_fingerprint(both, "_edited", "_edited_fp")
    return both.select(
        F.col("_id").alias(id_col),
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        F.col("_fp").alias("fingerprint"),
        F.col("_edited_fp").alias("edited_fingerprint"),
        likeness(F.col("_fp"), F.col("_edited_fp")).alias("near_edited"),
        likeness(F.col("_fp"), F.col("_next_fp")).alias("near_next"),
    )


def op9_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))
