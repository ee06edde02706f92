"""Exact dedup in DataFrame functions: groups of a 128-bit content hash, with bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravela.plans.lineage import broadcast_below, cut

#: Hashes of repeated texts that may be broadcast, about 32 MB; beyond that the join shuffles.
BROADCAST_ROWS = 400_000
#: Rows of a group that meet one copy of the text that stays; larger groups are salted.
SALT_ROWS = 256


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Groups of equal texts: (doc_id, keep_id, group_size, kept, text_sha256), one row for each input row.

    keep: "min" or "max", which id of a group stays. A null text counts as empty. Ids may repeat: the first
    row of such a tie is not told from the others, so all rows with keep_id are kept. A group without
    any id has keep_id null and all its rows kept. Other columns are ignored.

    The hash only nominates groups. Each row of a group is compared with the text of the row that would stay,
    and rows that differ (a collision) form groups by their text. Texts that occur once never shuffle.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("hash", hashed(F.col("text")))
    repeated = cut(docs.groupBy("hash").agg(pick("doc_id").alias("model_id"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    small = broadcast_below(repeated, BROADCAST_ROWS)

    singles = docs.join(small, "hash", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.sha2("text", 256).alias("text_sha256"))

    members = docs.join(small, "hash").withColumn("salts", F.floor(F.col("n") / SALT_ROWS).cast("int"))
    models = members.where(F.col("doc_id").eqNullSafe(F.col("model_id"))).dropDuplicates(["hash"])
    models = models.select("hash", F.explode(F.sequence(F.lit(0), F.col("salts"))).alias("salt"), F.col("text").alias("model"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts") + 1).cast("int"))
    compared = salted.join(models, ["hash", "salt"]).select("doc_id", "hash", "salt", "salts", F.sha2("text", 256).alias("text_sha256"), F.when(F.col("text") != F.col("model"), F.col("text")).alias("other"))
    compared = cut(compared)
    groups = compared.groupBy("hash", "other").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max("salts").alias("salts"))
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts")))).drop("salts")
    same = (compared["hash"] == groups["hash"]) & (compared["salt"] == groups["salt"]) & compared["other"].eqNullSafe(groups["other"])
    grouped = compared.join(groups, same).select("doc_id", "keep_id", "group_size", "text_sha256")
    return singles.unionByName(grouped).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """docs without the rows that exact_dedup does not keep; all columns stay. Rows without an id stay."""
    gone = exact_dedup(docs, id_col, text_col, keep).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone"), F.unhex("text_sha256").alias("_digest")).distinct()
    gone = broadcast_below(cut(gone), BROADCAST_ROWS)
    same = (docs[id_col] == gone["_gone"]) & (F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)) == gone["_digest"])
    return docs.join(gone, same, "left_anti")
