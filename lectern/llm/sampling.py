"""Bounded samples of rows for fitting models, and the split that keeps rows out of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the fifth of all ids that no model may learn from; a null id is false."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    """False for held-out ids and for null, which has no remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def labelled_ids(labels: DataFrame, label: str, per_class: int | None, learnable: bool = True) -> DataFrame:
    """(doc_id, label) of at most per_class ids of each class 0 and 1, the first by a hash of the id; all ids if per_class is None.

    An id with several labels counts as 1 if any is 1; null labels are left out.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    if learnable:
        rows = rows.where(may_learn(F.col("doc_id")))
    ids = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    if per_class is None:
        return ids
    parts = [ids.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1])
