"""Bounded samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees: the remainder of crc32 of the id as text by 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """``(text, label)`` of at most ``per_class`` training rows of each label, and how many rows of each label there are.

    The rows of the least id hashes are taken. They are picked from ids and labels alone, so that no text but theirs is
    moved; the picked ids, ``per_class`` for each label, are few enough to send to every executor. Of a repeated
    id one text is taken, and its largest label. Null ids, labels and texts take no part.
    """
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    share = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = known.limit(0)
    for value in sorted(share):
        picked = picked.union(known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label"), share
