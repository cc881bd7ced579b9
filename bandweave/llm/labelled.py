"""A bounded sample of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 11


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(id, label) of at most per_class rows of each label, those with the lowest hashes; held-out and null rows never.

    An id with several labels takes the highest.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    parts = [rows.where(F.col("label") == y).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def with_labels(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", most_chars: int | None = None) -> DataFrame:
    """(id, label, text) of the documents of the training sample; of rows that repeat an id, the least text.

    The sample is bounded by per_class and so broadcast. most_chars bounds the characters of each class's texts too: in
    the order of the sample, a text that would exceed it is passed over.
    """
    chosen = training_labels(labels, label_col, per_class, id_col)
    texts = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    if most_chars is not None:
        sizes = texts.select(id_col, F.char_length(F.coalesce("text", F.lit(""))).alias("n")).join(F.broadcast(chosen), id_col)
        sizes = sizes.groupBy(id_col, "label").agg(F.max("n").alias("n")).orderBy(F.xxhash64(id_col, F.lit(SEED)), id_col)
        room, kept = {}, []
        for row in sizes.collect():  # at most 2 * per_class
            left = room.get(row["label"], most_chars) - row["n"]
            if left >= 0:
                room[row["label"]] = left
                kept.append((row[id_col], row["label"]))
        chosen = docs.sparkSession.createDataFrame(kept, chosen.schema)
    return texts.join(F.broadcast(chosen), id_col).groupBy(id_col, "label").agg(F.min("text").alias("text"))
