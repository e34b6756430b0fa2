"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def labelled_texts(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, most_labels: int | None = None) -> list[tuple[str, object]]:
    """About `per_label` (text, label) pairs of each label, in a fixed order, on the driver.

    The rows of a label are thinned by a hash of their id at the rate its count asks for, so any
    input gives the same sample at any size, and no label's rows meet in one task. Of every label that
    occurs rows are taken, or of the `most_labels` most frequent ones where that is given; hence
    2 * per_label rows a label at most, about.
    """
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("sample_id"), F.col(label_col).alias("sample_label"))
    counts = rows.groupBy("sample_label").agg(F.count("*").alias("label_rows"))
    if most_labels is not None:
        counts = counts.orderBy(F.desc("label_rows"), "sample_label").limit(most_labels)
    # a hash in [0, 1) of the id
    place = F.pmod(F.xxhash64(F.col("sample_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    thinned = rows.join(F.broadcast(counts), "sample_label").where(place < F.lit(per_label) / F.col("label_rows"))
    chosen = thinned.select("sample_id", "sample_label").limit(2 * per_label * counts.count())
    texts = documents.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("sample_text"))
    found = texts.join(F.broadcast(chosen), "sample_id").select("sample_id", "sample_text", "sample_label").collect()
    return [(r["sample_text"] or "", r["sample_label"]) for r in sorted(found, key=lambda r: (str(r["sample_id"]), str(r["sample_label"]), r["sample_text"] or ""))]
