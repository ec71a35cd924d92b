"""Bounded samples of labelled documents for fitting small models on the driver.

Ids are drawn first, by a hash, from the narrow columns alone; texts are then
picked where they are read, so no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _drawn(rows: DataFrame, label: str, cap: int | None, total: int | None) -> Column:
    """True for about ``cap`` rows of each label, or ``total`` spread over the labels; one count per label reaches the driver."""
    sizes = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    each = cap if cap is not None else max(20, (total or 0) // max(1, len(sizes)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = F.lit(False)
    for value, n in sorted(sizes.items()):
        chosen = chosen | ((F.col(label) == F.lit(value)) & (draw < F.lit(each / n)))
    return chosen


def sample_rows(docs: DataFrame, label: str, total: int) -> DataFrame:
    """About ``total`` rows (doc_id, text, label) of ``docs``, as many of each value of its column ``label``.

    Rows without id or label are left out; a label with fewer rows is taken whole.
    """
    rows = docs.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", label)
    return rows.where(_drawn(rows, label, None, total))


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label, once per document; of contradicting rows the larger value holds, null labels and ids do not count."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.max(label).alias(label))


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, cap: int) -> DataFrame:
    """About ``cap`` rows (doc_id, text, label) of each value in ``labels``, which has one row per document.

    At most about ``cap`` ids per label are broadcast to the documents.
    """
    ids = labels.where(_drawn(labels, label, cap, None)).select("doc_id", label)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", label)
