"""A corpus made ready for training: filters, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all the documents it is given
and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreshock.llm import neighbours, packing, partenum, queries, repeats, toxicity
from foreshock.llm.base import reach, read, stored

#: Models, components and packing cannot be stated in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the lexicon, learned from the labels, rejects."""
    reach(spark)
    return toxicity.keep_clean(docs, toxicity.learn_toxicity(docs, read(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the nearest labelled neighbours vote down."""
    reach(spark)
    return neighbours.keep_good(docs, neighbours.learn_quality(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies."""
    reach(spark)
    return partenum.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that occur again; a null text stays null, n_chars is counted anew."""
    reach(spark)
    # Columns of the corpus that are named like a result wait under names of their own.
    aside = {c: f"_corpus_{c}" for c in docs.columns if c in ("n_bytes", "n_removed", "n_spans", "kept")}
    cut = repeats.remove_repeats(docs.withColumnsRenamed(aside), 200, as_text=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    cut = cut.withColumns({"text": text, "n_chars": F.length(text).cast("long")})
    return cut.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, as pieces packed into sequences of 2048 ids."""
    reach(spark)
    return packing.pack(docs, queries.WORD_TOKENIZER, queries.CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_poor),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
