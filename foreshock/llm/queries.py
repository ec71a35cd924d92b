"""The dealt operators over the whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreshock.llm import fingerprints, forest, host_rules, katz, language, neighbours, packing, partenum, periodic, pieces, repeats, toxicity, whitening
from foreshock.llm.base import ORACLE, QUERIES, query, read

__all__ = ["ORACLE", "QUERIES"]

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
CAPACITY = 2048


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 2048 ids as can be had."""
    return packing.pack(read(spark, sf_dir, "documents"), WORD_TOKENIZER, CAPACITY)


@query("op2_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with begin and end, and the decoded text, as digests."""
    return pieces.digests(read(spark, sf_dir, "documents"), PIECE_MODEL)


@query("op3_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon learned from two thirds of the labels, applied to all documents."""
    return toxicity.score_held_out(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op4_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    return language.identify_held_out(read(spark, sf_dir, "documents"))


@query("op10_quality_classifier")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality by nearest-neighbour voting, learned from four fifths of the labels."""
    return neighbours.classify_held_out(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op5_suffix_array_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 200 bytes that occur again."""
    cut = repeats.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), 200)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    return fingerprints.compare(read(spark, sf_dir, "documents"))


@query("op7_quality_rules", host_rules.JUDGE_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules per document and verdicts per host."""
    return host_rules.judge(read(spark, sf_dir, "documents")).drop("host_rate")


@query("op9_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of at least 3/4 of its five-word shingles."""
    return partenum.near_duplicates(read(spark, sf_dir, "documents"))


@query("op8_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a Katz bigram model of six sevenths of them."""
    return katz.score_held_out(read(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, on a grammar of its words."""
    return periodic.digests(read(spark, sf_dir, "documents"))


@query("op12_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the 16 leading components of their distinct rows, whitened."""
    return whitening.whitened_components(read(spark, sf_dir, "embeddings"), 16)


@query("op13_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with a cosine of at least 0.9."""
    return forest.near_vectors(read(spark, sf_dir, "embeddings"))
