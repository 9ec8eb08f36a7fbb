"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, brown, collocations, extraction, hard_negatives, jaccard, language_id, minhash, mixing, neighbours, piece_counts,
    rules, warc,
)
from .oracles import ORACLES as ORACLES
from .tables import documents


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file (see /opt/tokenizers/README.md)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document, learned from those that are not held out."""
    return brown.score(documents(spark, sf_dir))


#: a source's target weight goes with the square root of its size
MIX_EXPONENT = 0.5


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mixture of all sources."""
    docs = documents(spark, sf_dir).select("doc_id", "source", F.xxhash64("text").alias("text"))
    return mixing.mix(docs, MIX_EXPONENT).drop("text")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extraction.extract(documents(spark, sf_dir, "pages"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with byte_bpe_50k.json."""
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        source = f.read()
    return bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), source).drop("text")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by piece_bpe_32k.model."""
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return piece_counts.count_tokens(documents(spark, sf_dir), model)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back over the chain of records."""
    return warc.round_trip(documents(spark, sf_dir, "pages"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return neighbours.search(documents(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document, the contract's base verdict and that of the current policy."""
    rows = rules.ledger(documents(spark, sf_dir))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base = ~rules.passes(rules.BASE)
    return rows.select(
        *names, base.alias("base_failed"), (~base & rules.passes(rules.POLICY)).alias("kept"), "failed"
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn(
        "held_out", language_id.held_out("doc_id")
    )
    prototypes = language_id.learn(docs.where(~F.col("held_out")))
    return language_id.predict(docs.drop("lang"), prototypes).drop("text")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 4-word shingles with a similarity of 0.85 or more."""
    return jaccard.near_copies(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return collocations.mine(documents(spark, sf_dir))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 5-word shingles with a similarity of 0.85 or more."""
    return minhash.near_dedup(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of the five positives of every vector whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = documents(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_brown_scores": op1_brown_scores,
    "op2_mixing": op2_mixing,
    "op3_html_text": op3_html_text,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_token_counts": op5_token_counts,
    "op6_warc": op6_warc,
    "op7_neighbours": op7_neighbours,
    "op8_quality_rules": op8_quality_rules,
    "op9_language": op9_language,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_collocations": op11_collocations,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
