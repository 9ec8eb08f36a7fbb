"""The corpus pipeline: quality rules, language, near copies, mixture of sources, tokens.

Every stage works on all rows that the one before kept, and all but the last return the columns of `documents`.
Rows with a null or empty text fail the rules. Of the members of a component of near copies the one with the smallest
id stays. Rows that share an id but not their text are documents of their own; of rows alike in both, one stays. Rows
without an id are matched by their texts like all others, and stay only where no row with an id has such a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slicewise.llm import bpe, jaccard, language_id, mixing, queries, rules
from slicewise.llm.tables import documents, stored

ORACLE_SQL = None
#: least cosine with a language for a text to count as written in it
LEAST_SCORE = 0.2
#: near copies: words of a shingle, and least similarity of their sets in percent
COPY_WORDS, COPY_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule of the current policy rejects."""
    return rules.ledger(docs).where(rules.passes(rules.POLICY)).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are written in a language that was learned."""
    train = docs.where(~language_id.held_out("doc_id"))
    found = language_id.predict(docs, language_id.learn(train))
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return found.where(known).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that with the smallest id and, of its texts, the smallest hash."""
    # a row is known by its id and its text; rows without an id come last
    parts = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.xxhash64("text"), F.coalesce(F.octet_length("text"), F.lit(-1))]
    named = docs.withColumn("_key", F.struct(*[p.alias(f"k{n}") for n, p in enumerate(parts)]))
    found = jaccard.near_copies(named.select("_key", "text"), key="_key", words=COPY_WORDS, percent=COPY_PERCENT)
    chosen = found.where(F.col("_key") == F.col("component_id")).select("_key").distinct()
    first = F.row_number().over(W.partitionBy("_key").orderBy(F.xxhash64(*docs.columns)))
    kept = named.join(chosen, "_key", "left_semi").withColumn("_first", first).where("_first = 1")
    return kept.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written near each other as the mixture has them; the last stage gives their places."""
    mixed = mixing.mix(docs, queries.MIX_EXPONENT)
    return mixed.orderBy("slot", "place").select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, the digests of them and of the text decoded from them, and its place in the mixture.

    Written rows have no order of their own, so the mixture is in phase, slot and place. Places depend only on ids,
    texts, sources and the set of documents, so they are those that the stage before sorted by.
    """
    mixed = mixing.mix(docs, queries.MIX_EXPONENT).drop("release", "deadline")
    with open(queries.tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        return bpe.encode(mixed, f.read(), ids=True).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("language", language),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("encode_tokens", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each on the written result of the one before."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
