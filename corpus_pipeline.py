"""The corpus pipeline: five stages over documents, each a function (spark, docs, sf_dir) -> DataFrame.

Each stage works on all rows that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import mixing, near_dup, pieces, pii, toxicity
from sheaf.llm.common import q, release, settle, table
from sheaf.llm.queries import tokenizer_path

#: SQL can't say what boosted trees or pieces are; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject, with all their columns.

    Null and empty texts are scored as texts without words; equal texts stay or go together, repeated rows too. Without
    labels of both kinds the share of toxic labels is every score, so that nothing goes unless most are toxic.
    """
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    inner = docs.select(*(F.col(q(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col("text").alias("body"))
    kept = toxicity.score(inner, model, "body").where("predicted = 0")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest doc_id, and one row of it.

    Texts that are null or have no word are like no other, and rows without an id are in no group: they stay.
    """
    return near_dup.one_of_each(docs, near_dup.near_duplicates(docs))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the new text. Every row stays, and a null text is null."""
    inner = docs.select(*(F.col(q(c)).alias(c if c == "text" else f"c{i}") for i, c in enumerate(docs.columns)))
    found = pii.find_personal(inner)
    new, some = pii.redact(), F.size("spans") > 0
    changed = {"text": new, "n_chars": F.when(some, F.length(new).cast("long")).otherwise(F.col(f"c{docs.columns.index('n_chars')}"))}
    return found.select(*(changed.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most three times each. A null source is a source of its own; rows
    without words take no part in any source's share, and come as often as their source's share says."""
    inner = docs.select(*(F.col(q(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)), mixing.word_count().alias("words"))
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    mixed = mixing.emit(mixing.mix(inner, size="words", source=at["source"], doc_id=at["doc_id"]))
    return mixed.select(*(F.col(k).alias(c) for c, k in at.items()))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the pieces of each text: ids, and the byte offsets of each. Null and empty texts have none."""
    encoded = pieces.encode_offsets(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "starts", "ends")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("pii", redact_personal),
    ("mixing", mix_sources),
    ("pieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage returns is written as a table first."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir))
        release(before, collect=spark)
    return STAGES[-1][1](spark, docs, sf_dir)
