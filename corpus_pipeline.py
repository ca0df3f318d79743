"""A training-corpus pipeline of five stages; each takes and returns documents, the last returns encoded documents.

Each stage works on all rows that the stage before it kept. Defined cases are those of the operators; rows without words pass every stage
but the mix, which takes them like any other row of size 0: with the rows of their hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import mixing, near_dedup, quality, sentencepiece, substring_dedup
from quern.llm.queries import table, tokenizer_path
from quern.session import cut

#: Stages depend on hashes and a trained model, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def _columns(docs: DataFrame, *changed: str) -> list:
    return [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in changed]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, fitted on labelled ones, rejects."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).where(F.col("score") >= quality.THRESHOLD).select(_columns(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: the one with the smallest doc_id."""
    found = near_dedup.classes(docs)  # its classes are written; a table of its rows would hold every text until the application ends
    alone = found.where(F.col("class").isNull() | (F.col("class_size") == 1))
    first = found.where((F.col("class_size") > 1) & F.col("row.doc_id").eqNullSafe(F.col("class_id"))).dropDuplicates(["class"])
    return alone.union(first).select(_columns(docs))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out words in passages that also stand elsewhere."""
    found = substring_dedup.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    changed = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return found.select([changed.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice."""
    return mixing.mix(docs).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(_columns(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, and whether they decode to its text. Input columns of these names make way for them."""
    carried = [c for c in docs.columns if c.lower() not in ("text", "ids", "n_ids", "round_trip")]
    found = sentencepiece.encode(docs, tokenizer_path("piece_bpe_32k.model"), carry=carried, check=True)
    return found.select("row.*", "ids", F.size("ids").cast("long").alias("n_ids"), F.col("same").alias("round_trip"))


STAGES = [("quality classifier", good_quality), ("near-dedup", one_of_each), ("substring dedup", without_repeats), ("mixing", mixed), ("sentencepiece", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
