"""The registered queries of this subpackage: opN_<name>, their SQL, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import embedding_dedup, html_extract, katz, mixing, near_dedup, neighbours, quality, sentencepiece, substring_dedup, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies, on the driver and on executors alike."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), carry=["doc_id"], check=True)
    return out.select("row.doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.col("same").alias("round_trip"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = token_counts.token_counts(docs, tokenizer_path("byte_bpe_50k.json"), carry=["doc_id", "n_bytes"])
    return out.select("row.doc_id", "row.n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    return out.select("row.doc_id", quality.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.classes(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "class_id", "class_size", F.col("row.doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = katz.scores(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows, rows.where(neighbours.asked_every(F.col("vec_id"), 20)), k=20)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup.near(table(spark, sf_dir, "embeddings"), carry=["vec_id"])
    return out.select("row.vec_id", "n_links", "component_id", F.col("row.vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), carry=["page_id", "url"]).select("row.page_id", "row.url", "text", "n_chars")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_sentencepiece": op1_sentencepiece, "op2_token_counts": op2_token_counts, "op3_quality": op3_quality, "op4_near_dedup": op4_near_dedup, "op5_katz": op5_katz, "op6_neighbours": op6_neighbours, "op7_embedding_dedup": op7_embedding_dedup, "op8_mixing": op8_mixing, "op9_html_extract": op9_html_extract, "op10_substring_dedup": op10_substring_dedup}


#: Links by comparing all pairs; components by following links.
OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= CAST(0.9 AS DOUBLE)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
    least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) = vec_id AS kept FROM embeddings"""

#: Windows as texts; a word goes if one of the windows over it occurs twice.
OP10_SQL = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT row, i, array_to_string(words[i : i + 34], ' ') AS w FROM (SELECT row, words, unnest(range(1, len(words) - 33)) AS i FROM docs)),
gone AS (SELECT row, list(p) AS ps FROM (SELECT DISTINCT row, unnest(range(i, i + 35)) AS p FROM windows JOIN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1) USING (w)) GROUP BY row),
singly AS (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM docs),
kept AS (SELECT s.row, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM singly s ANTI JOIN (SELECT row, unnest(ps) AS p FROM gone) g ON g.row = s.row AND g.p = s.p GROUP BY s.row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (row)"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it; the other queries are tested against brute force, exact round trips or held-out accuracy."""
    return {"op7_embedding_dedup": OP7_SQL, "op8_mixing": mixing.oracle_sql(), "op10_substring_dedup": OP10_SQL}
