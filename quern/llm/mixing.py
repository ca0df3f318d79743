"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Sizes are summed by source and hash bucket, the bucket in which a source's budget ends is refined twice, and rows pass by comparing
their hash with the threshold found: no sort of rows, and one scan of the texts.

Defined cases: a null text has size 0; a null source is a source, the last; sources are ordered by code point; rows that are copies,
identifier and text included, share a hash and are taken alike; a source without words has target 0; an empty table gives an empty
result; input columns come back inside `row`, so their names cannot clash. A source's taken words miss the target by half the size of
one document, or of one group of such copies, at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut, ship

WORD = r"[^\x20\x09-\x0D]+"
#: A row's hash has LEVELS * BITS bits; each level of the histogram has 2**BITS buckets.
LEVELS, BITS = 3, 12
#: Taken words in all, as a share of all sizes; the most that a source, and so a document, gives, as a multiple of its size.
SHARE, MOST = 1.5, 2.0
WEIGHTS = (3.0, 1.0, 2.0)


def row_hash(key: Column, text: Column) -> Column:
    """36 bits of an MD5 of identifier and text."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes has a row for each source: source, source_size. Adds target: shares by weight, held at MOST times the source, the rest reshared.

    Reshared until none is above, each target is min(MOST * size, level * weight) for one level. In the order of size / weight, the level
    is set by the first source that stays below its hold.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (n % len(WEIGHTS) + 1).cast("int"))).withColumn("n", n)
    w = w.withColumn("hold", F.col("source_size") * MOST)
    up = Window.orderBy(F.col("hold") / F.col("weight"), "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy(F.lit(0))
    w = w.withColumn("before", F.sum("hold").over(up) - F.col("hold")).withColumn("left", F.sum("weight").over(total) - F.sum("weight").over(up) + F.col("weight"))
    w = w.withColumn("level", (F.sum("source_size").over(total) * SHARE - F.col("before")) / F.col("left"))
    w = w.withColumn("level", F.min(F.when(F.col("hold") / F.col("weight") >= F.col("level"), F.struct(F.col("hold") / F.col("weight"), "n", "level"))).over(total)["level"])
    return w.select("source", "source_size", F.least("hold", F.col("level") * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: source, source_size, target. Adds passes (whole passes over the source) and below: rows whose hash is under it come once more."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = cut(wanted.withColumn("passes", passes).withColumn("need", F.col("target") - F.col("passes") * F.col("source_size")))
    state = wanted.select("source", F.lit(0).cast("long").alias("bucket"), "need")
    for level in range(LEVELS):
        low = BITS * (LEVELS - 1 - level)
        at = state.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "need")
        inside = rows if not level else rows.join(at.select("s", "b"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", low + BITS) == F.col("b")))
        sums = inside.groupBy("source", F.shiftright("hash", low).alias("bucket")).agg(F.sum("size").alias("n"))
        order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("n").over(order))
        state = cut(
            sums.join(at.select("s", "need"), F.col("source").eqNullSafe(F.col("s")))
            .where((F.col("upto") - F.col("n") <= F.col("need")) & (F.col("need") < F.col("upto")))
            .select("source", "bucket", (F.col("need") - F.col("upto") + F.col("n")).alias("need"), "n")
        )
    last = state.select(F.col("source").alias("s"), (F.col("bucket") + (F.col("n") - F.col("need") < F.col("need")).cast("long")).alias("below"))
    found = wanted.join(last, F.col("source").eqNullSafe(F.col("s")), "left")
    return cut(found.select("source", "source_size", "target", "passes", F.coalesce("below", F.lit(0)).alias("below")))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """For every row of docs: row (a struct of its columns, or of carry), size (words), source_size, target (its source's), copies (0 to MOST)."""
    ship(docs.sparkSession)
    at = F.col(f"`{text}`").cast("string")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.coalesce(F.regexp_count(at, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_hash(F.col(f"`{key}`"), at).alias("hash"),
    )
    rows = cut(rows)
    sizes = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    found = thresholds(rows.select("source", "size", "hash"), targets(sizes)).withColumnRenamed("source", "s")
    out = rows.join(found, F.col("source").eqNullSafe(F.col("s")))
    return out.select("row", "size", "source_size", "target", (F.col("passes") + (F.col("hash") < F.col("below")).cast("long")).alias("copies"))


def oracle_sql() -> str:
    """The same in DuckDB SQL, with one histogram of single hashes in place of the levels."""
    return r"""
WITH rows AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')), 1, 9) AS BIGINT) AS hash FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS n, source_size * 2.0::DOUBLE AS hold FROM sizes),
levels AS (SELECT *, hold / weight AS ratio, (sum(source_size) OVER () * 1.5::DOUBLE - (sum(hold) OVER up - hold)) / (sum(weight) OVER () - sum(weight) OVER up + weight) AS level
    FROM weighed WINDOW up AS (ORDER BY hold / weight, n ROWS UNBOUNDED PRECEDING)),
wanted AS (SELECT source, source_size, least(hold, weight * (SELECT arg_min(level, (ratio, n)) FROM levels WHERE ratio >= level)) AS target FROM levels),
needs AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM wanted),
sums AS (SELECT source, hash, sum(size) AS n FROM rows GROUP BY source, hash),
upto AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY hash ROWS UNBOUNDED PRECEDING) AS upto FROM sums),
ends AS (SELECT u.source, min(CASE WHEN u.upto - (t.target - t.passes * t.source_size) < (t.target - t.passes * t.source_size) - (u.upto - u.n) THEN u.hash + 1 ELSE u.hash END) AS below
    FROM upto u JOIN needs t ON u.source IS NOT DISTINCT FROM t.source
    WHERE u.upto - u.n <= t.target - t.passes * t.source_size AND t.target - t.passes * t.source_size < u.upto GROUP BY u.source)
SELECT r.doc_id, r.size, t.source_size, t.target, CAST(r.size * (t.passes + CASE WHEN r.hash < coalesce(e.below, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rows r JOIN needs t ON r.source IS NOT DISTINCT FROM t.source LEFT JOIN ends e ON r.source IS NOT DISTINCT FROM e.source"""
