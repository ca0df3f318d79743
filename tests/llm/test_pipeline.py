"""Stages of the pipeline against plain versions of what they decide, on a small corpus."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quern.llm import mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(1)
    word = lambda: "".join(r.choices("th er on ing a be".split(), k=r.randint(1, 3)))
    rows, labels = [], []
    shared = " ".join(word() + "q" for _ in range(60))
    for i in range(240):
        bad = i % 4 == 0
        text = " ".join((word() + "!!").upper() if bad else word() for _ in range(r.randint(30, 200)))
        text = f"{text} {shared}" if i % 10 == 5 else text
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not bad), 0))
    rows += [(300 + k, rows[1][1], "en", "s1", rows[1][4]) for k in range(3)] + [(400, None, None, None, None), (401, "", "en", "s0", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in P.STAGES:
        docs = stage(spark, docs, folder).cache()
        kept.append(docs)
        if name != P.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good, single, cut, mixed, encoded = kept
    ids = {r.doc_id for r in good.collect()}
    assert not [i for i in ids if i < 240 and i % 4 == 0] and {i for i in range(240) if i % 4} <= ids
    assert {r.doc_id for r in single.collect()} == ids - {300, 301, 302}
    lengths = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    before = {r.doc_id: r.text for r in single.collect()}
    assert set(lengths) == set(before)
    assert 400 not in before or lengths[400][0] in (None, "")
    words = {i: (t or "").split() for i, t in before.items()}
    count = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    for i, w in words.items():
        gone = {p for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        assert lengths[i][0] == (" ".join(x for p, x in enumerate(w) if p not in gone) if gone else before[i])
    assert all(len(lengths[i][0].split()) <= len(words[i]) - 60 for i in words if i < 240 and i % 10 == 5)
    copies = {r["row"]["doc_id"]: r.copies for r in mixing.mix(cut).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})
    out = encoded.collect()
    assert len(out) == sum(copies.values()) and all(r.round_trip for r in out)
    assert all(r.n_ids == len(r.ids) for r in out)


def test_run(spark, folder):
    assert P.run(spark, folder).count() > 100


def test_clashing_columns(spark, folder, tmp_path):
    extra = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("IDS", "n_ids", "round_trip", "row", "class", "copies", "score", "kept_text", "size"):
        extra = extra.withColumn(name, F.lit("clash"))
    extra.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = P.run(spark, str(tmp_path))
    assert out.dtypes[-3:] == [("ids", "array<int>"), ("n_ids", "bigint"), ("round_trip", "boolean")] and "IDS" not in out.columns
    assert out.count() == P.run(spark, folder).count() and {r["class"] for r in out.select("class").collect()} == {"clash"}


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_held_out_rule(spark):
    df = spark.createDataFrame([(1,), (None,)], "k long").select(quality.held_out(F.col("k")))
    assert all(isinstance(r[0], bool) for r in df.collect())
