"""Operators of quern.llm against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from quern.llm import components, embedding_dedup, html_extract, katz, mixing, near_dedup, neighbours, quality, sentencepiece, substring_dedup, token_counts
from quern.llm import words as W
from quern.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, part int, row string"
VOCABULARY = [a + b for a in ("th", "er", "on", "qu", "É", "x,") for b in ("a", "en", "ing", "or", "Us")]


def texts(n=60, seed=1):
    r = random.Random(seed)
    passage = [r.choice(VOCABULARY) + str(i) for i in range(60)]
    out = []
    for i in range(n):
        w = [r.choice(VOCABULARY) + str(r.randint(0, 400)) for _ in range(r.randint(1, 160))]
        if i % 5 == 0:
            at = r.randint(0, len(w))
            w[at:at] = passage
        out.append(r.choice((" ", "\n", "\t ")).join(w))
    out += [None, "", "  \n ", "one", "one two three", "same same same same same same " * 9, "word " * 5000, out[3], out[3], out[7].replace("a", "a", 1) + " tail"]
    long = out[1].split()
    for k in range(8):  # near copies: a few words changed
        copy = (long + out[2].split())[:200]
        copy[r.randrange(len(copy))] = f"changed{k}"
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    rows = [(i, x, "en", f"s{i % 4}" if i % 9 else None, len(x or ""), "a", 1, "b") for i, x in enumerate(t)]
    return [*rows, rows[4], rows[4], (None, "no name at all here today", None, None, 0, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["row"]["doc_id"]].append(r)
    return out


# words


def test_word_hashes_follow_words(monkeypatch):
    t = [*texts(20), "a" * 5000]
    plain, at = W.hashes(pa.array(t))
    assert np.diff(at).tolist() == [len(words_of(x)) for x in t]
    flat = [w for x in t for w in words_of(x)]
    assert len({(w, h) for w, h in zip(flat, plain.tolist())}) == len(set(flat)) == len(set(plain.tolist()))
    monkeypatch.setattr(W, "SEGMENT", 64)
    W._powers.clear()
    again, at2 = W.hashes(pa.array(t))
    W._powers.clear()
    assert (again == plain).all() and (at2 == at).all()
    folded, _ = W.hashes(pa.array(["ABC É", "abc É", "abc é"]), folded=True)
    assert folded[0] == folded[2] == folded[4] and folded[1] == folded[3] != folded[5]


def test_rolling_hashes_are_of_windows():
    t = ["a b c d e", "x a b c", "", "a b"]
    h, at = W.hashes(pa.array(t))
    r, first = W.rolling(h, at, 3)
    assert len(r) == 5 and r[0] == r[4] and len(set(r.tolist())) == 4 and first.tolist() == [0, 1, 2, 5, 6]


# 1 SentencePiece


def test_model_is_rebuilt_exactly(rows):
    r = random.Random(2)
    odd = ["", "  ", "a  b", " lead", "trail ", "\n\t x", "a" * 50, "-" * 77, "😀é漢字", "▁▁a ▁b", "<s> </s> <unk> <0x41>", "\x00\x01", "ﬁ ﷺ", "0" * 33]
    odd += ["".join(r.choice("aab -=_.\n 0é漢") for _ in range(r.randint(1, 60))) for _ in range(500)]
    assert sentencepiece.differences(tokenizer_path("piece_bpe_32k.model"), odd + [x[1] or "" for x in rows]) == []


def test_long_texts_are_encoded_in_runs(spark, rows, monkeypatch):
    path = tokenizer_path("piece_bpe_32k.model")
    long = [" ".join(x[1] or "" for x in rows)[:300_000], "x" * 150_000, "日本語 " * 40_000, "a  b \n" * 30_000, "one two " * 20_000]
    assert len(sentencepiece.runs(long[4])) > 2 and " ".join(sentencepiece.runs(long[0])) == long[0]
    got = sentencepiece.encode(spark.createDataFrame(list(enumerate(long)), "n int, text string"), path, check=True, parity=True).collect()
    assert all(r.same and r.parity for r in got) and len(got) == len(long)
    monkeypatch.setattr(sentencepiece, "RUN", 5)
    short = [x[1] or "" for x in rows][:60] + ["a b c d e f g  h i", "1 2 3 é 4 5 6 7"]
    assert sentencepiece.differences(path, short) == []


def _field(n, kind, body):
    return bytes([n << 3 | kind]) + body


def _blob(n, data):
    size, out = len(data), b""
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return _field(n, 2, out + bytes([size]) + data)


def test_unigram_models_are_read(tmp_path):
    import struct

    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("▁ab", -1.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("c", -4.0, 1)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    data = b"".join(_blob(1, _blob(1, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, bytes([k]))) for p, s, k in pieces)
    data += _blob(2, _field(3, 0, b"\x01") + b"\x98\x02\x01") + _blob(3, _field(3, 0, b"\x01") + _field(4, 0, b"\x00") + _field(5, 0, b"\x01"))
    m = sentencepiece.parse(data)
    assert (m.kind, m.byte_fallback, m.dummy_prefix, m.one_space, len(m.pieces)) == (sentencepiece.UNIGRAM, True, True, False, 262)
    (tmp_path / "m.model").write_bytes(data)
    t = sentencepiece.build(data)
    assert [e.ids for e in t.encode_batch(["ab c", "d"], add_special_tokens=False)][0] == [2, 1, 5]
    assert t.decode(t.encode("ab d", add_special_tokens=False).ids) == "ab d"


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_ids_are_the_librarys(spark, tmp_path, rows, byte_fallback):
    import sentencepiece as library

    r = random.Random(2)
    path = str(tmp_path / "u.model")
    texts = [" ".join((x[1] or "").split()[:200]) for x in rows]
    with open(path, "wb") as f:
        library.SentencePieceTrainer.train(sentence_iterator=iter([x for x in texts if x]), model_writer=f, model_type="unigram", vocab_size=400, hard_vocab_limit=False, byte_fallback=byte_fallback, num_threads=1, minloglevel=2)
    odd = ["", " ", "<s>", "a <s> </s> b", "<unk>", "x<unk>y", "<0x41>", "one<0x0A>two é", "＜ｓ＞ ＜0x41＞", "漢字 😀", "a  b", "▁▁a"]
    odd += ["".join(r.choice(["a", "b", "e", " ", "<", "<s>", "<0x41>", "漢", "one", ">"]) for _ in range(r.randint(1, 20))) for _ in range(300)]
    assert sentencepiece.differences(path, odd + texts) == []
    assert sentencepiece.build(open(path, "rb").read()).encode("a<s></s><unk>", add_special_tokens=False).ids == library.SentencePieceProcessor(model_file=path).encode("a<s></s><unk>")
    table = spark.createDataFrame([(x,) for x in odd], "text string")
    assert {x.parity for x in sentencepiece.encode(table, path, parity=True).collect()} == {True}


def test_encode_and_decode(spark, docs, rows, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    out = sentencepiece.encode(docs, path, check=True)
    got = out.collect()
    assert len(got) == len(rows) and all(r.same for r in got)
    assert all((r.ids == []) == (not r["row"]["text"]) for r in got)
    back = sentencepiece.decode(out.select("row.text", "ids"), path).collect()
    assert all(r.decoded == (r["row"]["text"] or "") for r in back)
    assert sentencepiece.encode(empty, path).count() == 0


# 2 token counts


def test_token_counts(docs, rows, spark, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    extra = [(1000 + i, x) for i, x in enumerate(["a<|endoftext|>b  \n x", "  lead  ", "it's we'll  ''s 123 ½²", "ӿ ՘ ౜़ abc", "漢字 かな 한글 😀😀", "x" * 3000])]
    all_rows = [(r[0], r[1]) for r in rows] + extra
    got = token_counts.token_counts(spark.createDataFrame(all_rows, "doc_id long, text string").repartition(3), path).collect()
    assert Counter((r["row"]["doc_id"], r.n_tokens) for r in got) == Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in all_rows)
    assert token_counts.token_counts(empty, path).count() == 0


def test_agreed_code_points_are_split_alike():
    own, _, _ = token_counts._loaded(tokenizer_path("byte_bpe_50k.json"))
    agreed = [c for c in [*range(1, 0x600), *range(0x2000, 0x2C00), *range(0x3000, 0x3100), *range(0x4E00, 0xA000, 37), *range(0x1F300, 0x1F650)] if not token_counts.AGREED.search(chr(c))]
    for a in range(0, len(agreed), 1000):
        text = "".join(f"a{chr(c)}1 {chr(c)}  {chr(c)}. " for c in agreed[a : a + 1000])
        assert token_counts._pattern().findall(text) == [text[x:y] for _, (x, y) in own.pre_tokenizer.pre_tokenize_str(text)]


# 3 quality


def test_quality_learns_from_documents(spark, empty):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(VOCABULARY) + r.choice("abcdefgh") for _ in range(r.randint(20, 300)))
    bad = lambda: " ".join((r.choice(VOCABULARY) + "!!").upper() for _ in range(r.randint(20, 300)))
    data = [(i, bad() if i % 3 == 0 else good(), int(i % 3 > 0)) for i in range(300)] + [(1000, None, None), (1001, "", None), (None, "x", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, quality int")
    labels = docs.where("quality is not null").select("doc_id", "quality").union(spark.createDataFrame([(5, None), (None, 1)], "doc_id long, quality int"))
    model = quality.train(docs, labels)
    got = quality.classify(docs, model).collect()
    held = [r for r in got if r["row"]["quality"] is not None and zlib.crc32(str(r["row"]["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 20 and np.mean([(r.score >= 0.3) == bool(r["row"]["quality"]) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(data)
    again = quality.train(docs.repartition(5), labels)
    assert all(np.allclose(model[k], again[k]) for k in model)
    assert quality.train(docs, labels.limit(0)) is None
    assert {r.score for r in quality.classify(docs, None).collect()} == {0.5}
    assert quality.classify(empty, model).count() == 0


def test_quality_learns_from_every_passage(spark):
    r = random.Random(6)
    plain = lambda n: " ".join(r.choice(VOCABULARY) + r.choice("abcdefgh") for _ in range(n))
    junk = " ".join(f"{w}!!".upper() for w in VOCABULARY)
    junk = " ".join((junk.split() * quality.PASSAGE)[: quality.PASSAGE])
    parts = lambda bad: [junk if bad and i in (1, 2, 38) else plain(quality.PASSAGE) for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(parts(i % 2)), 1 - i % 2) for i in range(120)], "doc_id long, text string, quality int")
    batch = pa.RecordBatch.from_pydict({"label": [1.0, 0.0], "text": [plain(quality.PASSAGE * 40), ""]})
    assert [len(x) // 4 // quality.N_FEATURES for b in quality._featured(iter([batch])) for x in b.column("x").to_pylist()] == [40, 1]
    held = quality.classify(docs, quality.train(docs, docs.select("doc_id", "quality"))).where(quality.held_out(F.col("row.doc_id"))).collect()
    assert len(held) > 10 and all((h.score >= 0.5) == bool(h["row"]["quality"]) for h in held)


def test_attention_gradients():
    r = np.random.default_rng(0)
    x, first, y = r.normal(size=(12, quality.N_FEATURES)), np.array([0, 3, 4, 12]), np.array([1.0, 0.0, 1.0])
    model = quality.fit(x, first, y)
    assert np.abs(quality.score(model, x, first) - y).max() < 0.2


def test_gradients_are_finite_differences():
    r = np.random.default_rng(1)
    texts = pa.array([" ".join(r.choice(["a", "Bc", "def", "g h", "É", "xyz"], n)) for n in (3, 150, 0, 70)])
    x, first = quality.features(texts)
    bag, y = quality.tokens(texts), np.array([1.0, 0.0, 1.0, 0.3])
    assert len(bag.at) == len(x) + 1 and bag.at[-1] == len(bag.ids) == sum(len(words_of(t)) for t in texts.to_pylist())
    p = {k: v.astype(float) for k, v in quality.fit(x, first, y, bag).items()}
    x = (x - p.pop("mean")) / p.pop("scale")
    p = {k: v + r.normal(0, 0.3, v.shape) for k, v in p.items()}
    _, grad = quality.loss_and_gradients(p, x, first, y, bag)
    for k in p:
        places = [tuple(r.integers(0, n) for n in p[k].shape) for _ in range(6)]
        if k == "e":
            places += [(int(bag.ids[i, j]), 2) for i in (0, 5, 100) for j in range(4)]
        for at in places:
            old = p[k][at]
            sides = []
            for step in (1e-5, -1e-5):
                p[k][at] = old + step
                sides.append(quality.loss_and_gradients(p, x, first, y, bag)[0])
            p[k][at] = old
            assert grad[k][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4, abs=1e-8)


def test_words_decide_where_marks_are_alike(spark):
    """Both labels have words of the same letters and lengths, so only the words themselves tell."""
    r = random.Random(9)
    make = lambda words: " ".join(r.choice(words) for _ in range(r.randint(30, 200)))
    good, bad = ["stop", "tale", "mane", "part"], ["post", "late", "name", "trap"]
    docs = spark.createDataFrame([(i, make(good if i % 2 else bad), i % 2) for i in range(400)], "doc_id long, text string, quality int")
    held = quality.classify(docs, quality.train(docs, docs.select("doc_id", "quality"))).where(quality.held_out(F.col("row.doc_id"))).collect()
    assert len(held) > 50 and all((h.score >= 0.5) == bool(h["row"]["quality"]) for h in held)


def test_quality_odd_rows(spark):
    long = " ".join(VOCABULARY) * 2_000
    data = [(1, "a b c", "x"), (1, "a b c", "x"), (2, long, "x"), (3, None, "x"), (4, " \t", "x"), (None, "a b c", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, score string").withColumn("label", F.lit("clash")).withColumn("row", F.lit("clash"))
    got = quality.classify(docs, quality.train(docs, spark.createDataFrame([(1, 1), (2, 0), (1, 1)], "doc_id long, quality int"))).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r["row"]["text"] == "a b c"}) == 1
    assert {r["row"]["row"] for r in got} == {"clash"}


def test_quality_of_given_documents_on_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    got = quality.classify(docs.join(labels.select("doc_id").distinct(), "doc_id"), quality.train(docs, labels), carry=["doc_id"]).select("row.doc_id", "score").collect()
    held = [(r.score, known[r.doc_id]) for r in got if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, bad = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    auc = np.mean(good[:, None] > bad) + np.mean(good[:, None] == bad) / 2
    assert len(held) > 500 and auc > 0.99 and np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.97


# 4 near duplicates


def shingles(text):
    w = words_of(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def plain_classes(rows):
    keys = [r[0] for r in rows]
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                up[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return Counter((keys[i], min((keys[j] for j in g if keys[j] is not None), default=None), len(g)) for g in groups.values() for i in g)


def test_near_dedup(docs, rows, empty):
    got = near_dedup.classes(docs).collect()
    assert Counter((r["row"]["doc_id"], r.class_id, r.class_size) for r in got) == plain_classes(rows)
    assert near_dedup.classes(empty).count() == 0


def test_near_dedup_in_a_large_loose_group(spark):
    """Texts that drift apart step by step: neighbours are similar, ends are not, and leaders miss some."""
    r = random.Random(6)
    w = [f"w{i}" for i in range(120)]
    data = []
    for i in range(80):
        w = list(w)
        w[r.randrange(120)] = f"new{i}"
        data.append((i, " ".join(w)))
    got = near_dedup.classes(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert Counter((x["row"]["doc_id"], x.class_id, x.class_size) for x in got) == plain_classes(data)


def test_signatures_estimate_weighted_similarity():
    a, b = ["x y z " * 30 + f"q{i} " for i in range(1)][0], "x y z " * 30 + " ".join(f"r{i}" for i in range(40))
    cells, at = near_dedup.unit_cells(*W.hashes(pa.array([a, b])))
    s = near_dedup.darts(cells, at, 2000)
    ca, cb = shingles(a), shingles(b)
    true = sum((ca & cb).values()) / sum((ca | cb).values())
    assert abs((s[0] == s[1]).mean() - true) < 0.05
    part = np.ones(len(cells))
    part[at[0] : at[1]] = 0.5  # half of each cell: weights of one half
    half = near_dedup.darts(cells, at, 2000, part)
    assert abs((half[0] == s[0]).mean() - 0.5) < 0.06


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {n: n for e in edges for n in e if n is not None}
    for _ in range(100):
        for a, b in edges:
            if a is not None:
                up[a] = up[b] = min(up[a], up[b])
    assert got == {n: c for n, c in up.items() if c != n}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5 language model


def test_katz(docs, rows, spark, empty):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seqs = [(k, ["<s>", *words_of((t or "").translate(low)), "</s>"]) for k, t, *_ in rows]
    held = lambda k: zlib.crc32((str(k) if k is not None else "").encode()) % 5 == 1
    c1, c2, ch = Counter(), Counter(), Counter()
    for k, w in seqs:
        if not held(k):
            c1.update(w[1:])
            c2.update(zip(w, w[1:]))
            ch.update(w[:-1])
    count = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.K + 2)]
    d1, d2 = katz.discounts(count(c1)), katz.discounts(count(c2))
    kept = lambda c, d: d[c - 1] * c if c <= katz.K else c - katz.KEPT
    n, v = sum(c1.values()), len(c1)
    unknown = 1 - sum(kept(c, d1) for c in c1.values()) / n
    p1 = lambda w: kept(c1[w], d1) / n if w in c1 else unknown
    after = defaultdict(list)
    for (h, w), c in c2.items():
        after[h].append((w, c))
    a = {h: (1 - sum(kept(c, d2) for _, c in ws) / ch[h]) / (1 - sum(p1(w) for w, _ in ws)) for h, ws in after.items()}
    for h in list(after)[:20]:
        assert sum(kept(c, d2) / ch[h] for _, c in after[h]) + a[h] * (unknown + sum(p1(w) for w in c1 if (h, w) not in c2)) == pytest.approx(1)
    want = Counter()
    for k, w in seqs:
        base = sum(math.log10((c1[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w[1:])
        score = sum(math.log10(kept(c2[h, x], d2) / ch[h] if (h, x) in c2 else a.get(h, 1.0) * p1(x)) for h, x in zip(w, w[1:]))
        want[k, held(k), len(w) - 1, sum(x in c1 for x in w[1:]), n, round(base, 6), round(score, 6)] += 1
    got = katz.scores(docs).collect()
    assert Counter((r["row"]["doc_id"], r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert katz.scores(empty).count() == 0
    none = katz.scores(docs, train=F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.score) for r in none} == {(0, 0, 0.0)}


def test_katz_writes_two_files_a_task_and_few_for_its_result(docs, monkeypatch):
    tables, cut = [], katz.cut
    monkeypatch.setattr(katz, "cut", lambda df, *by: tables.append(cut(df, *by)) or tables[-1])
    monkeypatch.setattr(katz, "parts_for", lambda *_: 60)
    out = katz.scores(docs)
    files = Counter(name.rsplit("/", 1)[1].split("-")[1] for name in tables[0].inputFiles())
    assert max(files.values()) <= 2  # one for each kind of row before
    assert out.rdd.getNumPartitions() <= 20 and out.count() == docs.count()  # 60 / 3; what the optimizer made of 200 before


# 6, 7 embeddings


def vectors(seed=0, n=900):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 16))
    x = (centres[r.integers(0, 12, n)] + 0.35 * r.normal(size=(n, 16))).astype(np.float32)
    x[50:90] = x[50]
    data = [(i, [float(v) for v in row], "x", 3) for i, row in enumerate(x)]
    bad = [(5000, None, None, None), (5001, [0.0] * 16, "x", 1), (5002, [float("nan")] + [1.0] * 15, "x", 1), (5003, [None] + [1.0] * 15, "x", 1), (5004, [float("inf")] * 16, "x", 1), (5005, [1.0, 2.0], "x", 1), (None, data[3][1], "x", 1)]
    return [*data, data[7], *bad]


VECTORS = "vec_id long, embedding array<float>, node string, times int"


def test_nearest_neighbours(spark):
    data = vectors()
    df = spark.createDataFrame(data, VECTORS).repartition(3)
    got = neighbours.nearest(df, df.where(F.col("vec_id") % 20 == 0), 20).collect()
    good = {i: np.array(v) for i, v, *_ in data if i is not None and i < 5000}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids]).astype(np.float64)
    asked = [i for i in ids if i % 20 == 0]
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
        assert r.score == pytest.approx(float(good[r.vec_id].astype(np.float64) @ good[r.query_id]))
    assert sorted(found) == asked
    hit = 0
    for q in asked:
        s = x @ good[q]
        s[ids == q] = -np.inf
        hit += len({int(ids[i]) for i in np.lexsort((ids, -s))[:20]} & {i for i, _ in found[q]})
        assert [r for r in found[q]] == sorted(found[q], key=lambda t: (-t[1], t[0])) and len(found[q]) == 20
    assert hit / (20 * len(asked)) >= 0.9
    few = df.where("vec_id < 5")
    assert Counter(r.query_id for r in neighbours.nearest(few, few, 20).collect()) == {i: 4 for i in range(5)}
    assert neighbours.nearest(df.limit(0), df.limit(0), 5).count() == 0


def test_neighbours_of_every_length(spark):
    r = np.random.default_rng(5)
    data = [(i, r.normal(size=6 if i % 2 else 9).astype(np.float32).tolist(), "clash") for i in range(200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, node string")
    got = neighbours.nearest(df, df.where("vec_id < 20"), 7).collect()
    for q in range(20):
        same = sorted((-float(np.dot(np.array(v, np.float64), np.array(data[q][1], np.float64))), i) for i, v, _ in data if i != q and i % 2 == q % 2)[:7]
        assert [(x.vec_id, x.rank) for x in sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)] == [(i, n + 1) for n, (_, i) in enumerate(same)]


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 128)
    monkeypatch.setattr(embedding_dedup, "LEAF", 32)
    data = vectors()
    got = embedding_dedup.near(spark.createDataFrame(data, VECTORS).repartition(3)).collect()
    usable = [(i, np.array(v, np.float64)) for i, v, *_ in data if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    u = np.stack([v / np.sqrt(v @ v) for _, v in usable])
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(usable))
    for _ in range(200):
        label = np.minimum(label, np.where(link, label[None, :], len(label)).min(1))
    key = [i if i is not None else 10**9 for i, _ in usable]
    name = {c: min(k for k, l in zip(key, label) if l == c) for c in set(label.tolist())}
    want = Counter((k if k < 10**9 else None, int(n), name[int(l)]) for k, n, l in zip(key, link.sum(1), label))
    want.update([(i, 0, i) for i in range(5000, 5006)])
    assert Counter((r["row"]["vec_id"], r.n_links, r.component_id) for r in got) == want
    assert embedding_dedup.near(spark.createDataFrame([], VECTORS)).count() == 0


# 8 mixing


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, budget, target = list(order), 1.5 * sum(sizes.values()), {}
    while left:
        share = {s: budget * weight[s] / sum(weight[x] for x in left) for s in left}
        full = [s for s in left if share[s] >= 2 * sizes[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
            left.remove(s)
    taken = Counter()
    for r in got:
        s = r["row"]["source"]
        assert (r.size, r.source_size) == (len(words_of(r["row"]["text"])), sizes[s]) and r.target == pytest.approx(target[s]) and 0 <= r.copies <= 2
        taken[s] += r.size * r.copies
    most = max(len(words_of(r[1])) for r in rows)
    assert all(abs(taken[s] - target[s]) <= most for s in order)
    assert Counter((r["row"]["doc_id"], r.copies) for r in mixing.mix(docs.repartition(7)).collect()) == Counter((r["row"]["doc_id"], r.copies) for r in got)
    assert mixing.mix(empty).count() == 0


# 9 pages


def test_pages(spark):
    w = html_extract.fitted()
    body = "<h1>A title</h1><p>First words, enough of them to read well.<p>Second&nbsp;part &amp; more,\n of it.</p><p>Short.</p>"
    page = f'<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now, it is great.</div><article>{body}</article><div class="sidebar"><p>Some side text here, long enough.</p></div><div id="comments"><p>I liked it very much. Thanks.</p></div><form><p>Sign up here</p></form><footer>&copy; me</footer></body></html>'
    want = "A title First words, enough of them to read well. Second part & more, of it. Short."
    assert " ".join(html_extract.content(page, w)) == want
    data = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<div>" * 2000 + "<p>Deep text, with a sentence of words.</p>"), (1, "u", page), (5, "x", "<p>cut off <b"), (6, "y", "&am")]
    got = html_extract.extract(spark.createDataFrame(data, "page_id long, url string, html string").withColumn("page", F.lit("clash"))).collect()
    found = {r["row"]["page_id"]: r for r in got}
    assert len(got) == 7 and found[1].text == want and found[2].text == found[3].text == "" and found[4].text.startswith("Deep") and found[5].text == "cut off"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_deep_pages_take_memory_in_proportion():
    import tracemalloc

    w = html_extract.fitted()
    for page, text in (("<div>" * 100_000 + "<p>Deep text, with a sentence of words.", "Deep text, with a sentence of words."), ("<i><div>" + "<b>" * 30_000 + "</i>" * 30_000 + "</div>", ""), ("<div>" * 30_000 + "</section>" * 30_000, "")):
        tracemalloc.start()
        assert " ".join(html_extract.content(page, w)) == text
        assert tracemalloc.get_traced_memory()[1] < 600 * len(page)
        tracemalloc.stop()
    many = html_extract.blocks("".join(f"<div>t{i}" for i in range(20_000)))
    assert [b.text for b in many] == [f"t{i}" for i in range(20_000)] and {b.steps for b in many} == {1}


def test_steps_between_blocks_are_those_of_the_tree():
    r = random.Random(4)
    for _ in range(50):
        at, path, paths, page, number = 0, [], [], "", 0
        for _ in range(40):
            if path and r.random() < 0.4:
                path.pop()
                page += "</div>"
            else:
                number += 1
                path.append(number)
                page += "<div>"
            if r.random() < 0.5:
                paths.append(tuple(path))
                page += f"w{len(paths)}"
        found = html_extract.blocks(page)
        assert len(found) == len(paths)
        for a, b, block in zip(paths, paths[1:], found[1:]):
            common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert block.steps == len(a) + len(b) - 2 * common


def test_text_of_the_given_pages_is_that_of_their_articles(spark):
    """Held against the pages' own markup: what stands in article elements, asides and the like taken out."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["row"]["page_id"]: r.text for r in html_extract.extract(pages).collect()}
    compared = 0
    for r in pages.collect():
        if m := re.fullmatch(r".*<article[^>]*>(.*)</article>.*", r.html or "", re.S):
            want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", m[1])).split())
            compared += 1
            assert got[r.page_id].replace(" ", "") == want.replace(" ", "")
    assert compared > 200


def test_content_of_invented_pages():
    w = html_extract.fitted()
    wrong = total = 0
    for page in html_extract.training_pages(60, seed=99):
        kept = set(html_extract.content(page.replace(html_extract.MARKED, ""), w))
        for text, *_ in html_extract.blocks(page):
            wrong += (html_extract.MARKED in text) != (text.replace(html_extract.MARKED, "") in kept)
            total += 1
    assert wrong / total < 0.06


def test_minimum_cut():
    r = random.Random(8)
    for _ in range(60):
        n = r.randint(1, 7)
        s, t = [r.randint(0, 9) for _ in range(n)], [r.randint(0, 9) for _ in range(n)]
        edges = {(i, j): r.randint(1, 6) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5}
        cost = lambda side: sum(t[i] if side[i] else s[i] for i in range(n)) + sum(c for (i, j), c in edges.items() if side[i] != side[j])  # noqa: E731, B023
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.min_cut(s, t, edges)) == best


# 10 substrings


def test_windows_whose_hashes_collide_are_told_apart(monkeypatch):
    def repeated(values):
        monkeypatch.setattr(W, "hashes", lambda column: (np.array([v % (1 << 64) for v in values], np.uint64), np.array([0, 2, 4])))
        batch = pa.RecordBatch.from_pydict({"k1": pa.array([1, 2], pa.int64()), "k2": pa.array([3, 4], pa.int64()), "text": ["p q", "r s"]})
        sent = pa.Table.from_batches(list(substring_dedup._send(2, 4096)(iter([batch]))))
        found = [substring_dedup._repeated(sent.filter(pa.compute.equal(sent.column("part"), p))) for p in sent.column("part").unique().to_pylist()]
        return sum(len(substring_dedup.unpacked(d)[0]) for t in found for d in t.column("data").to_pylist() if d)

    a, b, x = 0x1234567890ABCDEF, 0xFEDCBA0987654321, 0x1111222233334445
    values = [a, b, a + x, b - x * W.BASE]
    h, _ = W.rolling(np.array([v % (1 << 64) for v in values], np.uint64), np.array([0, 2, 4]), 2)
    assert h[0] == h[1]
    assert repeated(values) == 0 and repeated([a, b, a, b]) == 2


@pytest.mark.parametrize("window", [35, 4])
def test_repeated_windows(docs, rows, empty, window):
    all_words = [words_of(r[1]) for r in rows]
    count = Counter(tuple(w[i : i + window]) for w in all_words for i in range(len(w) - window + 1))
    want = Counter()
    for r, w in zip(rows, all_words):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        want[r[0], len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    got = substring_dedup.remove_repeats(docs, window=window).collect()
    assert Counter((r["row"]["doc_id"], r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got) == want
    assert all(sum(b.end - b.begin for b in r.removed) == r.n_removed for r in got)
    assert substring_dedup.remove_repeats(empty, window=window).count() == 0


def test_round_trips_by_bytes_agree_with_the_decoder(monkeypatch):
    from quern.llm import queries, sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    t = sentencepiece.loaded(path, 2)
    plain = ["", " ", "  a", "a", "A text, two words.", "日本語 😀 é́", "\x00﻿�", "<0x41> <unk>", "a\tb\n", ""]
    marked = ["▁", "▁a", "a▁b", "▁▁ ▁"]
    ids = sentencepiece.encoded(path, plain + marked, 2)
    want = sentencepiece._decoded_same(t, ids, plain + marked)
    decoded = []
    monkeypatch.setattr(sentencepiece, "_decoded_same", lambda t, ids, texts: decoded.extend(texts) or [x == y for x, y in zip(t.decode_batch([i.tolist() for i in ids], skip_special_tokens=False), texts)])
    assert sentencepiece._same(path, t, ids, plain + marked) == want == [True] * len(plain) + [False] * len(marked)
    assert not set(decoded) & (set(plain) - {""})
    assert sentencepiece._same(path, t, ids[1:] + ids[:1], plain + marked) == sentencepiece._decoded_same(t, ids[1:] + ids[:1], plain + marked)
