"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

Every passage of PASSAGE words is encoded: each word has learned embeddings, looked up by hashes of the word, of it and the word before, and of
its first and last letters, whose mean over the passage is added to a projection of counts (byte classes, lengths, repetition). The network
learns, from labels of whole documents, these embeddings, gated attention weights over the passages, and the score of the weighted passage
vector. It is trained on the driver from the passages of at most MOST_TRAINED labelled documents (the ones with the smallest hashes of
doc_id), all passages of each; scoring takes all passages of all documents.

Defined cases: null and empty texts are one passage without words and get a score too; texts of any length are scored whole; ties of scores
and clashing column names mean nothing here; documents without labels are scored alike; of
several labels of a document the mean counts, null labels don't; without any label all scores are 0.5; repeated rows are scored each; an
empty table gives an empty result; input columns come back inside `row`. Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import words as W
from quern.session import ship

PASSAGE = 64
MOST_TRAINED = 4000
HIDDEN, GATES, BAGS, RATE, SEED = 16, 8, 128, 0.03, 5
#: Steps of the training, and how many words it may look at in all, again and again: what it costs the driver at most.
STEPS, LOOKS = 300, 24_000_000
#: Embeddings for each of the four kinds of hashes of a word, and how strongly they are drawn to zero.
BUCKETS, KINDS, DECAY = 4096, 4, 1e-4
THRESHOLD = 0.3
#: Byte classes: lower case, upper case, digits, non-ASCII, marks of sentences, ! and ?, |, brackets and quotes, other symbols, the rest.
_CLASS = np.full(256, 9, np.uint8)
for _n, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b".,;:", b"!?", b"|", b"()[]{}\"'`", b"*%$#&@=+<>/\\^~_-")):
    _CLASS[list(_bytes)] = _n
CLASSES = 10
N_FEATURES = CLASSES + 7


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and where each text's passages begin (one more for the end)."""
    data, at_byte = W.buffers(column)
    words, at = W.hashes(column)
    starts, ends = W.spans(data, at_byte)
    n = np.diff(at)
    count = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate(([0], np.cumsum(count)))
    text = np.repeat(np.arange(len(n)), n)
    passage = first[text] + (np.arange(len(words)) - at[text]) // PASSAGE
    total = first[-1]
    m = np.bincount(passage, minlength=total).astype(float)
    some = np.maximum(m, 1)
    per = lambda x: np.bincount(passage, x, minlength=total) / some
    x = np.zeros((total, N_FEATURES))
    length = ends - starts
    size = np.maximum(np.bincount(passage, length, minlength=total), 1)
    classes = _CLASS[data]
    for c in range(CLASSES):
        sums = np.concatenate(([0], np.cumsum(classes == c, dtype=np.int64)))
        x[:, c] = np.bincount(passage, sums[ends] - sums[starts], minlength=total) / size
    c = CLASSES
    x[:, c] = np.log1p(m)
    x[:, c + 1] = per(length) / 10
    if len(words):
        x[:, c + 2] = per(np.concatenate(([False], (words[1:] == words[:-1]) & (text[1:] == text[:-1]))))
        _, one = np.unique(W.mix(words + passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        x[:, c + 3] = np.bincount(passage[one], minlength=total) / some
        runs, begin = W.rolling(words, at, 5)
        _, which, times = np.unique(W.mix(runs + text[begin].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        x[:, c + 4] = np.bincount(passage[begin], times[which] > 1, minlength=total) / some
        x[:, c + 5] = per(_CLASS[data[ends - 1]] >= 5)
        x[:, c + 6] = per(_CLASS[data[starts]] == 1)
    return x, first


class Bag(NamedTuple):
    """Words of passages: the embeddings' numbers (words x KINDS), and where each passage's words begin (one more for the end)."""

    ids: np.ndarray
    at: np.ndarray


def tokens(column: pa.Array) -> Bag:
    """The numbers of every word's embeddings, by passage."""
    data, at_byte = W.buffers(column)
    words, at = W.hashes(column, folded=True)
    starts, ends = W.spans(data, at_byte)
    n = np.diff(at)
    count = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate(([0], np.cumsum(count)))
    within = np.arange(first[-1]) - np.repeat(first[:-1], count)
    begin = np.append(np.repeat(at[:-1], count) + within * PASSAGE, len(words))
    before = np.concatenate((np.zeros(1, np.uint64), words[:-1])) if len(words) else words
    before[at[:-1][n > 0]] = 0
    low, size = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64), ends - starts
    byte = lambda where, there: np.where(there, low[np.clip(where, 0, max(len(data) - 1, 0))], 0) if len(words) else words
    letters = lambda from_, step: sum(byte(from_ + step * i, size > i) << np.uint64(8 * i) for i in range(3))
    kinds = [words, W.mix(words + before * np.uint64(0x9E3779B97F4A7C15)), W.mix(letters(starts, 1)), W.mix(letters(ends - 1, -1) + np.uint64(1 << 40))]
    ids = np.stack([(k >> np.uint64(52)).astype(np.int32) + i * BUCKETS for i, k in enumerate(kinds)], 1)
    return Bag(ids, np.minimum(begin, len(words)))


def embedded(e: np.ndarray, bag: Bag) -> np.ndarray:
    """The mean of the words' embeddings for each passage; zero for one without words."""
    out = np.zeros((len(bag.at) - 1, e.shape[1]), e.dtype)
    size = np.diff(bag.at)
    if len(bag.ids):
        words = e[bag.ids[:, 0]]
        for k in range(1, KINDS):
            words += e[bag.ids[:, k]]
        full = size > 0
        out[full] = np.add.reduceat(words, bag.at[:-1][full]) / size[full, None].astype(e.dtype)
    return out


def _pool(z: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Softmax of z inside each text."""
    e = np.exp(z - np.repeat(np.maximum.reduceat(z, first[:-1]), np.diff(first)))
    return e / np.repeat(np.add.reduceat(e, first[:-1]), np.diff(first))


def _hidden(p: dict[str, np.ndarray], x: np.ndarray, bag: Bag | None) -> np.ndarray:
    return np.tanh(x @ p["w"] + p["b"] + (embedded(p["e"], bag) if bag is not None else 0))


def score(model: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, bag: Bag | None = None) -> np.ndarray:
    h = _hidden(model, (x - model["mean"]) / model["scale"], bag)
    a = _pool((np.tanh(h @ model["v"]) / (1 + np.exp(-h @ model["u"]))) @ model["q"], first)
    z = np.add.reduceat(h * a[:, None], first[:-1])
    return 1 / (1 + np.exp(-(z @ model["c"] + model["d"])))


def loss_and_gradients(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray, bag: Bag | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """The mean log loss of texts with some decay, and its derivatives; x is scaled already."""
    text = np.repeat(np.arange(len(y)), np.diff(first))
    h = _hidden(p, x, bag)
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-h @ p["u"]))
    a = _pool((t * s) @ p["q"], first)
    z = np.add.reduceat(h * a[:, None], first[:-1])
    logit = z @ p["c"] + p["d"]
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit) + DECAY / 2 * sum((p[k] ** 2).sum() for k in ("w", "c")))
    out = (1 / (1 + np.exp(-logit)) - y) / len(y)
    dz = out[:, None] * p["c"]
    da = (h * dz[text]).sum(1)
    de = a * (da - np.add.reduceat(a * da, first[:-1])[text])
    dt, ds = de[:, None] * p["q"] * s * (1 - t * t), de[:, None] * p["q"] * t * s * (1 - s)
    dh = (a[:, None] * dz[text] + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
    grad = {"w": x.T @ dh + DECAY * p["w"], "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "q": (t * s).T @ de, "c": z.T @ out + DECAY * p["c"], "d": out.sum(keepdims=True)}
    if bag is not None:
        loss += float(DECAY / 2 * (p["e"] ** 2).sum())
        grad["e"] = DECAY * p["e"]
        if len(bag.ids):
            size = np.diff(bag.at)
            share = (dh / np.maximum(size, 1)[:, None]).astype(p["e"].dtype)
            word = np.repeat(np.arange(len(size)), size)
            flat = bag.ids.reshape(-1).astype(np.uint16)  # sorted by radix
            order = np.argsort(flat, kind="stable")
            own = flat[order]
            new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            grad["e"][own[new]] += np.add.reduceat(share[word[order // KINDS]], new)
    return loss, grad


def _some(x: np.ndarray, first: np.ndarray, bag: Bag | None, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, Bag | None]:
    """The passages and words of some texts."""
    pick = lambda at, which: np.concatenate([np.arange(at[i], at[i + 1]) for i in which]) if len(which) else np.empty(0, np.int64)
    passages = pick(first, own)
    starts = np.concatenate(([0], np.cumsum(np.diff(first)[own])))
    if bag is None:
        return x[passages], starts, None
    sizes = np.diff(bag.at)[passages]
    words = np.repeat(bag.at[passages] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return x[passages], starts, Bag(bag.ids[words], np.concatenate(([0], np.cumsum(sizes))))


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, bag: Bag | None = None) -> dict[str, np.ndarray]:
    """Adam on the mean log loss, BAGS texts at a time, in an order that the seed gives."""
    r = np.random.default_rng(SEED)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    p = {"w": r.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "v": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "u": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "q": r.normal(0, GATES**-0.5, GATES), "c": r.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1)}
    if bag is not None:
        p["e"] = r.normal(0, 0.05, (KINDS * BUCKETS, HIDDEN)).astype(np.float32)
    one, two = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    steps = max(1, -(-len(y) // BAGS))
    words = len(bag.ids) if bag is not None else 0
    step, last = 0, min(STEPS, max(steps, LOOKS * steps // max(words, 1), 20))
    while step < last:
        for own in np.array_split(r.permutation(len(y)), steps)[: last - step]:
            step += 1
            some, starts, inside = _some(x, first, bag, own)
            _, grad = loss_and_gradients(p, some, starts, y[own], inside)
            rate = RATE * (1 - step / (last + 1))
            for k, g in grad.items():
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                p[k] = (p[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(p[k].dtype)
    return p | {"mean": mean, "scale": scale}


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: crc32 of the key as text is divisible by 5. A null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in W.pieces(batch, "text", 2 << 20):
            x, first = features(piece.column("text"))
            x, bag = x.astype(np.float32), tokens(piece.column("text"))
            ids, at = bag.ids.astype(np.uint16), bag.at[first]
            rows = [piece.column("label"), *(pa.array([z[a:b].tobytes() for a, b in zip(w, w[1:])], pa.binary()) for z, w in ((x, first), (ids, at)))]
            yield pa.RecordBatch.from_arrays(rows, ["label", "x", "ids"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> dict[str, np.ndarray] | None:
    """The model learned from the labelled rows of docs that are not held out; None if there are none. label: 0 or 1."""
    ship(docs.sparkSession)
    marked = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("double").alias("label")).where(F.col("label").isNotNull() & F.col("key").isNotNull() & ~held_out(F.col("key")))
    marked = marked.groupBy("key").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(MOST_TRAINED)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(marked), "key")
    # repeated keys can make more rows than labels: as many as the bound are kept
    found = rows.select("label", "text").mapInArrow(_featured, "label double, x binary, ids binary").limit(MOST_TRAINED).collect()
    if not found:
        return None
    found.sort(key=lambda r: (bytes(r.x), bytes(r.ids), r.label))  # the order of rows is Spark's; the fit shouldn't depend on it
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES).astype(float) for r in found]
    ids = [np.frombuffer(r.ids, np.uint16).reshape(-1, KINDS) for r in found]
    sizes = np.concatenate([np.minimum(PASSAGE, np.maximum(len(i) - PASSAGE * np.arange(len(b)), 0)) for i, b in zip(ids, bags)])
    bag = Bag(np.concatenate(ids).astype(np.int32), np.concatenate(([0], np.cumsum(sizes))))
    return fit(np.concatenate(bags), np.concatenate(([0], np.cumsum([len(b) for b in bags]))), np.array([r.label for r in found]), bag)


def _scored(model: dict[str, np.ndarray] | None):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "text", 2 << 20):
                found = score(model, *features(piece.column("text")), tokens(piece.column("text"))) if model else np.full(piece.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(found, pa.float64())], ["row", "score"])

    return scored


def classify(docs: DataFrame, model: dict[str, np.ndarray] | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """For every row of docs: row (a struct of its columns, or of carry) and score (0 to 1; higher: label 1 is likelier)."""
    ship(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(_scored(model), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
