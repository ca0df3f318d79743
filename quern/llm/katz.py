"""Language-model scores: Katz backoff over bigrams, counted from training documents and evaluated for every document.

P(w | h) = c*(h, w) / c(h) where the pair was seen, else a(h) P(w); P(w) = c*(w) / N for known words, and what is left for all unknown
ones together. c* = d_r r for counts r up to K, d_r by Good-Turing with Katz's correction, and r - KEPT above, so that every context leaves
some mass. a(h) makes each context's probabilities sum to exactly 1.

Tasks turn batches of documents into pairs (word, word before) with their documents, and send them, packed, to the part that the word's
hash names. A part counts its words and pairs, and writes to a table partitioned by who reads it: sums for each document that need no other
part; for each context, how many pairs it has of each count; for each token that backs off, its context and document. A second step,
partitioned by context, turns those into backoff weights and into sums for the documents that use them. What the discounts depend on are six counts of
counts a level, summed over all parts. The number of parts follows the input; each holds whole words.

Defined cases: a null text is empty and has one token, its end; a document's first word follows a start mark; words are compared by 64-bit
hashes; texts of any length are scored whole; without training documents every token is unknown, N is 0 and the score is 0; repeated rows count each; rows come back inside
`row`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import words as W
from quern.llm.packing import packed, trim, unpacked
from quern.session import cut, parts_for, ship

PART_BYTES = 10 << 20
K, KEPT = 5, 0.1
#: A part goes through its words in so many ranges, so that its arrays are as many times smaller.
SLICES = 8
U = np.uint64
START, END = U(0x5354415254), U(0x454E44)
_STEP = U(0x9E3779B97F4A7C15)
_SENT = pa.schema([("part", pa.int32()), ("batch", pa.string()), ("data", pa.binary())])
#: Kinds of rows in the table of counts.
SUMS, CONTEXTS, BACKOFFS, TOTALS, ROWS = range(5)
#: The table's partitions: what the next step weighs, totals for the driver among it, and what waits for the last one. Executors fork a process
#: three times for each file that they write, and while one forks, what its JVM holds may be counted twice: so few files, few tasks for the result.
WEIGHED = (CONTEXTS, BACKOFFS, TOTALS)
_TABLE = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("batch", pa.string()), ("totals", pa.list_(pa.int64())), ("data", pa.binary())])
_FLOATS = 2 + 2 * K + 3  # of a document's sums: two logarithms, discounted pairs by count, backed-off words by count, backed off, unknown, known


def _send(parts: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "text", 4 << 20):
                train = piece.column("train").to_numpy(zero_copy_only=False).astype(bool)
                order = np.argsort(~train, kind="stable")  # training documents come first
                piece = piece.take(pa.array(order))
                words, at = W.hashes(piece.column("text"), folded=True)
                n = np.diff(at) + 1
                ends = np.cumsum(n) - 1
                token = np.empty(len(words) + len(n), U)
                inside = np.ones(len(token), bool)
                inside[ends] = False
                token[inside], token[ends] = words, END
                before = np.concatenate((np.zeros(1, U), token[:-1]))
                before[np.concatenate(([0], ends[:-1] + 1))] = START
                doc = np.repeat(np.arange(len(n)), n)
                part = (token >> U(44)).astype(np.int64) % parts
                by = np.lexsort((doc, before, token, part))
                token, before, doc, part = token[by], before[by], doc[by], part[by]
                new_word = np.concatenate(([True], token[1:] != token[:-1]))
                new_pair = new_word | np.concatenate(([True], before[1:] != before[:-1]))
                new_doc = np.flatnonzero(new_pair | np.concatenate(([True], doc[1:] != doc[:-1])))
                times = np.diff(np.append(new_doc, len(token)))
                pair_at, word_at = np.flatnonzero(new_pair[new_doc]), np.flatnonzero(new_word[new_doc])
                token, before, doc, part = token[new_doc], before[new_doc], doc[new_doc], part[new_doc]
                sink = pa.BufferOutputStream()
                rows = pa.RecordBatch.from_arrays([piece.column("row"), pa.array(~train[order]), pa.array(n)], ["row", "held_out", "n_tokens"])
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows)
                kept = packed(sink.getvalue().to_pybytes())
                name = xxhash.xxh3_128_hexdigest(kept + token.tobytes() + before.tobytes() + doc.tobytes() + times.tobytes())
                sent = [(int(name[:8], 16) % parts, name, packed(np.array([0]), kept))]
                bounds = np.searchsorted(part, np.arange(parts + 1))
                count = np.array([1, int(train.sum()), len(n)])
                for p in np.flatnonzero(np.diff(bounds)):
                    a, b = bounds[p], bounds[p + 1]
                    pairs = pair_at[np.searchsorted(pair_at, a) : np.searchsorted(pair_at, b)]
                    own = word_at[np.searchsorted(word_at, a) : np.searchsorted(word_at, b)]
                    sent.append((p, name, packed(count, token[own], np.diff(np.append(np.searchsorted(pairs, own), len(pairs))), before[pairs], np.diff(np.append(pairs, b)), doc[a:b], times[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*sent), _SENT)], schema=_SENT)
                trim()

    return send


def _sum(which: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(which, weights, minlength=n)


def _log(x: np.ndarray) -> np.ndarray:
    """log10, with 0 for 0."""
    return np.log10(np.where(x > 0, x, 1))


def _kept(c: np.ndarray) -> np.ndarray:
    """Logarithm of a count without the discount of counts up to K."""
    return _log(np.where(c > K, c - KEPT, c))


def _slice(x: list[np.ndarray], which: int) -> list[np.ndarray]:
    """What a batch sent, for one of SLICES ranges of words only."""
    words = x[1] % U(SLICES) == which
    pairs = np.repeat(words, x[2])
    posts = np.repeat(pairs, x[4])
    return [x[0], x[1][words], x[2][words], x[3][pairs], x[4][pairs], x[5][posts].astype(np.int64), x[6][posts].astype(np.int64)]


class _Part:
    """What a part gathers while it goes through its words range by range."""

    def __init__(self, parts: int) -> None:
        self.parts = parts
        self.rows: list[tuple] = []
        self.sums: dict[int, np.ndarray] = {}
        self.totals = np.zeros(4 + 2 * K, np.int64)
        self.waiting: list[np.ndarray] = []

    def add(self, sent: list[list[np.ndarray]]) -> None:
        """Counts one range of words in all batches."""
        word, which = np.unique(np.concatenate([x[1] for x in sent]), return_inverse=True)
        if not len(word):
            return
        at = np.cumsum([0, *(len(x[1]) for x in sent)])
        in_word = np.concatenate([which[a + np.repeat(np.arange(len(x[1])), x[2])] for a, x in zip(at, sent)])  # each pair's word
        context = np.concatenate([x[3] for x in sent])
        posts = [np.repeat(np.arange(len(x[3])), x[4]) for x in sent]  # each posting's pair
        trained = np.concatenate([_sum(p, np.where(x[5] < x[0][1], x[6], 0), len(x[3])) for p, x in zip(posts, sent)])
        c1 = _sum(in_word, trained, len(word)).astype(np.int64)
        _, one, pair = np.unique(W.mix(in_word.astype(U) * _STEP + context), return_index=True, return_inverse=True)
        c2 = _sum(pair, trained, len(one)).astype(np.int64)
        counts = lambda c: np.bincount(c[(c > 0) & (c <= K + 1)], minlength=K + 2)[1:]
        self.totals += np.concatenate([[c1.sum(), (c1 > 0).sum()], counts(c1), counts(c2)]).astype(np.int64)
        begin = 0
        for b, (x, p) in enumerate(zip(sent, posts)):
            self._documents(b, x, c1[in_word[begin + p]], c2[pair[begin + p]], word[in_word[begin + p]] != END, context[begin + p])
            begin += len(x[3])
        real = np.flatnonzero(c2 > 0)
        self._contexts(context[one[real]], c1[in_word[one[real]]], c2[real])

    def _documents(self, b: int, x: list[np.ndarray], r1: np.ndarray, r2: np.ndarray, goes_on: np.ndarray, h: np.ndarray) -> None:
        """One batch's postings, with the counts of their words and pairs, to its documents' sums; those that back off wait for their context."""
        doc, times, n, seen = x[5], x[6].astype(np.float64), int(x[0][2]), r2 > 0
        sums = self.sums.setdefault(b, np.zeros((n, _FLOATS)))
        sums[:, 0] += _sum(doc, times * np.log10(r1 + 0.5), n)
        sums[:, 1] += _sum(doc, times * (np.where(seen, _kept(r2), _kept(r1)) - np.where(goes_on, _log(r1), 0)), n)
        for r in range(1, K + 1):
            sums[:, 1 + r] += _sum(doc, times * (r2 == r), n)
            sums[:, 1 + K + r] += _sum(doc, times * (~seen & (r1 == r)), n)
        sums[:, -3] += _sum(doc, times * (~seen & (r1 > 0)), n)
        sums[:, -2] += _sum(doc, times * (r1 == 0), n)
        sums[:, -1] += _sum(doc, times * (r1 > 0), n)
        back = np.flatnonzero(~seen)
        self.waiting.append(np.stack([h[back], np.full(len(back), b, U), doc[back].astype(U), x[6][back].astype(U)]))

    def _contexts(self, h: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> None:
        """Seen pairs to numbers for each context, sent to the context's part."""
        contexts, which = np.unique(h, return_inverse=True)
        n = len(contexts)
        numbers = [_sum(which, r2 == r, n) for r in range(1, K + 1)] + [_sum(which, r2 > K, n), _sum(which, np.where(r2 > K, r2, 0), n)]
        numbers += [_sum(which, r1 == r, n) for r in range(1, K + 1)] + [_sum(which, r1 > K, n), _sum(which, np.where(r1 > K, r1, 0), n)]
        to = (contexts >> U(44)).astype(np.int64) % self.parts
        order = np.argsort(to, kind="stable")
        bounds = np.searchsorted(to[order], np.arange(self.parts + 1))
        for q in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[q] : bounds[q + 1]]
            self.rows.append((CONTEXTS, int(q), None, None, packed(contexts[own], *(x[own].astype(np.int64) for x in numbers))))

    def finish(self, names: list[str]) -> list[tuple]:
        out = self.rows
        out.append((TOTALS, None, None, self.totals.tolist(), None))
        out += [(SUMS, None, names[b], None, packed(s[:, :2].T.reshape(-1), s[:, 2:].T.reshape(-1).astype(np.int64))) for b, s in self.sums.items()]
        if self.waiting:
            h, who, doc, times = np.concatenate(self.waiting, 1)
            to = (h >> U(44)).astype(np.int64) % self.parts
            order = np.lexsort((doc, who, to))
            h, who, doc, times, to = h[order], who[order].astype(np.int64), doc[order].astype(np.int64), times[order].astype(np.int64), to[order]
            new = np.flatnonzero(np.concatenate(([True], (to[1:] != to[:-1]) | (who[1:] != who[:-1])))) if len(h) else np.empty(0, int)
            for a, b in zip(new, np.append(new[1:], len(h))):
                out.append((BACKOFFS, int(to[a]), names[who[a]], None, packed(h[a:b], doc[a:b], times[a:b])))
        return out


def _counted(parts: int):
    def counted(table: pa.Table) -> pa.Table:
        sent, out = [], []
        for name, data in zip(table.column("batch").to_pylist(), table.column("data")):
            x = unpacked(data.as_buffer().to_pybytes())
            if x[0][0]:
                sent.append((name, data))
            else:
                out.append((ROWS, None, name, None, x[1]))
        if sent:
            part = _Part(parts)
            for which in range(SLICES):
                part.add([_slice(unpacked(data.as_buffer().to_pybytes()), which) for _, data in sent])
                trim()
            out += part.finish([name for name, _ in sent])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _TABLE)], schema=_TABLE)

    return counted


def discounts(n: list[int]) -> np.ndarray:
    """d_1 ... d_K from the numbers of things counted 1 ... K + 1 times. Where the counts are too few for one below 1, r - KEPT is kept of r."""
    r, n = np.arange(1, K + 1), np.array(n, float)
    plain = (r - KEPT) / r
    with np.errstate(all="ignore"):
        most = (K + 1) * n[K] / n[0]
        d = ((r + 1) * n[1:] / (r * n[:-1]) - most) / (1 - most)
    return np.where(np.isfinite(d) & (d > 0) & (d <= plain), d, plain)


class Constants:
    """What the whole corpus says: N, V, discounts of both levels, and the logarithm of the mass of unknown words."""

    def __init__(self, totals: list[int]) -> None:
        self.tokens, self.words = totals[:2]
        self.d1, self.d2 = discounts(totals[2 : 3 + K]), discounts(totals[3 + K : 4 + 2 * K])
        r, n = np.arange(1, K + 1), np.array(totals[2 : 2 + K])
        low = (n * r).sum()
        mass = (self.tokens - low - KEPT * (self.words - n.sum()) + (self.d1 * r * n).sum()) / max(self.tokens, 1)
        self.unknown = float(np.log10(1 - mass)) if self.tokens else 0.0


def _weighted(c: Constants):
    schema = pa.schema([("kind", pa.int32()), ("batch", pa.string()), ("data", pa.binary())])

    def weighted(table: pa.Table) -> pa.Table:
        """One part's contexts to backoff weights, and these to sums for the documents that back off to them."""
        r = np.arange(1, K + 1)
        contexts, asked = [], []
        for kind, batch, data in zip(table.column("kind").to_pylist(), table.column("batch").to_pylist(), table.column("data").to_pylist()):
            (contexts if kind == CONTEXTS else asked).append((batch, unpacked(data)))
        out = []
        if contexts:
            h, which = np.unique(np.concatenate([x[0] for _, x in contexts]), return_inverse=True)
            m = np.stack([_sum(which, np.concatenate([x[i] for _, x in contexts]), len(h)) for i in range(1, 5 + 2 * K)])
            total = (m[:K] * r[:, None]).sum(0) + m[K + 1]
            left = 1 - ((c.d2 * r) @ m[:K] + m[K + 1] - KEPT * m[K]) / total
            lower = 1 - ((c.d1 * r) @ m[K + 2 : 2 * K + 2] + m[2 * K + 3] - KEPT * m[2 * K + 2]) / c.tokens
            value = np.log10(left / lower) + np.log10(total)
        for batch, (g, doc, times) in asked:
            v = np.zeros(len(g))
            if contexts:
                near = np.minimum(np.searchsorted(h, g), len(h) - 1)
                v = np.where(h[near] == g, value[near], 0)
            out.append((BACKOFFS, batch, packed(_sum(doc.astype(np.int64), v * times, 0))))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    return weighted


def _gathered(c: Constants, started: int):
    def gathered(table: pa.Table) -> pa.Table:
        tables, more, sums = [], np.zeros(0), None
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
            x = unpacked(data)
            if kind == ROWS:
                tables.append(pa.ipc.open_stream(x[0]).read_all())
            elif kind == SUMS:
                n = len(x[0]) // 2
                x = np.concatenate([x[0].reshape(2, n).T, x[1].reshape(-1, n).T], 1)
                sums = x if sums is None else sums + x
            else:
                if len(x[0]) > len(more):
                    more = np.concatenate([more, np.zeros(len(x[0]) - len(more))])
                more[: len(x[0])] += x[0]
        sums = sums / len(tables)  # batches that are copies answer alike
        more = np.concatenate([more, np.zeros(len(sums) - len(more))]) / len(tables)
        score = sums[:, 1] + sums[:, 2 : 2 + K] @ np.log10(c.d2) + sums[:, 2 + K : 2 + 2 * K] @ np.log10(c.d1) - sums[:, -3] * np.log10(max(c.tokens, 1)) + sums[:, -2] * c.unknown + more - (np.log10(started) if started else 0)
        out = []
        for t in tables:
            n = t.column("n_tokens").to_numpy()
            base = sums[:, 0] - n * np.log10(c.tokens + 0.5 * (c.words + 1))
            out.append(pa.table({"row": t.column("row"), "held_out": t.column("held_out"), "n_tokens": n, "n_known": np.rint(sums[:, -1]).astype(np.int64), "train_tokens": np.full(len(n), c.tokens), "base_score": base, "score": score}))
        return pa.concat_tables(out)

    return gathered


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: crc32 of the key as text leaves 1 when divided by 5. A null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def scores(docs: DataFrame, text: str = "text", train: Column | None = None, key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """For every row of docs: row (a struct of its columns, or of carry), held_out, n_tokens, n_known, train_tokens, base_score and score.

    train: which rows to learn from; as a rule those that held_out(key) leaves.
    """
    ship(docs.sparkSession)
    parts = parts_for(docs, PART_BYTES)
    train = ~held_out(F.col(f"`{key}`")) if train is None else train
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    sent = rows.mapInArrow(_send(parts), "part int, batch string, data binary")
    found = sent.groupBy("part").applyInArrow(_counted(parts), "kind int, part int, batch string, totals array<long>, data binary")
    counts = cut(found.withColumn("weighed", F.col("kind").isin(*WEIGHED)), "weighed")
    sums = counts.where(F.col("weighed") & (F.col("kind") == TOTALS)).select(F.posexplode("totals").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    constants = Constants([r.n for r in sorted(sums, key=lambda r: r.at)] or [0] * (4 + 2 * K))
    started = rows.where("train").select("train").count()
    more = counts.where(F.col("weighed") & (F.col("kind") != TOTALS)).select("part", "kind", "batch", "data").groupBy("part").applyInArrow(_weighted(constants), "kind int, batch string, data binary")
    both = counts.where(~F.col("weighed")).select("kind", "batch", "data").union(more).repartition(max(8, parts // 3), "batch")
    out = T.StructType([rows.schema["row"], *T._parse_datatype_string("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")])
    return both.groupBy("batch").applyInArrow(_gathered(constants, started), out)
