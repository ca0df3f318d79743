"""Token counts: every distinct pre-token is tokenized once, its pieces are counted, and counts meet per-document pre-token frequencies.

A task turns a batch of texts into pre-token frequencies by document and sends them, packed, to the part that each pre-token's hash names.
The part tokenizes each of its distinct pre-tokens once and answers with one sum for each document of a batch; the answers meet the
batch's documents by the batch's name, a hash of its content. Ids of whole texts are never made.

A pre-token that many documents of a batch have is salted: batches deal it to as many parts as it has documents in the batch (to all parts at
most), each of which tokenizes it once. So a part gets no more of a frequent pre-token than of a rare one: about one document a batch.

Defined cases: a null text is empty and has 0 tokens; texts of any length are counted whole; strings of special tokens inside a text count as one token each, as the library's
default has it; repeated rows are counted each; an empty table gives an empty result; input columns come back inside `row`.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import words as W
from quern.session import parts_for, ship

PART_BYTES = 8 << 20
#: Code points whose classes the regex library and the tokenizers library agree on; texts with others are split by the latter, slowly.
AGREED = re.compile("[^\x00-՗ -⁯₠-₿℀-⯿　-〿ぁ-ゖ゠-ヿ一-鿼가-힣\U0001f300-\U0001f64f]")
_SENT = pa.schema([("part", pa.int32()), ("batch", pa.string()), ("rows", pa.binary()), ("lengths", pa.binary()), ("strings", pa.binary()), ("spread", pa.binary()), ("docs", pa.binary()), ("times", pa.binary())])
_SUMS = pa.schema([("batch", pa.string()), ("rows", pa.binary()), ("sums", pa.binary())])


class _Numbers(dict):
    """A number for each key, in the order in which they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


@functools.cache
def _loaded(path: str):
    """The tokenizer, one that takes a text as a single pre-token, the pre-token pattern, and the strings of special tokens."""
    from tokenizers import Tokenizer, pre_tokenizers

    own, whole = Tokenizer.from_file(path), Tokenizer.from_file(path)
    whole.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    whole.encode_special_tokens = True
    special = sorted((t.content for t in own.get_added_tokens_decoder().values()), key=len, reverse=True)
    return own, whole, re.compile("|".join(map(re.escape, special))) if special else None


@functools.cache
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def pre_tokens(text: str, own) -> list[str]:
    """The text's pre-tokens: by the published pattern, or by the tokenizer where the two may differ."""
    if text.isascii() or not AGREED.search(text):
        return _pattern().findall(text)
    return [text[a:b] for _, (a, b) in own.pre_tokenizer.pre_tokenize_str(text)]


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as hold them; the first byte says how many."""
    top = int(x.max()) if len(x) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32}[x[0]], offset=1).astype(np.int64)


def _send(path: str, parts: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _, special = _loaded(path)
        for batch in batches:
            for piece in W.pieces(batch, "text", 12 << 20):
                numbers, ids, ends, extra = _Numbers(), [], [0], []
                for text in piece.column("text").to_pylist():
                    runs = special.split(text) if special and text else [text or ""]
                    found = [x for run in runs for x in pre_tokens(run, own)]
                    ids.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
                    extra.append(len(runs) - 1)
                    ends.append(ends[-1] + len(found))
                n = len(ids)
                doc = np.repeat(np.arange(n), np.diff(ends))
                key, times = np.unique(np.concatenate(ids) * n + doc, return_counts=True)  # by pre-token, then document
                token, doc = key // n, key % n
                strings = [x.encode() for x in numbers]
                sink = pa.BufferOutputStream()
                rows = pa.RecordBatch.from_arrays([piece.column("row"), pa.array(extra, pa.int64())], ["row", "extra"])
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows)
                kept = sink.getvalue().to_pybytes()
                name = xxhash.xxh3_128_hexdigest(kept + b"".join(strings) + key.tobytes() + times.tobytes())
                sent = [(zlib.crc32(name.encode()) % parts, name, kept, *[None] * 5)]
                first = np.searchsorted(token, np.arange(len(strings) + 1))
                salt = zlib.crc32(name.encode()) % np.minimum(np.diff(first), parts)
                part = (np.fromiter(map(zlib.crc32, strings), np.int64, len(strings)) + salt) % parts
                order = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(bounds)):
                    own_tokens = order[bounds[p] : bounds[p + 1]]
                    spread = first[own_tokens + 1] - first[own_tokens]
                    at = np.repeat(first[own_tokens] - np.cumsum(spread) + spread, spread) + np.arange(spread.sum())
                    mine = [strings[i] for i in own_tokens]
                    sent.append((p, name, None, _narrow(np.fromiter(map(len, mine), np.int64, len(mine))), b"".join(mine), _narrow(spread), _narrow(doc[at]), _narrow(times[at])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*sent), _SENT)], schema=_SENT)

    return send


def _count(path: str):
    def count(table: pa.Table) -> pa.Table:
        _, whole, _ = _loaded(path)
        numbers, asked, out = _Numbers(), [], []
        for r in table.to_pylist():
            if r["rows"] is not None:
                out.append((r["batch"], r["rows"], None))
                continue
            ends = np.cumsum(_wide(r["lengths"])).tolist()
            s, begins = r["strings"], [0, *ends[:-1]]
            asked.append((r, np.fromiter((numbers[s[a:b]] for a, b in zip(begins, ends)), np.int64, len(ends))))
        texts, pieces = list(numbers), np.empty(len(numbers), np.int64)
        for a in range(0, len(texts), 10_000):
            pieces[a : a + 10_000] = [len(e.ids) for e in whole.encode_batch_fast([x.decode() for x in texts[a : a + 10_000]], add_special_tokens=False)]
        for r, which in asked:
            each = np.repeat(pieces[which], _wide(r["spread"])) * _wide(r["times"])
            out.append((r["batch"], None, np.bincount(_wide(r["docs"]), each).astype(np.int64).tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SUMS)], schema=_SUMS)

    return count


def _gather(table: pa.Table) -> pa.Table:
    tables, total = [], np.zeros(0, np.int64)
    for rows, sums in zip(table.column("rows").to_pylist(), table.column("sums").to_pylist()):
        if rows is not None:
            tables.append(pa.ipc.open_stream(rows).read_all())
        else:
            s = np.frombuffer(sums, np.int64)
            if len(s) > len(total):
                total = np.concatenate([total, np.zeros(len(s) - len(total), np.int64)])
            total[: len(s)] += s
    total = np.concatenate([total, np.zeros(tables[0].num_rows - len(total), np.int64)]) // len(tables)  # batches that are copies answer alike
    return pa.concat_tables([pa.table({"row": t.column("row"), "n_tokens": pa.array(total + t.column("extra").to_numpy())}) for t in tables])


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """For every row of docs: row (a struct of its columns, or of carry) and n_tokens, by the tokenizers file at path tokenizer."""
    ship(docs.sparkSession)
    parts = parts_for(docs, PART_BYTES)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    sent = rows.mapInArrow(_send(tokenizer, parts), "part int, batch string, rows binary, lengths binary, strings binary, spread binary, docs binary, times binary")
    sums = sent.groupBy("part").applyInArrow(_count(tokenizer), "batch string, rows binary, sums binary")
    return sums.groupBy("batch").applyInArrow(_gather, T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType())]))
