"""SentencePiece encoding and decoding with the tokenizers library: the model's protobuf is read field by field and rebuilt.

Rebuilt are the normaliser (compiled character map, extra white space, dummy prefix), the metaspace marker, unigram scores or the merges
that BPE scores stand for, and byte fallback. Batches are encoded and decoded by several threads.

Where no piece has the marker after another character, no merge goes over a marker's left side, so texts are split there first and the
library's cache of words applies; the ids are the same. For the same reason a long text is encoded in runs of about RUN characters, cut at
single spaces between ASCII letters or digits, where no normalisation reaches over; its ids are those of its runs in a row.

A unigram model of the tokenizers library matches any piece in text. Unknown, control and unused pieces are renamed so that no text holds
them; byte pieces need their names, so texts whose normal form has one written out ("<0x41>") are encoded by the sentencepiece library.

Defined cases: a null or empty text has no ids and decodes to an empty text; control pieces are never produced; texts of any length are
encoded whole, in bounded memory where they have places to cut; repeated rows are encoded each; an empty table gives an empty result; input
columns come back inside `row`.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import words as W
from quern.llm.packing import trim
from quern.session import ship

#: Bytes of text encoded at a time, and characters of a text's runs: the library's records of a text take some 50 times its bytes.
PIECE, RUN = 256 << 10, 64 << 10
_CUT = re.compile("(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
MARK = "▁"
_WRITTEN_BYTE = re.compile("<0x[0-9A-F]{2}>")
#: Kinds of pieces, and of models, in the public protobuf definition.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message; lengths and fixed values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    one_space: bool = True
    escape: bool = True


def parse(data: bytes) -> Model:
    """A model file's pieces (text, score, kind) and settings."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.kind = v
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n in (3, 4, 5):
                    setattr(m, {3: "dummy_prefix", 4: "one_space", 5: "escape"}[n], bool(v))
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Pairs whose joint text is a piece, best piece first: what a BPE model's scores say about the order of merges."""
    score = {p: s for p, s, kind in m.pieces if kind in (NORMAL, USER_DEFINED)}
    ranked = sorted((p for p in score if len(p) > 1), key=lambda p: -score[p])
    return [(p[:i], p[i:]) for p in ranked for i in range(1, len(p)) if p[:i] in score and p[i:] in score]


def by_words(m: Model) -> bool:
    """Whether texts can be cut before words: each word's marker begins a piece, and a text's first word looks like any other."""
    return m.escape and not any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED))


def build(data: bytes):
    """The model as a tokenizers.Tokenizer."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = parse(data)
    unknown = next((i for i, x in enumerate(m.pieces) if x[2] == UNKNOWN), None)
    if m.kind == BPE:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges(m), unk_token=m.pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=m.byte_fallback)
    elif m.kind == UNIGRAM:
        # normal texts have no spaces where they are escaped; the least score of a normal piece is what an unknown character's stands on
        least = min((s for _, s, kind in m.pieces if kind == NORMAL), default=0.0)
        hidden = " " if m.escape else "\uffff"
        model = models.Unigram([(hidden * (kind in (UNKNOWN, CONTROL, UNUSED)) + p, s if kind == NORMAL else least) for p, s, kind in m.pieces], unknown, m.byte_fallback)
    else:
        raise ValueError(f"model kind {m.kind} is neither unigram nor BPE")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.one_space:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape else " "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if by_words(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+"), "merged_with_next")
    shown = [decoders.Replace(Regex(f"^{hidden}"), "")] if m.kind == UNIGRAM else []
    t.decoder = decoders.Sequence([*shown, decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *[decoders.Strip(" ", 1, 0)] * m.dummy_prefix])
    own = [AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER_DEFINED]
    if own:
        t.add_tokens(own)
    return t


@functools.cache
def loaded(path: str, threads: int):
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    with open(path, "rb") as f:
        return build(f.read())


@functools.cache
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def _traits(path: str) -> tuple[frozenset[int], bool]:
    """Ids of byte pieces, if text can be taken for them, and whether texts may be cut into runs."""
    with open(path, "rb") as f:
        m = parse(f.read())
    taken = frozenset(i for i, x in enumerate(m.pieces) if x[2] == BYTE) if m.kind == UNIGRAM else frozenset()
    return taken, by_words(m) and m.dummy_prefix and not any(kind == USER_DEFINED for _, _, kind in m.pieces)


def runs(text: str, cuts: bool = True) -> list[str]:
    """The text in pieces of at least RUN characters where it has places to cut; the space at a cut belongs to neither."""
    out, begin = [], 0
    while cuts and len(text) - begin > RUN and (m := _CUT.search(text, begin + RUN)):
        out.append(text[begin : m.start()])
        begin = m.end()
    out.append(text[begin:])
    return out


def encoded(path: str, texts: list[str], threads: int) -> list[np.ndarray]:
    """Ids of each text."""
    t, (taken, _) = loaded(path, threads), _traits(path)
    ids = [np.array(e.ids, np.int32) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    if taken:
        for i, x in enumerate(ids):
            if not taken.isdisjoint(x.tolist()) and _WRITTEN_BYTE.search(t.normalizer.normalize_str(texts[i])):
                ids[i] = np.array(_library(path).encode(texts[i]), np.int32)
    return ids


def differences(path: str, texts: list[str]) -> list[int]:
    """Indices of texts that the rebuilt tokenizer encodes unlike the sentencepiece library."""
    want = _library(path).encode(texts, num_threads=1)
    return [i for i, (a, x) in enumerate(zip(want, texts)) if a != np.concatenate(encoded(path, runs(x, _traits(path)[1]), 2)).tolist()]


@functools.cache
def _spelled(path: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The bytes that a BPE model's pieces stand for, in a row, and where each begins (one more for the end); None for other models."""
    with open(path, "rb") as f:
        m = parse(f.read())
    if m.kind != BPE or not m.dummy_prefix or any(kind == USER_DEFINED for _, _, kind in m.pieces):
        return None
    spelled = [bytes([int(p[3:5], 16)]) if _WRITTEN_BYTE.fullmatch(p) else p.replace(MARK, " ").encode() for p, _, _ in m.pieces]
    return np.frombuffer(b"".join(spelled), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in spelled])))


def _decoded_same(t, ids: list[np.ndarray], texts: list[str]) -> list[bool]:
    return [a == b for a, b in zip(t.decode_batch([x.tolist() for x in ids], skip_special_tokens=False), texts)]


def _same(path: str, t, ids: list[np.ndarray], texts: list[str]) -> list[bool]:
    """Whether ids decode to their texts. Where the pieces' bytes are the text's after one space, the decoder gives the text too: what lies
    between whole pieces of valid UTF-8 is valid. All other texts are decoded."""
    if (spelled := _spelled(path)) is None:
        return _decoded_same(t, ids, texts)
    data, begins = spelled
    every = np.concatenate(ids)
    sizes = begins[every + 1] - begins[every]
    ends = np.cumsum(sizes)
    found = data[np.repeat(begins[every] - ends + sizes, sizes) + np.arange(sizes.sum())].tobytes()
    at = np.concatenate(([0], ends))[np.cumsum([0, *map(len, ids)])].tolist()
    same = [found[a:b] == b" " + x.encode() for a, b, x in zip(at, at[1:], texts)]
    rest = [i for i, ok in enumerate(same) if not ok]
    for i, ok in zip(rest, _decoded_same(t, [ids[i] for i in rest], [texts[i] for i in rest])):
        same[i] = ok
    return same


def _in_runs(path: str, t, text: str, cuts: bool, threads: int, check: bool) -> tuple[np.ndarray, bool]:
    """A text of any length, a few runs at a time: its ids, and whether all runs come back."""
    ids, same, parts = [], True, runs(text, cuts)
    for a in range(0, len(parts), 2 * threads):
        group = parts[a : a + 2 * threads]
        found = encoded(path, group, threads)
        same = same and (not check or all(_same(path, t, found, group)))
        ids += found
    return np.concatenate(ids), same


def _encode(path: str, threads: int, check: bool, parity: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, (_, cuts) = loaded(path, threads), _traits(path)
        for batch in batches:
            for piece in W.pieces(batch, "text", PIECE):
                texts = [x or "" for x in piece.column("text").to_pylist()]
                if len(texts) == 1:
                    found, back = _in_runs(path, t, texts[0], cuts, threads, check)
                    ids, same = [found], [back]
                else:
                    ids = encoded(path, texts, threads)
                    same = _same(path, t, ids, texts) if check else []
                at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                columns = [piece.column("row"), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids)))]
                if check:
                    columns.append(pa.array(same, pa.bool_()))
                if parity:
                    columns.append(pa.array([x.tolist() == y for x, y in zip(ids, _library(path).encode(texts, num_threads=threads))], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, ["row", "ids", *["same"] * check, *["parity"] * parity])
            trim()

    return encode


def _decode(path: str, threads: int):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(path, threads)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                texts = t.decode_batch([[i for i in x or [] if i is not None] for x in part.column("ids").to_pylist()], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], ["row", "decoded"])

    return decode


def _row(df: DataFrame, carry: list[str] | None):
    return F.struct(*[F.col(f"`{c}`") for c in carry or df.columns]).alias("row")


def encode(docs: DataFrame, model: str, text: str = "text", carry: list[str] | None = None, threads: int = 2, check: bool = False, parity: bool = False) -> DataFrame:
    """For every row of docs: row (a struct of its columns, or of carry) and ids; with check also same: the ids decode to the text; with
    parity also parity: the sentencepiece library gives the same ids.

    model: a SentencePiece file that driver and executors reach by this path. threads: of a task.
    """
    ship(docs.sparkSession)
    rows = docs.select(_row(docs, carry), F.col(f"`{text}`").cast("string").alias("text"))
    out = T.StructType([rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("same", T.BooleanType())] * check, *[T.StructField("parity", T.BooleanType())] * parity])
    return rows.mapInArrow(_encode(model, threads, check, parity), out)


def decode(encoded: DataFrame, model: str, ids: str = "ids", carry: list[str] | None = None, threads: int = 2) -> DataFrame:
    """For every row: row (a struct of its columns, or of carry) and decoded, the text of its ids."""
    ship(encoded.sparkSession)
    rows = encoded.select(_row(encoded, carry), F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(model, threads), T.StructType([rows.schema["row"], T.StructField("decoded", T.StringType())]))
