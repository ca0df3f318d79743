"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark, merged into maximal removal intervals.

Each task sends its windows' hashes to the part that a second, independent hash names, packed as numpy arrays; the part finds hashes that occur
more than once and answers each batch with the windows' places; the answers meet their documents again by a 128-bit key of identifier and text.
Hashes are counted inside a batch first: one that occurs there again is known to repeat, so its places stay with the batch and the part gets it
once, marked. A window that makes up a third of the corpus is then one number for each batch.

Defined cases: a null text has no words; texts shorter than the window keep everything; rows repeated as they are count as other
places, so their shared windows go from each of them; a null identifier is an identifier like any other; an empty table gives an empty
result; input columns come back inside `row`, so their names cannot clash. Windows are compared by 64-bit hashes of random-valued words
and, without bytes of its own, by the part that the second hash names: among n different windows, n**2 / 2**65 / parts pairs are expected
to look equal, and parts grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import words as W
from quern.llm.packing import packed, unpacked
from quern.session import parts_for, ship

#: Stored input bytes for which there is one part; a part's task needs about 15 times as much memory.
PART_BYTES = 12 << 20
#: Fixed value: makes other random values of words' hashes.
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_SENT = pa.schema([("part", pa.int32()), ("batch", pa.string()), ("keys", pa.binary()), ("data", pa.binary())])
_PLACES = pa.schema([("batch", pa.string()), ("keys", pa.binary()), ("data", pa.binary())])


def _send(window: int, parts: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "text", 8 << 20):
                words, at = W.hashes(piece.column("text"))
                h, first = W.rolling(words, at, window)
                if not len(h):
                    continue
                keys = packed(*(piece.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in ("k1", "k2")))
                text = np.searchsorted(at, first, "right") - 1
                place = first - at[text]
                second, _ = W.rolling(W.mix(words ^ _SECOND), at, window)
                part = (second % np.uint64(parts)).astype(np.int64)
                name = xxhash.xxh3_128_hexdigest(keys + h.tobytes())
                order = np.argsort(part, kind="stable")
                h, text, place, part = h[order], text[order], place[order], part[order]
                order = np.argsort(h, kind="stable")  # equal hashes stay sorted by part
                same = (h[order[1:]] == h[order[:-1]]) & (part[order[1:]] == part[order[:-1]])
                again = np.zeros(len(h), bool)
                again[order[1:]] = same
                spare = again.copy()  # of a repeated hash, all but the first
                again[order[:-1]] |= same
                rows = [(int(name[:8], 16) % parts, name, keys, packed(text[again], place[again]) if again.any() else None)]
                known, known_part = h[again & ~spare], part[again & ~spare]
                h, text, place, part = h[~again], text[~again], place[~again], part[~again]
                bounds, marked = np.searchsorted(part, np.arange(parts + 1)), np.searchsorted(known_part, np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(bounds) + np.diff(marked)):
                    a, b = bounds[p], bounds[p + 1]
                    new = np.flatnonzero(np.concatenate(([True], text[a + 1 : b] != text[a : b - 1]))) if b > a else np.empty(0, np.int64)
                    rows.append((p, name, None, packed(h[a:b], place[a:b], np.diff(np.append(new, b - a)), text[a:b][new], known[marked[p] : marked[p + 1]])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT)], schema=_SENT)

    return send


def _repeated(table: pa.Table) -> pa.Table:
    """The places of windows whose hash occurs in this part more than once, by batch; batches' keys and what they know by themselves pass through."""
    out, sent = [], []
    for name, keys, data in zip(table.column("batch").to_pylist(), table.column("keys").to_pylist(), table.column("data")):
        if keys is not None:
            out.append((name, keys, data.as_py()))
        else:
            sent.append((name, unpacked(data.as_buffer().to_pybytes())))
    if sent:
        ordered = np.sort(np.concatenate([x[i] for _, x in sent for i in (0, 4, 4)]))
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        del ordered
        for name, (h, place, counts, texts, _) in sent if len(again) else ():
            near = np.minimum(np.searchsorted(again, h), len(again) - 1)
            hit = np.flatnonzero(again[near] == h)
            if len(hit):
                out.append((name, None, packed(np.repeat(texts, counts)[hit], place[hit])))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PLACES)], schema=_PLACES) if out else _PLACES.empty_table()


def _by_document(table: pa.Table) -> pa.Table:
    """A batch's answers as one row for each document that has repeated windows."""
    keys, found = None, []
    for own, data in zip(table.column("keys").to_pylist(), table.column("data").to_pylist()):
        if own is not None:
            keys = np.stack(unpacked(own), 1)
        if data is not None:
            found.append(np.stack([x.astype(np.int64) for x in unpacked(data)], 1))
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("places", pa.binary())])
    if not found:
        return schema.empty_table()
    found = np.concatenate(found)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    new = np.flatnonzero(np.concatenate(([True], found[1:, 0] != found[:-1, 0])))
    own, places = keys[found[new, 0]].view(np.int64), found[:, 1].astype(np.uint32)
    return pa.Table.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array([places[a:b].tobytes() for a, b in zip(new, np.append(new[1:], len(found)))], pa.binary())], schema=schema)


def _intervals(places: bytes, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [begin, end) of words that the windows at these places cover."""
    first = np.unique(np.frombuffer(places, np.uint32)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], first[1:] > first[:-1] + window)))
    return list(zip(first[new].tolist(), (first[np.append(new[1:], len(first)) - 1] + window).tolist()))


def _take_out(window: int, schema: pa.Schema):
    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "text", 8 << 20):
                n_words, n_removed, kept, removed = [], [], [], []
                for text, places in zip(piece.column("text").to_pylist(), piece.column("places").to_pylist()):
                    words = (text or "").encode().split()  # bytes split at \x20 and \x09-\x0D, and nowhere else
                    n_words.append(len(words))
                    spans = _intervals(places, window) if places else []
                    for a, b in reversed(spans):
                        del words[a:b]
                    n_removed.append(sum(b - a for a, b in spans))
                    removed.append([{"begin": a, "end": b} for a, b in spans])
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, schema.field("removed").type), pa.array(kept, pa.binary()).cast(pa.string())], schema=pa.schema([pa.field("row", piece.schema.field("row").type), *list(schema)[1:]]))

    return take_out


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = 35, carry: list[str] | None = None) -> DataFrame:
    """For every row of docs: row (a struct of its columns, or of carry), n_words, n_removed, removed (intervals of word numbers) and kept_text.

    A word goes if a window of `window` words that covers it starts anywhere else too. kept_text joins the other words by one space.
    """
    ship(docs.sparkSession)
    parts = parts_for(docs, PART_BYTES)
    carry = carry or docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{key}`")).alias("k1"), F.xxhash64(F.col(f"`{text}`")).alias("k2"))
    sent = rows.select("k1", "k2", "text").mapInArrow(_send(window, parts), "part int, batch string, keys binary, data binary")
    answers = sent.groupBy("part").applyInArrow(_repeated, "batch string, keys binary, data binary")
    # rows that are copies, identifier included, have the same places
    places = answers.groupBy("batch").applyInArrow(_by_document, "k1 long, k2 long, places binary").dropDuplicates(["k1", "k2"])
    out = T.StructType([rows.schema["row"], *T._parse_datatype_string("n_words long, n_removed long, removed array<struct<begin:int,end:int>>, kept_text string")])
    arrow = pa.schema([("row", pa.null()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string())])
    full = rows.drop("text") if text in carry else rows  # no second copy of the text in the shuffle
    found = full.join(places, ["k1", "k2"], "left").select("row", F.col(f"row.`{text}`").cast("string").alias("text") if text in carry else "text", "places")
    return found.mapInArrow(_take_out(window, arrow), out)
