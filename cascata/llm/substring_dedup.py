"""Substring dedup by super-k-mers: exact counting of word windows that several documents share.

A window is ``window`` consecutive words of one document. It is repeated if the same words also start a window in a document
with a smaller doc_id; every word that a repeated window covers is removed. Windows are judged on the input.

Each window has a minimiser, the smallest hash among its runs of ``grain`` words. Consecutive windows with one minimiser
make a super-k-mer, which travels as one packed string (its words, joined by blanks) to the bucket of that minimiser, so
that equal windows always meet. There, windows are sorted by a 64-bit hash, and equal hashes are compared word by word,
which makes counting exact.

A survey of all texts first counts minimisers: tasks send sorted 44-bit values, about four bytes for a super-k-mer, to slices
of the value range. What occurs once holds no repeated window and stays at home. The values that occur more often mark
cells of a bitmap of a fixed size (2 ** ``CELL_BITS`` bits at most), which every task gets; a cell that several values share
costs some extra packing, never a result. Buckets are spread over partitions; a task gathers ``SHIP_BYTES`` of text before it
packs one compressed block for each partition, so that blocks stay large however many partitions there are.

Minimisers with ``HOT_ROWS`` super-k-mers or more (twice, four times, ... as many, if more than ``HOT_MOST`` of them are known)
would overload their bucket, which one task holds. Their windows travel singly and are counted by a plain aggregation on the
window's words, which combines before the shuffle, and whose join splits skewed keys. No window is dropped or sampled.

Null, empty and short texts have no windows; null text has no words. A null doc_id has no order: such documents neither
remove nor lose words. Rows that repeat a doc_id are documents of their own that don't remove each other's words. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cascata.llm.common import bounded_batches
from cascata.llm.tokens import Words, is_in, mix64, pieces, window_hashes
from cascata.session import materialize, passing

WINDOW = 13
GRAIN = 4
HOT_ROWS, HOT_MOST = 20_000, 1 << 20
BLOCK_BYTES = 6 << 20
SHIP_BYTES = 32 << 20
CELL_BITS = 28
_VALUE_BITS, _SLICE_BITS = 44, 10
_SURVEY_KEYS = 2_000_000
_PIECE = 4 << 20


def super_kmers(words: Words, window: int = WINDOW, grain: int = GRAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, minimiser) of each super-k-mer; windows are numbered by their first word."""
    grams = window_hashes(words.hashes(), grain)
    n = len(words) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    least = grams[:n].copy()
    for j in range(1, window - grain + 1):
        np.minimum(least, grams[j : j + n], out=least)
    owner = words.owners()
    whole = owner[:n] == owner[window - 1 : window - 1 + n]
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none, none, np.zeros(0, np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]) | (least[at[1:]] != least[at[:-1]])
    begin = np.flatnonzero(new)
    return owner[at[begin]], at[begin], np.diff(np.append(begin, len(at))), least[at[begin]]


def text_tag(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 32-bit mark of each text, which tells rows with one doc_id apart."""
    return np.array([int.from_bytes(hashlib.blake2b(raw[a : b - 1].tobytes(), digest_size=4).digest(), "little") for a, b in zip(bounds[:-1], bounds[1:])], np.int64)


def _value(keys: np.ndarray) -> np.ndarray:
    """Minimisers as evenly spread 44-bit values."""
    return mix64(keys) >> np.uint64(64 - _VALUE_BITS)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted values by slice, as compressed differences; under a null slice the bytes that the super-k-mers take."""
    schema = pa.schema([("slice", pa.int32()), ("values", pa.binary()), ("bytes", pa.int64())])
    held: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        values = np.sort(np.concatenate(held))
        held.clear()
        edges = np.searchsorted(values, np.arange((1 << _SLICE_BITS) + 1, dtype=np.uint64) << np.uint64(_VALUE_BITS - _SLICE_BITS))
        filled = np.flatnonzero(np.diff(edges))
        blobs = []
        for i in filled.tolist():
            mine = values[edges[i] : edges[i + 1]]
            steps = np.diff(mine, prepend=np.uint64(i << (_VALUE_BITS - _SLICE_BITS)))
            planes = steps.view(np.uint8).reshape(-1, 8)[:, :5].T  # a slice spans 2 ** 34 values
            blobs.append(zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(blobs, pa.binary()), pa.nulls(len(filled), pa.int64())], schema=schema)

    for batch in batches:
        for _, _, raw, bounds in pieces(batch.column("text"), _PIECE):
            words = Words(raw, bounds)
            _, first, count, key = super_kmers(words)
            if len(first):
                held.append(_value(key))
                size += int((words.ends[first + count + WINDOW - 2] - words.starts[first]).sum())
            if sum(map(len, held)) >= _SURVEY_KEYS:
                yield from flush()
    if held:
        yield from flush()
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([size])], schema=schema)


def _repeated(hot_rows: int):
    def counted(table: pa.Table) -> pa.Table:
        """Of one slice: its cells of values that occur more than once, the values that many super-k-mers have, and totals."""
        parts = []
        for blob in table["values"]:
            planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.uint8).reshape(5, -1)
            steps = np.zeros((planes.shape[1], 8), np.uint8)
            steps[:, :5] = planes.T
            parts.append(np.cumsum(steps.view(np.uint64)[:, 0], dtype=np.uint64))
        low = int(table["slice"][0].as_py())
        values, n = np.unique(np.concatenate(parts), return_counts=True)
        values += np.uint64(low << (_VALUE_BITS - _SLICE_BITS))
        cells = np.zeros(1 << (CELL_BITS - _SLICE_BITS), np.uint8)
        cells[((values[n > 1] >> np.uint64(_VALUE_BITS - CELL_BITS)) & np.uint64(len(cells) - 1)).astype(np.int64)] = 1
        bits = zstandard.ZstdCompressor(level=1).compress(np.packbits(cells).tobytes())
        hot = n >= hot_rows
        return pa.table({"slice": pa.array([low], pa.int32()), "cells": pa.array([bits], pa.binary()), "hot": pa.array([values[hot].tobytes()], pa.binary()), "n_hot": pa.array([n[hot].astype(np.int64).tobytes()], pa.binary()), "n": pa.array([int(n.sum())]), "n_repeated": pa.array([int(n[n > 1].sum())])})

    return counted


class Known:
    """What the survey says of minimisers: which occur more than once (or share a cell with such), and which are hot."""

    def __init__(self, bits: int, cells: np.ndarray, hot: np.ndarray):
        self.bits, self.cells, self.hot = bits, cells, hot

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(repeated but not hot, hot) as masks."""
        values = _value(keys)
        cell = values >> np.uint64(_VALUE_BITS - self.bits)
        hot = is_in(values, self.hot)
        return (self.cells[cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8)) & 1).astype(bool) & ~hot, hot


def survey(docs: DataFrame) -> tuple[Known, int]:
    """The minimisers of ``docs`` (text), and about how many bytes the super-k-mers under repeated ones take.

    The driver gets 2 ** CELL_BITS bits and HOT_MOST values at most, whatever the corpus.
    """
    seen = materialize(docs.select("text").mapInArrow(_survey, "slice int, values binary, bytes long"), "substr-survey")
    total = seen.where("slice is null").agg(F.sum("bytes")).first()[0] or 0
    schema = "slice int, cells binary, hot binary, n_hot binary, n long, n_repeated long"
    slices = materialize(seen.where("slice is not null").select("slice", "values").groupBy("slice").applyInArrow(_repeated(HOT_ROWS), schema), "substr-slices")
    n, repeated = slices.agg(F.sum("n"), F.sum("n_repeated")).first()
    least, bits = HOT_ROWS, min(CELL_BITS, max(_SLICE_BITS + 3, (8 * (n or 1)).bit_length()))
    cells = np.zeros(1 << (bits - 3), np.uint8)
    hot, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    width = len(cells) >> _SLICE_BITS
    for r in slices.select("slice", "cells", "hot", "n_hot").toLocalIterator():
        mine = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["cells"])), np.uint8))
        mine = np.packbits(mine.reshape(-1, 1 << (CELL_BITS - bits)).any(axis=1))
        cells[r["slice"] * width : (r["slice"] + 1) * width] = mine
        hot.append(np.frombuffer(bytes(r["hot"]), np.uint64))
        counts.append(np.frombuffer(bytes(r["n_hot"]), np.int64))
        if sum(map(len, hot)) > HOT_MOST:
            hot, counts = [np.concatenate(hot)], [np.concatenate(counts)]
            while (counts[0] >= least).sum() > HOT_MOST:
                least *= 2
            hot, counts = [hot[0][counts[0] >= least]], [counts[0][counts[0] >= least]]
    hot, counts = np.concatenate(hot), np.concatenate(counts)
    return Known(bits, cells, np.sort(hot[counts >= least])), int(total * (repeated or 0) / (n or 1))


def _pack(ids, tags, starts, sizes, data: bytes) -> bytes:
    head = b"".join(np.ascontiguousarray(x, t).tobytes() for x, t in ((ids, np.int64), (tags, np.uint32), (starts, np.uint32), (sizes, np.uint32)))
    return zstandard.ZstdCompressor(level=1).compress(len(ids).to_bytes(8, "little") + head + data)


def _unpack(block: bytes):
    data = zstandard.ZstdDecompressor().decompress(block)
    n = int.from_bytes(data[:8], "little")
    ids = np.frombuffer(data, np.int64, n, 8)
    tags = np.frombuffer(data, np.uint32, n, 8 + 8 * n)
    starts = np.frombuffer(data, np.uint32, n, 8 + 12 * n)
    sizes = np.frombuffer(data, np.uint32, n, 8 + 16 * n)
    return ids, tags, starts, sizes, data[8 + 20 * n :]


def _shipped(shared, parts: int):
    schema = pa.schema([("part", pa.int32()), ("block", pa.binary())])

    def blocks(held: list[tuple]) -> pa.RecordBatch:
        """One block for each partition, of all that was gathered."""
        part, ids, tags, starts, sizes = (np.concatenate([h[k] for h in held]) for k in range(5))
        strings = [x for h in held for x in h[5]]
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) != 0)))
        made = []
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
            at = order[x:y]
            made.append(_pack(ids[at], tags[at], starts[at], sizes[at], b"".join([strings[i] for i in at.tolist()])))
        return pa.RecordBatch.from_arrays([pa.array(part[order][cut].astype(np.int32)), pa.array(made, pa.binary())], schema=schema)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_keys = shared.value
        held, gathered = [], 0
        for batch in batches:
            ids = batch.column("doc_id")
            known = np.asarray(ids.is_valid())
            ids = np.asarray(ids.fill_null(0))
            for a, b, raw, bounds in pieces(batch.column("text"), _PIECE):
                words = Words(raw, bounds)
                owner, first, count, key = super_kmers(words)
                keep = known[a:b][owner] & known_keys.split(key)[0]
                owner, first, count, key = owner[keep], first[keep], count[keep], key[keep]
                if not len(first):
                    continue
                begin, end = words.starts[first], words.ends[first + count + WINDOW - 2] + 1  # with the blank behind
                text = words.data.tobytes()
                strings = [text[s:e] for s, e in zip(begin.tolist(), end.tolist())]
                part = ((key >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
                held.append((part, ids[a:b][owner], text_tag(raw, bounds)[owner], first - words.first[owner], end - begin, strings))
                gathered += int((end - begin).sum())
                if gathered >= SHIP_BYTES:
                    yield blocks(held)
                    held, gathered = [], 0
        if held:
            yield blocks(held)

    return ship


def _spans(ids, tags, at) -> pa.Table:
    """Runs of consecutive hit windows as (doc_id, tag, first word, words). Rows come sorted by super-k-mer and place."""
    if not len(ids):
        return pa.table({"doc_id": pa.array([], pa.int64()), "tag": pa.array([], pa.int64()), "start": pa.array([], pa.int64()), "size": pa.array([], pa.int64())})
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(ids)))
    return pa.table({"doc_id": pa.array(ids[begin]), "tag": pa.array(tags[begin].astype(np.int64)), "start": pa.array(at[begin].astype(np.int64)), "size": pa.array((count + WINDOW - 1).astype(np.int64))})


def later_windows(ids: np.ndarray, hashes: np.ndarray, words_of) -> np.ndarray:
    """Which windows have an equal one with a smaller id. words_of(i): the words of window i, to compare equal hashes."""
    order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    hit = np.zeros(len(ids), bool)
    same = np.concatenate(([False], sorted_hashes[1:] == sorted_hashes[:-1])) if len(order) else np.zeros(0, bool)
    begin = np.flatnonzero(~same)
    least = np.minimum.reduceat(ids[order], begin) if len(order) else ids
    sizes = np.diff(np.append(begin, len(order)))
    least = np.repeat(least, sizes)
    shared = np.repeat(sizes > 1, sizes)
    group = np.repeat(np.arange(len(begin)), sizes)
    maybe = shared & (np.repeat(np.maximum.reduceat(ids[order], begin) if len(order) else ids, sizes) > least)
    last, kept, clash = -1, None, set()
    for i, g in zip(order[maybe].tolist(), group[maybe].tolist()):
        mine = words_of(i)
        if g != last:
            last, kept = g, mine
        elif mine != kept:
            clash.add(g)
    hit[order[maybe]] = (ids[order] > least)[maybe]
    for g in clash:  # two sequences with one hash: told apart by their words
        members = order[group == g].tolist()
        first: dict[bytes, int] = {}
        for i in members:
            first[words_of(i)] = min(first.get(words_of(i), ids[i]), ids[i])
        for i in members:
            hit[i] = ids[i] > first[words_of(i)]
    return hit


def _counted(table: pa.Table) -> pa.Table:
    """All buckets of a partition: the spans that its super-k-mers lose."""
    parts: list[list] = [[], [], [], [], []]
    for packed in table.column("block"):
        for kept, new in zip(parts, _unpack(packed.as_py())):
            kept.append(new)
    ids, tags, starts, sizes = (np.concatenate(x) for x in parts[:4])
    text = b"".join(parts[4])
    del parts
    words = Words(np.frombuffer(text, np.uint8), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))))
    n = len(words) - WINDOW + 1
    owner = words.owners()
    at = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    hashes = window_hashes(words.hashes(), WINDOW)[at]
    begin, end = words.starts[at], words.ends[at + WINDOW - 1]
    of = owner[at]
    hit = later_windows(ids[of], hashes, lambda i: text[begin[i] : end[i]])
    of, at = of[hit], at[hit]
    return _spans(ids[of], tags[of], starts[of].astype(np.int64) + at - words.first[of])


def _hot_windows(shared):
    """Windows under hot minimisers, one row each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("words", pa.string()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64())])
        known_keys = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            known = np.asarray(ids.is_valid())
            ids = np.asarray(ids.fill_null(0))
            for a, b, raw, bounds in pieces(batch.column("text"), _PIECE):
                words = Words(raw, bounds)
                owner, first, count, key = super_kmers(words)
                keep = known[a:b][owner] & known_keys.split(key)[1]
                if not keep.any():
                    continue
                owner, first, count = owner[keep], first[keep], count[keep]
                of = np.repeat(owner, count)
                at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                text = words.data.tobytes()
                strings = [text[s:e] for s, e in zip(words.starts[at].tolist(), words.ends[at + WINDOW - 1].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(strings, pa.binary()).cast(pa.string()), pa.array(ids[a:b][of]), pa.array(text_tag(raw, bounds)[of]), pa.array(at - words.first[of])], schema=schema)

    return rows


def repeated_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, tag, start, size): runs of words that repeated windows cover, possibly overlapping."""
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with passing(spark):
        known, size = survey(docs)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
    shared = spark.sparkContext.broadcast(known)
    shipped = docs.mapInArrow(_shipped(shared, parts), "part int, block binary")
    spans = shipped.groupBy("part").applyInArrow(_counted, "doc_id long, tag long, start long, size long")
    if len(known.hot):
        windows = materialize(docs.mapInArrow(_hot_windows(shared), "words string, doc_id long, tag long, start long"), "substr-hot")
        first = windows.groupBy("words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("words", "first")
        again = windows.join(first, "words").where("doc_id > first")
        spans = spans.unionByName(again.select("doc_id", "tag", "start", F.lit(WINDOW).cast("long").alias("size")))
    return spans


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    for batch in batches:
        spans = batch.column("spans")
        for a, b, raw, bounds in pieces(batch.column("text"), _PIECE):
            words = Words(raw, bounds)
            text = words.data.tobytes()
            removed, kept = [], []
            for i in range(a, b):
                x, y = int(words.first[i - a]), int(words.first[i - a + 1])
                mine = spans[i].as_py()
                if not mine:
                    removed.append(0)
                    kept.append(text[words.starts[x] : words.ends[y - 1]] if y > x else b"")
                    continue
                gone = np.zeros(y - x, bool)
                for s in mine:
                    gone[s["start"] : s["start"] + s["size"]] = True
                removed.append(int(gone.sum()))
                at = np.flatnonzero(~gone) + x
                kept.append(b" ".join([text[s:e] for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist())]))
            n = np.diff(words.first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tags = [text_tag(raw, bounds) for _, _, raw, bounds in pieces(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(np.concatenate(tags) if tags else np.zeros(0, np.int64))], names=["doc_id", "text", "_tag"])


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by blanks), a row per document."""
    spans = repeated_spans(documents).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_t"), "spans")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tagged, "doc_id long, text string, _tag long")
    joined = docs.join(spans, (F.col("doc_id") == F.col("_id")) & (F.col("_tag") == F.col("_t")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string")
