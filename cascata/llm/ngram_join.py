"""Jaccard self-join of documents on word shingles, by signature trees.

A document's set is its distinct shingles of five lower-cased words, held as 64-bit hashes. Two documents link when
100 * |A & B| >= 75 * |A | B|. The result gives each document the smallest doc_id that links lead to. Every link is found
and checked on whole sets; what hashing can err by is two different shingles of one pair of documents with one 64-bit hash,
and two different sets (or blocks) with one size and one 128-bit digest.

1. Equal sets become one class; only class representatives go on.
2. All shingles have one total order, in which those known to be frequent come last, by frequency. Linked sets share one of
   their first |A| - ceil(0.75 |A|) + 1 shingles in that order, so every link lies within a block of representatives that
   have such a shingle in common. Of blocks with equal members one is kept.
3. Each block gets signature trees (``signature_tree``), and their dual traversal finds the pairs that may link. The first
   round takes the blocks of a few leading shingles of each document and of a block only pairs that span it; the documents'
   most frequent partners are verified, and links make first components. The second round takes every block that holds
   more than one component. The pairs that its trees leave may be as many as a group's size squared, so they only join
   components to regions: a task hands on what joins two that it had not joined before.
4. A link between two components lies within a region. The whole sets of a region's documents meet once, and its trees, now
   with a bit for each shared shingle, give the links that join its components.
5. A block of more than ``CHUNK`` documents (or a region of more than ``REGION`` shingles) is cut by size class, by component
   where one fills a chunk, and by hash. In the second round each pair of its chunks that may hold links has trees of its
   own, so that no task holds a hot block.

The frequent list only orders shingles, and the first round only saves work: a poor one costs time, never a link. Null,
empty and wordless texts have the empty set, link with nothing and are their own component. Rows that repeat a doc_id are
one node and give a row each. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cascata.llm.common import attach, bounded_batches
from cascata.llm.signature_tree import block_pairs, linked_pairs, signature, size_class
from cascata.llm.tokens import Frequent, Words, is_in, mix64, pieces, window_hashes
from cascata.operators.components import connected_components
from cascata.session import materialize, passing

SHINGLE = 5
MIN_SHARE = 0.75
#: Shingles of at least this share of all documents are listed as frequent, the most frequent HOT_MOST at most.
HOT_SHARE, HOT_MOST = 0.0002, 1 << 19
#: Of each document's prefix, the first round takes so many shingles that are not listed and so many that are.
LEADING = 3
CHUNK = 1024
#: Regions of more than so many shingles (and ``PER_SET`` more for each document) are cut.
REGION, PER_SET = 1 << 19, 64
#: Tree tasks gather blocks up to this many bytes before they build their trees.
FOREST_BYTES = 8 << 20
_SALTS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingle hashes of each text, text i's at first[i] : first[i + 1]."""
    words = Words(raw, bounds, lower=True)
    hashed = words.hashes()
    windows = window_hashes(hashed, size)
    out, lengths = [], np.zeros(len(bounds) - 1, np.int64)
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        if b - a >= size:
            mine = windows[a : b - size + 1].copy()
            mine.sort()
            if len(mine) > 1:
                mine = mine[np.concatenate(([True], mine[1:] != mine[:-1]))]
        elif b > a:  # the whole sequence as one shingle; its length is part of it
            mine = mix64(window_hashes(hashed[a:b], b - a) ^ _SALTS[b - a - 1])
        else:
            continue
        out.append(mine)
        lengths[i] = len(mine)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(lengths)))


def _digests(sets: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    out = []
    for salt in _SALTS[:2]:
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ salt))))
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out


_FEATURES = "doc_id long, n long, d1 long, d2 long, token long, freq long"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and at the end of the task a row for each frequent shingle."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in _FEATURES.split(", ")])
    frequent = Frequent(gather=1_500_000, keep=100_000)
    for batch in batches:
        ids = batch.column("doc_id")
        for a, b, raw, bounds in pieces(batch.column("text")):
            sets, first = shingle_sets(raw, bounds)
            frequent.add(sets)
            d1, d2 = _digests(sets, first)
            none = pa.nulls(b - a, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), pa.array(np.diff(first)), pa.array(d1), pa.array(d2), none, none], schema=schema)
    tokens, counts = frequent.items()
    if len(tokens):
        none = pa.nulls(len(tokens), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(tokens.view(np.int64)), pa.array(counts)], schema=schema)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int(is_in(a, b).sum())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text_a, text_b) whose sets are similar enough. The last b is kept, as its pairs follow each other."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    last, last_set = None, np.zeros(0, np.uint64)
    for batch in batches:
        left, right, b_ids = batch.column("text_a"), batch.column("text_b"), batch.column("b").to_pylist()
        keep = []
        row = 0
        for x, y, raw, bounds in pieces(left):
            sets, first = shingle_sets(raw, bounds)
            for i in range(x, y):
                if b_ids[row] != last:
                    last = b_ids[row]
                    one = next(pieces(right.slice(row, 1)))
                    last_set = shingle_sets(one[2], one[3])[0]
                mine = sets[first[i - x] : first[i - x + 1]]
                n, m = len(mine), len(last_set)
                ok = n and m and 4 * min(n, m) >= 3 * max(n, m) and 7 * _overlap(mine, last_set) >= 3 * (n + m)
                keep.append(bool(ok))
                row += 1
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids in ``pairs`` that link. texts: doc_id, text of representatives, one row for each."""
    ends = pairs.select(F.col("a").alias("need")).union(pairs.select("b")).distinct()
    needed = attach(texts, ends, "doc_id", "need", "left_semi")
    with_a = pairs.join(needed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(needed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")


def _in_order(mine: np.ndarray, hot: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, int]:
    """A set in the common order: unlisted shingles by hash, then listed ones by their count and hash; and how many are unlisted."""
    late = is_in(mine, hot)
    if not late.any():
        return mine, len(mine)
    tail = mine[late]
    return np.concatenate((mine[~late], tail[np.lexsort((tail, weight[np.searchsorted(hot, tail)]))])), len(mine) - len(tail)


_ROWS = "token long, doc_id long, comp long, n long, kind int, sig binary"


def _prefix_rows(hot_values, leading: bool):
    """Per document: a row with its size, size class and signature (token null), and a row per shingle of its prefix."""
    schema = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("kind", pa.int32()), ("sig", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, weight = hot_values.value
        for batch in batches:
            ids, comps = np.asarray(batch.column("doc_id")), np.asarray(batch.column("comp"))
            for a, b, raw, bounds in pieces(batch.column("text")):
                sets, first = shingle_sets(raw, bounds)
                n = np.diff(first)
                took, sigs = [np.zeros(0, np.uint64)] * (b - a), []
                for i, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    sigs.append(signature(sets[x:y]))
                    if y > x:
                        ordered, rare = _in_order(sets[x:y], hot, weight)
                        prefix = ordered[: (y - x) - (3 * (y - x) + 3) // 4 + 1]
                        took[i] = np.concatenate((prefix[:rare][:LEADING], prefix[rare:][:LEADING])) if leading else prefix
                tokens, sizes = np.concatenate(took), np.array([len(t) for t in took])
                none = pa.nulls(len(tokens), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(np.repeat(ids[a:b], sizes)), pa.array(np.repeat(comps[a:b], sizes)), none, pa.nulls(len(tokens), pa.int32()), pa.nulls(len(tokens), pa.binary())], schema=schema)
                yield pa.RecordBatch.from_arrays([pa.nulls(b - a, pa.int64()), pa.array(ids[a:b]), pa.array(comps[a:b]), pa.array(n), pa.array(size_class(n).astype(np.int32)), pa.array(sigs, pa.binary())], schema=schema)

    return rows


def _by_unit(pairs_of):
    """Rows sorted by unit (u1, u2), gathered to ``FOREST_BYTES`` of whole units for each call of ``pairs_of``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) < FOREST_BYTES:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            u1, u2 = (np.asarray(rows.column(c)) for c in ("u1", "u2"))
            whole = int(np.flatnonzero((u1 != u1[-1]) | (u2 != u2[-1]))[-1]) + 1 if (u1[0], u2[0]) != (u1[-1], u2[-1]) else 0  # the last block may go on
            if whole:
                yield from pairs_of(rows.slice(0, whole))
            held = [rows.slice(whole)]
        if sum(map(len, held)):
            yield from pairs_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return task


def _tree_task(spanning: bool):
    """Rows (u1, u2, side, n, doc_id, comp, sig), sorted by block (u1, u2): pairs of docs that span each block (the first
    round), or pairs of components that join to regions what its trees leave."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs_of(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key = [np.asarray(rows.column(c)) for c in ("u1", "u2")]
        new = np.concatenate(([True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])))
        block = np.cumsum(new) - 1
        side = np.asarray(rows.column("side")).astype(np.int64)
        crossed = np.bincount(block, side) > 0
        arrays = (np.asarray(rows.column(c)) for c in ("n", "doc_id", "comp"))
        last = np.zeros((0, 2), np.int64)
        for a, b in block_pairs(block, side, crossed, *arrays, rows.column("sig"), spanning, of_comps=not spanning):
            last = np.unique(np.concatenate((last, np.stack((a, b), 1))), axis=0)
            if len(last) >= 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(last[:, 0]), pa.array(last[:, 1])], schema=schema)
                last = last[:0]
        yield pa.RecordBatch.from_arrays([pa.array(last[:, 0]), pa.array(last[:, 1])], schema=schema)

    return _by_unit(pairs_of)


def _region_task(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows (u1, u2, side, doc_id, comp, sig), sig a whole set: the links that join components of each unit."""
    key = [np.asarray(rows.column(c)) for c in ("u1", "u2")]
    new = np.flatnonzero(np.concatenate(([True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]))))
    side, doc, comp = (np.asarray(rows.column(c)).astype(np.int64) for c in ("side", "doc_id", "comp"))
    found = [np.zeros((0, 2), np.int64)]
    for x, y in zip(new.tolist(), [*new[1:].tolist(), len(rows)]):
        sets = [np.frombuffer(v, np.uint64) for v in rows.column("sig").slice(x, y - x).to_pylist()]
        bounds = np.concatenate(([0], np.cumsum([len(v) for v in sets])))
        found += [np.stack(p, 1) for p in linked_pairs(np.concatenate(sets), bounds, side[x:y], doc[x:y], comp[x:y])]
    pairs = np.unique(np.concatenate(found), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


_PLACES = "u1 long, u2 long, side int, doc_id long, comp long, sig binary"


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with the whole set for each place (n, u1, u2, side, comp) of a document that names the set's size."""
    schema = pa.schema([("u1", pa.int64()), ("u2", pa.int64()), ("side", pa.int32()), ("doc_id", pa.int64()), ("comp", pa.int64()), ("sig", pa.binary())])
    out, held = [], 0

    def full() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for batch in batches:
        ids, places = batch.column("doc_id").to_pylist(), batch.column("places")
        for a, b, raw, bounds in pieces(batch.column("text")):
            sets, first = shingle_sets(raw, bounds)
            for i, at in enumerate(places.slice(a, b - a).to_pylist()):
                mine = sets[first[i] : first[i + 1]]
                for p in at:
                    if p["n"] == len(mine):
                        out.append((p["u1"], p["u2"], p["side"], ids[a + i], p["comp"], mine.tobytes()))
                        held += mine.nbytes + 64
                    if held > FOREST_BYTES // 2:
                        yield full()
                        out, held = [], 0
    if out:
        yield full()


def region_links(joined: DataFrame, comps: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links that join whatever components are linked within the regions to which the pairs ``joined`` join them.

    comps: node, comp of each representative; sizes: doc_id, n of all rows (a doc_id may repeat); texts: doc_id, text of
    representatives.
    """
    regions = connected_components(joined, "a", "b").select(F.col("node").alias("_n"), F.col("component").alias("token"))
    members = comps.join(regions, F.col("comp") == F.col("_n")).join(sizes.distinct(), F.col("node") == F.col("doc_id")).drop("doc_id")
    kind = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.35))).cast("int")  # similar sizes: one kind or neighbours
    members = materialize(members.select("token", F.col("node").alias("doc_id"), "comp", "n", kind.alias("kind"), F.lit(None).cast("binary").alias("sig")), "ngram-members")
    weight = F.col("n") + PER_SET
    large = materialize(members.groupBy("token").agg(F.sum(weight).alias("_w")).where(F.col("_w") > REGION).select(F.col("token").alias("_t")), "ngram-large")
    in_large = F.col("token") == F.col("_t")
    units = members.join(large, in_large, "left_anti").select(F.col("token").alias("u1"), F.lit(0).cast("long").alias("u2"), F.lit(0).alias("side"), "n", "doc_id", "comp")
    if not large.isEmpty():
        units = units.unionByName(_cut(members.join(large, in_large, "left_semi"), weight, REGION).drop("sig"))
    places = units.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_list(F.struct("n", "u1", "u2", "side", "comp")).alias("places"))
    places = materialize(places, "ngram-places")
    size = places.agg(F.sum(64 + 48 * F.size("places"))).first()[0] or 0
    sets = attach(texts.select("doc_id", "text"), places, "doc_id", "_d", "inner", size=size).select("doc_id", "text", "places").mapInArrow(_set_rows, _PLACES)
    return sets.repartition("u1", "u2").sortWithinPartitions("u1", "u2").mapInArrow(_by_unit(_region_task), "a long, b long")


def _cut(leaves: DataFrame, weight: Column, chunk: int) -> DataFrame:
    """Leaves of large blocks as rows of units (u1, u2): a chunk (one side) or two chunks whose pairs lie across them."""
    cells = leaves.groupBy("token", "kind", "comp").agg(F.sum(weight).alias("n_cell"))
    cells = cells.withColumn("pure", F.when(F.col("n_cell") >= chunk // 2, F.col("comp")))
    groups = materialize(cells.groupBy("token", "kind", "pure").agg(F.ceil(F.sum("n_cell") / chunk).cast("int").alias("chunks")), "ngram-cells")
    pure = materialize(cells.where("pure is not null").select(F.col("token").alias("_t"), F.col("kind").alias("_k"), F.col("pure").alias("_p")), "ngram-pure")
    x, y = (groups.select(F.col("token").alias(f"{s}t"), F.col("kind").alias(f"{s}k"), F.col("pure").alias(f"{s}p"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias(f"{s}c")) for s in "xy")
    same_cell = (F.col("yk") == F.col("xk")) & F.col("yp").eqNullSafe(F.col("xp"))
    # A chunk of one component has no open pair inside; of two cells of one class each pair of chunks comes once.
    within = same_cell & F.col("xp").isNull() & (F.col("yc") >= F.col("xc"))
    beside = (F.col("yk") == F.col("xk")) & (F.col("xp").isNull() & F.col("yp").isNotNull() | (F.col("xp") < F.col("yp")))
    above = (F.col("yk") == F.col("xk") + 1) & ~F.coalesce(F.col("xp") == F.col("yp"), F.lit(False))
    units = x.join(y, F.col("xt") == F.col("yt")).where(within | beside | above)
    units = materialize(units.withColumn("unit", F.monotonically_increasing_id()), "ngram-units")
    placed = leaves.join(pure, (F.col("token") == F.col("_t")) & (F.col("kind") == F.col("_k")) & (F.col("comp") == F.col("_p")), "left").drop("_t", "_k")
    placed = placed.join(groups.select(F.col("token").alias("_t"), F.col("kind").alias("_k"), F.col("pure").alias("_q"), "chunks"), (F.col("token") == F.col("_t")) & (F.col("kind") == F.col("_k")) & F.col("_p").eqNullSafe(F.col("_q")))
    placed = placed.withColumn("_c", F.pmod(F.xxhash64("doc_id"), F.col("chunks").cast("long")).cast("int")).select("token", "doc_id", "comp", "n", "kind", "sig", "_p", "_c")

    def flank(s: str) -> DataFrame:
        on = (F.col("token") == F.col(f"{s}t")) & (F.col("kind") == F.col(f"{s}k")) & F.col("_p").eqNullSafe(F.col(f"{s}p")) & (F.col("_c") == F.col(f"{s}c"))
        one = same_cell & (F.col("xc") == F.col("yc"))
        mine = units.where(~one) if s == "y" else units
        side = F.lit(0 if s == "x" else 1)
        return mine.join(placed, on).select(F.col("unit").alias("u1"), F.lit(-1).cast("long").alias("u2"), side.alias("side"), "n", "doc_id", "comp", "sig")

    return flank("x").unionByName(flank("y"))


def candidates(texts: DataFrame, hot: tuple[np.ndarray, np.ndarray], first_round: bool) -> DataFrame:
    """(a, b): in the first round, pairs of representatives that span the blocks of each document's leading shingles.

    In the second, pairs of components: what they join holds every two components that may link. texts: doc_id, comp, text.
    """
    spark = texts.sparkSession
    rows = texts.select("doc_id", "comp", "text").mapInArrow(_prefix_rows(spark.sparkContext.broadcast(hot), first_round), _ROWS)
    if first_round:  # a few rows per document, which cost less to keep than to make again
        rows = materialize(rows, "ngram-leading")
    blocks = (
        rows.where("token is not null")
        .select("token", "doc_id", "comp")
        .repartition("token")  # rows without the two digests: most shingles are of one document, which combining them first would only widen
        .groupBy("token")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n_docs"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"))
        .where("low < high")
        .groupBy("n_docs", "x", "y").agg(F.min("token").alias("block"))
    )
    blocks = materialize(blocks.select("block", "n_docs"), "ngram-blocks")
    some = blocks.unionByName(spark.range(1).select(F.lit(None).cast("long").alias("block"), F.lit(0).cast("long").alias("n_docs")))
    found = attach(rows, some, "token", "block", "inner", null_safe=True, size=80 * blocks.count())
    found = materialize(found.select("token", "doc_id", "comp", "n", "kind", "sig", "n_docs"), "ngram-rows")
    sigs = found.where("token is null").select("doc_id", "n", "kind", "sig")
    leaves = found.where("token is not null").select("token", "doc_id", "comp", "n_docs").join(sigs, "doc_id")
    plain = leaves.where(F.col("n_docs") <= CHUNK).select(F.col("token").alias("u1"), F.lit(0).cast("long").alias("u2"), F.lit(0).alias("side"), "n", "doc_id", "comp", "sig")
    if blocks.where(F.col("n_docs") > CHUNK).isEmpty():
        units = plain
    elif first_round:  # large blocks are dealt to chunks twice, by two seeds
        chunks = F.ceil(F.col("n_docs") / CHUNK).cast("long")
        twice = leaves.where(F.col("n_docs") > CHUNK).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))
        place = 1 + F.pmod(F.xxhash64("doc_id", "seed"), chunks) + F.col("seed") * chunks
        units = plain.unionByName(twice.select(F.col("token").alias("u1"), place.cast("long").alias("u2"), F.lit(0).alias("side"), "n", "doc_id", "comp", "sig"))
    else:
        units = plain.unionByName(_cut(leaves.where(F.col("n_docs") > CHUNK).drop("n_docs"), F.lit(1), CHUNK))
    dealt = units.repartition("u1", "u2").sortWithinPartitions("u1", "u2")
    return dealt.mapInArrow(_tree_task(first_round), "a long, b long")


def _frequent(features: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles with their counts, sorted by shingle: HOT_MOST at most, the rest of the order needs no list."""
    listed = features.where("token is not null").groupBy("token").agg(F.sum("freq").alias("freq"))
    listed = materialize(listed.where(F.col("freq") >= max(4.0, HOT_SHARE * n_docs)), "ngram-frequent")
    least, n = 0, 0
    for r in listed.groupBy(F.floor(F.log2("freq")).alias("p")).count().orderBy(F.desc("p")).collect():  # at most 64 rows
        n += r["count"]
        if n > HOT_MOST:
            least = 2 << r["p"]
            break
    rows = listed.where(F.col("freq") >= least).toArrow()
    order = np.argsort(np.asarray(rows["token"]).view(np.uint64))
    return np.asarray(rows["token"]).view(np.uint64)[order], np.asarray(rows["freq"])[order]


def link_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``documents`` (doc_id, text)."""
    spark = documents.sparkSession
    bounded_batches(spark)
    with passing(spark) as keep:
        return keep(materialize(_linked(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))), "ngram-components"))


def _linked(docs: DataFrame) -> DataFrame:
    features = materialize(docs.mapInArrow(_features, _FEATURES), "ngram-features")
    rows = features.where("n is not null").select("doc_id", "n", "d1", "d2")
    hot = _frequent(features, rows.count())

    filled = rows.where("n > 0")
    classes = materialize(filled.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "ngram-classes")
    reps = classes.select(F.col("rep").alias("node")).distinct()
    # One text for each representative, also where a doc_id repeats with different texts.
    texts = attach(docs, materialize(reps, "ngram-reps"), "doc_id", "node", "left_semi")

    near = candidates(texts.withColumn("comp", F.col("doc_id")), hot, first_round=True)
    best = near.groupBy("a", "b").agg(F.count("*").alias("votes")).groupBy("a").agg(F.max(F.struct("votes", (-F.col("b")).alias("last"))).alias("m"))
    best = materialize(best.select("a", (-F.col("m.last")).alias("b")), "ngram-near")
    first_links = materialize(verified(best, texts), "ngram-links")
    first_comps = connected_components(first_links, "a", "b").select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    comps = materialize(reps.join(first_comps, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("_c", "node").alias("comp")), "ngram-comps")

    open_pairs = candidates(attach(docs, comps, "doc_id", "node", "inner"), hot, first_round=False)
    joined = materialize(open_pairs, "ngram-pairs")
    links = first_links
    if not joined.isEmpty():
        links = materialize(region_links(joined, comps, filled.select("doc_id", "n"), texts), "ngram-links").union(first_links)
    final = connected_components(links, "a", "b").select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    named = classes.join(final, F.col("rep") == F.col("_n"), "left").select("n", "d1", "d2", F.coalesce("_c", "rep").alias("component_id"))
    joined = filled.select("doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return joined.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
