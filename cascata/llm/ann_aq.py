"""Approximate nearest neighbours by additive quantisation, with exact reranking.

A vector's direction is encoded as the sum of one codeword from each of ``books`` full-dimensional codebooks; its length, of
any magnitude, is kept beside it. Codebooks start as k-means of the residuals and are re-centred in turn; codes come from a
beam search over all books. The index keeps, for every distinct vector, its codes, its length and the norm of its
reconstruction. A query makes a table of its inner products with all codewords, adds up ``books`` entries per candidate,
corrects the sum by the stored norms, keeps the best ``rerank`` candidates, and scores those on the original vectors in
double precision.

Equal vectors are one entry of the index, so that copies never crowd out other candidates; after the rerank an entry
stands for its smallest vec_ids, one more than are asked for. Candidates with equal approximate scores are kept by vec_id.

Training uses at most ``SAMPLE`` vectors, chosen by hash; the index covers every vector. Codebooks are broadcast: their size
is books * 256 * dimension * 4 bytes, whatever the corpus. All queries meet all codes, in blocks: a task holds one block of
queries and streams one part of the code chunks past it. There are at most ``MOST_PARTS`` parts, so that what tasks return is
bounded by queries * rerank * ``MOST_PARTS``. A coarse partition that is only probed in part isn't used: on the given vectors,
which have no clusters, half of all cells must be probed for a recall of 0.9.

Vectors that are null, empty, zero, of another dimension than most, or hold null or non-finite components take no part.
Rows that repeat a vec_id count as one vector (the smallest). With fewer candidates than asked for, all are returned.
Ties go to the smaller vec_id. An empty table gives an empty result; extra columns are ignored. Vectors of any length are
one row; a task holds some thousand vectors at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cascata.session import materialize

BOOKS, WORDS, BEAM, SAMPLE = 24, 256, 4, 16384
RERANK = 384
CHUNK, QUERY_BLOCK, QUERIES_AT_ONCE = 4096, 2048, 256
CHUNKS_PER_PART, MOST_PARTS = 16, 32


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 5) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
        lost = np.flatnonzero(n == 0)
        if len(lost):
            centres[lost] = x[rng.choice(len(x), len(lost))]
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows x books) by beam search: each step extends the best ``beam`` partial sums by every codeword."""
    m, k, d = books.shape
    out = np.zeros((len(x), m), np.uint8)
    norms = (books**2).sum(2)
    for at in range(0, len(x), 512):
        part = x[at : at + 512].astype(np.float32)
        n = len(part)
        rest, cost, codes = part[:, None, :], np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.uint8)
        for j in range(m):
            b = rest.shape[1]
            gain = norms[j][None, None, :] - 2 * (rest.reshape(n * b, d) @ books[j].T).reshape(n, b, k)
            total = (cost[:, :, None] + gain).reshape(n, b * k)
            keep = min(beam, b * k)
            best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
            cost = np.take_along_axis(total, best, 1)
            parent, word = best // k, (best % k).astype(np.uint8)
            codes = np.concatenate((np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None]), axis=2)
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - books[j][word]
        out[at : at + n] = codes[np.arange(n), np.argmin(cost, 1)]
    return out


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 1, seed: int = 7) -> np.ndarray:
    """Codebooks (books x words x dimension): k-means of the residuals, then ``rounds`` of beam encoding and re-centring."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    rest, out = x.copy(), []
    for _ in range(books):
        centres = _kmeans(rest, words, rng)
        centres = np.concatenate((centres, np.repeat(centres[:1], words - len(centres), 0)))
        rest = rest - centres[np.argmin((centres**2).sum(1) - 2 * rest @ centres.T, axis=1)]
        out.append(centres)
    found = np.stack(out).astype(np.float32)
    for _ in range(rounds):
        codes = encode(x, found, 4)
        rest = x - reconstruct(codes, found)
        for j in range(books):
            total = np.zeros_like(found[j])
            np.add.at(total, codes[:, j], rest + found[j][codes[:, j]])
            n = np.bincount(codes[:, j], minlength=words)
            moved = found[j].copy()
            moved[n > 0] = total[n > 0] / n[n > 0, None]
            rest += found[j][codes[:, j]] - moved[codes[:, j]]
            found[j] = moved
    return found


def reconstruct(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(books.shape[0]))


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions in single precision, and lengths divided by 1024, which can't overflow."""
    x = x.astype(np.float64)
    most = np.abs(x).max(axis=1)
    x = x / most[:, None]
    length = np.sqrt((x**2).sum(axis=1))
    return (x / length[:, None]).astype(np.float32), most * (length / 1024)


def table_scores(queries: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """queries x codes: inner products with the reconstructions, from tables of inner products with the codewords."""
    total = np.zeros((len(queries), len(codes)), np.float32)
    for j in range(books.shape[0]):
        total += (queries @ books[j].T)[:, codes[:, j]]
    return total


def approximate(queries: np.ndarray, query_lengths: np.ndarray, codes: np.ndarray, lengths: np.ndarray, norms: np.ndarray, books: np.ndarray, euclidean: bool) -> np.ndarray:
    """queries x codes, larger is nearer: the inner product over the query's length, or minus the squared distance up to the query's own."""
    cosine = table_scores(queries, codes, books) / norms
    with np.errstate(over="ignore", invalid="ignore"):
        score = 2 * query_lengths[:, None] * (cosine * lengths) - lengths**2 if euclidean else cosine * lengths
    return np.nan_to_num(score, nan=-np.finfo(float).max)


def cut(scores: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` largest of each row with their ids; of equal ones at the border those with the smallest ids."""
    if scores.shape[1] <= keep:
        return scores, ids
    best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
    border = np.take_along_axis(scores, best, 1).min(axis=1)
    for i in np.flatnonzero((scores >= border[:, None]).sum(axis=1) > keep):
        best[i] = np.lexsort((ids[i], -scores[i]))[:keep]
    return np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)


def valid_vectors(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part, of one dimension."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = embeddings.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & sound).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    rows = materialize(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "ann-vectors")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (common["d"] if common else -1))


def _stack(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1)


_PACKED = "ids binary, codes binary, lengths binary, norms binary"


def _index(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.binary()) for c in _PACKED.split(", ")])
        books = shared.value
        for batch in batches:
            ids, x = np.asarray(batch.column("vec_id")), _stack(batch.column("v"))
            for at in range(0, len(ids), CHUNK):
                directions, lengths = units(x[at : at + CHUNK])
                codes = encode(directions, books)
                norms = np.maximum(np.sqrt((reconstruct(codes, books) ** 2).sum(1)), 1e-6).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in (ids[at : at + CHUNK].tobytes(), codes.tobytes(), lengths.tobytes(), norms.tobytes())], schema=schema)

    return rows


class _Block:
    """A block of queries and the best candidates so far."""

    def __init__(self, books: np.ndarray, rerank: int, euclidean: bool):
        self.books, self.rerank, self.euclidean = books, rerank, euclidean
        self.names, self.vectors = [], []
        self.best: list[tuple[np.ndarray, np.ndarray]] = []

    def meet(self, ids: bytes, codes: bytes, lengths: bytes, norms: bytes) -> None:
        if not self.best:
            self.names, self.vectors = np.concatenate(self.names), np.concatenate(self.vectors)
            self.directions, self.lengths = units(self.vectors)
            self.best = [(np.zeros((min(QUERIES_AT_ONCE, len(self.names) - at), 0)), np.zeros((min(QUERIES_AT_ONCE, len(self.names) - at), 0), np.int64)) for at in range(0, len(self.names), QUERIES_AT_ONCE)]
        ids, codes = np.frombuffer(ids, np.int64), np.frombuffer(codes, np.uint8).reshape(-1, self.books.shape[0])
        lengths, norms = np.frombuffer(lengths, np.float64), np.frombuffer(norms, np.float32)
        for i, (score, found) in enumerate(self.best):
            some = slice(i * QUERIES_AT_ONCE, (i + 1) * QUERIES_AT_ONCE)
            now = approximate(self.directions[some], self.lengths[some], codes, lengths, norms, self.books, self.euclidean)
            now, kept = cut(now, np.broadcast_to(ids, now.shape), self.rerank)
            self.best[i] = cut(np.concatenate((score, now), 1), np.concatenate((found, kept), 1), self.rerank)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for i, (score, found) in enumerate(self.best):
            names = np.repeat(self.names[i * QUERIES_AT_ONCE : (i + 1) * QUERIES_AT_ONCE], found.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(found.ravel()), pa.array(score.ravel())], names=["query_id", "vec_id", "approx"])


def _best(shared, rerank: int, euclidean: bool):
    """Rows sorted by block and part, a part's queries (with v) before its code chunks (with ids)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, last, block = shared.value, None, None
        for batch in batches:
            place = np.stack([np.asarray(batch.column(c)) for c in ("block", "part", "kind")], axis=1)
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(place)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                *here, kind = place[a].tolist()
                if here != last:
                    if block is not None:
                        yield from block.rows()
                    last, block = here, _Block(books, rerank, euclidean)
                if kind == 0:
                    block.names.append(np.asarray(batch.column("vec_id").slice(a, b - a)))
                    block.vectors.append(_stack(batch.column("v").slice(a, b - a)))
                elif len(block.names):
                    for row in zip(*(batch.column(c).slice(a, b - a) for c in ("ids", "codes", "lengths", "norms"))):
                        block.meet(*(x.as_py() for x in row))
        if block is not None:
            yield from block.rows()

    return score


def distinct_vectors(vectors: DataFrame, most: int) -> DataFrame:
    """(rep, vec_id, v): for each distinct vector its ``most`` smallest vec_ids; rep is the smallest. Tasks cut to that many before the shuffle."""
    same = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.withColumn("_m", F.row_number().over(same)).where(F.col("_m") <= most)
    return few.select(F.min("vec_id").over(Window.partitionBy("v")).alias("rep"), "vec_id", "v")


def search(embeddings: DataFrame, is_query, k: int = 20, rerank: int = RERANK, books: int = BOOKS, euclidean: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best found for each row that ``is_query`` (a Column on vec_id) selects.

    score is the inner product, or the squared distance with ``euclidean``.
    """
    spark = embeddings.sparkSession
    vectors = valid_vectors(embeddings)
    members = materialize(distinct_vectors(vectors, k + 1), "ann-distinct")
    entries = members.where("vec_id = rep").select("vec_id", "v")
    sample = entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(train(units(_stack(sample["v"]))[0], books))
    index = materialize(entries.mapInArrow(_index(shared), _PACKED), "ann-index")
    queries = vectors.where(is_query)
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    n_parts = min(MOST_PARTS, max(1, -(-index.count() // CHUNKS_PER_PART)))
    place = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(place(n_blocks, "vec_id").alias("block"), F.lit(0).alias("kind"), "vec_id", "v").withColumn("part", every(n_parts))
    right = index.withColumn("kind", F.lit(1)).withColumn("part", place(n_parts, "ids")).withColumn("block", every(n_blocks))
    met = left.unionByName(right, allowMissingColumns=True).repartition("block", "part").sortWithinPartitions("block", "part", "kind")
    near = met.mapInArrow(_best(shared, rerank, euclidean), "query_id long, vec_id long, approx double")
    if n_parts > 1:
        order = Window.partitionBy("query_id").orderBy(F.desc("approx"), "vec_id")
        near = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= rerank)
    pairs = near.select("query_id", "vec_id").join(entries, "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    one = (lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))) if euclidean else (lambda a, b: a.cast("double") * b.cast("double"))
    score = F.aggregate(F.zip_with("q", "v", one), F.lit(0.0), lambda acc, x: acc + x)
    order = Window.partitionBy("query_id").orderBy(F.asc("score") if euclidean else F.desc("score"), "vec_id")
    ranked = pairs.select("query_id", "vec_id", score.alias("score")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    # An entry's members tie; of k + 1 entries, or of one, k rows are left beside the query's own.
    full = ranked.select("query_id", F.col("vec_id").alias("rep"), "score").join(members.select("rep", "vec_id"), "rep").where("vec_id <> query_id")
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
