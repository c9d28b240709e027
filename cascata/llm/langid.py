"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are runs of one to three characters of the lower-cased text, with every run of non-letters as one blank, hashed
into 2^15 bins; a bin weighs (1 + log count) times its inverse document frequency, and a text's vector has length one.
Document frequencies come from all labelled training texts. Weights are trained by follow-the-regularised-leader with
L1 and L2 penalties on at most ``SAMPLE_ROWS`` labelled rows, ``SAMPLE_PER_LABEL`` of each label on average, chosen by hash.
A fifth of that sample is held back to fit the temperature that divides the scores before the softmax.

Rows are for training unless crc32(doc_id as text) mod 4 is 2, or doc_id or lang is null. A prediction sees the text alone.
Null texts and those without letters get ``und`` with score 0, as does every text if there was nothing to learn from; a
text in letters that no training text has gets some label, with a low score as a rule. Repeated rows are predicted alike. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cascata.llm.common import bounded_batches, fresh
from cascata.llm.tokens import pieces
from cascata.session import materialize

BITS = 15
DIMENSIONS = 1 << BITS
LONGEST = 3
SAMPLE_ROWS, SAMPLE_PER_LABEL = 20_000, 1_000
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def count_grams(raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """(bins, counts) of each text, or None where it has no letters."""
    texts = [raw[a : b - 1].tobytes().decode("utf-8", "replace").lower() for a, b in zip(bounds[:-1], bounds[1:])]
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    letter = _is_letter()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of the characters after a word stands for the blank
    codes = np.where(letter, codes, 0x20)[keep].astype(np.uint64)
    owner = owner[keep]
    letter = letter[keep]
    grams = []
    for n in range(1, LONGEST + 1):
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = (h + codes[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        ok = owner[:m] == owner[n - 1 :]
        if n == 1:
            ok &= letter
        grams.append((np.where(ok, h >> np.uint64(64 - BITS), DIMENSIONS).astype(np.int32), m))
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        if a == b or not grams:
            yield None
            continue
        counts = sum(np.bincount(g[a : min(b, m)], minlength=DIMENSIONS + 1) for g, m in grams)[:DIMENSIONS]
        bins = np.flatnonzero(counts)
        yield (bins, counts[bins]) if len(bins) else None


_VECTORS = "label string, order long, bins binary, counts binary, docs long"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: document frequencies (bins, counts under a null label); and the vectors of the sampled rows."""
    schema = pa.schema([("label", pa.string()), ("order", pa.int64()), ("bins", pa.binary()), ("counts", pa.binary()), ("docs", pa.int64())])
    frequency, docs = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        labels, chosen, order = batch.column("lang"), batch.column("chosen"), batch.column("order")
        for a, b, raw, bounds in pieces(batch.column("text")):
            for i, found in enumerate(count_grams(raw, bounds), a):
                if found is None:
                    continue
                bins, counts = found
                frequency[bins] += 1
                docs += 1
                if chosen[i].as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([labels[i].as_py()]), pa.array([order[i].as_py()]), pa.array([bins.astype(np.uint16).tobytes()], pa.binary()), pa.array([counts.astype(np.uint32).tobytes()], pa.binary()), pa.array([1], pa.int64())], schema=schema)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([0], pa.int64()), pa.array([b""], pa.binary()), pa.array([frequency.tobytes()], pa.binary()), pa.array([docs])], schema=schema)


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table["counts"])
    return pa.table({"counts": pa.array([total.tobytes()], pa.binary()), "docs": pa.array([sum(table["docs"].to_pylist())], pa.int64())})


def weigh(bins: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1 + np.log(counts)) * idf[bins]
    return values / max(np.sqrt((values**2).sum()), 1e-12)


class Model:
    """Labels, idf, weights (bins x labels, mostly zero), biases and the temperature."""

    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.labels, self.idf, self.weights, self.bias, self.temperature = labels, idf, weights, bias, temperature

    def scores(self, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weigh(bins, counts, self.idf) @ self.weights[bins] + self.bias

    def predict(self, bins: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        p = softmax(self.scores(bins, counts) / self.temperature)
        best = int(np.argmax(p))
        return self.labels[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_labels: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal on (bins, values) rows; a last bin that every row has is the bias and has no penalty."""
    z, n = np.zeros((DIMENSIONS + 1, n_labels)), np.zeros((DIMENSIONS + 1, n_labels))
    one, two = np.full(DIMENSIONS + 1, l1), np.full(DIMENSIONS + 1, l2)
    one[-1] = two[-1] = 0.0

    def solve(bins):
        zb, nb = z[bins], n[bins]
        w = -(zb - np.sign(zb) * one[bins, None]) / ((beta + np.sqrt(nb)) / alpha + two[bins, None])
        return np.where(np.abs(zb) > one[bins, None], w, 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bins, values = np.append(rows[i][0], DIMENSIONS), np.append(rows[i][1], 1.0)
            w = solve(bins)
            p = softmax(values @ w)
            p[y[i]] -= 1.0
            g = values[:, None] * p
            step = (np.sqrt(n[bins] + g * g) - np.sqrt(n[bins])) / alpha
            z[bins] += g - step * w
            n[bins] += g * g
    w = solve(np.arange(DIMENSIONS + 1))
    return w[:-1], w[-1]


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden-section search over its logarithm.

    Targets are smoothed as in Platt scaling, (n + 1) / (n + 2) for the right label of n rows, so that a sample without
    errors doesn't make every score 1.
    """
    right = (len(y) + 1) / (len(y) + 2)
    rest = (1 - right) / max(1, scores.shape[1] - 1)
    target = np.full(scores.shape, rest)
    target[np.arange(len(y)), y] = right

    def loss(log_t: float) -> float:
        return -float((target * np.log(np.maximum(softmax(scores / np.exp(log_t)), 1e-12))).sum(axis=1).mean())

    a, b, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of ``_VECTORS`` in one task of an executor: a row per label, and under a null label the idf and the temperature.

    The driver holds the model alone: neither the sample nor what training keeps for each weight.
    """
    schema = pa.schema([("label", pa.string()), ("weights", pa.binary()), ("bias", pa.float64()), ("temperature", pa.float64())])
    sample, frequency, docs = [], np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for label, order, bins, counts, n in zip(*(batch.column(c).to_pylist() for c in ("label", "order", "bins", "counts", "docs"))):
            if label is None:
                frequency += np.frombuffer(counts, np.int64)
                docs += n
            else:
                sample.append((order, label, bins, counts))
    if not sample:
        return
    sample.sort()  # rows come in any order, and reruns must agree
    idf = np.log((1 + docs) / (1 + frequency)) + 1
    labels = sorted({label for _, label, _, _ in sample})
    place = {x: i for i, x in enumerate(labels)}
    y = np.array([place[label] for _, label, _, _ in sample])
    rows = [(np.frombuffer(bins, np.uint16).astype(np.int64), np.frombuffer(counts, np.uint32)) for _, _, bins, counts in sample]
    rows = [(bins, weigh(bins, counts, idf)) for bins, counts in rows]
    back = np.arange(len(rows)) % 5 == 4  # rows are in hash order
    fitted = [rows[i] for i in np.flatnonzero(~back)]
    weights, bias = train_ftrl(fitted, y[~back], len(labels))
    model = Model(labels, idf, weights.astype(np.float32), bias)
    if back.any():
        model.temperature = fit_temperature(np.array([rows[i][1] @ model.weights[rows[i][0]] + bias for i in np.flatnonzero(back)]), y[back])
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([idf.tobytes()], pa.binary()), pa.array([0.0]), pa.array([float(model.temperature)])], schema=schema)
    for i, label in enumerate(labels):
        yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([model.weights[:, i].tobytes()], pa.binary()), pa.array([float(bias[i])]), pa.nulls(1, pa.float64())], schema=schema)


def fit(documents: DataFrame, per_label: int = SAMPLE_PER_LABEL, most: int = SAMPLE_ROWS) -> Model | None:
    """Train on the labelled training rows of ``documents`` (doc_id, text, lang); None if there are none."""
    bounded_batches(documents.sparkSession)
    usable = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = dict(usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect())
    if not sizes:
        return None
    each = min(per_label, most // len(sizes))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))])
    order = F.xxhash64(F.lit("langid"), F.col("doc_id").cast("string"))
    marked = usable.select("text", "lang", order.alias("order"), (F.pmod("order", F.lit(1_000_000)) < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0)) * 1_000_000).alias("chosen"))

    seen = materialize(marked.mapInArrow(_survey, _VECTORS), "langid-survey")
    parts = seen.where("label is null").select("counts", "docs", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("p"))
    level = parts.groupBy("p").applyInArrow(_summed, "counts binary, docs long")  # at most 16 rows of one size
    level = level.select(F.lit(None).cast("string").alias("label"), F.lit(0).cast("long").alias("order"), F.lit(b"").alias("bins"), "counts", "docs")
    sample = seen.where("label is not null").orderBy("order", "label", "bins", "counts").limit(most)
    learnt = level.unionByName(sample).repartition(1).mapInArrow(_learn, "label string, weights binary, bias double, temperature double").collect()
    if not learnt:
        return None
    (common,) = (r for r in learnt if r["label"] is None)
    each = sorted((r for r in learnt if r["label"] is not None), key=lambda r: r["label"])
    weights = np.stack([np.frombuffer(bytes(r["weights"]), np.float32) for r in each], axis=1)
    return Model([r["label"] for r in each], np.frombuffer(bytes(common["weights"])), weights, np.array([r["bias"] for r in each]), common["temperature"])


def annotate(documents: DataFrame, model: Model | None, carry: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The ``carry`` columns of ``documents`` with label and score as ``names``, which replace columns of those names."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bins x labels weights, whatever the corpus
    carry = [c for c in carry if c.lower() not in names]
    (text,) = fresh(documents, "_text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found: list[tuple[str, float]] = []
            for _, _, raw, bounds in pieces(batch.column(text)):
                found += [(UNKNOWN, 0.0) if f is None or known is None else known.predict(*f) for f in count_grams(raw, bounds)]
            added = [pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *added], names=[*carry, *names])

    source = documents.select(*[f"`{c}`" for c in carry], F.col("text").alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in carry)
    return source.mapInArrow(rows, f"{schema}, `{names[0]}` string, `{names[1]}` double")


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``documents`` (doc_id, text)."""
    marked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return annotate(marked, model, ["doc_id", "held_out"])
