"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text is a bag of byte-class trigrams (letters by case, digits, spaces, line ends, and punctuation signs apart) plus
terms for how much of it repeats.  Counts are damped, weighted by inverse document frequency and projected by a
truncated SVD fitted on a bounded labelled sample; the sample's vectors are broadcast, and every document takes exact
cosine products with all of them in blocks.  The nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.labelled import fold, sample

#: labelled rows of each label that are broadcast, dimensions of a vector, neighbours that vote, power of similarity
MOST, RANK, NEIGHBOURS, POWER, BLOCK = 1500, 32, 15, 8, 512
#: blocks of a Krylov basis, and its restarts at most
DEPTH, ROUNDS = 5, 60

_SIGNS = b"#*$%&|<>!?.,:;-\"'()"
_CLASS = np.full(256, 2, np.int64)  # other signs
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:] = 3, 4, 5, 5
_CLASS[[0x20, 0x09, 0x0D, 0x0B, 0x0C]], _CLASS[0x0A] = 0, 1
for _i, _c in enumerate(_SIGNS):
    _CLASS[_c] = 6 + _i
_N = 6 + len(_SIGNS)
_EXTRA = 6
DIMENSIONS = _N**3 + _EXTRA


def _repeats(part: K.Slice, k: int) -> np.ndarray:
    """Share of k-word windows that repeat an earlier one, per row."""
    rows, _ = K.shingle_sets(part, k)
    total = np.maximum(part.n_words - k + 1, 1)
    return 1 - np.minimum(np.bincount(rows, minlength=part.rows), total) / total


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(low, matrix) for runs of rows; a text without bytes has a zero row."""
    for part in K.slices(column, K.NON_SPACE, lower=False, limit=K.SLICE_BYTES // 2, most=256):
        kinds = _CLASS[part.data]
        out = np.zeros((part.rows, DIMENSIONS), np.float32)
        if len(kinds) > 2:
            row = np.repeat(np.arange(part.rows), np.diff(part.offsets))
            whole = row[2:] == row[:-2]
            code = (kinds[:-2] * _N + kinds[1:-1]) * _N + kinds[2:]
            code = code[whole] + row[2:][whole] * _N**3
            out[:, : _N**3] = np.bincount(code, minlength=part.rows * _N**3).reshape(part.rows, -1)
        size = np.maximum(out.sum(1, keepdims=True), 1)
        out[:, : _N**3] = np.sqrt(out[:, : _N**3] / size)
        some = (part.n_words > 0).astype(np.float32)
        for i, k in enumerate((1, 3)):
            share = _repeats(part, k).astype(np.float32)
            share = np.where(part.n_words >= 20, share, 0) if k == 3 else np.where(part.n_words >= 20, np.maximum(share - 0.5, 0), 0)
            out[:, _N**3 + 2 * i] = 1.5 * some * np.sqrt(share)
            out[:, _N**3 + 2 * i + 1] = 0.3 * some * np.sqrt(1 - share)
        yield part.low, out


@dataclass
class Model:
    weights: np.ndarray
    basis: np.ndarray  # DIMENSIONS x rank
    vectors: np.ndarray  # labelled rows x rank, of unit length
    labels: np.ndarray
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.weights) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        some = np.flatnonzero(x.any(axis=1))
        k = min(NEIGHBOURS, len(self.labels))
        for low in range(0, len(some) if k else 0, BLOCK):
            own = some[low : low + BLOCK]
            cosine = self.project(x[own]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cosine, near, 1).astype(float), 1e-3) ** POWER
            out[own] = (vote * self.labels[near]).sum(1) / vote.sum(1)
        return np.clip(out, 0, 1)


def strongest(matrix: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``rank`` largest eigenvalues of a symmetric matrix without large negative ones, falling, and their vectors.

    Restarted block Krylov iteration until they stand still; nothing of the matrix's size is held beside it.  A matrix
    that is small, or won't settle, is decomposed whole.
    """
    n, wide = len(matrix), 2 * rank
    if n > DEPTH * wide:
        by = lambda q: np.concatenate([matrix[i : i + BLOCK].astype(float) @ q for i in range(0, n, BLOCK)])
        own = np.linalg.qr(np.random.default_rng(0).standard_normal((n, wide)))[0]
        for _ in range(ROUNDS):
            grown = [own]
            for _ in range(DEPTH - 1):
                grown.append(np.linalg.qr(by(grown[-1]))[0])
            basis = np.linalg.qr(np.concatenate(grown, axis=1))[0]
            moved = by(basis)
            power, turn = np.linalg.eigh(basis.T @ moved)
            own, power, moved = basis @ turn[:, : -wide - 1 : -1], power[: -rank - 1 : -1], moved @ turn[:, : -rank - 1 : -1]
            if np.linalg.norm(moved - own[:, :rank] * power, axis=0).max() <= 1e-9 * max(power[0], 1e-9):
                return power, own[:, :rank]
    power, left = np.linalg.eigh(matrix.astype(float))
    return power[: -rank - 1 : -1], left[:, : -rank - 1 : -1]


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """Fit on at most ``most`` rows of each label; with no labelled rows every score is one half."""

    def run(batches):
        for batch in batches:
            for low, x in features(batch.column(0)):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(low, len(x)).cast(pa.int32()), pa.array([pa.compress(r.astype(np.float16).tobytes(), codec="zstd", asbytes=True) for r in x], pa.binary())], names=["label", "x"])

    rows = sample(docs, labels, "quality", {0: most, 1: most}).mapInArrow(run, "label int, x binary").collect()
    rows.sort(key=lambda r: (r[0], bytes(r[1])))
    if not rows:
        return Model(np.ones(DIMENSIONS, np.float32), np.zeros((DIMENSIONS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    y = np.array([r[0] for r in rows], float)

    def row(r) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(pa.decompress(bytes(r[1]), decompressed_size=2 * DIMENSIONS, codec="zstd", asbytes=True), np.float16)
        at = np.flatnonzero(x).astype(np.uint16)
        return at, x[at]

    held = [row(r) for r in rows]
    times = np.zeros(DIMENSIONS, np.int64)
    for at, _ in held:
        times[at] += 1
    used = np.flatnonzero(times)
    weights = (1 + np.log((1 + len(held)) / (1 + times))).astype(np.float32)
    column = np.cumsum(times > 0) - 1
    blocks = range(0, len(held), BLOCK)

    def weighted(low: int) -> np.ndarray:
        """BLOCK rows from ``low``, dense in the used columns: never all rows at once."""
        out = np.zeros((len(held[low : low + BLOCK]), len(used)), np.float32)
        for i, (at, values) in enumerate(held[low : low + BLOCK]):
            out[i, column[at]] = values
        return np.multiply(out, weights[used], out=out)

    # right singular vectors from the Gram matrix of the rows, at most 2 * MOST of them whatever the columns
    gram = np.empty((len(held), len(held)), np.float32)
    for low in blocks:
        own = weighted(low)
        for other in range(0, low + 1, BLOCK):
            tile = own @ (own if other == low else weighted(other)).T
            gram[low : low + BLOCK, other : other + BLOCK], gram[other : other + BLOCK, low : low + BLOCK] = tile, tile.T
    power, left = strongest(gram, RANK)
    del gram
    strong = power > 1e-8 * max(power[0], 1e-9)
    left = (left[:, strong] / np.sqrt(power[strong])).astype(np.float32)
    right = np.zeros((len(used), left.shape[1]), np.float32)
    for low in blocks:
        right += weighted(low).T @ left[low : low + BLOCK]
    basis = np.zeros((DIMENSIONS, max(1, right.shape[1])), np.float32)
    basis[used, : right.shape[1]] = right
    model = Model(weights, basis, np.zeros((0, basis.shape[1]), np.float32), y, float(y.mean()))
    projected = np.concatenate([weighted(low) @ basis[used] for low in blocks])
    model.vectors = (projected / np.maximum(np.linalg.norm(projected, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    K.release()
    return model


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, x in features(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(x)), pa.array(model.value.score(x))], names=["doc_id", "score"])
        K.release()

    return run


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts score the sample's share of label 1, as do texts without any usable feature.  Rows are scored
    each, repeated ones alike; a null doc_id is not held out; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` predicted good, all columns kept; texts without words are kept out only by their score."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for low, x in features(batch.column(at)):
                keep[low : low + len(x)] = model.value.score(x) >= 0.5
            yield batch.filter(pa.array(keep))
        K.release()

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    from tessera.llm.workspace import table

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
