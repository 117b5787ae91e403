"""Toxic spans by a linear-chain conditional random field over two labels.

Tokens are labelled from the documents' labels: a word or word beginning that occurs in toxic documents and, beyond
chance, in no clean one marks its tokens.  The chain is trained on windows around such tokens and on clean windows.
Its emissions come from hashed features of a token's bytes (the word and its beginnings), so unseen inflections of a
toxic stem still weigh in; forward-backward marginals over the whole text give offending spans and the score.
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
from tessera.llm.workspace import Workspace, partitions

#: bits of the weight table; tokens on each side of a training window's middle; tokens of a block of the messages
BITS, REACH, STRIDE = 20, 6, 1024
#: bounds of training, all of them on labelled rows: rows of each label, marking features, windows a round, rounds, and
#: of clean texts one token in so many is the middle of a window of the first round
MOST_TOXIC, MOST_CLEAN, MOST_MARKS, WINDOWS, ROUNDS, EVERY = 1500, 4500, 20_000, 6000, 6, 200
#: tokens of an offending span have at least this marginal
MARGINAL = 0.5
_FEATURES = ("word", "b4", "b5", "b6")


def token_features(part: K.Slice) -> np.ndarray:
    """Tokens x features, 64-bit hashes; a beginning as long as its word counts as one too."""
    span = part.span_hasher()
    s, e = part.starts, part.ends
    columns = [span(s, e)]
    columns += [K.mix(span(s, np.minimum(s + k, e)) + np.uint64(k)) for k in (4, 5, 6)]
    return np.stack(columns, axis=1) if len(s) else np.zeros((0, len(_FEATURES)), np.uint64)


def _slot(features: np.ndarray) -> np.ndarray:
    return (features >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Chain:
    weights: np.ndarray  # log-odds of label 1 per feature slot
    bias: float
    move: np.ndarray  # 2 x 2 log potentials

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.bias + self.weights[_slot(features)].sum(1)

    def marginals(self, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(label 1) of every token; ``first`` holds each row's first token, one more entry at the end."""
        return _forward_backward(emission, first, self.move)[0]


def _sweep(odds: np.ndarray, first: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Odds messages along every row: v[0] = odds[0], v[t] = odds[t] * (a01 + a11 * v[t-1]) / (a00 + a10 * v[t-1]).

    Rows are cut into blocks that step together.  A step is a Moebius map, so a block's map is a 2 x 2 product; chaining
    the products gives each block the message that enters it, and one long row costs no more steps than a block has.
    """
    size = np.diff(first)
    n = -(-size // STRIDE)
    row = np.repeat(np.arange(len(size)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = first[:-1][row] + piece * STRIDE
    length = np.minimum(STRIDE, size[row] - piece * STRIDE)
    enter = np.full(len(row), -1.0)  # no message: the row's first token
    if len(row) and n.max() > 1:
        long = np.flatnonzero((n[row] > 1) & (piece < n[row] - 1))  # full blocks with one behind them
        top, low = np.tile([1.0, 0.0], (len(long), 1)).T.copy(), np.tile([0.0, 1.0], (len(long), 1)).T.copy()
        for t in range(STRIDE):
            o = odds[start[long] + t]
            top, low = o * (a[0, 1] * low + a[1, 1] * top), a[0, 0] * low + a[1, 0] * top
            if t == 0:
                begin = piece[long] == 0
                top[:, begin], low[:, begin] = np.stack([np.zeros(begin.sum()), o[begin]]), np.array([[0.0], [1.0]])
            scale = np.abs(top).max(0) + np.abs(low).max(0)
            top /= scale
            low /= scale
        value = 0.0
        for j, i in enumerate(long.tolist()):  # one step a block
            value = 1.0 if piece[i] == 0 else value
            value = float((top[0, j] * value + top[1, j]) / (low[0, j] * value + low[1, j]))
            enter[i + 1] = value
    out = np.empty(len(odds))
    order = np.argsort(-length, kind="stable")
    start, length, last = start[order], length[order], enter[order]
    active = len(length)
    for t in range(int(length[0]) if active else 0):
        while active and length[active - 1] <= t:
            active -= 1
        last = last[:active]
        o = odds[start[:active] + t]
        given = np.maximum(last, 0)
        moved = o * (a[0, 1] + a[1, 1] * given) / (a[0, 0] + a[1, 0] * given)
        last = np.where(last < 0, o, moved) if t == 0 else moved
        out[start[:active] + t] = last
    return out


def _forward_backward(emission: np.ndarray, first: np.ndarray, move: np.ndarray):
    """Marginals of label 1, and the messages (odds m(1) / m(0)) that training needs of them."""
    odds = np.exp(np.clip(emission, -30, 30))
    a = np.exp(move)
    ahead = _sweep(odds, first, a)
    back = _sweep(odds[::-1], len(odds) - first[::-1], a.T)[::-1] / odds
    both = ahead * back
    return both / (1 + both), ahead, back, odds, a


def train(features: np.ndarray, labels: np.ndarray, first: np.ndarray, rounds: int = 60) -> Chain:
    """Maximum conditional likelihood with a ridge, by adaptive gradient steps."""
    slots = _slot(features)
    used, where = np.unique(slots, return_inverse=True)
    where = where.reshape(slots.shape)
    w, bias, move = np.zeros(len(used)), -2.0, np.zeros((2, 2))
    speed_w, speed_b, speed_m = np.full(len(used), 1e-3), 1e-3, np.full((2, 2), 1e-3)
    inner = np.ones(len(labels), bool)
    inner[first[:-1]] = False
    inner = np.flatnonzero(inner)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (labels[inner - 1], labels[inner]), 1)
    n = max(1, len(labels))
    for _ in range(rounds):
        p, ahead, back, odds, a = _forward_backward(bias + w[where].sum(1), first, move)
        gap = labels - p
        grad_w = np.bincount(where.ravel(), weights=np.repeat(gap, where.shape[1]), minlength=len(used)) - 0.1 * w
        expected = np.zeros((2, 2))
        left, right = ahead[inner - 1], odds[inner] * back[inner]
        joint = np.stack([np.full(len(inner), a[0, 0]), a[0, 1] * right, a[1, 0] * left, a[1, 1] * left * right])
        expected += (joint / joint.sum(0)).sum(1).reshape(2, 2)
        grad_b, grad_m = gap.sum(), pairs - expected - 0.02 * move
        speed_w += grad_w**2
        speed_b += grad_b**2
        speed_m += grad_m**2
        w += 0.5 * grad_w / np.sqrt(speed_w)
        bias += 0.2 * grad_b / np.sqrt(speed_b)
        move += 0.1 * grad_m / np.sqrt(speed_m)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Chain(weights, float(bias) if n else -5.0, move)


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document counts (feature, toxic, clean), one row per feature and block of rows."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for part in K.slices(batch.column(0), K.ALNUM):
            features = token_features(part)
            row = np.repeat(part.row_of_word(), features.shape[1])
            order = np.lexsort((row, features.ravel()))
            f, row = features.ravel()[order], row[order]
            keep = np.ones(len(f), bool)
            keep[1:] = (f[1:] != f[:-1]) | (row[1:] != row[:-1])
            f, toxic = f[keep], label[part.low + row[keep]]
            edge = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, int)
            if len(edge):
                yes = np.add.reduceat(toxic.astype(np.int64), edge)
                count = np.diff(np.concatenate([edge, [len(f)]]))
                yield pa.RecordBatch.from_arrays([pa.array(f[edge].view(np.int64)), pa.array(yes), pa.array(count - yes)], names=["feature", "toxic", "clean"])


def _windows(marks: np.ndarray, reach: int, model=None):
    """Labelled windows: around tokens with a mined feature in toxic texts, and in clean texts around one token in
    ``EVERY`` or, with a model, around the tokens that it takes for toxic."""

    def run(batches):
        for batch in batches:
            for part in K.slices(batch.column(0), K.ALNUM):
                features = token_features(part)
                if not len(features):
                    continue
                flat = features.ravel()
                at = np.minimum(np.searchsorted(marks, flat), max(len(marks) - 1, 0))
                hit = (marks[at] == flat).reshape(-1, len(_FEATURES)).any(1) if len(marks) else np.zeros(len(features), bool)
                row, limit = part.row_of_word(), part.first_word
                label = batch.column(1).to_numpy(zero_copy_only=False)[part.low + row]
                hit &= label == 1
                if model is None:
                    near = np.concatenate([np.flatnonzero(hit), np.flatnonzero(label == 0)[::EVERY]])
                else:
                    near = np.flatnonzero((label == 0) & (model.value.marginals(model.value.emissions(features), limit) > 0.1))
                taken = np.zeros(len(features), bool)
                x, y = [], []
                for i in near.tolist():
                    low, high = max(limit[row[i]], i - reach), min(limit[row[i] + 1], i + reach + 1)
                    if not taken[i]:
                        taken[low:high] = True
                        x.append(features[low:high].tobytes())
                        y.append(hit[low:high].astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["x", "y"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Chain:
    """Train on a bounded sample of the labelled rows (``MOST_TOXIC``, ``MOST_CLEAN``), with at most ``MOST_MARKS`` marking
    features and ``WINDOWS`` windows a round; without toxic examples every token is clean."""
    sc, ws = docs.sparkSession.sparkContext, Workspace(docs.sparkSession, "toxic")
    taught = ws.save(sample(docs, labels, "toxic", {1: MOST_TOXIC, 0: MOST_CLEAN}), "taught").repartition(partitions(docs.sparkSession))
    n = dict(taught.groupBy("label").count().collect())
    yes, no = max(1, n.get(1, 0)), max(1, n.get(0, 0))
    counts = taught.mapInArrow(_presence, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = ws.save(counts, "counts")
    # log-likelihood ratio against the base rate, beyond what chance gives to any of all features
    surprise = F.col("toxic") * F.log(F.col("toxic") / (F.col("toxic") + F.col("clean")) / F.lit(yes / (yes + no)))
    bar = float(np.log(max(counts.count(), 1)))
    marked = counts.where("toxic >= 3 and toxic >= 30 * clean").where(surprise >= bar).orderBy(F.desc("toxic"), "feature").limit(MOST_MARKS).select("feature").collect()
    marks = np.sort(np.array([r[0] for r in marked], np.int64).view(np.uint64))
    if not len(marks):
        return Chain(np.zeros(1 << BITS, np.float32), -12.0, np.zeros((2, 2)))
    rows, chain = [], None
    for _ in range(ROUNDS):
        found = taught.mapInArrow(_windows(marks, REACH, None if chain is None else sc.broadcast(chain)), "x binary, y binary").orderBy(F.xxhash64("x"), "x").limit(WINDOWS).collect()
        rows += found
        if not found:
            break
        x = [np.frombuffer(bytes(r[0]), np.uint64).reshape(-1, len(_FEATURES)) for r in rows]
        y = np.concatenate([np.frombuffer(bytes(r[1]), np.uint8) for r in rows]).astype(np.int64)
        chain = train(np.concatenate(x), y, np.concatenate([[0], np.cumsum([len(v) for v in x])]))
    return chain


def _scorer(model, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column(1), K.ALNUM):
                p = model.value.marginals(model.value.emissions(token_features(part)), part.first_word)
                clean = K.sums_by_row(part.row_of_word(), p * np.log1p(-np.minimum(p, 1 - 1e-9)), part.rows)
                hot = np.flatnonzero(p >= MARGINAL)
                row = part.row_of_word()[hot]
                columns = [batch.column(0).slice(part.low, part.rows), pa.array(np.clip(1 - np.exp(clean), 0, 1))]
                if spans:
                    columns.append(pa.array(_offsets(part, hot, row), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "spans"][: len(columns)])

    return run


def _offsets(part: K.Slice, hot: np.ndarray, row: np.ndarray) -> list[list[dict]]:
    """Code-point offsets of offending runs of tokens, per row."""
    out: list[list[dict]] = [[] for _ in range(part.rows)]
    if not len(hot):
        return out
    points = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
    last = -2
    for i, r in zip(hot.tolist(), row.tolist(), strict=True):
        base = points[part.offsets[r]]
        if i == last + 1 and out[r]:
            out[r][-1]["end"] = int(points[part.ends[i]] - base)
        else:
            out[r].append({"start": int(points[part.starts[i]] - base), "end": int(points[part.ends[i]] - base)})
        last = i
    return out


def toxicity(docs: DataFrame, labels: DataFrame, spans: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, spans.

    The score takes in the marginal p of every token: 1 - product of (1 - p) ** p, so a token counts by its own weight
    and a long text's many small marginals don't add up to toxicity.  Spans are runs of tokens with a marginal of at
    least ``MARGINAL``, in code points.  Null and empty texts score 0 and have none; texts of any length are read whole.  Rows are scored each, repeated
    ones alike; a null doc_id is not held out; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    schema = "doc_id long, score double" + ", spans array<struct<start: long, end: long>>" * spans
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(model, spans), schema)
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"), *["spans"] * spans)


def query(spark, sf_dir):
    from tessera.llm.workspace import table

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
